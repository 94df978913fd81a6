"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks.llm import ann, bpe, conversation_repair, exact_dedup, licenses, lm_score, mixing, ngram_join, phrases, quality, secret_scan, toxicity, warc
from shuffleworks.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
    """
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    return rows.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_text(of("assign", "access", "hex")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("found")).alias("spans"),
    )


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, table(spark, sf_dir, "documents"))


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.find_licenses(table(spark, sf_dir, "documents")))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS stored FROM p)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN stored = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN stored <> page_id THEN stored END AS refers_to
    FROM m
    """
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query(mixing.sql("documents"))
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
    n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY ALL),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
    FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
    LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = n.doc_id
    """
)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query()
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@query()
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query(conversation_repair.sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


@query(phrases.sql())
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
