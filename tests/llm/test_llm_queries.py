"""Registered queries against SQL or rows, and the pipeline against its parts done by brute force."""

import re

import duckdb
import pytest

import corpus_pipeline
from shuffleworks.llm import mixing
from shuffleworks.llm.queries import QUERIES, SQL
from tests.checking import difference, duckdb_tables
from tests.llm.test_exact_dedup import brute as equal_groups
from tests.llm.test_ngram_join import brute as near_groups


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duckdb_tables(sf_dir), SQL[name]) is None


def test_each_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", ["op1_lm_score", "op4_toxicity", "op5_secret_scan", "op6_bpe", "op7_license_scan"])
def test_one_row_per_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = sorted(r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_after_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, before, sf_dir), "test")
        outputs[name] = (sorted(map(tuple, before.collect()), key=repr), sorted(map(tuple, docs.collect()), key=repr))
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows, kept = outputs["toxicity"]
    insults = re.compile("idiot|moron|scum|loser|worthless|pathetic")
    rude = [r for r in rows if len(insults.findall(r[1].lower())) > 2]
    assert set(kept) < set(rows) and len(set(kept) & set(rude)) <= 0.2 * len(rude)
    rows, kept = outputs["exact dedup"]
    assert sorted(r[0] for r in kept) == sorted({g[1] for g in equal_groups(rows)[0]})
    rows, kept = outputs["near dedup"]
    assert sorted(r[0] for r in kept) == sorted({g[2] for g in near_groups(rows, 5, 80)})
    rows, kept = outputs["mixing"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(mixing.sql("documents", columns="d.*")).fetchall(), key=repr) == kept
    rows, kept = outputs["bpe"]
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [(r[0], r[3], library.encode(r[1], add_special_tokens=False).ids) for r in rows]
    assert sorted([(a, b, list(ids)) for a, b, n, ids in kept], key=repr) == sorted(expected, key=repr)
