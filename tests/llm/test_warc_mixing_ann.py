import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shuffleworks.llm import ann, mixing, warc
from shuffleworks.session import scratch_path


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "é" * 600, "<p>" + "x" * 2000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a", big), (5, "http://b\r\nWARC-Type: x", big), (3, None, big), (2, "u", "small"), (4, "u", "small")]
    rows += [(6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (9, "u", "y" * 1000), (9, "u", "y" * 1000)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, pages):
    got = sorted([(str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark, pages).collect()])
    assert got == sorted(
        [("1", "revisit", 5, 1203), ("5", "response", None, 1203), ("3", "revisit", 5, 1203), ("2", "response", None, 5), ("4", "response", None, 5)]
        + [("6", "response", None, 0), ("7", "response", None, 0), ("8", "response", None, 2040), ("None", "revisit", 8, 2040)]
        + [("9", "response", None, 1000)] * 2
    )
    assert warc.round_trip(spark, pages.where("false")).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_payloads_and_pushed_predicates(spark, pages, compression, plan):
    path = scratch_path(spark, "warc")
    warc.write_warc(pages, path, compression=compression)
    records = warc.read_warc(spark, path)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in records.where("record_type = 'response'").collect():
        assert bytes(r.payload).decode() == (html[r.page_id] or "")
    assert {r.page_id for r in records.where("record_type = 'revisit'").collect()} == {1, 3, None}
    assert [r.page_id for r in records.where("page_id in (2, 77)").collect()] == [2]
    assert records.where("refers_to is not null and payload_bytes > 2000").count() == 1
    assert "Filter (" not in plan(records.where("record_type = 'revisit'"))  # all of it is pushed down
    assert "Filter (" in plan(records.where("payload_bytes > 2000"))
    assert {r.payload for r in warc.read_warc(spark, path, payload=False).collect()} == {None}


@pytest.mark.parametrize("piece, block", [(mixing.PIECE, mixing.BLOCK), (0.05, 7), (0.3, 1)])
def test_mixing_equals_sql_on_odd_documents(odd, odd_rows, monkeypatch, piece, block):
    monkeypatch.setattr(mixing, "PIECE", piece)  # small ones make many blocks
    monkeypatch.setattr(mixing, "BLOCK", block)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in odd_rows])
    expected = con.execute(mixing.sql("documents", columns="d.doc_id, d.text, d.source, c.copy_no, n.n_copies, c.shuffle_key")).fetchall()
    got = mixing.replicate(odd).select("doc_id", "text", "source", "copy_no", "n_copies", "shuffle_key").collect()
    assert Counter(map(tuple, got)) == Counter(expected)
    assert set(odd.columns) < set(mixing.replicate(odd).columns)


def test_mixing_reaches_target_weights(spark, no_docs):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3900, "big").otherwise("rare").alias("source"))
    counts = Counter(r.source for r in mixing.replicate(docs, {"big": 1.0, "rare": 1.0}).collect())
    assert counts["big"] == pytest.approx(2000, abs=4 * math.sqrt(2000)) and counts["rare"] == pytest.approx(2000, abs=4 * math.sqrt(2000))
    assert {r.source for r in mixing.replicate(docs, {"rare": 1.0}).collect()} == {"rare"}
    assert mixing.replicate(no_docs).count() == 0


def test_copies_of_a_document_of_a_large_rate_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 7999, "big").otherwise("rare").alias("source"))
    rows = mixing.replicate(docs, {"big": 1.0, "rare": 1.0}).where("source = 'rare'").collect()
    assert len(rows) == pytest.approx(4000, abs=4 * math.sqrt(4000)) and {r.n_copies for r in rows} == {len(rows)}
    assert sorted(r.copy_no for r in rows) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("weight", [-1.0, math.nan, math.inf])
def test_weights_that_mean_nothing_are_refused(no_docs, weight):
    with pytest.raises(ValueError):
        mixing.replicate(no_docs, {"a": weight})


def test_poisson_counts_have_the_right_variance(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 19000, "a").otherwise("b").alias("source"))
    found = mixing.replicate(docs, {"b": 1.0}).groupBy("doc_id").agg(F.max("n_copies").alias("n")).toPandas()["n"]
    assert found.mean() == pytest.approx(20, rel=0.05) and found.var() == pytest.approx(20, rel=0.2)


def brute(rows, k=5, every=50):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) or len(v) != 4:
            continue
        kept[i] = min(kept.get(i, v), v)
    ids = sorted(kept)
    out = {}
    for q in ids:
        if q % every == 0:
            a = np.array(kept[q])
            near = sorted((-float(a @ np.array(kept[i]) / np.linalg.norm(a) / np.linalg.norm(kept[i])), i) for i in ids if i != q)
            out[q] = near[:k]
    return out


def test_ann_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400, 520)]  # many equal ones
    rows += [(1000, None), (1050, [0.0] * 4), (1100, [1.0, None, 2.0, 3.0]), (1150, [math.nan, 1.0, 1.0, 1.0]), (1200, [math.inf] * 4), (None, [1.0] * 4)]
    rows += [(1250, [1.0, 2.0]), rows[0], (450, [1.0, 2.0, 3.0, 5.0])]
    vectors = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    expected = brute(rows)
    assert set(got) == set(expected)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        hits += len({i for *_, i in found} & {i for _, i in expected[q]})
        for _, score, i in found:
            match = [s for s, j in brute(rows, 10**6)[q] if j == i]
            assert score == pytest.approx(match[0], abs=1e-12)
    assert hits >= 0.9 * 5 * len(expected)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few).collect()] == [(0, 1, 1)]
    assert ann.nearest(few.where("false")).count() == 0


def test_recall_on_the_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table.collect()]
    ids, values = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    got = Counter()
    for r in ann.nearest(table).collect():
        scores = values @ values[np.flatnonzero(ids == r.query_id)[0]]
        scores[ids == r.query_id] = -9
        got["hit"] += r.vec_id in ids[np.lexsort((ids, -scores))[:5]]
        got["all"] += 1
    assert got["hit"] >= 0.9 * got["all"]


@pytest.mark.parametrize("noise", [0.01, 0.001])
def test_recall_among_near_copies(spark, noise):
    """1,500 copies of one vector with little noise beside as many others; recall of each half on its own."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(3000, 64))
    copies = rng.random(3000) < 0.5
    values[copies] = rng.normal(size=64) + noise * rng.normal(size=(copies.sum(), 64))
    vectors = spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(vectors).collect():
        found.setdefault(r.query_id // 10, set()).add(r.vec_id // 10)
    assert sorted(found) == list(range(0, 3000, 5))
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    hits = {True: [], False: []}
    for q, got in found.items():
        far = ((unit - unit[q]) ** 2).sum(axis=1)
        far[q] = 9
        hits[bool(copies[q])].append(len(got & set(np.argsort(far, kind="stable")[:5].tolist())) / 5)
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9, {k: np.mean(v) for k, v in hits.items()}
