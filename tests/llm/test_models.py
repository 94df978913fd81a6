"""Toxicity and masked pseudo-likelihood."""

import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shuffleworks.llm import lm_score, toxicity

RUDE, MISSPELT = ["blorgish", "snargle", "fropwit"], ["blorgishy", "snargler", "fropwits"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(RUDE)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs += [(1000, " ".join([*plain[:30], *MISSPELT])), (1001, ""), (1002, None), (None, "some text"), (0, docs[0][1])]
    labels += [(None, 1, 1), (2000, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_misspellings(labelled):
    docs, labels = labelled
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    fold = got[got.held_out & (got.doc_id < 600)]
    assert len(fold) > 100 and ((fold.doc_id % 4 == 0) == (fold.predicted == 1)).mean() > 0.95
    assert got[got.doc_id == 1000].predicted.all()
    assert not got[got.doc_id.isin([1001, 1002])].predicted.any()


def test_labels_of_the_held_out_fold_are_never_learnt(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, turned))
    assert first == second


def test_clean_rows_keep_their_columns(odd, no_docs, labelled):
    labels = labelled[1]
    assert toxicity.keep_clean(odd, labels).columns == odd.columns
    assert toxicity.score(no_docs, labels).count() == 0
    nothing = toxicity.score(odd, labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.0} and len(nothing) == odd.count()


def plainly(weights, ids):
    """The log-probability of each token given its neighbours, one after the other."""
    out = []
    for i, token in enumerate(ids):
        hidden = weights[1].copy()
        for k, place in enumerate(lm_score.PLACES):
            hidden += weights[0][k][ids[i + place] if 0 <= i + place < len(ids) else lm_score.TOKENS]
        hidden = np.tanh(hidden)
        upper = hidden @ weights[2] + weights[3]
        own = token // lm_score.CLASSES
        lower = hidden @ weights[4][own] + weights[5][own]
        out.append(upper[own] - np.log(np.exp(upper).sum()) + lower[token % lm_score.CLASSES] - np.log(np.exp(lower).sum()))
    return out


def test_scores_equal_a_loop_over_tokens():
    rng = np.random.default_rng(3)
    weights = [w + rng.normal(0, 0.3, w.shape).astype(np.float32) for w in lm_score.start(np.arange(lm_score.TOKENS)[::-1])]
    steep = [w * np.float32(200 if i in (2, 4) else 1) for i, w in enumerate(weights)]  # logits beyond single precision's exponentials
    ids = rng.integers(0, lm_score.TOKENS, 50).tolist()
    line = np.array([lm_score.TOKENS] * 2 + ids + [lm_score.TOKENS] * 2)
    own = np.arange(2, 52)
    for given in (weights, steep):
        got = lm_score.log_probabilities(given, np.stack([line[own + p] for p in lm_score.PLACES]), line[own])
        assert got == pytest.approx(plainly([w.astype(np.float64) for w in given], ids), rel=1e-4, abs=1e-3)


def test_whole_scores_equal_a_loop_over_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 300)
    monkeypatch.setattr(lm_score, "PART", 50)
    rng = random.Random(9)
    common = [f"k{i}" for i in range(lm_score.KNOWN)]
    texts = [" ".join(common)] * 3 + [" ".join(rng.choice(["K1", "k2", "k30", f"r{rng.randrange(400)}"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += ["", None, "\t\n", "r1 " * 700, texts[5]]
    kept = {}

    def fit(blocks, counts, rounds, real=lm_score.fit):
        kept["weights"], kept["counts"] = real(blocks, counts, rounds), counts
        return kept["weights"]

    def vocabulary(rows, real=lm_score.vocabulary):
        kept["words"] = real(rows)
        return kept["words"]

    monkeypatch.setattr(lm_score, "fit", fit)
    monkeypatch.setattr(lm_score, "vocabulary", vocabulary)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm_score.score(docs).collect()
    known, buckets, _, _ = kept["words"]
    split = [(t or "").lower().encode().split() for t in texts]
    n = Counter(w for words in split for w in words)
    bucket = {w: lm_score.word_hash(w) % lm_score.BUCKETS for w in n}
    size = Counter()
    for w, count in n.items():
        size[bucket[w]] += count * (w not in known)
    weights = [w.astype(np.float64) for w in kept["weights"]]
    assert len(rows) == len(texts) and len(n) > lm_score.KNOWN + 100
    for row in rows:
        words = split[row.doc_id]
        if len(words) > 1000:
            continue  # a loop would take long; of all the others every word is compared
        wanted = sum(plainly(weights, [known.get(w, buckets[bucket[w]]) for w in words])) + sum(np.log(n[w] / size[bucket[w]]) for w in words if w not in known)
        assert row.n_tokens == len(words) and row.log_likelihood == pytest.approx(wanted, rel=1e-4, abs=1e-3)
        assert row.mean_log_prob == (pytest.approx(wanted / len(words), rel=1e-4, abs=1e-3) if words else None)


def test_slopes_equal_differences():
    rng = np.random.default_rng(4)
    weights = [(w + rng.normal(0, 0.2, w.shape)).astype(np.float64) for w in lm_score.start(np.ones(lm_score.TOKENS, dtype=np.int64))]
    around, middle = rng.integers(0, lm_score.TOKENS + 1, (len(lm_score.PLACES), 6)), rng.integers(0, lm_score.TOKENS, 6)
    slopes = lm_score.slopes(weights, around, middle)
    loss = lambda: -lm_score.log_probabilities(weights, around, middle).mean()
    for w, slope in zip(weights, slopes):
        at = np.unravel_index(np.abs(slope).argmax(), w.shape)
        before, w[at] = w[at], w[at] + 1e-5
        high = loss()
        w[at] = before - 1e-5
        assert (high - loss()) / 2e-5 == pytest.approx(slope[at], rel=1e-3)
        w[at] = before


def test_training_prefers_order_and_covers_all_rows(spark, odd, no_docs):
    rng = random.Random(2)
    grammar = [["red", "green"], ["fox", "hen"], ["eats", "sees"], ["corn", "grass"], ["today", "now"]]
    texts = [" ".join(rng.choice(g) for _ in range(12) for g in grammar) for _ in range(200)]
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, " ".join(shuffled)])], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lm_score.score(docs, rounds=6).collect()}
    assert got[0] > got[200] + 0.1
    rows = lm_score.score(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.n_tokens, r.log_likelihood, r.mean_log_prob) for r in rows if r.doc_id in (5, 6, 7)} == {(0, 0.0, None)}
    assert lm_score.score(no_docs).count() == 0


@pytest.mark.parametrize("portion", [50, 10**6])
def test_every_place_of_every_text_is_trained_on_once(monkeypatch, portion):
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in [1, 2, 5, 0, 31, 40, 3007, 3, 31, 31]]
    known, buckets = {w.encode(): i for i, w in enumerate("abcdef")}, np.arange(lm_score.KNOWN, lm_score.TOKENS)
    wanted, gap = [], [lm_score.TOKENS] * lm_score.SPAN
    for text in texts:
        line = [*gap, *(known[w] for w in text.encode().split()), *gap]
        wanted += [(line[i], *(line[i + p] for p in lm_score.PLACES)) for i in range(len(gap), len(line) - len(gap))]
    ids = pa.array(range(len(texts)), pa.int64())
    batches = [pa.RecordBatch.from_arrays([ids[at : at + 4], pa.array(texts[at : at + 4])], names=["doc_id", "text"]) for at in range(0, len(texts), 4)]
    lines = list(lm_score._blocks(SimpleNamespace(value=(known, buckets)))(iter(batches)))
    assert len(lines) > 2 and [i for b in lines for i in b.column("ids")[0].as_py()] == ids.to_pylist()
    seen, like = [], lm_score.start(np.ones(lm_score.TOKENS, dtype=np.int64))
    monkeypatch.setattr(lm_score.Descent, "learn", lambda self, around, middle: seen.extend(zip(middle.tolist(), *around.tolist())))
    for turn in range(3):
        list(lm_score._train(SimpleNamespace(value=like), turn, 3, portion)(iter(lines)))
    assert sorted(seen) == sorted(wanted)


def test_words_of_a_bucket_have_probabilities_of_their_own(spark, monkeypatch):
    common = [f"k{i}" for i in range(lm_score.KNOWN)]
    bucket = lambda w: lm_score.word_hash(w.encode()) % lm_score.BUCKETS
    one, other = next((f"r{i}", f"r{j}") for j in range(2000) for i in range(j) if bucket(f"r{i}") == bucket(f"r{j}"))
    monkeypatch.setattr(lm_score, "fit", lambda blocks, counts, rounds, fit=lm_score.fit: fit(blocks, counts, 0))  # the same network for both
    texts = [*[" ".join(common)] * 9, f"{one} {one} {one}", f"{one} {one} {one}", one, other, f"k1 {other}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm_score.score(docs).collect()
    got = {r.doc_id: r.log_likelihood for r in rows}
    assert len(rows) == len(texts) and [r.n_tokens for r in sorted(rows)][9:] == [3, 3, 1, 1, 2]
    assert got[11] - got[12] == pytest.approx(np.log(7 / 2), abs=1e-4)  # of one: 7, of the other: 2
    assert got[9] == pytest.approx(got[10])


@pytest.mark.parametrize("sample", [12, 3000])
def test_class_shares_do_not_depend_on_the_sample(spark, sample):
    docs = spark.createDataFrame([(i, "the same words for all") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int")
    learnt = toxicity.open_labels(labels).agg(F.avg("toxic")).first()[0]
    rows = toxicity.score(docs, labels, sample=sample).collect()
    assert {r.predicted for r in rows} == {0}
    assert rows[0].score == pytest.approx(learnt, abs=0.02)


def test_repeated_rows_are_learnt_from_once(labelled):
    docs, labels = labelled
    again = docs.where("doc_id in (4, 5)").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("copy")
    assert toxicity.train(docs.unionByName(again), labels) == toxicity.train(docs.distinct(), labels)


def test_toxicity_scores_are_the_networks(spark):
    rude = "idiot idiot, idiot! idiot. (idiot) you nice day"
    texts = [rude] * 3 + [f"{'scum ' * (i % 2)}w{i} a fine day w{i + 1}, w{i}." for i in range(60)] + ["", "Idiots! IDIOT?"]
    toxic = np.array([int("idiot" in t.lower() or "scum" in t) for t in texts])
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in zip(ids, toxic)], "doc_id long, quality int, toxic int")
    active, vectors, weights, bias = toxicity.fit(texts, toxic)
    place = {b: i for i, b in enumerate(active)}
    found = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for ident, text in zip(ids, texts):
        words = set(re.findall(r"\w+", text.lower()))
        of_word = [sum(vectors[place[b]] if b in place else 0 for b in toxicity.grams(w)) / len(toxicity.grams(w)) for w in words]
        odds = np.exp(sum(of_word, np.zeros(toxicity.WIDTH)) / (len(words) + toxicity.PAD) @ weights + bias)
        assert found[ident] == pytest.approx(odds[1] / odds.sum(), abs=1e-5)


def test_training_holds_neither_texts_nor_all_products(monkeypatch):
    """Texts are read once, and a product is made of a few cells at a time, with the same sums."""
    rng = np.random.default_rng(2)
    rows, columns = (rng.integers(0, n, 900) for n in (40, 30))
    rows[:200] = 7  # one row beyond the bound
    values, dense, back = rng.random(900), *(rng.random((n, 8)).astype(np.float32) for n in (30, 40))
    whole = toxicity._Sums(rows, columns, values, (40, 30))
    sizes = []
    real = np.add

    class Add:
        @staticmethod
        def reduceat(products, *args, **kwargs):
            sizes.append(len(products))
            return real.reduceat(products, *args, **kwargs)

    expected = whole.dot(dense), whole.dot(back, transposed=True)
    monkeypatch.setattr(toxicity, "CELLS", 50)
    parts = toxicity._Sums(rows, columns, values, (40, 30))
    monkeypatch.setattr(toxicity, "np", SimpleNamespace(**{**vars(np), "add": Add}))
    assert np.array_equal(parts.dot(dense), expected[0]) and np.array_equal(parts.dot(back, transposed=True), expected[1])
    assert len(sizes) > 20 and sorted(sizes)[-2] <= 50
    assert toxicity._Sums(rows[:0], columns[:0], values[:0], (3, 2)).dot(dense[:2]).tolist() == [[0.0] * 8] * 3
    monkeypatch.undo()
    texts, toxic = [f"some plain words {'blorg' * (i % 2)}" for i in range(60)], np.arange(60) % 2
    once = toxicity.fit(iter(texts), toxic, steps=3)
    assert all(np.array_equal(a, b) for a, b in zip(once, toxicity.fit(texts, toxic, steps=3)))
