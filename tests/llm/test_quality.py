"""The quality classifier: its ratios and descent against plain ones, its scores against the model, held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

from shuffleworks.llm import quality as q


def corpus(n=120):
    rng = np.random.default_rng(5)
    good, bad = [f"w{i}" for i in range(60)], [f"W{i}!!" for i in range(20)]
    texts, label = [], []
    for i in range(n):
        label.append(int(rng.random() < 0.7))
        words = list(rng.choice(good, rng.integers(5, 60)))
        texts.append(" ".join(words if label[-1] else [*words[:3], *rng.choice(bad, 10)]))
    return texts, np.array(label)


def test_features_are_tokens_and_pairs():
    hashes = q.Hashes()
    assert len(q.features("", hashes)) == 0
    one = q.features("Word", hashes)
    assert len(one) == 1 and not set(one) & set(q.features("word", hashes))
    two = q.features("Word !!", hashes)  # two tokens, a pair, no repeats one before
    assert len(two) == 4 and set(one) < set(two)
    assert list(q.features("a b c " * 9, hashes)) == list(q.features("a  b\nc " * 9, hashes))
    assert set(q.features("x x x x", hashes)) != set(q.features("x y x y", hashes))


def test_ratios_equal_plain_counts():
    rows = [np.array([1, 5]), np.array([5, 9]), np.array([9])]
    found = q.log_ratios(rows, np.array([1, 0, 0]), np.array([1.0, 1.0, 2.0]))
    up, down = {1: 2.0, 5: 2.0, 9: 1.0}, {1: 1.0, 5: 2.0, 9: 4.0}
    for k in up:
        assert found[k] == pytest.approx(math.log(up[k] / 5) - math.log(down[k] / 7))
    assert np.count_nonzero(found) <= 3


def test_descent_reaches_the_optimum():
    texts, label = corpus()
    hashes = q.Hashes()
    rows = [q.features(t, hashes) for t in texts]
    ratios = q.log_ratios(rows, label, np.ones(len(label)))
    values = [q.scaled(r, ratios) for r in rows]
    sign, bound = 2.0 * label - 1, np.where(label == 1, 1.0, 2.0)
    weights, bias, dual = q.descend(rows, values, sign, bound, epochs=2000)
    assert ((dual >= 0) & (dual <= bound)).all()
    # The weights are what the dual variables say, and the duality gap is closed.
    again = np.zeros_like(weights)
    for own, v, a, s in zip(rows, values, dual, sign):
        again[own] += a * s * v
    assert np.allclose(again, weights) and bias == pytest.approx((dual * sign).sum())
    norm = (weights @ weights + bias * bias) / 2
    losses = [max(0.0, 1 - s * (weights[own] @ v + bias)) for own, v, s in zip(rows, values, sign)]
    primal, best = norm + (bound * losses).sum(), dual.sum() - norm
    assert primal >= best - 1e-9 and primal - best < 0.02 * primal


def test_classes_weigh_what_they_stand_for():
    texts, label = corpus()
    more = [t for t, c in zip(texts, label) if c == 0]
    doubled = q.fit(texts + more, np.append(label, [0] * len(more)))
    weighed = q.fit(texts, label, (2.0, 1.0))
    hashes = q.Hashes()
    for t in texts[:20]:
        own = q.features(t, hashes)
        assert q.margin(own, *doubled) * q.margin(own, *weighed) > 0


@pytest.fixture(scope="module")
def frames(spark):
    texts, label = corpus(200)
    docs = spark.createDataFrame([*[(i, t, "s", 0.5) for i, t in enumerate(texts)], (900, None, "s", 0.5), (901, "", "s", 0.5), (None, "w1", "s", 0.1)], "doc_id long, text string, quality string, score double")
    rows = [(i, int(c), 0) for i, c in enumerate(label)]
    # Labels of the held-out fold are turned round: nothing may be learnt from them.
    wrong = [(i, 1 - c if zlib.crc32(str(i).encode()) % 3 == 1 else c, t) for i, c, t in rows]
    labels = spark.createDataFrame([*wrong, (None, 1, 0), (3, None, 0), (5000, 0, 0), (5001, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, texts, label


def test_scores_equal_the_models(frames):
    docs, labels, texts, label = frames
    learnt = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    ratios, weights, bias = q.fit([texts[i] for i in learnt], label[learnt])
    hashes = q.Hashes()
    found = {r.doc_id: r for r in q.score(docs, labels).collect()}
    assert len(found) == docs.count()
    for i, text in [*enumerate(texts), (900, ""), (901, ""), (None, "w1")]:
        expected = 1 / (1 + math.exp(-q.SLOPE * q.margin(q.features(text, hashes), ratios, weights, bias)))
        assert found[i].score == pytest.approx(expected, abs=1e-4)
        assert found[i].predicted == (found[i].score >= 0.5)
        assert found[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(found[i].predicted == label[i] for i in range(len(texts)) if found[i].held_out)


def test_bounded_sample_and_one_class(frames):
    docs, labels, *_ = frames
    assert q.train(docs, labels, sample=10) is not None
    only = q.score(docs, labels.where("quality = 1")).collect()
    assert all(0 <= r.score <= 1 for r in only)


def test_without_labels_or_documents(spark, frames):
    docs, labels, *_ = frames
    assert {r.score for r in q.score(docs, labels.limit(0)).collect()} == {0.5}
    assert q.score(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
