import os
import random

import numpy as np
import pytest

from shuffleworks.llm import ngram_join as nj
from shuffleworks.llm.common import Scratch
from shuffleworks.llm.components import components
from shuffleworks.session import SHUFFLE_CONF, shared_dir, shuffles_removed


def sets_of(rows, width):
    out = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        if not words:
            out.append(set())
        elif len(words) < width:
            out.append({tuple(words)})
        else:
            out.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    return out


def brute(rows, width, num, den=100):
    """(doc_id, n_shingles, component_id, n_links) per row, sorted."""
    sets = sets_of(rows, width)
    links = {i: set() for i in range(len(rows))}
    for i in links:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None), len(links[i])))
    return sorted(out, key=repr)


def mutated(seed, n):
    """Chains and stars of copies with more and more words changed, among texts that share passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz")
    passage = [word() for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.randint(3, 90))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) + 1, " ".join(text)))
            if rng.random() < 0.3:
                base = text
    return rows


def result(spark, rows, width, num):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in nj.near_duplicates(docs, width, num).collect()], key=repr)


@pytest.mark.parametrize("width, num", [(4, 85), (5, 80)])
def test_odd_documents(odd, odd_rows, width, num):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in nj.near_duplicates(odd, width, num).collect()]
    assert sorted(got, key=repr) == brute(odd_rows, width, num)


@pytest.mark.parametrize("limits", [{}, {"LIST": 2, "BLOCK": 3, "COMMON": 2, "STAR": 4, "FLUSH": 500}, {"LIST": 1, "BLOCK_SHINGLES": 40, "HEAVY": 5, "COMMON": 3, "STAR": 3}])
def test_limits_change_the_work_and_not_the_result(spark, monkeypatch, limits):
    rows = mutated(3, 250)
    for name, value in limits.items():
        monkeypatch.setattr(nj, name, value)
    assert result(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_one_document_of_each_group_stays(odd, odd_rows):
    kept = nj.drop_near_copies(odd)
    assert kept.columns == odd.columns
    expected = brute(odd_rows, 5, 80)
    alone = sum(1 for r in expected if r[1] == 0)
    assert kept.count() == alone + len({r[2] for r in expected if r[1]})


def test_overlaps_in_portions():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 5000, 900).astype(np.uint64)) for _ in range(20)]
    assert (nj.overlaps(sets) - np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets]) * (1 - np.eye(20)))[~np.eye(20, dtype=bool)].sum() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_empty_table(no_docs):
    assert nj.near_duplicates(no_docs, 5, 80).count() == 0
    assert nj.drop_near_copies(no_docs).count() == 0


@pytest.mark.parametrize("limits", [{"STAR": 8, "COMMON": 2}, {"STAR": 10**6, "COMMON": 2, "LIST": 4}])
def test_a_template_alone_ties_no_texts(spark, monkeypatch, limits):
    """81 of 97 shingles are the template's, two of them in each prefix, where a match by them alone needs four."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    template = [word() for _ in range(84)]
    rows = [(k, " ".join(template + [word() for _ in range(16)])) for k in range(100)]
    rows += [(100 + k, f"{rows[k][1][:-7]} {word()}") for k in range(10)]
    clusters = []

    def kept(edges):
        clusters.append(found := components(edges))
        return found

    for name, value in limits.items():
        monkeypatch.setattr(nj, name, value)
    monkeypatch.setattr(nj, "components", kept)
    assert result(spark, rows, 4, 85) == brute(rows, 4, 85)
    largest = clusters[0].groupBy("component").count().agg({"count": "max"}).first()[0]
    assert largest == 2


def test_rounds_of_verification_leave_no_link_out(spark, monkeypatch):
    rows = mutated(5, 150)
    for name, value in {"BLOCK": 3, "STAR": 4, "COMMON": 2, "ROUND": 1}.items():
        monkeypatch.setattr(nj, name, value)
    cut, rounds = Scratch.cut, []

    def counted(self, name, *parts):
        if name == "links":
            parts = [list(parts[0])]
            rounds.append(len(parts[0]))
        return cut(self, name, *parts)

    monkeypatch.setattr(Scratch, "cut", counted)
    assert result(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert rounds[0] > 1


def test_tables_between_steps_are_gone_when_the_result_is_there(spark):
    folder = shared_dir(spark).removeprefix("file:") + "/shuffleworks"
    names = ("sets", "classes", "met", "members", "links", "full")

    def there():
        return {p for p in (os.listdir(folder) if os.path.isdir(folder) else []) if p.startswith(tuple(f"{n}-" for n in names))}

    before, rows = there(), mutated(7, 40)
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert there() == before
    got = [sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect()], key=repr) for _ in range(2)]
    assert got[0] == got[1] == brute(rows, 4, 85)


def test_shuffle_files_go_with_their_query(spark):
    before = spark.conf.get(SHUFFLE_CONF, None)
    with shuffles_removed(spark):
        assert spark.conf.get(SHUFFLE_CONF) == "true"
    assert spark.conf.get(SHUFFLE_CONF, None) == before


def test_bitmap_marks_its_numbers(spark, monkeypatch):
    numbers = [0, 1, 63, 64, 65, 127, 128, (5 << 33) + 63, (5 << 33) + 64, None]
    df = spark.createDataFrame([(n,) for n in numbers + [2, 62, 66, 5 << 33]], "x long")
    bits = nj.bitmap(spark.createDataFrame([(n,) for n in numbers], "y long"), nj.F.col("y"))
    for words in (nj.WORDS, 1):
        monkeypatch.setattr(nj, "WORDS", words)
        assert sorted(r.x for r in nj.marked(df, "x", bits).collect()) == sorted(n for n in numbers if n is not None)
