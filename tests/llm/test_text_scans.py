"""Secrets, licences, BPE."""

import random
import re
import zlib
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from shuffleworks.llm import bpe, licenses, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def scan(text):
    data = text.encode()
    return secret_scan.in_code_points(data, secret_scan._finder()(data))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "API_KEY", "apikey", "passwd", " = ", ":", "'", '"', " ", "é", "ſecret", "abcdef123456", "AKIA", "ABCDEFGH12345678", "deadbeef", "-", "\n"])).map("".join))
def test_base_spans_equal_plain_patterns(text):
    got = sorted((a, secret_scan.KINDS.index(k), k, b) for a, b, k in scan(text) if k in ("assign", "access", "hex"))
    assert [(k, a, b) for a, _, k, b in got] == spans(text)


def test_checksums_decide_on_tokens():
    body = "abcdefghijABCDEFGHIJ0123456789"
    good = f"ghp_{body}{secret_scan.base62(zlib.crc32(body.encode()))}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert [k for *_, k in scan(f"é {good} x")] == ["github"] and scan(f"é {good} x")[0][:2] == (2, 2 + len(good))
    assert scan(bad) == []


def test_secrets_of_odd_documents(odd, odd_rows, no_docs):
    got = secret_scan.find_secrets(odd).collect()
    assert len(got) == len(odd_rows)
    by_text = sorted((str(r[0]), str([s for s in spans(r[1] or "")])) for r in odd_rows)
    assert sorted((str(r.doc_id), str([(s["kind"], s["start"], s["end"]) for s in r.found])) for r in got) == by_text
    assert secret_scan.find_secrets(no_docs).count() == 0


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        own = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences_of_odd_documents(odd, odd_rows, no_docs):
    found = licenses.summary(licenses.find_licenses(odd)).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found)
    assert got == sorted(str((r[0], *places(r[1]))) for r in odd_rows)
    labels = {r.doc_id: (r.labels, r.score) for r in found}
    assert labels[14] == ("cc-by,cc-by-nc,gpl,gpl-3.0,reserved", 1.0) and labels[7] == ("", 0.0)
    assert licenses.find_licenses(no_docs).count() == 0


def accepted(words, idf):
    """All places of all templates: key phrases there, and enough of the weight."""
    found = []
    for t in licenses.templates():
        weights = [idf[w] for w in t["words"]]
        for start in range(len(words)):
            if all(words[start + at : start + at + n] == t["words"][at : at + n] for at, n in t["must"]):
                share = sum(w for w, a, b in zip(weights, words[start:], t["words"]) if a == b) / sum(weights)
                if share >= (1.0 if t["base"] else licenses.SHARE) - 1e-9:
                    found.append((t["label"], t["base"], start, round(share, 9)))
    return sorted(found)


def test_notices_with_a_changed_word_equal_brute_force(spark):
    texts = [words for words, *_ in licenses.NOTICES]
    for words, _, _ in licenses.NOTICES:
        own = words.split()
        texts += [" ".join(["before", *own[:i], "acquiring", *own[i + 1 :], "after"]) for i in range(len(own))]
    texts += ["license mit license the mit license", "obtaining a copy", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licenses.word_idf(docs.select(licenses.text_words(F.col("text")).alias("words")))
    got = {r.doc_id: sorted((x.label, x.base, x.start, round(x.share, 9)) for x in r.found) for r in licenses.find_licenses(docs).collect()}
    assert got == {i: accepted(t.split(), idf) for i, t in enumerate(texts)}
    changed = texts.index("before permission is hereby granted free of charge to any person acquiring a copy after")
    assert [x[0] for x in got[changed]] == ["mit"]


def test_no_python_on_the_license_path(odd, plan):
    assert not re.search("Python|Arrow|Pandas", plan(licenses.summary(licenses.find_licenses(odd))))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own(library):
    return bpe.Bpe(bpe.load())


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("the cat's ΣİßÉ́ \u0085 \x1c<|endoftext|>0٣日本\n"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_library(library, own, text):
    ids = [i for part in text.encode().split() for i in own.encode(part.decode())]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_of_long_words_and_special_tokens(library, own):
    for text in ("ab" * 5000, "<|startoftext|>x<|endoftext|><|endoftext|>", "", " "):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_odd_documents(spark, odd, odd_rows, no_docs, library):
    encoded = bpe.encode(spark, odd)
    got = sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect())
    assert got == sorted((str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    decoded = sorted((str(r.doc_id), r.text) for r in bpe.decode(spark, encoded).collect())
    assert decoded == sorted((i, library.decode(ids, skip_special_tokens=False)) for i, ids in got)
    assert bpe.digests(spark, no_docs).count() == 0 and bpe.encode(spark, no_docs).count() == 0


def test_trees_run_together_merge_as_one_by_one(monkeypatch):
    model = bpe.Bpe(bpe.load(None))
    rng = random.Random(2)
    letters = "abcdefghinorst" * 3 + "éß日😀\x00Z-"
    words = sorted({"".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 17, 40) for _ in range(60)} | {"aaaa", "the", "international" * 9})
    expected = {w: model.fresh(w) for w in words}
    monkeypatch.setattr(bpe, "TOGETHER", 1)
    monkeypatch.setattr(bpe, "CELLS", 64)
    model.learn(words)
    assert {w: model.words[w] for w in words} == expected


def test_ids_go_out_a_few_megabytes_at_a_time(own):
    """Encoded texts must not pile up until a whole Arrow batch is done."""
    texts = [f"alpha beta gamma {i}. " * 4000 for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    sizes, found, ids = [], [], []
    for part in bpe._encode(SimpleNamespace(value=bpe.load()))(iter([batch])):
        sizes.append(len(part.column("ids").values) * 4)
        found += part.column("doc_id").to_pylist()
        ids += part.column("ids").to_pylist()
    assert found == list(range(60)) and all(ids[i] == [x for w in texts[i].split() for x in own.encode(w)] for i in (0, 7, 59))
    assert max(sizes) < 4 << 20 < sum(sizes)
