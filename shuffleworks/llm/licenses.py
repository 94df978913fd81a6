"""License scan by a positional index of rare tokens; DataFrame functions only.

Templates are short licence notices. Document frequencies of their words over all
texts give each word's IDF. The index holds, for each template, those words of its
mandatory key phrases that have the highest IDF, with their places: words that an
accepted place has anyway, so that the lookup loses none. A text looks up those of its words that the index
has; a word at place p that stands at place q of a template proposes that the
template begins at p - q. Postings are intersected by that relative place: as many
of a template's index words as it needs must propose the same beginning. Then its
mandatory key phrases must stand at their places, and the score is the share of
the template's IDF that the text has at the right places.

The base phrases are templates of which every word is mandatory, so each of their
places is found, by its rarest word.

Null texts count as empty: no words, no labels, score 0. Every row gives one row;
extra columns are ignored. Words are maximal runs of ASCII letters and digits and
of all characters beyond ASCII, with A to Z in lower case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.llm.common import whole_text

# Fixed values. Base phrases: words, label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Notices: words, label, mandatory key phrases.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", ["apache license"]),
    ("you may not use this file except in compliance with the license", "apache-2.0", ["except in compliance with the license"]),
    ("released under the mit license", "mit", ["mit license"]),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ["hereby granted free of charge"]),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ["source and binary forms"]),
    ("licensed under the gnu general public license version 3", "gpl-3.0", ["gnu general public license version 3"]),
    ("licensed under the gnu general public license version 2", "gpl-2.0", ["gnu general public license version 2"]),
    ("gnu lesser general public license", "lgpl", ["lesser general public license"]),
    ("gnu affero general public license", "agpl", ["affero general public license"]),
    ("mozilla public license version 2 0", "mpl-2.0", ["mozilla public license"]),
    ("licensed under cc by nc 4 0", "cc-by-nc", ["cc by nc"]),
    ("licensed under cc by sa 4 0", "cc-by-sa", ["cc by sa"]),
    ("creative commons attribution 4 0 international license", "cc-by", ["creative commons attribution"]),
]
RARE = 2  # index words of a notice, of its mandatory phrases
SHARE = 0.6  # of a notice's IDF that must be in place
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_words(text: Column) -> Column:
    """The words; only the ends of the split can be empty."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def templates() -> list[dict]:
    """Every template: words, label, base or not, and which of its places are mandatory."""
    out = [{"words": p.split(), "label": label, "base": True, "must": [(0, len(p.split()))]} for p, label in BASE]
    for text, label, phrases in NOTICES:
        words, must = text.split(), []
        for phrase in phrases:
            n = len(phrase.split())
            must.append(next((i, n) for i in range(len(words)) if words[i : i + n] == phrase.split()))
        out.append({"words": words, "label": label, "base": False, "must": must})
    return out


def word_idf(rows: DataFrame) -> dict[str, float]:
    """IDF of the templates' words over all texts: one row per word comes to the driver, of a fixed list."""
    vocabulary = sorted({w for t in templates() for w in t["words"]})
    found = rows.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("word", F.lit(None).cast("string"))
    seen = {r["word"]: r["n"] for r in counts.unionByName(total).collect()}
    return {w: math.log((1 + seen[None]) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}


def _index(idf: dict[str, float]) -> list[dict]:
    """The templates with their index words' places, highest IDF first, and their weights."""
    out = templates()
    for t in out:
        first = {t["words"][i]: i for at, n in reversed(t["must"]) for i in reversed(range(at, at + n))}
        rare = sorted(first, key=lambda w: (-idf[w], w))[: 1 if t["base"] else RARE]
        t["rare"], t["weights"] = [(w, first[w]) for w in rare], [idf[w] for w in t["words"]]
    return out


def _verified(words: Column, start: Column, t: dict) -> Column:
    """The share of the template's IDF in place; null where a key phrase is not."""
    window = F.slice(words, start + 1, len(t["words"]))
    whole = F.lit(True)
    for at, n in t["must"]:
        phrase = F.array(*map(F.lit, t["words"][at : at + n]))
        whole &= F.slice(words, start + at + 1, n) == phrase
    pairs = F.arrays_zip(window.alias("a"), F.array(*map(F.lit, t["words"])).alias("b"), F.array(*map(F.lit, t["weights"])).alias("w"))
    share = F.aggregate(F.filter(pairs, lambda x: x["a"] == x["b"]), F.lit(0.0), lambda s, x: s + x["w"]) / sum(t["weights"])
    return F.when(whole, F.least(share, F.lit(1.0)))


def _places(words: Column, hits: Column, t: dict) -> Column:
    """(start, share) of the template's places."""
    starts = None
    for word, q in t["rare"]:
        proposed = F.transform(F.filter(hits, lambda h: (h["w"] == word) & (h["p"] >= q)), lambda h: h["p"] - q)
        starts = proposed if starts is None else F.array_intersect(starts, proposed)
    found = F.transform(starts, lambda s: F.struct(s.alias("start"), _verified(words, s, t).alias("share")))
    return F.filter(found, lambda x: x["share"] >= (1.0 if t["base"] else SHARE) - 1e-9)


def _labelled(places: Column, label: str, base: bool) -> Column:
    named = F.lit(label).alias("label"), F.lit(base).alias("base")
    return F.transform(places, lambda x: F.struct(*named, x["start"].alias("start"), x["share"].alias("share")))


def find_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, and ``found``, the places (label, base, start, share) of all templates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_words(whole_text()).alias("words"))
    index = _index(word_idf(rows))
    looked_up = sorted({w for t in index for w, _ in t["rare"]})
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("w"), i.alias("p")))), lambda h: h.isNotNull())
    # Most texts have no index word at all, which is cheaper to know than its places.
    any_hit = F.arrays_overlap("words", F.array(*map(F.lit, looked_up)))
    kind = "array<struct<w:string,p:int>>"
    rows = rows.withColumn("hits", F.when(any_hit, hits).otherwise(F.array().cast(kind)))
    labelled = [_labelled(_places(F.col("words"), F.col("hits"), t), t["label"], t["base"]) for t in index]
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")
    found = F.when(F.size("hits") > 0, F.concat(*labelled)).otherwise(none)
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_licenses``."""
    base = F.filter("found", lambda x: x["base"])

    def names(column: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda x: x["label"]))), ",")

    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
