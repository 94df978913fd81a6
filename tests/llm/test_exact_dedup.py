import hashlib
import re

import pytest

from shuffleworks.llm import exact_dedup as ed


def brute(rows):
    """(doc_id, keep_id, group_size, sha256) per row, sorted, and the number kept per group."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("limits", [{}, {"chunk": 8, "huge": 32}, {"chunk": 8, "huge": 16, "moduli": (7, 11)}])
def test_equals_brute_force_even_if_fingerprints_collide(odd, odd_rows, limits):
    got = ed.exact_duplicates(odd, **limits).collect()
    expected, n_groups = brute(odd_rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == expected
    assert sum(r.kept for r in got) == n_groups


def test_fingerprints_compose():
    hasher = ed.Hasher(16)
    a, b = b"abc" * 11, b"xyz!" * 9
    shifted = hasher.shift(hasher.whole(a), len(b))
    assert hasher.whole(a + b) == tuple((x + y) % m for x, y, m in zip(shifted, hasher.whole(b), ed.MODULI))
    value = 0
    for byte in a + b:
        value = (value * ed.BASES[0] + byte) % ed.MODULI[0]
    assert hasher.whole(a + b)[0] == value


def test_dropping_keeps_one_row_per_group_and_all_columns(odd, odd_rows):
    kept = ed.drop_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == brute(odd_rows)[1]


def test_empty_table(no_docs):
    assert ed.exact_duplicates(no_docs).count() == 0
    assert ed.drop_copies(no_docs).count() == 0
