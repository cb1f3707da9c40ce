import hashlib
import re
from collections import defaultdict

import pytest

from bazaarlens.llm.exact_dedup import directory, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[n], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out.append((i, best[2], len(groups[n]), (-len(t or ""), i) == (best[0], best[2]), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = ["a b", "ab", "a  b", "", None, " \n", "abc", "x y", "xy", "é", "a\x1cb", "ab"]


@pytest.mark.parametrize("bits", [64, 1])
def test_groups_and_chains(docs, bits):
    got = exact_dedup(docs(TEXTS), slot_bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(TEXTS)))


def test_repeated_rows_null_ids_and_no_rows(docs):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b  c"), (2, "bc"), (3, "q" * 50_000)]
    got = exact_dedup(docs([t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert exact_dedup(docs([])).count() == 0


def test_against_brute_force(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted(map(tuple, exact_dedup(sample, capacity=10).collect()), key=str) == brute(rows)


def test_directory_splits_until_buckets_fit():
    counts = {0: 5, 1: 5, 2: 1, 3: 1, 7: 9}
    got = directory(counts, capacity=6, max_depth=3)
    assert [p for p, _, _ in got] == sorted(counts)
    held = defaultdict(int)
    for p, b, d in got:
        assert b == (1 << d) | (p >> (3 - d))
        held[b] += counts[p]
    assert sorted(held.values()) == [2, 5, 5, 9]
