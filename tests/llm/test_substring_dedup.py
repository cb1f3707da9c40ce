import random

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm.substring_dedup import compact_windows, linked_pairs, longest, near_passages, passages_between, segments, sliding_least
from bazaarlens.llm.words import shingles, word_hashes


def test_windows_hold_every_stretch_once():
    """Each stretch of ``width`` places lies in exactly one window whose c is its least value, the first of equal ones."""
    rng = np.random.default_rng(2)
    for n, width in ((40, 5), (7, 7), (6, 7), (300, 2), (2_000, 46)):
        values = rng.integers(0, 30, n).astype(np.uint64) << np.uint64(20)
        bounds = np.array([0, n // 3, n // 3, n])
        lo, c, hi = compact_windows(values, bounds, width)
        for begin, end in ((0, n // 3), (n // 3, n)):
            for a in range(begin, end - width + 1):
                least = a + int(values[a : a + width].argmin())
                assert [w for x, w, y in zip(lo, c, hi) if x <= a and a + width <= y and a <= w < a + width] == [least]
        text = np.searchsorted(bounds, c, "right")
        assert (text == np.searchsorted(bounds, lo, "right")).all() and (text == np.searchsorted(bounds, hi - 1, "right")).all()
        assert len(set(c.tolist())) == len(c)
        assert sliding_least(values, width).tolist() == [min(values[k : k + width]) for k in range(n - width + 1)]


def test_segments():
    hit = np.array([0] * 10 + [1] * 30 + [0] * 3 + [1] * 20 + [0] * 40 + [1] * 25, bool)
    assert segments(hit, 20, 4) == [(10, 63), (103, 128)]
    # one word exchanged near an end leaves five misses: the stretch of 46 is found whole
    assert segments(np.array([1] * 33 + [0] * 5 + [1] * 8, bool), 46, 8) == [(0, 46)]
    assert segments(np.zeros(60, bool), 46, 8) == segments(np.ones(45, bool), 46, 8) == []


def test_longest_stretches_against_brute_force():
    rng = np.random.default_rng(5)
    for cost in (4, 8, 1):
        rows = [rng.random(rng.integers(0, 40)) < rng.choice([0.1, 0.6, 0.9, 1.0]) for _ in range(60)]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        first, end = longest(np.concatenate(rows), bounds, cost)
        for r, a, b in zip(rows, first, end):
            good = [(j - i, -j) for i in range(len(r)) for j in range(i + 1, len(r) + 1) if r[i] and r[j - 1] and r[i:j].sum() >= cost * (~r[i:j]).sum()]
            assert (b - a == max(good)[0] and r[a] and r[b - 1]) if good else (a, b) == (0, 0)


def planted(rng, cases, size, edits, held=None):
    """Texts of pairs that share a passage of ``size`` words with ``edits`` words exchanged; ``held``: a first text holds so many of its words."""
    word = lambda: f"w{rng.randrange(10**7)}"
    texts = []
    for _ in range(cases):
        shared = [word() for _ in range(size)]
        edited = list(shared)
        for k in rng.sample(range(size), edits):
            edited[k] = word()
        around = lambda p: " ".join([word() for _ in range(rng.randrange(10, 90))] + p + [word() for _ in range(rng.randrange(10, 90))])
        if held:
            start = rng.choice([0, size - held])
            texts.append(around(shared[start : start + held]))
        texts += [around(shared), around(edited)]
    return texts


def test_recall_of_edited_passages(docs):
    """At least 0.9 of the pairs whose passages have a similarity of 0.8 or more are found, also where the least id holds a part only."""
    rng = random.Random(11)
    for size, edits, held in ((60, 1, None), (80, 1, None), (120, 2, None), (200, 4, None), (50, 0, 40), (50, 0, 30), (60, 0, 48), (50, 0, None)):
        step = 3 if held else 2
        got = passages(docs(planted(rng, 150, size, edits, held)))
        pairs = {(k + step - 1, k + step - 2) for k in range(0, 150 * step, step)}
        found = len({(max(p), min(p)) for p in got} & pairs)
        assert found >= (150 if not edits and not held else 135), (size, edits, held, found)
        assert {(max(p), min(p)) for p in got} <= pairs | {(a, b) for a, b in got if held}
        assert all(r.similarity >= 0.8 for r in got.values())


def passages(df):
    return {(r.doc_id, r.other_doc_id): r for r in near_passages(df).collect()}


def test_planted_passages(docs):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, short = words(60), words(30)
    edited = list(shared)
    edited[30] = "edited"
    texts = [words(100) + shared + words(40), words(7) + shared + words(300), words(80) + edited, words(90) + short, short + words(90), words(500), shared]
    got = passages(docs([" ".join(t) for t in texts] + ["", None, "q " * 30_000]))
    assert set(got) == {(1, 0), (2, 0), (6, 0)}
    assert (got[1, 0].first_word, got[1, 0].end_word, got[1, 0].other_first, got[1, 0].other_end) == (7, 67, 100, 160)
    assert 0.8 <= got[2, 0].similarity < 1 and got[6, 0].similarity == 1


def test_against_brute_force(sample):
    """Documents that share 46 runs of five words in a row are exactly those in rows of similarity 1, by connection."""
    rows = sample.collect()
    grams, at = shingles(*word_hashes(pa.array([r.text for r in rows])), 5)
    runs = {}
    for i, r in enumerate(rows):
        own = grams[at[i] : at[i + 1]]
        for k in range(len(own) - 45):
            runs.setdefault(own[k : k + 46].tobytes(), set()).add(r.doc_id)
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(links):
        for x in parent:
            parent[x] = x
        for a, b in links:
            parent[root(a)] = root(b)
        return {frozenset(y for y in parent if root(y) == root(x)) for x in parent}

    want = classes((a, b) for ids in runs.values() for a in ids for b in ids)
    got = classes((r.doc_id, r.other_doc_id) for r in near_passages(sample).collect())
    for c in want:
        assert any(c <= g for g in got)
    assert any(len(c) > 1 for c in want)


def test_hot_signatures_are_dealt_out(docs, monkeypatch):
    from bazaarlens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common.join_salted, "__defaults__", ("n", "inner", 0))
    monkeypatch.setattr(common.join_sized, "__defaults__", (0,))
    shared = " ".join(f"s{i}" for i in range(60))
    got = passages(docs([" ".join(f"d{k}x{i}" for i in range(30)) + " " + shared for k in range(40)]))
    assert set(got) == {(k, 0) for k in range(1, 40)}


def test_no_rows_and_repeats(docs):
    assert near_passages(docs([])).count() == 0
    text = " ".join(f"k{i}" for i in range(80))
    assert set(passages(docs([text, text, text, text], [1, 1, 2, None]))) == {(2, 1)}


def families(rng, templates, each, edits):
    """Pairs of texts that share a passage of 60 words, 36 of them a template that all families of it share; ``edits`` words of the second are exchanged."""
    word = lambda: f"w{rng.randrange(10**7)}"
    texts = []
    for _ in range(templates):
        template = [word() for _ in range(36)]
        for _ in range(each):
            left = rng.randrange(4, 21)
            passage = [word() for _ in range(left)] + template + [word() for _ in range(24 - left)]
            edited = list(passage)
            for k in rng.sample(range(60), edits):
                edited[k] = word()
            for p in (passage, edited):
                texts.append(" ".join([word() for _ in range(rng.randrange(5, 40))] + p + [word() for _ in range(rng.randrange(5, 40))]))
    return texts


@pytest.mark.parametrize("edits,least", [(0, 1.0), (1, 0.9)])
def test_families_around_a_template_are_all_found(docs, edits, least):
    """Pairs, not classes: each family's two texts are linked with each other, however many families there are."""
    texts = families(random.Random(4), 4, 60, edits)
    rows = near_passages(docs(texts)).collect()
    assert all(r.similarity >= 0.8 and r.doc_id // 2 == r.other_doc_id // 2 for r in rows)
    found = {r.doc_id // 2 for r in rows}
    assert len(found) >= least * len(texts) / 2


def test_singletons_of_a_template_end_the_search(docs):
    """Texts that share 36 words only have no passage in common, and nothing to split them by."""
    rng = random.Random(8)
    template = [f"t{k}" for k in range(36)]
    texts = [" ".join([f"a{rng.randrange(10**7)}" for _ in range(30)] + template + [f"b{rng.randrange(10**7)}" for _ in range(30)]) for _ in range(60)]
    assert near_passages(docs(texts)).collect() == []


def chains(rng, cases, length):
    """Passages of 60 words, each with one word exchanged that those before it hold: neighbours have a similarity of 0.84, others have no passage in common."""
    word = lambda: f"w{rng.randrange(10**7)}"
    texts = []
    for _ in range(cases):
        passage = [word() for _ in range(60)]
        for k in range(length):
            if k:
                passage[(20, 40, 30)[k % 3]] = word()
            texts.append(" ".join([word() for _ in range(rng.randrange(5, 40))] + passage + [word() for _ in range(rng.randrange(5, 40))]))
    return texts


@pytest.mark.parametrize("block", [512, 3])
def test_chains_are_linked(docs, block):
    """The first text is like the second only, which is like the third: a link with the first must not hide that."""
    rows = near_passages(docs(chains(random.Random(6), 60, 3)), block=block).collect()
    found = {(r.doc_id, r.other_doc_id) for r in rows}
    near = {(k + 1, k) for k in range(0, 180, 3)} | {(k + 2, k + 1) for k in range(0, 180, 3)}
    assert found <= near | {(k + 2, k) for k in range(0, 180, 3)}
    assert len(found & near) >= 0.9 * len(near), len(found & near)


@pytest.mark.parametrize("seed", [1, 2])
def test_linked_pairs_connect_what_brute_force_connects(seed):
    """All pairs of windows of a group, one by one, give the same components as the pairs that were chosen."""
    rng = np.random.default_rng(seed)
    bodies, left, group = [], [], []
    for g in range(25):
        base = rng.integers(0, 60_000, 91)
        for _ in range(rng.integers(1, 14)):
            own = base.copy()
            for at in rng.integers(0, 90, rng.integers(0, 3)):
                own[at : at + 5] = rng.integers(0, 60_000, len(own[at : at + 5]))
            if rng.random() < 0.2:
                own = np.insert(np.delete(own, slice(20, 24)), 60, rng.integers(0, 60_000, 4))
            lo, hi = rng.integers(0, 30), rng.integers(70, 92)
            bodies.append(own[lo:hi].astype("<u2"))
            left.append(45 - lo)
            group.append(g)
    left, group, doc = np.array(left), np.array(group), np.arange(len(group))
    linked = rng.random(len(group)) < 0.2
    classes = lambda pairs: _classes(len(group), pairs + [(a, b) for a in np.flatnonzero(linked).tolist() for b in np.flatnonzero(linked).tolist() if group[a] == group[b]])
    every = [(i, j) for i in range(len(group)) for j in range(i) if group[i] == group[j]]
    found = {x[0] for x in passages_between([bodies[i] for i, _ in every], [bodies[j] for _, j in every], np.array([left[j] - left[i] for i, j in every]), 46, 0.8)}
    want = [p for k, p in enumerate(every) if k in found]
    got = linked_pairs(bodies, left, doc, group, np.full(len(group), 2), linked, 46, 0.8)
    assert set(got) <= set(want) and len(want) > len(got) > 20
    assert classes(got) == classes(want)


def _classes(n, pairs):
    own = list(range(n))
    for a, b in pairs:
        one, two = own[a], own[b]
        own = [one if x == two else x for x in own]
    return {frozenset(k for k in range(n) if own[k] == x) for x in own}


def one_by_one(owns, nears, width, similarity):
    """Passages of rows where words were put in or left out, each row alone."""
    strict, out = 2 * similarity / (1 - similarity), []
    for k, (own, near) in enumerate(zip(owns, nears, strict=True)):
        for cost in (strict / 2, strict):
            found = []
            for a, b in segments(np.isin(own, near), width, cost):
                for x, y in segments(np.isin(near, own[a:b]), width, cost):
                    one, two = set(own[a:b].tolist()), set(near[x:y].tolist())
                    if (score := len(one & two) / len(one | two)) >= similarity:
                        found.append((k, a, b, x, y, score))
            if found:
                break
        out += found
    return out


@pytest.mark.parametrize("longest_row", [91, 400])
def test_rows_with_words_put_in_are_compared_side_by_side(monkeypatch, longest_row):
    from bazaarlens.llm import substring_dedup

    rng = np.random.default_rng(longest_row)
    owns, nears = [], []
    for k in range(400):
        own = rng.integers(0, 1 << 32, rng.integers(50, longest_row + 1)).astype("<u4")
        near = own
        for _ in range(rng.integers(1, 6)):
            at, gone, put = rng.integers(0, len(near)), rng.integers(0, 30), rng.integers(1, 30)
            near = np.concatenate([near[:at], rng.integers(0, 1 << 32, put).astype("<u4"), near[at + gone :]])[:longest_row]
        if k % 9 == 0:
            near = np.concatenate([near, near[: rng.integers(0, 30)]])
        owns.append(own)
        nears.append(near[:0] if k % 50 == 0 else near)
    calls = []
    monkeypatch.setattr(substring_dedup, "segments", lambda *a: calls.append(a) or segments(*a))
    far = np.full(len(owns), 1000)  # nothing is aligned, so all rows are compared by what they hold anywhere
    got = passages_between(owns, nears, far, 46, 0.8)
    want = one_by_one(owns, nears, 46, 0.8)
    assert sorted(got) == sorted(want) and len(want) > 20
    # windows are too short for two passages side by side: none of their rows is gone through by itself
    assert not calls if longest_row == 91 else len(calls) < len(owns) and len(want) > len({x[0] for x in want})


def test_dense_rows_and_segments_of_many_rows():
    """Side by side, rows give what ``longest`` and ``segments`` give for each of them."""
    from bazaarlens.llm.substring_dedup import _dense, _segments_of

    rng = np.random.default_rng(3)
    for width, cost in ((2, 1), (5, 4), (20, 8), (46, 4), (46, 8)):
        for part in (0.3, 0.6, 0.9, 1.0):
            bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 120, 60))])
            hit = rng.random(bounds[-1]) < part
            first, end = longest(hit, bounds, cost)
            assert _dense(hit, bounds, width, cost).tolist() == (end - first >= width).tolist()
            want = [(k, a, b) for k in range(60) for a, b in segments(hit[bounds[k] : bounds[k + 1]], width, cost)]
            assert list(zip(*(x.tolist() for x in _segments_of(hit, bounds, width, cost)))) == want
    assert all(len(x) == 0 for x in _segments_of(np.zeros(0, bool), np.zeros(1, np.int64), 46, 8))


def test_several_passages_of_aligned_rows_are_found_side_by_side(monkeypatch):
    """Rows with two passages in place are not gone through one by one."""
    from bazaarlens.llm import substring_dedup

    rng = np.random.default_rng(7)
    owns = [rng.integers(0, 1 << 32, 200).astype("<u4") for _ in range(50)]
    nears = [np.concatenate([own[:60], rng.integers(0, 1 << 32, 70).astype("<u4"), own[130:]]) for own in owns]
    monkeypatch.setattr(substring_dedup, "segments", None)
    got = passages_between(owns, nears, np.zeros(50, np.int64), 46, 0.8)
    assert got == [(k, a, b, a, b, 1.0) for k in range(50) for a, b in ((0, 60), (130, 200))]


@pytest.mark.parametrize("sides", [False, True])
def test_large_groups_are_compared_by_products_of_matrices(monkeypatch, sides):
    """Windows around a template have the same pairs by a product of matrices as pair by pair, and those with too little in common are never sorted."""
    from bazaarlens.llm import substring_dedup

    rng = np.random.default_rng(9)
    template, bodies = rng.integers(0, 60_000, 36), []
    for _ in range(60):
        left, right = rng.integers(0, 60_000, 24), rng.integers(0, 60_000, 24)
        for _ in range(2):
            own = np.concatenate([left, template, right])
            own[rng.integers(0, 84)] = rng.integers(0, 60_000)
            bodies.append(own.astype("<u2"))
    n = len(bodies)
    side = rng.permutation(n) % 2 if sides else np.full(n, 2)
    tried, small = [], substring_dedup._pairs_in_small
    monkeypatch.setattr(substring_dedup, "_within", lambda values, some, f=substring_dedup._within: tried.append(len(values)) or f(values, some))
    monkeypatch.setattr(substring_dedup, "_pairs_in_small", None)
    run = lambda: linked_pairs(bodies, np.full(n, 42), np.arange(n), np.zeros(n, np.int64), side, np.zeros(n, bool), 46, 0.8)
    got = run()
    assert sorted(got) == [(k + 1, k) for k in range(0, n, 2) if not sides or side[k] != side[k + 1]]
    assert sum(tried) < 84 * n  # of n^2 / 2 pairs
    monkeypatch.setattr(substring_dedup, "_pairs_in_small", small)
    monkeypatch.setattr(substring_dedup, "LARGE", n + 1)
    assert run() == got
