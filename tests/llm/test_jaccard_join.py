import random
import re

import pytest

from bazaarlens.llm import jaccard_join as jj


def grams(text, n=5):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1))))


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    out = []
    for a in range(len(rows)):
        of = [b for b in range(len(rows)) if root(b) == root(a)]
        ids = [rows[b][0] for b in of if rows[b][0] is not None]
        out.append((rows[a][0], min(ids) if ids else None, len(of), links[a]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r.class_id, r.class_size, r.n_links) for r in df.collect()), key=str)


def test_banding_reaches_the_recall():
    bands, rows = jj.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jj.MAX_HASHES
    with pytest.raises(ValueError):
        jj.banding(max_hashes=2)


def test_against_brute_force(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert got(jj.jaccard_join(sample)) == brute(rows)


def test_shuffled_joins_and_null_ids(docs, monkeypatch):
    from bazaarlens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common.join_salted, "__defaults__", ("n", "inner", 0))
    monkeypatch.setattr(common.join_sized, "__defaults__", (0,))
    rng = random.Random(2)
    base = [[f"{x}{rng.randrange(900)}" for _ in range(80)] for x in "abc"]
    rows = []
    for n in range(40):
        near = list(base[n % 3])
        if n % 4:
            near[rng.randrange(80)] = f"edit{n}"
        rows.append((None if n % 5 == 0 else n % 17, " ".join(near)))
    for block in (512, 4):
        assert got(jj.jaccard_join(docs([t for _, t in rows], [i for i, _ in rows]), block=block)) == brute(rows)


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_in_blocks(docs, block):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [" ".join(base)] * 3
    for _ in range(9):
        near = list(base)
        near[rng.randrange(120)] = "edit%d" % rng.randrange(99)
        texts.append(" ".join(near))
    texts += ["short one", "short one", "", None, "!!", " ".join(f"z{i}" for i in range(40_000))]
    assert got(jj.jaccard_join(docs(texts), block=block)) == brute(list(enumerate(texts)))


def test_repeats_null_ids_and_no_rows(docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, a + " x"), (1, b), (None, b + " y"), (2, a)]
    assert got(jj.jaccard_join(docs([t for _, t in rows], [i for i, _ in rows]))) == brute(rows)
    assert jj.jaccard_join(docs([])).count() == 0


def test_one_rule_at_every_group_size(docs):
    """2,200 near copies of one text: the same links however groups are cut, and nearly all of those there are."""
    rng = random.Random(4)
    base = [f"w{n}" for n in range(100)]
    texts, spots = [], []
    for n in range(2200):
        near = list(base)
        at = sorted(rng.sample(range(4, 96), rng.choice([1, 1, 2])))
        for i in at:
            near[i] = f"edit{n}x{i}"
        texts.append(" ".join(near))
        spots.append(at)
    # a run is kept by both texts unless it holds a place that one of them has changed
    lost = [frozenset(j for i in at for j in range(i - 4, i + 1) if 0 <= j < 96) for at in spots]
    want = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            both = 96 - len(lost[a] | lost[b])
            if both >= 0.8 * (192 - both) - 1e-9:
                want[a] += 1
                want[b] += 1
    found = [got(jj.jaccard_join(docs(texts), block=block)) for block in (4096, 512)]
    assert found[0] == found[1] and sum(want) > 500_000
    links = {r[0]: r[3] for r in found[0]}
    assert all(links[n] <= w for n, w in enumerate(want))
    assert sum(links.values()) >= 0.999 * sum(want)
