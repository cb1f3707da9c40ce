import random

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm.decontaminate import MATCH, align, contaminated, rarest
from bazaarlens.llm.words import word_hashes


def plain(item, words):
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        words = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        score, first, end = align(np.array(item, np.uint64), np.array(words, np.uint64))
        assert score == plain(item, words)
        assert score == plain(item, words[first:end])  # the reported words hold the alignment


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, id string")


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_copies_and_edits(spark, docs, sent):
    rng = random.Random(5)
    words = [f"v{rng.randrange(5000)}" for _ in range(400)]
    item = words[:30]
    edited = list(item)
    for k in (4, 11, 19, 26):
        edited[k] = "changed"
    del edited[15]
    texts = [" ".join(words[50:200]), "start " + " ".join(item).upper() + " end", " ".join(words[100:300] + edited + words[300:]), "", None, " ".join(item[:8]), "q " * 30_000]
    tests = items(spark, [(7, " ".join(item), "x"), (8, None, "x"), (9, "", "x"), (10, "!!", None), (None, "a b c", None)])
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs(texts), tests, sent_grams=sent).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].score == 1.0 and (got[1, 7].first_word, got[1, 7].end_word) == (1, 31)
    assert 0.6 < got[2, 7].score < 0.95 and got[2, 7].first_word == 200


def brute(rows, its):
    """(id, item) of all pairs whose alignment over the whole text reaches half of the best score."""
    w, at = word_hashes(pa.array([t or "" for _, t in rows]))
    v, to = word_hashes(pa.array([t or "" for _, t in its]))
    want = set()
    for i, (doc, _) in enumerate(rows):
        own = w[at[i] : at[i + 1]]
        for j, (name, _) in enumerate(its):
            item = v[to[j] : to[j + 1]]
            if len(item) and np.isin(item, own).sum() >= 0.5 * len(item) and align(item, own)[0] >= 0.5 * MATCH * len(item):
                want.add((doc, name))
    return want


def test_against_brute_force(spark, sample):
    tests = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated(sample, tests).collect()}
    want = brute([(r.doc_id, r.text) for r in sample.collect()], [(r.item_id, r.text) for r in tests.collect()])
    assert got == want and want


def test_many_items_in_one_document_and_shuffled_joins(spark, docs, monkeypatch):
    from bazaarlens.llm import common, decontaminate

    monkeypatch.setattr(decontaminate, "ROW_ITEMS", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common.join_salted, "__defaults__", ("n", "inner", 0))
    monkeypatch.setattr(common.join_sized, "__defaults__", (0,))
    rng = random.Random(9)
    words = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    its = [(j, words(20)) for j in range(30)]
    rows = [(0, " ".join(t for _, t in its)), (1, its[3][1]), (2, words(50))] + [(3 + k, words(5) + " " + its[7][1]) for k in range(9)]
    for sent in (0, 10**6):
        got = {(r.doc_id, r.item_id) for r in contaminated(docs([t for _, t in rows]), items(spark, [(j, t, "x") for j, t in its]), sent_grams=sent).collect()}
        assert got == brute(rows, its) and len(got) == 40


def test_partial_copies_beside_full_ones(spark, docs):
    """Any half or more of an item, its end beside a full copy among them, is found as brute force finds it."""
    rng = random.Random(8)
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    its = [words(n) for n in (100, 100, 59, 40, 200)]
    texts = []
    for item in its:
        m = len(item)
        for part in (item, item[m * 2 // 5 :], item[m // 2 :], item[: m // 2], item[m // 4 : m * 3 // 4 + 1], item[m * 3 // 5 :]):
            texts.append(" ".join(words(20) + part + words(20)))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs(texts), items(spark, [(j, " ".join(x), "x") for j, x in enumerate(its)])).collect()}
    want = set()
    w, at = word_hashes(pa.array(texts))
    v, to = word_hashes(pa.array([" ".join(x) for x in its]))
    for i in range(len(texts)):
        for j in range(len(its)):
            item, own = v[to[j] : to[j + 1]], w[at[i] : at[i + 1]]
            if align(item, own)[0] >= 0.5 * MATCH * len(item):
                want.add((i, j))
    assert {(6 * j + k, j) for j in range(len(its)) for k in (0, 1)} <= want
    assert got == want


def test_no_rows_and_repeats(spark, docs):
    tests = items(spark, [(1, " ".join(f"k{i}" for i in range(20)), "x")])
    assert contaminated(docs([]), tests).count() == 0
    assert contaminated(docs(["a"]), items(spark, [])).count() == 0
    text = tests.first().text
    assert [tuple(r)[:2] for r in contaminated(docs([text, text, "a", text], [1, 1, 1, None]), tests).collect()] == [(1, 1)]


def test_rarest_of_each_stretch(spark):
    held = [5, 1, 9, 9, None, 2, 7, 7, 7, 3]
    rows = [(1, 100 + k, k, h) for k, h in enumerate(held) if h] + [(2, 7, 0, 4)]
    got = {(r.item_id, r.item_at) for r in rarest(spark.createDataFrame(rows, "item_id long, gram long, item_at int, held long"), 3).collect()}
    want = {(2, 0)}
    for k in range(len(held)):
        run = [(h, 100 + j, j) for j, h in enumerate(held) if h and k <= j < k + 3]
        if held[k]:
            want.add((1, min(run)[2]))
    assert got == want
    # each run of three places that the corpus holds has a seed
    assert all(any((1, j) in got for j in range(k, k + 3)) for k in range(len(held) - 2) if all(held[k : k + 3]))


@pytest.mark.parametrize("sent", [10**6, 0])
def test_recall_of_edited_copies_made_of_common_phrases(spark, docs, sent):
    """Copies with every fourth to eighth word exchanged, in a corpus that repeats the items' phrases: at least 0.95 of what all n-grams find, and all with runs of five words."""
    rng = random.Random(12)
    phrases = [" ".join(f"w{rng.randrange(300)}" for _ in range(4)) for _ in range(60)]
    its = [" ".join(rng.sample(phrases, 8)) for _ in range(25)]
    texts, apart = [" ".join(rng.choices(phrases, k=40)) for _ in range(150)], []
    for item in its:
        for every in (4, 5, 6, 7, 8):
            words = item.split()
            for k in range(rng.randrange(every), len(words), every):
                words[k] = f"new{rng.randrange(10**6)}"
            texts.append(f"begin {' '.join(words)} end")
            apart.append(every)
    tests = items(spark, [(j, x, "x") for j, x in enumerate(its)])
    rows = docs(texts)
    every_gram = {(r.doc_id, r.item_id) for r in contaminated(rows, tests, stretch=1).collect()}
    got = {(r.doc_id, r.item_id) for r in contaminated(rows, tests, sent_grams=sent).collect()}
    planted = {(150 + 5 * j + k, j): apart[5 * j + k] for j in range(len(its)) for k in range(5)}
    assert got <= every_gram and len(got & planted.keys()) >= 0.95 * len(every_gram & planted.keys())
    assert {p for p, every in planted.items() if every >= 6} <= got
