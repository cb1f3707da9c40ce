import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm import ranked_search as rs

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    nd, nt = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for q, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * nd) // nt
            s = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(seed, n=400):
    """Words by a steep law, long and short texts, many copies of some."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Größe", "ÀB", "x1", "日本"]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    texts = [" ".join(rng.choices(vocab, weight, k=rng.choice([1, 3, 20, 60, 900]))) for _ in range(n)]
    texts += [texts[3]] * 120 + [texts[7].upper()] * 30
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 25])))) for i in range(25)] + [(90, texts[3]), (91, texts[7])]
    return texts, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, docs, seed):
    texts, items = corpus(seed)
    got = rows_of(rs.search(docs(texts).repartition(6), items_of(spark, items)))
    assert got == brute(list(enumerate(texts)), items)


def test_small_blocks_of_items_and_documents_without_signatures(spark, docs, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 4)
    monkeypatch.setattr(rs, "MOST_ENTRIES", 1 << 5)
    texts, items = corpus(5, 150)
    assert rows_of(rs.search(docs(texts), items_of(spark, items))) == brute(list(enumerate(texts)), items)


def test_nulls_repeats_empty_and_long_texts(spark, docs):
    long = "alpha beta " * 60_000 + "gamma"
    texts = [None, "", "...", "alpha", "ALPHA", long, "alpha", "beta beta", "é", "É", "gamma"]
    ids = [1, 2, 3, 9, 4, 5, 4, None, 7, 8, 6]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "beta gamma"), (5, "é"), (6, "absent")]
    assert rows_of(rs.search(docs(texts, ids), items_of(spark, items))) == brute(list(zip(ids, texts)), items)
    assert rs.search(docs(texts).limit(0), items_of(spark, items)).count() == 0
    assert rs.search(docs([None, "-"]), items_of(spark, items)).count() == 0
    assert rs.search(docs(texts), items_of(spark, [])).count() == 0


def test_pieces_of_long_texts_end_between_words(monkeypatch):
    text = "ab cde f " * 50 + "g" * 40 + " é" * 20
    whole = rs.Vocabulary([b"cde", "é".encode(), b"g" * 40]).words(pa.array([text]))
    monkeypatch.setattr(rs, "PIECE", 7)
    cut = rs.Vocabulary([b"cde", "é".encode(), b"g" * 40]).words(pa.array([text]))
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert Counter(whole[1].tolist()) == {0: 50, 1: 20, 2: 1, -1: 100}


def test_bounds_hold_and_exclude(spark, sample):
    """No score is above its bound, and bounds exclude most documents."""
    texts = [r["text"] for r in sample.select("text").collect()]
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    words = [sorted(set(terms(t))) for t in items]
    vocabulary = rs.Vocabulary(sorted({t.encode() for w in words for t in w}))
    number = {t.decode(): i for i, t in enumerate(vocabulary.terms)}
    flat = [np.array([number[t] for t in w]) for w in words]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in flat])[:-1]])
    one = rs.Items(vocabulary.hashes, np.ones(len(number), np.int64), np.concatenate(flat), starts, len(texts), sum(len(terms(t)) for t in texts), np.zeros(len(flat), np.int64), np.full(len(flat), rs._LAST))
    hashes, known, bounds = vocabulary.words(pa.array(texts))
    tight = total = 0
    for i in range(len(texts)):
        own = slice(bounds[i], bounds[i + 1])
        if bounds[i + 1] > bounds[i]:
            values, counts = np.unique(hashes[own], return_counts=True)
            entries = int(sum((counts >= least).sum() for least in rs.LEVELS))
            block = rs._Block(max(4, (entries - 1).bit_length()))
            block.add(pa.array([i]), i, len(known[own]), values, counts)
            most = one.bounds(np.array([len(known[own])]), block.n, block.bits[:, :1].tobytes())[:, 0]
            exact = one.scores(known[own], np.arange(len(flat)))
            assert (most >= exact).all()
            tight, total = tight + int((most <= exact * 1.05 + 1).sum()), total + len(flat)
    assert tight > 0.8 * total


def test_query_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(rs.op13_ranked_search(spark, tables)) == brute(docs, items)
