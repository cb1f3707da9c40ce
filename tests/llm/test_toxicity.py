import zlib

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm import toxicity as tx


def test_gradients():
    rng = np.random.default_rng(0)
    net = tx.Network(1)
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, tx.WORD_DIM + tx.CHAR_DIM))
    index = rng.integers(0, 6, (3, 9))
    index[1, 5:] = -1
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = net.forward(x, index).astype(np.float64)
        return float((np.log1p(np.exp(logit)) - y * logit).sum())

    logit, saved = net.forward(x, index, keep=True)
    grads, dx = net.backward(x, index, saved, 1 / (1 + np.exp(-logit)) - y)
    for name, grad in [*grads.items(), ("x", dx)]:
        own = x if name == "x" else net.p[name]
        for k in rng.integers(0, own.size, 4):
            at = np.unravel_index(k, own.shape)
            own[at] += 1e-2
            up = loss()
            own[at] -= 2e-2
            down = loss()
            own[at] += 1e-2
            assert (up - down) / 2e-2 == pytest.approx(grad[at], abs=3e-3, rel=0.05), name


def test_forward_pass_against_plain_loops():
    rng = np.random.default_rng(3)
    net = tx.Network(1)
    p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in net.p.items()}
    net.p = p
    x, h = rng.standard_normal((7, tx.WORD_DIM + tx.CHAR_DIM)), tx.HIDDEN
    index = rng.integers(0, 7, (4, 6))
    index[2, 3:] = -1
    sig = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for row in index:
        words = [x[i] for i in row if i >= 0]
        both = []
        for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
            s, states = np.zeros(h), [None] * len(words)
            for t in order:
                g, r = words[t] @ p[f"w{d}"] + p[f"b{d}"], s @ p[f"u{d}"]
                z, q = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                s = s + z * (np.tanh(g[2 * h :] + q * r[2 * h :]) - s)
                states[t] = s
            both.append(states)
        states = [np.concatenate([f, b]) for f, b in zip(*both, strict=True)]
        e = np.exp([np.tanh(s @ p["a"]) @ p["v"] for s in states])
        want.append(sum(w * s for w, s in zip(e / e.sum(), states, strict=True)) @ p["o"] + p["c"][0])
    assert np.allclose(net.forward(x, index), want, atol=1e-4)


def test_all_words_are_in_windows():
    texts = ["", " ".join(f"w{i}" for i in range(100)), "one", " ".join(f"w{i}" for i in range(48))]
    owner, index = tx.Words(pa.array(texts)).windows()
    assert owner.tolist() == [1, 1, 1, 1, 2, 3]
    held = [set(w) for w in index[owner == 1].tolist()]
    place = tx.Words(pa.array(texts[1:2])).place.tolist()
    assert all(any(set(place[k : k + 25]) <= {tx.Words(pa.array(texts[1:2])).windows()[1][n][j] for j in range(48)} for n in range(4)) for k in range(76)) and len(held) == 4
    assert len(set(index[owner == 1].ravel()) - {-1}) == 100


def test_scores_of_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tx.op9_toxicity(spark, at).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count()
    held = [i for i in labels if i in rows and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out for i in held)
    pos, neg = [[rows[i].score for i in held if labels[i] == y] for y in (1, 0)]
    assert np.mean([p > n for p in pos for n in neg]) > 0.93
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(spark, docs):
    net = tx.Network()
    got = tx.toxicity(docs(["", None, "!!", "a b", "w " * 60_000], [1, None, 1, 4, 5]), net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got[:3]}) == 1
    assert tx.toxicity(docs([]), net).count() == 0
    with pytest.raises(ValueError):
        tx.toxicity(docs(["a"]), net, score_col="Lang")
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert 0 <= tx.toxicity(docs(["x"], [1]), tx.train(docs(["x"], [1]), labels)).first().score <= 1
