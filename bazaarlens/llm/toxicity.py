"""Toxicity scores of all overlapping windows by a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.words import blocks, hashes_between, mix, raw, tidied, word_bounds

#: Words in a window, and from one window's first word to the next one's.
WINDOW, STRIDE = 48, 24
#: Most rows of the word table and of the table of character runs; numbers in a row of each; numbers in a hidden state.
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 14, 1 << 14, 8, 8, 8
#: Labelled documents in which a word or character run has to occur to get a row: this many, and this share of them.
MIN_DOCS, MIN_SHARE = 4, 0.004
#: The model is fitted on at most so many labelled documents of each label, those with the least hash of their id.
MAX_DOCS = 1000
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.05, 7
#: A document's score at which it is predicted toxic.
CUT = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _place(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in sorted keys; the number of keys for others."""
    if not len(keys):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, len(keys))


class Words:
    """The distinct words of a block of texts, their character runs, and which word stands at each place."""

    def __init__(self, texts: pa.Array):
        data, at = raw(pc.utf8_lower(pc.fill_null(texts, "")))
        starts, ends, self.bounds = word_bounds(data, at)
        hashes = hashes_between(data, starts, ends)
        self.hashes, first, self.place = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        # character runs of a word: every three bytes, and its first three to six
        rows, owner = [], []
        size = e - s
        three = np.maximum(size - 2, 0)
        own = np.repeat(np.arange(len(s)), three)
        begin = np.repeat(s - (np.cumsum(three) - three), three) + np.arange(int(three.sum()))
        rows.append(hashes_between(data, begin, begin + 3))
        owner.append(own)
        for k in (1, 4, 5, 6):
            some = np.flatnonzero(size >= k)
            rows.append(mix(hashes_between(data, s[some], s[some] + k) + np.uint64(k)))
            owner.append(some)
        owner, rows = np.concatenate(owner), np.concatenate(rows)
        order = np.argsort(owner, kind="stable")
        self.char_hash = rows[order]
        self.char_at = np.searchsorted(owner[order], np.arange(len(s) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text of each window, its words' numbers, -1 behind the end): all windows of all texts with words."""
        count = np.diff(self.bounds)
        n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(count)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = k[:, None] * STRIDE + np.arange(WINDOW)
        inside = at < count[text][:, None]
        return text, np.where(inside, self.place[np.where(inside, at + self.bounds[:-1][text][:, None], 0)] if len(self.place) else -1, -1)


class Network:
    """Word and character embeddings, a gated recurrent unit in each direction, attention pooling, a logistic output."""

    def __init__(self, seed: int = SEED, word_keys: np.ndarray | None = None, char_keys: np.ndarray | None = None):
        self.word_keys, self.char_keys = (np.zeros(0, np.uint64) if k is None else k for k in (word_keys, char_keys))
        rng = np.random.default_rng(seed)
        x, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        self.word, self.char = ((rng.standard_normal((len(k) + 1, n)) * 0.1).astype(np.float32) for k, n in ((self.word_keys, WORD_DIM), (self.char_keys, CHAR_DIM)))
        self.word[-1] = self.char[-1] = 0  # the last row is that of all others
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": small(x, 3 * h), f"u{d}": small(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": small(2 * h, h), "v": small(h), "o": small(2 * h), "c": np.full(1, -1.0, np.float32)}
        self.scale = np.array([1.0, 0.0], np.float32)  # calibration of the logit, fitted on documents

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        return _place(self.word_keys, words.hashes), _place(self.char_keys, words.char_hash)

    def inputs(self, word_row: np.ndarray, char_row: np.ndarray, char_at: np.ndarray) -> np.ndarray:
        """Inputs of distinct words: the word's row beside the sum of its character runs' rows, over the root of their number."""
        if not len(word_row):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.char[char_row], char_at[:-1]) / np.sqrt(np.diff(char_at))[:, None]
        return np.concatenate([self.word[word_row], chars.astype(np.float32)], 1)

    def read(self, words: Words) -> np.ndarray:
        return self.inputs(*self.rows(words), words.char_at)

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows. ``x``: inputs of distinct words; ``index``: (windows, WINDOW) rows of x, -1 behind the end."""
        n, t = index.shape
        h, p = HIDDEN, self.p
        live = (index >= 0).astype(np.float32)
        states, tape = np.zeros((t, n, 2 * h), np.float32), {}
        for k, d in enumerate("fb"):
            gates = np.concatenate([x @ p[f"w{d}"] + p[f"b{d}"], np.zeros((1, 3 * h), np.float32)])  # the last row serves -1
            s, u, saved = np.zeros((n, h), np.float32), p[f"u{d}"], []
            for step in range(t) if d == "f" else range(t - 1, -1, -1):
                g = gates[index[:, step]]
                r = s @ u
                zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, q = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + q * r[:, 2 * h :])
                m = live[:, step : step + 1]
                new = s + m * z * (c - s)
                if keep:
                    saved.append((step, s, r, z, q, c, m))
                s = new
                states[step, :, k * h : k * h + h] = s
            tape[d] = saved
        att = np.tanh(states.reshape(t * n, 2 * h) @ p["a"]).reshape(t, n, h)
        e = att @ p["v"] - 1e4 * (1 - live.T)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (live, states, tape, att, w, pooled)) if keep else logit

    def backward(self, x: np.ndarray, index: np.ndarray, saved, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of ``x``."""
        live, states, tape, att, w, pooled = saved
        n, t = index.shape
        h, p = HIDDEN, self.p
        g = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["o"]
        dstates = w[:, :, None] * dpool
        dw = (states * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tnh,tn->h", att, de)
        datt = (de[:, :, None] * p["v"] * (1 - att**2)).reshape(t * n, h)
        g["a"] = states.reshape(t * n, 2 * h).T @ datt
        dstates = dstates + (datt @ p["a"].T).reshape(t, n, 2 * h)
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dgates = np.zeros((len(x) + 1, 3 * h), np.float32)
            ds, u, du = np.zeros((n, h), np.float32), p[f"u{d}"], np.zeros((h, 3 * h), np.float32)
            for step, s, r, z, q, c, m in reversed(tape[d]):
                ds = ds + dstates[step, :, k * h : k * h + h]
                dc = ds * m * z * (1 - c**2)
                dz = ds * m * (c - s) * z * (1 - z)
                dq = dc * r[:, 2 * h :] * q * (1 - q)
                dr = np.concatenate([dz, dq, dc * q], 1)
                np.add.at(dgates, index[:, step], np.concatenate([dz, dq, dc], 1))
                du += s.T @ dr
                ds = ds * (1 - m * z) + dr @ u.T
            g[f"u{d}"] = du
            g[f"w{d}"], g[f"b{d}"] = x.T @ dgates[:-1], dgates[:-1].sum(0)
            dx += dgates[:-1] @ p[f"w{d}"].T
        return g, dx


def _documents(words: Words, row: np.ndarray, run_row: np.ndarray, sizes: tuple[int, int], use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many of the texts that ``use`` names each word row and each character-run row occurs; text by text, to need little memory."""
    seen = np.zeros(sizes[0], np.int64), np.zeros(sizes[1], np.int64)
    for i in np.flatnonzero(use):
        own = np.unique(words.place[words.bounds[i] : words.bounds[i + 1]])
        size = words.char_at[own + 1] - words.char_at[own]
        at = np.repeat(words.char_at[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        seen[0][np.unique(row[own])] += 1
        seen[1][np.unique(run_row[at])] += 1
    return seen


def _vocabulary(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words and of the character runs that occur in ``least`` documents or more, the most frequent of them."""
    out = []
    runs, number = np.unique(words.char_hash, return_inverse=True)
    every = np.ones(len(words.bounds) - 1, bool)
    counts = _documents(words, np.arange(len(words.hashes)), number, (len(words.hashes), len(runs)), every)
    for keys, seen, most in ((words.hashes, counts[0], WORD_ROWS), (runs, counts[1], CHAR_ROWS)):
        some = np.flatnonzero(seen >= least)
        out.append(np.sort(keys[some[np.argsort(-seen[some], kind="stable")[:most]]]))
    return out[0], out[1]


def _odds(net: Network, words: Words, word_row: np.ndarray, char_row: np.ndarray, labels: np.ndarray, use: np.ndarray) -> np.ndarray:
    """How much each distinct word speaks for the label: the largest log odds of itself and its runs that have rows, less 1, at least 0."""
    both = [_documents(words, word_row, char_row, (len(net.word), len(net.char)), use & (labels == y)) for y in (0, 1)]
    n = [max(1, ((labels == y) & use).sum()) for y in (0, 1)]
    odds = [np.log((b + 0.5) / n[1]) - np.log((a + 0.5) / n[0]) for a, b in zip(*both, strict=True)]
    odds[0][-1] = odds[1][-1] = 0
    run = np.maximum.reduceat(odds[1][char_row], words.char_at[:-1])
    return np.maximum(np.maximum(odds[0][word_row], run) - 1, 0)


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """A network fitted to document labels.

    A toxic document need not be toxic in every window. Documents start with the window whose words speak most for
    the label by their log odds; after half of the epochs, with the window that the network itself scores highest.
    The logit of a document's highest window is then calibrated on a fifth of the documents that was held back.
    """
    rng = np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.string()))
    net = Network(seed, *_vocabulary(words, max(MIN_DOCS, int(MIN_SHARE * len(texts)))))
    word_row, char_row = net.rows(words)
    owner, index = words.windows()
    if not len(owner) or labels.min() == labels.max():
        net.p["c"][0] = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))) if len(labels) else -3.0
        net.p["o"][:] = 0
        return net
    held = np.array([zlib.crc32(b"held:" + t.encode()) % 5 == 0 for t in texts])
    rank = np.where(index >= 0, np.append(_odds(net, words, word_row, char_row, labels, ~held), 0)[index], 0).sum(1)
    memory = {k: np.zeros_like(v) for k, v in net.p.items()} | {"word": np.zeros(len(net.word), np.float32), "char": np.zeros(len(net.char), np.float32)}
    train = np.flatnonzero(~held & (np.diff(words.bounds) > 0))
    weight = np.where(labels == 1, 0.5 / max(1, (labels[train] == 1).sum()), 0.5 / max(1, (labels[train] == 0).sum())) * len(train)
    for epoch in range(epochs):
        if epoch == epochs // 2:
            x = net.inputs(word_row, char_row, words.char_at)
            rank = np.concatenate([net.forward(x, index[k : k + 4096]) for k in range(0, len(index), 4096)])
        order = np.lexsort((-rank, owner))
        top = order[np.concatenate([[True], np.diff(owner[order]) > 0])]
        best = np.zeros(len(texts), np.int64)
        best[owner[top]] = top
        some = rng.permutation(train)
        for k in range(0, len(some), BATCH):
            docs = some[k : k + BATCH]
            chosen = best[docs]
            # clean documents also show a window at random
            other = docs[labels[docs] == 0]
            n = np.bincount(owner, minlength=len(texts))
            begin = np.cumsum(n) - n
            chosen = np.concatenate([chosen, begin[other] + (rng.random(len(other)) * n[other]).astype(np.int64)])
            y, wt = np.concatenate([labels[docs], np.zeros(len(other))]), np.concatenate([weight[docs], weight[other]])
            used, local = np.unique(index[chosen], return_inverse=True)
            local = local.reshape(len(chosen), WINDOW) - (used[0] == -1)
            used = used[used >= 0]
            wr = word_row[used]
            size = words.char_at[used + 1] - words.char_at[used]
            at = np.concatenate([[0], np.cumsum(size)])
            cr = char_row[np.repeat(words.char_at[used] - at[:-1], size) + np.arange(at[-1])]
            x = net.inputs(wr, cr, at)
            drop = (rng.random(len(used)) < 0.3)[:, None] * np.array([1] * WORD_DIM + [0] * CHAR_DIM)  # word inputs go now and then, so that characters count
            x = x * (1 - drop).astype(np.float32)
            logit, saved = net.forward(x, local, keep=True)
            g, dx = net.backward(x, local, saved, ((_sigmoid(logit) - y) * wt / len(y)).astype(np.float32))
            dx = dx * (1 - drop).astype(np.float32)
            for name, grad in g.items():
                memory[name] += grad**2
                net.p[name] -= RATE * grad / np.sqrt(memory[name] + 1e-8)
            for table, name, rows, grad in ((net.word, "word", wr, dx[:, :WORD_DIM]), (net.char, "char", cr, np.repeat(dx[:, WORD_DIM:] / np.sqrt(size)[:, None], size, 0))):
                total = np.zeros_like(table)
                np.add.at(total, rows, grad)
                hit = np.unique(rows)
                memory[name][hit] += (total[hit] ** 2).mean(1)
                table[hit] -= RATE * total[hit] / np.sqrt(memory[name][hit] + 1e-8)[:, None]
                table[-1] = 0
    logits = _highest(net, words)
    use = held & (np.diff(words.bounds) > 0) if (labels[held].sum() >= 5) else np.diff(words.bounds) > 0
    net.scale = _calibrate(logits[use], labels[use])
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope (kept positive) and offset of a logistic fit, with a light pull of the slope to 1."""
    a, b = 1.0, 0.0
    loss = lambda a, b: (np.logaddexp(0, a * logit + b) - y * (a * logit + b)).sum() + ((a - 1) ** 2 + 0.01 * b * b) / 2
    for _ in range(30):
        q = _sigmoid(a * logit + b)
        g = np.array([((q - y) * logit).sum() + (a - 1), (q - y).sum() + 0.01 * b])
        v = q * (1 - q)
        m = np.array([[(v * logit**2).sum() + 1, (v * logit).sum()], [(v * logit).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(m, g)
        size = 1.0
        while size > 1e-6 and loss(max(0.05, a - size * step[0]), b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = max(0.05, a - size * step[0]), b - size * step[1]
    return np.array([a, b], np.float32)


def _highest(net: Network, words: Words) -> np.ndarray:
    """The highest window's logit of each text; that of no words at all where it has none."""
    owner, index = words.windows()
    out = np.full(len(words.bounds) - 1, net.p["c"][0] - 4, np.float32)
    if len(owner):
        x = net.read(words)
        logits = np.concatenate([net.forward(x, index[k : k + 4096]) for k in range(0, len(index), 4096)])
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.maximum.reduceat(logits, first)
    return out


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The score of each text: its highest window's calibrated probability; texts without words score lowest."""
    words = Words(texts)
    return _sigmoid(net.scale[0] * _highest(net, words) + net.scale[1]).astype(np.float64)


def _scored(net: Network, text_col: str, score_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(text_col)):
                part = batch.slice(first, len(texts))
                yield pa.record_batch([*part.columns, pa.array(score_texts(net, texts))], names=[*part.schema.names, score_col])

    return tidied(run)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Network:
    """Fitted on a bounded sample: at most ``max_docs`` labels of each kind, by the hash of their ids, and their documents.

    Documents whose crc32(id as text) mod 4 is 2 are held out. Labels other than 0 and 1 are passed over; of labels
    that repeat an id the larger counts. Of documents that repeat an id the least text is taken, so no more texts than
    labels reach the driver. Null texts are empty. Without labels, or with labels of one kind, all texts score alike.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * max_docs ids: the documents are read once, and only texts of these ids are shuffled
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.toxic, r.doc_id))
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], np.int64))


def toxicity(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col``: the highest probability of toxicity among all overlapping windows of the whole text.

    Windows have 48 words and start every 24; each word is in one at least, and any 25 words in a row are in one
    together. All other columns come back as they were, whatever their names; ``score_col`` must not be one of them.
    Null texts are scored as empty ones; empty texts and texts without words have the lowest score; very long texts
    are scored whole. Rows are scored one by one, whatever their ids; an empty table gives an empty result.
    """
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {score_col} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` double"
    return docs.mapInArrow(_scored(net, text_col, score_col), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
