"""Unigram encoding and decoding of whole texts with the pieces of a sentencepiece file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.words import blocks, tidied

#: The whitespace marker; a text is encoded with one in front of it and one for each blank.
MARK = "▁"
#: How far below the least score a character that no piece covers is scored.
UNKNOWN_PENALTY = 10.0
#: Distinct stretches a task remembers the ids of.
REMEMBERED = 100_000
#: Stretches that are segmented side by side.
TOGETHER = 8_000
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


class Trie:
    """Double-array trie over code points: a child of state s by symbol x is base[s] + x, if check there is s.

    Code points are numbered by first use in the pieces; 0 stands for all others and has no children.
    """

    def __init__(self, pieces: list[str]):
        points = np.unique(np.array([ord(c) for p in pieces for c in p], np.int64))
        self.points, width = points, len(points) + 1
        code = {chr(c): i + 1 for i, c in enumerate(points)}
        root: dict = {}
        for number, p in enumerate(pieces):
            node = root
            for c in p:
                node = node.setdefault(code[c], {})
            node[0] = number
        size = 4 * sum(map(len, pieces)) + 2 * width + 8192
        self.base, self.check, self.piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        free, dense, todo = 1, 1, [(0, root)]
        for state, node in todo:
            self.piece[state] = node.get(0, -1)
            symbols = np.array(sorted(k for k in node if k), np.int64)
            if not len(symbols):
                continue
            while taken[free]:
                free += 1
            lo, at = max(free, dense * (len(symbols) > 1)), 0
            while not at:  # the first base at which all children fall on free places
                bases = lo + np.flatnonzero(~taken[lo : lo + 1024]) - symbols[0]
                bases = bases[bases > 0]
                bases = bases[~taken[bases[:, None] + symbols].any(1)]
                at, lo = (int(bases[0]), lo) if len(bases) else (0, lo + 1024)
            if len(symbols) > 1:  # what lies far below is left to single children
                dense = max(dense, at + int(symbols[0]) - 512)
            self.base[state] = at
            taken[at + symbols] = True
            self.check[at + symbols] = state
            todo += [(at + k, node[k]) for k in symbols.tolist()]
        last = int(np.flatnonzero(taken)[-1]) + width + 1
        self.base, self.check, self.piece = self.base[:last], self.check[:last], self.piece[:last]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, which of them exist)."""
        to = self.base[state] + symbol
        return to, (symbol > 0) & (self.base[state] > 0) & (self.check[to] == state)


class Pieces:
    """Pieces with log scores. ``texts`` has None for control pieces, which no text is encoded to."""

    def __init__(self, texts: list[str | None], scores: list[float], byte_ids: dict[int, int]):
        self.ids = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
        self.trie = Trie([texts[i] for i in self.ids])
        self.scores = np.asarray(scores, np.float64)
        self.unknown = float(self.scores[self.ids].min()) - UNKNOWN_PENALTY
        if len(byte_ids) < 256:
            raise ValueError("byte fallback needs a piece for each byte")
        self.id_of_byte = np.array([byte_ids[b] for b in range(256)])
        spelt = [(t or "").replace(MARK, " ").encode() for t in texts]
        for b, i in byte_ids.items():
            spelt[i] = bytes([b])
        size = np.array([len(x) for x in spelt], np.int64)
        self.spelling = np.cumsum(size) - size, size, np.frombuffer(b"".join(spelt), np.uint8)
        inner = [t for t in (texts[i] for i in self.ids) if MARK in t.lstrip(MARK)]
        if inner:
            raise ValueError("a marker inside a piece would reach over the places where texts are cut")


@lru_cache(2)
def load(path: str) -> Pieces:
    """The pieces of a sentencepiece file, with their own scores if it is a unigram model. The driver loads them; tasks get the arrays.

    For a byte-pair model the scores only rank the pieces; they become log probabilities by Zipf's law, log(1 / rank)
    less the log of the harmonic sum.
    """
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    normal = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n)]
    own = np.array([p.get_score(i) for i in range(n)])
    if np.array_equal(own[normal], -np.arange(sum(normal), dtype=float)):
        rank = 1 - own
        own = -np.log(rank) - np.log((1 / rank[normal]).sum())
    byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
    return Pieces([p.id_to_piece(i) if ok else None for i, ok in enumerate(normal)], own.tolist(), byte_ids)


def viterbi(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each word: all ids in a row, and the words' bounds in them.

    All words are worked on side by side. The trie is walked from every place of every word at once, which gives the
    edges; then the best score of each place follows from the edges that end there, in order of the places. Of equal
    scores the longest last piece wins. A character that no piece covers becomes its UTF-8 bytes.
    """
    trie = pieces.trie
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    total = int(first[-1])
    word = np.repeat(np.arange(len(words)), size)
    left = first[word + 1] - np.arange(total)  # characters from a place to its word's end
    symbol = trie.symbols(points)
    begins, ends, which = [], [], []
    place, state, depth = np.arange(total), np.zeros(total, np.int64), 0
    single = np.zeros(total, bool)
    while len(place):
        state, ok = trie.step(state, symbol[place + depth])
        place, state = place[ok], state[ok]
        depth += 1
        own = trie.piece[state]
        hit = own >= 0
        if depth == 1:
            single[place[hit]] = True
        begins.append(place[hit])
        ends.append(place[hit] + depth)
        which.append(own[hit])
        more = left[place] > depth
        place, state = place[more], state[more]
    lone = np.flatnonzero(~single)
    begin = np.concatenate([*begins, lone])
    end = np.concatenate([*ends, lone + 1])
    number = np.concatenate([pieces.ids[np.concatenate(which)] if which else np.zeros(0, np.int64), np.full(len(lone), -1, np.int64)])
    cost = np.where(number >= 0, pieces.scores[number], pieces.unknown)
    # node of a place: place + word, so that each word has one more node than characters
    w = word[begin]
    a, b = begin + w, end + w
    reach = end - first[w]
    order = np.lexsort((begin, b, reach))  # at one end, the longest piece first
    a, b, number, cost, reach = a[order], b[order], number[order], cost[order], reach[order]
    best, back, via = np.zeros(total + len(words)), np.zeros(total + len(words), np.int64), np.full(total + len(words), -1, np.int64)
    cuts = np.searchsorted(reach, np.arange(1, (int(size.max()) if len(words) else 0) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        to = b[lo:hi]
        score = best[a[lo:hi]] + cost[lo:hi]
        group = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(score, group)
        n = np.diff(np.append(group, len(to)))
        won = np.flatnonzero(score == np.repeat(top, n))
        lead = won[np.concatenate([[True], to[won][1:] != to[won][:-1]])]
        best[to[lead]], back[to[lead]], via[to[lead]] = score[lead], a[lo:hi][lead], number[lo:hi][lead]
    # walk back from all words' ends at once
    nodes = first[1:] + np.arange(len(words))
    start = first[:-1] + np.arange(len(words))
    at, who, steps = nodes.copy(), np.arange(len(words)), []
    live = at > start
    at, who = at[live], who[live]
    while len(at):
        steps.append((who, via[at], back[at]))
        at = back[at]
        live = at > start[who]
        at, who = at[live], who[live]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    who = np.concatenate([s[0] for s in steps])
    got = np.concatenate([s[1] for s in steps])
    where = np.concatenate([s[2] for s in steps])
    order = np.lexsort((where, who))
    who, got, where = who[order], got[order], where[order]
    return _spelt(pieces, points, who, got, where - who), np.searchsorted(_counts(points, got, where - who, who), np.arange(len(words) + 1))


def _width(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _counts(points: np.ndarray, got: np.ndarray, place: np.ndarray, who: np.ndarray) -> np.ndarray:
    """``who`` with characters that no piece covers repeated for each of their bytes."""
    return np.repeat(who, np.where(got < 0, _width(points[place]), 1))


def _spelt(pieces: Pieces, points: np.ndarray, who: np.ndarray, got: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``got`` with characters that no piece covers (-1) as the ids of their UTF-8 bytes."""
    point = points[place]
    n = np.where(got < 0, _width(point), 1)
    row = np.repeat(np.arange(len(got)), n)
    behind = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(row))  # bytes of the character still to come
    point, width = point[row], n[row]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
    part = point >> (6 * behind)
    value = np.where(behind == width - 1, lead | np.where(width == 1, part & 0x7F, part), 0x80 | part & 0x3F)
    return np.where(got[row] >= 0, got[row], pieces.id_of_byte[value & 255])


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct stretches, their numbers for all texts in a row, the texts' bounds): a stretch is markers and what follows them.

    No piece has a marker behind another character, so the best segmentation of a text is that of its stretches.
    """
    plain = pc.invert(pc.match_substring_regex(texts, f"  |^ | $|^$|{MARK}"))
    lists = pc.split_pattern(texts, " ")
    if pc.all(plain).as_py() is False:
        whole = [x if ok else [y[1:] for y in _STRETCH.findall(MARK + t.replace(" ", MARK))] for x, ok, t in zip(lists.to_pylist(), plain.to_pylist(), texts.to_pylist(), strict=True)]
        lists = pa.array(whole, pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])


def encode_texts(pieces: Pieces, known: dict[str, bytes], texts: pa.Array) -> list[bytes]:
    """Ids of whole texts, little-endian 32-bit. ``known`` remembers the ids of stretches, up to a bound, from call to call."""
    distinct, number, bounds = stretches(texts)
    words = distinct.to_pylist()
    new = [w for w in words if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = words
    for first in range(0, len(new), TOGETHER):
        part = new[first : first + TOGETHER]
        ids, at = viterbi(pieces, [MARK + w for w in part])
        flat = ids.astype("<i4").tobytes()
        known.update({w: flat[4 * a : 4 * b] for w, a, b in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True)})
    held = [known[w] for w in words]
    flat = np.frombuffer(b"".join(held), "<i4")
    size = np.array([len(x) >> 2 for x in held], np.int64)
    start = np.cumsum(size) - size
    n = size[number]
    ends = np.cumsum(n)
    out = flat[np.repeat(start[number] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    cut = np.concatenate([[0], ends])[bounds]
    return [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids: markers become blanks, the first blank goes, runs of bytes are read as UTF-8 (else as U+FFFD)."""
    start, size, data = pieces.spelling
    n = size[ids]
    ends = np.cumsum(n)
    raw = data[np.repeat(start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    text = raw.decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _encoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                part = batch.slice(first, len(texts))
                yield pa.record_batch([*part.columns, pa.array(encode_texts(pieces, known, texts), pa.binary())], names=[*part.schema.names, "ids"])

    return tidied(run)


def _decoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in blocks(batch.column("ids")):
                part = batch.slice(first, len(held))
                texts = [None if x is None else decode_ids(pieces, np.frombuffer(x, "<i4")) for x in held.to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return tidied(run)


def _more(df: DataFrame, column: str, kind: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{column} {kind}"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, ids): ids of whole texts as little-endian 32-bit integers, by the best unigram segmentation.

    Null texts are empty and have the ids of one marker; any character has ids, if need be those of its bytes. Null
    and repeated ids are kept row by row. An empty table gives an empty result; other columns are left out.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(_encoded(load(path)), _more(base, "ids", "binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column decoded: the text of its column ids (null for null).

    A text comes back as it was, but for a marker character in it, which comes back as a blank.
    """
    return encoded.mapInArrow(_decoded(load(path)), _more(encoded, "decoded", "string"))


def _both_ways(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                ids = encode_texts(pieces, known, texts)
                decoded = pa.array([decode_ids(pieces, np.frombuffer(x, "<i4")) for x in ids], pa.string())
                same = pc.equal(decoded, pc.replace_substring(texts, MARK, " "))
                yield pa.record_batch({"id": batch.column("id").slice(first, len(texts)), "ids": pa.array(ids, pa.binary()), "decoded": decoded, "same": same})

    return tidied(run)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, decoded, same): ``encode`` and ``decode`` in one pass, which loads the pieces once for both.

    ``same`` tells whether the decoded text equals the text, a marker in it counting as a blank. Null texts are empty;
    null and repeated ids are kept row by row; very long texts are encoded whole. An empty table gives an empty
    result; other columns are left out, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = base.mapInArrow(_both_ways(load(path)), f"id {base.schema['id'].dataType.simpleString()}, ids binary, decoded string, same boolean")
    return rows.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32, decoded_sha256, same (decoded equals the text); nulls and repeats as in ``encode_and_decode``."""
    return encode_and_decode(docs, path).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "same")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
