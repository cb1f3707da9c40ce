"""Ranked lexical search by bit-sliced Bloom signatures: bounds from slices of an index, exact scores for all documents not excluded."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from bazaarlens.llm.common import bytes_of, join_sized, rows_of, small_batches, written
from bazaarlens.llm.words import _IN_WORD, blocks, hashes_between, mix, raw, tidied, word_bounds

#: How often a term has to occur in a document for its first, second ... entry in the signature.
LEVELS = np.array([1, 2, 3, 4, 5, 7, 10, 15, 25, 50])
#: Slices that each entry sets, and slices for each entry of the fullest document of a block.
HASHES, SLICES = 5, 12
#: Documents and bytes of a block of signatures; from so many entries on a document has no signature and is never excluded.
BLOCK_DOCS, BLOCK_SIZE, MOST_ENTRIES = 512, 4 << 20, 1 << 18
#: Bytes of a text that are hashed at once, items that are bounded at once, bytes of all items, and documents that set an item's first threshold.
PIECE, ITEMS, QUERY_BYTES, FIRST = 4 << 20, 256, 64 << 20, 16
_BLOCK = "ids array<long>, sizes array<long>, slices long, bits binary, terms array<int>, dfs array<long>, n_docs long, n_terms long"
_LAST = np.iinfo(np.int64).max
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about ``PIECE`` bytes that end where no word goes on."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):
            free = np.flatnonzero(~_IN_WORD[data[end : end + PIECE]])
            if len(free):
                end += int(free[0])
                break
            end += PIECE
        end = min(end, len(data))
        yield at, end
        at = end


@dataclass
class Vocabulary:
    """The terms of a query set, found in texts by hash and then byte by byte."""

    terms: list[bytes]
    keys: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.data = np.frombuffer(b"".join(self.terms), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in self.terms])]).astype(np.int64)
        self.hashes = hashes_between(self.data, self.at[:-1], self.at[1:])
        self.order = np.argsort(self.hashes)
        self.keys = self.hashes[self.order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two terms of the query set have one hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Of each word: the number of the term it is, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys) or not len(hashes):
            return out
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == hashes)
        term = self.order[place[hit]]
        size = ends[hit] - starts[hit]
        same = size == self.at[term + 1] - self.at[term]
        hit, term, size = hit[same], term[same], size[same]
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            step = np.arange(n)
            for part in np.array_split(own, max(1, len(own) * int(n) // PIECE)):
                equal = (data[starts[hit[part]][:, None] + step] == self.data[self.at[term[part]][:, None] + step]).all(1)
                out[hit[part[equal]]] = term[part[equal]]
        return out

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all terms of a block of texts, the numbers of those that are known, and the texts' bounds in them."""
        data, at = raw(texts)
        data = _LOWER[data]
        hashes, known, counts = [], [], np.zeros(len(at) - 1, np.int64)
        for a, b in _pieces(data) if len(at) == 2 else [(0, len(data))]:
            part = data[a:b]
            starts, ends, bounds = word_bounds(part, np.clip(at - a, 0, b - a))
            h = hashes_between(part, starts, ends)
            hashes.append(h)
            known.append(self.find(part, starts, ends, h))
            counts += np.diff(bounds)
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int64), *known]), np.concatenate([[0], np.cumsum(counts)])


def _slices(hashes: np.ndarray, level: int, n: int) -> np.ndarray:
    """Slices (hashes, ``HASHES``) that terms of these hashes set in a signature of n slices for that level."""
    x = mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (((x & np.uint64(0xFFFFFFFF))[:, None] + np.arange(HASHES, dtype=np.uint64) * (x >> np.uint64(32) | np.uint64(1))[:, None]) % np.uint64(n)).astype(np.int64)


class _Block:
    """Documents with about as many entries, side by side: slice s holds one bit for each document."""

    def __init__(self, power: int) -> None:
        self.n = SLICES << power if power <= MOST_ENTRIES.bit_length() - 1 else 0
        self.most = BLOCK_DOCS if not self.n else max(8, min(BLOCK_DOCS, BLOCK_SIZE // self.n * 8))
        self.bits = np.zeros((self.n, self.most // 8), np.uint8)
        self.rows: list[pa.Array] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, row: pa.Array, id_: int | None, size: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        at = len(self.ids)
        if self.n:
            for level, least in enumerate(LEVELS):
                hashes, counts = hashes[counts >= least], counts[counts >= least]
                if not len(hashes):
                    break
                self.bits[_slices(hashes, level, self.n).ravel(), at >> 3] |= np.uint8(128 >> (at & 7))
        self.rows.append(row)
        self.ids.append(id_)
        self.sizes.append(size)

    def made(self, schema: pa.Schema) -> pa.RecordBatch:
        bits = np.ascontiguousarray(self.bits[:, : -(-len(self.ids) // 8)])
        rows = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), pa.concat_arrays(self.rows))
        columns = {"rows": rows, "ids": [self.ids], "sizes": [self.sizes], "slices": [self.n], "bits": [bits.tobytes()]}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name == "rows" else pa.array(columns.get(f.name, [None]), f.type) for f in schema], schema=schema)


def build(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The index of ``rows`` (row, id, text): blocks of signatures, and for each task how many documents hold each term of ``vocabulary``.

    Nothing is shuffled. A task keeps one open block for each power of two of entries, so that a long document does not
    thin out the signatures of short ones. Documents without terms are not indexed.
    """
    schema = StructType([StructField("rows", ArrayType(rows.schema["row"].dataType)), *StructType.fromDDL(_BLOCK)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        df, n_docs, n_terms = np.zeros(len(vocabulary.terms), np.int64), 0, 0
        for b in batches:
            ids = b["id"].to_pylist()
            for first, texts in blocks(b["text"]):
                hashes, known, bounds = vocabulary.words(texts)
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    own = slice(bounds[i], bounds[i + 1])
                    size = int(bounds[i + 1] - bounds[i])
                    held = np.unique(known[own])
                    df[held[held >= 0]] += 1
                    n_docs, n_terms = n_docs + 1, n_terms + size
                    values, counts = np.unique(hashes[own], return_counts=True)
                    entries = int(sum((counts >= least).sum() for least in LEVELS))
                    power = min(max(4, (entries - 1).bit_length()), MOST_ENTRIES.bit_length())
                    block = open_blocks.setdefault(power, _Block(power))
                    block.add(b["row"].slice(first + i, 1), ids[first + i], size, values, counts)
                    if len(block.ids) == block.most:
                        yield open_blocks.pop(power).made(arrow)
        for block in open_blocks.values():
            yield block.made(arrow)
        if n_docs:
            held = np.flatnonzero(df)
            stats = {"terms": [held.tolist()], "dfs": [df[held].tolist()], "n_docs": [n_docs], "n_terms": [n_terms]}
            yield pa.RecordBatch.from_arrays([pa.array(stats.get(f.name, [None]), f.type) for f in arrow], schema=arrow)

    with small_batches(rows.sparkSession):
        return written(rows.mapInArrow(tidied(run), schema), "signatures")


@dataclass
class Items:
    """Some items of the query set: their terms' hashes and weights, the corpus' sizes, and what a document must reach."""

    hashes: np.ndarray  # of all their terms
    weights: np.ndarray
    flat: np.ndarray  # terms of the first item, of the second ...
    starts: np.ndarray  # where each item's terms begin in flat
    n_docs: int
    n_terms: int
    score: np.ndarray  # of each item: the score to reach, and the id up to which that score is enough
    until: np.ndarray

    def damp(self, sizes: np.ndarray) -> np.ndarray:
        return 100 - 90 + (90 * sizes * self.n_docs) // self.n_terms

    def bounds(self, sizes: np.ndarray, slices: int, bits: bytes) -> np.ndarray:
        """(items, documents): no document of the block scores more."""
        n, wide = len(sizes), -(-len(sizes) // 8)
        level = np.zeros((len(self.hashes), n), np.uint8)
        table = np.frombuffer(bits, np.uint8).reshape(slices, wide) if slices else None
        left, here = np.arange(len(self.hashes)), None
        for j in range(len(LEVELS)):
            if table is None:
                level[:] = len(LEVELS)
                break
            now = np.bitwise_and.reduce(table[_slices(self.hashes[left], j, slices)], 1)
            here = now if here is None else now & here
            some = here.any(1)
            left, here = left[some], here[some]
            if not len(left):
                break
            level[left] += np.unpackbits(here, axis=1)[:, :n]
        most = np.concatenate([LEVELS[1:] - 1, [0]])[:, None] + np.zeros_like(sizes)
        most[-1] = sizes
        most = np.minimum(most, sizes)
        worth = np.concatenate([np.zeros((1, n), np.int64), 1_000_000_000 * most // (1000 * most + 8 * self.damp(sizes))])
        gain = self.weights[:, None] * worth[level, np.arange(n)]
        return np.add.reduceat(gain[self.flat], self.starts, axis=0)

    def scores(self, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of one document for some of the items, from the numbers of its terms (-1: unknown)."""
        tf = np.bincount(known[known >= 0], minlength=len(self.hashes))
        gain = self.weights * (1_000_000_000 * tf // (1000 * tf + 8 * self.damp(np.int64(len(known)))))
        return np.array([gain[self.flat[a:b]].sum() for a, b in zip(self.starts[wanted], np.append(self.starts, len(self.flat))[wanted + 1])], np.int64)

    def reached(self, score: np.ndarray, id_: np.ndarray, item: np.ndarray) -> np.ndarray:
        return (score > 0) & ((score > self.score[item]) | (score == self.score[item]) & (id_ <= self.until[item]))


def _signatures(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int, bytes]]:
    """(rows, ids with null as the last, sizes, slices, bits) of each block."""
    for i in range(len(batch)):
        if batch["slices"][i].is_valid:
            ids = batch["ids"][i].values
            yield batch["rows"][i].values, np.array(ids.fill_null(_LAST), np.int64), np.array(batch["sizes"][i].values, np.int64), batch["slices"][i].as_py(), batch["bits"][i].as_py()


def _promising(index: DataFrame, items: Items) -> DataFrame:
    """Of each item: the documents with the highest bounds in each task, at most ``FIRST``; rows (row, item, bound, id)."""
    schema = StructType([StructField("row", index.schema["rows"].dataType.elementType), *StructType.fromDDL("item int, bound long, id long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(items.starts)
        best, ids, place = np.zeros((count, 0), np.int64), np.zeros((count, 0), np.int64), np.zeros((count, 0), np.int64)
        kept: list[pa.Array] = []
        for batch in batches:
            for rows, own, sizes, slices, bits in _signatures(batch):
                bound = items.bounds(sizes, slices, bits)
                rank = np.empty(len(own), np.int64)
                rank[np.argsort(own, kind="stable")] = np.arange(len(own))
                key = bound * len(own) + (len(own) - 1 - rank)
                top = np.argpartition(-key, min(FIRST, len(own)) - 1, axis=1)[:, :FIRST]
                base = sum(map(len, kept))
                kept.append(rows)
                both = np.concatenate([best, np.take_along_axis(bound, top, 1)], 1), np.concatenate([ids, own[top]], 1), np.concatenate([place, base + top], 1)
                order = np.lexsort((both[1], -both[0]), axis=1)[:, :FIRST]
                best, ids, place = (np.take_along_axis(x, order, 1) for x in both)
                used, place = np.unique(place, return_inverse=True)
                place = place.reshape(best.shape)
                kept = [pa.concat_arrays(kept).take(pa.array(used))]
        if kept:
            item, column = np.nonzero(best > 0)
            where = place[item, column]
            yield pa.RecordBatch.from_arrays([kept[0].take(pa.array(where)), pa.array(item.astype(np.int32)), pa.array(best[item, column]), pa.array(ids[item, column])], schema=arrow)

    found = index.filter("slices is not null").select("rows", "ids", "sizes", "slices", "bits").mapInArrow(tidied(run), schema)
    first = Window.partitionBy("item").orderBy(F.desc("bound"), "id", "row")
    return found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= FIRST).groupBy("row").agg(F.collect_list("item").alias("items"))


def _possible(index: DataFrame, items: Items) -> DataFrame:
    """All documents whose bound reaches what some items ask for: rows (row, items)."""
    schema = StructType([StructField("row", index.schema["rows"].dataType.elementType), *StructType.fromDDL("items array<int>")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, own, sizes, slices, bits in _signatures(batch):
                bound = items.bounds(sizes, slices, bits)
                doc, item = np.nonzero(items.reached(bound, own[None, :], np.arange(len(bound))[:, None]).T)
                if len(doc):
                    used, at = np.unique(doc, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array([*at, len(doc)], pa.int32()), pa.array(item.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(used)), lists], schema=arrow)

    return index.filter("slices is not null").select("rows", "ids", "sizes", "slices", "bits").mapInArrow(tidied(run), schema)


def _rescored(rows: DataFrame, wanted: DataFrame, vocabulary: Vocabulary, items: Items, terms: np.ndarray) -> DataFrame:
    """Exact scores that reach what the items ask for: rows (item, row, id, score)."""
    own = join_sized(rows, written(wanted, "wanted"), "row", "inner")
    schema = StructType([*StructType.fromDDL("item int, score long"), StructField("row", rows.schema["row"].dataType), *StructType.fromDDL("id long")])
    arrow = to_arrow_schema(schema)
    number = np.full(len(vocabulary.terms) + 1, -1, np.int64)
    number[terms] = np.arange(len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, item, score = [], [], []
            order = np.array(b["id"].cast(pa.int64()).fill_null(_LAST), np.int64)
            for first, texts in blocks(b["text"]):
                _, known, bounds = vocabulary.words(texts)
                for i in range(len(texts)):
                    asked = np.array(b["items"][first + i].values, np.int64)
                    got = items.scores(number[known[bounds[i] : bounds[i + 1]]], asked)
                    keep = items.reached(got, order[first + i], asked)
                    place += [first + i] * int(keep.sum())
                    item += asked[keep].tolist()
                    score += got[keep].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), b["row"].take(pa.array(place, pa.int64())), b["id"].cast(pa.int64()).take(pa.array(place, pa.int64()))], schema=arrow)

    with small_batches(rows.sparkSession):
        return written(own.select("row", "id", "text", "items").mapInArrow(tidied(run), schema), "scores")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_id: str = "item_id", stored: bool = False) -> DataFrame:
    """The ``k`` best documents of each query by exact score: (``query_id``, rank, ``id_col``, score).

    Terms, weights and scores are those of the module's contract query (see ``op13_ranked_search``). Three passes:
    the index is built from all documents and counts the queries' terms; the documents with the highest bounds are
    scored and set each query's threshold, the k-th best score so far; all documents whose bound reaches the threshold
    are scored. A bound equal to the threshold is excluded only where the document's id comes after the k-th one's.

    Queries are a stated set whose texts need at most ``QUERY_BYTES``; they are bounded in blocks of ``ITEMS``. Null
    texts have no terms and neither find nor are found. Repeated rows each have a rank; equal scores go by id (null
    last), then row. Repeated queries each have their answer; no documents or queries give no rows. Texts are read
    whole, in pieces where they are long. Extra columns are ignored.
    """
    spark = docs.sparkSession
    asked = written(queries.select(F.col(query_id).alias("q"), F.coalesce("text", F.lit("")).alias("text")), "queries")
    if bytes_of(asked) > QUERY_BYTES:
        raise ValueError(f"the queries' texts need over {QUERY_BYTES} bytes; search for them in parts")
    out_schema = StructType([StructField(query_id, asked.schema["q"].dataType), *StructType.fromDDL("rank int"), StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("score long")])
    held, names = [], []
    for q, text in asked.collect():
        data, at = raw(pa.array([text]))
        data = _LOWER[data]
        starts, ends, _ = word_bounds(data, at)
        own = {data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())}
        if own:
            held.append(own)
            names.append(q)
    vocabulary = Vocabulary(sorted(set().union(*held)))
    rows = rows_of(docs, [F.col(id_col).cast("long").alias("id"), "text"], stored)
    if not held:
        return spark.createDataFrame([], out_schema)
    index = build(rows, vocabulary)
    stats = index.filter("n_docs is not null")
    n_docs, n_terms = stats.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return spark.createDataFrame([], out_schema)
    df = np.zeros(len(vocabulary.terms), np.int64)
    for t, n in stats.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs")).collect():
        df[t] = n
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    answers = None
    for at in range(0, len(held), ITEMS):
        part = held[at : at + ITEMS]
        terms = np.array(sorted({number[t] for own in part for t in own}))
        flat = [np.searchsorted(terms, sorted(number[t] for t in own)) for own in part]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[t]) + 1))) for t in terms], np.int64)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])[:-1]]).astype(np.int64)
        items = Items(vocabulary.hashes[terms], weights, np.concatenate(flat), starts, n_docs, n_terms, np.zeros(len(part), np.int64), np.full(len(part), _LAST))
        first = _rescored(rows, _promising(index, items), vocabulary, items, terms)
        for item, score, id_ in _ranked(first, k).filter(F.col("rank") == k).select("item", "score", "id").collect():
            items.score[item], items.until[item] = score, _LAST if id_ is None else id_
        scores = _rescored(rows, _possible(index, items), vocabulary, items, terms)
        label = spark.createDataFrame([(i, q) for i, q in enumerate(names[at : at + ITEMS])], StructType([*StructType.fromDDL("item int"), StructField(query_id, asked.schema["q"].dataType)]))
        found = _ranked(scores, k).join(F.broadcast(label), "item").select(query_id, F.col("rank").cast("int").alias("rank"), F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "score")
        answers = found if answers is None else answers.union(found)
    return answers


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item: terms lower-cased in ASCII only, weights of 1000 ln((2N+2)/(2df+1)), counts damped by length."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), stored=True)


ORACLE = r"""
WITH told AS (
  SELECT 0 AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents
), lowered AS (
  SELECT kind, id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM told
), found AS (
  SELECT kind, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered
), tf AS MATERIALIZED (
  SELECT kind, id, term, count(*) AS tf FROM found GROUP BY ALL
), sizes AS MATERIALIZED (
  SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE kind = 1 GROUP BY id
), corpus AS (
  SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM sizes
), weights AS MATERIALIZED (
  SELECT term, count(*) AS df, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus WHERE kind = 1 GROUP BY term
), scored AS (
  SELECT q.id AS item_id, d.id AS doc_id, sum(w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (100 - 90 + (90 * n * nd) // nt))))::BIGINT AS score
  FROM tf q JOIN tf d ON q.kind = 0 AND d.kind = 1 AND q.term = d.term JOIN sizes ON sizes.id = d.id JOIN weights ON weights.term = d.term, corpus GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
