"""Benchmark decontamination: rare n-gram seeds, then word-level Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlens.llm import common
from bazaarlens.llm.common import BROADCAST_BYTES, bytes_of, join_salted, join_sized, written
from bazaarlens.llm.words import blocks, shingles, tidied, word_hashes

#: Words in a seed, and the share of the best possible score that counts as a copy.
SEED_WORDS, MIN_SCORE = 3, 0.5
#: Of so many n-grams of an item that begin one after the other, the one that the corpus holds least often is a seed.
STRETCH = 3
#: Item n-grams up to which they are sent to the tasks with the items' words; more are joined by shuffles.
SENT_GRAMS = 1_000_000
#: Items that one row carries, with their words, beside a document's text; a document with more of them has several rows.
ROW_ITEMS = 200
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (best score, first word, end word) of the item's best local alignment in ``words``.

    One numpy step for each word of the item; the gap along a row is a running maximum. Of equal scores the one that
    ends first wins.
    """
    if not len(item) or not len(words):
        return 0, 0, 0
    m = len(words)
    ramp = np.arange(m + 1) * -GAP
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for w in item:
        step = np.where(words == w, MATCH, MISMATCH)
        diagonal, up = row[:-1] + step, row[1:] + GAP
        new, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
        take = diagonal > 0
        new[1:][take], start[1:][take] = diagonal[take], begin[:-1][take]
        take = up > new[1:]
        new[1:][take], start[1:][take] = up[take], begin[1:][take]
        reach = new + ramp
        top = np.maximum.accumulate(reach)
        origin = np.maximum.accumulate(np.where(reach == top, np.arange(m + 1), 0))
        row = top - ramp
        begin = start[origin]
        begin[row == 0] = np.flatnonzero(row == 0)
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(begin[at]), at)
    return best


def best_place(item: np.ndarray, own: np.ndarray, offsets: list[int], min_score: float) -> tuple[int, int, int]:
    """Best (score, first word, end word) of the item's alignments around seeds; ``offsets``: places of seeds in ``own`` less their places in the item, ascending.

    Near seeds share a window. One that holds too few of the item's words for ``min_score`` is not aligned: each adds
    MATCH at most.
    """
    best, k = (0, 0, 0), 0
    room = len(item) // 2 + 1
    while k < len(offsets):
        lo = offsets[k] - room
        hi = lo
        while k < len(offsets) and offsets[k] - room <= hi:
            hi = offsets[k] + len(item) + room
            k += 1
        lo = max(lo, 0)
        part = own[lo : max(hi, 0)]
        if np.isin(item, part).sum() >= min_score * len(item):
            score, a, b = align(item, part)
            if score > best[0]:
                best = (score, a + lo, b + lo)
    return best


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["id", "item_id", "score", "first_word", "end_word"])


def _grams(n: int):
    """Rows (id, gram, at) of all n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                values, bounds = shingles(*word_hashes(texts), n)
                for part in range(0, len(values), 500_000):
                    own = np.arange(part, min(part + 500_000, len(values)))
                    rows = np.searchsorted(bounds, own, "right") - 1
                    yield pa.record_batch({"id": batch.column("id").take(pa.array(rows + first)), "gram": pa.array(values[own].astype(np.int64)), "at": pa.array((own - bounds[rows]).astype(np.int32))})

    return tidied(run)


def _counted(n: int, only: np.ndarray | None):
    """Rows (gram, held): how often the texts of a block hold an n-gram, of those in ``only`` (ascending) where that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column("text")):
                values = shingles(*word_hashes(texts), n)[0]
                if only is not None:
                    values = values[_among(values, only)]
                gram, held = np.unique(values, return_counts=True)
                yield pa.record_batch({"gram": pa.array(gram.astype(np.int64)), "held": pa.array(held.astype(np.int64))})

    return tidied(run)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the values that ``table`` (ascending) holds. Most others fall out by their leading bits."""
    light = np.zeros(1 << 20, bool)
    light[(table >> np.uint64(44)).astype(np.int64)] = True
    place = np.flatnonzero(light[(values >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(table, values[place])
    return place[table[np.minimum(at, len(table) - 1)] == values[place]] if len(table) else place


def rarest(places: DataFrame, stretch: int) -> DataFrame:
    """Of each ``stretch`` places of an item in a row, the one whose n-gram the corpus holds least often; of equal ones that with the least hash.

    ``places``: item_id, gram, item_at, held. Places that the corpus does not hold are not there, and never chosen.
    """
    run = Window.partitionBy("item_id").orderBy("item_at").rangeBetween(0, stretch - 1)
    return places.select("item_id", F.min(F.struct("held", "gram", "item_at")).over(run).alias("s")).select("item_id", "s.gram", "s.item_at", "s.held").distinct()


def _searched(n: int, min_score: float, items: dict[int, np.ndarray], gram: np.ndarray, item_id: np.ndarray, item_at: np.ndarray):
    """Alignments of texts with the items whose seeds (``gram`` ascending, with item and place) they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                words, at = word_hashes(texts)
                values, bounds = shingles(words, at, n)
                place = _among(values, gram)
                lo, hi = np.searchsorted(gram, values[place], "left"), np.searchsorted(gram, values[place], "right")
                uses = hi - lo
                seed = np.repeat(lo - (np.cumsum(uses) - uses), uses) + np.arange(int(uses.sum()))
                place = np.repeat(place, uses)
                row = np.searchsorted(bounds, place, "right") - 1
                offset = place - bounds[row] - item_at[seed]
                order = np.lexsort((offset, item_id[seed], row))
                row, item, offset = row[order], item_id[seed][order], offset[order]
                cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else row
                out = []
                ids = batch.column("id").slice(first, len(texts)).to_pylist()
                for a, b in zip(cut, np.append(cut[1:], len(row))):
                    k, name = int(row[a]), int(item[a])
                    score, begin, end = best_place(items[name], words[at[k] : at[k + 1]], np.unique(offset[a:b]).tolist(), min_score)
                    out.append((ids[k], name, score / (MATCH * len(items[name])), begin, end))
                if out:
                    yield _rows(out, batch.schema.field("id").type)

    return tidied(run)


def _aligned(min_score: float):
    """Of each text with its seeds (item, item's words, offsets): the best alignment with each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                words, bounds = word_hashes(texts)
                out = []
                seeds = batch.column("seeds").slice(first, len(texts)).to_pylist()
                ids = batch.column("id").slice(first, len(texts)).to_pylist()
                for k, held in enumerate(seeds):
                    for seed in held:
                        item = np.frombuffer(seed["words"], np.uint64)
                        score, begin, end = best_place(item, words[bounds[k] : bounds[k + 1]], sorted(set(seed["offsets"])), min_score)
                        out.append((ids[k], seed["item_id"], score / (MATCH * len(item)), begin, end))
                if out:
                    yield _rows(out, batch.schema.field("id").type)

    return tidied(run)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in blocks(batch.column("text")):
            words, at = word_hashes(texts)
            yield pa.record_batch({"item_id": batch.column("id").slice(first, len(texts)), "words": pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = SEED_WORDS, min_score: float = MIN_SCORE, sent_grams: int = SENT_GRAMS, stretch: int = STRETCH) -> DataFrame:
    """Rows (id, item_id, score, first_word, end_word): passages of documents that are copies of benchmark items, edited or not.

    How often all documents together hold each n-gram of the items is counted first. Of every ``stretch`` n-grams in a
    row that the documents hold at all, the rarest is a seed. So n + stretch - 1 words of an item in a row always have
    a seed, wherever they are in it, and common phrases lead nowhere unless a stretch has nothing else. Each document
    with a seed is aligned with its item around every place that a seed suggests, unless it holds too few of the item's
    words there to reach ``min_score``. ``score`` is the alignment's score over the best possible one; rows reach
    ``min_score``. No document and no item is passed over for being frequent.

    Where items have up to ``sent_grams`` n-grams and words of a measured size, these are sent to the tasks; the
    documents are then read twice and nothing of them but counts is shuffled. More are counted and joined by shuffles,
    with the places of a frequent seed dealt out over tasks.

    Null texts are empty and match nothing; very long texts are searched whole. Items without words are passed over;
    items shorter than n words have one seed of all their words, which finds texts made of just these. Of items that
    repeat an id the one with the least words counts. Null ids do not match (there would be nothing to name). Rows
    that repeat an id are one document whose rows are each aligned; the best alignment is reported, of equal ones the
    first in its text. Empty tables give an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    kind = base.schema["id"].dataType.simpleString()
    tests = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("id is not null")
    words = written(tests.mapInArrow(_item_words, "item_id long, words binary").filter("length(words) > 0").groupBy("item_id").agg(F.min("words").alias("words")), "items")
    named = tests.mapInArrow(_grams(n), "id long, gram long, at int").select(F.col("id").alias("item_id"), "gram", F.col("at").alias("item_at"))
    grams = written(named.join(words.select("item_id"), "item_id", "left_semi").distinct(), "item-grams")
    result = f"id {kind}, item_id long, score double, first_word long, end_word long"

    def best(scored: DataFrame) -> DataFrame:
        top = scored.filter(F.col("score") >= min_score).groupBy("id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("back"), "end_word")).alias("b"))
        return top.select(F.col("id").alias(id_col), "item_id", "b.score", (-F.col("b.back")).alias("first_word"), "b.end_word")

    sent = grams.count() <= sent_grams and bytes_of(words) <= BROADCAST_BYTES
    asked = grams.groupBy("gram").agg(F.count("*").alias("n"))
    only = np.sort(asked.select("gram").toArrow().column("gram").to_numpy().astype(np.uint64)) if sent else None
    corpus = base.select("text").mapInArrow(_counted(n, only), "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held"))
    held = written(asked.join(corpus, "gram"), "gram-counts")
    seeds = written(rarest(join_salted(grams, held, ["gram"], ["item_id"]), stretch), "seeds")
    if sent:
        texts = {r["item_id"]: np.frombuffer(r["words"], np.uint64) for r in words.toArrow().to_pylist()}
        table = seeds.toArrow()
        gram = table.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(gram, kind="stable")
        return best(base.mapInArrow(_searched(n, min_score, texts, gram[order], table.column("item_id").to_numpy()[order], table.column("item_at").to_numpy()[order].astype(np.int64)), result))
    rare = seeds.groupBy("gram").agg(F.first("held").alias("n"), F.count("*").alias("places"))
    limit = max(common.HOT_ROWS, (rare.agg(F.sum("n")).first()[0] or 0) // common.MAX_HOT)
    rare = written(rare.withColumn("parts", F.ceil(F.col("n") / limit).cast("int")), "rare")
    hits = join_salted(base.mapInArrow(_grams(n), f"id {kind}, gram long, at int"), rare.drop("places"), ["gram"], ["id", "at"])
    hits = written(hits.select("id", "gram", "at", F.pmod(F.xxhash64("id", "at"), "parts").cast("int").alias("part")), "hits")
    dealt = join_salted(seeds, rare.select("gram", "parts", F.col("places").alias("n")), ["gram"], ["item_id"])
    dealt = dealt.select("item_id", "gram", "item_at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = hits.join(dealt, ["gram", "part"]).groupBy("id", "item_id").agg(F.collect_set((F.col("at") - F.col("item_at")).cast("long")).alias("offsets"))
    found = written(found, "found")
    uses = written(found.groupBy("item_id").agg(F.count("*").alias("n")).join(words, "item_id"), "item-uses")
    full = join_salted(found, uses, ["item_id"], ["id"])
    # items of a document, in rows of about ROW_ITEMS
    parts = found.groupBy("id").agg(F.ceil(F.count("*") / ROW_ITEMS).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("item_id"), F.coalesce("parts", F.lit(1)))
    told = join_sized(full, written(parts, "many-seeds"), "id", "left").groupBy("id", part.alias("part")).agg(F.collect_list(F.struct("item_id", "words", "offsets")).alias("seeds"))
    told = written(told.drop("part"), "seeded")
    return best(join_sized(base, told, "id", "inner").mapInArrow(_aligned(min_score), result))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
