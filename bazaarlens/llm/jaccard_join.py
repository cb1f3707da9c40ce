"""N-gram Jaccard self-join by min-hash banding, verified on full n-gram sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import components, join_salted, join_sized, written
from bazaarlens.llm.words import BLOCK_BYTES, blocks, min_hashes, mix, release, shingles, tidied, word_hashes

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 96
#: Texts in a block. Candidate groups up to this size are read in one go, larger ones band by band, in blocks; what is a link is the same.
BLOCK = 512


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with the wanted recall.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands. Of the bandings with at most
    ``max_hashes`` hashes that reach ``recall`` at the threshold, the one with most rows a band is taken, and of those
    the one with fewest bands.
    """
    for rows in range(max_hashes, 0, -1):
        for bands in range(1, max_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding within max_hashes reaches the recall")


def _digest(grams: np.ndarray) -> str | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None


def _signatures(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                values, at = shingles(*word_hashes(texts), n)
                low = min_hashes(values, at, bands * rows).astype(np.uint64).reshape(-1, bands, rows)
                key = np.zeros(low.shape[:2], np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x100000001B3) + low[:, :, r] + np.uint64(1))
                sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch(
                    {
                        "id": batch.column("id").slice(first, len(texts)),
                        "text_hash": batch.column("text_hash").slice(first, len(texts)),
                        "set_key": pa.array([_digest(s) for s in sets], pa.string()),
                        "bands": pa.FixedSizeListArray.from_arrays(pa.array(key.astype(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                    }
                )

    return tidied(run)


def _sets(n: int):
    """The sets of texts whose digest is the one asked for; a text that merely has the same id is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                values, at = shingles(*word_hashes(texts), n)
                sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                made = pa.record_batch({"set_key": batch.column("set_key").slice(first, len(texts)), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})
                yield made.filter(pa.array([_digest(s) == k for s, k in zip(sets, made.column("set_key").to_pylist(), strict=True)], pa.bool_()))

    return tidied(run)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set on the left, how many elements it shares with each set on the right."""
    sizes = [len(s) for s in right]
    values, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for s in left:
        a, b = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        yield np.bincount(owner[at], minlength=len(right))


def _compare(threshold: float):
    """Links within a block or between two blocks: for each text the documents it links to, and a node of its tree.

    Links are counted, not listed: rows out are at most the texts in, and the trees keep all that the links connect.
    Texts carry all their bands. Two are compared if they share one; those met in a band count only in the first band
    that they share, so once, and those met in a whole group (band -1) in any.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, sides = table.column("set_key").to_pylist(), np.asarray(table.column("block"))
        weight = np.asarray(table.column("copies"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        i, j, band = key[1].as_py(), key[2].as_py(), table.column("band")[0].as_py()
        values = np.array(table.column("bands").to_pylist(), np.int64)
        a, b = np.flatnonzero(sides == i), np.flatnonzero(sides == j)
        links, parent = np.zeros(len(keys), np.int64), list(range(len(keys)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        size = np.array([len(s) for s in sets])
        for x, shared in zip(a, _overlaps([sets[x] for x in a], [sets[x] for x in b]) if len(b) else [], strict=False):
            near = b[shared >= threshold * (size[x] + size[b] - shared) - 1e-9]
            near = near[near != x]
            if len(near):
                same = values[near] == values[x]
                near = near[same.any(1) if band < 0 else same.argmax(1) == band]
            links[x] += weight[near].sum()
            if i != j:
                links[near] += weight[x]
            for y in near:
                parent[root(int(y))] = root(int(x))
        head = [keys[root(x)] for x in range(len(keys))]
        if table.nbytes > 8 * BLOCK_BYTES:
            del table, sets
            release()
        return pa.table({"set_key": pa.array(keys, pa.string()), "head": pa.array(head, pa.string()), "links": pa.array(links)})

    return run


def _dealt(groups: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Rows (set_key, part, band, blocks, block): which texts are compared with each other, in which blocks.

    A group of up to ``block`` texts is one part (band -1), so its sets are read once. A larger one, which bands may have
    chained from texts that are not alike, has a part for each band value that two of its texts share.
    """
    sizes = written(groups.groupBy("root").agg(F.count("*").alias("n")).withColumn("size", F.col("n")), "group-sizes")
    placed = written(join_salted(groups, sizes, ["root"], ["node"]).select(F.col("node").alias("set_key"), "root", "size"), "placed")
    whole = placed.filter(F.col("size") <= block).select("set_key", F.col("root").alias("part"), F.lit(-1).alias("band"), F.lit(1).alias("blocks"))
    large = join_sized(texts.select("set_key", "bands"), written(placed.filter(F.col("size") > block).select("set_key"), "large-groups"), "set_key", "left_semi")
    met = written(large.select("set_key", F.posexplode("bands").alias("band", "value")), "large-bands")
    shared = written(met.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "shared-bands")
    split = join_salted(met, shared, ["band", "value"], ["set_key"]).select("set_key", F.concat_ws(":", "band", "value").alias("part"), "band", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    return whole.unionByName(split).withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks").cast("int"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, class_id (smallest id of all rows that links connect), class_size, n_links.

    Two rows are linked when the Jaccard similarity of their sets of n-word runs is at least ``threshold``;
    ``n_links`` counts the other rows that a row is linked to.

    Rows with equal sets become one text first, so copies are never paired with each other. Texts that share a band
    are hung on the band's smallest text, which makes candidate groups without listing pairs. Two texts are linked if
    they share a band and their full sets are similar enough: the same rule whatever else is in their group, so a link
    never hangs on how many other texts there are. A group of up to ``block`` texts is one task; in a larger one texts
    meet in the first band they share, and a band value of more than ``block`` texts is dealt out over pairs of blocks,
    each a task of bounded size. Only counts and spanning trees come back.

    A text of fewer than n words has one run of all of them; very long texts are compared on all their runs. Null
    texts, and texts without words, have no links and are classes of their own, also among each other. A null id is a
    row as any other; its class has the id null only if no row of it has one. Rows that repeat an id count each. Ids
    may be of any type with an order. An empty table gives an empty result; other columns are ignored.
    """
    bands, rows = banding(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    signed = written(base.mapInArrow(_signatures(bands, rows, n), f"id {kind}, text_hash long, set_key string, bands array<bigint>"), "signatures")
    some = signed.filter("set_key is not null")
    texts = written(some.groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("least"), F.first("bands").alias("bands"), F.count("*").alias("copies")).select("set_key", "least.id", "least.text_hash", "bands", "copies"), "texts")
    banded = texts.select("set_key", F.posexplode("bands").alias("band", "value"))
    heads = written(banded.groupBy("band", "value").agg(F.min("set_key").alias("head"), F.count("*").alias("n")).filter("n > 1"), "band-heads")
    hung = join_salted(banded, heads, ["band", "value"], ["set_key"]).filter("set_key <> head").select(F.col("set_key").alias("u"), F.col("head").alias("v"))
    groups = written(components(hung, "candidates"), "candidate-groups")
    dealt = written(_dealt(groups, texts, block).join(texts.select("set_key", "copies", "bands"), "set_key"), "dealt")
    # the sets are made again from the texts of the candidates: from the row with the least id of each
    name = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    wanted = written(join_sized(texts.select("set_key", "text_hash", name), groups.select(F.col("node").alias("set_key")), "set_key", "left_semi"), "wanted")
    again = join_sized(base.select("text", "text_hash", name), wanted, ["name", "text_hash"], "inner")
    sets = written(again.select("set_key", "text").mapInArrow(_sets(n), "set_key string, grams binary"), "sets").groupBy("set_key").agg(F.first("grams").alias("grams"))
    ready = dealt.join(sets, "set_key").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    ready = ready.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_key", "copies", "band", "bands", "grams")
    found = written(ready.groupBy("part", "i", "j").applyInArrow(_compare(threshold), "set_key string, head string, links long"), "links")
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("set_key").alias("u"), F.col("head").alias("v")), "linked")
    named = links.join(linked.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "links", F.coalesce("root", "set_key").alias("root"))
    of = written(texts.select("set_key", "id", "copies").join(named, "set_key", "left").select("set_key", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_key").alias("root")), "named")
    classes = written(of.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n")), "classes")
    of = written(join_salted(of, classes, ["root"], ["set_key"]).select("set_key", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n")), "text-classes")
    out = join_salted(some.select("id", "text_hash", "set_key"), of, ["set_key"], ["id", "text_hash"]).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links")
    alone = signed.filter("set_key is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
