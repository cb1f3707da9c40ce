"""Exact dedup over an extendible-hash index that lies in shared files. DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import join_salted, shared_dir, written

#: Rows in a bucket before it splits, and the most buckets; larger tables have larger buckets.
CAPACITY, MAX_BUCKETS = 20_000, 16_384
#: A slot with more rows than these is summed before it is shuffled, and weighs only so much in its bucket.
HOT_SLOT = 1_000


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line ends, vertical tabs, form feeds and carriage returns; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Directory for the number of rows under each ``max_depth``-bit prefix: rows (prefix, bucket, local depth).

    It starts as one bucket of depth 0. A bucket of more than ``capacity`` rows splits on its next bit, and the
    directory doubles where that bucket was as deep as the directory. At ``max_depth`` a bucket stays as large as it
    is. A bucket's number is its bits behind a leading 1, so no two buckets of any depth share a number.
    """
    out, todo = [], [(0, 0, sorted(counts.items()))]
    while todo:
        depth, bits, held = todo.pop()
        if depth < max_depth and sum(n for _, n in held) > capacity:
            shift = max_depth - depth - 1
            for bit in (0, 1):
                if part := [x for x in held if x[0] >> shift & 1 == bit]:
                    todo.append((depth + 1, bits << 1 | bit, part))
        else:
            out += [(prefix, 1 << depth | bits, depth) for prefix, _ in held]
    return sorted(out)


def build_index(entries: DataFrame, capacity: int = CAPACITY, max_buckets: int = MAX_BUCKETS, slot_bits: int = 64, hot: int = HOT_SLOT) -> DataFrame:
    """The index of ``entries`` (column slot) in files by bucket: rows (bucket, slot, n), one for each slot.

    Slots are counted map-side first, so that a text that a third of all rows share is one row here. Prefixes are
    three bits longer than ``max_buckets`` buckets of equal size would need, or than there are rows for; the driver
    sees one number for each. Each bucket is a folder and holds one range of slots.
    """
    spark = entries.sparkSession
    slots = written(entries.groupBy("slot").agg(F.count("*").alias("n")), "slots")
    weight = F.least("n", F.lit(hot))
    total = slots.agg(F.sum(weight)).first()[0] or 0
    capacity = max(capacity, total // max_buckets)
    depth = min(slot_bits, (total // capacity).bit_length() + 3)
    prefix = F.shiftrightunsigned("slot", slot_bits - depth).cast("int")
    counts = {r[0]: r[1] for r in slots.groupBy(prefix.alias("p")).agg(F.sum(weight)).collect()}
    table = spark.createDataFrame(directory(counts, capacity, depth), "prefix int, bucket long, depth int")
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    found = slots.join(F.broadcast(table), prefix == table.prefix).select("bucket", "slot", "n")
    found.repartition("bucket").write.partitionBy("bucket").parquet(at)
    return spark.read.schema("slot long, n long, bucket long").parquet(at)


def chains(members: DataFrame, hot: int = HOT_SLOT) -> DataFrame:
    """Rows (bucket, slot, sha, group_size, keep_id, most): the different texts of each slot, compared as bytes.

    ``members`` has bucket, slot, rows (how many the slot has), id, n_chars and norm. A bucket's rows go to the one task
    that owns its range of slots, which chains the different texts of each slot and compares bytes inside. Slots with
    more than ``hot`` rows would make such a task large: their rows are summed by text before they are shuffled.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id")).alias("best")
    link = lambda rows: rows.groupBy("bucket", "slot", "norm").agg(F.count("*").alias("group_size"), best)
    found = link(members.filter(F.col("rows") <= hot).repartition("bucket")).unionByName(link(members.filter(F.col("rows") > hot)))
    return found.select("bucket", "slot", F.sha2("norm", 256).alias("sha"), "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("most"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = 64, capacity: int = CAPACITY, hot: int = HOT_SLOT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. The row with the most code points in the original text stays,
    then the one with the smallest id (of any type with an order).

    Slots are the top ``slot_bits`` bits of a 64-bit hash. A slot with one row is settled by the index alone. The
    others' normalised texts are fetched, sent to the owners of their buckets, and compared there as bytes; different
    texts in one slot form a chain. On the way back, rows of a hot text are dealt out over tasks.

    Null texts are empty texts, and all empty ones are equal; very long texts are compared whole. A null id sorts last
    (it stays only if no other row of the group has as many code points). Rows that repeat an id each count, and each
    is reported; as ids decide ties, ``kept`` is then true for each such row. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = base.select("id", F.char_length("text").alias("n_chars"), normalised(F.col("text")).alias("norm")).withColumn("slot", F.shiftrightunsigned(F.xxhash64("norm"), 64 - slot_bits) if slot_bits < 64 else F.xxhash64("norm"))
    entries = written(hashed.select("id", "n_chars", "slot", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("place")), "entries")
    index = build_index(entries, capacity, slot_bits=slot_bits, hot=hot)
    shared = written(index.filter("n > 1").withColumn("rows", F.col("n")), "shared-slots")
    groups = written(chains(join_salted(hashed, shared, ["slot"], ["id", "n_chars"]), hot).withColumn("n", F.col("group_size")), "groups")
    many = join_salted(entries, groups.drop("bucket"), ["slot", "sha"], ["place"], how="left")
    alone = F.col("group_size").isNull()
    kept = F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")))
    return many.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, max(length(text)) as most from d group by norm),
k as (select d.norm, min(doc_id) as keep_id from d join g on d.norm = g.norm and length(d.text) = g.most group by d.norm)
select d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id as kept, sha256(d.norm) as text_sha256
from d join g on d.norm = g.norm join k on d.norm = k.norm
"""
