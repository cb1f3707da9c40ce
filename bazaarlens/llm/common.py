"""What the text operators share: the shared folder, row numbers, size-checked and salted joins, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakSet

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A join side is broadcast only after its values have been measured to need at most so many bytes.
BROADCAST_BYTES = 32 << 20
#: A key is dealt out over several tasks from so many rows on, and from this part of all rows on; so at most MAX_HOT keys are.
HOT_ROWS, MAX_HOT = 1_000, 10_000


#: Tables that ``written`` has made: read straight from files, so that a row is named by its file and place.
_tables: WeakSet = WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the session runs on one machine (tests), a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(at)
    table = spark.read.schema(df.schema).parquet(at)
    _tables.add(table)
    return table


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame, name: str, stored: bool = False) -> DataFrame:
    """``docs`` with a column that tells its rows apart however often they are read.

    Rows of a DataFrame in general are numbered in a written table. Tables that ``written`` made are not written again,
    nor are those that the caller says are read straight from files (``stored``): their rows are named by a hash of the
    file's path and the place in there.
    """
    if stored or docs in _tables:
        return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias(name), "*")
    return written(docs.select(F.monotonically_increasing_id().alias(name), "*"), "numbered")


def rows_of(docs: DataFrame, columns: list[Column], stored: bool) -> DataFrame:
    """``columns`` of ``docs`` beside the column row, which tells its rows apart (see ``numbered``)."""
    if not stored and docs not in _tables:
        return numbered(docs.select(*columns), "row")
    row = free_name(docs, "row")
    return numbered(docs, row, stored).select(F.col(row).alias("row"), *columns)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Fewer rows in an Arrow batch for jobs run inside, whose rows hold whole documents."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _weight(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value) + 16
    elif isinstance(kind, ArrayType):
        size = F.aggregate(F.transform(value, lambda x: _weight(x, kind.elementType)), F.lit(24).cast("long"), lambda a, x: a + x)
    elif isinstance(kind, StructType):
        size = sum((_weight(value[f.name], f.dataType) for f in kind), F.lit(16))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def bytes_of(df: DataFrame) -> int:
    """How many bytes the values of all rows need in memory, about."""
    row = sum((_weight(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(row)).first()[0] or 0


def join_sized(left: DataFrame, right: DataFrame, on: str | list[str], how: str, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts ``right`` when its values need at most ``bound`` bytes, and shuffles both sides beyond.

    ``right`` should be cheap to read twice (a written table).
    """
    return left.join(F.broadcast(right) if bytes_of(right) <= bound else right, on, how)


def join_salted(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], n: str = "n", how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Join of ``left`` with ``right``, which has one row a key and in ``n`` how many rows of ``left`` have that key.

    ``right`` is broadcast if its values need at most ``bound`` bytes. Beyond that both sides are shuffled, and the rows
    of a hot key are dealt out over parts by a hash of their ``spread`` columns, the key's one row being repeated for
    each part: no task gets more than about ``HOT_ROWS`` rows or a ``MAX_HOT``-th of all rows of one key. As counts
    add up, there are at most ``MAX_HOT`` hot keys; of them only keys and numbers of parts are broadcast. ``right``
    should be a written table. The result has its columns without ``n``.
    """
    weight = sum((_weight(F.col(f"`{f.name}`"), f.dataType) for f in right.schema), F.lit(16))
    total, top, size = right.agg(F.sum(n), F.max(n), F.sum(weight)).first()
    if (size or 0) <= bound:
        return left.join(F.broadcast(right.drop(n)), on, how)
    limit = max(HOT_ROWS, total // MAX_HOT)
    if top <= limit:
        return left.join(right.drop(n), on, how)
    parts = F.broadcast(right.filter(F.col(n) > limit).select(*on, F.ceil(F.col(n) / limit).cast("int").alias("__parts")))
    dealt = left.join(parts, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")), F.lit(0))).drop("__parts")
    last = F.when(F.col(n) > limit, F.ceil(F.col(n) / limit) - 1).otherwise(0).cast("bigint")
    copies = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop(n)
    return dealt.join(copies, [*on, "__part"], how).drop("__part")


def _stars(edges: DataFrame, least: DataFrame, tag: str) -> DataFrame:
    """One round: each node's neighbours are hung on the smallest node among itself and them (edges are u > v)."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    large = written(join_salted(up, least.select("u", "m", "n"), ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")), f"{tag}-large")
    down = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{tag}-down")
    return join_salted(large, down, ["u"], ["v"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components by alternating star operations: rows (node, root), root being the smallest node.

    ``edges`` has columns u and v of one type. Each step is a written table, so no lineage builds up and nothing is
    collected but a few numbers; a node with many neighbours is dealt out over tasks. The rounds end when each node but
    the roots has one neighbour, a smaller one: then all components are stars. Nodes without edges do not appear.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(edges, f"{tag}-edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"), F.count("*").alias("edges")), f"{tag}-least")
        if not least.agg(F.count_if((F.col("m") < F.col("u")) & (F.col("edges") > 1))).first()[0]:
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        now = written(_stars(now, least, tag), f"{tag}-stars")
