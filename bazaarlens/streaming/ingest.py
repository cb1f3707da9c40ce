"""Search pages as a stream, merged into snapshot versions; a batch that runs twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bazaarlens.operators import merge
from bazaarlens.sources.snapshots import Snapshot


def steps(incoming: DataFrame, stored: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The price observations that ``incoming`` makes, sighting after sighting, starting from what is stored.

    A sighting's shipping is the last known one, the stored one included. It makes an observation if it is the first
    of a new listing, or if price or shipping differ from those before. A new listing's id is that of its first sighting.
    """
    ids = stored.select(*key, F.col("listing_id").alias("__id"), F.col("price").alias("__price"), F.col("shipping_cost").alias("__ship"), F.lit(True).alias("__was"))
    rows = incoming.select(*key, *order, "listing_id", "price", "shipping_cost").join(ids, list(key), "left")
    w = Window.partitionBy(*key).orderBy(*order)
    known = F.coalesce(F.last("shipping_cost", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__ship"))
    rows = rows.withColumn("__known", known).withColumn("__first", F.row_number().over(w) == 1)
    before = lambda now, was: F.when(F.col("__first"), F.col(was)).otherwise(F.lag(now).over(w))
    same = before("price", "__price").eqNullSafe(F.col("price")) & before("__known", "__ship").eqNullSafe(F.col("__known"))
    new = F.col("__first") & F.col("__was").isNull()
    return rows.withColumn("__due", new | ~same).withColumn("__own", F.first("listing_id").over(w)).filter("__due").select(F.coalesce("__id", "__own").alias("listing_id"), "price", F.col("__known").alias("shipping_cost"), F.col(order[0]).alias("observed_at"))


def merge_batch(snapshot: Snapshot, log: str, policy: dict = merge.SEARCH_POLICY, order: tuple[str, ...] = ("fetched_at", "position"), keep: int = 2) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: a micro-batch of sightings (columns of the snapshot, and ``order``) becomes the next version.

    First the batch's observations and what became of each key are written under ``log``, then the version, which is
    the batch's commit: logs of batches beyond the newest version are those of a batch that will run again. Each part
    is the same whenever it is written, as it depends on the batch and the version before only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        number = batch_id + 1
        if number in snapshot.versions():
            return
        batch = batch.persist()
        try:
            stored = snapshot.read(snapshot.newest(number))
            steps(batch, stored, snapshot.key, order).write.mode("overwrite").parquet(f"{log}/observations/batch={batch_id}")
            folded = merge.folded(batch, snapshot.key, order, policy)
            after = merge.upsert(stored, folded.hint("shuffle_hash"), F.col("n.__last"), policy, snapshot.key, first=F.col("n.__first"))
            touched = after.filter("created or updated").select(*snapshot.key, "created", "updated", "revived")
            touched.write.mode("overwrite").parquet(f"{log}/touched/batch={batch_id}")
            snapshot.write(after.select(*stored.columns), number)
        finally:
            batch.unpersist()
        snapshot.vacuum(keep)

    return run


def upsert_stream(sightings: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All sightings that are there, batch by batch; started again with its checkpoint it goes on where it stopped."""
    return sightings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observations(snapshot: Snapshot, log: str) -> DataFrame:
    """Observations of all batches that have committed."""
    return snapshot.spark.read.parquet(f"{log}/observations").filter(F.col("batch") < snapshot.newest()).drop("batch")


def counters(snapshot: Snapshot, log: str) -> DataFrame:
    """One row per committed batch: inserted, updated, reactivated."""
    rows = snapshot.spark.read.parquet(f"{log}/touched").filter(F.col("batch") < snapshot.newest())
    return rows.groupBy("batch").agg(F.count_if("created").alias("inserted"), F.count_if("updated").alias("updated"), F.count_if("revived").alias("reactivated"))
