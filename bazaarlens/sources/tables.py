"""Readers and writers of the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.operators.normalize import BODY, ITEM

PAGE = f"search_id bigint, fetched_at string, itemSummaries array<struct<{ITEM}>>, total bigint"
PAGE_SIZE, DEALS_TTL_S = 200, 7200


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of search pages: search_id, position, total, kept, truncated and the item's own columns; 200 of a page at most."""
    pages = spark.read.schema(PAGE).json(path).withColumn("items", F.slice(F.coalesce("itemSummaries", F.array().cast(f"array<struct<{ITEM}>>")), 1, PAGE_SIZE))
    kept = F.size("items")
    return pages.select("search_id", "total", kept.alias("kept"), (F.col("total") > kept).alias("truncated"), F.posexplode("items").alias("position", "item")).select("search_id", "total", "kept", "truncated", "position", "item.*")


def item_bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BODY).json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a snapshot, as its pointer names it."""
    version = spark.read.text(f"{path}/current").orderBy(F.desc("value")).first()[0]
    return spark.read.parquet(f"{path}/{version.split(' ')[-1]}")


def write_snapshot(df: DataFrame, path: str, number: int, partition_by: tuple[str, ...] = ()) -> None:
    """A new version beside the old ones, then the pointer; readers of the old one are not disturbed."""
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    df.sparkSession.createDataFrame([(f"{number:08d} {name}",)], "value string").coalesce(1).write.mode("append").text(f"{path}/current")


SAVED_SEARCH = "id bigint, keyword string, location string, enabled boolean, created_at timestamp_ntz, last_run_at timestamp_ntz, last_result_total int"
WATCHED = "id bigint, listing_id bigint, added_at timestamp_ntz, note string, price_when_added double"


def saved_searches(spark: SparkSession, path: str) -> DataFrame:
    """Saved searches; columns that the files lack are null, and one that does not say otherwise is enabled."""
    return spark.read.schema(SAVED_SEARCH).parquet(path).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def watched(spark: SparkSession, path: str) -> DataFrame:
    """Watched listings, one row each: watching something again is the same as watching it once, and the first time counts."""
    rows = spark.read.schema(WATCHED).parquet(path).filter(F.col("listing_id").isNotNull())
    first = F.min_by(F.struct("id", "added_at", "note", "price_when_added"), F.struct(F.col("added_at").isNull(), "added_at", "id"))
    return rows.groupBy("listing_id").agg(first.alias("x")).select("x.id", "listing_id", "x.added_at", "x.note", "x.price_when_added")


def append_observations(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def seed_history(listing: DataFrame) -> DataFrame:
    """The opening observation of listings that have no history yet; its shipping is unknown."""
    return listing.select("listing_id", "price", F.lit(None).cast("double").alias("shipping_cost"), F.col("first_seen_at").alias("observed_at"))


def reset_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def write_deals(deals: DataFrame, path: str, now: Column) -> None:
    deals.withColumn("scanned_at", now).write.mode("overwrite").parquet(path)


def read_deals(spark: SparkSession, path: str, schema: T.StructType, now: Column, ttl: int = DEALS_TTL_S) -> DataFrame:
    """The last scan's deals; none where there is no scan or it is older than the time to live."""
    found = spark.read.schema(schema).option("ignoreMissingFiles", "true")
    try:
        return found.parquet(path).filter(F.col("scanned_at") > now - F.expr(f"interval {ttl} seconds"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
