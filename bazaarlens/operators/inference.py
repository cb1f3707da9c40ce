"""Vectors for listings from a model that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_CAP = 2000


def pending(listing: DataFrame, limit: int | None = JOB_CAP) -> DataFrame:
    """Listings for which no vector has been tried, by id; ``limit`` bounds one job."""
    rows = listing.filter(F.col("embedded_at").isNull())
    return rows if limit is None else rows.orderBy("listing_id").limit(limit)


def _tried(model: Callable[[list], list], values: list) -> list[tuple[list | None, str | None]]:
    """(vector, reason) of each value. A batch that fails is halved until the value that fails stands alone, so the others cost a few calls more."""
    if not values:
        return []
    try:
        vectors = list(model(values))
    except Exception as e:  # whatever the caller's model raises is a value's fault once it stands alone
        if len(values) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(values) // 2
        return _tried(model, values[:half]) + _tried(model, values[half:])
    if len(vectors) != len(values):
        raise ValueError(f"the model gave {len(vectors)} vectors for {len(values)} values")
    return [(v, "no vector" if v is None else None) for v in vectors]


def embed(rows: DataFrame, model: Callable[[list], list] | None = None, column: str = "images", load: Callable[[], Callable[[list], list]] | None = None) -> DataFrame:
    """Rows (listing_id, vector, reason): the model's vectors for batches of values; where there is none, why.

    ``load`` makes the model, once for each task, before the first batch; or ``model`` is given as it is. Null values
    are not shown to the model.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model
        for batch in batches:
            own = own or load()
            values = [list(v) if hasattr(v, "tolist") else v for v in batch[column]]
            known = [v for v in values if v is not None]
            got = iter(_tried(own, known))
            out = [next(got) if v is not None else (None, "no value") for v in values]
            yield pd.DataFrame({"listing_id": batch["listing_id"], "vector": [v for v, _ in out], "reason": [r for _, r in out]})

    return rows.select("listing_id", column).mapInPandas(run, "listing_id long, vector array<float>, reason string")


def assert_some(counters: DataFrame) -> DataFrame:
    """Counters of attempts; fails where all of several attempts failed, as then the model is at fault and not the values."""
    broken = (F.col("attempted") > 1) & (F.col("embedded") == 0)
    return counters.withColumn("failed", F.when(broken, F.raise_error(F.lit("all attempts failed")).cast("long")).otherwise(F.col("failed")))


def reasons(vectors: DataFrame) -> DataFrame:
    """How many attempts failed, by reason."""
    return vectors.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def stamped(listing: DataFrame, vectors: DataFrame, now: Column) -> DataFrame:
    """Every attempt is stamped; a vector is set only where there is one."""
    rows = listing.join(vectors.withColumn("__tried", F.lit(True)), "listing_id", "left")
    return rows.withColumn("embedding", F.coalesce("vector", "embedding")).withColumn("embedded_at", F.when(F.col("__tried"), now).otherwise(F.col("embedded_at"))).drop("vector", "reason", "__tried")


def attempt_counters(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("attempted"), F.count("vector").alias("embedded"), F.count_if(F.col("vector").isNull()).alias("failed"))
