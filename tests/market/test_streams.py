"""Streams over files give what the batch forms give."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaarlens.streaming import jobs

SCHEMA = "listing_id long, at timestamp, images string"


def source(spark, tmp_path, batches):
    at = tmp_path / "in"
    for n, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["listing_id", "at", "images"])
        spark.createDataFrame(frame.assign(at=pd.to_datetime(frame["at"])), SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(at))


def test_vectors_and_announcements(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, "2024-01-01", "a"), (2, "2024-01-01", "b")], [(1, "2024-01-02", "c")]])
    got = jobs.run_to_table(jobs.embed_stream(s, lambda batch: [[float(len(batch))] for _ in batch]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.listing_id for r in got.collect()) == [1, 1, 2]
    once = jobs.run_to_table(jobs.announce_once(s.select("listing_id")), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r.listing_id for r in once.collect()) == [1, 2]


def test_unseen_listings(spark, tmp_path):
    """Once at a later sighting, once as time passes; a listing seen again in time is not unseen."""
    s = source(spark, tmp_path, [[(1, "2024-01-01", "a"), (2, "2024-01-01", "a")], [(2, "2024-01-04", "a"), (4, "2024-01-04", "a")], [(4, "2024-01-14", "a")], [(3, "2024-01-21", "a")], [(3, "2024-01-21", "a")]])
    got = jobs.run_to_table(jobs.unseen(s, 5 * 86_400_000, "1 day"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((r.listing_id, r.unseen_since.day) for r in got.collect()) == [(1, 1), (2, 4), (4, 4), (4, 14)]


CHECKS = "listing_id long, at timestamp, tie long, ended boolean, price double, shipping_cost double"


def shuffled(spark, tmp_path, rows, files, seed):
    """``rows`` in random files, then two far later rows that let the watermark pass them."""
    rng = random.Random(seed)
    parts = [[] for _ in range(files)]
    for r in rows:
        parts[rng.randrange(files)].append(r)
    ends = [[(-1, dt.datetime(2030, 1, 1), 0, None, None, None)], [(-2, dt.datetime(2030, 1, 1), 0, None, None, None)]]
    for part in [p for p in parts if p] + ends:
        spark.createDataFrame(part, CHECKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def played(spark, tmp_path, df):
    return [r for r in jobs.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect() if r.listing_id >= 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_checks_and_observations_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200)), n, rng.random() < 0.5, rng.choice([None, 1.0, 2.0]), rng.choice([None, None, 0.0, 5.0])) for n in range(60)]
    checks, notes = [], []
    for k in range(4):
        status, last = "alive", None
        for _, _, tie, ended, price, ship in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            change = "terminal" if status in ("confirmed", "terminal") else ("confirmed" if status == "strike" else "strike") if ended else "recovered" if status == "strike" else "alive"
            status = "alive" if change == "recovered" else change
            checks.append((k, tie, change))
            now = (price, ship if ship is not None or last is None else last[1])
            if last is None or now != last:
                notes.append((k, tie, *now))
            last = now
    s = shuffled(spark, tmp_path, rows, 4, seed)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert sorted((r.listing_id, r.tie, r.change) for r in played(spark, tmp_path / "a", jobs.two_strikes(s, "10 days"))) == sorted(checks)
    assert sorted((r.listing_id, r.tie, r.price, r.shipping_cost) for r in played(spark, tmp_path / "b", jobs.changes_only(s, "10 days"))) == sorted(notes, key=lambda r: r[:2])


def test_rows_wait_for_the_watermark_and_no_longer(spark, tmp_path):
    """A check that the watermark has passed is dropped; those within its delay are played in order."""
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    files = [[(1, at(10), 0, True, None, None)], [(1, at(9), 1, True, None, None)], [(2, at(30), 2, False, None, None)], [(1, at(1), 3, False, None, None)], [(3, at(60), 4, False, None, None)], [(3, at(60), 5, False, None, None)]]
    for part in files:
        spark.createDataFrame(part, CHECKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.listing_id, r.tie): r.change for r in played(spark, tmp_path, jobs.two_strikes(s, "2 days"))}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): "strike", (1, 0): "confirmed"}


def test_windows(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, "2024-01-01", "a"), (2, "2024-01-01", "b")], [(1, "2024-01-09", "c")], [(1, "2024-01-10", "c")]])
    got = jobs.run_to_table(jobs.activity(s).select(F.col("w.start").alias("start"), "n"), str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert (2,) in [(r.n,) for r in got]
