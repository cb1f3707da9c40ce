"""Literal cases of read models, saved tables, rule reports and deals with a time to live."""

import datetime as dt
import time

from bazaarlens.operators import measure, serving, valuation
from bazaarlens.plans.fixtures import listing
from bazaarlens.sources import tables
from bazaarlens.streaming import jobs

AT = "/root/testdata/sf0.001"


def test_series_of_delivered_prices(spark):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = spark.createDataFrame([(1, 10.0, 5.0, at(0), 0), (1, 30.0, None, at(1), 1), (1, 20.0, 1.0, at(2), 2), (2, 7.0, None, at(0), 3)], "listing_id long, price double, shipping_cost double, observed_at timestamp, tie long")
    assert sorted(map(tuple, serving.series_summary(rows).collect())) == [(1, 15.0, 21.0, 15.0, 30.0, 3), (2, 7.0, 7.0, 7.0, 7.0, 1)]
    assert sorted(map(tuple, serving.series_summary(rows, newest=2).collect())) == [(1, 30.0, 21.0, 21.0, 30.0, 2), (2, 7.0, 7.0, 7.0, 7.0, 1)]


def test_valued_on_demand(spark):
    """One id is one row, twice asked or not; an id that no listing has is none."""
    rows = listing(spark, AT)
    some = [r.listing_id for r in rows.select("listing_id").orderBy("listing_id").limit(3).collect()]
    ids = spark.createDataFrame([(i,) for i in [*some, some[0], -5, None]], "listing_id long")
    got = valuation.value_listings(rows, ids).collect()
    assert sorted(r.listing_id for r in got) == some
    for r in got:
        assert r.signals.comp_count == r.n == len(r.comps) and (r.estimate is None) == (r.n < 3) == bool(r.signals.below_minimum)


def test_watched_once_and_searches_enabled(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    spark.createDataFrame([(3, 1, day(2), "b", 2.0), (2, 1, day(1), "a", 1.0), (1, 1, day(1), None, 3.0), (4, 2, None, None, 4.0), (5, None, day(1), "x", 5.0)], tables.WATCHED).write.parquet(str(tmp_path / "w"))
    assert sorted(map(tuple, tables.watched(spark, str(tmp_path / "w")).collect())) == [(1, 1, day(1), None, 3.0), (4, 2, None, None, 4.0)]
    spark.createDataFrame([(1, "a", None), (2, "b", False)], "id long, keyword string, enabled boolean").write.parquet(str(tmp_path / "s"))
    assert sorted((r.id, r.enabled, r.location) for r in tables.saved_searches(spark, str(tmp_path / "s")).collect()) == [(1, True, None), (2, False, None)]


def test_rule_reports(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 20.0), ("a", 2, 5.0), ("a", None, 100.0), ("a", 1, None), ("b", None, 1.0)], "rule string, bucket int, price double")
    got = {r.rule: r for r in measure.bucket_report(rows, "rule", "bucket").collect()}
    assert (got["a"].buckets, got["a"].unstated, got["a"].median_spread, got["a"].worst_spread, got["a"].overall_spread, got["a"].median_trimmed) == (2, 1, 2.0, 2.0, 20.0, None)
    assert (got["b"].buckets, got["b"].unstated, got["b"].worst_spread) == (0, 1, None)
    changes = spark.createDataFrame([(None, 4), (2, 4), (4, 4), (4, None), (None, None)], "b int, a int")
    assert tuple(measure.rule_rate(changes, "b", "a").first()) == (2, 5, 0.4)
    assert tuple(measure.rule_rate(changes.limit(0), "b", "a").first()) == (0, 0, 0.0)
    ids = spark.range(100)
    assert [r.id for r in measure.seeded_sample(ids, "id", 5).collect()] == [r.id for r in measure.seeded_sample(ids.repartition(7), "id", 5).collect()]


def test_deals_are_forgotten_after_their_time(spark, tmp_path):
    """Within the time to live the same score is passed once; after it, again."""
    schema = "listing_id long, tie long, score double"
    at = str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(at)
    add((1, 0, 0.5), (2, 1, 0.3))
    s = spark.readStream.schema(schema).parquet(at)
    run = lambda name, ttl: sorted((r.listing_id, r.tie) for r in jobs.run_to_table(jobs.fresh_deals(s, ttl), str(tmp_path / name), str(tmp_path / f"{name}-c"), empty_batches=False).collect())
    assert run("long", 10**9) == run("short", 1) == [(1, 0), (2, 1)]
    time.sleep(0.1)
    add((1, 2, 0.5), (2, 3, 0.4))
    assert run("long", 10**9) == [(1, 0), (2, 1), (2, 3)]
    assert run("short", 1) == [(1, 0), (1, 2), (2, 1), (2, 3)]
