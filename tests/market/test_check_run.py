"""One pass of checks, literally: retirement first, then the choice, the look-up, strikes and counters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import lifecycle, normalize
from bazaarlens.plans.fixtures import kept

NOW = dt.datetime(2024, 7, 1)
ROW = "listing_id long, source_id string, source string, title string, category string, condition string, price double, shipping_cost double, shipping_estimated boolean, is_auction boolean, bid_count int, accepts_best_offer boolean, image_hash string, status string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, last_checked_at timestamp, missing_since timestamp, item_end_date timestamp, aspects map<string,string>, category_id string, sold_quantity int, is_gtc boolean, lot_size int, completeness string, has_defect boolean, is_accessory boolean, price_is_from boolean, capacity_gb int, spec_generation string, form_factor string, model_key string, variant_signals map<string,string>, epid string"


def row(i, first=100, seen=10, checked=None, missing=None, status="active", source="ebay", image=None):
    ago = lambda d: None if d is None else NOW - dt.timedelta(days=d)
    return (i, f"s{i}", source, "Lot of 3 handhelds", None, None, 10.0, 1.0, False, False, None, False, image, status, ago(first), ago(first), ago(seen), ago(checked), ago(missing), None, None, None, None, None, None, None, False, False, False, None, None, None, None, None, None)


#: 1 and 2 are old and long unseen, 2 with a strike; 3 has a strike and is gone, 4 is gone, 5 has a strike and is back, 6 is there, 7 was seen an hour ago, 8 is another source's, 9 is a relist of 3.
ROWS = [row(1, 100, 40), row(2, 100, 40, 5, 5), row(3, 50, 20, 4, 4, image="p"), row(4, 50, 20, 9), row(5, 50, 20, 3, 3), row(6, 50, 20), row(7, 50, 1 / 24), row(8, 100, 40, source="depop"), row(9, 5, 1 / 24, image="p")]


def bodies(spark, ids):
    return spark.createDataFrame([(f"s{i}",) for i in ids], "itemId string").select(F.from_json(F.to_json(F.struct("itemId")), normalize.BODY).alias("b")).select("b.*")


def run(spark, quota=None, budget=lifecycle.BUDGET):
    rows = spark.createDataFrame(ROWS, ROW)
    return lifecycle.counted_run(rows, bodies(spark, [1, 2, 5, 6]), F.lit(NOW), kept, budget, quota)


def test_retired_listings_cost_no_call(spark):
    rows, counters = run(spark)
    got = {r.listing_id: r for r in rows.collect()}
    assert {i: r.change for i, r in got.items()} == {3: "confirmed", 4: "strike", 5: "recovered", 6: "alive"}
    assert got[3].status == "likely_sold" and got[3].relist_id == 9 and got[3].sale_score is not None and got[4].sale_score is None
    assert got[5].missing_since is None and got[4].missing_since == NOW and got[6].lot_size == 3 and got[4].lot_size is None
    assert counters == {"checked": 4, "marked_sold": 1, "detected_relists": 1, "enriched": 2, "pending_confirmation": 1, "recovered": 1, "skipped_proven_alive": 2, "retired_stale": 2, "quota_exhausted": False}


@pytest.mark.parametrize("quota,budget,ids,spent", [(2, 700, {3, 5}, True), (4, 700, {3, 4, 5, 6}, False), (None, 3, {3, 5, 6}, False), (0, 700, set(), True), (None, 0, set(), False)])
def test_budget_and_quota(spark, quota, budget, ids, spent):
    """Strikes first, then never checked, then least lately checked."""
    rows, counters = run(spark, quota, budget)
    assert {r.listing_id for r in rows.collect()} == ids
    assert (counters["checked"], counters["quota_exhausted"], counters["retired_stale"]) == (len(ids), spent, 2)


def test_sources_are_retired_apart(spark):
    rows = spark.createDataFrame(ROWS, ROW)
    got = {r.listing_id: (r.status, r.retired) for r in lifecycle.retired_of(rows, F.lit(NOW)).collect()}
    assert got[1] == got[2] == ("stale", True) and got[8] == got[3] == ("active", False)
