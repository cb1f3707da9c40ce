"""Literal cases of single operators."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarlens.functions.stats import cosine, upper_medians, weighted_median, weighted_median_of
from bazaarlens.operators import extract, inference, knn, lifecycle, measure, merge, normalize, valuation
from bazaarlens.plans import market
from bazaarlens.plans.fixtures import listing
from bazaarlens.sources import tables

AT = "/root/testdata/sf0.001"


def median_of(pairs):
    pairs = sorted(pairs)
    if not pairs:
        return None
    total = sum(w for _, w in pairs)
    if total <= 0:
        return pairs[len(pairs) // 2][0]
    run = 0.0
    for v, w in pairs:
        run += w
        if run >= total / 2:
            return v


CASES = [[(10, 1), (20, 1), (30, 1)], [(10, 10), (20, 1), (30, 1)], [(10, 1), (20, 1), (30, 10)], [], [(10, 0), (20, 0), (30, 0)], [(100, 1), (105, 1), (110, 1), (5000, 1)]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(more=st.lists(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 4)), max_size=7), max_size=4))
def test_weighted_median(spark, more):
    cases = CASES + more
    rows = spark.createDataFrame([(i, [(float(v), float(w)) for v, w in c]) for i, c in enumerate(cases)], "i int, p array<struct<value: double, weight: double>>")
    got = {r.i: r.m for r in rows.select("i", weighted_median_of(F.col("p")).alias("m")).collect()}
    assert got == {i: median_of(c) for i, c in enumerate(cases)}
    flat = rows.select("i", F.explode("p").alias("x")).select("i", "x.value", "x.weight")
    assert {r.i: r.weighted_median for r in weighted_median(flat, ["i"], "value", "weight").collect()} == {i: median_of(c) for i, c in enumerate(cases) if c}


def test_blocks_and_expressions_find_the_same_neighbours(spark):
    rows = listing(spark, AT)
    q, c = rows.filter("listing_id % 40 = 0 and model_key is not null"), knn.comparable(rows)
    one = sorted(map(tuple, knn.knn(q, c, 7, chunk=3).select("query_id", "listing_id", "similarity", "rank").collect()))
    two = sorted(map(tuple, knn.knn_expressions(q, c, 7).collect()))
    assert one == two and one


def test_block_plan(spark):
    rows = listing(spark, AT)
    plan = valuation.sold_comps(valuation.candidates(rows), rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.96)
    assert df.select(knn.l2_normalised("a")).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="must have 3"):
        knn.assert_dimension(df, 3, "a").collect()


def test_two_strikes_in_batches(spark):
    schema = "listing_id long, status string, missing_since timestamp, last_checked_at timestamp"
    rows = spark.createDataFrame([(1, "active", None, None), (2, "active", None, None), (3, "stale", None, None)], schema)
    now = F.expr("timestamp '2024-01-02'")
    ended = spark.createDataFrame([(1, True), (2, True), (3, True)], "listing_id long, ended boolean")
    once = lifecycle.checked(rows, ended, now)
    assert {r.listing_id: r.change for r in once.collect()} == {1: "strike", 2: "strike", 3: None}
    again = lifecycle.checked(once.drop("change"), spark.createDataFrame([(1, True), (2, False)], "listing_id long, ended boolean"), now)
    assert {r.listing_id: (r.status, r.change) for r in again.collect()} == {1: ("likely_sold", "confirmed"), 2: ("active", "recovered"), 3: ("stale", None)}
    assert again.filter("listing_id = 2").first().missing_since is None


def test_upsert_never_blanks_or_revives(spark):
    schema = "listing_id long, source string, source_id string, title string, price double, shipping_cost double, shipping_estimated boolean, epid string, image_hash string, status string, first_seen_at timestamp, last_seen_at timestamp, missing_since timestamp"
    stored = spark.createDataFrame([(1, "ebay", "a", "old", 5.0, 2.0, True, "e", None, "likely_sold", None, None, None), (2, "ebay", "b", "x", 5.0, 2.0, False, None, "h", "stale", None, None, None)], schema)
    page = spark.createDataFrame([("ebay", "a", "new", 5.0, None, False, None, "h1", 0), ("ebay", "b", "x", 6.0, 2.0, False, "e2", "h2", 1), ("ebay", "b", "twice", 9.0, 2.0, False, "e2", "h2", 2), ("ebay", "c", "c", 1.0, None, False, None, None, 3)], "source string, source_id string, title string, price double, shipping_cost double, shipping_estimated boolean, epid string, image_hash string, position int")
    new = merge.upsert(stored, merge.first_of_key(page).drop("position"), F.expr("timestamp '2024-01-02'"))
    got = {r.source_id: r for r in new.collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.title, a.shipping_cost, a.shipping_estimated, a.epid, a.image_hash, a.status, a.price_changed) == ("new", 2.0, True, "e", "h1", "likely_sold", False)
    assert (b.title, b.price, b.epid, b.image_hash, b.status, b.revived, b.price_changed) == ("x", 6.0, "e2", "h", "active", True, True)
    assert c.created and c.price_changed and c.status == "active"
    assert merge.counters(new).first().asDict() == {"inserted": 1, "updated": 2, "upserted": 3, "reactivated": 1, "price_changes": 1}


def test_shipping_and_images(spark):
    df = spark.createDataFrame([([("FIXED", ("12.50",)), ("FIXED", ("24.99",))],), ([("CALCULATED", ("3",)), ("FIXED", ("x",))],), (None,), ([("FIXED", ("0",))],)], "o array<struct<shippingCostType: string, shippingCost: struct<value: string>>>")
    cost, estimated = normalize.cheapest_shipping(F.col("o"))
    assert [tuple(r) for r in df.select(cost, estimated).collect()] == [(12.5, False), (3.0, True), (None, False), (0.0, False)]
    urls = spark.createDataFrame([("http://x/s-l225.jpg",), ("http://x/s-l64.txt",)], "u string")
    assert [r[0] for r in urls.select(normalize.larger_image(F.col("u"))).collect()] == ["http://x/s-l1600.jpg", "http://x/s-l64.txt"]


def test_no_python_in_extraction(spark):
    df = spark.createDataFrame([("RTX 3090 with big backplate", "Graphics", None)], "title string, category string, condition string")
    out = extract.extracted(df)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.first().model_key == "rtx-3090" and not out.first().is_accessory


def test_inference_stamps_every_attempt(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "bad", None, None), (3, "c", [9.0], None)], "listing_id long, images string, embedding array<float>, embedded_at timestamp")

    def model(batch):
        if "bad" in batch:
            raise ValueError("bad")
        return [[1.0, 2.0] for _ in batch]

    vectors = inference.embed(inference.pending(rows, 2), model)
    got = {r.listing_id: r for r in inference.stamped(rows, vectors, F.expr("timestamp '2024-01-01'")).collect()}
    assert got[1].embedding == [1.0, 2.0] and got[2].embedding is None and got[3].embedding == [9.0]
    assert got[1].embedded_at and got[2].embedded_at and not got[3].embedded_at
    assert tuple(inference.attempt_counters(vectors).first()) == (2, 1, 1)


def test_snapshots_pages_and_deals(spark, tmp_path):
    df = spark.range(3)
    tables.write_snapshot(df, str(tmp_path / "s"), 1)
    tables.write_snapshot(df.filter("id > 0"), str(tmp_path / "s"), 2)
    assert tables.read_snapshot(spark, str(tmp_path / "s")).count() == 2
    (tmp_path / "page.json").write_text('{"search_id": 1, "itemSummaries": [{"itemId": "a", "price": {"value": "3"}}, {"itemId": "b"}], "total": 9}\n{"search_id": 2, "total": 0}\n')
    page = tables.search_pages(spark, str(tmp_path / "page.json")).collect()
    assert [(r.itemId, r.position, r.truncated) for r in page] == [("a", 0, True), ("b", 1, True)]
    at, now = str(tmp_path / "deals"), F.expr("timestamp '2024-01-01 00:00:00'")
    schema = spark.sql("select 1L as id, timestamp '2024-01-01' as scanned_at").schema
    assert tables.read_deals(spark, at, schema, now).count() == 0
    tables.write_deals(df, at, now)
    assert tables.read_deals(spark, at, schema, now).count() == 3
    assert tables.read_deals(spark, at, schema, F.expr("timestamp '2024-01-01 03:00:00'")).count() == 0


def test_upper_medians_of_groups_of_any_size(spark):
    rows = [(k, v, w) for k, vs in ((None, [3.0, 1.0]), ("a", [5.0, 5.0, 2.0, None, 9.0]), ("b", [None]), ("c", [4.0])) for v, w in zip(vs, reversed(vs))]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: tuple(r)[1:] for r in upper_medians(df, ["k"], ["v", "w"]).collect()}
    assert got == {None: (2, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0), "a": (5, 5.0, 2.0, 9.0, 5.0, 2.0, 9.0), "b": (1, None, None, None, None, None, None), "c": (1, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0)}
    spreads = {r.k: (r.n, r.median, r.spread) for r in measure.bucket_spread(df, "k", "v").collect()}
    assert spreads == {None: (2, 3.0, 3.0), "a": (4, 5.0, 4.5), "c": (1, 4.0, None)}
    for plan in (measure.bucket_spread(df, "k", "v"), market.valuation_confidence(spark, AT)):
        assert "collect_list" not in plan._jdf.queryExecution().toString()
