"""Queries of read models, reports, raw pages, vectors and streams; with their SQL."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import extract, inference, knn, measure, normalize, serving
from bazaarlens.plans import market, titles
from bazaarlens.plans.fixtures import COMPARABLE, WITH_LISTING, listing, scratch, table
from bazaarlens.sources import tables



# ---- read models


def listings_page(spark: SparkSession, sf: str) -> DataFrame:
    return serving.page(listing(spark, sf), "ebay", "active", 10, 500).select("listing_id", "first_seen_at", "price", "total_cost")


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("listing_id"), F.col("value").alias("price"), F.when(F.col("event_id") % 3 > 0, 5.0).alias("shipping_cost"), F.col("ts").alias("observed_at"), F.col("event_id").alias("tie"))


def price_history(spark: SparkSession, sf: str) -> DataFrame:
    return serving.price_history(_observations(spark, sf), 7)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return listing(spark, sf).filter("listing_id % 31 = 0").select("listing_id", (F.col("price") + F.col("listing_id") % 21 - 10).alias("price_when_added"))


def watchlist_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.watchlist(_items(spark, sf), listing(spark, sf), _observations(spark, sf), keep_ended=False)
    return rows.select("listing_id", F.round("change", 6).alias("change"), "n_active", "n_ended", F.coalesce(F.size("history"), F.lit(0)).alias("n_history"), F.get("history", F.lit(0)).alias("oldest"))


def watchlist_add(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    wanted = table(spark, sf, "customer").select((F.col("c_custkey") * 5).alias("listing_id"))
    return serving.watch(wanted, rows, _items(spark, sf), market.now()).select("listing_id", "price_when_added")


def deal_feed_filter(spark: SparkSession, sf: str) -> DataFrame:
    return serving.feed(market._valued(spark, sf), 0.3, 0.4, 20).select("listing_id", "score", "confidence")


def new_alerts(spark: SparkSession, sf: str) -> DataFrame:
    deals = market.deal_feed(spark, sf).select("listing_id", "score")
    return serving.alerts(deals, listing(spark, sf).filter("listing_id % 2 = 0"))


_OBS = "(select user_id as listing_id, value as price, case when event_id % 3 > 0 then 5.0 end as shipping_cost, ts as observed_at, event_id as tie from events)"
_ITEMS = ", items as (select listing_id, price + listing_id % 21 - 10 as price_when_added from listing where listing_id % 31 = 0)\n"
SQL = {
    "listings_page": WITH_LISTING + "select listing_id, first_seen_at, price, price + shipping_cost as total_cost from listing where source = 'ebay' and status = 'active' order by first_seen_at desc, listing_id limit 200 offset 10",
    "price_history": f"select *, price + shipping_cost as total_cost from {_OBS} where listing_id = 7",
    "watchlist_feed": WITH_LISTING + _ITEMS + f""", h as (select listing_id, count(*) as n, arg_min(price, (observed_at, tie)) as oldest from (select *, row_number() over (partition by listing_id order by observed_at desc, tie desc) as r from {_OBS}) where r <= 200 group by 1),
j as (select i.listing_id, i.price_when_added, l.price, l.status from items i join listing l on l.listing_id = i.listing_id)
select j.listing_id, round(case when price_when_added > 0 then (price - price_when_added) / price_when_added else 0 end, 6) as change, (select count(*) from j where status = 'active') as n_active, (select count(*) from j where status <> 'active') as n_ended, coalesce(h.n, 0) as n_history, h.oldest
from j left join h on h.listing_id = j.listing_id where status = 'active'""",
    "watchlist_add": WITH_LISTING + _ITEMS + "select l.listing_id, l.price as price_when_added from listing l where l.listing_id in (select c_custkey * 5 from customer) and l.listing_id not in (select listing_id from items)",
    "deal_feed_filter": WITH_LISTING + market._VALUED + "select listing_id, (estimate - asking) / estimate as score, confidence from valued where estimate > 0 and (estimate - asking) / estimate >= 0.3 and confidence >= 0.4 order by score desc, listing_id limit 20",
    "new_alerts": WITH_LISTING + market._VALUED + """, feed as (select listing_id, (estimate - asking) / estimate as score from valued where estimate > 0 and (estimate - asking) / estimate >= 0.2 and confidence >= 0.3 order by score desc, listing_id limit 50)
select listing_id, score, row_number() over (order by score desc, listing_id) <= 5 as shown from feed where listing_id % 2 <> 0""",
}

# ---- reports


def _comparable(spark: SparkSession, sf: str) -> DataFrame:
    return knn.comparable(listing(spark, sf))


def spread_report(spark: SparkSession, sf: str) -> DataFrame:
    return measure.four_groupings(_comparable(spark, sf))


def spread_worst(spark: SparkSession, sf: str) -> DataFrame:
    return measure.worst_groups(_comparable(spark, sf), ["category", "model_key"])


def spread_groups(spark: SparkSession, sf: str) -> DataFrame:
    return measure.group_spreads(_comparable(spark, sf), ["category", "model_key"])


def ddr_bucket_spread(spark: SparkSession, sf: str) -> DataFrame:
    return measure.bucket_spread(_comparable(spark, sf).filter("spec_generation = 'DDR5' and form_factor = 'laptop'"), "capacity_gb")


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return measure.coverage(listing(spark, sf))


def thin_pools(spark: SparkSession, sf: str) -> DataFrame:
    return measure.thin_pools(listing(spark, sf), ["category", "model_key"])


def kit_rule_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = titles.titled(spark, sf).select("category", F.array_max(extract.capacities(F.col("title"))).alias("b"), extract.capacity(F.col("title"), F.col("category")).alias("a"))
    return measure.rule_change(rows, "b", "a", "category")


def seed_history(spark: SparkSession, sf: str) -> DataFrame:
    return tables.seed_history(listing(spark, sf))


_GROUPED = f"""select {{keys}}, count(*) as n, median(price) as median, case when count(*) >= 2 then max(price) / min(price) end as spread,
  case when count(*) >= 5 then max(price) filter (where i = round_even(0.9 * (n - 1), 0)) / max(price) filter (where i = round_even(0.1 * (n - 1), 0)) end as trimmed
  from (select *, row_number() over (partition by {{keys}} order by price) - 1 as i, count(*) over (partition by {{keys}}) as n from listing where {COMPARABLE} and price > 0 {{known}}) group by {{keys}}"""


def _report(name: str, keys: list[str]) -> str:
    inner = _GROUPED.format(keys=", ".join(keys), known="".join(f" and {k} is not null" for k in keys))
    return f"select '{name}' as grouping, count(*) as groups, sum(n)::bigint as rows, median(spread) as median_spread, max(spread) as worst_spread, median(trimmed) as median_trimmed, max(trimmed) as worst_trimmed from ({inner}) where n >= 5"


SQL |= {
    "spread_report": WITH_LISTING + " union all ".join(_report(n, k) for n, k in measure.GROUPINGS.items()),
    "spread_groups": WITH_LISTING + _GROUPED.format(keys="category, model_key", known=""),
    "spread_worst": WITH_LISTING + "select * from (" + _GROUPED.format(keys="category, model_key", known="") + ") where n >= 5 order by spread desc, category, model_key nulls first limit 5",
    "ddr_bucket_spread": WITH_LISTING + f"select capacity_gb, count(*) as n, list_sort(list(price))[count(*) // 2 + 1] as median, case when count(*) >= 2 then max(price) / min(price) end as spread from listing where {COMPARABLE} and spec_generation = 'DDR5' and form_factor = 'laptop' group by 1",
    "coverage_report": WITH_LISTING + "select category, count(*) as n, avg((epid is not null)::int) as epid, avg((shipping_cost is not null)::int) as shipping, avg((model_key is not null)::int) as model_key, avg(is_auction::int) as auctions, avg(accepts_best_offer::int) as offers from listing group by rollup(category)",
    "thin_pools": WITH_LISTING + "select category, model_key, count(*) as n from listing group by 1, 2 having count(*) < 20",
    "seed_history": WITH_LISTING + "select listing_id, price, null::double as shipping_cost, first_seen_at as observed_at from listing",
}

# ---- raw pages and vectors


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """A search-page item for every order, as JSON text, and read back by the source's schema."""
    k = F.col("o_orderkey")
    option = lambda kind, cost: F.struct(F.lit(kind).alias("shippingCostType"), F.struct(cost.cast("string").alias("value")).alias("shippingCost"))
    ship = F.when(k % 4 == 1, F.array(option("CALCULATED", F.lit("5.5")), option("FIXED", F.lit("junk")))).when(k % 4 == 2, F.array(option("FIXED", k % 50), option("FIXED", F.lit(30)))).when(k % 4 == 3, F.array(option("CALCULATED", F.lit(3)), option("FIXED", F.lit(9))))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("item-"), k).alias("itemId"), F.lit("t").alias("title"), F.lit("u").alias("itemWebUrl"), F.struct((F.col("o_totalprice")).cast("string").alias("value")).alias("price"), ship.alias("shippingOptions"),
            F.struct(F.when(k % 3 > 0, "Town").alias("city"), F.lit("").alias("stateOrProvince"), F.when(k % 5 > 0, "DE").alias("country")).alias("itemLocation"), F.when(k % 2 == 0, F.array(F.lit("AUCTION"), F.lit("BEST_OFFER"))).alias("buyingOptions"),
            F.struct(F.when(k % 7 > 0, "i1").alias("imageUrl")).alias("image"), F.array(F.struct(F.lit("i2").alias("imageUrl")), F.struct(F.lit("").alias("imageUrl"))).alias("additionalImages"),
            F.when(k % 3 == 0, F.lit("2024-02-03T04:05:06.000Z")).when(k % 3 == 1, F.lit("soon")).alias("itemCreationDate"), F.array(F.struct(F.lit("Colour").alias("name"), F.lit("red").alias("value")), F.struct(F.lit("Colour").alias("name"), F.when(k % 2 == 0, "blue").otherwise("").alias("value"))).alias("localizedAspects"),
            F.when(k % 6 == 0, '[{"estimatedAvailabilityStatus":"OUT_OF_STOCK","estimatedSoldQuantity":4}]').when(k % 6 == 1, '{"estimatedAvailableQuantity":0,"estimatedSoldQuantity":2}').when(k % 6 == 2, "5").when(k % 6 == 3, '[{"estimatedAvailableQuantity":3,"estimatedSoldQuantity":1},{"estimatedSoldQuantity":7}]').alias("estimatedAvailabilities"),
            F.when(k % 11 == 0, F.lit("2024-06-01T00:00:00Z")).when(k % 11 == 1, F.lit("2024-12-01T00:00:00Z")).when(k % 11 == 2, F.lit("never")).alias("itemEndDate"),
        )
    )
    return table(spark, sf, "orders").select(k.alias("k"), F.from_json(body, normalize.BODY).alias("x")).select("k", "x.*")


def shipping_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    cost, estimated = normalize.cheapest_shipping(F.col("shippingOptions"))
    return _raw(spark, sf).select("k", cost.alias("cost"), estimated.alias("estimated"))


def has_ended(spark: SparkSession, sf: str) -> DataFrame:
    rows = _raw(spark, sf)
    return rows.select("k", normalize.has_ended(F.col("estimatedAvailabilities"), F.col("itemEndDate"), F.expr("timestamp '2024-07-01 00:00:00'")).alias("ended"), normalize.max_sold(F.col("estimatedAvailabilities")).alias("sold"))


def normalize_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.normalised(_raw(spark, sf), F.expr("timestamp '2024-07-01 00:00:00'"))
    return rows.select("source_id", "price", "currency", "shipping_cost", "shipping_estimated", "is_auction", "accepts_best_offer", "location", F.array_join("images", ",").alias("images"), F.to_timestamp_ntz(F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss")).alias("posted_at"), "is_gtc")


def enrich_merge(spark: SparkSession, sf: str) -> DataFrame:
    base = listing(spark, sf).select("listing_id", "source_id", "epid", "is_auction", "bid_count", F.col("item_end_date").cast("timestamp").alias("item_end_date"), F.lit(None).cast("map<string,string>").alias("aspects"), F.lit(None).cast("string").alias("category_id"), F.lit(1).alias("sold_quantity"), F.lit(None).cast("boolean").alias("is_gtc"))
    rows = normalize.enriched(base, _raw(spark, sf).filter("k % 3 <> 0"))
    return rows.select("listing_id", F.element_at("aspects", "Colour").alias("colour"), "sold_quantity", "is_gtc", F.date_format("item_end_date", "yyyy-MM-dd").alias("ends"))


def capture_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(F.element_at(F.array(F.lit(" Depop"), F.lit("facebook "), F.lit("ebay")), (k % 3 + 1).cast("int")).alias("source"), F.when(k % 5 > 0, F.concat(F.lit(" c"), k)).alias("source_id"), F.when(k % 7 > 0, "t").otherwise(" ").alias("title"), F.lit("u").alias("url"), F.when(k % 13 > 0, F.col("o_totalprice")).alias("price"))
    good, bad = normalize.captures(raw)
    return good.withColumn("reason", F.lit("good")).unionByName(bad).groupBy("source", "reason").agg(F.count("*").alias("n"))


def embed_pending(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf).select("listing_id", F.array(F.col("source_id")).alias("images"), F.when(F.col("listing_id") % 4 == 0, F.col("now_ts")).alias("embedded_at"))
    return inference.assert_some(inference.attempt_counters(inference.embed(inference.pending(rows, None), _toy_model)))


def _flaky() -> Callable[[list], list]:
    """A model that is loaded, gives nothing for names that end in 0, and fails on those that end in 7."""

    def model(batch: list) -> list:
        if any(x[0].endswith("7") for x in batch):
            raise ValueError("unreadable")
        return _toy_model(batch)

    return model


def _flaky_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("listing_id")
    rows = listing(spark, sf).select("listing_id", F.when(k % 9 > 0, F.array("source_id")).alias("images"), F.when(k % 4 == 0, F.col("now_ts") - F.expr("interval 1 day")).alias("embedded_at"), F.when(k % 4 == 0, F.array(F.lit(9.0), F.lit(9.0)).cast("array<float>")).alias("embedding"))
    return rows, inference.embed(inference.pending(rows, None), load=_flaky)


def embed_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Why attempts failed: one bad value costs its batch nothing."""
    return inference.reasons(_flaky_vectors(spark, sf)[1])


def embed_stamped(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt is stamped, and only those with a vector have one."""
    rows, vectors = _flaky_vectors(spark, sf)
    return inference.stamped(rows, vectors, market.now()).select("listing_id", "embedded_at", F.element_at("embedding", 1).cast("double").alias("first"))


def _toy_model(batch: list) -> list:
    """A stand-in for a real model: the length of the name; none for names that end in 0."""
    return [None if x[0].endswith("0") else [float(len(x[0])), 1.0] for x in batch]


_AVAIL = "case k % 6 when 0 then true when 1 then true else false end or k % 11 = 0"
SQL |= {
    "embed_failures": "select case when o_orderkey % 9 = 0 then 'no value' when o_orderkey % 10 = 7 then 'ValueError: unreadable' else 'no vector' end as reason, count(*) as n from orders where o_orderkey % 4 <> 0 and (o_orderkey % 9 = 0 or o_orderkey % 10 in (0, 7)) group by 1",
    "embed_stamped": "select o_orderkey as listing_id, case when o_orderkey % 4 = 0 then timestamp '2024-06-30' else timestamp '2024-07-01' end as embedded_at, case when o_orderkey % 4 = 0 then 9.0 when o_orderkey % 9 > 0 and o_orderkey % 10 not in (0, 7) then length('item-' || o_orderkey)::double end as first from orders",
    "shipping_cheapest": "select o_orderkey as k, case o_orderkey % 4 when 1 then 5.5 when 2 then least(o_orderkey % 50, 30)::double when 3 then 9.0 end as cost, o_orderkey % 4 = 1 as estimated from orders",
    "has_ended": f"select k, {_AVAIL} as ended, case k % 6 when 0 then 4 when 1 then 2 when 3 then 7 end as sold from (select o_orderkey as k from orders)",
    "normalize_page": """select concat('item-', k) as source_id, o_totalprice as price, 'USD' as currency, case k % 4 when 1 then 5.5 when 2 then least(k % 50, 30)::double when 3 then 9.0 end as shipping_cost, k % 4 = 1 as shipping_estimated, k % 2 = 0 as is_auction, k % 2 = 0 as accepts_best_offer,
  nullif(concat_ws(', ', case when k % 3 > 0 then 'Town' end, case when k % 5 > 0 then 'DE' end), '') as location, case when k % 7 > 0 then 'i1,i2' else 'i2' end as images, case when k % 3 = 0 then timestamp '2024-02-03 04:05:06' end as posted_at, null::boolean as is_gtc from (select *, o_orderkey as k from orders)""",
    "enrich_merge": WITH_LISTING + """, r as (select listing_id as k, * from listing), s as (select *, k % 3 <> 0 as here, case k % 11 when 0 then timestamp '2024-06-01' when 1 then timestamp '2024-12-01' end as body_end from r)
select k as listing_id, case when not here then null when k % 2 = 0 then 'blue' else 'red' end as colour, case when not here then 1 when k % 6 = 1 then 2 else 1 end as sold_quantity,
  case when not here then null when body_end is not null then false when not is_auction then true end as is_gtc, strftime(coalesce(item_end_date, case when here then body_end end), '%Y-%m-%d') as ends from s""",
    "capture_rows": """with r as (select o_orderkey as k, o_totalprice as p from orders), s as (select case k % 3 when 0 then 'depop' when 1 then 'facebook' else 'ebay' end as source, case when k % 3 = 2 then 'source' when k % 13 = 0 or p <= 0 then 'price' when k % 5 = 0 then 'source_id' when k % 7 = 0 then 'title' else 'good' end as reason from r)
select source, reason, count(*) as n from s group by 1, 2""",
    "kit_rule_change": titles._BANK + """, c as (select category, title like '%2x16GB%' or title like 'Kit 32GB x 2%' as changed from x)
select category, count(*) filter (where changed) as changed, count(*) as n, count(*) filter (where changed) / count(*) as rate from c group by 1 having count(*) filter (where changed) > 0""",
    "embed_pending": "select count(*) as attempted, count(*) filter (where o_orderkey % 10 <> 0) as embedded, count(*) filter (where o_orderkey % 10 = 0) as failed from orders where o_orderkey % 4 <> 0",
}

QUERIES = {name: globals()[name] for name in SQL}
