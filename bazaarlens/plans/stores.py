"""Queries that write and read the engine's tables, and those over captured rows and single title signals; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import extract, merge, normalize
from bazaarlens.plans.fixtures import WITH_LISTING, listing, scratch, table
from bazaarlens.plans.market import now
from bazaarlens.sources import tables

_NOW = "timestamp '2024-07-01 00:00:00'"


def search_page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Search pages, one a customer with an item for each order, written as JSON and read as a source."""
    k = F.col("o_orderkey")
    item = F.struct(F.concat(F.lit("item-"), k).alias("itemId"), F.concat(F.lit("Thing "), k).alias("title"), F.struct(F.col("o_totalprice").cast("string").alias("value")).alias("price"))
    pages = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("search_id")).agg(F.array_sort(F.collect_list(item)).alias("itemSummaries"), (F.count("*") + F.max(k) % 2).alias("total"))
    at = scratch(spark)
    pages.write.json(at)
    rows = tables.search_pages(spark, at)
    return rows.select("search_id", "total", "kept", "truncated", "position", F.col("itemId").alias("item_id"), "title", F.col("price.value").cast("double").alias("price"))


def item_body_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Item bodies of most listings, written as JSON and read as a source; listings without a body are absent."""
    k = F.col("o_orderkey")
    at = scratch(spark)
    table(spark, sf, "orders").filter(k % 5 > 0).select(F.concat(F.lit("item-"), k).alias("itemId"), F.when(k % 3 == 0, F.lit("2024-06-01T00:00:00Z")).alias("itemEndDate"), (k % 4).alias("bidCount")).write.json(at)
    bodies = tables.item_bodies(spark, at).select(F.col("itemId").alias("source_id"), F.lit(True).alias("found"), F.col("bidCount").alias("bids"), normalize.has_ended(F.col("estimatedAvailabilities"), F.col("itemEndDate"), now()).alias("over"))
    rows = listing(spark, sf).select("listing_id", "source_id").join(bodies, "source_id", "left")
    return rows.select("listing_id", F.col("found").isNull().alias("absent"), "bids", (F.col("found").isNull() | F.col("over")).alias("ended"))


def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a snapshot; readers get the newer one."""
    at = scratch(spark)
    rows = listing(spark, sf).select("listing_id", "source", "price", "status")
    tables.write_snapshot(rows, at, 1)
    tables.write_snapshot(rows.withColumn("status", F.when(F.col("listing_id") % 6 == 0, "stale").otherwise(F.col("status"))), at, 2, ("source",))
    return tables.read_snapshot(spark, at).select("listing_id", "source", "price", "status")


def observation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Opening observations and those of price changes, appended to one log and read back."""
    at = scratch(spark)
    rows = listing(spark, sf).select("listing_id", "price", "shipping_cost", "first_seen_at")
    tables.append_observations(tables.seed_history(rows), at)
    tables.append_observations(rows.filter("listing_id % 4 = 1").select("listing_id", (F.col("price") + 5).alias("price"), "shipping_cost", now().alias("observed_at")), at)
    return spark.read.parquet(at).groupBy("listing_id").agg(F.count("*").alias("n"), F.min_by("price", "observed_at").alias("first_price"), F.max_by("price", "observed_at").alias("last_price"), F.max_by("shipping_cost", "observed_at").alias("last_shipping"))


def deals_within_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Deals scanned an hour and three hours ago: within two hours, only the former are served."""
    at = scratch(spark)
    rows = listing(spark, sf).select("listing_id", "price")
    served = None
    for hours in (1, 3):
        tables.write_deals(rows.filter(F.col("listing_id") % 2 == hours // 2), f"{at}/{hours}", now() - F.expr(f"interval {hours} hours"))
        found = tables.read_deals(spark, f"{at}/{hours}", spark.read.parquet(f"{at}/{hours}").schema, now())
        served = found if served is None else served.unionByName(found)
    return served.select("listing_id", "price", "scanned_at")


def column_reset(spark: SparkSession, sf: str) -> DataFrame:
    """A column emptied before it is worked out anew: all rows are pending again."""
    rows = tables.reset_column(listing(spark, sf), "model_key")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count("model_key").alias("known"))


def captured_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Captured rows as listings: titles that differ by row are read at once, with what the page says beside them."""
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.when(k % 2 == 0, "depop").otherwise("facebook").alias("source"), F.concat(F.lit("c"), k).alias("source_id"), F.concat(F.lit("Player "), F.pow(F.lit(2), k % 5 + 4).cast("int"), F.lit("GB lot of "), k % 7 + 2).alias("title"), F.lit("u").alias("url"),
        F.col("o_totalprice").cast("double").alias("price"), F.when(k % 3 > 0, "EUR").alias("currency"), F.when(k % 4 > 0, (k % 4).cast("double")).alias("shipping_cost"), F.when(k % 5 > 0, F.array(F.lit("i"))).alias("images"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("condition"),
        F.when(k % 3 == 0, "Lumo").alias("brand"), F.when(k % 3 == 1, "").alias("size"), F.when(k % 6 == 0, "ann").alias("seller"),
    )
    rows = normalize.captured_listing(normalize.captures(raw)[0], now())
    return rows.select("source", "source_id", "currency", "shipping_cost", "is_auction", "is_gtc", "category", F.size("images").alias("n_images"), F.element_at("aspects", "Brand").alias("brand"), F.element_at("aspects", "Seller").alias("seller"), F.coalesce(F.size("aspects"), F.lit(0)).alias("n_aspects"), "capacity_gb", "lot_size", "completeness", "has_defect", "status")


def search_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Searches that failed are set aside with a reason; the pages of all others go on."""
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("search_id"), F.when(F.col("c_custkey") % 17 > 0, F.col("c_acctbal") < 0).alias("failed"), F.when(F.col("c_custkey") % 3 > 0, "timeout").alias("reason"))
    good, bad = merge.quarantined(runs)
    return good.select("search_id", F.lit(None).cast("string").alias("reason"), F.lit(False).alias("set_aside")).unionByName(bad.withColumn("set_aside", F.lit(True)))


def title_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of memory titles whose kit differs by row, some of them sealed, some with a note to read."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Memory "), k % 7 + 2, F.lit("x"), F.pow(F.lit(2), k % 4 + 2).cast("int"), F.lit("GB DDR4"), F.when(k % 3 == 0, " factory sealed").otherwise(""))
    rows = table(spark, sf, "orders").select(k.alias("listing_id"), title.alias("title"), F.lit("Memory (RAM)").alias("category"))
    out = extract.extracted(rows, condition=None)
    return out.select("listing_id", F.element_at("variant_signals", "kit").alias("kit"), F.element_at("variant_signals", "sealed_or_new").alias("sealed"), F.size("variant_signals").alias("n"), "capacity_gb")


def titles_left_to_read(spark: SparkSession, sf: str) -> DataFrame:
    """Only titles that were never read are read; an empty map means read, and nothing found."""
    k = F.col("listing_id")
    rows = listing(spark, sf).select("listing_id", "category", F.when(k % 3 == 1, F.create_map().cast("map<string,string>")).when(k % 3 == 2, F.create_map(F.lit("kit"), F.lit("2x16"))).alias("variant_signals"))
    return extract.only_new(rows).select("listing_id", "category")


def used_conditions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"), (F.col("o_orderkey") % 80 * 100).cast("string").alias("condition_id"))
    return normalize.used_only(rows)


def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses with a size part before a known file type get a larger one; others stay."""
    k = F.col("o_orderkey")
    ending = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".gif", ".jpg?x=1"))), (k % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(k.alias("listing_id"), normalize.larger_image(F.concat(F.lit("https://x/s-l"), k % 900 + 1, ending)).alias("url"))


SQL = {
    "search_page_rows": """with i as (select o_custkey as search_id, 'item-' || o_orderkey as item_id, 'Thing ' || o_orderkey as title, o_totalprice as price, row_number() over (partition by o_custkey order by 'item-' || o_orderkey) - 1 as position, count(*) over (partition by o_custkey) as n, max(o_orderkey) over (partition by o_custkey) as top from orders)
select search_id, n + top % 2 as total, least(n, 200) as kept, n + top % 2 > least(n, 200) as truncated, position, item_id, title, price::double as price from i where position < 200""",
    "item_body_rows": WITH_LISTING + "select listing_id, listing_id % 5 = 0 as absent, case when listing_id % 5 > 0 then listing_id % 4 end as bids, listing_id % 5 = 0 or listing_id % 3 = 0 as ended from listing",
    "snapshot_round_trip": WITH_LISTING + "select listing_id, source, price, case when listing_id % 6 = 0 then 'stale' else status end as status from listing",
    "observation_log": WITH_LISTING + "select listing_id, case when listing_id % 4 = 1 then 2 else 1 end as n, price as first_price, case when listing_id % 4 = 1 then price + 5 else price end as last_price, case when listing_id % 4 = 1 then shipping_cost end as last_shipping from listing",
    "deals_within_ttl": WITH_LISTING + f"select listing_id, price, {_NOW} - interval 1 hour as scanned_at from listing where listing_id % 2 = 0",
    "column_reset": WITH_LISTING + "select category, count(*) as n, 0 as known from listing group by 1",
    "captured_titles": """select case when o_orderkey % 2 = 0 then 'depop' else 'facebook' end as source, 'c' || o_orderkey as source_id, case when o_orderkey % 3 > 0 then 'EUR' else 'USD' end as currency, case when o_orderkey % 4 > 0 then (o_orderkey % 4)::double end as shipping_cost, false as is_auction, false as is_gtc, null as category,
  case when o_orderkey % 5 > 0 then 1 else 0 end as n_images, case when o_orderkey % 3 = 0 then 'Lumo' end as brand, case when o_orderkey % 6 = 0 then 'ann' end as seller, (o_orderkey % 3 = 0)::int + (o_orderkey % 6 = 0)::int as n_aspects,
  (2 ** (o_orderkey % 5 + 4))::int as capacity_gb, o_orderkey % 7 + 2 as lot_size, null as completeness, false as has_defect, 'active' as status from orders where o_totalprice > 0""",
    "search_quarantine": "select c_custkey as search_id, case when c_custkey % 17 > 0 and c_acctbal >= 0 then null when c_custkey % 3 > 0 then 'timeout' else 'unknown' end as reason, not (c_custkey % 17 > 0 and c_acctbal >= 0) as set_aside from customer",
    "title_signals": """with t as (select o_orderkey as k, o_orderkey % 7 + 2 as m, (2 ** (o_orderkey % 4 + 2))::int as size from orders)
select k as listing_id, m || 'x' || m * size as kit, case when k % 3 = 0 then 'true' end as sealed, 1 + (k % 3 = 0)::int as n, m * size as capacity_gb from t""",
    "titles_left_to_read": WITH_LISTING + "select listing_id, category from listing where listing_id % 3 = 0",
    "used_conditions": "select o_orderkey as listing_id, (o_orderkey % 80 * 100)::varchar as condition_id from orders where o_orderkey % 80 * 100 in (2000, 2500, 3000, 4000, 5000, 6000, 7000)",
    "image_sizes": "select o_orderkey as listing_id, 'https://x/s-l' || case when o_orderkey % 4 < 2 then 1600 else o_orderkey % 900 + 1 end || (case o_orderkey % 4 when 0 then '.jpg' when 1 then '.PNG' when 2 then '.gif' else '.jpg?x=1' end) as url from orders",
}
QUERIES = {name: globals()[name] for name in SQL}
