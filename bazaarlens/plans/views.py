"""Queries of what is shown and asked for: valuations on demand, deals and matches with what they rest on, charts, saved tables, rule reports; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import extract, matching, measure, normalize, serving, valuation
from bazaarlens.plans import market, reports
from bazaarlens.plans.fixtures import WITH_LISTING, kept, listing, scratch, table
from bazaarlens.sources import tables

_NOW = "timestamp '2024-07-01 00:00:00'"


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("listing_id")
    return kept(listing(spark, sf).withColumns({"title": F.concat(F.lit("Thing "), k), "url": F.concat(F.lit("https://x/"), k)}))


# ---- valuation and matches


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _shown(spark, sf)
    ids = table(spark, sf, "customer").select((F.col("c_custkey") * 50).alias("listing_id"))
    return rows, valuation.value_listings(rows, ids, kept)


def single_valuation(spark: SparkSession, sf: str) -> DataFrame:
    """Listings valued on demand, some of them sold, of other sources, or not there at all."""
    return _asked(spark, sf)[1].select("listing_id", "asking", "n", "estimate", "spread", "confidence", "score", "signals.*", F.size("caveats").alias("n_caveats")).drop("comp_count")


def deal_read(spark: SparkSession, sf: str) -> DataFrame:
    """The same with everything they rest on, a row for each comparable listing; one for those without."""
    rows, valued = _asked(spark, sf)
    out = serving.deal_read(valued, rows).select("*", F.explode_outer("comps").alias("c"))
    return out.select("listing_id", "title", "url", "source", "asking_price", "total_cost", "estimated_value", "deal_score", "confidence", "comp_count", *[F.col(f"c.{c}").alias(f"comp_{c}") for c in ("rank", "listing_id", "title", "price", "url", "sale_confidence", "price_confidence")])


def match_read(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of other sources' listings with each candidate's facts; one row for those that have none."""
    rows = _shown(spark, sf)
    asked = rows.filter("source <> 'ebay' and listing_id % 50 = 0")
    out = serving.match_read(*matching.priced(asked, rows, keep=kept), rows)
    facts = [F.col(f"candidate.{c}").alias(f"candidate_{c}") for c in ("place", "listing_id", "title", "price", "total_cost", "url", "similarity", "epid")]
    return out.select("query_id", "title", "total_cost", "analysed", "matched_by", "comps_from", "note", *facts)


_VALUED = market._VALUED.replace(market._CANDIDATES, ", cand as materialized (select * from listing where listing_id in (select c_custkey * 50 from customer))\n")
_CHOSEN = WITH_LISTING + market.SQL["match_prices"].removeprefix(WITH_LISTING).split("\nselect a.listing_id as query_id")[0]
SQL = {
    "single_valuation": WITH_LISTING + _VALUED + """select v.listing_id, asking, v.n, estimate, v.spread, confidence, case when estimate > 0 then (estimate - asking) / estimate end as score,
  case when v.n < 3 then true end as below_minimum, case when v.n in (3, 4) then true end as few_comps, case when v.spread > 2 then round(v.spread, 2) end as wide_spread, case when v.n >= 3 then round(a.sales[len(a.sales) // 2 + 1], 3) end as median_sale_confidence,
  case when v.n >= 3 then round(a.weights[len(a.weights) // 2 + 1], 3) end as median_price_confidence, round(v.spread, 2) as spread_ratio, case when v.n >= 3 and l.shipping_cost is null then true end as asking_price_excludes_unknown_shipping,
  1 + (case when v.n < 5 then 1 else 0 end) + (case when v.n >= 3 and v.spread > 2 then 1 else 0 end) + (case when v.n >= 3 and v.offers >= greatest(1, v.n // 3) then 1 else 0 end) as n_caveats
  from valued v join listing l using (listing_id) left join agg a on a.query_id = v.listing_id""",
    "deal_read": WITH_LISTING + _VALUED + """select v.listing_id, 'Thing ' || v.listing_id as title, 'https://x/' || v.listing_id as url, l.source, l.price as asking_price, l.price + l.shipping_cost as total_cost, estimate as estimated_value, case when estimate > 0 then (estimate - asking) / estimate end as deal_score, confidence, v.n as comp_count,
  c.rank as comp_rank, c.listing_id as comp_listing_id, 'Thing ' || c.listing_id as comp_title, c.comp_price, 'https://x/' || c.listing_id as comp_url, o.sale_confidence as comp_sale_confidence, o.price_confidence as comp_price_confidence
  from valued v join listing l on l.listing_id = v.listing_id left join comps c on c.query_id = v.listing_id left join listing o on o.listing_id = c.listing_id""",
    "match_read": _CHOSEN + """, placed as (select c.query_id, c.listing_id, c.comps_from, coalesce(m.similarity, t.confidence) as similarity from chosen c left join matched m on c.comps_from = 'candidates' and m.query_id = c.query_id and m.listing_id = c.listing_id left join top t on t.query_id = c.query_id),
numbered as (select *, row_number() over (partition by query_id order by similarity desc, listing_id) - 1 as place from placed)
select a.listing_id as query_id, 'Thing ' || a.listing_id as title, a.price + a.shipping_cost as total_cost, n.place is not null as analysed, t.matched_by, x.comps_from, concat_ws('+', case when x.spread > 3 then 'wide_spread' end, case when x.n is null then 'not_analysed' else 'asking_prices' end) as note,
  n.place as candidate_place, n.listing_id as candidate_listing_id, 'Thing ' || n.listing_id as candidate_title, l.price as candidate_price, l.price + l.shipping_cost as candidate_total_cost, 'https://x/' || n.listing_id as candidate_url, n.similarity as candidate_similarity, l.epid as candidate_epid
  from ask a left join top t on t.query_id = a.listing_id left join ctx x on x.query_id = a.listing_id left join numbered n on n.query_id = a.listing_id left join listing l on l.listing_id = n.listing_id""",
}

# ---- charts and saved tables


def price_series_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered prices as the deal card and the watchlist chart them: all of a listing's, and its newest 200."""
    rows = reports._observations(spark, sf)
    both = [serving.series_summary(rows, newest).withColumn("chart", F.lit(name)) for name, newest in (("deal", None), ("watchlist", serving.HISTORY))]
    return both[0].unionByName(both[1])


def saved_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Saved searches written without some of the columns, and read as a source."""
    at, k = scratch(spark), F.col("c_custkey")
    table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("keyword"), F.when(k % 7 < 2, F.lit(False)).when(k % 7 < 4, F.lit(True)).alias("enabled"), F.when(k % 3 == 0, F.expr(_NOW.replace("timestamp ", "timestamp_ntz "))).alias("last_run_at")).write.parquet(at)
    return tables.saved_searches(spark, at).select("id", "keyword", "location", "enabled", "last_run_at", "last_result_total")


def watched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A watchlist to which each sighting adds its listing again: the first time counts."""
    at = scratch(spark)
    e = table(spark, sf, "events")
    e.select(F.col("event_id").alias("id"), F.col("user_id").alias("listing_id"), F.col("ts").cast("timestamp_ntz").alias("added_at"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("n"), F.col("event_id"))).alias("note"), F.col("value").cast("double").alias("price_when_added")).write.parquet(at)
    return tables.watched(spark, at)


SQL |= {
    "price_series_totals": f"""with c as (select listing_id, coalesce(price + shipping_cost, price) as cost, (observed_at, tie) as moment, row_number() over (partition by listing_id order by observed_at desc, tie desc) as r from {reports._OBS}),
b as (select 'deal' as chart, * from c union all select 'watchlist', * from c where r <= 200)
select chart, listing_id, arg_min(cost, moment) as first_cost, arg_max(cost, moment) as last_cost, min(cost) as lowest, max(cost) as highest, count(*) as n from b group by 1, 2""",
    "saved_search_rows": f"select c_custkey as id, c_name as keyword, null::varchar as location, c_custkey % 7 >= 2 as enabled, case when c_custkey % 3 = 0 then {_NOW} end as last_run_at, null::int as last_result_total from customer",
    "watched_rows": "select event_id as id, user_id as listing_id, ts as added_at, case when event_id % 3 > 0 then 'n' || event_id end as note, value as price_when_added from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1",
}

# ---- rule reports


def _kits(spark: SparkSession, sf: str) -> DataFrame:
    """Memory titles by row: half of them kits, which state a capacity only to the kit rule, some without one, some of whole machines."""
    k = F.col("listing_id")
    size = F.pow(F.lit(2), k % 4 + 2).cast("int")
    title = F.when(k % 11 == 0, "Memory kit").when(k % 2 == 0, F.concat(F.lit("Memory "), k % 7 + 2, F.lit("x"), size, F.lit("GB"))).otherwise(F.concat(F.lit("Memory "), size, F.lit("GB")))
    rows = listing(spark, sf).select("listing_id", title.alias("title"), F.when(k % 5 == 0, "PC Laptops & Netbooks").otherwise("Memory (RAM)").alias("category"), "price", "spec_generation", F.when(k % 3 == 1, "laptop").otherwise("desktop").alias("form_factor"))
    return rows.withColumns({"before": F.array_max(extract.capacities(F.col("title"))), "after": extract.capacity(F.col("title"), F.col("category")), "anywhere": extract.capacity(F.col("title"), F.lit(""))})


def kit_rule_rate(spark: SparkSession, sf: str) -> DataFrame:
    return measure.rule_rate(_kits(spark, sf), "before", "after")


def kit_rule_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty changed titles by seed, to be read."""
    rows = _kits(spark, sf).filter(~F.col("before").eqNullSafe(F.col("after")) & F.col("after").isNotNull())
    return measure.seeded_sample(rows, "listing_id", 20).select("listing_id", "title", "before", "after")


def desktop_bucket_report(spark: SparkSession, sf: str) -> DataFrame:
    """DDR5 desktop memory by capacity, as read before the kit rule and after it."""
    rows = _kits(spark, sf).filter("spec_generation = 'DDR5' and form_factor = 'desktop'").select("price", F.explode(F.array(*[F.struct(F.lit(label).alias("rule"), F.col(c).alias("bucket")) for label, c in (("before", "before"), ("after", "anywhere"))])).alias("x"))
    return measure.bucket_report(rows.select("price", "x.*"), "rule", "bucket")


def coverage_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf).withColumn("category_id", F.when(F.col("listing_id") % 6 > 0, F.col("listing_id").cast("string")))
    return measure.coverage(rows, more=("category_id",))


def thin_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories whose names another locale has given have too few listings to find comparable ones in."""
    rows = listing(spark, sf).withColumn("category", F.when(F.col("listing_id") % 103 == 3, F.concat("category", F.lit(" (DE)"))).otherwise(F.col("category")))
    return measure.thin_pools(rows, ["category"])


def normalize_seller(spark: SparkSession, sf: str) -> DataFrame:
    """An item's first category, and its seller's figures where they are numbers."""
    k = F.col("o_orderkey")
    category = lambda n: F.struct(F.concat(F.lit(n), k % 9).alias("categoryId"), F.concat(F.lit("C"), F.lit(n), k % 9).alias("categoryName"))
    body = F.struct(F.concat(F.lit("item-"), k).alias("itemId"), F.when(k % 4 == 0, F.array(category("1"), category("2"))).when(k % 4 == 1, F.array(category("3"))).when(k % 4 == 2, F.array().cast("array<struct<categoryId: string, categoryName: string>>")).alias("categories"), F.when(k % 5 > 0, F.struct((k % 77).cast("int").alias("feedbackScore"), F.when(k % 3 == 0, "99.5").when(k % 3 == 1, "most").alias("feedbackPercentage"))).alias("seller"), F.when(k % 7 > 0, F.struct(F.when(k % 2 == 0, "12.5").otherwise("free").alias("value"), F.when(k % 3 > 0, "EUR").alias("currency"))).alias("price"))
    rows = table(spark, sf, "orders").select(F.from_json(F.to_json(body), normalize.BODY).alias("x")).select("x.*")
    return normalize.normalised(rows, F.expr(_NOW)).select("source_id", "category", "category_id", "seller_feedback_score", "seller_feedback_percent", "price", "currency")


_KITS = WITH_LISTING + """, t as (select listing_id, price, spec_generation, case when listing_id % 3 = 1 then 'laptop' else 'desktop' end as form_factor, listing_id % 5 = 0 as machine, case when listing_id % 11 = 0 then null else (2 ** (listing_id % 4 + 2))::int end as size, case when listing_id % 11 > 0 and listing_id % 2 = 0 then listing_id % 7 + 2 end as m from listing),
k as (select *, case when m is null then size end as before, case when m is null then size when not machine then size * m end as after, size * coalesce(m, 1) as anywhere from t)
"""
_BUCKETS = """, r as (select 'before' as rule, before as bucket, price from k where spec_generation = 'DDR5' and form_factor = 'desktop' union all select 'after', anywhere, price from k where spec_generation = 'DDR5' and form_factor = 'desktop'),
g as (select rule, bucket, case when count(*) >= 2 then max(price) / min(price) end as spread, case when count(*) >= 5 then max(price) filter (where i = round_even(0.9 * (n - 1), 0)) / max(price) filter (where i = round_even(0.1 * (n - 1), 0)) end as trimmed
  from (select *, row_number() over w - 1 as i, count(*) over (partition by rule, bucket) as n from r where bucket is not null window w as (partition by rule, bucket order by price)) group by 1, 2),
o as (select rule, max(price) / min(price) as spread, max(price) filter (where i = round_even(0.9 * (n - 1), 0)) / max(price) filter (where i = round_even(0.1 * (n - 1), 0)) as trimmed from (select *, row_number() over w - 1 as i, count(*) over (partition by rule) as n from r window w as (partition by rule order by price)) group by 1),
l as (select rule, list_sort(list(spread) filter (where spread is not null)) as ss, list_sort(list(trimmed) filter (where trimmed is not null)) as ts from g group by 1),
s as (select rule, count(distinct bucket) as buckets, count(*) filter (where bucket is null) as unstated from r group by 1)
select s.*, ss[len(ss) // 2 + 1] as median_spread, ss[-1] as worst_spread, ts[len(ts) // 2 + 1] as median_trimmed, ts[-1] as worst_trimmed, o.spread as overall_spread, o.trimmed as overall_trimmed from s join l using (rule) join o using (rule)"""
SQL |= {
    "kit_rule_rate": _KITS + "select count(*) filter (where before is distinct from after and after is not null) as changed, count(*) as n, count(*) filter (where before is distinct from after and after is not null) / count(*) as rate from k",
    "kit_rule_sample": _KITS + "select listing_id, 'Memory ' || m || 'x' || size || 'GB' as title, before, after from k where before is distinct from after and after is not null order by md5('0:' || listing_id), listing_id limit 20",
    "desktop_bucket_report": _KITS + _BUCKETS,
    "coverage_with_ids": WITH_LISTING + "select category, count(*) as n, avg((epid is not null)::int) as epid, avg((shipping_cost is not null)::int) as shipping, avg((model_key is not null)::int) as model_key, avg((listing_id % 6 > 0)::int) as category_id, avg(is_auction::int) as auctions, avg(accepts_best_offer::int) as offers from listing group by rollup(category)",
    "thin_categories": WITH_LISTING + "select category || case when listing_id % 103 = 3 then ' (DE)' else '' end as category, count(*) as n from listing group by 1 having count(*) < 20",
    "normalize_seller": """with o as (select o_orderkey as k from orders) select 'item-' || k as source_id, case k % 4 when 0 then 'C1' || k % 9 when 1 then 'C3' || k % 9 end as category, case k % 4 when 0 then '1' || k % 9 when 1 then '3' || k % 9 end as category_id,
  case when k % 5 > 0 then (k % 77)::int end as seller_feedback_score, case when k % 5 > 0 and k % 3 = 0 then 99.5::double end as seller_feedback_percent, case when k % 7 > 0 and k % 2 = 0 then 12.5::double end as price, case when k % 7 > 0 and k % 3 > 0 then 'EUR' else 'USD' end as currency from o""",
}
QUERIES = {name: globals()[name] for name in SQL}
