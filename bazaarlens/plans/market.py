"""Queries over listings: neighbours, valuation, matching, lifecycle, merging; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions import stats
from bazaarlens.operators import knn, lifecycle, matching, merge, normalize, valuation
from bazaarlens.plans.fixtures import COMPARABLE, WITH_LISTING, kept, listing, table

_NOW = "timestamp '2024-07-01 00:00:00'"


def now():
    """The time of all fixture queries."""
    return F.expr("timestamp_ntz '2024-07-01 00:00:00'")


# ---- neighbours and valuation


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors with the same label, for every vector whose id is divisible by 50."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("listing_id"), "embedding", F.col("label").alias("category"))
    return knn.knn(v.filter("listing_id % 50 = 0"), v, 10, ("category",), (), keep=kept)


def knn_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(listing(spark, sf))
    pool = knn.comparable(rows).filter("source = 'ebay'")
    return knn.knn(rows.filter("listing_id % 50 = 0"), pool, 10, keep=kept)


def knn_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of stored listings without spec filters, whatever their category."""
    return _stored(spark, sf)[0]


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = kept(listing(spark, sf))
    return knn.knn_with_pairs(rows.filter("listing_id % 50 = 0"), knn.comparable(rows).filter("source = 'ebay'"), kept, 10, (), ())


def knn_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Of the pairs of chunks of ``knn_stored``: how many there are, how many were compared, and which share was skipped."""
    _, pairs = _stored(spark, sf)
    return pairs.agg(F.count("*").alias("pairs"), F.count_if("compared").alias("compared"), (1 - F.count_if("compared") / F.count("*")).alias("skipped_share"))


def deal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.candidates(listing(spark, sf)).select("listing_id", "category", "model_key", "epid")


def sold_comps(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(listing(spark, sf))
    return valuation.sold_comps(valuation.candidates(rows), rows, keep=kept).select("query_id", "listing_id", "rank", "comp_price", "substituted", "weight")


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(listing(spark, sf))  # read for the keys, the candidates, the pool and the facts
    return valuation.value(valuation.sold_lists(valuation.candidates(rows), rows, keep=kept))


def valuations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _valued(spark, sf)
    return rows.select("listing_id", "category", "asking", "n", "estimate", "spread", "confidence", "score", F.size("caveats").alias("n_caveats"))


def deal_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = valuation.find_deals(_valued(spark, sf))
    return rows.select("listing_id", "category", "asking", "n", "estimate", "confidence", "score", F.transform("comps", lambda x: x["listing_id"]).alias("comp_ids"))


def valuation_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The confidence of each category and model's sold comparable listings as one set."""
    price, _ = valuation.comp_price()
    rows = knn.comparable(listing(spark, sf)).filter("status = 'likely_sold' and model_key is not null")
    by = stats.upper_medians(rows.withColumn("comp", price), ["category", "model_key"], ["comp", "sale_confidence", "price_confidence"])
    spread, (sale, weight) = F.col("comp_hi") / F.col("comp_lo"), (F.col(f"{x}_confidence_median") for x in ("sale", "price"))
    return by.select("category", "model_key", "n", valuation.confidence(F.col("n"), spread, sale, weight).alias("confidence"))


def weighted_median_by_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf).filter("status = 'likely_sold'").withColumn("weight", F.coalesce("price_confidence", F.lit(1.0)))
    return stats.weighted_median(rows, ["category", "model_key"], "price", "weight")


def scannable_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    flag = valuation.candidates(rows).select("listing_id", F.lit(1).alias("scannable"))
    active = rows.filter("status = 'active'").select("listing_id", "category").join(flag, "listing_id", "left")
    return active.groupBy("category").agg(F.count("*").alias("n_active"), F.count("scannable").alias("n_scannable"), (F.count("scannable") / F.count("*")).alias("share"))


_POOL = f", pool as materialized (select * from listing where {COMPARABLE} and source = 'ebay' and embedding is not null)\n"
_SIM = "floor(list_cosine_similarity(q.embedding::double[], c.embedding::double[]) * 1e9 + 0.5) / 1e9"
_TOLERANT = " and ".join(f"(q.{t} is null or c.{t} is null or q.{t} = c.{t})" for t in knn.TOLERANT)
_STRICT = "(q.category is null or q.category = c.category) and (q.model_key is null or q.model_key = c.model_key)"


def _near(queries: str, pool: str, on: str, k: int) -> str:
    return f"""select query_id, listing_id, similarity, rank from (
  select *, row_number() over (partition by query_id order by similarity desc, listing_id) as rank from (
    select q.listing_id as query_id, c.listing_id, {_SIM} as similarity from {queries} q join {pool} c on q.listing_id <> c.listing_id and q.embedding is not null and {on})) where rank <= {k}"""


_CANDIDATES = f""", sold as (select * from listing where status = 'likely_sold'),
cand as materialized (select * from listing where source = 'ebay' and status = 'active' and {COMPARABLE} and not is_auction and embedding is not null
  and (model_key in (select model_key from sold where model_key is not null) or epid in (select epid from sold where epid is not null)
    or not exists (select 1 from sold where model_key is not null or epid is not null)))
"""
_COMPS = (
    _CANDIDATES + _POOL + ", near as materialized (" + _near("cand", "pool", _STRICT + " and " + _TOLERANT, 60) + """),
comps as materialized (select n.query_id, n.listing_id, n.rank, coalesce(l.price + l.shipping_cost, l.price) as comp_price, l.shipping_cost is null as substituted,
    case when coalesce(l.price_confidence, 0) = 0 then 1.0 else l.price_confidence end as weight, l.sale_confidence, l.accepts_best_offer
  from near n join listing l on l.listing_id = n.listing_id where l.status = 'likely_sold' and (l.sale_confidence is null or l.sale_confidence >= 0.3))
"""
)
_VALUED = (
    _COMPS + """, runs as (select *, sum(weight) over (partition by query_id order by comp_price, weight, listing_id rows unbounded preceding) as run, sum(weight) over (partition by query_id) as total from comps),
est as (select query_id, min(comp_price) filter (where run >= total / 2 - 1e-9) as estimate from runs group by query_id),
agg as (select query_id, count(*) as n, max(comp_price) / min(comp_price) as spread, count(*) filter (where accepts_best_offer) as offers,
    list_sort(list(sale_confidence) filter (where sale_confidence is not null)) as sales, list_sort(list(weight)) as weights, list(listing_id order by rank) as comp_ids from comps group by query_id),
valued as (select c.listing_id, c.category, coalesce(c.price + c.shipping_cost, c.price) as asking, coalesce(a.n, 0) as n,
    case when a.n >= 3 then e.estimate end as estimate, case when a.n >= 3 then a.spread end as spread,
    case when a.n >= 3 then greatest(0.0, least(1.0, (case when a.n < 5 then 0.5 + 0.1 * a.n else 1.0 end) * (case when a.spread > 2 then 0.6 else 1.0 end)
      * coalesce(a.sales[len(a.sales) // 2 + 1], 1.0) * a.weights[len(a.weights) // 2 + 1])) else 0.0 end as confidence, a.offers, a.comp_ids
  from cand c left join agg a on a.query_id = c.listing_id left join est e on e.query_id = c.listing_id)
"""
)

SQL = {
    "knn_topk": "with v as (select vec_id as listing_id, embedding, label as category from embeddings)\n" + _near("(select * from v where listing_id % 50 = 0)", "v", "q.category = c.category", 10),
    "knn_filters": WITH_LISTING + _POOL + _near("(select * from listing where listing_id % 50 = 0)", "pool", _STRICT + " and " + _TOLERANT, 10),
    "knn_stored": WITH_LISTING + _POOL + _near("(select * from listing where listing_id % 50 = 0)", "pool", "true", 10),
    "deal_candidates": WITH_LISTING + _CANDIDATES + "select listing_id, category, model_key, epid from cand",
    "sold_comps": WITH_LISTING + _COMPS + "select query_id, listing_id, rank, comp_price, substituted, weight from comps",
    "valuations": WITH_LISTING + _VALUED + """select listing_id, category, asking, n, estimate, spread, confidence, case when estimate > 0 then (estimate - asking) / estimate end as score,
  1 + (case when n < 5 then 1 else 0 end) + (case when n >= 3 and spread > 2 then 1 else 0 end) + (case when n >= 3 and offers >= greatest(1, n // 3) then 1 else 0 end) as n_caveats from valued""",
    "deal_feed": WITH_LISTING + _VALUED + """select listing_id, category, asking, n, estimate, confidence, (estimate - asking) / estimate as score, comp_ids from valued
where estimate > 0 and (estimate - asking) / estimate >= 0.2 and confidence >= 0.3 order by score desc, listing_id limit 50""",
    "valuation_confidence": WITH_LISTING + f""", g as (select category, model_key, count(*) as n, max(coalesce(price + shipping_cost, price)) / min(coalesce(price + shipping_cost, price)) as spread,
  list_sort(list(sale_confidence) filter (where sale_confidence is not null)) as sales, list_sort(list(price_confidence)) as weights from listing where {COMPARABLE} and status = 'likely_sold' and model_key is not null group by 1, 2)
select category, model_key, n, greatest(0.0, least(1.0, (case when n < 5 then 0.5 + 0.1 * n else 1.0 end) * (case when spread > 2 then 0.6 else 1.0 end) * coalesce(sales[len(sales) // 2 + 1], 1.0) * weights[len(weights) // 2 + 1])) as confidence from g""",
    "weighted_median_by_key": WITH_LISTING + """, r as (select category, model_key, price, coalesce(price_confidence, 1.0) as w, listing_id from listing where status = 'likely_sold'),
s as (select *, sum(w) over (partition by category, model_key order by price, listing_id rows unbounded preceding) as run, sum(w) over (partition by category, model_key) as total,
  row_number() over (partition by category, model_key order by price, listing_id) as i, count(*) over (partition by category, model_key) as n from r)
select category, model_key, min(price) filter (where case when total > 0 then run >= total / 2 - 1e-9 else i > n // 2 end) as weighted_median from s group by 1, 2""",
    "scannable_share": WITH_LISTING + _CANDIDATES + """select l.category, count(*) as n_active, count(c.listing_id) as n_scannable, count(c.listing_id) / count(*) as share
from listing l left join cand c on c.listing_id = l.listing_id where l.status = 'active' group by l.category""",
}

# ---- matching


def image_hash_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    return matching.same_photo(rows.filter("source <> 'ebay'"), rows)


def epid_peers_price_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    asked = rows.filter("source <> 'ebay'").withColumnRenamed("listing_id", "query_id")
    return matching.price_context(matching.catalogue_peers(asked, rows).select("query_id", "listing_id"), rows)


def match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(listing(spark, sf))
    return matching.match(rows.filter("source <> 'ebay' and listing_id % 50 = 0"), rows, keep=kept)


def match_prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(listing(spark, sf))
    asked = rows.filter("source <> 'ebay' and listing_id % 50 = 0")
    return matching.priced(asked, rows, keep=kept)[0]


_MATCH = (
    _POOL + ", ask as (select * from listing where source <> 'ebay' and listing_id % 50 = 0),\n"
    "photo as (select q.listing_id as query_id, c.listing_id from ask q join listing c on q.image_hash = c.image_hash and c.source = 'ebay' and q.listing_id <> c.listing_id),\n"
    "rest as (select * from ask where listing_id not in (select query_id from photo)),\n"
    "near as materialized (" + _near("rest", "pool", _STRICT + " and " + _TOLERANT, 10) + """),
matched as (select query_id, listing_id, 1.0 as similarity, row_number() over (partition by query_id order by listing_id) as rank, 'image_hash' as matched_by from photo
  union all select query_id, listing_id, similarity, rank, 'embedding' from near)
"""
)
SQL |= {
    "image_hash_match": WITH_LISTING + "select q.listing_id as query_id, c.listing_id from listing q join listing c on q.image_hash = c.image_hash and c.source = 'ebay' and q.listing_id <> c.listing_id where q.source <> 'ebay'",
    "epid_peers_price_context": WITH_LISTING + f"""select q.listing_id as query_id, count(*) as n, median(c.price) as median_price, min(c.price) as min_price, max(c.price) as max_price, median(c.price + c.shipping_cost) as median_total,
  count(c.shipping_cost) as n_totals, max(c.price) / min(c.price) as spread from listing q join (select * from listing where {COMPARABLE} and source = 'ebay') c on q.epid = c.epid and q.listing_id <> c.listing_id
  and (q.completeness is null or c.completeness is null or q.completeness = c.completeness) where q.source <> 'ebay' group by 1""",
    "match_cascade": WITH_LISTING + _MATCH + "select * from matched",
    "match_prices": WITH_LISTING + _MATCH + f""", top as (select m.query_id, m.matched_by, m.similarity as confidence, l.epid, a.completeness from matched m join listing l on l.listing_id = m.listing_id join ask a on a.listing_id = m.query_id where m.rank = 1),
peers as (select t.query_id, c.listing_id, t.epid from top t join (select * from listing where {COMPARABLE} and source = 'ebay') c on t.epid = c.epid and t.query_id <> c.listing_id and (t.completeness is null or c.completeness is null or t.completeness = c.completeness)),
enough as (select query_id from peers group by 1 having count(*) >= 2),
chosen as (select query_id, listing_id, 'epid' as comps_from from peers where query_id in (select query_id from enough) union all select query_id, listing_id, 'candidates' from matched where query_id not in (select query_id from enough)),
ctx as (select c.query_id, min(c.comps_from) as comps_from, count(*) as n, median(l.price) as median_price, min(l.price) as min_price, max(l.price) as max_price, median(l.price + l.shipping_cost) as median_total, count(l.shipping_cost) as n_totals, max(l.price) / min(l.price) as spread
  from chosen c join listing l on l.listing_id = c.listing_id group by 1)
select a.listing_id as query_id, t.matched_by, coalesce(t.confidence, 0.0) as confidence, x.comps_from, case when x.comps_from = 'epid' then t.epid end as epid, x.n, x.median_price, x.min_price, x.max_price, x.median_total, x.n_totals, x.spread,
  concat_ws('+', case when x.spread > 3 then 'wide_spread' end, case when x.n is null then 'not_analysed' else 'asking_prices' end) as note
from ask a left join top t on t.query_id = a.listing_id left join ctx x on x.query_id = a.listing_id""",
}

# ---- lifecycle


def retire_stale(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.retire(listing(spark, sf), now()).select("listing_id", "status", "retired")


def proven_alive(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf).filter("status = 'active' and source = 'ebay'")
    return rows.groupBy("category").agg(F.count_if(lifecycle.proven_alive(now())).alias("n_alive"), F.count("*").alias("n_active"))


def check_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.due(listing(spark, sf), now()).select("listing_id", "last_checked_at", "missing_since")


def two_strike(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("listing_id"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.col("event_type").isin("error", "purchase").alias("ended"))
    return lifecycle.two_strikes(e).select("listing_id", "tie", "ended", "change")


def check_pass(spark: SparkSession, sf: str) -> DataFrame:
    """One check of the listings that are due: every third is gone."""
    rows = listing(spark, sf)
    gone = lifecycle.due(rows, now()).select("listing_id", (F.col("listing_id") % 3 == 0).alias("ended"))
    return lifecycle.checked(rows, gone, now()).select("listing_id", "status", "missing_since", "change")


def check_counters(spark: SparkSession, sf: str) -> DataFrame:
    return check_pass(spark, sf).filter("change is not null").groupBy("change").agg(F.count("*").alias("n"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Item bodies of four fifths of the listings, by their schema: some out of stock, some past their end, some with a capacity."""
    k = F.col("o_orderkey")
    aspects = F.when(k % 2 == 0, F.array(F.struct(F.lit("STRING").alias("type"), F.lit("Storage Capacity").alias("name"), F.concat(F.lit(2) * (k % 7 + 1), F.lit(" GB")).alias("value"))))
    stock = F.when(k % 6 == 0, '[{"estimatedAvailabilityStatus":"OUT_OF_STOCK","estimatedSoldQuantity":4}]').when(k % 6 == 1, '{"estimatedAvailableQuantity":3}')
    end = F.when(k % 7 == 0, F.lit("2024-06-01T00:00:00Z")).when(k % 7 == 1, F.lit("2024-12-01T00:00:00Z"))
    body = F.to_json(F.struct(F.concat(F.lit("item-"), k).alias("itemId"), aspects.alias("localizedAspects"), end.alias("itemEndDate")))
    rows = table(spark, sf, "orders").filter(k % 5 > 0).select(F.from_json(body, normalize.BODY).alias("x"), stock.alias("stock"))
    return rows.select("x.*", "stock").drop("estimatedAvailabilities").withColumnRenamed("stock", "estimatedAvailabilities")


def _to_check(spark: SparkSession, sf: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return listing(spark, sf).withColumns({"title": F.concat(F.lit("Lot of "), F.col("listing_id") % 9 + 2, F.lit(" handhelds")), "condition": none("string"), "aspects": none("map<string,string>"), "category_id": none("string"), "sold_quantity": none("int"), "is_gtc": none("boolean"), "variant_signals": none("map<string,string>"), "item_end_date": F.col("item_end_date").cast("timestamp")})


def check_run(spark: SparkSession, sf: str) -> DataFrame:
    """Due listings, looked up, filled in, read again, checked and scored; those long unseen were retired before."""
    rows = lifecycle.check_run(_to_check(spark, sf), _bodies(spark, sf), now(), keep=kept)
    return rows.select("listing_id", "found", "ended", "status", "missing_since", "change", "relist_id", "capacity_gb", "lot_size", "sold_quantity", F.col("sale_score").isNotNull().alias("is_scored"))


def check_run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Calls run out after 500 checks. The counters are observed while the rows are written."""
    counters = lifecycle.counted_run(_to_check(spark, sf), _bodies(spark, sf), now(), kept, quota=500)[1]
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in counters.items()))


def relist_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    return lifecycle.relists(rows.filter("status = 'likely_sold'"), rows, F.expr("timestamp_ntz '2024-06-20 00:00:00'"))


def score_sale(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing(spark, sf)
    sold = rows.filter("status = 'likely_sold'")
    sold = sold.join(lifecycle.relists(sold, rows, now()), "listing_id", "left")
    out = lifecycle.scored(sold, now())
    return out.select("listing_id", "relist_id", F.round("sale_score", 6).alias("sale_score"), F.round("price_score", 6).alias("price_score"), F.size("signals").alias("n_signals"), F.element_at("signals", "price_bias").alias("price_bias"))


_LIFE = "(epoch(coalesce(missing_since, now_ts)) - epoch(posted_at)) / 86400"
SQL |= {
    "retire_stale": WITH_LISTING + f", r as (select *, status = 'active' and first_seen_at < {_NOW} - interval 60 day and last_seen_at < {_NOW} - interval 30 day as retired from listing) select listing_id, case when retired then 'stale' else status end as status, retired from r",
    "proven_alive": WITH_LISTING + f"select category, count(*) filter (where last_seen_at >= {_NOW} - interval 3 hour) as n_alive, count(*) as n_active from listing where status = 'active' and source = 'ebay' group by 1",
    "check_candidates": WITH_LISTING + f"select listing_id, last_checked_at, missing_since from listing where status = 'active' and source = 'ebay' and last_seen_at < {_NOW} - interval 3 hour order by missing_since is null, last_checked_at nulls first, last_seen_at, listing_id limit 700",
    "two_strike": """with e as (select user_id as listing_id, ts, event_id as tie, event_type in ('error', 'purchase') as ended from events),
p as (select *, coalesce(lag(ended) over w, false) as prior from e window w as (partition by listing_id order by ts, tie)),
t as (select *, coalesce(bool_or(ended and prior) over (partition by listing_id order by ts, tie rows between unbounded preceding and 1 preceding), false) as done from p)
select listing_id, tie, ended, case when done then 'terminal' when ended and prior then 'confirmed' when ended then 'strike' when prior then 'recovered' else 'alive' end as change from t""",
    "relist_join": WITH_LISTING + """select listing_id, other as relist_id from (select s.listing_id, c.listing_id as other, row_number() over (partition by s.listing_id order by c.first_seen_at desc, c.listing_id) as r
  from listing s join listing c on s.source = c.source and s.image_hash = c.image_hash and s.listing_id <> c.listing_id where s.status = 'likely_sold' and c.status <> 'likely_sold' and c.first_seen_at >= timestamp '2024-06-20' - interval 21 day) where r = 1""",
    "score_sale": WITH_LISTING + f""", rel as (select listing_id, other as relist_id from (select s.listing_id, c.listing_id as other, row_number() over (partition by s.listing_id order by c.first_seen_at desc, c.listing_id) as r
  from listing s join listing c on s.source = c.source and s.image_hash = c.image_hash and s.listing_id <> c.listing_id where s.status = 'likely_sold' and c.status <> 'likely_sold' and c.first_seen_at >= {_NOW} - interval 21 day) where r = 1),
b as (select l.*, r.relist_id, case when not is_auction then abs(epoch(coalesce(missing_since, now_ts)) - epoch(item_end_date)) / 3600 <= 12 end as at_end, {_LIFE} as life from listing l left join rel r on r.listing_id = l.listing_id where status = 'likely_sold'),
c as (select *, at_end is null and life >= 28 and (life % 30 <= 2 or life % 30 >= 28) as term from b), d as (select *, not term and life <= 7 as quick from c)
select listing_id, relist_id,
  round(greatest(0.0, least(1.0, 0.75 * (case when relist_id is not null then 0.15 else 1.0 end) * (case when not is_auction then 1.0 when bid_count = 0 then 0.05 when bid_count > 0 then 1.5 else 1.0 end) * (case when at_end then 0.4 else 1.0 end) * (case when term then 0.5 when quick then 1.2 else 1.0 end))), 6) as sale_score,
  round(greatest(0.0, least(1.0, (case when accepts_best_offer then 0.75 else 1.0 end) * (case when is_auction then 0.6 else 1.0 end) * (case when shipping_cost is null then 0.9 when shipping_estimated then 0.95 else 1.0 end))), 6) as price_score,
  1 + (relist_id is not null)::int + (case when is_auction and bid_count is not null then 2 else 0 end) + (at_end is not null)::int + (case when term then 2 when quick then 1 else 0 end) + accepts_best_offer::int + is_auction::int + (accepts_best_offer or is_auction)::int
    + (case when shipping_cost is null or shipping_estimated then 1 else 0 end) as n_signals,
  case when is_auction then 'under' when accepts_best_offer then 'over' end as price_bias from d""",
}
_OLD = f"source = 'ebay' and status = 'active' and first_seen_at < {_NOW} - interval 60 day and last_seen_at < {_NOW} - interval 30 day"
_RUN = WITH_LISTING + f""", market as materialized (select * exclude (status), case when {_OLD} then 'stale' else status end as status, {_OLD} as retired from listing),
due as materialized (select * from market where status = 'active' and source = 'ebay' and last_seen_at < {_NOW} - interval 3 hour order by missing_since is null, last_checked_at nulls first, last_seen_at, listing_id limit 700),
b as (select *, listing_id % 5 > 0 as found, listing_id % 5 = 0 or listing_id % 6 = 0 or listing_id % 7 = 0 as ended from due),
c as (select *, case when ended and missing_since is not null then 'confirmed' when ended then 'strike' when missing_since is not null then 'recovered' else 'alive' end as change from b),
rel as (select listing_id, other as relist_id from (select s.listing_id, c.listing_id as other, row_number() over (partition by s.listing_id order by c.first_seen_at desc, c.listing_id) as r
  from c s join market c on s.source = c.source and s.image_hash = c.image_hash and s.listing_id <> c.listing_id where s.change = 'confirmed' and c.status <> 'likely_sold' and c.first_seen_at >= {_NOW} - interval 21 day) where r = 1),
run as (select c.*, relist_id from c left join rel using (listing_id))
"""
SQL |= {
    "check_run": _RUN + f"""select listing_id, found, ended, case when change = 'confirmed' then 'likely_sold' else status end as status, case when change = 'strike' then {_NOW} when change = 'recovered' then null else missing_since end as missing_since, change, relist_id,
  case when not found then capacity_gb when listing_id % 2 = 0 then 2 * (listing_id % 7 + 1) end as capacity_gb, case when found then listing_id % 9 + 2 else lot_size end as lot_size, case when found and listing_id % 6 = 0 then 4 end as sold_quantity, change = 'confirmed' as is_scored from run""",
    "check_run_counters": _RUN.replace("limit 700", "limit 500") + f"""select count(*) as checked, count(*) filter (where change = 'confirmed') as marked_sold, count(*) filter (where change = 'confirmed' and relist_id is not null) as detected_relists, count(*) filter (where found) as enriched,
  count(*) filter (where change = 'strike') as pending_confirmation, count(*) filter (where change = 'recovered') as recovered,
  (select count(*) from market where source = 'ebay' and status = 'active' and last_seen_at >= {_NOW} - interval 3 hour) as skipped_proven_alive,
  (select count(*) from market where retired) as retired_stale,
  (select count(*) from market where source = 'ebay' and status = 'active' and last_seen_at < {_NOW} - interval 3 hour) > 500 as quota_exhausted from run""",
}
_CHECKED = WITH_LISTING.replace("listing as (", "listing as materialized (", 1) + f""", due as materialized (select listing_id, listing_id % 3 = 0 as ended from listing where status = 'active' and source = 'ebay' and last_seen_at < {_NOW} - interval 3 hour order by missing_since is null, last_checked_at nulls first, last_seen_at, listing_id limit 700),
c as (select l.*, case when l.status <> 'active' or d.ended is null then null when d.ended and missing_since is not null then 'confirmed' when d.ended then 'strike' when missing_since is not null then 'recovered' else 'alive' end as change from listing l left join due d on d.listing_id = l.listing_id)
"""
SQL |= {
    "check_pass": _CHECKED + f"select listing_id, case when change = 'confirmed' then 'likely_sold' else status end as status, case when change = 'strike' then {_NOW} when change = 'recovered' then null else missing_since end as missing_since, change from c",
    "check_counters": _CHECKED + "select change, count(*) as n from c where change is not null group by 1",
}

# ---- upserts and price history


def _page(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the listings as stored, half of all as seen again, some at another price, and each tenth twice."""
    rows = listing(spark, sf).drop("embedding", "now_ts")
    seen = rows.filter("listing_id % 2 = 0").withColumn("price", F.when(F.col("listing_id") % 7 == 0, F.col("price") + 10).otherwise(F.col("price")))
    seen = seen.withColumn("shipping_cost", F.when(F.col("listing_id") % 5 == 0, F.lit(None)).otherwise(F.col("shipping_cost"))).withColumn("position", F.lit(0))
    again = seen.filter("listing_id % 10 = 0").withColumn("price", F.col("price") + 1).withColumn("position", F.lit(1))
    return rows.filter("listing_id % 3 <> 0"), merge.first_of_key(seen.unionByName(again)).drop("position")


_FLAGS = ("created", "updated", "revived", "price_changed")


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    stored, seen = _page(spark, sf)
    return merge.upsert(stored, seen, now()).select("source", "source_id", "price", "shipping_cost", "shipping_estimated", "status", "last_seen_at", "missing_since", "epid", "image_hash", *_FLAGS)


def upsert_counters(spark: SparkSession, sf: str) -> DataFrame:
    return merge.counters(merge.upsert(*_page(spark, sf), now()))


def upsert_observations(spark: SparkSession, sf: str) -> DataFrame:
    return merge.observations(merge.upsert(*_page(spark, sf), now()), now())


def capture_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Captured again: some with the same photos, some with others, some with none."""
    stored, seen = _page(spark, sf)
    k = F.col("listing_id")
    photo = lambda x: F.array(F.concat(F.lit(x), k.cast("string")))
    stored = stored.withColumns({"images": F.when(k % 11 > 0, photo("a")), "embedded_at": F.when(k % 13 > 0, F.col("first_seen_at"))})
    seen = seen.withColumns({"images": F.when(k % 8 == 0, photo("a")).when(k % 8 == 2, photo("b")).when(k % 8 == 4, F.array().cast("array<string>")), "image_hash": F.when(k % 3 > 0, F.concat(F.lit("n"), k.cast("string")))})
    rows = merge.upsert(stored, seen, now(), merge.CAPTURE_POLICY, revive=False, compare_incoming=True)
    return rows.select("source", "source_id", "price", "shipping_cost", "status", "completeness", "image_hash", F.array_join("images", ",").alias("images"), "embedded_at", *_FLAGS)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("listing_id"), F.floor(F.col("value") / 50 + 0.5).alias("price"), F.col("ts").alias("observed_at"), F.col("event_id").alias("tie"))


def price_changes(spark: SparkSession, sf: str) -> DataFrame:
    return merge.changes(_history(spark, sf)).select("listing_id", "tie", "price")


def price_series_summary(spark: SparkSession, sf: str) -> DataFrame:
    at = F.struct("observed_at", "tie")
    return merge.changes(_history(spark, sf)).groupBy("listing_id").agg(F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.count("*").alias("n"))


def search_health(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "customer").filter("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("search_id"), (F.col("c_acctbal") < 0).alias("failed"), (F.col("c_nationkey") * 30).alias("total"), F.least(F.lit(200), F.col("c_nationkey") * 30).alias("kept"))
    return merge.search_health(runs)


def search_bookkeeping(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("search_id"), F.col("c_name").alias("keyword"), (F.col("c_custkey") % 8 != 0).alias("enabled"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit(7).alias("last_result_total"), "c_acctbal", "c_nationkey")
    runs = merge.enabled(rows).select("search_id", (F.col("c_acctbal") < 0).alias("failed"), (F.col("c_nationkey") * 30).alias("total"))
    return merge.bookkept(rows.drop("c_acctbal", "c_nationkey"), runs, now())


_MERGE = WITH_LISTING + """, stored as (select * from listing where listing_id % 3 <> 0),
seen as (select *, case when listing_id % 7 = 0 then price + 10 else price end as new_price, case when listing_id % 5 = 0 then null else shipping_cost end as new_ship from listing where listing_id % 2 = 0),
m as (select coalesce(s.source, n.source) as source, coalesce(s.source_id, n.source_id) as source_id, s.listing_id is not null as was, n.listing_id is not null as came, s.listing_id as sid, n.listing_id as nid, s.price as old_price, n.new_price, s.shipping_cost as old_ship, n.new_ship,
  s.shipping_estimated as old_est, n.shipping_estimated as new_est, s.status as old_status, s.last_seen_at as old_seen, s.missing_since as old_missing, coalesce(s.epid, n.epid) as epid, coalesce(s.image_hash, n.image_hash) as image_hash, s.completeness as old_comp, n.completeness as new_comp
  from stored s full join seen n on s.source = n.source and s.source_id = n.source_id),
u as (select *, case when was and not came then old_price else new_price end as price, case when not was then new_ship when not came then old_ship else coalesce(new_ship, old_ship) end as shipping_cost,
  case when not was then new_est when not came or new_ship is null then old_est else new_est end as shipping_estimated, not was as created, was and came as updated, coalesce(was and came and old_status = 'stale', false) as revived from m),
v as (select *, came and (not was or old_price is distinct from price or old_ship is distinct from shipping_cost) as price_changed, came and (not was or old_price is distinct from new_price or old_ship is distinct from new_ship) as capture_changed from u)
"""
_HISTORY = """with h as (select user_id as listing_id, floor(value / 50 + 0.5) as price, ts, event_id as tie from events),
c as (select *, lag(price) over w as before, row_number() over w as r from h window w as (partition by listing_id order by ts, tie)),
d as (select * from c where r = 1 or before is distinct from price)
"""
SQL |= {
    "upsert_merge": _MERGE + f"""select source, source_id, price, shipping_cost, shipping_estimated, case when not was or revived then 'active' else old_status end as status, case when came then {_NOW} else old_seen end as last_seen_at,
  case when came then null else old_missing end as missing_since, epid, image_hash, created, updated, revived, price_changed from v""",
    "upsert_counters": _MERGE + "select count(*) filter (where created) as inserted, count(*) filter (where updated) as updated, count(*) filter (where created or updated) as upserted, count(*) filter (where revived) as reactivated, count(*) filter (where price_changed and updated) as price_changes from v",
    "upsert_observations": _MERGE + f"select coalesce(sid, nid) as listing_id, price, shipping_cost, {_NOW} as observed_at from v where price_changed",
    "capture_upsert": _MERGE + """, k as (select v.*, coalesce(sid, nid) as id, case when sid % 11 > 0 then 'a' || sid end as old_images, case nid % 8 when 0 then 'a' || nid when 2 then 'b' || nid when 4 then '' end as new_images,
    case when nid % 3 > 0 then 'n' || nid end as new_hash, l.image_hash as old_hash, case when sid % 13 > 0 then l.first_seen_at end as old_embedded from v join listing l on l.listing_id = coalesce(sid, nid)),
w as (select *, was and came and coalesce(new_images, '') <> '' and new_images is distinct from old_images as other from k)
select source, source_id, price, shipping_cost, case when not was then 'active' else old_status end as status, case when was then old_comp else new_comp end as completeness,
  case when not was or other then new_hash when came then coalesce(old_hash, new_hash) else old_hash end as image_hash, case when not was or other then new_images else old_images end as images, case when was and not other then old_embedded end as embedded_at,
  created, updated, false as revived, capture_changed as price_changed from w""",
    "price_changes": _HISTORY + "select listing_id, tie, price from d",
    "price_series_summary": _HISTORY + "select listing_id, arg_min(price, (ts, tie)) as first_price, arg_max(price, (ts, tie)) as last_price, min(price) as lowest, max(price) as highest, count(*) as n from d group by 1",
    "search_bookkeeping": f"""with r as (select *, c_custkey % 8 <> 0 as on_, c_custkey % 8 <> 0 and c_acctbal >= 0 as ran from customer)
select c_custkey as search_id, c_name as keyword, on_ as enabled, case when ran then {_NOW} end as last_run_at, case when ran then c_nationkey * 30 else 7 end as last_result_total from r""",
    "search_health": """with r as (select c_acctbal < 0 as failed, c_nationkey * 30 as total, least(200, c_nationkey * 30) as kept from customer where c_custkey % 8 <> 0)
select count(*) as searches_run, count(*) filter (where failed) as searches_failed, count(*) filter (where not failed and total > kept) as truncated, count(*) filter (where failed) >= greatest(2, count(*) // 2) as systematic from r""",
}

QUERIES = {name: globals()[name] for name in (*SQL, "knn_skipped")}
