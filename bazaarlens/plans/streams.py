"""Queries that run streams over the events table, fed in files and out of order; with their SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import merge
from bazaarlens.plans import market
from bazaarlens.plans.fixtures import scratch, table
from bazaarlens.sources.snapshots import Snapshot
from bazaarlens.streaming import ingest, jobs

#: Events come up to so many days late, in files of a week each.
LATE_DAYS, FILES = 4, 5


def _fed(rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """``rows`` as a stream that reads one file after the other: those of part 0, of part 1 ..."""
    at = scratch(rows.sparkSession)
    numbered = rows.withColumn("__part", part)
    for n in range(parts):
        numbered.filter(F.col("__part") == n).drop("__part").coalesce(1).write.mode("append").parquet(at)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _late(spark: SparkSession, sf: str, values: dict[str, Column]) -> DataFrame:
    """Events (listing_id, at, tie and ``values``) in an order that is up to ``LATE_DAYS`` off; two last rows let the watermark pass all."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("listing_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"), *[v.alias(k) for k, v in values.items()])
    days = F.datediff("at", F.lit("2024-01-01").cast("date"))
    part = F.least(F.floor((days + F.col("tie") % (LATE_DAYS + 1)) / 7), F.lit(FILES - 1))
    ends = spark.range(2).select((-F.col("id") - 1).alias("listing_id"), F.expr("timestamp '2030-01-01 00:00:00' + make_interval(0, 0, 0, int(id))").alias("at"), F.col("id").alias("tie"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in values])
    return _fed(rows.unionByName(ends), F.when(F.col("listing_id") < 0, FILES + F.col("tie")).otherwise(part), FILES + 2)


def _ran(df: DataFrame, empty_batches: bool = True) -> DataFrame:
    at = scratch(df.sparkSession)
    return jobs.run_to_table(df, f"{at}/out", f"{at}/checkpoint", empty_batches).filter("listing_id >= 0")


def stream_two_strikes(spark: SparkSession, sf: str) -> DataFrame:
    """Checks that come late are played where they belong."""
    return _ran(jobs.two_strikes(_late(spark, sf, {"ended": F.col("event_type").isin("error", "purchase")}), f"{LATE_DAYS + 1} days"))


def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Price and known shipping, whichever changes; late observations included."""
    values = {"price": F.floor(F.col("value") / 50 + 0.5).cast("double"), "shipping_cost": F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 4).cast("double"))}
    return _ran(jobs.changes_only(_late(spark, sf, values), f"{LATE_DAYS + 1} days"))


def stream_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Listings that nothing has shown for two days."""
    rows = _ran(jobs.unseen(_late(spark, sf, {}), 2 * 86_400_000, f"{LATE_DAYS + 1} days"))
    return rows.withColumn("unseen_since", F.col("unseen_since").cast("timestamp_ntz"))


def stream_announce_once(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("listing_id"), "event_id")
    return _ran(jobs.announce_once(_fed(e, F.col("event_id") % 3, 3).select("listing_id")))


def stream_fresh_deals(spark: SparkSession, sf: str) -> DataFrame:
    """Scans of deals one after the other, a file each: what is new or has another score than at the last scan."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    order = F.unix_micros(F.col("ts").cast("timestamp"))  # a scan's rows are told apart and ordered by their time
    e = table(spark, sf, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("listing_id"), F.least(F.floor(day / 8), F.lit(3)).alias("scan")).agg(F.max_by(F.floor(F.col("value") / 100).cast("double"), F.struct(order, "event_id")).alias("score"), F.max_by("event_id", F.struct(order, "event_id")).alias("tie"))
    return _ran(jobs.fresh_deals(_fed(e, F.col("scan"), 4).select("listing_id", "tie", "score")), empty_batches=False)


class _Killed(Exception):
    pass


def _ingested(spark: SparkSession, sf: str) -> tuple[Snapshot, str]:
    """A third of the listings stored, all events as sightings of them in four files; stopped once with a version written and its batch not committed."""
    at = scratch(spark)
    name = "ingest_" + at.rsplit("/", 1)[-1].replace("-", "")
    snapshot = Snapshot(spark, f"{at}/listing", name, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = table(spark, sf, "events")
    k = F.col("listing_id")
    own = {"listing_id": F.col("user_id"), "source": F.lit("ebay"), "source_id": F.col("user_id").cast("string")}
    stored = e.select(*[v.alias(c) for c, v in own.items()]).distinct().filter("listing_id % 3 = 0").select(
        "*", F.concat(F.lit("old "), "source_id").alias("title"), F.lit(7.0).alias("price"), F.when(k % 2 == 0, 1.0).alias("shipping_cost"), F.when(k % 2 == 0, False).alias("shipping_estimated"), F.when(k % 5 > 0, F.concat(F.lit("e"), "source_id")).alias("epid"), F.when(k % 7 > 2, F.concat(F.lit("h"), "source_id")).alias("image_hash"),
        F.when(k % 4 == 0, "stale").when(k % 4 == 1, "likely_sold").otherwise("active").alias("status"), F.expr("timestamp_ntz '2023-12-01 00:00:00'").alias("first_seen_at"), F.expr("timestamp_ntz '2023-12-02 00:00:00'").alias("last_seen_at"), F.when(k % 4 == 2, F.expr("timestamp_ntz '2023-12-03 00:00:00'")).alias("missing_since"),
        F.array_repeat(k.cast("float"), 16).alias("embedding"),
    )
    snapshot.write(stored, 0)
    n = F.col("event_id")
    seen = e.select(
        *[v.alias(c) for c, v in own.items()], F.concat(F.lit("t"), n % 11).alias("title"), F.floor(F.col("value") / 50 + 0.5).cast("double").alias("price"), F.when(n % 3 > 0, (n % 4).cast("double")).alias("shipping_cost"), (n % 2 == 0).alias("shipping_estimated"),
        F.when(n % 5 == 0, F.concat(F.lit("x"), n % 13)).alias("epid"), F.when(n % 6 == 0, F.concat(F.lit("n"), n % 17)).alias("image_hash"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"), n.alias("position"),
    )
    stream = _fed(seen, F.least(F.floor(F.datediff(F.col("fetched_at").cast("date"), F.lit("2024-01-01").cast("date")) / 8), F.lit(3)), 4)
    apply, killed = ingest.merge_batch(snapshot, f"{at}/log"), []

    def once_killed(batch: DataFrame, number: int) -> None:
        apply(batch, number)
        if number == 1 and not killed:
            killed.append(number)
            raise _Killed

    while True:
        try:
            ingest.upsert_stream(stream, once_killed, f"{at}/checkpoint").awaitTermination()
            return snapshot, f"{at}/log"
        except StreamingQueryException:
            if len(killed) != 1 or snapshot.newest() != 2:
                raise
            killed.append(0)


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored once all sightings are in."""
    snapshot, _ = _ingested(spark, sf)
    return snapshot.read().select("listing_id", "source_id", "title", "price", "shipping_cost", "shipping_estimated", "epid", "image_hash", "status", "first_seen_at", "last_seen_at", "missing_since", F.size("embedding").alias("n_embedding"))


def stream_upsert_log(spark: SparkSession, sf: str) -> DataFrame:
    """The observations that the sightings have made."""
    return ingest.observations(*_ingested(spark, sf)).select("listing_id", "price", "shipping_cost", "observed_at")


def stream_upsert_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What each batch did."""
    return ingest.counters(*_ingested(spark, sf))


_STORED = """stored as (select distinct user_id as listing_id, 'old ' || user_id as title, 7.0 as price, case when user_id % 2 = 0 then 1.0 end as ship, case when user_id % 2 = 0 then false end as est, case when user_id % 5 > 0 then 'e' || user_id end as epid, case when user_id % 7 > 2 then 'h' || user_id end as hash,
  case user_id % 4 when 0 then 'stale' when 1 then 'likely_sold' else 'active' end as status from events where user_id % 3 = 0),
seen as (select user_id as listing_id, 't' || event_id % 11 as title, floor(value / 50 + 0.5) as price, case when event_id % 3 > 0 then (event_id % 4)::double end as ship, event_id % 2 = 0 as est, case when event_id % 5 = 0 then 'x' || event_id % 13 end as epid, case when event_id % 6 = 0 then 'n' || event_id % 17 end as hash,
  ts, event_id as n, least(date_diff('day', date '2024-01-01', ts::date) // 8, 3) as batch from events)"""
SQL = {
    "stream_two_strikes": market.SQL["two_strike"].replace("select listing_id, tie, ended, case", "select listing_id, tie, case"),
    "stream_changes": """with e as (select user_id as listing_id, event_id as tie, ts, floor(value / 50 + 0.5) as price, case when event_id % 3 > 0 then (event_id % 4)::double end as ship from events),
k as (select *, last_value(ship ignore nulls) over (partition by listing_id order by ts, tie) as known from e),
c as (select *, lag(price) over w as p, lag(known) over w as s, row_number() over w as r from k window w as (partition by listing_id order by ts, tie))
select listing_id, tie, price, known as shipping_cost from c where r = 1 or p is distinct from price or s is distinct from known""",
    "stream_unseen": "with n as (select user_id as listing_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as next from events) select listing_id, ts as unseen_since from n where next is null or next - ts > interval 2 day",
    "stream_announce_once": "select distinct user_id as listing_id from events where event_type = 'purchase'",
    "stream_fresh_deals": """with s as (select user_id as listing_id, least(date_diff('day', date '2024-01-01', ts::date) // 8, 3) as scan, arg_max(floor(value / 100), (ts, event_id)) as score, arg_max(event_id, (ts, event_id)) as tie from events where event_type = 'purchase' group by 1, 2),
p as (select *, lag(score) over (partition by listing_id order by scan) as before from s) select listing_id, tie, score::double as score from p where before is distinct from score""",
    "stream_upsert": "with " + _STORED + """, n as (select listing_id, arg_max(title, (ts, n)) as title, arg_max(price, (ts, n)) as price, arg_max(ship, (ts, n)) as ship, arg_max(est, (ts, n)) filter (where ship is not null) as est, arg_min(est, (ts, n)) as est_first, arg_max(epid, (ts, n)) as epid, arg_min(hash, (ts, n)) as hash, min(ts) as first, max(ts) as last from seen group by 1)
select listing_id, listing_id::varchar as source_id, coalesce(n.title, s.title) as title, coalesce(n.price, s.price) as price, coalesce(n.ship, s.ship) as shipping_cost, case when n.ship is not null then n.est when s.listing_id is not null then s.est else est_first end as shipping_estimated, coalesce(n.epid, s.epid) as epid, coalesce(s.hash, n.hash) as image_hash,
  case when s.listing_id is null or n.listing_id is not null and s.status = 'stale' then 'active' else s.status end as status, case when s.listing_id is null then first else timestamp '2023-12-01' end as first_seen_at, coalesce(last, timestamp '2023-12-02') as last_seen_at, case when n.listing_id is null and listing_id % 4 = 2 then timestamp '2023-12-03' end as missing_since,
  case when s.listing_id is not null then 16 end as n_embedding from stored s full join n using (listing_id)""",
    "stream_upsert_log": "with " + _STORED + """, q as (select listing_id, price, ship, null::timestamp as ts, -1 as n from stored union all select listing_id, price, ship, ts, n from seen),
k as (select *, last_value(ship ignore nulls) over (partition by listing_id order by ts nulls first, n) as known from q),
c as (select *, lag(price) over w as p, lag(known) over w as s, row_number() over w as r from k window w as (partition by listing_id order by ts nulls first, n))
select listing_id, price, known as shipping_cost, ts as observed_at from c where n >= 0 and (r = 1 or p is distinct from price or s is distinct from known)""",
    "stream_upsert_counters": "with " + _STORED + """, b as (select distinct batch, listing_id from seen),
f as (select b.*, s.listing_id is not null as was, s.status, row_number() over (partition by b.listing_id order by batch) as r from b left join stored s on s.listing_id = b.listing_id)
select batch, count(*) filter (where not was and r = 1) as inserted, count(*) filter (where was or r > 1) as updated, count(*) filter (where status = 'stale' and r = 1) as reactivated from f group by 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
