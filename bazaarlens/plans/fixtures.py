"""Views over the driver's tables that stand in for listings, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One listing for each order. Moduli are coprime with 2 and 5, as the tables' row counts are products of those.
LISTING = """
select k as listing_id, concat('item-', cast(k as string)) as source_id,
  case k % 11 when 0 then 'depop' when 1 then 'facebook' else 'ebay' end as source,
  cast(floor(p_retailprice * (50 + (k * 37) % 101) + 0.5) as double) / cast(100 as double) as price,
  case when k % 3 = 0 then null else cast((13 * k) % 41 as double) end as shipping_cost,
  k % 7 = 1 as shipping_estimated, p_type as category,
  case when k % 13 = 0 then null else p_brand end as model_key,
  case when k % 3 = 1 then null else concat('e', cast(p_partkey as string)) end as epid,
  case when k % 7 = 0 then null when p_size % 3 = 0 then 16 when p_size % 3 = 1 then 32 else 64 end as capacity_gb,
  case when k % 3 = 0 then null when p_size % 2 = 0 then 'DDR4' else 'DDR5' end as spec_generation,
  case when k % 3 = 1 then null when p_size % 2 = 0 then 'desktop' else 'laptop' end as form_factor,
  case k % 9 when 0 then 'bare' when 1 then 'complete' when 2 then 'bundle' end as completeness,
  case when k % 49 = 3 then 2 end as lot_size,
  k % 27 = 4 as has_defect, k % 41 = 5 as is_accessory, k % 17 = 6 as price_is_from, k % 19 = 7 as is_auction,
  case when k % 19 = 7 then k % 3 end as bid_count, k % 7 < 3 as accepts_best_offer,
  case when k % 23 = 0 then null else concat('h', cast(k % 997 as string)) end as image_hash,
  status,
  case when status <> 'likely_sold' or k % 17 = 0 then null else cast((7 * k) % 101 as double) / cast(100 as double) end as sale_confidence,
  cast(case when status <> 'likely_sold' then null when k % 21 = 0 then 0.0 when k % 19 = 7 then 0.6 when k % 3 = 0 then 1.0 when k % 3 = 1 then 0.9 else 0.75 end as double) as price_confidence,
  posted_at, first_seen_at, last_seen_at,
  case when k % 4 = 0 then null else last_seen_at + interval '1' day end as last_checked_at,
  case when status = 'likely_sold' or (status = 'active' and k % 23 = 0) then least(now_ts, posted_at + interval '1' day * cast(k % 97 as int)) end as missing_since,
  case when k % 2 = 0 then null else posted_at + interval '1' day * 30 end as item_end_date,
  case when k % 29 = 0 then null else embedding end as embedding, now_ts
from (
  select *, greatest(first_seen_at, now_ts - interval '1' hour * cast(case when k % 5 = 0 then k % 3 else k % 1013 end as int)) as last_seen_at
  from (
    select *, posted_at + interval '1' day * cast(k % 3 as int) as first_seen_at
    from (
      select o.o_orderkey as k, p.*, e.embedding, timestamp '2024-07-01 00:00:00' as now_ts,
        timestamp '2024-01-01 00:00:00' + interval '1' day * cast(o.o_orderkey % 167 as int) as posted_at,
        case o.o_orderstatus when 'F' then 'likely_sold' when 'O' then 'active' else 'stale' end as status
      from {orders} o
      join {part} p on p.p_partkey = o.o_orderkey % (select count(*) from {part})
      join {embeddings} e on e.vec_id = cast(floor(o.o_orderkey / 3) as bigint) % (select count(*) from {embeddings})
    ) a
  ) b
) c
"""
#: The same as a common table expression over DuckDB's views, to put in front of a query.
WITH_LISTING = "with listing as (" + LISTING.format(orders="orders", part="part", embeddings="embeddings").replace("as string)", "as varchar)") + ")\n"
#: Comparable rows: one whole working product at one price.
COMPARABLE = "lot_size is null and not has_defect and not is_accessory and not price_is_from"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTING, **{t: table(spark, sf_dir, t) for t in ("orders", "part", "embeddings")})


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; a machine's own only where the session runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{at}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new shared folder, computed once."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
