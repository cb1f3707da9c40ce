"""Reports on how alike the prices of comparable sets are, and on coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.stats import nearest_rank, ranked, upper_median, upper_medians

MIN_GROUP, MIN_TRIMMED, WORST, THIN_POOL = 5, 5, 5, 20


QUANTILES = {"p10": 0.1, "p90": 0.9}


def _spreads(q: DataFrame, keys: list[str]) -> DataFrame:
    return q.select(*keys, "n", "median", F.when(F.col("n") >= 2, F.col("hi") / F.col("lo")).alias("spread"), F.when((F.col("n") >= MIN_TRIMMED) & (F.col("p10") > 0), F.col("p90") / F.col("p10")).alias("trimmed"))


def group_spreads(rows: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    """By group of positive values: n, median, max/min (from two rows on) and p90/p10 (from five rows on)."""
    return _spreads(nearest_rank(rows.filter(F.col(value) > 0), keys, value, QUANTILES), keys)


def reported(groups: DataFrame, by: str, min_group: int = MIN_GROUP) -> DataFrame:
    """A row for each ``by`` over its groups (n, spread, trimmed) of at least ``min_group``: their number and rows, and the median and worst of both spreads.

    The medians are those of counted spreads, so they do not need all groups in one task's memory.
    """
    g = groups.filter(F.col("n") >= min_group)
    each = [g.groupBy(by, F.lit(which).alias("which"), F.col(which).alias("value")).agg(F.count("*").alias("times"), F.sum("n").alias("rows")) for which in ("spread", "trimmed")]
    counted = each[0].unionByName(each[1])
    sizes = each[0].groupBy(by).agg(F.sum("times").alias("groups"), F.sum("rows").alias("rows"))
    of = ranked(counted, [by, "which"], "value", "times", {}).groupBy(by).agg(*[F.max(F.when(F.col("which") == which, F.col(c))).alias(f"{name}_{which}") for which in ("spread", "trimmed") for c, name in (("median", "median"), ("hi", "worst"))])
    return sizes.join(of, by, "left")


def spread_report(rows: DataFrame, keys: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """One row over groups of at least ``min_group``: their number and rows, and the median and worst of both spreads."""
    return reported(group_spreads(rows, keys).withColumn("__all", F.lit(1)), "__all", min_group).drop("__all")


def worst_groups(rows: DataFrame, keys: list[str], min_group: int = MIN_GROUP, n: int = WORST) -> DataFrame:
    return group_spreads(rows, keys).filter(F.col("n") >= min_group).orderBy(F.desc("spread"), *keys).limit(n)


GROUPINGS = {"category": ["category"], "memory": ["capacity_gb", "spec_generation", "form_factor"], "model_key": ["model_key"], "category_model": ["category", "model_key"]}


def four_groupings(rows: DataFrame, value: str = "price") -> DataFrame:
    """The report for four ways to group, from one pass over the rows; rows that lack a key are left out of that grouping.

    Values are counted once under all groupings (grouping sets), so what is shuffled is counts of distinct values.
    """
    keys = list(dict.fromkeys(k for by in GROUPINGS.values() for k in by))
    sets = [[F.col(k) for k in (*by, value)] for by in GROUPINGS.values()]
    mask = {sum(1 << len(keys) - i for i, k in enumerate(keys) if k not in by): (name, by) for name, by in GROUPINGS.items()}
    counted = rows.filter(F.col(value) > 0).groupingSets(sets, *keys, value).agg(F.count("*").alias("__n"), F.grouping_id(*keys, value).alias("__set"))
    name, known = F.lit(None).cast("string"), F.lit(False)
    for bits, (grouping, by) in mask.items():
        here = F.col("__set") == bits
        name = F.when(here, grouping).otherwise(name)
        stated = F.lit(True)
        for k in by:
            stated = stated & F.col(k).isNotNull()
        known = known | here & stated
    own = ["grouping", *keys]
    groups = _spreads(ranked(counted.filter(known).withColumn("grouping", name), own, value, "__n", QUANTILES), own)
    return reported(groups, "grouping")


def bucket_spread(rows: DataFrame, bucket: str, value: str = "price") -> DataFrame:
    """By bucket, the unstated one too: n, upper median and max/min."""
    g = upper_medians(rows.filter(F.col(value) > 0), [bucket], [value])
    return g.select(bucket, "n", F.col(f"{value}_median").alias("median"), F.when(F.col("n") >= 2, F.col(f"{value}_hi") / F.col(f"{value}_lo")).alias("spread"))


def bucket_report(rows: DataFrame, which: str, bucket: str, value: str = "price") -> DataFrame:
    """How alike values are inside the buckets of each rule (``which``): buckets, values without one, and both spreads' upper median, worst and overall.

    A rule has as many buckets as there are capacities, so their spreads are a short list; the values are only counted.
    """
    some = rows.filter(F.col(value).isNotNull())
    sizes = some.groupBy(which).agg(F.count_distinct(bucket).alias("buckets"), F.count_if(F.col(bucket).isNull()).alias("unstated"))
    each = group_spreads(some.filter(F.col(bucket).isNotNull()), [which, bucket], value)
    kinds = ("spread", "trimmed")
    of = each.groupBy(which).agg(*[f for c in kinds for f in (upper_median(F.collect_list(c)).alias(f"median_{c}"), F.max(c).alias(f"worst_{c}"))])
    overall = group_spreads(some, [which], value).select(which, *[F.col(c).alias(f"overall_{c}") for c in kinds])
    return sizes.join(of, which, "left").join(overall, which, "left")


def coverage(rows: DataFrame, by: str = "category", more: tuple[str, ...] = ()) -> DataFrame:
    """Shares of rows with a catalogue id, shipping, model key and ``more`` columns, of auctions and best offers: by category, and in all (null)."""
    known = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    return rows.rollup(by).agg(F.count("*").alias("n"), known("epid").alias("epid"), known("shipping_cost").alias("shipping"), known("model_key").alias("model_key"), *[known(c).alias(c) for c in more], F.avg(F.col("is_auction").cast("int")).alias("auctions"), F.avg(F.col("accepts_best_offer").cast("int")).alias("offers"))


def thin_pools(rows: DataFrame, keys: list[str], least: int = THIN_POOL) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") < least)


def rule_change(rows: DataFrame, before: str, after: str, by: str, top: int = 10) -> DataFrame:
    """Where a rule changes a value: the ten categories with most changes, their number and rate."""
    g = rows.groupBy(by).agg(F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"), F.count("*").alias("n"))
    return g.filter("changed > 0").orderBy(F.desc("changed"), by).limit(top).withColumn("rate", F.col("changed") / F.col("n"))


def rule_rate(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many values a rule changes, of how many, and the rate (0 of none)."""
    out = rows.agg(F.count_if(~F.col(before).eqNullSafe(F.col(after)) & F.col(after).isNotNull()).alias("changed"), F.count("*").alias("n"))
    return out.withColumn("rate", F.col("changed") / F.greatest(F.col("n"), F.lit(1)))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in an order that a seed and the key decide: the same ones whatever the layout, and a top-k, not a sort."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)
