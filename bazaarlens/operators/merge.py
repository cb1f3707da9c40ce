"""Upserts by per-column policies, and change-only price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a re-sighting does to a stored column; columns not named here are never touched.
SEARCH_POLICY = {
    "overwrite": ("title", "price", "currency", "is_auction", "accepts_best_offer", "lot_size", "completeness", "has_defect", "is_accessory", "price_is_from", "capacity_gb", "spec_generation", "form_factor", "model_key", "variant_signals"),
    "if_given": ("epid", "bid_count", "seller_feedback_score", "seller_feedback_percent", "qualified_programs"),
    "pair": (("shipping_cost", "shipping_estimated"),),
    "fill": ("image_hash",),
}
#: A captured page says less: shipping only if given, and no derived fields. Other photos than before replace the photo's
#: hash and clear its vector, so that it is made anew.
CAPTURE_POLICY = {"overwrite": ("title", "price", "currency"), "if_given": ("shipping_cost", "aspects"), "pair": (), "fill": ("image_hash",), "photos": {"given": "images", "replaced": ("image_hash",), "cleared": ("embedding", "embedded_at")}}


def merged(column: str, policy: dict) -> Column:
    """A column of a matched row: stored ``s.`` under the policy for incoming ``n.``."""
    old, new = F.col(f"s.{column}"), F.col(f"n.{column}")
    if photos := policy.get("photos"):
        given = F.col(f"n.{photos['given']}")
        other = F.coalesce(F.size(given) > 0, F.lit(False)) & ~given.eqNullSafe(F.col(f"s.{photos['given']}"))
        if column in (photos["given"], *photos["replaced"]):
            return F.when(other, new).otherwise(F.coalesce(old, new) if column in policy["fill"] else old)
        if column in photos["cleared"]:
            return F.when(~other, old)
    if column in policy["overwrite"]:
        return new
    if column in policy["if_given"]:
        return F.coalesce(new, old)
    if column in policy["fill"]:
        return F.coalesce(old, new)
    for pair in policy["pair"]:
        if column in pair:
            return F.when(F.col(f"n.{pair[0]}").isNotNull(), new).otherwise(old)
    return old


def upsert(stored: DataFrame, incoming: DataFrame, now: Column, policy: dict = SEARCH_POLICY, key: tuple[str, ...] = ("source", "source_id"), revive: bool = True, compare_incoming: bool = False, first: Column | None = None) -> DataFrame:
    """The new snapshot: stored columns, plus created, updated, revived and price_changed.

    ``incoming`` has unique keys (see ``first_of_key``) and may lack stored columns. A sighting sets last_seen_at,
    clears missing_since and makes a stale row active; a likely sold row is never revived. A price observation is due
    when (price, shipping) differs between before and after the merge; with ``compare_incoming``, between before and
    what came in, so that unknown shipping counts as a change. ``first`` is when a new row was first seen, if not ``now``.
    """
    if policy.get("photos") and policy["photos"]["given"] not in stored.columns:
        policy = {k: v for k, v in policy.items() if k != "photos"}
    missing = [c for c in stored.columns if c not in incoming.columns]
    new = incoming.select(*incoming.columns, *[F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in missing])
    both = stored.withColumn("__s", F.lit(True)).alias("s").join(new.withColumn("__n", F.lit(True)).alias("n"), [F.col(f"s.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    was, came = F.col("s.__s").isNotNull(), F.col("n.__n").isNotNull()
    seen = was & came
    alive = seen & (F.col("s.status") == "stale") if revive else F.lit(False)
    special = {
        "last_seen_at": F.when(came, now).otherwise(F.col("s.last_seen_at")),
        "first_seen_at": F.when(was, F.col("s.first_seen_at")).otherwise(now if first is None else first),
        "missing_since": F.when(seen & F.lit(revive), F.lit(None)).when(was, F.col("s.missing_since")),
        "status": F.when(~was, "active").when(alive, "active").otherwise(F.col("s.status")),
    }
    value = lambda c: special[c] if c in special else F.when(seen, merged(c, policy)).when(was, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
    after = {c: value(c) for c in stored.columns}
    price, ship = ("n.price", "n.shipping_cost") if compare_incoming else (None, None)
    same = F.col("s.price").eqNullSafe(F.col(price) if price else after["price"]) & F.col("s.shipping_cost").eqNullSafe(F.col(ship) if ship else after["shipping_cost"])
    return both.select(*[after[c].alias(c) for c in stored.columns], (came & ~was).alias("created"), seen.alias("updated"), F.coalesce(alive, F.lit(False)).alias("revived"), (came & (~was | ~same)).alias("price_changed"))


def first_of_key(incoming: DataFrame, key: tuple[str, ...] = ("source", "source_id"), position: str = "position") -> DataFrame:
    """One row for each key, the one with the least position: a page that lists an item twice must not multiply it."""
    by = Window.partitionBy(*key).orderBy(position)
    return incoming.withColumn("__r", F.row_number().over(by)).filter("__r = 1").drop("__r")


def folded(incoming: DataFrame, key: tuple[str, ...], order: tuple[str, ...], policy: dict = SEARCH_POLICY) -> DataFrame:
    """One row for each key, which has the effect of all its rows upserted one after the other in ``order``.

    Columns to overwrite have their last value, those to take if given their last known one, those to fill their first
    known one, and all others what the first row says. A plain aggregation: rows of a key are combined before they are
    shuffled. ``__first`` and ``__last`` are the least and greatest of the first order column. Ties in ``order`` are
    settled by the values themselves.
    """
    at = F.struct(*order)
    pairs = {c: p[0] for p in policy["pair"] for c in p}

    def pick(c: str, newest: bool, known: bool) -> Column:
        if "map<" in incoming.schema[c].dataType.simpleString():  # maps have no order of their own
            by = F.when(F.col(c).isNotNull(), at) if known else at
            return F.max_by(c, by) if newest else F.min_by(c, by)
        row = F.struct(at, F.col(c))
        row = F.when(F.col(c).isNotNull(), row) if known else row
        return (F.max(row) if newest else F.min(row))[c]

    def value(c: str) -> Column:
        if c in policy["overwrite"] or c in policy["if_given"]:
            return pick(c, True, c in policy["if_given"])
        start = pick(c, False, c in policy["fill"])
        if c in pairs:
            given = F.max(F.when(F.col(pairs[c]).isNotNull(), F.struct(at, F.col(pairs[c]).alias("__led"), F.col(c).alias("__c"))))
            return F.when(given.isNotNull(), given["__c"]).otherwise(start)
        return start

    rest = [c for c in incoming.columns if c not in (*key, *order)]
    return incoming.groupBy(*key).agg(*[value(c).alias(c) for c in rest], F.min(order[0]).alias("__first"), F.max(order[0]).alias("__last"))


def counters(snapshot: DataFrame) -> DataFrame:
    """One row: inserted, updated, upserted, reactivated, price_changes (of rows that were there)."""
    n = lambda c: F.count_if(c)
    return snapshot.agg(n(F.col("created")).alias("inserted"), n(F.col("updated")).alias("updated"), n(F.col("created") | F.col("updated")).alias("upserted"), n(F.col("revived")).alias("reactivated"), n(F.col("price_changed") & F.col("updated")).alias("price_changes"))


def observations(snapshot: DataFrame, now: Column) -> DataFrame:
    """Price observations that an upsert makes: one for each new row, one for each change."""
    return snapshot.filter("price_changed").select("listing_id", "price", "shipping_cost", now.alias("observed_at"))


def changes(history: DataFrame, key: str = "listing_id", values: tuple[str, ...] = ("price",), order: tuple[str, ...] = ("observed_at", "tie")) -> DataFrame:
    """The rows of a history in which a value differs from the row before; the first row always does."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.row_number().over(w) > 1
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    return history.withColumn("__same", same).filter("not __same").drop("__same")


def search_health(runs: DataFrame) -> DataFrame:
    """One row from runs (search_id, failed, total, kept): searches run and failed, truncated, and whether the fault is systematic."""
    rows = runs.agg(F.count("*").alias("searches_run"), F.count_if("failed").alias("searches_failed"), F.count_if(~F.col("failed") & (F.col("total") > F.col("kept"))).alias("truncated"))
    return rows.withColumn("systematic", F.col("searches_failed") >= F.greatest(F.lit(2), F.floor(F.col("searches_run") / 2)))


def quarantined(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of searches that ran, searches set aside): one search's fault costs its own page only, and is told by id and reason."""
    failed = F.coalesce(F.col("failed"), F.lit(True))
    return runs.filter(~failed), runs.filter(failed).select("search_id", F.coalesce("reason", F.lit("unknown")).alias("reason"))


def enabled(searches: DataFrame) -> DataFrame:
    return searches.filter("enabled")


def bookkept(searches: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Saved searches after a run (runs: search_id, failed, total): those that ran get its time and total; others stay."""
    ran = runs.filter("not failed").select("search_id", F.col("total").cast("int").alias("__total"), F.lit(True).alias("__ran"))
    rows = searches.join(ran, "search_id", "left")
    return rows.withColumn("last_run_at", F.when(F.col("__ran"), now).otherwise(F.col("last_run_at"))).withColumn("last_result_total", F.coalesce("__total", "last_result_total")).drop("__total", "__ran")
