"""Listings that leave the market: retirement, checks in two strikes, relists and the two confidences of a sale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from bazaarlens.operators import extract, normalize

STALE_DAYS, UNSEEN_DAYS, ALIVE_S, BUDGET = 60, 30, 10_800, 700
RELIST_DAYS, QUICK_DAYS, END_HOURS, TERM_DAYS, TERM_SLACK = 21, 7.0, 12.0, 30, 2
SALE, PRICE = 0.75, 1.0
COMP_SOURCES = ("ebay",)


def days(n: int) -> Column:
    return F.expr(f"interval {n} days")


def seconds(t: Column) -> Column:
    """A timestamp's seconds, with or without time zone."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def retire(listing: DataFrame, now: Column, among: Column | None = None) -> DataFrame:
    """Active listings (``among`` those) first seen over 60 days and last seen over 30 days ago become stale; ``retired`` says which."""
    old = (F.lit(True) if among is None else among) & (F.col("status") == "active") & (F.col("first_seen_at") < now - days(STALE_DAYS)) & (F.col("last_seen_at") < now - days(UNSEEN_DAYS))
    return listing.withColumn("retired", old).withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def proven_alive(now: Column) -> Column:
    return F.col("last_seen_at") >= now - F.expr(f"interval {ALIVE_S} seconds")


def due(listing: DataFrame, now: Column, budget: int = BUDGET, sources: tuple[str, ...] = COMP_SOURCES) -> DataFrame:
    """The ``budget`` active listings most in need of a check: those with a strike, then least lately checked, then seen."""
    open_ = listing.filter((F.col("status") == "active") & F.col("source").isin(*sources) & ~proven_alive(now))
    return open_.orderBy(F.col("missing_since").isNull(), F.col("last_checked_at").asc_nulls_first(), "last_seen_at", "listing_id").limit(budget)


def checked(listing: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """``listing`` after one check each (checks: listing_id, ended): strike, confirm or recover; unchecked rows stay.

    A first failed check is a strike. A second confirms and the listing counts as likely sold; being alive clears it.
    """
    rows = listing.join(checks.select("listing_id", F.col("ended").alias("__ended")), "listing_id", "left")
    live, seen = F.col("status") == "active", F.col("__ended").isNotNull()
    strike = F.col("missing_since").isNotNull()
    change = F.when(live & seen & F.col("__ended") & strike, "confirmed").when(live & seen & F.col("__ended"), "strike").when(live & seen & strike, "recovered").when(live & seen, "alive")
    rows = rows.withColumn("change", change)
    since = F.when(F.col("change") == "strike", now).when(F.col("change") == "recovered", F.lit(None)).otherwise(F.col("missing_since"))
    return rows.withColumn("missing_since", since).withColumn("status", F.when(F.col("change") == "confirmed", "likely_sold").otherwise(F.col("status"))).withColumn("last_checked_at", F.when(F.col("change").isNotNull(), now).otherwise(F.col("last_checked_at"))).drop("__ended")


def fetched(asked: DataFrame, bodies: DataFrame, now: Column) -> DataFrame:
    """``asked`` listings after a look at their item bodies (itemId and the fields of BODY), with found and ended.

    A listing without a body is absent, which counts as ended, as does a body that is out of stock or past its end. A
    body is read first, ended or not: it fills in the listing, whose title is then read again with the new aspects.
    """
    here = bodies.select(F.col("itemId").alias("source_id"), F.lit(True).alias("found"), normalize.has_ended(F.col("estimatedAvailabilities"), F.col("itemEndDate"), now).alias("over"))
    rows = normalize.enriched(asked, bodies.join(asked.select(F.col("source_id").alias("itemId")), "itemId", "left_semi"))
    rows = rows.join(here, "source_id", "left").withColumn("found", F.coalesce("found", F.lit(False))).withColumn("ended", ~F.col("found") | F.coalesce("over", F.lit(False))).drop("over")
    keep = [c for c in (*extract.FIELDS, "variant_signals") if c in rows.columns]
    before = rows.withColumn("__before", F.struct(*keep)).drop(*extract.FIELDS, "variant_signals", "usable_as_comp")
    read = extract.extracted(before, aspects="aspects")
    return read.withColumns({c: F.when(F.col("found"), F.col(c)).otherwise(F.col(f"__before.{c}")) for c in keep}).select(*rows.columns)


def retired_of(listing: DataFrame, now: Column, sources: tuple[str, ...] = COMP_SOURCES) -> DataFrame:
    """``retire`` for the listings of the checked sources; the others stay as they are and are not retired."""
    return retire(listing, now, F.col("source").isin(*sources))


def market_metrics(now: Column, sources: tuple[str, ...] = COMP_SOURCES) -> list[Column]:
    """What a pass counts over all listings, once those to retire are retired."""
    open_ = (F.col("status") == "active") & F.col("source").isin(*sources)
    return [F.count_if(open_ & proven_alive(now)).alias("skipped_proven_alive"), F.count_if("retired").alias("retired_stale"), F.count_if(open_ & ~proven_alive(now)).alias("open")]


RUN_COUNTERS = ("checked", "marked_sold", "detected_relists", "enriched", "pending_confirmation", "recovered")


def run_metrics() -> list[Column]:
    """What a pass counts over the listings that it checked."""
    n, sold = F.count_if, F.col("change") == "confirmed"
    return [
        F.count(F.lit(1)).alias("checked"), n(sold).alias("marked_sold"), n(sold & F.col("relist_id").isNotNull()).alias("detected_relists"), n(F.col("found")).alias("enriched"),
        n(F.col("change") == "strike").alias("pending_confirmation"), n(F.col("change") == "recovered").alias("recovered"),
    ]


def check_run(listing: DataFrame, bodies: DataFrame, now: Column, budget: int = BUDGET, quota: int | None = None, sources: tuple[str, ...] = COMP_SOURCES, keep: Callable[[DataFrame], DataFrame] = lambda df: df, seen: Observation | None = None) -> DataFrame:
    """One pass: the ``budget`` listings that are due, checked while ``quota`` calls last, with found, ended, change and relist_id.

    Listings that nothing has shown for long are retired before the choice is made, so no call is spent on them.
    Confirmed ones are scored at once: sale_score, price_score and signals. ``keep`` writes a step's few rows, which
    several joins read, as a table and returns that; ``seen`` gathers ``market_metrics`` while the choice is made.
    """
    market = retired_of(listing, now, sources)
    counted = market.observe(seen, *market_metrics(now, sources)) if seen is not None else market
    asked = keep(due(counted, now, budget if quota is None else min(budget, quota), sources).drop("retired"))
    looked = keep(fetched(asked, bodies, now))
    rows = checked(looked.drop("found", "ended"), looked.select("listing_id", "ended"), now).join(looked.select("listing_id", "found", "ended"), "listing_id")
    sold = rows.filter("change = 'confirmed'")
    return scored(rows.join(relists(sold, market.drop("retired"), now), "listing_id", "left"), now).withColumns({c: F.when(F.col("change") == "confirmed", F.col(c)) for c in ("sale_score", "price_score", "signals")})


def counted_run(listing: DataFrame, bodies: DataFrame, now: Column, write: Callable[[DataFrame], DataFrame], budget: int = BUDGET, quota: int | None = None, sources: tuple[str, ...] = COMP_SOURCES) -> tuple[DataFrame, dict]:
    """(the rows of a pass as ``write`` keeps them, its nine counters): both come from the same jobs, nothing is read again to count.

    Without calls (``quota`` 0) nothing is checked, but listings are retired; without a budget nothing else is counted.
    """
    seen, ran = Observation("market"), Observation("run")
    asks = min(budget, quota) if quota is not None else budget
    rows = check_run(listing, bodies, now, budget, quota, sources, write, seen if asks > 0 else None)
    if asks > 0:
        done = write(rows.observe(ran, *run_metrics()))
        of_run, of_all = dict(ran.get), dict(seen.get)
    else:  # nothing is looked at: Spark would not run the rows' plan at all
        done, of_run = write(rows), {name: 0 for name in RUN_COUNTERS}
        of_all = retired_of(listing, now, sources).agg(*market_metrics(now, sources)).first().asDict()
    open_ = of_all.pop("open")
    if budget <= 0:
        of_all["skipped_proven_alive"] = 0
    return done, of_run | of_all | {"quota_exhausted": quota is not None and min(open_, budget) > quota}


def two_strikes(events: DataFrame) -> DataFrame:
    """A history of checks (listing_id, at, tie, ended) played through: rows with the state before and after each check.

    Only the run of failed checks since the last alive one matters, so it is a window: the second failed check in a
    row confirms, and whatever follows a confirmation is terminal.
    """
    order = Window.partitionBy("listing_id").orderBy("at", "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("__prior", F.coalesce(F.lag("ended").over(order), F.lit(False)))
    rows = rows.withColumn("__second", F.col("ended") & F.col("__prior"))
    terminal = F.coalesce(F.max("__second").over(before), F.lit(False))
    return rows.withColumn("change", F.when(terminal, "terminal").when(F.col("__second"), "confirmed").when(F.col("ended"), "strike").when(F.col("__prior"), "recovered").otherwise("alive")).drop("__prior", "__second")


def relists(sold: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Rows (listing_id, relist_id): the newest listing of the same source and photo, first seen in the last 21 days, that is not sold."""
    s = sold.filter(F.col("image_hash").isNotNull()).select("listing_id", "source", "image_hash")
    c = listing.filter((F.col("status") != "likely_sold") & (F.col("first_seen_at") >= now - days(RELIST_DAYS)) & F.col("image_hash").isNotNull())
    # the newest two of a photo are enough: one of them is another listing
    place = F.struct("first_seen_at", (-F.col("listing_id")).alias("back"))
    first = c.groupBy("source", "image_hash").agg(F.max(place).alias("m1"))
    second = c.join(first, ["source", "image_hash"]).filter(-F.col("listing_id") != F.col("m1.back")).groupBy("source", "image_hash").agg(F.max(place).alias("m2"))
    both = s.join(first, ["source", "image_hash"]).join(second, ["source", "image_hash"], "left")
    other = F.when(-F.col("m1.back") != F.col("listing_id"), -F.col("m1.back")).otherwise(-F.col("m2.back"))
    return both.select("listing_id", other.alias("relist_id")).filter("relist_id is not null")


def scored(sold: DataFrame, now: Column) -> DataFrame:
    """``sold`` (with relist_id) with sale_score, price_score and signals: did it sell, and at the recorded price?

    Each signal multiplies its score; both are kept in [0, 1]. An unknown end date is unknown, never "not ended". The
    direction of the price bias that an auction sets replaces that of best offers.
    """
    ended = F.coalesce("missing_since", now)
    at_end = F.when(~F.col("is_auction"), F.abs(seconds(ended) - seconds(F.col("item_end_date"))) / 3600 <= END_HOURS)
    life = (seconds(ended) - seconds(F.col("posted_at"))) / 86400
    rest = life % TERM_DAYS
    term = at_end.isNull() & (life >= TERM_DAYS - TERM_SLACK) & ((rest <= TERM_SLACK) | (rest >= TERM_DAYS - TERM_SLACK))
    quick = ~F.coalesce(term, F.lit(False)) & (life <= QUICK_DAYS)
    bids = F.when(F.col("is_auction"), F.col("bid_count"))
    by = lambda test, factor: F.when(test, factor).otherwise(1.0)
    sale = F.lit(SALE) * by(F.col("relist_id").isNotNull(), 0.15) * by(bids == 0, 0.05) * by(bids > 0, 1.5) * by(at_end, 0.4) * F.when(term, 0.5).when(quick, 1.2).otherwise(1.0)
    price = F.lit(PRICE) * by(F.col("accepts_best_offer"), 0.75) * by(F.col("is_auction"), 0.6) * F.when(F.col("shipping_cost").isNull(), 0.9).when(F.col("shipping_estimated"), 0.95).otherwise(1.0)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    flag = lambda test, name, what="true": F.when(test, F.struct(F.lit(name).alias("key"), F.lit(what).cast("string").alias("value")))
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    signals = F.array_compact(
        F.array(
            entry("relisted_as", F.col("relist_id")), entry("bid_count", bids), flag(bids == 0, "auction_no_bids"), flag(bids > 0, "auction_had_bids"), entry("ended_at_scheduled_end", at_end),
            entry("lifetime_days", F.bround(life, 1)), flag(term, "near_listing_term"), flag(term, "term_inferred"), flag(quick, "quick_disappearance"), flag(F.col("accepts_best_offer"), "accepts_best_offer"),
            flag(F.col("is_auction"), "is_auction"), F.when(F.col("is_auction"), F.struct(F.lit("price_bias").alias("key"), F.lit("under").alias("value"))).when(F.col("accepts_best_offer"), F.struct(F.lit("price_bias").alias("key"), F.lit("over").alias("value"))),
            flag(F.col("shipping_cost").isNull(), "shipping_unknown"), flag(F.col("shipping_cost").isNotNull() & F.col("shipping_estimated"), "shipping_estimated"),
        )
    )
    return sold.withColumn("sale_score", clamp(sale)).withColumn("price_score", clamp(price)).withColumn("signals", F.map_from_entries(signals))
