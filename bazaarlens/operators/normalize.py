"""Raw marketplace JSON to listing rows, by column expressions over nested data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import extract

#: Fixed values of the source's search pages.
ITEM = (
    "itemId string, title string, itemWebUrl string, price struct<value: string, currency: string>, image struct<imageUrl: string>, additionalImages array<struct<imageUrl: string>>, "
    "itemLocation struct<city: string, stateOrProvince: string, country: string>, condition string, epid string, categories array<struct<categoryId: string, categoryName: string>>, buyingOptions array<string>, "
    "seller struct<username: string, feedbackScore: int, feedbackPercentage: string>, qualifiedPrograms array<string>, shippingOptions array<struct<shippingCostType: string, shippingCost: struct<value: string, currency: string>>>, "
    "itemCreationDate string, bidCount int, itemEndDate string"
)
BODY = ITEM + ", localizedAspects array<struct<type: string, name: string, value: string>>, estimatedAvailabilities string"
AVAILABILITY = "struct<estimatedAvailabilityStatus: string, estimatedAvailableQuantity: string, estimatedSoldQuantity: string>"
#: Conditions of things that are not new.
USED_CONDITIONS = ("2000", "2010", "2020", "2030", "2500", "3000", "4000", "5000", "6000", "7000")
CAPTURE_SOURCES = ("depop", "facebook")


def cheapest_shipping(options: Column) -> tuple[Column, Column]:
    """(cost, estimated): the least fixed cost, else the least calculated one, else unknown. 0 is a cost; unreadable ones are none."""
    costs = lambda calculated: F.array_min(F.transform(F.filter(options, lambda o: (F.coalesce(o["shippingCostType"], F.lit("")) == "CALCULATED") == F.lit(calculated)), lambda o: o["shippingCost"]["value"].try_cast("double")))
    fixed, calculated = costs(False), costs(True)
    return F.coalesce(fixed, calculated), fixed.isNull() & calculated.isNotNull()


def lenient_timestamp(text: Column) -> Column:
    """An ISO time, with Z or an offset; null for anything else."""
    return F.try_to_timestamp(text)


def flat_aspects(aspects: Column) -> Column:
    """[{name, value}] as a map: pairs with an empty side are skipped, the last of equal names wins, an empty map is null."""
    pairs = F.filter(aspects, lambda a: (F.coalesce(a["name"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != ""))
    names = F.array_distinct(F.transform(pairs, lambda a: a["name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda a: a["name"] == n), -1)["value"])
    return F.when(F.size(names) > 0, F.map_from_arrays(names, last))


def availabilities(raw: Column) -> Column:
    """The field as an array, whether it was a list or one object; empty for any other shape."""
    listed = F.from_json(raw, f"array<{AVAILABILITY}>")
    return F.when(raw.startswith("["), listed).when(raw.startswith("{"), F.array(F.from_json(raw, AVAILABILITY))).otherwise(F.array().cast(f"array<{AVAILABILITY}>"))


def has_ended(raw: Column, end: Column, now: Column) -> Column:
    """Out of stock, none left, or past its end. Unknown shapes and times are no sign of an end."""
    gone = F.exists(availabilities(raw), lambda a: F.coalesce(a["estimatedAvailabilityStatus"] == "OUT_OF_STOCK", F.lit(False)) | F.coalesce(a["estimatedAvailableQuantity"].try_cast("int") == 0, F.lit(False)))
    return F.coalesce(gone, F.lit(False)) | F.coalesce(lenient_timestamp(end) <= now, F.lit(False))


def max_sold(raw: Column) -> Column:
    return F.array_max(F.transform(availabilities(raw), lambda a: a["estimatedSoldQuantity"].try_cast("int")))


def image_urls(first: Column, more: Column) -> Column:
    urls = F.concat(F.array(first), F.coalesce(F.transform(more, lambda m: m["imageUrl"]), F.array().cast("array<string>")))
    return F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != "")


def larger_image(url: Column, size: int = 1600) -> Column:
    """The size part of an image address before its file type, replaced; other addresses as they are."""
    return F.regexp_replace(url, r"(?i)s-l\d+(?=\.(?:jpg|jpeg|png|webp)$)", f"s-l{size}")


def joined_place(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def normalised(items: DataFrame, now: Column) -> DataFrame:
    """Items of search pages (with the schema ITEM) as listing rows. Whether an item is good till cancelled stays unknown."""
    cost, estimated = cheapest_shipping(F.col("shippingOptions"))
    has = lambda what: F.coalesce(F.array_contains("buyingOptions", what), F.lit(False))
    category = F.get("categories", F.lit(0))
    return items.select(
        F.lit("ebay").alias("source"), F.col("itemId").alias("source_id"), "title", F.col("price.value").try_cast("double").alias("price"), F.coalesce("price.currency", F.lit("USD")).alias("currency"),
        cost.alias("shipping_cost"), estimated.alias("shipping_estimated"), has("AUCTION").alias("is_auction"), has("BEST_OFFER").alias("accepts_best_offer"), F.col("bidCount").alias("bid_count"),
        image_urls(F.col("image.imageUrl"), F.col("additionalImages")).alias("images"), joined_place(F.col("itemLocation.city"), F.col("itemLocation.stateOrProvince"), F.col("itemLocation.country")).alias("location"),
        "condition", category["categoryName"].alias("category"), category["categoryId"].alias("category_id"), "epid", F.col("itemWebUrl").alias("url"), F.col("qualifiedPrograms").alias("qualified_programs"),
        F.col("seller.feedbackScore").alias("seller_feedback_score"), F.col("seller.feedbackPercentage").try_cast("double").alias("seller_feedback_percent"),
        F.lit(None).cast("boolean").alias("is_gtc"), lenient_timestamp(F.col("itemCreationDate")).alias("posted_at"), now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit("active").alias("status"),
    )


def enriched(listing: DataFrame, bodies: DataFrame) -> DataFrame:
    """``listing`` with what item bodies (source_id and the schema BODY) add; rows without a body stay as they are.

    Aspects overwrite if there are any; category id, catalogue id and end date only fill; sold quantity and bids
    overwrite if given. With an end date a listing is not good till cancelled; without one it is, unless an auction.
    """
    b = bodies.select(F.col("itemId").alias("source_id"), flat_aspects(F.col("localizedAspects")).alias("b_aspects"), F.get("categories", F.lit(0))["categoryId"].alias("b_category"), F.col("epid").alias("b_epid"), lenient_timestamp(F.col("itemEndDate")).alias("b_end"), max_sold(F.col("estimatedAvailabilities")).alias("b_sold"), F.col("bidCount").alias("b_bids"), F.lit(True).alias("b_here"))
    rows = listing.join(b, "source_id", "left")
    gtc = F.when(F.col("b_here").isNull(), F.col("is_gtc")).when(F.col("b_end").isNotNull(), False).when(~F.col("is_auction"), True).otherwise(F.col("is_gtc"))
    new = {"aspects": F.coalesce("b_aspects", "aspects"), "category_id": F.coalesce("category_id", "b_category"), "epid": F.coalesce("epid", "b_epid"), "item_end_date": F.coalesce("item_end_date", "b_end"), "sold_quantity": F.coalesce("b_sold", "sold_quantity"), "bid_count": F.coalesce("b_bids", "bid_count"), "is_gtc": gtc}
    return rows.withColumns(new).select(listing.columns)


def used_only(listing: DataFrame, column: str = "condition_id") -> DataFrame:
    return listing.filter(F.col(column).isin(*USED_CONDITIONS))


def captures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with a reason): captured rows of a known source with a price over 0 and an id, title and address."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    clean = rows.withColumn("source", F.lower(text("source")))
    for c in ("source_id", "title", "url"):
        clean = clean.withColumn(c, text(c))
    reason = F.when(~F.col("source").isin(*CAPTURE_SOURCES), "source").when(F.coalesce(F.col("price"), F.lit(0.0)) <= 0, "price").when(F.col("source_id") == "", "source_id").when(F.col("title") == "", "title").when(F.col("url") == "", "url")
    clean = clean.withColumn("reason", reason)
    return clean.filter("reason is null").drop("reason"), clean.filter("reason is not null")


def capture_attributes(brand: Column, size: Column, seller: Column) -> Column:
    """Those of Brand, Size and Seller that are given, as a map; null if none is."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("Brand", brand), ("Size", size), ("Seller", seller))]), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def captured_listing(good: DataFrame, now: Column) -> DataFrame:
    """Good captured rows as listing rows: no category, not an auction, not good till cancelled, seen now.

    Titles are read at once, with what the page says about size and brand, as a capture is matched right away. A brand
    is no category.
    """
    rows = good.select(
        "source", "source_id", "title", "price", F.coalesce("currency", F.lit("USD")).alias("currency"), "shipping_cost", F.lit(False).alias("shipping_estimated"), F.lit(False).alias("is_auction"), F.lit(False).alias("accepts_best_offer"),
        F.coalesce("images", F.array().cast("array<string>")).alias("images"), "location", "condition", F.lit(None).cast("string").alias("category"), "url", capture_attributes(F.col("brand"), F.col("size"), F.col("seller")).alias("aspects"),
        F.lit(False).alias("is_gtc"), now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit("active").alias("status"),
    )
    return extract.extracted(rows, condition=None, aspects="aspects").drop("usable_as_comp")
