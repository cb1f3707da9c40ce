"""What a title says about the thing on offer, as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import vocabulary as v

#: Letters of either case match, and classes and word bounds are those of Unicode.
FLAGS = "(?iU)"
FIELDS = ("lot_size", "completeness", "has_defect", "is_accessory", "price_is_from", "capacity_gb", "spec_generation", "form_factor", "model_key")
INT = "array<int>"


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp(text, F.lit(FLAGS + pattern)), F.lit(False))


def group(text: Column, pattern: str, n: int = 0) -> Column:
    """A group of the first match; null where it does not take part."""
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, n), F.lit(""))


def every(text: Column, pattern: str, n: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(n)), F.array().cast("array<string>"))


def with_groups(text: Column, pattern: str, n: int, use: Callable[[list[Column | None]], Column]) -> Column:
    """``use`` of the n groups of the first match (by number, null where one takes no part); null without a match.

    All groups come from one replacement, however often ``use`` names them. The groups must not match U+0001.
    """
    all_groups = F.regexp_replace(text, FLAGS + rf"^[\s\S]*?(?:{pattern})[\s\S]*", "\x01".join(f"${i}" for i in range(1, n + 1)))
    used = F.transform(F.array(F.split(all_groups, "\x01")), lambda g: use([None, *[F.nullif(F.get(g, i), F.lit("")) for i in range(n)]]))
    return F.when(has(text, pattern), F.get(used, 0))


def any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in tokens])


def lots(title: Column, category: Column) -> Column:
    """Stated number from 2 on; a smaller stated one means no lot; lot words and lot categories mean 2 at least."""
    stated = F.when(has(title, v.LOT_COUNTS), F.coalesce(*[group(title, v.LOT_COUNTS, n) for n in range(1, 6)]).try_cast("int"))
    return F.coalesce(F.when(stated >= 2, stated), F.when(stated.isNull() & has(title, v.LOT_WORDS), 2), F.when(any_of(category, v.LOT_CATEGORIES), 2))


def completeness(title: Column) -> Column:
    """Bare before bundle before complete; null is unstated. Two different accessories listed mean complete."""
    listed = F.array_distinct(F.transform(every(title, rf"\b(?:{v.ACCESSORIES})\b"), lambda x: F.lower(F.replace(x, F.lit("-"), F.lit(" ")))))
    whole = has(title, v.INCLUDES) | has(title, v.PLUS) | (F.size(listed) >= 2)
    return F.when(has(title, v.BARE) | has(title, v.MISSING), "bare").when(has(title, v.BUNDLE), "bundle").when(whole, "complete")


def defect(title: Column, category: Column, condition: Column) -> Column:
    """Seller's condition, defect words, missing parts of a component, cracks unless denied, dead on arrival."""
    component = any_of(category, v.COMPONENT_CATEGORIES)
    words = has(title, v.DEFECTS)
    alone = component & ~has(title, v.MACHINES) & has(title, v.MISSING)
    crack = has(title, v.CRACK) & ~has(title, v.CRACK_DENIED)
    return has(F.coalesce(condition, F.lit("")), v.CONDITION_DEFECTS) | words | (component & has(title, v.MISSING_AFTER)) | alone | crack | has(title, v.DOA)


def gigabytes(number: Column, unit: Column) -> Column:
    return number.try_cast("int") * F.when(F.upper(unit) == "TB", 1024).otherwise(1)


def _plausible(values: Column) -> Column:
    return F.filter(values, lambda x: (x > 0) & (x <= v.MAX_CAPACITY_GB))


def capacities(title: Column) -> Column:
    """All capacities with a unit of their own, in GB."""
    both = F.zip_with(every(title, v.CAPACITY, 1), every(title, v.CAPACITY, 2), gigabytes)
    return F.when(F.lower(title).rlike("[gt]b"), _plausible(both)).otherwise(F.array().cast(INT))


def shared_unit_capacities(title: Column) -> Column:
    """Capacities of slash lists with one unit, where all numbers are powers of two from 4 on."""

    def of(numbers: Column, unit: Column) -> Column:
        each = F.transform(F.split(numbers, r"\s*/\s*"), lambda x: x.try_cast("int"))
        good = F.forall(each, lambda x: (x >= 4) & (x.bitwiseAND(x - 1) == 0))
        values = F.transform(each, lambda x: x * F.when(F.upper(unit) == "TB", 1024).otherwise(1))
        return F.when(good & F.forall(values, lambda x: x <= v.MAX_CAPACITY_GB), values).otherwise(F.array().cast(INT))

    lists = F.flatten(F.zip_with(every(title, v.SHARED_UNIT, 1), every(title, v.SHARED_UNIT, 2), of))
    return F.when(F.contains(title, F.lit("/")), lists).otherwise(F.array().cast(INT))


def kits(title: Column, category: Column) -> Column:
    """(total, modules) of kits such as 2x16GB: two to eight modules, in titles about memory or storage, not of whole machines."""
    pair = lambda n, size: F.struct((n.try_cast("int") * size).alias("total"), n.try_cast("int").alias("modules"))
    first = F.zip_with(every(title, v.KIT_COUNT_FIRST, 1), F.zip_with(every(title, v.KIT_COUNT_FIRST, 2), every(title, v.KIT_COUNT_FIRST, 3), gigabytes), pair)
    second = F.zip_with(every(title, v.KIT_SIZE_FIRST, 3), F.zip_with(every(title, v.KIT_SIZE_FIRST, 1), every(title, v.KIT_SIZE_FIRST, 2), gigabytes), pair)
    found = F.filter(F.concat(first, second), lambda x: x["modules"].between(2, v.MAX_MODULES) & (x["total"] > 0) & (x["total"] <= v.MAX_CAPACITY_GB))
    return F.when(has(title, v.STORAGE_WORDS) & ~any_of(category, v.MACHINE_CATEGORIES), found).otherwise(F.array().cast("array<struct<total:int,modules:int>>"))


ASPECTS = ("Storage Capacity", "Capacity", "RAM Size", "Total Capacity")


def capacity(title: Column, category: Column, aspects: Column | None = None, kit: Column | None = None, stated: Column | None = None) -> Column:
    """Greatest stated capacity or kit total, else that of the aspects. ``kit`` and ``stated`` are ``kits`` and ``capacities`` where they are at hand."""
    kit, stated = kits(title, category) if kit is None else kit, capacities(title) if stated is None else stated
    own = F.greatest(F.array_max(stated), F.array_max(F.transform(kit, lambda x: x["total"])))
    if aspects is None:
        return own
    return F.coalesce(own, *[F.array_max(capacities(F.coalesce(F.element_at(aspects, k), F.lit("")))) for k in ASPECTS])


def generation(title: Column) -> Column:
    bus = F.coalesce(group(title, v.GENERATION, 2), group(title, v.GENERATION, 3))
    return F.when(has(title, v.GENERATION), F.coalesce(F.upper(group(title, v.GENERATION, 1)), F.concat(F.lit("PCIE"), bus)))


def form_factor(title: Column) -> Column:
    return F.when(has(title, v.STORAGE_WORDS), F.coalesce(*[F.when(has(title, p), name) for name, p in v.FORM_FACTORS]))


def _joined(*parts: Column) -> Column:
    """Parts in small letters without blanks, by hyphens; null unless the second is there."""
    small = [F.replace(F.regexp_replace(F.lower(p), r"(?U)\s+", ""), F.lit("+"), F.lit("plus")) for p in parts]
    return F.when(parts[1].isNotNull(), F.concat_ws("-", *small))


def gpu_key(title: Column) -> Column:
    return with_groups(title, v.GPU, 3, lambda g: _joined(*g[1:]))


def cpu_key(title: Column) -> Column:
    intel = with_groups(title, v.CPU_INTEL, 3, lambda g: F.lower(F.concat(g[1], F.lit("-"), g[2], F.coalesce(g[3], F.lit("")))))
    amd = with_groups(title, v.CPU_AMD, 4, lambda g: F.lower(F.concat(F.lit("ryzen-"), F.coalesce(g[1], g[3]), F.coalesce(g[2], g[4], F.lit("")))))
    return F.when(has(title, v.CPU_WORDS), F.coalesce(intel, amd))


def console_key(title: Column, category: Column) -> Column:
    def key(g: list[Column]) -> Column:
        return F.coalesce(
            F.when(g[1].isNotNull(), "switch-2"), F.concat(F.lit("switch-"), F.lower(F.coalesce(g[2], g[3]))), F.when(g[4].isNotNull(), "switch"),
            F.concat(F.lit("ps"), F.coalesce(g[5], g[6])), F.concat(F.lit("xbox-series-"), F.lower(g[7])), F.when(g[8].isNotNull(), "xbox-one"),
        )

    return F.when(~any_of(category, v.PLATFORM_CATEGORIES), with_groups(title, v.CONSOLE, 8, key))


def phone_key(title: Column) -> Column:
    def key(g: list[Column]) -> Column:
        return F.coalesce(
            F.concat(F.lit("iphone-"), g[1], F.lit("e")), _joined(F.lit("iphone"), g[3], g[4]), _joined(F.lit("iphone"), g[5]),
            _joined(F.lit("galaxy"), F.concat(g[6], g[7]), g[8]), _joined(F.lit("pixel"), g[9], g[10]),
        )

    return with_groups(title, v.PHONE, 10, key)


def model_key(title: Column, category: Column) -> Column:
    return F.coalesce(gpu_key(title), cpu_key(title), console_key(title, category), phone_key(title))


def accessory(title: Column, category: Column, key: Column | None = None) -> Column:
    """The evidence that something is a part for the product and not the product; null where there is none.

    ``key`` is ``model_key`` where that is at hand.
    """
    key = model_key(title, category) if key is None else key
    no_product = F.when(~has(F.concat_ws(" ", title, category), v.MACHINES), group(title, v.NOT_THE_PRODUCT))
    only = F.coalesce(group(title, rf"\b(?:{v.ONLY_NOUNS})\b[^,]{{0,24}}\bonly\b|\bonly\b[^,]{{0,24}}\b(?:{v.ONLY_NOUNS})\b"), group(title, rf"\b(?:{v.ACCESSORY_NOUNS})\b[^,]{{0,30}}\bonly\b"))
    packaging = F.when(has(title, v.PACKAGING), group(title, v.CONTENTS_ABSENT))
    purpose = has(title, v.FOR)
    strong = F.when(purpose | key.isNotNull(), group(title, rf"(?<!{v.INCLUSIONS}.{{0,28}})\b(?:{v.STRONG_ACCESSORIES})\b"))
    weak = F.when(purpose, F.coalesce(group(title, rf"\b(?:{v.ACCESSORY_NOUNS})\b"), group(title, v.SUBJECTS)))
    after = group(title, v.CONSOLE_ACCESSORY, 1)
    before = F.call_function("substring_index", F.lower(title), F.lower(after), F.lit(1))
    console = F.when(after.isNotNull() & ~has(title, v.BUNDLE) & ~has(before, v.INCLUSIONS), after)
    return F.coalesce(F.when(any_of(category, v.ACCESSORY_CATEGORIES), F.concat(F.lit("category:"), category)), no_product, only, packaging, strong, weak, console)


def price_is_from(title: Column, category: Column, stated: Column | None = None) -> Column:
    """Several variants at the price of the cheapest: variant words, colours of phones, or capacities side by side."""
    n = F.size(F.array_union(capacities(title) if stated is None else stated, shared_unit_capacities(title)))
    colours = any_of(category, v.PHONE_CATEGORIES) & has(title, v.COLOUR_LIST)
    return has(title, v.VARIANTS) | (~any_of(category, v.MACHINE_CATEGORIES) & (colours | (n >= 3) | ((n == 2) & any_of(category, v.ONE_CAPACITY_CATEGORIES))))


def signals(title: Column, category: Column, evidence: Column | None = None, kit: Column | None = None) -> Column:
    """What else the title says: read notes, first four negations, sealed, accessory evidence, kit.

    ``evidence`` and ``kit`` are ``accessory`` and ``kits`` where these are at hand.
    """
    kit = F.array_max(kits(title, category) if kit is None else kit)
    evidence = accessory(title, category) if evidence is None else evidence
    entry = lambda k, x: F.struct(F.lit(k).alias("key"), x.cast("string").alias("value"))
    negated = F.slice(every(title, v.NEGATIONS, 1), 1, 4)
    pairs = F.array(
        entry("seller_says_read", F.when(has(title, v.READ), "true")), entry("negations", F.nullif(F.array_join(negated, ","), F.lit(""))), entry("sealed_or_new", F.when(has(title, v.SEALED), "true")),
        entry("accessory", evidence), entry("kit", F.concat_ws("x", kit["modules"], kit["total"])),
    )
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull() & (x["value"] != "")))


def extracted(df: DataFrame, title: str = "title", category: str = "category", condition: str | None = "condition", aspects: str | None = None) -> DataFrame:
    """``df`` with the nine derived fields, the signals and usable_as_comp.

    What several of them rest on (model key, kits, capacities, accessory evidence) is a column of an earlier
    projection, so that its patterns are matched once a row; there is no shuffle and no Python.
    """
    t, c = F.coalesce(F.col(title), F.lit("")), F.col(category)
    state = F.col(condition) if condition else F.lit("")
    read = ("__key", "__kits", "__stated", "__evidence")
    key, kit, stated, evidence = (F.col(x) for x in read)
    base = df.withColumns({"__key": model_key(t, c), "__kits": kits(t, c), "__stated": capacities(t)}).withColumn("__evidence", accessory(t, c, key))
    out = base.withColumns(
        {
            "lot_size": lots(t, c), "completeness": completeness(t), "has_defect": defect(t, c, state), "is_accessory": evidence.isNotNull(), "price_is_from": price_is_from(t, c, stated),
            "capacity_gb": capacity(t, c, F.col(aspects) if aspects else None, kit, stated), "spec_generation": generation(t), "form_factor": form_factor(t), "model_key": key, "variant_signals": signals(t, c, evidence, kit),
        }
    ).drop(*read)
    return out.withColumn("usable_as_comp", F.col("lot_size").isNull() & ~F.col("has_defect") & ~F.col("is_accessory") & ~F.col("price_is_from"))


def only_new(df: DataFrame) -> DataFrame:
    """Listings whose titles were never read; an empty map means read, and nothing found."""
    return df.filter(F.col("variant_signals").isNull())


def report(after: DataFrame, before: str = "before") -> DataFrame:
    """One row: processed, lots, defects, accessories, from-prices, by completeness, changed rows, and the sum excluded.

    ``after`` has the derived fields, and those from before in a struct.
    """
    n = F.count_if
    rows = after.withColumn("changed", ~F.struct(*FIELDS).eqNullSafe(F.col(before)))
    out = rows.agg(F.count("*").alias("processed"), n(F.col("lot_size").isNotNull()).alias("lots"), n("has_defect").alias("defects"), n("is_accessory").alias("accessories"), n("price_is_from").alias("multi_variant"), *[n(F.col("completeness") == x).alias(x) for x in ("bare", "complete", "bundle")], n("changed").alias("changed"))
    return out.withColumn("excluded_from_comps", F.col("lots") + F.col("defects") + F.col("accessories") + F.col("multi_variant"))
