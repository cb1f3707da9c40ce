"""Pattern matches with code-point offsets, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of text kept on each side of a match as its context.
CONTEXT = 24


def _found(text: Column, kind: int, pattern: str, need: Column) -> Column:
    """Leftmost non-overlapping matches: array of (kind, at, gap, match, left, right).

    Splitting by the pattern gives the gaps between the matches, extracting gives the matches; ``gap`` is the number
    of code points between a match and the one before it. ``need`` is a cheap test that holds wherever the pattern can
    match; other texts are not searched.
    """
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(gaps, 2, 1 << 30).alias("r"))
    rows = F.transform(
        each,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.char_length(x["g"]).cast("long").alias("gap"), x["m"].alias("match"),
            F.right(x["g"], F.lit(CONTEXT)).alias("left"), F.left(x["r"], F.lit(CONTEXT)).alias("right"),
        ),
    )
    return F.when(need, F.filter(rows, lambda x: x["match"].isNotNull()))


def matches(docs: DataFrame, patterns: list[tuple[str, Column]]) -> DataFrame:
    """Rows (rid, id, kind, start, end, match, left, right) of ``docs`` (id, text); kind is the pattern's place in the list.

    Every document has at least one row; where nothing matches, it is one with a null kind. ``rid`` tells rows with
    equal ids apart. Only the matches are shuffled, by row and kind, to sum the gaps up to offsets.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "id", text.alias("text"))
    all_of = F.concat(*[F.coalesce(_found(F.col("text"), k, p, need), F.array()) for k, (p, need) in enumerate(patterns)])
    rows = base.select("rid", "id", F.explode_outer(all_of).alias("x")).select("rid", "id", "x.*")
    upto = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("match").cast("long")
    end = F.sum(F.col("gap") + size).over(upto)
    return rows.select("rid", "id", "kind", (end - size).alias("start"), end.alias("end"), "match", "left", "right")


def joined(rows: Column) -> Column:
    """``kind:start:end`` of an array of (name, start, end), comma-joined in its order."""
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
