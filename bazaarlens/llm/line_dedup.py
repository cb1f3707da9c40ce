"""Removal of globally repeated multi-line chunks with content-defined boundaries. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import join_salted, join_sized, rows_of, written


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(text: Column) -> Column:
    """The text's chunks of whole lines, in order; joined by line ends they are the text again.

    The rolling hash before a line is that of the hashes of the two lines before it. A chunk starts where it is less
    than before the preceding line and not greater than before the next one, but not before the second line. That
    depends on four lines alone, so a passage of lines is cut alike wherever it stands; two boundaries are never next
    to each other, so all chunks but the last have two lines or more, and a run of one repeated line is never cut.

    Each line gets a tag, 1 where a chunk starts and 0 elsewhere. As every line end is then followed by a tag, the
    text can be split at those followed by 1 whatever it holds, in one pass and without random access.
    """

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.xxhash64(x))
        none = F.array(F.xxhash64(F.lit("")))
        pairs = F.arrays_zip(F.concat(none, hashes).alias("p"), F.concat(none, none, hashes).alias("q"))
        rolling = F.transform(pairs, lambda r: F.xxhash64(r["p"], r["q"]))  # before line 0, 1, ..., and two behind the end
        return _let(rolling, lambda g: tag(F.arrays_zip(lines.alias("x"), F.concat(F.array(F.lit(None).cast("long")), g).alias("before"), g.alias("here"), F.slice(g, 2, F.size(g)).alias("next"))))

    def tag(rows: Column) -> Column:
        starts = lambda r, i: (i > 1) & (r["here"] < r["before"]) & (r["here"] <= r["next"])
        return F.transform(F.filter(rows, lambda r: r["x"].isNotNull()), lambda r, i: F.concat(F.when(starts(r, i), "1").otherwise("0"), r["x"]))

    whole = F.substring(F.array_join(_let(F.split(text, "\n", -1), cut), "\n"), 2, 2**31 - 1)
    return F.transform(F.split(whole, "\n1", -1), lambda c: F.replace(c, F.lit("\n0"), F.lit("\n")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row per input row: id, text without repeated chunks, n_lines, removed_lines, removed_chunks.

    A chunk of two lines or more that occurs twice or more in all rows stays where it occurs first (smallest id, then
    row, then place in the text); its other occurrences go. Chunks whose 64-bit hashes meet are fetched, and grouped by
    their bytes, so different chunks are never taken for each other. Single lines and chunks of blank lines stay.

    Every row is a document of its own: rows that repeat an id, and rows with null ids, lose only chunks of their own
    text. Null ids come after all others. Null texts are empty and come back empty; long texts are cut whole. Empty
    tables give an empty result, and other columns are left out. ``stored``: see ``rows_of``.

    Hashes of all chunks are shuffled, texts only of repeated ones; a chunk that many rows hold is dealt out over
    tasks. Documents are not shuffled unless those that lose chunks are too many to broadcast.
    """
    base = rows_of(docs, [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")], stored)
    multi = F.col("chunk").contains("\n") & F.col("chunk").rlike(r"\S")
    cut = base.select("row", "id", F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).filter(multi)
    marks = cut.select(F.xxhash64("chunk").alias("h"))
    twice = written(marks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "chunk-hashes")
    again = written(join_salted(cut.withColumn("h", F.xxhash64("chunk")), twice, ["h"], ["row", "at"]), "chunks")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "at")
    groups = again.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    groups = written(groups.select("h", F.sha2("chunk", 256).alias("sha"), "n", "first.row", "first.at").withColumnsRenamed({"row": "first_row", "at": "first_at"}), "chunk-groups")
    member = join_salted(again.select("row", "at", "h", F.sha2("chunk", 256).alias("sha")), groups, ["h", "sha"], ["row", "at"])
    gone = member.filter("first_row <> row or first_at <> at")
    lost = written(gone.groupBy("row").agg(F.collect_set("at").alias("gone")), "lost-chunks")
    kept = join_sized(base, lost, "row", "left").withColumn("parts", chunks(F.col("text")))
    out = F.coalesce("gone", F.array().cast("array<int>"))
    n = lambda c: (F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    stays = F.filter("parts", lambda _, i: ~F.array_contains(out, i))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    rows = kept.select(F.col("id").alias(id_col), clean.alias("text"), n(F.col("text")).alias("n_lines"), F.size(stays).alias("left"), F.size(out).cast("long").alias("removed_chunks"))
    return rows.select(id_col, "text", "n_lines", (F.col("n_lines") - F.when(F.col("removed_chunks") == 0, F.col("n_lines")).when(F.col("left") == 0, F.lit(0)).otherwise(n(F.col("text")))).alias("removed_lines"), "removed_chunks")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
    return rows.select("doc_id", "n_lines", "removed_lines", "removed_chunks", F.char_length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
