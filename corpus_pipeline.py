"""Corpus preparation in five stages: toxicity, exact dedup, near dedup, benchmark decontamination, encoding.

All stages but the last return the columns of their input, whatever these are, and decide row by row: each input row has
a key of its own, so rows that repeat an id, or have none, stay or go by their own text. Null texts are empty ones.
Empty tables give empty results, and texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import free_name, join_sized, numbered, written
from bazaarlens.llm.decontaminate import contaminated
from bazaarlens.llm.exact_dedup import exact_dedup
from bazaarlens.llm.jaccard_join import jaccard_join
from bazaarlens.llm.sentencepiece import round_trip
from bazaarlens.llm.toxicity import toxicity, train

#: Score from which a document goes. Higher than where one is flagged, so that clean documents stay.
TOXIC = 0.5


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(``docs`` with a number for each row, (key, text) of each row, the number's name).

    Keys are ordered by doc_id, nulls last, then row; no two are equal.
    """
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    return rows, rows.select(key.alias("key"), "text"), row


def without(rows: DataFrame, keys: DataFrame, row: str) -> DataFrame:
    """``rows`` but those with one of these keys, without the number. The keys are broadcast only if they are measured to be small."""
    gone = written(keys.select(F.col("key.row").alias(row)).distinct(), "dropped")
    return join_sized(rows, gone, row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``. Texts without words score lowest and stay; the network is fitted on a bounded sample (see ``train``)."""
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return toxicity(docs, net, score_col=score).filter(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with most code points, then the least id, then the first row. All empty and null texts are one group."""
    rows, texts, row = keyed(docs)
    return without(rows, exact_dedup(texts, id_col="key").filter("not kept").select("key"), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each class of near copies, of equal ids the first. Texts without words are near to none and stay."""
    rows, texts, row = keyed(docs)
    return without(rows, jaccard_join(texts, id_col="key").filter("key <> class_id").select("key"), row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no copy of a benchmark item, edited or not. Texts without words stay."""
    rows, texts, row = keyed(docs)
    return without(rows, contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").select("key"), row)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32, decoded_sha256, same. Null texts are empty; null and repeated ids are kept."""
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: The network, the banding, the alignment and the segmentation are not SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again. Rows, nulls and names as in the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
