"""Secret scan with corpus-wide ownership counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import written
from bazaarlens.llm.spans import joined, matches

#: Kinds in the order of their reports; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "prefixed", "pem", "mixed")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (
    ASSIGN,
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]{24,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})",
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}",
)
#: A value that more owners or more repositories than these hold is a widely copied example.
MAX_OWNERS, MAX_REPOS = 2, 3
#: Distinct characters a value needs to look live.
MIN_DISTINCT = 8


def _needs(text: Column) -> list[Column]:
    low = F.lower(text)
    words = F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    has = lambda x: F.contains(text, F.lit(x))
    return [words, has("AKIA"), F.lit(True), has("eyJ"), has("gh") | has("sk_live_") | has("xox"), has("-----BEGIN "), F.lit(True)]


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (rid, id, owner, repo, kind, start, end, value) of ``docs`` (id, text, owner, repo); kind is null where a document has none.

    Matches whose value is too short are dropped and not tried again further on.
    """
    tagged = docs.select(F.struct("id", "owner", "repo").alias("id"), "text")
    rows = matches(tagged, list(zip(PATTERNS, _needs(F.col("text")), strict=True)))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 1)).otherwise(F.col("match"))
    rows = rows.withColumn("value", value)
    size = F.char_length("value")
    good = F.when(F.col("kind") == 0, size >= 6).when(F.col("kind") == 1, size >= 20).otherwise(F.lit(True))
    kind = F.when(good, F.col("kind"))
    return rows.select("rid", "id.id", "id.owner", "id.repo", kind.alias("kind"), "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value_sha, owners, repos, uses): how many distinct owners and repositories hold each candidate value.

    Summed in two steps, (value, owner, repo) first, so a value that a third of all documents share is as many rows
    as it has owners and repositories before anything is shuffled by value.
    """
    each = found.filter("kind is not null").groupBy(F.sha2("value", 256).alias("value_sha"), "owner", "repo").agg(F.count("*").alias("uses"))
    return each.groupBy("value_sha").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.sum("uses").alias("uses"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: id, secrets (array of kind, start, end, value_sha, owners, repos, verdict), in order of start, then kind.

    ``verdict`` is ``copied`` for a value held by more than ``max_owners`` owners or ``max_repos`` repositories,
    ``weak`` for one with fewer than eight distinct characters, else ``live``. Base kinds are always reported; the
    further kinds (web tokens, prefixed tokens, private key headers, long mixed strings) only when they are live.

    Null texts are empty; null owners and repositories count as none. Rows that repeat an id are scanned and reported
    each. An empty table gives an empty result. Extra columns are ignored, whatever their names.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found = written(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"))), "secrets")
    some = found.filter("kind is not null").withColumn("value_sha", F.sha2("value", 256)).join(ownership(found), "value_sha")
    held = some.unionByName(found.filter("kind is null"), allowMissingColumns=True)  # no null keys in the join
    distinct = F.size(F.array_distinct(F.split("value", "")))
    verdict = F.when((F.col("owners") > max_owners) | (F.col("repos") > max_repos), "copied").when((F.col("kind") != 5) & (distinct < MIN_DISTINCT), "weak").otherwise("live")
    shown = (F.col("kind") <= 2) | ((F.col("kind") > 2) & (verdict == "live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", "kind", F.when(F.col("kind").isNotNull(), name).alias("name"), "end", "value_sha", "owners", "repos", verdict.alias("verdict"))
    rows = held.groupBy("rid", "id").agg(F.array_sort(F.collect_list(F.when(shown, one))).alias("secrets"))
    return rows.select(F.col("id").alias(id_col), "secrets")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda test: F.size(F.filter("secrets", test)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] <= 2)
    return rows.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(secrets, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        n(lambda x: x["verdict"] == "live").alias("n_live"),
        n(lambda x: x["verdict"] == "copied").alias("n_copied"),
    )
