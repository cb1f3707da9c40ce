"""Snapshot versions bucketed by key, and the stream of sightings merged into them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import merge
from bazaarlens.sources.snapshots import Snapshot
from bazaarlens.streaming import ingest

KEY = ("source", "source_id")
STORED = "listing_id long, source string, source_id string, title string, price double, shipping_cost double, shipping_estimated boolean, epid string, image_hash string, variant_signals map<string,string>, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, missing_since timestamp_ntz, embedding array<float>"
SEEN = "listing_id long, source string, source_id string, title string, price double, shipping_cost double, shipping_estimated boolean, epid string, image_hash string, variant_signals map<string,string>, fetched_at timestamp_ntz, position long"
T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def stored_rows():
    base = lambda i, status, ship: (i, "ebay", str(i), "old", 10.0, ship, ship is None, None, "h" if i % 2 else None, {"kit": "1x8"}, status, at(-50), at(-40), at(-30) if i == 2 else None, [0.5] * 8)
    return [base(1, "active", None), base(2, "active", 3.0), base(3, "stale", 1.0), base(4, "likely_sold", None)]


def sightings(seed, n=60):
    rng = random.Random(seed)
    return [(k, "ebay", str(k), f"t{h}", rng.choice([10.0, 11.0, None]), rng.choice([None, 0.0, 3.0]), rng.random() < 0.5, rng.choice([None, "e1", "e2"]), rng.choice([None, "n1"]), rng.choice([None, {}, {"a": "b"}]), at(h), h) for h, k in enumerate(rng.choices(range(1, 8), k=n))]


def one_by_one(stored, seen):
    """The rules, sighting after sighting: (rows by id, observations)."""
    names, got = [c.split()[0] for c in STORED.split(", ")], []
    rows = {r[2]: dict(zip(names, r)) for r in stored}
    for s in sorted(seen, key=lambda r: r[-2:]):
        new = dict(zip([c.split()[0] for c in SEEN.split(", ")], s))
        now, old = new.pop("fetched_at"), rows.get(new["source_id"])
        new.pop("position")
        if old is None:
            rows[new["source_id"]] = dict.fromkeys(names) | new | {"status": "active", "first_seen_at": now, "last_seen_at": now}
            got.append((new["listing_id"], new["price"], new["shipping_cost"], now))
            continue
        before = (old["price"], old["shipping_cost"])
        old |= {c: new[c] for c in ("title", "price", "variant_signals")} | {"last_seen_at": now, "missing_since": None}
        if new["shipping_cost"] is not None:
            old |= {c: new[c] for c in ("shipping_cost", "shipping_estimated")}
        old["epid"] = new["epid"] if new["epid"] is not None else old["epid"]
        old["image_hash"] = old["image_hash"] if old["image_hash"] is not None else new["image_hash"]
        old["status"] = "active" if old["status"] == "stale" else old["status"]
        if before != (old["price"], old["shipping_cost"]):
            got.append((old["listing_id"], old["price"], old["shipping_cost"], now))
    return rows, got


def snapshot_of(spark, tmp_path, name, stored):
    s = Snapshot(spark, str(tmp_path / "listing"), name, buckets=4)
    s.write(spark.createDataFrame(stored, STORED), 0)
    return s


def fed(spark, tmp_path, parts):
    for rows in parts:
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], SEEN).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def state(snapshot, log):
    rows = {r["source_id"]: r.asDict() for r in snapshot.read().collect()}
    return rows, sorted((tuple(r) for r in ingest.observations(snapshot, log).select("listing_id", "price", "shipping_cost", "observed_at").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_have_the_effect_of_single_sightings(spark, tmp_path, seed):
    seen = sightings(seed)
    snapshot, log = snapshot_of(spark, tmp_path, f"one{seed}", stored_rows()), str(tmp_path / "log")
    cuts = sorted(random.Random(seed).sample(range(1, len(seen)), 2))
    stream = fed(spark, tmp_path, [seen[a:b] for a, b in zip([0, *cuts], [*cuts, len(seen)])])
    ingest.upsert_stream(stream, ingest.merge_batch(snapshot, log), str(tmp_path / "c")).awaitTermination()
    rows, notes = state(snapshot, log)
    want, said = one_by_one(stored_rows(), seen)
    assert rows == want and notes == sorted(said, key=str)
    assert snapshot.versions() == [2, 3]
    n = ingest.counters(snapshot, log).agg(F.sum("inserted"), F.sum("reactivated")).first()
    assert tuple(n) == (len(want) - 4, int("3" in {s[2] for s in seen}))


@pytest.mark.parametrize("where", ["before", "logged", "after"])
def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path, monkeypatch, where):
    """Killed before its logs, between its logs and its version, or before its commit."""
    seen = sightings(9, 30)
    snapshot, log = snapshot_of(spark, tmp_path, f"twice_{where}", stored_rows()), str(tmp_path / "log")
    stream = fed(spark, tmp_path, [seen[:10], seen[10:20], seen[20:]])
    apply, write, killed = ingest.merge_batch(snapshot, log), Snapshot.write, []

    def stop(now):
        if now == where and not killed:
            killed.append(now)
            raise RuntimeError("killed")

    def dying(batch, number):
        if number == 1:
            stop("before")
        apply(batch, number)
        if number == 1:
            stop("after")

    def half(self, df, number):
        if number == 2 and where == "logged" and not killed:
            df.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.at(number))
            stop("logged")
        write(self, df, number)

    monkeypatch.setattr(Snapshot, "write", half)
    with pytest.raises(Exception, match="killed"):
        ingest.upsert_stream(stream, dying, str(tmp_path / "c")).awaitTermination()
    ingest.upsert_stream(stream, dying, str(tmp_path / "c")).awaitTermination()
    rows, notes = state(snapshot, log)
    want, said = one_by_one(stored_rows(), seen)
    assert killed == [where] and rows == want and notes == sorted(said, key=str)


def test_only_what_comes_in_is_shuffled(spark, tmp_path):
    """The stored side has no exchange and no sort above its scan, and its buckets become the next version's."""
    snapshot = snapshot_of(spark, tmp_path, "plan", stored_rows())
    seen = merge.folded(spark.createDataFrame(sightings(1), SEEN), KEY, ("fetched_at", "position"))
    after = merge.upsert(snapshot.read(), seen.hint("shuffle_hash"), F.col("n.__last"), merge.SEARCH_POLICY, KEY, first=F.col("n.__first")).select(*snapshot.read().columns)
    plan = after._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("FileScan parquet")]
    assert "FullOuter" in stored and "Exchange" not in stored and "Sort" not in stored
    assert plan.count("Exchange hashpartitioning") == 1
    snapshot.write(after, 1)
    assert len(list((tmp_path / "listing" / "v00000001").glob("part-*.parquet"))) <= 4


def test_versions_are_known_from_their_files(spark, tmp_path):
    """A session that has never heard of a version reads it, with its buckets; vacuum keeps the newest."""
    first = snapshot_of(spark, tmp_path, "kept", stored_rows())
    first.write(first.read().withColumn("price", F.col("price") + 1), 1)
    first.write(first.read(), 1)
    other = spark.newSession()
    again = Snapshot(other, first.path, "kept_again", buckets=4)
    assert again.versions() == [0, 1]
    assert {r.price for r in again.read().collect()} == {11.0} and {r.price for r in again.read(0).collect()} == {10.0}
    assert "Bucketed: true" in again.read().groupBy(*KEY).count()._jdf.queryExecution().toString()
    again.vacuum(1)
    assert again.versions() == [1] and again.newest(1) is None
    with pytest.raises(FileNotFoundError):
        Snapshot(spark, str(tmp_path / "none"), "none").read()
