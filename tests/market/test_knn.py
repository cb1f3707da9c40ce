"""Pruned and plain neighbours are the same; keys that are broadcast or shuffled flag the same rows; quantiles from counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import stats
from bazaarlens.operators import inference, knn, matching, measure, serving, valuation
from bazaarlens.plans.fixtures import COMPARABLE, kept, listing

AT = "/root/testdata/sf0.001"
ROWS = "listing_id long, embedding array<double>, category string, model_key string, completeness string, capacity_gb int, spec_generation string, form_factor string"


def vectors(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        return (rng.normal(size=(6, 12)) * 10)[rng.integers(0, 6, n)] + rng.normal(size=(n, 12)) * 0.05
    if kind == "ties":  # few different vectors, so most similarities are equal
        return rng.normal(size=(5, 4))[rng.integers(0, 5, n)]
    if kind == "equal":
        return np.ones((n, 3))
    return rng.normal(size=(n, 8))


def brute(rows, asked, k):
    out = []
    for q in asked:
        sims = []
        for c in rows:
            if c[0] != q[0] and all(q[i] is None or c[i] is None or q[i] == c[i] for i in range(4, 8)) and (q[2] is None or q[2] == c[2]):
                a, b = np.array(q[1]), np.array(c[1])
                sims.append((-np.floor(a @ b / np.sqrt((a @ a) * (b @ b)) * 1e9 + 0.5) / 1e9, c[0]))
        out += [(q[0], i, s) for s, i in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("kind", ["clusters", "ties", "equal", "spread"])
def test_pruning_loses_nothing(spark, kind):
    rng = random.Random(1)
    rows = [(i, v.tolist(), rng.choice([None, "a", "b"]), None, rng.choice([None, "x", "y"]), None, None, None) for i, v in enumerate(vectors(kind, 240))]
    asked = rows[::6]
    pool, q = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ROWS)
    got, pairs = knn.knn_with_pairs(q, pool, kept, 7, ("category",), chunk=20, pivots=4)
    got = sorted((r.query_id, r["rank"], r.listing_id) for r in got.collect())
    plain = sorted((r.query_id, r["rank"], r.listing_id) for r in knn.knn(q, pool, 7, ("category",), chunk=20).collect())
    want, seen = [], {}
    for query, i, _ in brute(rows, asked, 7):
        seen[query] = seen.get(query, 0) + 1
        want.append((query, seen[query], i))
    assert got == plain == sorted(want)
    share = pairs.agg(F.avg(F.col("compared").cast("int"))).first()[0]
    assert share < 0.6 if kind == "clusters" else share <= 1


def test_best_settles_ties_at_the_last_place():
    sim = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf], [0.1, 0.1, 0.1, 0.1, 0.1], [-np.inf] * 5])
    row, col = knn._best(sim, np.array([7, 6, 5, 4, 3]), 2)
    assert list(zip(row, col)) == [(0, 1), (0, 3), (1, 4), (1, 3)]


@pytest.mark.parametrize("bound", [0, 1 << 25])
def test_sold_keys(spark, bound):
    rows = listing(spark, AT)
    got = {r.listing_id for r in valuation.candidates(rows, bound=bound).select("listing_id").collect()}
    rows.createOrReplaceTempView("l")
    want = {r.listing_id for r in spark.sql(f"select listing_id from l where source = 'ebay' and status = 'active' and {COMPARABLE} and not is_auction and embedding is not null and (model_key in (select model_key from l where status = 'likely_sold' and model_key is not null) or epid in (select epid from l where status = 'likely_sold' and epid is not null))").collect()}
    assert got == want and got
    none = rows.withColumn("status", F.lit("active"))
    assert valuation.candidates(none, bound=bound).count() == none.filter(f"source = 'ebay' and {COMPARABLE} and not is_auction and embedding is not null").count()


def test_keys_beyond_the_bound_spread_rows_without_one(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else f"k{i % 4}") for i in range(300)], "listing_id long, model_key string")
    keys = spark.createDataFrame([("k0",), ("k1",)], "model_key string")
    small, large = (valuation.key_flag(rows, keys, "model_key", "known", b) for b in (1 << 20, 0))
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_quantiles_from_counts(spark):
    rng = random.Random(3)
    groups = {g: [float(rng.choice([1, 2, 3, 5, 8, 8, 100])) for _ in range(n)] for g, n in {"a": 1, "b": 2, "c": 5, "d": 11, "e": 48, None: 6}.items()}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    got = {r.g: r for r in stats.nearest_rank(rows, ["g"], "v", {"p10": 0.1, "p90": 0.9}).collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        at = lambda q: s[round(q * (len(s) - 1))]  # noqa: E731, B023
        r = got[g]
        assert (r.n, r.lo, r.hi, r.median, r.p10, r.p90) == (len(s), s[0], s[-1], float(np.median(s)), at(0.1), at(0.9))


def test_groupings_read_the_rows_once(spark):
    rows = listing(spark, AT).filter(COMPARABLE)
    report = measure.four_groupings(rows)
    assert report._jdf.queryExecution().executedPlan().toString().count("orders.parquet") <= 4  # sizes and both medians share counts; subqueries of the fixture aside
    assert {r.grouping for r in report.collect()} == set(measure.GROUPINGS)


def test_one_bad_value_costs_its_batch_a_few_calls():
    calls = []

    def model(batch):
        calls.append(len(batch))
        if 13 in batch:
            raise KeyError("bad")
        return [[float(v)] if v != 5 else None for v in batch]

    got = inference._tried(model, list(range(64)))
    assert got[13] == (None, "KeyError: 'bad'") and got[5] == (None, "no vector") and all(v == ([float(i)], None) for i, v in enumerate(got) if i not in (5, 13))
    assert len(calls) == 13  # two a halving, and the first
    with pytest.raises(ValueError, match="1 vectors for 2"):
        inference._tried(lambda batch: [[1.0]], [1, 2])


def test_a_model_that_always_fails_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "listing_id long, images string")
    with pytest.raises(Exception, match="all attempts failed"):
        inference.assert_some(inference.attempt_counters(inference.embed(rows, lambda batch: 1 / 0))).collect()


def test_blocks_without_clusters_are_not_pruned(spark, monkeypatch):
    """Vectors spread at random: the probe finds no cells apart, so nothing is pruned, and the pairs of chunks are all compared."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=32)]) for i in range(400)], "listing_id long, embedding array<float>")

    def never(*_):
        raise AssertionError("pruned")

    monkeypatch.setattr(knn, "_pruned", never)
    asked = rows.filter("listing_id % 20 = 0")
    near, pairs = knn.knn_with_pairs(asked, rows, lambda df: df.cache(), 5, (), (), chunk=100)
    got = sorted((r.query_id, r.rank, r.listing_id) for r in near.collect())
    assert got == sorted((r.query_id, r.rank, r.listing_id) for r in knn.knn(asked, rows, 5, (), (), chunk=100).collect()) and len(got) == 100
    assert pairs.count() == 4 and pairs.filter("not compared").count() == 0


def shuffled(spark, run):
    """Bytes that the stages of ``run`` wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (store.stageList(None, False, False, none, None).apply(i) for i in range(store.stageList(None, False, False, none, None).size()))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for s, n in stages().items() if s not in before)


def test_shuffles_do_not_grow_with_the_pairs_of_chunks(spark):
    """3,000 different vectors in 150 chunks: each row used to be shuffled for every chunk of the other side, 20.8 MB here."""
    rng = np.random.default_rng(4)
    rows = kept(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)).astype(np.float32))], "listing_id long, embedding array<float>"))
    got = {}
    run = lambda: got.update(rows=knn.knn(rows, rows, 3, (), (), chunk=20).collect())
    assert shuffled(spark, run) < 10_000_000
    v = np.array([r.embedding for r in rows.orderBy("listing_id").collect()], np.float64)
    v /= np.sqrt((v * v).sum(1))[:, None]
    sim = np.floor(v @ v.T * 1e9 + 0.5) / 1e9
    np.fill_diagonal(sim, -2)
    for r in got["rows"]:
        assert r.listing_id == np.lexsort((np.arange(3000), -sim[r.query_id]))[r.rank - 1]
    assert len(got["rows"]) == 9000


@pytest.mark.parametrize("same_hash", [False, True])
def test_equal_vectors_are_compared_once(spark, monkeypatch, same_hash):
    """Classes of equal vectors and keys have one list, and each query leaves itself out of it; vectors of one hash stay apart."""
    if same_hash:
        monkeypatch.setattr(knn, "_hash", lambda: F.lit(1).cast("long"))
    rng = random.Random(5)
    rows = [(i, v.tolist(), rng.choice([None, "a"]), None, rng.choice([None, "x"]), None, None, None) for i, v in enumerate(vectors("ties", 300))]
    pool = kept(spark.createDataFrame(rows, ROWS))
    got = sorted((r.query_id, r["rank"], r.listing_id) for r in knn.knn(pool, pool, 9, ("category",), chunk=20, keep=kept).collect())
    want, seen = [], {}
    for query, i, _ in brute(rows, rows, 9):
        seen[query] = seen.get(query, 0) + 1
        want.append((query, seen[query], i))
    assert got == sorted(want)
    asked, near, _ = knn.knn_lists(pool, pool, kept, 9, ("category",))
    assert asked.count() == 300 and near.count() <= 20 and max(len(r.near) for r in near.collect()) == 10


def test_a_vector_without_length_has_no_neighbours(spark):
    rows = spark.createDataFrame([(i, [0.0, 0.0] if i < 20 else [1.0, float(i)]) for i in range(24)], "listing_id long, embedding array<float>")
    got = knn.knn(rows, rows, 5, (), ()).collect()
    assert {r.query_id for r in got} == {20, 21, 22, 23} == {r.listing_id for r in got} and len(got) == 12


def test_lists_are_made_once_for_a_class_of_queries(spark):
    """400 equal queries, each with 60 comparables: what is found used to be shuffled for each of them, 204 kB here."""
    one = listing(spark, AT).filter("embedding is not null").limit(1).drop("listing_id", "status", "source", "lot_size", "has_defect", "is_accessory", "price_is_from", "sale_confidence", "price_confidence")
    k = F.col("listing_id")
    rows = kept(spark.range(800).withColumnRenamed("id", "listing_id").crossJoin(one).withColumns({"status": F.when(k % 2 == 0, "active").otherwise("likely_sold"), "source": F.lit("ebay"), "lot_size": F.lit(None).cast("int"), "has_defect": F.lit(False), "is_accessory": F.lit(False), "price_is_from": F.lit(False), "sale_confidence": F.lit(0.5), "price_confidence": F.lit(0.0), "price": 10.0 + k}))
    got = {}
    run = lambda: got.update(rows=valuation.value(valuation.sold_lists(rows.filter("status = 'active'"), rows, keep=kept)).collect())
    assert shuffled(spark, run) < 80_000
    assert len(got["rows"]) == 400
    for r in got["rows"]:  # the least ids come first: of 60 others without itself, the odd ones are sold
        others = [i for i in range(62) if i != r.listing_id][:60]
        assert [(c["rank"], c.listing_id) for c in r.comps] == [(place + 1, i) for place, i in enumerate(others) if i % 2]
        assert r.n == 30 and {c.weight for c in r.comps} == {1.0}


def test_a_shared_photo_is_priced_once(spark):
    """900 listings with one photo, 30 asked: 370 kB were shuffled for their 27,000 matches; one of the asked is among the listings itself."""
    k = F.col("listing_id")
    rows = spark.range(930).withColumnRenamed("id", "listing_id").withColumns({"source": F.when(k < 900, "ebay").otherwise("depop"), "image_hash": F.lit("h"), "epid": F.lit(None).cast("string"), "completeness": F.lit(None).cast("string"), "price": 1.0 + k, "shipping_cost": F.when(k % 2 == 0, 2.0), "category": F.lit("a"), "model_key": F.lit("m"), "embedding": F.array(F.lit(1.0), F.lit(2.0)), "title": F.concat(F.lit("T"), k), "url": F.lit("u")})
    rows = rows.withColumns({"lot_size": F.lit(None).cast("int"), "has_defect": F.lit(False), "is_accessory": F.lit(False), "price_is_from": F.lit(False), **{c: F.lit(None).cast("string") for c in ("capacity_gb", "spec_generation", "form_factor")}})
    rows = kept(rows)
    asked = rows.filter("listing_id >= 900 or listing_id = 5")
    got = {}
    run = lambda: got.update(rows=matching.priced(asked, rows, keep=kept)[0].collect())
    assert shuffled(spark, run) < 60_000
    assert len(got["rows"]) == 31
    for r in got["rows"]:
        prices = [1.0 + i for i in range(900) if i != r.query_id]
        assert (r.matched_by, r.comps_from, r.n, r.median_price, r.min_price, r.max_price) == ("image_hash", "candidates", len(prices), float(np.median(prices)), min(prices), max(prices))
    ranks = {}
    for r in matching.match(asked, rows, keep=kept).collect():
        ranks.setdefault(r.query_id, []).append((r.rank, r.listing_id))
    assert all(sorted(v) == [(place + 1, i) for place, i in enumerate(i for i in range(900) if i != q)] for q, v in ranks.items()) and len(ranks) == 31
    plan = matching.match(asked, rows, keep=kept)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Window" not in plan  # nothing orders the matches after the join that makes them
    read = serving.match_read(*matching.priced(asked, rows, keep=kept), rows)
    assert read.count() == 30 * 900 + 899
    shown = {r.query_id: [x.candidate.listing_id for x in read.filter(F.col("query_id") == r.query_id).orderBy("candidate.place").collect()] for r in asked.selectExpr("listing_id as query_id").filter("query_id in (5, 900)").collect()}
    assert shown == {5: [i for i in range(900) if i != 5], 900: list(range(900))}
