import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import extract as x
from bazaarlens.operators import vocabulary as v

WORDS = "iPhone 15 pro max 16 e plus galaxy s 23 ultra fe pixel 8 a rtx 4070 ti super rx 6700 xt i7-12700k i5 13600 KF ryzen 5 5600 x3d 7800 ps5 playstation 4 switch OLED lite 2 nintendo xbox series x one 2x16gb ddr5 1tb nvme cpu case charger cable box fan backplate shroud for only".split() + ["ryzen 5 5600x", "Ryzen 7800 x3d", "7800X3D"]


@pytest.fixture(scope="module")
def titles(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 10))) for _ in range(3000)]
    texts += ["", "\n iPhone 15\n pro", "x\x85RTX 4090", "ßwitch lite switch lite", "$1 ps5 \\ $2", "a" * 30_000 + " ps4", None]
    return spark.createDataFrame([(i, t, ("Laptops", "Consoles", None)[i % 3]) for i, t in enumerate(texts)], "id long, title string, category string").cache()


@pytest.mark.parametrize(("pattern", "n"), [(v.GPU, 3), (v.CPU_INTEL, 3), (v.CPU_AMD, 4), (v.CONSOLE, 8), (v.PHONE, 10)])
def test_all_groups_at_once_are_those_of_single_extractions(titles, pattern, n):
    t = F.col("title")
    at_once = x.with_groups(t, pattern, n, lambda g: F.array(*g[1:]))
    rows = titles.select(at_once.alias("got"), F.when(x.has(t, pattern), F.array(*[x.group(t, pattern, i) for i in range(1, n + 1)])).alias("want"))
    assert rows.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    assert rows.filter("got is not null").count() > 20


def test_fields_are_those_of_their_own_functions(titles):
    """The shared columns of ``extracted`` change nothing, and leave no column behind."""
    got = x.extracted(titles, condition=None)
    assert [c for c in got.columns if c.startswith("__")] == []
    t, c = F.coalesce("title", F.lit("")), F.col("category")
    want = {"model_key": x.model_key(t, c), "is_accessory": x.accessory(t, c).isNotNull(), "capacity_gb": x.capacity(t, c), "price_is_from": x.price_is_from(t, c)}
    apart = [~F.col(k).eqNullSafe(e) for k, e in want.items()] + [~F.to_json("variant_signals").eqNullSafe(F.to_json(x.signals(t, c)))]
    assert got.filter(F.greatest(*[a.cast("int") for a in apart]) == 1).count() == 0
    assert got.filter("model_key is not null").count() > 100 < got.filter("is_accessory").count()


def test_model_patterns_are_matched_once_a_row(titles):
    plan = x.extracted(titles, condition=None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"playstation\s*(5|4)") == plan.count(r"galaxy\s+([sznf])") == 2  # whether there is a match, and its groups
