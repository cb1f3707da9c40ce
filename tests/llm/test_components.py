import random

import pytest

from bazaarlens.llm import common


def brute(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo.extend(near[x])
    return out


@pytest.mark.parametrize("bound", [common.BROADCAST_BYTES, 0])
def test_chains_hubs_and_loose_edges(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common.join_salted, "__defaults__", ("n", "inner", bound))
    rng = random.Random(4)
    names = list(range(100, 140))
    rng.shuffle(names)
    edges = list(zip(names, names[1:], strict=False))
    edges += [(900, 901 + i) for i in range(20)] + [(5, 900)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    edges = [(u, v) for u, v in edges if u != v]
    rows = edges + [(7, 7), (None, 3), (3, None)] + edges[:9] + [(v, u) for u, v in edges[:9]]
    found = common.components(spark.createDataFrame(rows, "u long, v long"), "test").collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == brute(edges)


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "u long, v long"), "test").count() == 0
