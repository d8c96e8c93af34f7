"""Order statistics against sorted lists."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal
from math import ceil

import pytest
from pyspark.sql import functions as F

from docgraph.operators import statistics


@pytest.mark.parametrize("kind", ["long", "double", "int"])
def test_selection(spark, kind):
    rng = random.Random(3)
    draw = {
        "long": lambda: rng.choice([rng.randrange(-5, 5), rng.randrange(-(10**18), 10**18), 2**62 + rng.randrange(3)]), "double": lambda: rng.choice([rng.random(), rng.gauss(0, 1e-9), rng.expovariate(1) ** 9, -0.5]),
        "int": lambda: rng.randrange(4),
    }[kind]
    rows = [("hot", draw()) for _ in range(2500)] + [(rng.choice(["a", "b", None]), draw()) for _ in range(80)] + [("one", draw()), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    shares = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: r for r in statistics.nearest_ranks(df, ["g"], "v", shares).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == g and v is not None)
        assert got[g].n == len(own) and [got[g][name] for name in shares] == [own[max(1, ceil(q * len(own))) - 1] for q in shares.values()]
    assert "none" not in got and len(got) == 5
    whole = statistics.nearest_ranks(df, [], "v", {"p50": 0.5}).collect()
    everything = sorted(v for _, v in rows if v is not None)
    assert [(r.n, r.p50) for r in whole] == [(len(everything), everything[ceil(len(everything) / 2) - 1])]
    assert statistics.nearest_ranks(df.limit(0), ["g"], "v", shares).count() == 0


def test_distribution(spark):
    rows = [("a", n) for n in (1, 2, 3, 4)] + [("b", 7)] + [(None, n) for n in range(41)] + [("c", None)]
    got = {r.g: tuple(r)[1:] for r in statistics.distribution(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    for g in ("a", "b", None):
        own = sorted(v for x, v in rows if x == g)
        n = len(own)
        at = int(Decimal("0.95") * (n - 1) // 1) if n == 1 else int((Decimal("0.95") * (n - 1)).to_integral_value(ROUND_HALF_EVEN))
        assert got[g] == (sum(own), round(sum(own) / n, 2), (own[(n - 1) // 2] + own[n // 2]) / 2, own[at], own[0], own[-1])
    assert set(got) == {"a", "b", None}


def test_stages(spark):
    rows = [("s", "x", True, 5), ("s", "x", False, 7), ("s", "y", False, None), ("t", "y", None, None)]
    calls = spark.createDataFrame(rows, "stage string, category string, success boolean, ms long")
    found = {r.stage: r for r in statistics.stage_statistics(calls, F.when(F.col("success"), "good").otherwise("bad"), ["ms"]).collect()}
    assert (found["s"].calls, found["s"].lost, [tuple(o) for o in found["s"].outcomes], found["s"].ms.median) == (3, 1, [("bad", 2), ("good", 1)], 6.0)
    assert (found["t"].calls, found["t"].lost, found["t"].ms) == (1, 1, None)
