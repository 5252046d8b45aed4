"""Percentiles held against numpy."""

import math
import random

import numpy as np
import pytest

from crownwork.operators.percentiles import percentiles

SHARES = [0.0, 0.1, 0.5, 0.995, 1.0]


def groups():
    rng = random.Random(2)
    return {
        "even": [rng.random() * 300 for _ in range(3000)],
        "whole": [float(rng.randrange(7)) for _ in range(2000)],
        "one": [5.0],
        "two": [-1.0, 2.0],
        "same": [3.25] * 900,
        "far": [rng.gauss(0, 1) for _ in range(1500)] + [1e300, -1e300, 1e-300],
        "powers": [10.0**k for k in range(-150, 150)] * 3,
        None: [rng.gauss(100, 5) for _ in range(800)],
    }


@pytest.mark.parametrize("bins,few", [(1024, 4096), (64, 5)])
def test_against_numpy(spark, bins, few):
    made = groups()
    rows = [(k, v) for k, vs in made.items() for v in vs] + [("even", None), ("one", math.nan), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {(r["g"], r["share"]): (r["n"], r["value"]) for r in percentiles(df, ["g"], "x", SHARES, bins, few).collect()}
    assert set(got) == {(g, s) for g in made for s in SHARES}
    for (g, s), (n, v) in got.items():
        assert n == len(made[g]) and np.isclose(v, np.quantile(made[g], s), rtol=1e-12, atol=0 if g != "far" else 1e-12)


def test_no_groups_and_no_rows(spark):
    df = spark.range(5001).selectExpr("cast(id as double) x")
    (r,) = percentiles(df, [], "x", [0.25], few=10).collect()
    assert (r["n"], r["value"]) == (5001, 1250.0)
    assert percentiles(df.limit(0), [], "x", [0.5]).collect() == []
