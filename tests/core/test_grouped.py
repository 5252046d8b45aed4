"""Suppression and matching finished by groups, by components and by rounds give the scan's rows."""

import random

import pytest

from crownwork.operators import match, suppress


def made(seed, groups=4, n=60):
    """Pairs in groups that share ids, chains of all lengths among them; all scores and values have ties."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for p in range(n):
            for q in rng.sample(range(n), rng.choice([1, 1, 2, 3])):
                rows.append((g, p, p % 9, q, rng.randrange(1, 6) / 5))
    rows += [(9, p, 5, q, 1.0 - p / 100) for p in range(40) for q in (p, p + 1)]  # one long chain
    return rows


PAIRS = "image_id bigint, pred_id bigint, score bigint, gt_id bigint, value double"


@pytest.mark.parametrize("most", [100_000, 70, 1])
def test_matchings(spark, most):
    rows = made(1)
    df = spark.createDataFrame(rows, PAIRS).selectExpr("*", "1 a", "2 b", "3 root").repartition(3)
    used, want = set(), set()
    for g, p, s, q, v in sorted(rows, key=lambda r: (-r[2], r[1], -r[4], r[3])):
        if (g, "p", p) not in used and (g, "q", q) not in used:
            used |= {(g, "p", p), (g, "q", q)}
            want.add((g, p, q, v))
    got = list(map(tuple, match.in_score_order(df, ("image_id",), most).collect()))
    assert len(got) == len(want) and set(got) == want
    used, want = set(), []
    for g, p, _, q, v in sorted(rows, key=lambda r: (-r[4], r[1], r[3])):
        if (g, "p", p) not in used and (g, "q", q) not in used:
            used |= {(g, "p", p), (g, "q", q)}
            want.append((p, q, v))
    assert sorted(map(tuple, match.one_to_one(df, ("image_id",), most).collect())) == sorted(want)


@pytest.mark.parametrize("most,by", [(100_000, ("image_id",)), (100_000, ()), (50, ("image_id",)), (1, ())])
def test_suppression(spark, most, by):
    rng = random.Random(3)
    edges = {(g, h * 5 + g, l * 5 + g) for g in range(5) for h, l in (sorted(rng.sample(range(80), 2)) for _ in range(90))}
    edges |= {(7, 1000 + k, 1001 + k) for k in range(60)}  # each other one goes
    df = spark.createDataFrame(sorted(edges), "image_id bigint, high bigint, low bigint").repartition(4)
    nodes = sorted({n for e in edges for n in e[1:]} | {-5})
    kept: set = set()
    for n in nodes:
        if not any(h in kept for _, h, l in edges if l == n):
            kept.add(n)
    got = suppress.survivors(spark.createDataFrame([(n,) for n in nodes], "id bigint"), df, by, most)
    assert sorted(r["id"] for r in got.collect()) == sorted(kept)
    none = suppress.survivors(got, df.limit(0), by, most)
    assert none.count() == len(kept)


def test_a_cycle_is_refused(spark):
    from pyspark.errors import PythonException

    df = spark.createDataFrame([(1, 2), (2, 1)], "high bigint, low bigint")
    with pytest.raises(PythonException, match="cycle"):
        suppress.survivors(spark.createDataFrame([(1,), (2,)], "id bigint"), df).collect()
