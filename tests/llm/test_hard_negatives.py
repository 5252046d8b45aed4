import math
import random

import numpy as np
import pytest

from crownwork.llm import hard_negatives
from crownwork.llm.hard_negatives import Heaps, mined, shifted_labels, strassen

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows):
    own = [(i, [math.floor(256 * x) for x in v], ((y + 1) % 10 if i % 7 == 0 else y)) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(own):
        if i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(own) if b != a)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            fit = [(k, -t) for t, k, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, r, k, -s, t) for r, (k, t) in enumerate(fit[:10], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (3, 5, 2), (33, 64, 65), (64, 40, 64), (101, 67, 130), (70, 1, 90)])
def test_strassen_is_exact(n, k, m):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(1 << 62), 1 << 62, (n, k)), rng.integers(-(1 << 62), 1 << 62, (k, m))
    assert (strassen(a, b, 4) == a @ b).all()  # both wrap
    small = a % 1000, b % 1000
    assert strassen(*small, 8).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in small[1].T] for r in small[0]]


def test_heaps_take_tiles_in_any_order():
    rng = np.random.default_rng(1)
    scores, allowed = rng.integers(0, 6, (7, 200)), rng.random((7, 200)) < 0.3
    ident = rng.permutation(200)
    expected = [sorted((-int(s), int(i)) for s, ok, i in zip(r, a, ident) if ok)[:4] for r, a in zip(scores, allowed)]
    for step in (200, 50, 3):
        h = Heaps(7, 4)
        for at in rng.permutation(range(0, 200, step)):
            part = slice(at, at + step)
            h.offer(scores[:, part], allowed[:, part], ident[part], ident[part])
        assert [[(-int(s), int(i)) for o, s, i in zip(h.owner, h.score, h.ident) if o == k] for k in range(7)] == expected


@pytest.mark.parametrize("seed,tile,wide,slice_", [(1, 256, 1024, 32), (2, 2, 16, 1), (3, 3, 20, 2)])
def test_against_brute_force(spark, monkeypatch, seed, tile, wide, slice_):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "WIDE", wide)
    monkeypatch.setattr(hard_negatives, "SLICE", slice_)
    rng = random.Random(seed)
    few = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice(few) if rng.random() < 0.5 else [rng.gauss(0, 1) for _ in range(6)], 3 if rng.random() < 0.4 else rng.randrange(10)) for i in range(0, 900)]
    rows += [(1000, None, 1), (None, few[0], 1), (1100, few[0], None), (1200, [1.0, None] + few[0][:4], 2), (1300, few[1][:5] + [math.nan], 2), (1400, few[1][:5] + [math.inf], 2), (1500, [0.0] * 6, 2), (-100, few[2], 5)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 row", "2 of", "3 tile", "4 score").repartition(5)
    want = brute(rows)
    assert len(want) > 100
    assert got(mined(shifted_labels(df))) == want


def test_repeated_ids_and_short_vectors(spark):
    v = [1.0, 2.0]
    rows = [(100, v, 1), (100, v, 1), (1, [0.5], 2), (2, [], 1), (3, [0.5, 0.5], 3), (100, [9.0], 4)]
    wide = [(i, x + [0.0] * (2 - len(x)), y) for i, x, y in rows]
    assert got(mined(spark.createDataFrame(rows, SCHEMA))) == brute(wide) != []


def test_empty_tables_and_lone_labels(spark):
    assert got(mined(spark.createDataFrame([], SCHEMA))) == []
    assert got(mined(spark.createDataFrame([(100, [1.0], 1), (101, [1.0], 2)], SCHEMA))) == []
    assert got(mined(spark.createDataFrame([(100, [], 1), (101, [], 1), (102, [], 2)], SCHEMA))) == [(100, 101, 1, 102, 0, 0)]


def test_query_equals_its_sql(spark):
    import duckdb

    from crownwork.llm.queries import op12_hard_negatives, oracle_sql

    d = "/root/testdata/sf0.001"
    want = duckdb.sql(oracle_sql()["op12_hard_negatives"].replace("from embeddings", f"from '{d}/embeddings.parquet'")).fetchall()
    assert got(op12_hard_negatives(spark, d)) == sorted(want) != []
