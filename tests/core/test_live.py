"""Live matching held against the batch counts."""

import random

import pytest
from pyspark.sql import functions as F

from crownwork.operators import match, metrics, overlap
from crownwork.streaming import live

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "tile_id bigint, truth boolean, box_id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint, ts timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def boxes(spark, seed=1, n=400):
    from datetime import datetime, timedelta

    rng, rows = random.Random(seed), []
    for k in range(n):
        x, y, tile = rng.randrange(60), rng.randrange(60), rng.randrange(6)
        rows.append((tile, k % 3 == 0, k, x, y, x + rng.randrange(5, 30), y + rng.randrange(5, 30), datetime(2024, 1, 1) + timedelta(seconds=k)))
    rows += [(7, True, 10_001, 0, 0, 9, 9, rows[0][-1]), (8, False, 10_002, 0, 0, 9, 9, rows[0][-1])]  # one side only
    return rows


def batch_counts(spark, rows, iou=0.4):
    df = spark.createDataFrame(rows, SCHEMA)
    side = lambda truth, name: df.where(F.col("truth") == truth).select("tile_id", F.col("box_id").alias(name), *live.SIDES)
    pred, gt = side(False, "pred_id"), side(True, "gt_id")
    pairs = overlap.pair_measures(overlap.overlap_join(pred, gt, ("tile_id",))).where(F.col("iou") >= iou)
    pairs = pairs.select(F.col("l_tile_id").alias("tile_id"), F.col("l_pred_id").alias("pred_id"), F.col("r_gt_id").alias("gt_id"), F.col("iou").alias("value"))
    taken = match.one_to_one(pairs).join(pred.select("pred_id", "tile_id"), "pred_id")
    return sorted(map(tuple, metrics.counted(pred, gt, taken, ["tile_id"]).select("tile_id", "tp", "fp", "fn").collect()))


def run(df, tmp_path, name):
    def put(b, k):
        b.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={k}")

    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()


def test_any_order_and_a_restart_end_with_the_batch_counts(spark, tmp_path):
    rows = boxes(spark)
    want = batch_counts(spark, rows)
    assert sum(r[1] for r in want) > 30
    dealt = rows + rng_sample(rows, 30)  # some come again
    random.Random(5).shuffle(dealt)
    half = len(dealt) // 2
    for part in (dealt[:half], dealt[half:]):  # two runs over one checkpoint
        for at in range(0, len(part), 80):
            spark.createDataFrame(part[at : at + 80], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run(live.live_matching(stream), tmp_path, "out")
    out = live.latest(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(map(tuple, out.select("tile_id", "tp", "fp", "fn").collect())) == want
    assert out.where("n_pred - tp != fp or n_gt - tp != fn or closed").isEmpty()


def rng_sample(rows, k):
    return random.Random(9).sample(rows, k)


def test_tiles_close_when_nothing_comes(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    one = [(1, True, 1, 0, 0, 10, 10, t), (1, False, 2, 0, 0, 10, 9, t)]
    later = [(2, True, 1, 0, 0, 10, 10, t + timedelta(hours=5)), (None, True, 1, 0, 0, 10, 10, t), (2, True, 9, 5, 5, 5, 9, t)]
    for k, rows in enumerate([one, later, [(3, False, 4, 0, 0, 1, 1, t + timedelta(hours=6))]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run(live.live_matching(stream, ts="ts", late="1 minute", keep_ms=60_000), tmp_path, "out")
    rows = sorted((r["batch"], r["tile_id"], r["tp"], r["fn"], r["closed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [r[1:] for r in rows if not r[4]] == [(1, 1, 0, False), (2, 0, 1, False), (3, 0, 0, False)]
    assert (1, 1, 0, True) in [r[1:] for r in rows]


def test_greedy_pairs_by_hand():
    import numpy as np

    pred = np.array([[0, 0, 10, 10], [0, 0, 10, 9], [50, 50, 60, 60]], float)
    truth = np.array([[0, 0, 10, 10], [0, 1, 10, 10], [0, 0, 100, 100]], float)
    assert greedy_set(pred, truth, 0.4) == {(0, 0), (1, 1)} and greedy_set(pred[:0], truth, 0.4) == set()


def greedy_set(pred, truth, iou):
    return set(live.greedy_pairs(pred, truth, iou))
