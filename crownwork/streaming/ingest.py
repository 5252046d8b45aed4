"""Incremental ingest and running counts with Structured Streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def ingest_tiles(stream: DataFrame, biomes: list[str], path: str, checkpoint: str) -> DataStreamWriter:
    """Appends the tiles of the wanted biomes to Parquet at path, each image_id once, however long ago it was first seen.

    The ids that a run has seen are in its state store, where a batch looks up its own ids only, so batches cost the same
    however many went before; with RocksDB as provider (spark.sql.streaming.stateStore.providerClass) they are on disk. A
    run is named by its checkpoint. One with a new checkpoint adds to what earlier ones wrote, whose ids, and no others, its
    batches read from there. A batch is written to a folder of its own (run=..., batch=...), which takes the place of what
    an interrupted try of it left there. Tiles without image_id can't be told apart and are left out. Of rows of one
    image_id any may be the one that stays."""

    def add(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch
        run = "run=" + (spark.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha256(checkpoint.encode()).hexdigest()[:16])
        others = [f"{path}/{name}" for name in _folders(spark, path) if name.startswith("run=") and name != run]
        if others:
            known = spark.read.schema(T.StructType([batch.schema["image_id"]])).parquet(*others)
            new = batch.join(known.select("image_id"), "image_id", "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{path}/{run}/batch={number}")

    wanted = stream.where(F.col("biome_name").isin(*biomes) & F.col("image_id").isNotNull()).dropDuplicates(["image_id"])
    return wanted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def live_metrics(stream: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Running n_pred, n_tp and value_sum by tile; only sums, which late rows can still change."""
    return stream.groupBy("tile_id").agg(F.count("*").alias("n_pred"), F.count_if(F.col("value") >= threshold).alias("n_tp"), F.sum("value").alias("value_sum"))
