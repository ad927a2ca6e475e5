"""Continuous archive ingest: inventory rows upserted by path, and exposure per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.operators.archive import deck_merge


def _versions(spark: SparkSession, library: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(library)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{library}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def current_library(spark: SparkSession, library: str) -> DataFrame | None:
    """Newest complete version of the library."""
    done = _versions(spark, library)
    return spark.read.parquet(f"{library}/v={done[-1]}") if done else None


def ingest_deck(files: DataFrame, library: str, checkpoint: str) -> StreamingQuery:
    """Merge arriving inventory rows into the library; a batch that runs again writes its own version again."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, library) if v < batch_id]
        incoming = batch.dropDuplicates(["path"])
        if earlier:
            incoming = deck_merge(spark.read.parquet(f"{library}/v={earlier[-1]}"), incoming)
        incoming.write.mode("overwrite").parquet(f"{library}/v={batch_id}")

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exposure_per_day(files: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Running exposure and frame count per observation day, closed once the watermark passes the day."""
    return (
        files.withWatermark("observation_time", lateness)
        .groupBy(F.window("observation_time", "1 day"))
        .agg(F.sum("exposure_seconds").alias("exposure_seconds"), F.count(F.lit(1)).alias("frame_count"))
    )
