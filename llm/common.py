"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.lineage import checkpoint_dir, cut

__all__ = ["cut", "checkpoint_dir", "table", "held_out", "small_batches", "text_bytes", "row_keys", "pieces_for", "stored"]

#: Rows handed to numpy code at a time; a batch of long texts is cut at this many bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written in decimal leaves 2; a null id counts as training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * limit / max(batch.column(column).nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column (one map-side-combined aggregate)."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def row_keys(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns: a null-free join key for rows without a sure id."""
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def pieces_for(df: DataFrame, total: int, each: int) -> int:
    """Number of groups so that one holds about ``each`` units, and no fewer than twice the cores."""
    return max(1, -(-total // each), 2 * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the session's shared folder and read it back (a lost executor loses nothing)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)
