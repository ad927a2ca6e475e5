"""Readers and writers of the survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_FILTER = "unknown"


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurements with a non-null filter, so that every later join can use plain equality."""
    return spark.read.parquet(path).withColumn("filter_name", F.coalesce("filter_name", F.lit(UNKNOWN_FILTER)))


def _flat(rows: DataFrame) -> DataFrame:
    """List columns as "; "-joined text and maps or structs as JSON, for text formats."""
    out = []
    for f in rows.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.concat_ws("; ", F.col(f.name).cast("array<string>")).alias(f.name))
        elif kind in ("map", "struct"):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return rows.select(*out)


def write_rows(rows: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write measurements, light curves or science rows as parquet, csv or json, partitioned by the given columns."""
    if form == "csv":
        rows = _flat(rows)
    writer = rows.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_science(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Accepted and rejected science rows side by side in folders ``accepted=true`` and ``accepted=false``."""
    write_rows(rows, path, form, by=("accepted",))


def append_run(spark: SparkSession, history_path: str, report: DataFrame) -> None:
    """Append one run report per object to the history (JSON lines)."""
    report.withColumn("run_time", F.current_timestamp()).write.mode("append").json(history_path)


RUN_SCHEMA = (
    "object_name string, file_count long, solved_count long, measurement_count long, light_curve_count long, run_time timestamp"
)


def run_history(spark: SparkSession, history_path: str, object_name: str | None = None) -> DataFrame:
    """Past runs, newest first."""
    rows = spark.read.schema(RUN_SCHEMA).json(history_path)
    if object_name is not None:
        rows = rows.where(F.col("object_name") == object_name)
    return rows.orderBy(F.desc("run_time"))
