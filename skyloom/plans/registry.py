"""All named queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("photometry", "archive", "catalogs", "series", "reports", "pixels", "linking", "learning", "forced")


def _in_utc(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for area in AREAS:
        for name, fn in import_module(f"skyloom.plans.{area}").QUERIES.items():
            out[name] = _in_utc(fn)
    return out
