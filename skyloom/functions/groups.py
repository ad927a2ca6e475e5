"""Exact per-group statistics and ordering that stay distributed when one group is huge.

Every helper has two exact forms. When no group is larger than ``GROUP_ROW_LIMIT`` rows (checked with
one map-side-combined count) the plain Spark form is used: one shuffle on the group key. Otherwise the
work of a large group is divided over many tasks by value bracket (order statistics) or by time slot
(row numbers and neighbours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numeric import MAD_TO_SIGMA, finite, let

GROUP_ROW_LIMIT = 1_000_000
BRACKET = 0.001
SKETCH_ACCURACY = 10_000


def groups_fit(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """True when no group of ``keys`` has more rows than the limit (one keys-only aggregate)."""
    bound = GROUP_ROW_LIMIT if limit is None else limit
    return df.groupBy(*keys).count().where(F.col("count") > bound).isEmpty()


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitions that stay apart: small rows with costly work per group must not be coalesced into one task."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, df.sparkSession.sparkContext.defaultParallelism), *keys)


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-group columns back to the rows. Keys are never null (readers write "unknown" for a missing filter)."""
    return df.join(stats, keys, how)


def group_quantiles(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], fits: bool | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of the finite values of each group.

    Large-group form: a sketch proposes a narrow bracket around each wanted rank, exact counts say which
    region of the value axis really holds the rank, and only the distinct values of that region are
    ranked. A poor sketch costs time, never accuracy.
    """
    vals = df.where(finite(value)).select(*keys, value.cast("double").alias("__v"))
    if fits is None:
        fits = groups_fit(vals, keys)
    if fits:
        return vals.groupBy(*keys).agg(*[F.percentile("__v", F.lit(p)).alias(a) for a, p in probs.items()])

    hist = vals.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    edges_at = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-BRACKET, BRACKET)})
    sketch = vals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", [float(e) for e in edges_at], SKETCH_ACCURACY).alias("__edges"),
    )
    region = F.size(F.filter("__edges", lambda e: e < F.col("__v")))
    placed = attach(hist, sketch, keys, "inner").withColumn("__r", region).drop("__edges")
    starts = (
        placed.groupBy(*keys, "__r")
        .agg(F.sum("__c").alias("__rc"), F.first("__n").alias("__n"))
        .withColumn(
            "__start",
            F.coalesce(
                F.sum("__rc").over(Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    ranks = []
    for a, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(p)
        for end, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            ranks.append(F.struct(F.lit(a).alias("a"), F.lit(end).alias("e"), r.cast("long").alias("r"), pos.alias("pos")))
    wanted = (
        starts.withColumn("__w", F.explode(F.array(*ranks)))
        .where((F.col("__w.r") >= F.col("__start")) & (F.col("__w.r") < F.col("__start") + F.col("__rc")))
        .select(*keys, "__r", "__start", "__w")
    )
    regions = wanted.groupBy(*keys, "__r").agg(F.first("__start").alias("__start"))
    w = Window.partitionBy(*keys, "__r").orderBy("__v")
    ordered = attach(placed.drop("__n"), regions, [*keys, "__r"], "inner").withColumn(
        "__end", F.col("__start") + F.sum("__c").over(w)
    )
    hits = attach(wanted.drop("__start"), ordered.drop("__start"), [*keys, "__r"], "inner").where(
        (F.col("__w.r") < F.col("__end")) & (F.col("__w.r") >= F.col("__end") - F.col("__c"))
    )
    aggs = []
    for a in probs:
        lo = F.max(F.when((F.col("__w.a") == a) & (F.col("__w.e") == "lo"), F.col("__v")))
        hi = F.max(F.when((F.col("__w.a") == a) & (F.col("__w.e") == "hi"), F.col("__v")))
        frac = F.max(F.when(F.col("__w.a") == a, F.col("__w.pos") - F.floor(F.col("__w.pos"))))
        aggs.append((lo + (hi - lo) * frac).alias(a))
    return hits.groupBy(*keys).agg(*aggs)


def with_median(df: DataFrame, keys: list[str], value: Column, name: str, fits: bool) -> DataFrame:
    """Add the group median of the finite values to every row."""
    if fits:
        w = Window.partitionBy(*keys)
        return df.withColumn(name, F.median(F.when(finite(value), value)).over(w))
    return attach(df, group_quantiles(df, keys, value, {name: 0.5}, fits=False), keys)


def with_robust_scale(
    df: DataFrame, keys: list[str], value: Column, center: str, scale: str, fits: bool, minimum: int = 3
) -> DataFrame:
    """Add group median and 1.4826*MAD (null when fewer than ``minimum`` values or MAD is 0)."""
    out = with_median(df, keys, value, center, fits)
    out = with_median(out, keys, F.abs(value - F.col(center)), "__mad", fits)
    n = F.count(F.when(finite(value), F.lit(1)))
    if fits:
        out = out.withColumn("__n", n.over(Window.partitionBy(*keys)))
    else:
        out = attach(out, df.groupBy(*keys).agg(n.alias("__n")), keys)
    return out.withColumn(
        scale, F.when((F.col("__n") >= minimum) & (F.col("__mad") > 0), F.lit(MAD_TO_SIGMA) * F.col("__mad"))
    ).drop("__mad", "__n")


def numbered(df: DataFrame, keys: list[str], time: str, ties: list[str], name: str, fits: bool, slot: float = 86400.0) -> DataFrame:
    """Row number in time order per group.

    Large-group form: number rows inside (group, time slot), then add the running count of earlier slots. Rows without a
    time come first in both forms; they share one slot before all others.
    """
    if fits:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(time, *ties)).cast("long"))
    slotted = df.withColumn("__slot", F.coalesce(F.floor(F.col(time).cast("double") / F.lit(slot)), F.lit(-(1 << 62))))
    base = (
        slotted.groupBy(*keys, "__slot")
        .agg(F.count(F.lit(1)).alias("__cnt"))
        .withColumn(
            "__base",
            F.coalesce(
                F.sum("__cnt").over(Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("__cnt")
    )
    local = slotted.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__slot").orderBy(time, *ties)))
    return attach(local, base, [*keys, "__slot"]).withColumn(name, F.col("__base") + F.col("__rn")).drop("__slot", "__base", "__rn")


def neighbours(
    df: DataFrame, keys: list[str], time: str, ties: list[str], value: Column, before: int, after: int, name: str, fits: bool
) -> DataFrame:
    """Add an array of ``struct(d, v)`` for the rows at positions -before..+after in time order.

    Null values keep their position. Large-group form: each row is sent to the few positions around it, so a
    shuffled group has at most before+after+1 rows.
    """
    item = F.struct(value.alias("v"))
    if fits:
        w = Window.partitionBy(*keys).orderBy(time, *ties).rowsBetween(-before, after)
        return df.withColumn(name, F.transform(F.collect_list(item).over(w), lambda s: s["v"]))
    seq = numbered(df, keys, time, ties, "__seq", False)
    sent = seq.select(
        *keys,
        F.explode(F.sequence(F.col("__seq") - after, F.col("__seq") + before)).alias("__seq"),
        F.struct(F.col("__seq").alias("p"), value.alias("v")).alias("__s"),
    )
    local = sent.groupBy(*keys, "__seq").agg(F.transform(F.array_sort(F.collect_list("__s")), lambda s: s["v"]).alias(name))
    return attach(seq, local, [*keys, "__seq"]).drop("__seq")


def with_previous(df: DataFrame, keys: list[str], time: str, ties: list[str], columns: dict[str, str], fits: bool) -> DataFrame:
    """Add the previous row's values (``columns``: new name -> source column) in time order."""
    if fits:
        w = Window.partitionBy(*keys).orderBy(time, *ties)
        for new, src in columns.items():
            df = df.withColumn(new, F.lag(src).over(w))
        return df
    seq = numbered(df, keys, time, ties, "__seq", False)
    prev = seq.select(*keys, (F.col("__seq") + 1).alias("__seq"), *[F.col(s).alias(n) for n, s in columns.items()])
    return attach(seq, prev, [*keys, "__seq"]).drop("__seq")


def array_median(values: Column) -> Column:
    """Median of a short array, ignoring nulls."""

    def middle(v):
        n = F.size(v)
        lo = F.try_element_at(v, F.floor((n + 1) / 2).cast("int"))
        hi = F.try_element_at(v, F.floor((n + 2) / 2).cast("int"))
        return F.when(n > 0, (lo + hi) / F.lit(2.0))

    return let(F.array_sort(F.filter(values, lambda x: x.isNotNull())), middle)
