"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native functions only).

Each source's documents are laid on a line in a hashed order, and the mix takes the first ``target`` words of that
line, repeated once where the target exceeds the source. The taken line is cut into blocks of equal word count. A
binary tree splits the exact block quotas of all sources among the output shards: at every node half of the blocks
go left, and how many of them come from each source is a multivariate-hypergeometric draw. A shard then owns
disjoint, permuted blocks of every source and orders its own pieces by a hash.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; sizes of 0 take
nothing; an empty table gives no rows; equal rows are placed separately; other columns are ignored by ``mix_plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import cut, row_keys

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 16_384
BLOCKS_PER_SHARD = 64
BUCKET_ROWS = 5_000
SEED = 20_240_607
#: Odd prime used to permute block numbers inside a source.
STEP = 2_147_483_647


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: index, size, rows, weight and target words (weights, then caps, then the excess reshared)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = (
        per.withColumn("source_index", F.row_number().over(ordered) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("source_index") % len(WEIGHTS) + 1))
        .withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    )
    # Sources reach their cap in the order of cap / weight; the level is set by those that stay below.
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_index").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = weighed.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "source_index", "level"))).over(everything)["level"]
    return levelled.withColumn(
        "target", F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    ).select("source", "source_index", "source_size", "n_rows", "weight", "target")


def _log_factorial(n: Column) -> Column:
    """Exact logarithms below 16, Stirling's series above (error under 1e-12)."""
    x = n.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 16, small).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _hypergeometric(kind: Column, others: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``kind`` items are among ``drawn`` out of kind + others (inverse of the distribution function)."""
    total = kind + others
    share = kind / F.greatest(total, F.lit(1))
    spread = F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    middle = F.floor(drawn * share).cast("long")
    reach = F.ceil(9 * spread).cast("long") + 9
    low = F.greatest(F.lit(0).cast("long"), drawn - others, middle - reach)
    high = F.least(kind, drawn, middle + reach)
    chance = F.transform(
        F.sequence(low, high), lambda x: F.exp(_log_choose(kind, x) + _log_choose(others, drawn - x) - _log_choose(total, drawn))
    )
    mass = F.aggregate(chance, F.lit(0.0), lambda a, x: a + x)
    found = F.aggregate(
        chance,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + (a["sum"] + x < uniform * mass).cast("long")).alias("n")),
        lambda a: a["n"],
    )
    return F.least(high, low + found)


def _uniform(*columns: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11) + 0.5) / F.lit(float(1 << 53))


def _draw(depth: int):
    """Step over the sources of a node: draw from this one, given what is still wanted and left."""

    def step(state: Column, quota: Column) -> Column:
        others = state["left"] - quota
        drawn = _hypergeometric(quota, others, state["want"], _uniform(F.lit(depth), F.col("shard"), state["i"]))
        return F.aggregate(
            F.array(drawn), state,
            lambda s, x: F.struct(
                (s["want"] - x).alias("want"), others.alias("left"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(x)).alias("out")
            ),
        )

    return step


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``source_index, quota`` -> ``shard, source_index, first_block, n_blocks``; ``shards`` is a power of two.

    The tree holds one small row per node and source count, never blocks or documents.
    """
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("source_index", F.col("quota").cast("long").alias("quota")))).alias("q")).select(
        F.lit(0).cast("long").alias("shard"), F.transform("q", lambda s: s["quota"]).alias("q"), F.transform("q", lambda s: s["source_index"]).alias("ids")
    )
    for depth in range(int(math.log2(shards))):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        placed = tree.withColumn("total", total)
        start = F.struct(
            F.floor((F.col("total") + 1) / 2).cast("long").alias("want"), F.col("total").alias("left"), F.lit(0).cast("long").alias("i"),
            F.array().cast("array<bigint>").alias("out"),
        )

        drawn = placed.withColumn("l", F.aggregate("q", start, _draw(depth), lambda s: s["out"]))
        tree = drawn.select("ids", F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("l").alias("q")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")),
        )).alias("x")).select("x.shard", "x.q", "ids")
        tree = cut(tree)
    flat = tree.select("shard", F.explode(F.arrays_zip("ids", "q")).alias("x")).select(
        "shard", F.col("x.ids").alias("source_index"), F.col("x.q").alias("n_blocks")
    )
    earlier = Window.partitionBy("source_index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first_block", F.coalesce(F.sum("n_blocks").over(earlier), F.lit(0).cast("long")))


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: ``k1, k2`` (row key), doc_id, size, source_size, target, taken, and the shard of its first words;
    ``passes`` and ``shards`` hold the words and the shard of each pass over the source.

    A hot source is laid out in hashed buckets: offsets of buckets come from a small table, offsets inside a bucket
    from a window over about ``BUCKET_ROWS`` rows.
    """
    k1, k2 = row_keys("doc_id", "source", "text")
    sizes = cut(docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = cut(source_targets(sizes))
    rows = sizes.withColumnRenamed("source", "s").join(F.broadcast(sources) if _few(sources) else sources, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    order = F.xxhash64(F.lit(SEED), "k1", "k2")
    rows = rows.withColumn("bucket", F.pmod(order, F.ceil(F.col("n_rows") / BUCKET_ROWS))).withColumn("order", F.xxhash64(F.lit(SEED + 1), "k1", "k2"))
    buckets = rows.groupBy("source_index", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("source_index", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0).cast("long")).alias("base"))
    inside = Window.partitionBy("source_index", "bucket").orderBy("order", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
        .join(bases, ["source_index", "bucket"])
        .withColumn("start", F.col("base") + F.col("inner"))
    )
    end = F.floor("target").cast("long")

    def of_pass(n: int) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), end - (F.col("start") + n * F.col("source_size"))))

    taken = [of_pass(n) for n in range(MOST)]
    total = taken[0]
    for t in taken[1:]:
        total = total + t
    laid = laid.withColumn("taken", total).withColumn("passes", F.array(*taken))

    quotas = sources.select("source_index", F.ceil(F.floor("target") / BLOCK_WORDS).cast("long").alias("quota"))
    blocks = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = 1 << max(0, math.ceil(math.log2(max(1, blocks / BLOCKS_PER_SHARD))))
    split = split_quotas(quotas, shards).join(quotas, "source_index")
    place = (
        split.where("n_blocks > 0")
        .select("source_index", "shard", "quota", F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("n_blocks") - 1)).alias("drawn"))
        .select("source_index", "shard", F.pmod(F.col("drawn") * STEP + F.col("source_index"), F.col("quota")).alias("block"))
    )
    # Each pass of a document goes, uncut, to the shard of the block in which that pass of it begins.
    for n in range(MOST):
        first = F.floor((F.col("start") + n * F.col("source_size")) / BLOCK_WORDS).cast("long")
        own = place.select("source_index", "block", F.col("shard").alias(f"shard_{n}"))
        laid = laid.withColumn("block", F.when(F.col("passes")[n] > 0, first)).join(own, ["source_index", "block"], "left").drop("block")
    shards_of = F.array(*[F.col(f"shard_{n}") for n in range(MOST)])
    return laid.select("k1", "k2", "doc_id", "size", "source_size", "target", "taken", "passes", F.col("shard_0").alias("shard"), shards_of.alias("shards"))


def _few(sources: DataFrame) -> bool:
    """Whether the per-source table is small enough to send to every task (at most a thousand rows)."""
    return sources.count() <= 1_000


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows themselves with the columns of ``docs``: a document taken twice comes twice, the last one of a
    source is cut to the words taken (joined by single spaces), ``n_chars`` follows where it exists. Rows of a shard
    stand together, in hashed order."""
    columns = docs.columns
    keys = row_keys("doc_id", "source", "text")
    plan = mix_plan(docs).where("taken > 0").select("k1", "k2", "size", "passes", "shards")
    keyed = docs.withColumns({"__k1": keys[0], "__k2": keys[1]})
    rest = [c for c in columns]
    texts = keyed.groupBy("__k1", "__k2").agg(F.first(F.struct(*rest)).alias("__row"))
    pieces = plan.select("k1", "k2", "size", "shards", F.posexplode("passes").alias("pass", "words")).where("words > 0").select(
        F.col("pass").alias("__pass"),
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("size").alias("__size"), F.col("words").alias("__words"), F.col("shards")[F.col("pass")].alias("__shard")
    )
    joined = texts.join(pieces, ["__k1", "__k2"])
    text = F.when(F.col("__words") >= F.col("__size"), F.col("__row.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(F.col("__row.text"), F.lit(f"({WORD})"), 1), 1, F.col("__words").cast("int")), " ")
    )
    out = joined.select("__shard", "__pass", "__words", "__size", *[(text if c == "text" else F.col(f"__row.{c}")).alias(c) for c in columns])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__words") < F.col("__size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    order = F.xxhash64(F.lit(SEED + 2), "doc_id", "text", "__pass")
    return out.repartitionByRange("__shard", order).sortWithinPartitions("__shard", order).select(*columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "shard")
