"""Order-dependent work without putting a whole key into one task.

``consecutive_pairs`` cuts the timeline of each key into chunks, looks at
neighbours inside a chunk, and links chunks through their edge rows only.
``cumulative_counts`` and what follows from it (ranks, quantiles, ROC area)
work on a histogram of distinct values, cut into bins of an order-preserving
scale, so that only one row per bin is ever put in order as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def consecutive_pairs(
    df: DataFrame, keys: list[str], order: list[str], carry: list[str], chunk: Column
) -> DataFrame:
    """Each row of a key with its direct predecessor.

    Returns ``keys``, ``prev`` and ``cur``, both structs of ``order + carry``.
    ``chunk`` must not decrease along ``order``.
    """
    link = F.struct(*order, *carry)
    slots = Window.partitionBy(*keys, "_chunk").orderBy(*[f"cur.{c}" for c in order])
    linked = (
        df.select(*keys, chunk.alias("_chunk"), link.alias("cur"))
        .withColumn("prev", F.lag("cur").over(slots))
        .withColumn("_last", F.lead("cur").over(slots).isNull())
    )
    inside = linked.where(F.col("prev").isNotNull()).select(*keys, "prev", "cur")
    # first and last row of every chunk: at most two rows per chunk and key
    line = Window.partitionBy(*keys).orderBy(*[f"cur.{c}" for c in order])
    across = (
        linked.where(F.col("prev").isNull() | F.col("_last"))
        .select(*keys, "cur", F.col("prev").isNull().alias("_first"), F.lag("cur").over(line).alias("prev"))
        .where(F.col("_first") & F.col("prev").isNotNull())
        .select(*keys, "prev", "cur")
    )
    return inside.unionByName(across)


def positions(df: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """1-based position of each row within its key, chunk by chunk.

    ``chunk`` must not decrease along ``order``.  Only the row counts of the
    chunks are put in order over a whole key.
    """
    rows = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        rows.withColumn("_inside", inside)
        .join(offsets, [*keys, "_chunk"])
        .withColumn("position", (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop("_inside", "_offset", "_chunk")
    )


def value_bin(value: Column) -> Column:
    """Order-preserving bin of a finite double, 64 bins per doubling."""
    size = F.floor(F.log2(1.0 + F.abs(value) * float(1 << 20)) * 64.0)
    return F.when(value < 0, -size).otherwise(size).cast("int")


def cumulative_counts(
    df: DataFrame, keys: list[str], value: str, counts: dict[str, Column] | None = None
) -> DataFrame:
    """Histogram of ``value`` per key with the running counts below each value.

    For every ``name -> condition`` in ``counts`` the result has ``name`` (rows
    with this value), ``below_name`` (rows with a smaller value) and
    ``total_name`` (rows of the key).
    """
    counts = counts or {"n": F.lit(True)}
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counts.items()])
        .withColumn("_bin", value_bin(F.col("value")))
    )
    bins = hist.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(f"_{n}") for n in counts])
    before_bin = (
        Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    bins = bins.select(
        *keys,
        "_bin",
        *[F.coalesce(F.sum(f"_{n}").over(before_bin), F.lit(0)).alias(f"_{n}") for n in counts],
        *[F.sum(f"_{n}").over(Window.partitionBy(*keys)).alias(f"total_{n}") for n in counts],
    )
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return hist.join(bins, keys + ["_bin"]).select(
        *keys,
        "value",
        *counts,
        *[
            (F.col(f"_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"below_{n}")
            for n in counts
        ],
        *[f"total_{n}" for n in counts],
    )


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact linearly interpolated quantile of ``value`` per key.

    Only the two neighbours of the wanted rank leave the histogram, so no
    group is held in memory.
    """
    hist = cumulative_counts(df, keys, value)
    place = (F.col("total_n") - 1) * F.lit(float(q))
    low, high = F.floor(place), F.ceil(place)
    holds = lambda rank: (F.col("below_n") <= rank) & (rank < F.col("below_n") + F.col("n"))
    share = place - low
    return (
        hist.where(holds(low) | holds(high))
        .groupBy(*keys)
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("_lo"),
            F.max(F.when(holds(high), F.col("value"))).alias("_hi"),
            F.max(share).alias("_share"),
        )
        .select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).alias(name))
    )


def mid_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their 1-based rank, ties sharing the average."""
    hist = cumulative_counts(df, keys, value)
    return hist.select(
        *keys, "value", "n", (F.col("below_n") + (F.col("n") + 1) / 2.0).alias("mid_rank")
    )
