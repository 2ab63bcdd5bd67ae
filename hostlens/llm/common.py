"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens.sources.store import materialize

#: of one Arrow batch; what a Python worker holds at once follows from it
BATCH_BYTES = "1m"
BATCH_SETTING, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: tables of at most so many rows are broadcast, larger ones are joined by a shuffle
BROADCAST_ROWS = 50_000

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Python workers get at most ``BATCH_BYTES`` at once, or one row, unless the
    session sets a size of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        conf.set(BATCH_SETTING, BATCH_BYTES)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def attach(df: DataFrame, lookup: DataFrame, key: str, value: str, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with column ``value`` of ``lookup`` (one row per ``key``, nulls match).

    ``lookup`` is counted first: up to ``rows`` rows it is broadcast; beyond
    that the join shuffles and adaptive execution splits hot keys.
    """
    (k,) = fresh(df, "_key")
    right = lookup.select(col(key).alias(k), col(value)) if how == "left" else lookup.select(col(key).alias(k))
    if lookup.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    return df.join(right, col(key).eqNullSafe(col(k)), how).drop(k) if how == "left" else df.join(right, col(key).eqNullSafe(col(k)), how)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


__all__ = ["REGISTRY", "attach", "col", "fresh", "held_out", "materialize", "query", "small_batches", "table"]
