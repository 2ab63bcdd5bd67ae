"""Joining big inputs to one-row-per-key tables when keys are very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostlens.config import Settings


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    size_col: str,
    row_id: list[str],
    settings: Settings,
) -> DataFrame:
    """Left join ``rows`` to ``per_key``, which has one row per ``keys``.

    ``per_key`` carries in ``size_col`` how many rows its key has.  A key with
    more than ``rows_per_task`` rows is joined in as many parts as it has such
    portions: its entry is repeated for each part, and its rows are dealt to the
    parts by a hash of ``row_id``.  All that is broadcast is the number of parts
    of these keys, of which there are at most rows / ``rows_per_task``.
    """
    values = [c for c in per_key.columns if c not in keys]
    parts = F.ceil(F.col(size_col) / settings.rows_per_task)
    large = per_key.where(F.col(size_col) > settings.rows_per_task).select(*keys, parts.alias("_parts"))
    spread = per_key.select(
        *keys,
        F.struct(*values).alias("_entry"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.coalesce(parts, F.lit(1)), F.lit(1)) - 1)).alias("_salt"),
    )
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*row_id), F.coalesce("_parts", F.lit(1)).cast("bigint"))
    )
    picked = [F.col(f"_entry.{c}").alias(c) for c in values]
    return dealt.join(spread, [*keys, "_salt"], "left").select(*rows.columns, *picked)
