"""Sharding by proportional stratified interleaving.

Rows of each source are put in a random order that a seed fixes; the row of rank
r (from 0) among n gets the fractional rank (r + 1/2) / n.  Sorted by it, every
stretch of rows holds every source in its share of the whole, so equal slices
are shards that match the mixture.  Shards differ by at most one row.

Nothing is ranked in one task.  Within a source, rows fall into bins of the
random number; sums over bins give where each bin starts, and rows are ranked in
their bin.  Fractional ranks spread evenly by construction, whatever the shares
of the sources, so the second ranking uses bins of them in the same way.

A null source is a source, the last one.  A row without id draws the number of
the empty id.  Rows with one id stand beside each other in the order and are
told apart by size and checksum; equal rows are interchangeable.  Null and empty
texts have size 1 and checksum 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.llm.common import col, materialize, query, table

SHARDS, SEED, BINS = 16, "shard", 4096


def _starts(rows: DataFrame, keys: list[str], bin_name: str) -> DataFrame:
    """(keys, bin, start, total): rows before each bin, and rows with these keys."""
    every = Window.partitionBy(*keys)
    before = every.orderBy(bin_name).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*keys, bin_name).agg(F.count("*").alias("n")).select(
        *[F.col(k).alias(f"k_{k}") for k in keys], F.col(bin_name).alias("k_bin"),
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"), F.sum("n").over(every).alias("total"),
    )


def _ranked(rows: DataFrame, keys: list[str], bin_name: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """Adds the rank from 0 among rows with equal keys, and their number."""
    starts = materialize(_starts(rows, keys, bin_name), "shard-bins")
    on = F.col(bin_name) == F.col("k_bin")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    inside = Window.partitionBy(*keys, bin_name).orderBy(*order)
    ranked = rows.withColumn("inside", F.row_number().over(inside) - 1).join(starts, on)
    return ranked.withColumn(rank, F.col("start") + F.col("inside")).withColumn(total, F.col("total")).drop(
        "inside", "k_bin", *[f"k_{k}" for k in keys], *[c for c in ("start", "total") if c not in (rank, total)]
    )


def assigned(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, bins: int = BINS,
             doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) per row."""
    digest = F.md5(F.concat(F.coalesce(col(doc_id).cast("string"), F.lit("")), F.lit(f"/{seed}")))
    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            col(doc_id).alias("doc_id"), col(source).alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("draw"),
        ).withColumn("bin", F.floor(F.col("draw") * F.lit(bins) / F.lit(1 << 48))),
        "shard-rows",
    )
    ties = [F.col("draw"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    strata = _ranked(rows, ["source"], "bin", ties, "rank", "total").drop("bin")
    placed = materialize(
        strata.withColumn("share", (2 * F.col("rank") + 1) / (2 * F.col("total")))
        .withColumn("bin", F.floor(F.col("share") * bins)).drop("rank", "total"),
        "shard-strata",
    )
    order = [F.col("share"), F.col("source").asc_nulls_last(), *ties]
    all_rows = _ranked(placed, [], "bin", order, "place", "total")
    shard = F.floor(F.col("place") * shards / F.col("total")).cast("int")
    first = F.ceil(shard * F.col("total") / shards)
    return all_rows.select(
        "doc_id", "source", "size", "text_crc32", shard.alias("shard"), (F.col("place") - first).cast("long").alias("slot")
    )


SQL = f"""
WITH crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps),
bytes AS (
    SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/{SEED}'), 1, 12) AS BIGINT) AS draw,
        hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS MATERIALIZED (
    SELECT b.* EXCLUDE (h), xor(list_reduce(
        list_transform(range(1, len(h) + 1, 2), lambda i: CAST('0x' || substring(h, i, 2) AS BIGINT)),
        lambda c, x: xor(c >> 8, steps[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM bytes b, crc),
shares AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, size, text_crc32) - 1)::DOUBLE
        / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS share FROM sums),
places AS (
    SELECT *, row_number() OVER (ORDER BY share, source NULLS LAST, draw, doc_id, size, text_crc32) - 1 AS place,
        count(*) OVER () AS total FROM shares)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
    CAST(place * {SHARDS} // total AS INTEGER) AS shard,
    CAST(place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM places
"""


@query("op7_sharding", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
