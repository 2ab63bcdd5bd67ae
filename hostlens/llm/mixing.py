"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the corpus by weight; a source that would be taken
more than ``max_repeats`` times stops there and its excess is shared again by
weight.  With one number x per corpus, targets are min(max_repeats * size,
x * weight), and x follows from sums over the sources in the order in which
they reach their limit.

A document is expected e = target / size of its source times.  It gets floor(e)
whole copies for certain, and one more with the inclusion probability p that is
left.  Documents of a source are ranked by the odds of a random number u divided
by the odds of p (Pareto order sampling), and taken in that order as long as the
words that are due last; the sample has a fixed size in words.  What the next
document overshoots is filled by documents that fit, in the same order, and one
document more is taken if that brings the source nearer to its target.

Random numbers are hashes of doc_id and seed, so reruns agree.  Rows that share id
and source are numbered by size, and a number beyond the first is hashed as well,
so repeated rows, and rows without id, are taken one by one like any others.  The order of a
source is summed in bins, not in one task: only the bin in which the words run
out is ranked row by row.  What is decided per source is a short list of
(words due, last place taken); rows are compared with that list.

Null and empty texts have size 0 and are never taken.  A null source is a source,
the last one.  An empty table gives an empty
result.  Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.llm.common import attach, col, fresh, materialize, query, table
from hostlens.operators.ordered import positions

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order."""

    weights: tuple[int, ...] = (1, 2, 3)
    max_repeats: int = 3
    seed: str = "mix"
    bins: int = 1 << 14
    fills: int = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Ordered by size per weight, the sources up to some place are at their limit;
    the rest shares what they leave.  The first place where the rest stays below
    its own limit is the right one.
    """
    total = sizes.agg(F.sum("source_size")).first()[0]
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, mix.weights))
    weighed = sizes.select(
        "source", "source_size", F.element_at(weights, ((F.row_number().over(order) - 1) % len(mix.weights)) + 1).alias("weight")
    )
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    tried = weighed.select(
        "*",
        ((F.lit(total or 0) - mix.max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         / F.sum("weight").over(rest)).alias("x"),
    ).withColumn("below", F.col("x") * F.col("weight") <= mix.max_repeats * F.col("source_size"))
    share = F.min(F.when(F.col("below"), F.struct(F.col("source_size") / F.col("weight"), F.col("x")))).over(Window.partitionBy())
    limit = (mix.max_repeats * F.col("source_size")).cast("double")
    return tried.select("*", share.getField("x").alias("share")).select(
        "source", "source_size",
        F.when(F.col("share").isNull(), limit).otherwise(F.least(limit, F.col("share") * F.col("weight"))).alias("target"),
    )


def numbered(rows: DataFrame, doc_id: str, source: str, size: str, out: str) -> DataFrame:
    """``rows`` and how many rows with the same id and source come before each, by size.

    Only rows whose id and source occur again are put in order, in chunks of one size,
    some hashes and one partition, so that neither a crowd without ids nor one
    row repeated many times meets in one task.
    """
    key, other, row_hash, part, at = fresh(rows, "_key", "_again", "_hash", "_part", "_at")
    named = rows.withColumn(key, F.to_json(F.struct(col(doc_id).alias("id"), col(source).alias("source"))))
    again = materialize(named.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias(other)), "mix-repeated")
    if again.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("long"))
    same = F.col(key) == F.col(other)
    once = named.join(again, same, "left_anti").withColumn(out, F.lit(0).cast("long"))
    some = (
        named.join(again, same, "left_semi")
        .withColumn(row_hash, F.shiftright(F.xxhash64(*map(col, rows.columns)), 50)).withColumn(part, F.spark_partition_id())
    )
    order = [size, row_hash, part]
    placed = positions(
        materialize(some.withColumn(at, F.struct(*map(col, order))), "mix-repeats"), [key], [at], F.col(at)
    ).withColumn(out, F.col("position") - 1)
    columns = [*map(col, rows.columns), col(out)]
    return once.select(*columns).unionByName(placed.select(*columns))


def uniform(doc_id: Column, seed: str, again: Column | None = None) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of id and seed, and of the
    number of a repeated row."""
    number = F.lit("") if again is None else F.when(again > 0, F.concat(F.lit("/"), again.cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}"), number))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def _cut(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source, cut, taken): how far down the order of a source the words due last.

    ``rows`` (source, place, size, due) hold candidates; places lie in (0, 1).
    """
    rows = rows.withColumn("bin", F.floor(F.col("place") * mix.bins))
    ordered = Window.partitionBy("source").orderBy("bin")
    bins = (
        rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("place").alias("top"), F.max("due").alias("due"))
        .withColumn("before", F.sum("words").over(ordered) - F.col("words"))
        .withColumn("fits", F.col("before") + F.col("words") <= F.col("due"))
    )
    first = F.min(F.when(~F.col("fits"), F.struct("bin", "before")))
    ends = materialize(
        bins.groupBy("source").agg(
            first.alias("edge"),
            F.max(F.when(F.col("fits"), F.struct("bin", "top", (F.col("before") + F.col("words")).alias("sum")))).alias("whole"),
        ).select("source", F.struct("edge", "whole").alias("ends")),
        "mix-ends",
    )
    place = Window.partitionBy("source").orderBy("place")
    inside = (
        attach(rows, ends, "source", "ends").where(F.col("bin") == F.col("ends.edge.bin"))
        .groupBy("source", "place").agg(F.sum("size").alias("size"), F.max("due").alias("due"), F.max("ends.edge.before").alias("before"))
        .withColumn("sum", F.col("before") + F.sum("size").over(place))
        .where(F.col("sum") <= F.col("due"))
        .groupBy("source").agg(F.struct(F.max("place").alias("top"), F.max("sum").alias("sum")).alias("last"))
    )
    best = F.coalesce(
        F.when(F.col("last").isNotNull(), F.struct("last.top", "last.sum")), F.struct("ends.whole.top", "ends.whole.sum")
    )
    return materialize(
        attach(ends, materialize(inside, "mix-inside"), "source", "last").select(
            "source",
            F.struct(F.coalesce(best["top"], F.lit(-1.0)).alias("cut"), F.coalesce(best["sum"], F.lit(0)).alias("taken")).alias("step"),
        ),
        "mix-cuts",
    )


def _taken(size: Column, place: Column, steps: Column) -> Column:
    return F.exists(steps, lambda s: (size <= s["due"]) & (place <= s["cut"]))


def plan(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, plan) from rows (doc_id, source, size, again): plan holds source_size,
    target, expected, certain, and the steps that say who gets one copy more."""
    rows = materialize(sizes.select("doc_id", "source", "size", "again"), "mix-sizes")
    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = materialize(
        targets(totals, mix).withColumn("expected", expected).withColumn("certain", F.floor("expected"))
        .select("source", F.struct("source_size", "target", "expected", "certain").alias("plan"),
                (F.col("target") - F.col("certain") * F.col("source_size")).alias("due"),
                F.lit(None).cast("array<struct<due:double,cut:double>>").alias("steps")),
        "mix-plan",
    )

    def untaken(most: Column) -> DataFrame:
        state = sources.select("source", F.struct("plan", "due", "steps").alias("state"))
        found = attach(rows, state, "source", "state").select(
            "source", "size", place(F.col("doc_id"), F.col("state.plan"), mix, F.col("again")).alias("place"), F.col("state.due").alias("due"),
            F.coalesce(F.col("state.steps"), F.array()).alias("steps"),
        ).where(F.col("place").isNotNull() & (F.col("size") > 0) & most)
        return found.where(~_taken(F.col("size"), F.col("place"), F.col("steps"))).drop("steps")

    for _ in range(mix.fills + 1):
        cuts = _cut(untaken(F.col("size") <= F.col("due")), mix)
        step = F.struct("due", F.coalesce("step.cut", F.lit(-1.0)).alias("cut"))
        sources = materialize(
            attach(sources, cuts, "source", "step").select(
                "source", "plan", (F.col("due") - F.coalesce("step.taken", F.lit(0))).alias("due"),
                F.concat(F.coalesce("steps", F.array().cast("array<struct<due:double,cut:double>>")), F.array(step)).alias("steps"),
            ),
            "mix-plan",
        )
    nearest = F.struct(F.abs(F.col("size") - F.col("due")).alias("gap"), "place", "size")
    last = materialize(
        untaken(F.col("size") < 2 * F.col("due")).groupBy("source").agg(F.min(nearest).alias("last")), "mix-last"
    )
    return attach(sources, last, "source", "last").select("source", F.struct("plan.*", "steps", "last").alias("plan"))


def place(doc_id: Column, plan: Column, mix: Mix, again: Column | None = None) -> Column:
    """Odds of the random number over odds of inclusion, mapped to (0, 1); null if
    the source needs no more than whole copies."""
    u, p = uniform(doc_id, mix.seed, again), plan["expected"] - plan["certain"]
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, odds / (1 + odds))


def copies(doc_id: Column, size: Column, plan: Column, mix: Mix, again: Column | None = None) -> Column:
    at, last = place(doc_id, plan, mix, again), plan["last"]
    more = F.coalesce(_taken(size, at, plan["steps"]), F.lit(False)) | F.coalesce(
        (size == last["size"]) & (at == last["place"]), F.lit(False)
    )
    return F.when(size > 0, plan["certain"] + more.cast("long")).otherwise(F.lit(0).cast("long"))


def mixed(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it; columns stay as they are."""
    size, again, chosen, times = fresh(docs, "_size", "_number", "_plan", "_times")
    sized = numbered(docs.withColumn(size, word_count(col(text))), doc_id, source, size, again)
    narrow = [col(c).alias(n) for c, n in ((doc_id, "doc_id"), (source, "source"), (size, "size"), (again, "again"))]
    sources = plan(sized.select(*narrow), mix)
    lookup = sources.select(F.col("source").alias(source), F.col("plan").alias(chosen))
    taken = attach(sized, lookup, source, chosen).withColumn(times, copies(col(doc_id), col(size), col(chosen), mix, col(again)))
    return taken.withColumn(times, F.explode(F.array_repeat(F.lit(1), col(times).cast("int")))).select(*map(col, docs.columns))


def _sql(mix: Mix) -> str:
    """The same by window functions; every fill is one more pair of common tables."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mix.weights))
    weight = f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mix.weights)} {cases} END"
    m = mix.max_repeats
    parts = [f"""
WITH counted AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY size) - 1 AS again FROM counted),
sized AS MATERIALIZED (
    SELECT doc_id, source, size,
        (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/{mix.seed}' || CASE WHEN again > 0 THEN '/' || again ELSE '' END), 1, 12) AS BIGINT)
            + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
    FROM numbered),
weighed AS (SELECT source, sum(size)::BIGINT AS source_size, {weight} AS weight FROM sized GROUP BY source),
tried AS (
    SELECT *, ((SELECT sum(source_size) FROM weighed)::DOUBLE - ({m} * coalesce(sum(source_size) OVER (
            ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
        / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS x
    FROM weighed),
shared AS (SELECT arg_min(x, source_size::DOUBLE / weight) AS share FROM tried WHERE x * weight <= {m} * source_size),
planned AS (
    SELECT source, source_size, least(({m} * source_size)::DOUBLE, coalesce(share * weight, ({m} * source_size)::DOUBLE)) AS target
    FROM tried, shared),
expecting AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS expected FROM planned),
placed0 AS MATERIALIZED (
    SELECT s.*, source_size, target, floor(expected) AS certain, false AS taken, target - floor(expected) * source_size AS due,
        CASE WHEN expected > floor(expected) THEN
            ((u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))))
            / (1 + ((u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))))) END AS place
    FROM sized s JOIN expecting e ON s.source IS NOT DISTINCT FROM e.source)"""]
    for k in range(mix.fills + 1):
        parts.append(f"""
summed{k} AS (
    SELECT *, NOT taken AND place IS NOT NULL AND size > 0 AND size <= due AS candidate,
        sum(CASE WHEN NOT taken AND place IS NOT NULL AND size > 0 AND size <= due THEN size ELSE 0 END)
            OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM placed{k}),
placed{k + 1} AS MATERIALIZED (
    SELECT * EXCLUDE (candidate, running) REPLACE (taken OR (candidate AND running <= due) AS taken,
        due - coalesce(max(CASE WHEN candidate AND running <= due THEN running END) OVER (PARTITION BY source), 0) AS due) FROM summed{k})""")
    end = mix.fills + 1
    parts.append(f"""
gaps AS (
    SELECT *, NOT taken AND place IS NOT NULL AND size > 0 AND size < 2 * due AS candidate FROM placed{end}),
ended AS (
    SELECT * REPLACE (taken OR (candidate AND rank() OVER (
        PARTITION BY source, candidate ORDER BY abs(size - due), place, size) = 1) AS taken) FROM gaps)""")
    return ",".join(parts) + f"""
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (certain + CASE WHEN taken THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM ended"""


SQL = _sql(Mix())


@query("op5_mixing", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix()
    sized = materialize(
        table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-documents"
    )
    sized = numbered(sized, "doc_id", "source", "size", "again")
    chosen = attach(sized, plan(sized, mix), "source", "plan")
    return chosen.select(
        "doc_id", "size", "plan.source_size", "plan.target",
        (F.col("size") * copies(F.col("doc_id"), F.col("size"), F.col("plan"), mix, F.col("again"))).alias("taken"),
    )
