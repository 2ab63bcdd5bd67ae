"""Quality rules: documents fail by themselves or with their host.

Every document is measured once; failures are counted per host, the rate of a
host is shrunk towards the rate of all hosts by an empirical beta prior (method
of moments), and the verdict on the host is joined back to its documents.  A
host with few documents is therefore judged by the prior, not by chance.

Null and empty texts have no words and fail.  Null hosts form one host of their
own.  Repeated rows are judged, and counted, one by one.  An empty table gives
an empty result.  Other columns pass through, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens.llm.common import attach, col, fresh, materialize, query, small_batches, table

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """``repeat_window`` must be a power of two."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    max_host_rate: float = 0.5


def repeated_positions(ids: np.ndarray, window: int) -> int:
    """Positions inside windows that occur at least twice in ``ids``.

    Windows are named by doubling: two names of half the length make one, so
    equal names mean equal windows.
    """
    length = 1
    while length < window:
        if len(ids) <= length:
            return 0
        pairs = ids[:-length].astype(np.int64) * (int(ids.max()) + 1) + ids[length:]
        names, ids = np.unique(pairs, return_inverse=True)
        if len(names) == len(pairs):
            return 0
        length *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(ids) + window, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        0 if len(code) == len(words) else repeated_positions(ids, window),
    )


def measured(docs: DataFrame, text: str = "text", out: str = "counts", rules: Rules = Rules()) -> DataFrame:
    """``docs`` and a struct of the five counts."""
    small_batches(docs)

    @F.pandas_udf(COUNTS)
    def counts(texts: pd.Series) -> pd.DataFrame:
        rows = [measure(t, rules.repeat_window) for t in texts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")], dtype="int64")

    return docs.withColumn(out, counts(col(text)))


def fails(counts: Column, rules: Rules = Rules()) -> Column:
    return (counts["n_words"] < rules.min_words) | (
        100 * counts["n_repeat_words"] > rules.max_repeat_percent * counts["n_words"]
    )


def host_rates(failures: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, failures, rate): the mean of the beta posterior per host.

    With m the rate over all rows and s2 the variance of host rates, weighted
    by rows, sampling alone explains m(1-m) hosts/rows of s2; the rest is the
    variance of the prior, whose strength is m(1-m)/rest - 1, kept within
    [1, 1e6].  Only these moments, one row, come to the driver.
    """
    hosts = materialize(
        failures.groupBy(col(host).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(col(failed).cast("long")).alias("failures")),
        "host-failures",
    )
    k, n, f, f2 = hosts.agg(
        F.count("*"), F.sum("n"), F.sum("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("n"))
    ).first()
    a = b = 0.5
    if n:
        m = f / n
        spread = m * (1 - m)
        between = f2 / n - m * m - spread * k / n
        strength = min(1e6, max(1.0, spread / between - 1)) if between > 0 else 1e6
        a, b = m * strength, (1 - m) * strength
    return hosts.withColumn("rate", (F.col("failures") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def verdicts(
    docs: DataFrame, host: str = "source", counts: str = "counts", out: str = "verdict", rules: Rules = Rules()
) -> DataFrame:
    """``docs`` (with measured counts) and a struct (base_failed, host_rate, kept)."""
    failed, rate = fresh(docs, "_failed", "_rate")
    judged = docs.withColumn(failed, fails(col(counts), rules))
    rates = host_rates(judged.select(col(host), col(failed)), host, failed)
    lookup = rates.select(F.col("host").alias(host), F.col("rate").alias(rate))
    return (
        attach(judged, lookup, host, rate)
        .withColumn(out, F.struct(
            col(failed).alias("base_failed"),
            col(rate).alias("host_rate"),
            (~col(failed) & (col(rate) <= rules.max_host_rate)).alias("kept"),
        ))
        .drop(failed, rate)
    )


def accepted(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows that neither fail by themselves nor belong to a rejected host."""
    counts, verdict = fresh(docs, "counts", "verdict")
    judged = verdicts(measured(docs, text, counts, rules), host, counts, verdict, rules)
    return judged.where(col(verdict)["kept"]).select(*map(col, docs.columns))


KEPT_SQL = r"""
doc_words AS MATERIALIZED (
    SELECT row, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, t
    FROM (SELECT row_number() OVER () AS row, coalesce(text, '') AS t FROM {docs})
),
grams AS MATERIALIZED (
    SELECT row, i, list_slice(words, i, i + 7) AS gram
    FROM (SELECT row, words, unnest(generate_series(1, len(words) - 7)) AS i FROM doc_words WHERE len(words) >= 8)
),
repeated AS (
    SELECT row, count(*) AS n_repeat_words FROM (
        SELECT DISTINCT row, i + unnest(generate_series(0, 7)) AS position FROM (
            SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS times FROM grams) WHERE times > 1)
    GROUP BY row
),
counted AS MATERIALIZED (
    SELECT d.*, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM (SELECT row_number() OVER () AS row, * FROM {docs}) d JOIN (
        SELECT w.row, CAST(len(words) AS BIGINT) AS n_words,
            CAST(list_sum(list_transform(words, lambda w: length(w))) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM (SELECT row, t, words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
              FROM doc_words) w LEFT JOIN repeated USING (row)) USING (row)
),
hosts AS (
    SELECT source AS host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM counted GROUP BY source
),
moments AS (
    SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS f2 FROM hosts
),
prior AS (
    SELECT m, CASE WHEN f2 - m * m - m * (1 - m) * k / n > 0
        THEN least(1e6, greatest(1.0, m * (1 - m) / (f2 - m * m - m * (1 - m) * k / n) - 1)) ELSE 1e6 END AS strength FROM moments
),
judged AS (
    SELECT c.*, NOT base_failed AND (h.f + m * strength) / (h.n + strength) <= 0.5 AS kept
    FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.host, prior
)
"""

SQL = "WITH " + KEPT_SQL.format(docs="documents") + """
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""


@query("op6_quality_rules", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = materialize(measured(docs).select("doc_id", "source", "counts"), "quality-counts")
    return verdicts(counted).select("doc_id", "counts.*", "verdict.base_failed", "verdict.kept")
