"""Verdicts: calibrated detector scores, fusion, severity and explanation.

Ranking the contributions of a verdict is done inside its row with array
functions, so explaining costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens import constants as C
from hostlens.config import Settings
from hostlens.functions import scalars as X
from hostlens.functions.dims import feature_index, feature_names, names_for, phrase, salience
from hostlens.operators import baseline as B


# --- fusion ----------------------------------------------------------------------

def weights(has_sequence: Column, has_window: Column, settings: Settings) -> tuple[Column, Column]:
    """Normalised (sequence, window) weights; a missing detector leaves all
    weight to the other, and weights without a sum are even."""
    total = settings.sequence_weight + settings.window_weight
    ws, ww = (
        (0.5, 0.5) if total <= 0
        else (settings.sequence_weight / total, settings.window_weight / total)
    )
    seq = F.when(~has_sequence, 0.0).when(~has_window, 1.0).otherwise(ws)
    win = F.when(~has_sequence, 1.0).when(~has_window, 0.0).otherwise(ww)
    return seq, win


def fuse(window_score: Column, sequence_score: Column, ws: Column, ww: Column) -> Column:
    """The window score alone until there is a sequence score."""
    return F.when(sequence_score.isNull(), window_score).otherwise(
        ws * sequence_score + ww * window_score
    )


def dominant(window_score: Column, sequence_score: Column, ws: Column, ww: Column) -> Column:
    return F.when(
        sequence_score.isNotNull() & (ws * sequence_score >= ww * window_score), "lstm"
    ).otherwise("vae")


def is_anomalous(score: Column, threshold: float = 70.0) -> Column:
    return score >= threshold


# --- explanation ------------------------------------------------------------------

def contributions(features: Column, base: Column) -> Column:
    """Salience-weighted distance of each feature from the baseline mean; a
    missing mean counts as 0."""
    weight = F.array(*[F.lit(salience(n)) for n in feature_names()])
    deviation = F.zip_with(features, base, lambda v, b: F.abs(v - F.coalesce(b, F.lit(0.0))))
    return F.zip_with(deviation, weight, lambda d, w: d * w)


def ranked_contributions(weighed: Column) -> Column:
    """Positive contributions, largest first, ties in vector order: array of
    (neg, idx), ``neg`` being the negated contribution.

    A contribution of zero can neither be explained nor listed.
    """
    rows = F.transform(weighed, lambda c, i: F.struct((-c).alias("neg"), i.alias("idx")))
    return F.sort_array(F.filter(rows, lambda r: r["neg"] < 0))


def top_ranked(weighed: Column, k: int) -> Column:
    return F.slice(ranked_contributions(weighed), 1, k)


def contribution_rows(vectors: DataFrame, keys: list[str], dim: DataFrame, least: float | None = None) -> DataFrame:
    """Every contribution of every vector as a row with its rank, for whoever
    wants to query them; verdicts use ``ranked_contributions``.

    With ``least`` those below it are left out before they are ranked, which leaves
    the ranks of the others as they are.  A row carries its own value only: the vector
    would be copied once per row.
    """
    weighed = contributions(F.col("features"), F.col("norm_mean"))
    rows = F.transform(weighed, lambda c, i: F.struct((-c).alias("neg"), i.alias("idx"), F.get("features", i).alias("value")))
    wanted = F.filter(rows, lambda r: r["neg"] < 0 if least is None else (r["neg"] < 0) & (r["neg"] <= -least))
    return (
        vectors.select(*keys, F.posexplode(F.sort_array(wanted)).alias("_at", "_c"))
        .select(
            *keys,
            (F.col("_at") + 1).alias("rank"),
            F.col("_c.idx").alias("idx"),
            F.col("_c.value").alias("value"),
            (-F.col("_c.neg")).alias("contribution"),
        )
        .join(F.broadcast(dim.select("idx", "name", "phrase")), "idx")
    )


def top_features(features: Column, ranked: Column, k: int = C.TOP_FEATURES) -> Column:
    names = F.array(*[F.lit(n) for n in feature_names()])
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(
            F.get(names, r["idx"]).alias("name"),
            X.round_half_even(F.get(features, r["idx"]), 4).alias("value"),
            X.round_half_even(-r["neg"], 4).alias("contribution"),
        ),
    )


def clauses(spark: SparkSession, features: Column, ranked: Column, k: int = C.TOP_PHRASES) -> Column:
    """``phrase (name=0.00)`` for each notable contribution, at most k."""
    syscalls = names_for(spark)
    names = F.array(*[F.lit(n) for n in feature_names()])
    phrases = F.array(*[F.lit(phrase(n, syscalls)) for n in feature_names()])
    notable = F.slice(F.filter(ranked, lambda r: -r["neg"] >= C.MIN_CONTRIBUTION), 1, k)
    return F.transform(
        notable,
        lambda r: F.concat(
            F.get(phrases, r["idx"]), F.lit(" ("), F.get(names, r["idx"]), F.lit("="),
            X.fixed_text(F.get(features, r["idx"]), 2), F.lit(")"),
        ),
    )


def sentence(process: Column, parts: Column) -> Column:
    """One sentence out of the clauses."""
    size = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(size - 1, F.lit(0))), ", ")
    last = F.try_element_at(parts, F.lit(-1))
    body = (
        F.when(size == 1, last)
        .when(size == 2, F.concat(head, F.lit(" and "), last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )
    return F.when(
        size == 0,
        F.concat(F.lit("Process "), process, F.lit(" shows only mild deviations from its baseline.")),
    ).otherwise(F.concat(F.lit("Process "), process, F.lit(" "), body, F.lit(".")))


def flag_safe(rows: DataFrame, safe_pids: DataFrame | None) -> DataFrame:
    """Adds ``is_safe``; a small list of pids is broadcast by its measured size."""
    if safe_pids is None:
        return rows.withColumn("is_safe", F.lit(False))
    flagged = safe_pids.select("host_id", "pid").distinct().withColumn("_safe", F.lit(True))
    return rows.join(flagged, ["host_id", "pid"], "left").withColumn(
        "is_safe", F.coalesce("_safe", F.lit(False))
    ).drop("_safe")


# --- verdicts -----------------------------------------------------------------------

def score_windows(
    windows: DataFrame,
    baselines: DataFrame,
    settings: Settings,
    entity: list[str],
    order: str,
    safe_pids: DataFrame | None = None,
) -> DataFrame:
    """One verdict per window.

    ``windows`` has ``entity``, ``order``, ``last_ns``, ``last_comm`` and
    ``features``; ``baselines`` is the table made by ``plans.training.fit``.
    A window without a baseline gets the "no baseline" verdict.  Baselines with
    ``directions`` or ``slopes`` are scored by them.
    """
    spark = windows.sparkSession
    key = ["host_id", "comm"]
    named = windows.withColumn("comm", F.col("last_comm"))
    fitted = baselines.drop("window_seconds", "sequence_length")
    based = B.attach_stats(named, fitted, key, [*entity, order], settings)
    available = F.col("norm_min").isNotNull()
    x = based.withColumn("x", F.when(available, B.normalized()).otherwise(F.col("features")))

    # the context of a process only holds windows that had a baseline
    line = [*entity, "_available"]
    learned = lambda name: name if name in baselines.columns else None
    scored = B.sequence_errors(
        B.with_step_errors(x.withColumn("_available", available), line, order, slopes=learned("slopes")), line, order, settings
    )

    scored = flag_safe(scored, safe_pids)

    window_score = 100.0 * B.calibrated("window_error", "window_error_mean", "window_error_std")
    sequence_score = 100.0 * B.calibrated("sequence_error", "sequence_error_mean", "sequence_error_std")
    ws, ww = weights(F.lit(True), F.lit(True), settings)
    safe = available & F.col("is_safe")
    return (
        scored.withColumn("window_error", F.when(available, B.window_error(directions=learned("directions"))))
        .withColumn("vae_score", F.when(available, window_score).otherwise(0.0))
        .withColumn("lstm_score", F.when(available, sequence_score))
        .withColumn("fused_score", fuse(F.col("vae_score"), F.col("lstm_score"), ws, ww))
        .withColumn("final_score", F.when(safe | ~available, 0.0).otherwise(F.col("fused_score")))
        # each of these is used more than once by the next one
        .withColumn("weighed", F.when(available, contributions(F.col("features"), F.col("norm_mean"))))
        .withColumn("ranked", top_ranked(F.col("weighed"), max(C.TOP_FEATURES, C.TOP_PHRASES)))
        .withColumn("clauses", clauses(spark, F.col("features"), F.col("ranked")))
        .select(
            *entity,
            order,
            F.col("last_comm").alias("process_name"),
            F.coalesce("last_ns", F.lit(0)).alias("timestamp_ns"),
            "final_score",
            "vae_score",
            "lstm_score",
            F.when(available, dominant(F.col("vae_score"), F.col("lstm_score"), ws, ww)).alias("dominant"),
            X.severity(F.col("final_score"), settings).alias("severity"),
            available.alias("model_available"),
            safe.alias("suppressed"),
            (F.col("window_error") >= F.col("threshold")).alias("over_threshold"),
            F.when(
                ~available,
                F.concat(F.lit("No trained baseline for '"), F.col("last_comm"), F.lit("'; cannot score yet.")),
            )
            .when(
                safe,
                F.concat(F.lit("PID "), F.col("pid").cast("string"), F.lit(" is on the known-safe list; alert suppressed.")),
            )
            .otherwise(sentence(F.col("last_comm"), F.col("clauses")))
            .alias("explanation"),
            F.coalesce(top_features(F.col("features"), F.col("ranked")), F.array().cast("array<struct<name:string,value:double,contribution:double>>")).alias("top_features"),
        )
    )


def detections(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Threats whose whole signature fires in a window.

    The signature table is fixed and tiny; each of its features is looked up in
    the vector of the window, so there is no exploded vector and no shuffle.
    """
    rules: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for threat, name, test, ids in C.SIGNATURES:
        rules.setdefault((threat, ids), []).append((feature_index()[name], test))
    fires = lambda idx, test: (
        F.element_at("features", idx + 1) > 0 if test == "gt0" else F.element_at("features", idx + 1) == 1
    )
    hits = []
    for (threat, ids), tests in rules.items():
        cond = fires(*tests[0])
        for t in tests[1:]:
            cond = cond & fires(*t)
        hits.append(F.when(cond, F.struct(F.lit(threat).alias("threat"), F.lit(ids).alias("techniques"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return windows.select(*keys, F.inline(found))
