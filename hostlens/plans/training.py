"""Fitting baselines for every process seen in a period, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostlens.config import Settings
from hostlens.operators import baseline as B
from hostlens.operators import features as FE
from hostlens.operators.windows import hopping
from hostlens.sources.store import materialize

ENTITY = ["host_id", "comm"]


def observed_events(telemetry: DataFrame, process: str | None = None, from_ns: int | None = None,
                    to_ns: int | None = None) -> DataFrame:
    """Events of the observation period, of one process or of all."""
    rows = telemetry
    if process is not None:
        rows = rows.where(F.col("comm") == process)
    if from_ns is not None:
        rows = rows.where(F.col("ts_ns") >= from_ns)
    if to_ns is not None:
        rows = rows.where(F.col("ts_ns") < to_ns)
    return rows


def training_vectors(telemetry: DataFrame, settings: Settings, entity: list[str] = ENTITY, **observed) -> DataFrame:
    """Hopping-window vectors of the observation period, one session per key.

    Events without a program name belong to the program '', as in scoring.
    """
    rows = observed_events(telemetry, **observed).withColumn("comm", F.coalesce("comm", F.lit("")))
    return FE.vectors(rows, hopping(rows, entity, settings), entity, settings).select(
        *entity, "k", "features"
    )


def detectors(windows: DataFrame, settings: Settings, entity: list[str], order: str, size: int) -> DataFrame | None:
    """What the detectors learn beyond the centre, from the training part of normalised
    windows: ``directions`` and ``explained``, ``slopes``; None if neither is asked for."""
    train, learned = windows.where(F.col("part") == "train"), None
    if settings.latent_dims > 0:
        learned = B.fit_subspace(B.comoments(train, entity), entity, size, settings.latent_dims, settings.power_steps)
    if settings.predict_steps:
        slopes = B.fit_ar1(train.select(*entity, order, "x"), entity, order)
        # a key with a single window has no step to learn from
        every = train.select(*entity).distinct().join(slopes, entity, "left").withColumn(
            "slopes", F.coalesce("slopes", F.array_repeat(F.lit(1.0), size))
        )
        learned = every if learned is None else learned.join(every, entity)
    return learned


def window_errors(vectors: DataFrame, settings: Settings, entity: list[str] = ENTITY, order: str = "k") -> tuple[DataFrame, DataFrame]:
    """The packed normaliser of each process with what its detectors learned, and per
    window its part of the split and the errors of both detectors."""
    parted = B.split_ranks(vectors, entity, [order], settings.validation_split)
    packed = B.pack_normalizer(B.fit_normalizer(parted, entity), entity)
    x = B.attach_stats(parted, packed, entity, [order], settings).withColumn("x", B.normalized())
    if settings.latent_dims > 0 or settings.predict_steps:
        first = vectors.select(F.size("features").alias("n")).first()
        size = first.n if first else 0
        packed = materialize(packed.join(detectors(x, settings, entity, order, size), entity), "detectors")
        x = B.attach_stats(parted, packed, entity, [order], settings).withColumn("x", B.normalized())
    learned = lambda name: name if name in packed.columns else None
    errors = B.with_step_errors(x, entity, order, slopes=learned("slopes")).select(
        *entity, order, "part", B.window_error(directions=learned("directions")).alias("error"), "step_error"
    )
    return packed, errors


def fit(vectors: DataFrame, settings: Settings, entity: list[str] = ENTITY, order: str = "k") -> DataFrame:
    """One row per process: normaliser, window centre, calibration of both
    detectors, threshold and counts.

    ``vectors`` is read twice; hand in a stored table when it is expensive to
    compute.  The errors, a few numbers per window, are stored in between.
    """
    packed, errors = window_errors(vectors, settings, entity, order)
    errors = materialize(errors, "window-errors")
    held = errors.where(F.col("part") == "validation")
    runs = B.padded_sequence_errors(errors.drop("part"), entity, order, settings)
    held_runs = B.split_ranks(runs, entity, [order], settings.validation_split).where(
        F.col("part") == "validation"
    )
    n_runs = runs.groupBy(*entity).agg(F.count("*").alias("n_sequences"))
    return (
        packed.join(n_runs, entity)
        .join(B.calibration(held, entity, "error", "window_error"), entity, "left")
        .join(B.calibration(held_runs, entity, "sequence_error", "sequence_error"), entity, "left")
        .join(B.tune_threshold(held, entity, "error", settings), entity, "left")
        .select(
            *entity,
            "n_windows",
            "n_sequences",
            F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
            F.coalesce("window_error_mean", F.lit(0.0)).alias("window_error_mean"),
            F.coalesce("window_error_std", F.lit(1.0)).alias("window_error_std"),
            F.coalesce("sequence_error_mean", F.lit(0.0)).alias("sequence_error_mean"),
            F.coalesce("sequence_error_std", F.lit(1.0)).alias("sequence_error_std"),
            "norm_min", "norm_max", "norm_mean", "norm_std", "center",
            *[c for c in ("directions", "explained", "slopes") if c in packed.columns],
        )
        .withColumn("window_seconds", F.lit(settings.window_seconds))
        .withColumn("sequence_length", F.lit(settings.sequence_length))
    )


def summary(baselines: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """Training result per process."""
    return baselines.select(
        *entity,
        "threshold",
        "n_windows",
        "n_sequences",
        F.col("window_error_mean").alias("val_loss"),
        F.lit(True).alias("window_detector"),
        (F.col("n_sequences") > 0).alias("sequence_detector"),
    )
