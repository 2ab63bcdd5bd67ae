"""Normalisers, detectors, thresholds and evaluation, for all processes at once.

``key`` is the list of columns naming a baseline, usually host and process
name.  A *vector table* has ``key``, an order column and ``features``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hostlens.config import Settings
from hostlens.functions import scalars as X
from hostlens.operators.ordered import cumulative_counts, quantile
from hostlens.operators.skew import attach_per_key

MIN_ERROR_STD = 1e-6


# --- normaliser -----------------------------------------------------------------

def fit_normalizer(vectors: DataFrame, key: list[str], value: str = "features") -> DataFrame:
    """Per key and vector position: min, max, mean and population deviation
    (0 counts as 1).  When the rows carry ``part``, also the mean of the
    training part."""
    std = F.stddev_pop("v")
    parts = ["part"] if "part" in vectors.columns else []
    train = [F.avg(F.when(F.col("part") == "train", F.col("v"))).alias("train_mean")] if parts else []
    return (
        vectors.select(*key, *parts, F.posexplode(value).alias("idx", "v"))
        .groupBy(*key, "idx")
        .agg(
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.avg("v").alias("mean"),
            F.when(std == 0, 1.0).otherwise(std).alias("std"),
            F.count("*").alias("n"),
            *train,
        )
    )


def pack_normalizer(stats: DataFrame, key: list[str]) -> DataFrame:
    """The statistics of a key as arrays in vector order, one row per key.

    With ``train_mean`` the row also has ``center``, the normalised mean of the
    training part, which is what the window detector reconstructs.
    """
    names = ["min", "max", "mean", "std"] + (["train_mean"] if "train_mean" in stats.columns else [])
    packed = F.sort_array(F.collect_list(F.struct("idx", *names)))
    wide = stats.groupBy(*key).agg(F.max("n").alias("n_windows"), packed.alias("_s")).select(
        *key, "n_windows", *[F.col(f"_s.{n}").alias(f"norm_{n}") for n in names]
    )
    if "train_mean" not in names:
        return wide
    center = minmax(F.col("norm_train_mean"), F.col("norm_min"), F.col("norm_max"))
    return wide.withColumn("center", center).drop("norm_train_mean")


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo) into [0, 1]; a span of 0 counts as 1."""
    span = F.zip_with(hi, lo, lambda h, l: F.when(h == l, F.lit(1.0)).otherwise(h - l))
    above = F.zip_with(x, lo, lambda v, l: v - l)
    return F.zip_with(
        above, span, lambda d, s: F.least(F.greatest(d / s, F.lit(0.0)), F.lit(1.0))
    )


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """Standard score cut at three deviations, moved into [0, 1]."""
    off = F.zip_with(x, mean, lambda v, m: v - m)
    cut = lambda z: F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0))
    return F.zip_with(off, std, lambda d, s: (cut(d / s) + 3.0) / 6.0)


def normalized(method: str = "minmax", value: str = "features") -> Column:
    """Normalised vector of a row that carries the packed statistics."""
    x = F.col(value)
    if method == "minmax":
        return minmax(x, F.col("norm_min"), F.col("norm_max"))
    if method == "zscore":
        return zscore(x, F.col("norm_mean"), F.col("norm_std"))
    raise ValueError(f"unknown normalization method: {method!r}")


def attach_stats(vectors: DataFrame, packed: DataFrame, key: list[str], order: list[str], settings: Settings) -> DataFrame:
    """Vectors with the packed statistics of their key; null without any."""
    return attach_per_key(vectors, packed, key, "n_windows", order, settings)


# --- ordered split --------------------------------------------------------------

def train_size(n: Column, share: float) -> Column:
    """Rows kept for training: the tail of round-half-even(n*share) rows, at
    least one and at most n-1, is held out; a single row is kept."""
    held = F.bround(n * F.lit(float(share)), 0).cast("bigint")
    held = F.when(n > 1, F.least(F.greatest(held, F.lit(1)), n - 1)).otherwise(F.lit(0))
    return n - held


def split_ranks(rows: DataFrame, key: list[str], order: list[str], share: float) -> DataFrame:
    """Adds ``part`` (train or validation) to rows put in order per key.

    Rows are windows, so a key has at most span / stride of them.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    total = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumn("_rank", rank).withColumn(
        "part",
        F.when(F.col("_rank") <= train_size(total, share), "train").otherwise("validation"),
    ).drop("_rank")


# --- detectors -------------------------------------------------------------------
# Both stand in for the neural detectors of the original model family: they keep
# the contract (reconstruct, squared error, calibrate, sigmoid) but are linear.

def mean_squared(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(sq, F.lit(0.0), lambda acc, e: acc + e) / F.size(a)


def window_error(value: str = "x", center: str = "center", directions: str | None = None) -> Column:
    """Mean squared distance from the centre or, with ``directions``, from the plane
    through the centre that they span."""
    if directions is None:
        return mean_squared(F.col(value), F.col(center))
    add = lambda a, e: a + e
    off = F.zip_with(value, center, lambda x, c: x - c)
    # each is used more than once: named by a transform over a single element
    left = F.transform(
        F.array(off),
        lambda y: F.aggregate(F.transform(y, lambda v: v * v), F.lit(0.0), add)
        - F.aggregate(
            F.transform(F.col(directions), lambda d: F.pow(F.aggregate(F.zip_with(d, y, lambda a, b: a * b), F.lit(0.0), add), 2)),
            F.lit(0.0), add,
        ),
    )[0]
    return F.greatest(left, F.lit(0.0)) / F.size(value)


def comoments(windows: DataFrame, key: list[str], value: str = "x") -> DataFrame:
    """(key, i, j, s), i <= j: sums of products of the non-zero values at two positions.

    Position ``size`` stands for the constant 1, so the table holds the sums and the
    number of windows as well.  Tables of different windows are merged by adding up.
    """
    one = F.struct(F.size(value).alias("i"), F.lit(1.0).alias("v"))
    entries = F.concat(
        F.filter(F.transform(value, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0), F.array(one)
    )
    return (
        windows.select(*key, entries.alias("_e")).select(*key, "_e", F.inline("_e"))
        .select(*key, "i", "v", F.explode("_e").alias("_o")).where(F.col("_o.i") >= F.col("i"))
        .groupBy(*key, "i", F.col("_o.i").alias("j")).agg(F.sum(F.col("v") * F.col("_o.v")).alias("s"))
    )


def leading_directions(covariance: np.ndarray, dims: int, steps: int) -> list[np.ndarray]:
    """Orthonormal vectors of the largest variance, by power steps from an even start; what
    a direction explains is taken out before the next one is sought."""
    left, found = covariance.copy(), []
    for _ in range(min(dims, len(left))):
        v = np.full(len(left), 1 / np.sqrt(len(left)))
        for _ in range(steps):
            w = left @ v
            for u in found:
                w = w - (w @ u) * u
            length = np.linalg.norm(w)
            if length <= 1e-12:
                return found
            v = w / length
        found.append(v)
        left -= (v @ left @ v) * np.outer(v, v)
    return found


def fit_subspace(moments: DataFrame, key: list[str], size: int, dims: int, steps: int) -> DataFrame:
    """(key, directions, explained): leading directions of each key, and the share of
    the variance that they hold.  A key has at most size^2 / 2 moments."""
    kind = StructType([
        *[moments.schema[k] for k in key], StructField("directions", ArrayType(ArrayType(DoubleType()))), StructField("explained", DoubleType()),
    ])

    def fit(own: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        last = rows["j"] == size
        n = rows.loc[last & (rows["i"] == size), "s"].iloc[0]
        sums = rows[last & (rows["i"] < size)]
        used = np.sort(sums["i"].to_numpy())
        at = np.full(size, -1)
        at[used] = np.arange(len(used))
        mean = np.zeros(len(used))
        mean[at[sums["i"]]] = sums["s"] / n
        pairs = rows[~last]
        matrix = np.zeros((len(used), len(used)))
        matrix[at[pairs["i"]], at[pairs["j"]]] = matrix[at[pairs["j"]], at[pairs["i"]]] = pairs["s"] / n
        matrix -= np.outer(mean, mean)
        found, whole = leading_directions(matrix, dims, steps), np.trace(matrix)
        wide = np.zeros((len(found), size))
        wide[:, used] = found if found else np.zeros((0, len(used)))
        share = sum(v @ matrix @ v for v in found) / whole if whole > 1e-12 else 0.0
        return pd.DataFrame([(*own, wide.tolist(), float(share))], columns=kind.names)

    return moments.groupBy(*key).applyInPandas(fit, kind)


def with_step_errors(
    windows: DataFrame, key: list[str], order: str, value: str = "x", slopes: str | None = None
) -> DataFrame:
    """Sequence detector, one step: each window is predicted from the window
    before it; adds the mean squared error of that prediction.

    Without ``slopes`` the prediction is the previous window itself, with them
    (see ``fit_ar1``) each position moves towards its centre.
    """
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    guess = F.col("_before")
    if slopes is not None:
        c, a = F.col("center"), F.col(slopes)
        guess = F.transform(guess, lambda v, i: c[i] + a[i] * (v - c[i]))
    return (
        windows.withColumn("_before", before)
        .withColumn("step_error", mean_squared(F.col(value), guess))
        .drop("_before")
    )


def fit_ar1(windows: DataFrame, key: list[str], order: str, value: str = "x") -> DataFrame:
    """Slope of each vector position on its own previous value, packed per key;
    a position without variation keeps the slope 1 (persistence)."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    both = F.arrays_zip(F.col("_before").alias("a"), F.col(value).alias("b"))
    slopes = (
        windows.withColumn("_before", before)
        .where(F.col("_before").isNotNull())
        .select(*key, F.posexplode(both).alias("idx", "p"))
        .groupBy(*key, "idx")
        .agg(F.coalesce(F.regr_slope("p.b", "p.a"), F.lit(1.0)).alias("slope"))
    )
    packed = F.sort_array(F.collect_list(F.struct("idx", "slope")))
    return slopes.groupBy(*key).agg(packed.alias("_s")).select(*key, F.col("_s.slope").alias("slopes"))


def sequence_errors(windows: DataFrame, key: list[str], order: str, settings: Settings) -> DataFrame:
    """Rolls step errors into the error of the run of L windows that ends at
    each window; null until there are L windows.

    Never builds the L x 427 run: the error of a run is the mean of its L-1
    steps.
    """
    size = settings.sequence_length
    line = Window.partitionBy(*key).orderBy(order)
    steps = line.rowsBetween(-(size - 2), 0) if size > 1 else line.rowsBetween(0, 0)
    mean = F.avg("step_error").over(steps) if size > 1 else F.lit(0.0)
    return windows.withColumn(
        "sequence_error", F.when(F.row_number().over(line) >= size, mean)
    )


def padded_sequence_errors(windows: DataFrame, key: list[str], order: str, settings: Settings) -> DataFrame:
    """One row per training sequence.  A session shorter than L gives a single
    sequence whose padding repeats the first window, which adds steps of 0."""
    size = settings.sequence_length
    total = F.count("*").over(Window.partitionBy(*key))
    whole = F.sum("step_error").over(Window.partitionBy(*key))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order))) == 1
    short = F.coalesce(F.col("_whole"), F.lit(0.0)) / F.lit(float(max(size - 1, 1)))
    return (
        sequence_errors(windows, key, order, settings)
        .withColumn("_n", total)
        .withColumn("_whole", whole)
        .withColumn("_last", last)
        .withColumn(
            "sequence_error",
            F.when((F.col("_n") < size) & F.col("_last"), short).otherwise(F.col("sequence_error")),
        )
        .where(F.col("sequence_error").isNotNull())
        .drop("_n", "_whole", "_last")
    )


def calibration(errors: DataFrame, key: list[str], error: str, prefix: str) -> DataFrame:
    """Mean and population deviation of held-out errors; the deviation is
    floored, and without any error the standard normal is assumed."""
    std = F.stddev_pop(error)
    return errors.groupBy(*key).agg(
        F.coalesce(F.avg(error), F.lit(0.0)).alias(f"{prefix}_mean"),
        F.when(std.isNull(), 1.0).when(std <= 0, MIN_ERROR_STD).otherwise(std).alias(f"{prefix}_std"),
    )


def calibrated(error: str, mean: str, std: str) -> Column:
    return X.sigmoid((F.col(error) - F.col(mean)) / F.col(std))


# --- thresholds -------------------------------------------------------------------

def tune_threshold(errors: DataFrame, key: list[str], error: str, settings: Settings) -> DataFrame:
    """max(mean + n_std * deviation, the 1 - fpr quantile); a single error is
    its own threshold."""
    q = quantile(errors, key, error, 1.0 - settings.target_fpr, "_q")
    std = F.coalesce(F.stddev_pop(error), F.lit(0.0))
    moments = errors.groupBy(*key).agg(
        F.count(error).alias("n_errors"), F.avg(error).alias("_mean"), std.alias("_std")
    )
    joined = moments.join(q, key, "left") if key else moments.withColumn("_q", q.scalar())
    return joined.select(
        *key,
        "n_errors",
        F.when(F.col("n_errors") == 1, F.col("_mean"))
        .otherwise(F.greatest(F.col("_mean") + F.col("_std") * settings.n_std, F.col("_q")))
        .alias("threshold"),
    )


def error_statistics(errors: DataFrame, key: list[str], error: str, q: float) -> DataFrame:
    """Mean, population deviation and exact quantile."""
    quant = quantile(errors, key, error, q, "quantile")
    moments = errors.groupBy(*key).agg(
        F.avg(error).alias("mean"), F.coalesce(F.stddev_pop(error), F.lit(0.0)).alias("std")
    )
    return moments.join(quant, key) if key else moments.withColumn("quantile", quant.scalar())


# --- evaluation --------------------------------------------------------------------

def rates(labelled: DataFrame, key: list[str], error: str, label: str, threshold: Column) -> DataFrame:
    """True and false positive rate and F1 at an inclusive threshold."""
    attack, hit = F.col(label) == 1, F.col(error) >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    counted = labelled.groupBy(*key).agg(
        n(attack).alias("n_pos"),
        n(~attack).alias("n_neg"),
        n(attack & hit).alias("tp"),
        n(~attack & hit).alias("fp"),
    )
    tpr, fpr = ratio(F.col("tp"), F.col("n_pos")), ratio(F.col("fp"), F.col("n_neg"))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return counted.select(
        *key,
        "n_pos",
        "n_neg",
        tpr.alias("true_positive_rate"),
        fpr.alias("false_positive_rate"),
        ratio(2.0 * precision * tpr, precision + tpr).alias("f1_score"),
    )


def roc_auc(labelled: DataFrame, key: list[str], error: str, label: str) -> DataFrame:
    """Area under the ROC curve: per distinct attack value, the normals below
    it plus half of the normals equal to it."""
    hist = cumulative_counts(
        labelled, key, error, {"pos": F.col(label) == 1, "neg": F.col(label) != 1}
    )
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return hist.groupBy(*key).agg(F.coalesce(F.try_divide(wins, pairs), F.lit(0.0)).alias("roc_auc"))


def label_union(normal: DataFrame, attack: DataFrame) -> DataFrame:
    return normal.withColumn("label", F.lit(0)).unionByName(attack.withColumn("label", F.lit(1)))


