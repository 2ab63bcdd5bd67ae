"""Normalisers, detectors, calibration, thresholds, evaluation, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.catalog.common import COMM, ST, TRAIN_END, cte, query, sql, stored, table, tel
from hostlens.catalog import vector_sql  # noqa: F401
from hostlens.operators import baseline as B
from hostlens.operators import ordered as O
from hostlens.plans import training
from hostlens.sources import store as S

# --- vectors at scale: embeddings, with the label as process name ---------------

KEY, ORDER = ["label"], "vec_id"


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features")
    )


def _packed(v):
    return B.pack_normalizer(B.fit_normalizer(v, KEY), KEY)


cte("emb", "SELECT label, vec_id, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
cte("emb_stats", "SELECT label, idx, min(v) AS lo, max(v) AS hi, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS std, CAST(count(*) AS BIGINT) AS n FROM emb GROUP BY ALL", "emb")
cte("emb_x", "SELECT label, vec_id, idx, least(greatest((v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 0.0), 1.0) AS x, (least(greatest((v - mean) / std, -3.0), 3.0) + 3.0) / 6.0 AS z FROM emb JOIN emb_stats USING (label, idx)", "emb", "emb_stats")
HELD = "CASE WHEN n > 1 THEN least(greatest(CAST(round_even(n * 0.2, 0) AS BIGINT), 1), n - 1) ELSE 0 END"
cte("emb_part", f"SELECT label, vec_id, rn, CASE WHEN rn <= n - {HELD} THEN 'train' ELSE 'validation' END AS part FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
cte("emb_center", "SELECT label, idx, avg(x) AS c FROM emb_x JOIN emb_part USING (label, vec_id) WHERE part = 'train' GROUP BY ALL", "emb_x", "emb_part")
cte("emb_err", "SELECT label, vec_id, avg((x - c) * (x - c)) AS error FROM emb_x JOIN emb_center USING (label, idx) GROUP BY ALL", "emb_x", "emb_center")
cte("emb_step", "SELECT label, vec_id, avg((x - p) * (x - p)) AS step_error FROM (SELECT label, vec_id, x, lag(x) OVER (PARTITION BY label, idx ORDER BY vec_id) AS p FROM emb_x) GROUP BY ALL", "emb_x")
cte("emb_seq", "SELECT label, vec_id, CASE WHEN rn >= 5 THEN m END AS sequence_error FROM (SELECT label, vec_id, row_number() OVER w AS rn, avg(step_error) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM emb_step WINDOW w AS (PARTITION BY label ORDER BY vec_id))", "emb_step")
cte("emb_cal", "SELECT label, avg(error) AS error_mean, CASE WHEN stddev_pop(error) <= 0 THEN 1e-6 ELSE stddev_pop(error) END AS error_std FROM emb_err JOIN emb_part USING (label, vec_id) WHERE part = 'validation' GROUP BY 1", "emb_err", "emb_part")


@query("M01_fit_normalizer", sql("SELECT CAST(label AS BIGINT) AS label, CAST(idx AS INT) AS idx, round(lo, 8) AS min, round(hi, 8) AS max, round(mean, 8) AS mean, round(std, 8) AS std, n FROM emb_stats", "emb_stats"))
def m01(spark, sf_dir):
    s = B.fit_normalizer(vecs(spark, sf_dir), KEY)
    return s.select(F.col("label").cast("bigint"), "idx", *[F.round(c, 8).alias(c) for c in ("min", "max", "mean", "std")], "n")


def _normalized(spark, sf_dir, method):
    v = vecs(spark, sf_dir)
    x = B.attach_stats(v, _packed(v), KEY, [ORDER], ST).withColumn("x", B.normalized(method))
    return x.select("vec_id", F.posexplode("x").alias("idx", "x")).withColumn("x", F.round("x", 8))


@query("M02_minmax", sql("SELECT vec_id, CAST(idx AS INT) AS idx, round(x, 8) AS x FROM emb_x", "emb_x"))
def m02(spark, sf_dir):
    return _normalized(spark, sf_dir, "minmax")


@query("M03_zscore", sql("SELECT vec_id, CAST(idx AS INT) AS idx, round(z, 8) AS x FROM emb_x", "emb_x"))
def m03(spark, sf_dir):
    return _normalized(spark, sf_dir, "zscore")


@query("M04_normalize_by_method", sql("SELECT vec_id, 'minmax' AS method, round(sum(x), 6) AS total FROM emb_x GROUP BY 1 UNION ALL SELECT vec_id, 'zscore', round(sum(z), 6) FROM emb_x GROUP BY 1", "emb_x"))
def m04(spark, sf_dir):
    v = vecs(spark, sf_dir)
    x = B.attach_stats(v, _packed(v), KEY, [ORDER], ST)
    total = lambda m: F.round(F.aggregate(B.normalized(m), F.lit(0.0), lambda a, e: a + e), 6)
    both = F.array(*[F.struct(F.lit(m).alias("method"), total(m).alias("total")) for m in ("minmax", "zscore")])
    return x.select("vec_id", F.inline(both))


@query("M05_missing_statistics", sql("SELECT vec_id, CAST(label AS BIGINT) AS label, label % 3 <> 0 AS fitted FROM embeddings"))
def m05(spark, sf_dir):
    """Statistics are stored, loaded and missing for every third process."""
    v = vecs(spark, sf_dir)
    packed = S.materialize(_packed(v.where("label % 3 <> 0")), "normalizer")
    x = B.attach_stats(v, packed, KEY, [ORDER], ST)
    return x.select("vec_id", F.col("label").cast("bigint"), F.col("norm_min").isNotNull().alias("fitted"))


@query("M06_ordered_split", sql("SELECT vec_id, part FROM emb_part", "emb_part"))
def m06(spark, sf_dir):
    return B.split_ranks(vecs(spark, sf_dir).select("label", "vec_id"), KEY, [ORDER], ST.validation_split).select("vec_id", "part")


def errors(spark, sf_dir):
    return training.window_errors(vecs(spark, sf_dir), ST, KEY, ORDER)[1]


@query("M07_window_detector", sql("SELECT vec_id, round(error, 8) AS error FROM emb_err", "emb_err"))
def m07(spark, sf_dir):
    return errors(spark, sf_dir).select("vec_id", F.round("error", 8).alias("error"))


@query("M08_sequence_detector", sql("SELECT vec_id, round(sequence_error, 8) AS sequence_error FROM emb_seq", "emb_seq"))
def m08(spark, sf_dir):
    e = errors(spark, sf_dir).select("label", "vec_id", "step_error")
    return B.sequence_errors(e, KEY, ORDER, ST).select("vec_id", F.round("sequence_error", 8).alias("sequence_error"))


LEARNED = ST.with_(latent_dims=2, power_steps=25, predict_steps=True)
cte("emb_y", "SELECT label, vec_id, idx, x, x - c AS y, part FROM emb_x JOIN emb_center USING (label, idx) JOIN emb_part USING (label, vec_id)", "emb_x", "emb_center", "emb_part")
cte("emb_cov", "SELECT label, i, list(s ORDER BY j) AS r FROM (SELECT a.label, a.idx AS i, b.idx AS j, avg(a.y * b.y) AS s FROM emb_y a JOIN emb_y b USING (label, vec_id) WHERE a.part = 'train' GROUP BY ALL) GROUP BY ALL", "emb_y")
cte("emb_m1", "SELECT label, m, m AS whole, n, list_transform(range(n), lambda i: 0.0::DOUBLE) AS o FROM (SELECT label, list(r ORDER BY i) AS m, len(list(r)) AS n FROM emb_cov GROUP BY label)", "emb_cov")
_TIMES = "list_transform({m}, lambda r: list_dot_product(r, v))"
_CLEAR = "list_transform(w, lambda a, i: a - list_dot_product(w, o) * o[i])"
_UNIT = "list_transform(w, lambda a: a / sqrt(list_dot_product(w, w)))"
for _d in (1, 2):
    cte(
        f"emb_p{_d}",
        f"SELECT label, m, whole, o, 0 AS step, list_transform(range(n), lambda i: 1 / sqrt(n)) AS v FROM emb_m{_d} UNION ALL "
        f"SELECT label, m, whole, o, step + 1, {_UNIT} FROM (SELECT * EXCLUDE (w), {_CLEAR} AS w FROM "
        f"(SELECT label, m, whole, o, step, {_TIMES.format(m='m')} AS w FROM emb_p{_d} WHERE step < {LEARNED.power_steps}))",
        f"emb_m{_d}",
    )
    cte(
        f"emb_v{_d}",
        f"SELECT label, m, whole, v, list_dot_product(v, {_TIMES.format(m='whole')}) AS size, list_dot_product(v, {_TIMES.format(m='m')}) AS here "
        f"FROM emb_p{_d} WHERE step = {LEARNED.power_steps}", f"emb_p{_d}",
    )
    if _d == 1:
        cte(
            "emb_m2",
            "SELECT label, list_transform(m, lambda r, i: list_transform(r, lambda a, j: a - here * v[i] * v[j])) AS m, whole, len(v) AS n, v AS o FROM emb_v1", "emb_v1",
        )
cte(
    "emb_left",
    "SELECT e.label, e.vec_id, e.y2, list_dot_product(e.ys, a.v) AS s1, list_dot_product(e.ys, b.v) AS s2 FROM "
    "(SELECT label, vec_id, sum(y * y) / count(*) AS y2, list(y ORDER BY idx) AS ys FROM emb_y GROUP BY ALL) e JOIN emb_v1 a USING (label) JOIN emb_v2 b USING (label)",
    "emb_y", "emb_v1", "emb_v2",
)


def learned_errors(spark, sf_dir):
    return training.window_errors(vecs(spark, sf_dir), LEARNED, KEY, ORDER)


@query(
    "M07b_subspace_detector",
    sql("SELECT vec_id, round(y2 - (s1 * s1 + s2 * s2) / (SELECT max(n) FROM emb_m1), 6) AS error FROM emb_left", "emb_left", "emb_m1", recursive=True),
)
def m07b(spark, sf_dir):
    """Distance from the plane of the two leading directions, for windows in training or not."""
    return learned_errors(spark, sf_dir)[1].select("vec_id", F.round("error", 6).alias("error"))


@query(
    "M07c_explained_share",
    sql("SELECT CAST(a.label AS BIGINT) AS label, round((a.size + b.size) / t, 6) AS explained FROM emb_v1 a JOIN emb_v2 b USING (label) "
        "JOIN (SELECT label, sum(r[i + 1]) AS t FROM emb_cov GROUP BY 1) USING (label)", "emb_v1", "emb_v2", "emb_cov", recursive=True),
)
def m07c(spark, sf_dir):
    packed = learned_errors(spark, sf_dir)[0]
    return packed.select(F.col("label").cast("bigint"), F.round("explained", 6).alias("explained"))


_SLOPES = (
    "slopes AS (SELECT label, idx, coalesce(regr_slope(x, p), 1.0) AS slope FROM (SELECT label, idx, x, lag(x) OVER (PARTITION BY label, idx ORDER BY vec_id) AS p "
    "FROM emb_y WHERE part = 'train') WHERE p IS NOT NULL GROUP BY ALL), "
    "steps AS (SELECT label, vec_id, avg((x - c - slope * (p - c)) ** 2) AS step_error FROM (SELECT *, lag(x) OVER (PARTITION BY label, idx ORDER BY vec_id) AS p FROM emb_x) "
    "JOIN emb_center USING (label, idx) JOIN slopes USING (label, idx) GROUP BY ALL) "
)


@query(
    "M08c_predicted_sequence",
    sql("--MORE" + _SLOPES + "SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) >= 5 THEN round(avg(step_error) OVER (PARTITION BY label ORDER BY vec_id "
        "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) END AS sequence_error FROM steps", "emb_y", "emb_x", "emb_center"),
)
def m08c(spark, sf_dir):
    """Error of a run whose steps are predicted by the slope of each feature."""
    e = learned_errors(spark, sf_dir)[1].select("label", "vec_id", "step_error")
    return B.sequence_errors(e, KEY, ORDER, LEARNED).select("vec_id", F.round("sequence_error", 8).alias("sequence_error"))


@query("M08b_autoregression", sql("SELECT CAST(label AS BIGINT) AS label, CAST(idx AS INT) AS idx, round(coalesce(regr_slope(x, p), 1.0), 6) AS slope FROM (SELECT label, idx, x, lag(x) OVER (PARTITION BY label, idx ORDER BY vec_id) AS p FROM emb_x) WHERE p IS NOT NULL GROUP BY ALL", "emb_x"))
def m08b(spark, sf_dir):
    v = vecs(spark, sf_dir)
    x = B.attach_stats(v, _packed(v), KEY, [ORDER], ST).withColumn("x", B.normalized())
    slopes = B.fit_ar1(x.select("label", "vec_id", "x"), KEY, ORDER)
    return slopes.select(F.col("label").cast("bigint"), F.posexplode("slopes").alias("idx", "slope")).withColumn("slope", F.round("slope", 6))


@query("M09_validation_errors", sql("SELECT vec_id, round(error, 8) AS error FROM emb_err JOIN emb_part USING (label, vec_id) WHERE part = 'validation'", "emb_err", "emb_part"))
def m09(spark, sf_dir):
    return errors(spark, sf_dir).where("part = 'validation'").select("vec_id", F.round("error", 8).alias("error"))


@query("M10_calibration", sql("SELECT CAST(label AS BIGINT) AS label, round(error_mean, 8) AS error_mean, round(error_std, 8) AS error_std FROM emb_cal", "emb_cal"))
def m10(spark, sf_dir):
    held = errors(spark, sf_dir).where("part = 'validation'")
    return B.calibration(held, KEY, "error", "error").select(F.col("label").cast("bigint"), F.round("error_mean", 8).alias("error_mean"), F.round("error_std", 8).alias("error_std"))


@query("M19_calibrated_score", sql("SELECT vec_id, round(1 / (1 + exp(-(error - error_mean) / error_std)), 6) AS score FROM emb_err JOIN emb_cal USING (label)", "emb_err", "emb_cal"))
def m19(spark, sf_dir):
    e = S.materialize(errors(spark, sf_dir), "embedding-errors")
    cal = B.calibration(e.where("part = 'validation'"), KEY, "error", "error")
    return e.join(cal, KEY).select("vec_id", F.round(B.calibrated("error", "error_mean", "error_std"), 6).alias("score"))


# --- labelled scores: document length, toxic or not -----------------------------------


def docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("error"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")


cte("docs", "SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS error FROM documents")
cte("ldocs", "SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS error, CAST(toxic AS INTEGER) AS label FROM documents JOIN labels USING (doc_id)")
THRESHOLD = "CASE WHEN count(*) = 1 THEN avg(error) ELSE greatest(avg(error) + 2 * stddev_pop(error), quantile_cont(error, 0.95)) END"


def all_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("error"))


@query("M11_error_statistics", sql("SELECT lang, round(avg(error), 6) AS mean, round(stddev_pop(error), 6) AS std, round(quantile_cont(error, 0.9), 6) AS quantile FROM docs GROUP BY 1", "docs"))
def m11(spark, sf_dir):
    s = B.error_statistics(all_docs(spark, sf_dir), ["lang"], "error", 0.9)
    return s.select("lang", *[F.round(c, 6).alias(c) for c in ("mean", "std", "quantile")])


@query("M11b_overall_statistics", sql("SELECT round(avg(error), 6) AS mean, round(stddev_pop(error), 6) AS std, round(quantile_cont(error, 0.37), 6) AS quantile FROM docs", "docs"))
def m11b(spark, sf_dir):
    s = B.error_statistics(all_docs(spark, sf_dir), [], "error", 0.37)
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "quantile")])


@query("M12_threshold", sql(f"SELECT lang, CAST(count(*) AS BIGINT) AS n_errors, round({THRESHOLD}, 6) AS threshold FROM docs GROUP BY 1", "docs"))
def m12(spark, sf_dir):
    return B.tune_threshold(all_docs(spark, sf_dir), ["lang"], "error", ST).withColumn("threshold", F.round("threshold", 6))


@query("M13_tuned_on_errors", sql(f"SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n_errors, round({THRESHOLD}, 8) AS threshold FROM emb_err JOIN emb_part USING (label, vec_id) WHERE part = 'validation' GROUP BY 1", "emb_err", "emb_part"))
def m13(spark, sf_dir):
    held = S.materialize(errors(spark, sf_dir).where("part = 'validation'"), "held-errors")
    return B.tune_threshold(held, KEY, "error", ST).select(F.col("label").cast("bigint"), "n_errors", F.round("threshold", 8).alias("threshold"))


RATES = (
    "cnt AS (SELECT lang, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q, count(*) FILTER (WHERE label = 1 AND error >= 1500) AS tp, "
    "count(*) FILTER (WHERE label = 0 AND error >= 1500) AS fp FROM ldocs GROUP BY 1), "
    "rt AS (SELECT *, coalesce(tp / nullif(p, 0), 0) AS tpr, coalesce(fp / nullif(q, 0), 0) AS fpr, coalesce(tp / nullif(tp + fp, 0), 0) AS pr FROM cnt) "
)


@query("M14_evaluation", sql("--MORE" + RATES + "SELECT lang, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, round(tpr, 8) AS true_positive_rate, round(fpr, 8) AS false_positive_rate, round(coalesce(2 * pr * tpr / nullif(pr + tpr, 0), 0), 8) AS f1_score FROM rt", "ldocs"))
def m14(spark, sf_dir):
    r = B.rates(docs(spark, sf_dir), ["lang"], "error", "label", F.lit(1500.0))
    return r.select("lang", "n_pos", "n_neg", *[F.round(c, 8).alias(c) for c in ("true_positive_rate", "false_positive_rate", "f1_score")])


AUC = (
    "rk AS (SELECT {k} label, avg(r) OVER (PARTITION BY {k} error) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY error) AS r FROM ldocs)), "
    "ag AS (SELECT {k} sum(mid) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM rk {g}) "
    "SELECT {k} round(coalesce((s - p * (p + 1) / 2) / nullif(p * q, 0), 0), 8) AS roc_auc FROM ag"
)


@query("M15_roc_auc", sql("--MORE" + AUC.format(k="lang,", p="lang", g="GROUP BY 1"), "ldocs"))
def m15(spark, sf_dir):
    return B.roc_auc(docs(spark, sf_dir), ["lang"], "error", "label").withColumn("roc_auc", F.round("roc_auc", 8))


@query("M15b_overall_auc", sql("--MORE" + AUC.format(k="", p="1", g=""), "ldocs"))
def m15b(spark, sf_dir):
    return B.roc_auc(docs(spark, sf_dir), [], "error", "label").withColumn("roc_auc", F.round("roc_auc", 8))


@query("W14b_value_histogram", sql("SELECT n_chars AS value, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (ORDER BY n_chars) - count(*) AS BIGINT) AS below_n FROM (SELECT CAST(n_chars AS DOUBLE) AS n_chars FROM documents) GROUP BY 1"))
def w14b(spark, sf_dir):
    return O.cumulative_counts(all_docs(spark, sf_dir), [], "error").drop("total_n")


# --- baselines for every process ------------------------------------------------------


def training_vectors(spark, sf_dir):
    return stored(
        spark, sf_dir, "training-vectors",
        lambda: training.training_vectors(tel(spark, sf_dir), ST, to_ns=TRAIN_END),
    )


def baselines(spark, sf_dir):
    return stored(spark, sf_dir, "baselines", lambda: training.fit(training_vectors(spark, sf_dir), ST))


cte("b_part", f"SELECT host_id, comm, k, n, CASE WHEN rn <= n - {HELD} THEN 'train' ELSE 'validation' END AS part FROM (SELECT host_id, comm, k, row_number() OVER (PARTITION BY host_id, comm ORDER BY k) AS rn, count(*) OVER (PARTITION BY host_id, comm) AS n FROM (SELECT DISTINCT host_id, comm, k FROM c_win))", "c_win")
cte("b_stats", "SELECT host_id, comm, idx, min(v) AS lo, max(v) AS hi, avg(v) AS mean, avg(v) FILTER (WHERE part = 'train') AS tm FROM c_dense JOIN b_part USING (host_id, comm, k) GROUP BY ALL", "c_dense", "b_part")
NORM = "least(greatest(({v} - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 0.0), 1.0)"
cte("b_x", f"SELECT host_id, comm, k, idx, {NORM.format(v='v')} AS x, {NORM.format(v='tm')} AS c FROM c_dense JOIN b_stats USING (host_id, comm, idx)", "c_dense", "b_stats")
cte("b_err", "SELECT host_id, comm, k, part, n, avg((x - c) * (x - c)) AS error, avg((x - p) * (x - p)) AS step_error FROM (SELECT *, lag(x) OVER (PARTITION BY host_id, comm, idx ORDER BY k) AS p FROM b_x) JOIN b_part USING (host_id, comm, k) GROUP BY ALL", "b_x", "b_part")
cte("b_runs", "SELECT host_id, comm, k, CASE WHEN n < 5 THEN coalesce(whole, 0) / 4.0 ELSE m END AS sequence_error FROM (SELECT host_id, comm, k, n, row_number() OVER w AS rn, sum(step_error) OVER (PARTITION BY host_id, comm) AS whole, avg(step_error) OVER (PARTITION BY host_id, comm ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM b_err WINDOW w AS (PARTITION BY host_id, comm ORDER BY k)) WHERE (n >= 5 AND rn >= 5) OR (n < 5 AND rn = n)", "b_err")
cte("b_run_part", f"SELECT *, CASE WHEN rn <= n - {HELD} THEN 'train' ELSE 'validation' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY host_id, comm ORDER BY k) AS rn, count(*) OVER (PARTITION BY host_id, comm) AS n FROM b_runs)", "b_runs")
cte("b_win", f"SELECT host_id, comm, avg(error) AS wm, CASE WHEN stddev_pop(error) <= 0 THEN 1e-6 ELSE stddev_pop(error) END AS ws, {THRESHOLD} AS threshold FROM b_err WHERE part = 'validation' GROUP BY ALL", "b_err")
cte("b_seq", "SELECT host_id, comm, avg(sequence_error) AS sm, CASE WHEN stddev_pop(sequence_error) <= 0 THEN 1e-6 ELSE stddev_pop(sequence_error) END AS ss FROM b_run_part WHERE part = 'validation' GROUP BY ALL", "b_run_part")
cte(
    "fitted",
    "SELECT a.host_id, a.comm, a.n_windows, r.n_sequences, coalesce(threshold, 0) AS threshold, coalesce(wm, 0) AS wm, coalesce(ws, 1) AS ws, coalesce(sm, 0) AS sm, coalesce(ss, 1) AS ss "
    "FROM (SELECT host_id, comm, CAST(max(n) AS BIGINT) AS n_windows FROM b_part GROUP BY 1, 2) a JOIN (SELECT host_id, comm, CAST(count(*) AS BIGINT) AS n_sequences FROM b_runs GROUP BY 1, 2) r USING (host_id, comm) "
    "LEFT JOIN b_win USING (host_id, comm) LEFT JOIN b_seq USING (host_id, comm)",
    "b_part", "b_runs", "b_win", "b_seq",
)
FIT_SQL = "host_id, comm, n_windows, n_sequences, round(threshold, 6) AS threshold, round(wm, 6) AS window_error_mean, round(ws, 6) AS window_error_std, round(sm, 6) AS sequence_error_mean, round(ss, 6) AS sequence_error_std"


def _fit_row(b):
    return b.select(*COMM, "n_windows", "n_sequences", *[F.round(c, 6).alias(c) for c in (
        "threshold", "window_error_mean", "window_error_std", "sequence_error_mean", "sequence_error_std")])


@query("M17_train_all_processes", sql(f"SELECT {FIT_SQL} FROM fitted", "fitted"))
def m17(spark, sf_dir):
    return _fit_row(baselines(spark, sf_dir))


@query("M16_train_one_process", sql(f"SELECT {FIT_SQL} FROM fitted WHERE comm = 'nginx'", "fitted"))
def m16(spark, sf_dir):
    vectors = S.materialize(training.training_vectors(tel(spark, sf_dir), ST, process="nginx", to_ns=TRAIN_END), "nginx-vectors")
    return _fit_row(training.fit(vectors, ST))


@query("M18_training_summary", sql("SELECT host_id, comm, round(threshold, 6) AS threshold, n_windows, n_sequences, round(wm, 6) AS val_loss, true AS window_detector, n_sequences > 0 AS sequence_detector FROM fitted", "fitted"))
def m18(spark, sf_dir):
    return training.summary(baselines(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6)).withColumn("val_loss", F.round("val_loss", 6))


@query("M01b_training_statistics", sql("SELECT host_id, comm, CAST(idx AS INT) AS idx, round(lo, 8) AS min, round(hi, 8) AS max, round(mean, 8) AS mean FROM b_stats", "b_stats"))
def m01b(spark, sf_dir):
    s = B.fit_normalizer(training_vectors(spark, sf_dir), COMM)
    return s.select(*COMM, "idx", *[F.round(c, 8).alias(c) for c in ("min", "max", "mean")])


@query("S15_baseline_bundle", sql(f"SELECT {FIT_SQL} FROM fitted WHERE comm = 'sshd'", "fitted"))
def s15(spark, sf_dir):
    """Saved as a table, one process replaced, then loaded for that process."""
    path = S.work_path(spark, "baseline-table")
    fitted = baselines(spark, sf_dir)
    S.save_baselines(fitted, path)
    S.save_baselines(fitted.where("comm = 'sshd'"), path)
    return _fit_row(S.load_baselines(spark, path, "sshd"))


@query("S16_list_baselines", sql("SELECT host_id, comm AS process_name, round(threshold, 6) AS threshold, n_windows, n_sequences, 86400 AS window_seconds, 5 AS sequence_length FROM fitted WHERE comm <> 'cron'", "fitted"))
def s16(spark, sf_dir):
    kept = S.delete_baseline(baselines(spark, sf_dir), "cron")
    return S.list_baselines(kept).withColumn("threshold", F.round("threshold", 6))
