"""Window features, one by one and as a vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.common import PROC, ST, query, sql, tel
from hostlens.catalog import vector_sql  # noqa: F401
from hostlens.functions import scalars as X
from hostlens.functions.dims import feature_dim, feature_names
from hostlens.operators import features as FE
from hostlens.operators.windows import hopping

KEY = [*PROC, "k"]

SINGLE = {
    "F03": "unique_remote_ips",
    "F04": "unique_remote_ports",
    "F05": "outbound_connection_rate",
    "F06": "bytes_sent_per_second",
    "F07": "bytes_recv_per_second",
    "F08": "is_using_tor_port",
    "F09": "is_connecting_to_rfc1918",
    "F10": "avg_dns_query_size",
    "F11": "dns_query_rate",
    "F12": "max_dns_payload_bytes",
    "F13": "unique_files_opened",
    "F14": "files_in_system_dirs",
    "F15": "executable_files_opened",
    "F16": "files_written_count",
    "F17": "entropy_of_file_paths",
    "F18": "log_deletion_count",
    "F19": "timestamp_modification_count",
    "F20": "child_processes_spawned",
    "F21": "is_shell_spawned",
    "F22": "privilege_escalation_attempt",
    "F23": "is_injection_target",
    "F24": "namespace_change_count",
    "F25": "pivot_root_attempt",
    "F26": "lolbin_execution_count",
    "F28": "window_duration_ms",
    "F29": "events_per_second",
    "F30": "cpu_time_ratio",
}


def _named(names):
    def run(spark, sf_dir):
        t = tel(spark, sf_dir)
        out = FE.named_features(t, hopping(t, PROC, ST), PROC, names, ST)
        return out.select(*KEY, *[F.round(n, 8).alias(n) for n in names])

    return run


def _named_sql(names):
    cols = ", ".join(f"round(CAST({n} AS DOUBLE), 8) AS {n}" for n in names)
    return sql(f"SELECT host_id, pid, k, {cols} FROM p_sem", "p_sem")


for _id, _name in SINGLE.items():
    query(f"{_id}_{_name}", _named_sql([_name]))(_named([_name]))

_LOL = [f"lolbin_{n}" for n in C.LOLBINS]
query("F27_lolbin_flags", _named_sql(_LOL))(_named(_LOL))

_SHARES = (
    "SELECT host_id, pid, k, CAST({slot} AS INT) AS slot, round(count(*) / sum(count(*)) OVER (PARTITION BY host_id, pid, k), 8) AS share "
    "FROM {src} GROUP BY host_id, pid, k, {slot}"
)


def _shares(column):
    def run(spark, sf_dir):
        t = tel(spark, sf_dir)
        out = FE.frequency_block(t, hopping(t, PROC, ST), PROC, ST)
        return (
            out.select(*KEY, F.posexplode(column).alias("slot", "share"))
            .where("share > 0")
            .withColumn("share", F.round("share", 8))
        )

    return run


query(
    "F01_syscall_frequency",
    sql(_SHARES.format(slot=vector_sql.SLOT, src="(SELECT * FROM p_win WHERE fam = 1)"), "p_win"),
)(_shares("call_shares"))
query("F02_syscall_bigrams", sql(_SHARES.format(slot="bucket", src="p_pwin"), "p_pwin"))(_shares("pair_shares"))


@query(
    "F31_feature_vector",
    sql("SELECT host_id, pid, k, CAST(idx AS INT) AS idx, round(v, 8) AS v FROM p_vec WHERE v <> 0", "p_vec"),
)
def vector(spark, sf_dir):
    t = tel(spark, sf_dir)
    v = FE.checked(FE.vectors(t, hopping(t, PROC, ST), PROC, ST))
    return (
        v.select(*KEY, F.posexplode("features").alias("idx", "v"))
        .where("v <> 0")
        .withColumn("v", F.round("v", 8))
    )


@query(
    "F32_clamp",
    "SELECT event_id, CASE WHEN isnan(v) OR isinf(v) THEN 0.0 ELSE least(greatest(v, 0.0), 1.0) END AS v "
    "FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE "
    "ELSE round(value, 4) - 1.0 END AS v FROM events)",
)
def clamp(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = (
        F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(float("nan")))
        .when(F.pmod("event_id", F.lit(7)) == 1, F.lit(float("inf")))
        .otherwise(F.round("value", 4) - 1.0)
    )
    return e.select("event_id", X.clamp01(odd).alias("v"))


@query(
    "F33_feature_names",
    sql(
        "SELECT CAST(idx AS INT) AS idx, CASE WHEN idx < 335 THEN 'syscall_' || idx || '_freq' WHEN idx < 385 THEN 'syscall_bigram_' || (idx - 335) "
        "ELSE [" + ", ".join(f"'{n}'" for n in feature_names()[385:]) + "][idx - 384] END AS name, CAST(count(*) AS BIGINT) AS windows "
        "FROM p_vec WHERE v > 0 GROUP BY ALL",
        "p_vec",
    ),
)
def names(spark, sf_dir):
    """Name of every vector position that is ever used, with how many windows use it."""
    t = tel(spark, sf_dir)
    v = FE.vectors(t, hopping(t, PROC, ST), PROC, ST)
    used = (
        v.select(F.posexplode("features").alias("idx", "v")).where("v > 0")
        .groupBy("idx").agg(F.count("*").alias("windows"))
    )
    return used.join(F.broadcast(feature_dim(spark).select("idx", "name")), "idx").select("idx", "name", "windows")


@query(
    "F34_saturation",
    "SELECT event_id, round(least(value / 2.0, 1.0), 8) AS half, CAST(0.0 AS DOUBLE) AS no_cap FROM events",
)
def saturation(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        F.round(X.saturate(F.col("value"), 2.0), 8).alias("half"),
        X.saturate(F.col("value"), 0.0).alias("no_cap"),
    )
