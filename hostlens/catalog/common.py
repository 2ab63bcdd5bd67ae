"""Registry, parameters and derived tables shared by the catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostlens.config import NS, Settings
from hostlens.functions import scalars as X
from hostlens.sources.store import materialize
from hostlens.sources.telemetry import adapter_sql, telemetry

DAY = 86_400
# events are sparse (minutes to hours apart), so windows are a day long
ST = Settings(
    window_seconds=DAY,
    sequence_length=5,
    score_interval_seconds=DAY,
    dedup_seconds=DAY // 4,
    rate_window_seconds=DAY,
    max_alerts_per_window=10,
    retention_days=10,
    order_chunk_seconds=DAY,
)
W, STRIDE, TICK = ST.window_ns, ST.stride_ns, ST.tick_ns
T0 = 1_704_067_200 * NS            # 2024-01-01
NOW = T0 + 30 * DAY * NS           # 2024-01-31
TRAIN_END = T0 + 20 * DAY * NS     # 2024-01-21
PROC = ["host_id", "pid"]
COMM = ["host_id", "comm"]

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables in a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries read: computed once per session and
    state of the folder, and kept in the work folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


tel = telemetry


def verdict_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain verdict table with one row per event, for funnel and reports."""
    t = tel(spark, sf_dir)
    score = F.col("k").cast("double") + F.pmod("event_id", F.lit(10)) / 10.0
    return t.select(
        "event_id",
        "host_id",
        "pid",
        F.col("comm").alias("process_name"),
        F.col("ts_ns").alias("timestamp_ns"),
        score.alias("final_score"),
        X.severity(score, ST).alias("severity"),
        F.concat(F.col("comm"), F.lit(" is unusual")).alias("explanation"),
        (F.pmod("event_id", F.lit(11)) != 0).alias("model_available"),
    )


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.operators.alerts import build_alerts

    v = verdict_feed(spark, sf_dir).where(F.col("final_score") >= ST.high)
    return (
        build_alerts(v, F.col("event_id"))
        .withColumn("acknowledged", F.pmod("alert_id", F.lit(2)) == 0)
    )


def rule_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines in file order: three entries for each program name."""
    t = tel(spark, sf_dir)
    return t.groupBy("comm", "host_id").agg(F.count("*").alias("n")).select(
        F.col("host_id").alias("position"),
        F.col("comm").alias("process_name"),
        F.concat(F.lit("seen "), F.col("n").cast("string")).alias("reason"),
        (F.pmod("n", F.lit(130))).cast("double").alias("max_score_suppress"),
        F.when(F.pmod("n", F.lit(3)) == 0, F.lit("2024-01-15T00:00:00"))
        .when(F.pmod("n", F.lit(3)) == 1, F.lit("2024-02-15T00:00:00"))
        .alias("expires_at"),
    )


# --- SQL side ------------------------------------------------------------------------

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (sql, needs)


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """A query over named common tables and whatever they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTE[name][1]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({CTE[n][0]})" for n in order)
    glue = ", " if body.lstrip().upper().startswith("--MORE") else "\n"
    if glue == ", ":
        body = body.lstrip()[len("--MORE"):]
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{glue}{body}"


def lit_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


SEVERITY_SQL = (
    "CASE WHEN least(greatest({s},0),100) >= 90 THEN 'CRITICAL' WHEN least(greatest({s},0),100) >= 70 THEN 'HIGH' "
    "WHEN least(greatest({s},0),100) >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
)

cte("tel", adapter_sql())
cte(
    "feed",
    "SELECT event_id, host_id, pid, comm AS process_name, ts_ns AS timestamp_ns, "
    "CAST(k AS DOUBLE) + (event_id % 10) / 10.0 AS final_score, "
    + SEVERITY_SQL.format(s="(CAST(k AS DOUBLE) + (event_id % 10) / 10.0)")
    + " AS severity, comm || ' is unusual' AS explanation, event_id % 11 <> 0 AS model_available FROM tel",
    "tel",
)
cte(
    "alerts",
    "SELECT event_id AS alert_id, host_id, process_name, pid, final_score AS score, severity, explanation, "
    "timestamp_ns, event_id % 2 = 0 AS acknowledged, '' AS ack_note, timestamp_ns / 1e9 AS created_unix "
    "FROM feed WHERE final_score >= 70",
    "feed",
)
cte(
    "rule_entries",
    "SELECT host_id AS position, comm AS process_name, 'seen ' || CAST(n AS VARCHAR) AS reason, "
    "CAST(n % 130 AS DOUBLE) AS max_score_suppress, CASE n % 3 WHEN 0 THEN TIMESTAMP '2024-01-15 00:00:00' "
    "WHEN 1 THEN TIMESTAMP '2024-02-15 00:00:00' END AS expires_at "
    "FROM (SELECT comm, host_id, count(*) AS n FROM tel GROUP BY 1, 2)",
    "tel",
)
cte(
    "rules",
    "SELECT process_name, arg_max(reason, position) AS reason, arg_max(max_score_suppress, position) AS max_score_suppress, "
    "max_by(struct_pack(e := expires_at), position).e AS expires_at, 'user' AS created_by FROM rule_entries GROUP BY 1",
    "rule_entries",
)
