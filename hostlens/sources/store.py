"""Tables on shared storage: events, alerts, rules, baselines, versions.

All of them are Parquet directories.  A table that is rewritten is written
next to its readers first (``materialize``), never over its own input.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from hostlens.config import NS, Settings
from hostlens.sources.telemetry import FAMILY_FIELDS, own_fields

CHECKPOINT_CONF = "spark.checkpoint.dir"


def work_root(spark: SparkSession) -> str:
    """The shared work folder of the session.

    A local one is made only where the session names none and all tasks run in
    this process; on a cluster, folders of single machines would lose data.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hostlens-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/hostlens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write once to the work folder and go on from there, so that whatever
    reads the result several times does not compute it several times, and a
    lost executor costs no recomputation.  ``options`` go to the writer."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more, as loops
    leave them behind."""
    for df in tables:
        path = df.__dict__.get("work_path")
        if path:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


# --- events ------------------------------------------------------------------------

ENVELOPE_KEYS = ["event_id", "host_id", "ts_ns", "event_type", "pid", "comm"]
LONG_MAX = (1 << 63) - 1


def _payload(family: int, have: set[str]) -> Column:
    fields = [c for c in FAMILY_FIELDS[family] if c in have]
    detail = [
        F.col("ts_ns").alias("timestamp_ns"), F.col("pid"), F.col("comm"), *[F.col(f) for f in fields]
    ]
    return F.to_json(F.struct(*detail))


def to_envelope(telemetry: DataFrame) -> DataFrame:
    """Key columns as they are, everything else of the family as JSON."""
    have = set(telemetry.columns)
    data = None
    for family in FAMILY_FIELDS:
        cond = F.col("fam") == family
        data = F.when(cond, _payload(family, have)) if data is None else data.when(cond, _payload(family, have))
    return telemetry.select(
        "event_id", "host_id", "ts_ns", F.col("fam").alias("event_type"), "pid", "comm", data.alias("data")
    )


def from_envelope(envelope: DataFrame, families: list[int] | None = None) -> DataFrame:
    """Typed events of the given families (all by default) in one table."""
    wanted = families or list(FAMILY_FIELDS)
    fields = {n: t for have in FAMILY_FIELDS.values() for n, t in have.items()}
    detail = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    parsed = envelope.where(F.col("event_type").isin(*wanted)).select(
        "event_id", "host_id", "ts_ns", "pid", "comm", F.col("event_type").cast("int").alias("fam"),
        F.from_json("data", detail).alias("_d"),
    )
    return own_fields(parsed.select("event_id", "host_id", "ts_ns", "pid", "comm", "fam", "_d.*"))


def with_event_date(df: DataFrame, boot_seconds: Column | int = 0) -> DataFrame:
    """Calendar day of an event; ``ts_ns`` counts from the boot of the host."""
    boot = F.lit(boot_seconds) if isinstance(boot_seconds, int) else boot_seconds
    seconds = F.expr(f"ts_ns div {NS}L") + boot
    return df.withColumn("event_date", F.timestamp_seconds(seconds).cast("date"))


def write_events(telemetry: DataFrame, path: str, mode: str = "append") -> None:
    """Append events, laid out by day and family, sorted for lookups by process.

    Rows are rebalanced by day and family: adaptive execution splits what is
    large and joins what is small by measured bytes, so the number of files
    follows the volume and no day is left to a single task.
    """
    (
        with_event_date(to_envelope(telemetry))
        .hint("rebalance", "event_date", "event_type")
        .sortWithinPartitions("event_date", "event_type", "host_id", "pid", "ts_ns")
        .write.mode(mode)
        .partitionBy("event_date", "event_type")
        .parquet(path)
    )


ENVELOPE_SCHEMA = (
    "event_id bigint, host_id bigint, ts_ns bigint, pid bigint, comm string, data string, "
    "event_date date, event_type int"
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE_SCHEMA).parquet(path)


def between(events: DataFrame, from_ts: int, to_ts: int, boot_seconds: int = 0) -> DataFrame:
    """Events of a time range; in a stored table days out of range are not read.

    ``boot_seconds`` is what ``with_event_date`` was given.
    """
    kept = events.where(F.col("ts_ns").between(from_ts, to_ts))
    if "event_date" not in events.columns:
        return kept
    day = lambda ts: F.lit(datetime.date(1970, 1, 1) + datetime.timedelta(seconds=ts // NS + boot_seconds))
    last = (datetime.date.max - datetime.date(1970, 1, 1)).days * 86_400 - boot_seconds
    if from_ts > 0:
        kept = kept.where(F.col("event_date") >= day(from_ts))
    return kept.where(F.col("event_date") <= day(to_ts)) if to_ts // NS < last and to_ts < LONG_MAX else kept


def by_pid(events: DataFrame, host_id: int, pid: int, from_ts: int = 0, to_ts: int = LONG_MAX) -> DataFrame:
    """Events of one process: a pid names a process only on its host."""
    mine = between(events, from_ts, to_ts).where((F.col("host_id") == host_id) & (F.col("pid") == pid))
    return mine.orderBy("ts_ns", "event_id")


def by_process_name(
    events: DataFrame, name: str, from_ts: int = 0, to_ts: int = LONG_MAX, limit: int | None = None
) -> DataFrame:
    found = between(events, from_ts, to_ts).where(F.col("comm") == name).orderBy("ts_ns", "event_id")
    return found if limit is None else found.limit(limit)


def retention_cutoff(now_ns: int, settings: Settings) -> int:
    return now_ns - settings.retention_days * 86_400 * NS


def retained(events: DataFrame, now_ns: int, settings: Settings) -> DataFrame:
    return between(events, retention_cutoff(now_ns, settings), LONG_MAX)


def expired_count(events: DataFrame, now_ns: int, settings: Settings) -> DataFrame:
    return between(events, -LONG_MAX, retention_cutoff(now_ns, settings) - 1).agg(
        F.count("*").alias("deleted")
    )


def apply_retention(spark: SparkSession, path: str, now_ns: int, settings: Settings) -> int:
    """Delete events older than the retention period; returns how many.

    What stays of the boundary day is written to the work folder and replaces
    its partitions; partitions that hold only old events are removed.
    """
    cutoff = retention_cutoff(now_ns, settings)
    cut_day = F.timestamp_seconds(F.lit(cutoff // NS)).cast("date")
    touched = read_events(spark, path).where(F.col("event_date") <= cut_day)
    parts = (
        touched.groupBy("event_date", "event_type")
        .agg(
            F.count_if(F.col("ts_ns") < cutoff).alias("old"),
            F.count_if(F.col("ts_ns") >= cutoff).alias("new"),
        )
        .where("old > 0")
        .collect()  # one row per day and family
    )
    if any(p["new"] for p in parts):
        keep = materialize(
            touched.where((F.col("event_date") == cut_day) & (F.col("ts_ns") >= cutoff)), "retention"
        )
        (
            keep.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_date", "event_type")
            .parquet(path)
        )
    for p in parts:
        if not p["new"]:
            delete_folder(spark, f"{path}/event_date={p['event_date']}/event_type={p['event_type']}")
    return sum(p["old"] for p in parts)


# --- records that may be malformed ------------------------------------------------------

def parse_lines(lines: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """JSON lines to typed columns plus ``is_corrupt`` and the original text."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(
        F.col(column), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    return lines.select(F.col(column).alias("raw_line"), parsed.alias("_p")).select(
        "raw_line",
        *[F.col(f"_p.{f.name}") for f in schema.fields],
        (F.col("_p").isNull() | F.col("_p._bad").isNotNull()).alias("is_corrupt"),
    )


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("is_corrupt")).drop("is_corrupt", "raw_line")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_corrupt").select("raw_line")


def observed(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, counting all and dropped records on the way through."""
    obs = Observation("records")
    return parsed.observe(
        obs,
        F.count("*").alias("records"),
        F.coalesce(F.sum(F.col("is_corrupt").cast("long")), F.lit(0)).alias("dropped"),
    ), obs


# --- rules ------------------------------------------------------------------------------

RULE_SCHEMA = (
    "process_name string, reason string, max_score_suppress double, "
    "expires_at timestamp, created_by string"
)


def rules_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rules written as JSON objects; missing fields take their defaults and an
    expiry that is no timestamp rejects the rule (``valid`` is false)."""
    raw = F.from_json(
        column,
        "process_name string, reason string, max_score_suppress double, expires_at string, created_by string",
    )
    # plain ISO-8601 text without a zone is UTC, like the session
    expiry = F.try_to_timestamp("_r.expires_at")
    return lines.select("*", raw.alias("_r")).select(
        *[c for c in lines.columns if c != column],
        "_r.process_name",
        F.coalesce("_r.reason", F.lit("")).alias("reason"),
        F.coalesce("_r.max_score_suppress", F.lit(100.0)).alias("max_score_suppress"),
        expiry.alias("expires_at"),
        F.coalesce("_r.created_by", F.lit("user")).alias("created_by"),
        (
            F.col("_r.process_name").isNotNull()
            & (F.col("_r.expires_at").isNull() | (F.col("_r.expires_at") == "") | expiry.isNotNull())
        ).alias("valid"),
    )


def rules_to_json(rules: DataFrame) -> DataFrame:
    iso = F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss")
    return rules.select(
        F.to_json(
            F.struct(
                "process_name", "reason", "max_score_suppress", iso.alias("expires_at"), "created_by"
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def last_rule_per_process(rules: DataFrame, position: str) -> DataFrame:
    """The last entry of a process replaces the earlier ones."""
    fields = [c for c in rules.columns if c not in ("process_name", position)]
    return (
        rules.groupBy("process_name")
        .agg(F.max_by(F.struct(*fields), F.col(position)).alias("_r"))
        .select("process_name", "_r.*")
    )


def upsert_rule(rules: DataFrame, added: DataFrame, position: str | None = None) -> DataFrame:
    """Add or replace rules; a ceiling outside 0..100 is not accepted.

    Of several additions for a process the last by ``position`` counts; without
    positions, the largest row.
    """
    ok = added.where(F.col("max_score_suppress").between(0, 100))
    if position:
        ok = last_rule_per_process(ok, position)
    else:
        rest = [c for c in ok.columns if c != "process_name"]
        ok = ok.groupBy("process_name").agg(F.max(F.struct(*rest)).alias("_r")).select("process_name", "_r.*")
    return rules.join(ok.select("process_name"), "process_name", "left_anti").unionByName(ok)


def remove_rule(rules: DataFrame, process_name: str) -> DataFrame:
    return rules.where(F.col("process_name") != process_name)


def rule_is_active(now: Column) -> Column:
    return F.col("expires_at").isNull() | (now < F.col("expires_at"))


def clear_expired(rules: DataFrame, now: Column) -> DataFrame:
    return rules.where(rule_is_active(now))


def expired_rules(rules: DataFrame, now: Column) -> DataFrame:
    return rules.where(~rule_is_active(now)).agg(F.count("*").alias("expired"))


def save_rules(rules: DataFrame, path: str) -> None:
    """Replace the rule file: one JSON object per line."""
    rules_to_json(rules).write.mode("overwrite").text(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file, of each process the last one; without a file there are none.

    Lines are in order of file name and place, files being read whole or in
    splits that follow each other.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], RULE_SCHEMA)
    place = F.struct(F.input_file_name(), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    found = rules_from_json(lines.select("value", place.alias("_place"))).where("valid").drop("valid")
    return last_rule_per_process(found, "_place")


# --- baselines -----------------------------------------------------------------------------

BASELINE_BUCKETS = 64


def _baseline_place(df: DataFrame) -> DataFrame:
    """Folders by host and a hash of the program, so many programs make few folders."""
    return df.withColumn("host", F.col("host_id")).withColumn(
        "bucket", F.pmod(F.xxhash64("comm"), F.lit(BASELINE_BUCKETS)).cast("int")
    )


def _replace_baselines(kept: DataFrame, path: str) -> None:
    """Rewrite the folders that ``kept`` has rows in."""
    (
        materialize(kept, "baselines").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("host", "bucket").parquet(path)
    )


def save_baselines(baselines: DataFrame, path: str) -> None:
    """Write baselines; only those of the same host and program are replaced."""
    spark = baselines.sparkSession
    new = _baseline_place(baselines).withColumn("saved_at", F.current_timestamp())
    if exists(spark, path):
        old = spark.read.parquet(path).withColumn("host", F.col("host_id"))
        touched = old.join(new.select("host", "bucket").distinct(), ["host", "bucket"], "left_semi")
        rest = touched.join(new.select("host_id", "comm"), ["host_id", "comm"], "left_anti")
        new = rest.unionByName(new, allowMissingColumns=True)
    _replace_baselines(new, path)


def load_baselines(spark: SparkSession, path: str, process: str | None = None, host_id: int | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if process is not None:
        bucket = F.pmod(F.xxhash64(F.lit(process)), F.lit(BASELINE_BUCKETS)).cast("int")
        table = table.where((F.col("bucket") == bucket) & (F.col("comm") == process))
    if host_id is not None:
        table = table.where((F.col("host") == host_id) & (F.col("host_id") == host_id))
    return table.drop("host", "bucket")


def remove_baseline(spark: SparkSession, path: str, process: str, host_id: int) -> bool:
    """Delete one baseline from the stored table; false if there was none."""
    table = spark.read.parquet(path)
    bucket = F.pmod(F.xxhash64(F.lit(process)), F.lit(BASELINE_BUCKETS)).cast("int")
    folder = table.where((F.col("host") == host_id) & (F.col("bucket") == bucket))
    mine = (F.col("comm") == process) & (F.col("host_id") == host_id)
    if folder.where(mine).isEmpty():
        return False
    number = folder.select("bucket").first()[0]
    rest = folder.where(~mine).withColumn("host", F.col("host_id"))
    if rest.isEmpty():
        delete_folder(spark, f"{path}/host={host_id}/bucket={number}")
    else:
        _replace_baselines(rest, path)
    return True


def delete_folder(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


# --- processes exempted from scoring --------------------------------------------------------

def save_safe_pids(pids: DataFrame, path: str) -> None:
    """Replace the stored list of (host_id, pid)."""
    materialize(pids.select("host_id", "pid").distinct(), "safe-pids").write.mode("overwrite").parquet(path)


def load_safe_pids(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "host_id bigint, pid bigint")
    return spark.read.parquet(path)


def list_baselines(baselines: DataFrame) -> DataFrame:
    return baselines.select(
        "host_id", F.col("comm").alias("process_name"), "threshold", "n_windows", "n_sequences",
        "window_seconds", "sequence_length",
    ).orderBy("host_id", "process_name")


def baseline_exists(baselines: DataFrame, process: str) -> bool:
    return not baselines.where(F.col("comm") == process).isEmpty()


def delete_baseline(baselines: DataFrame, process: str) -> DataFrame:
    return baselines.where(F.col("comm") != process)


# --- version registry ------------------------------------------------------------------------

def next_versions(registry: DataFrame, added: DataFrame, key: str = "process_name", order: str = "created_unix") -> DataFrame:
    """New registry rows, numbered on from the highest version of the process."""
    highest = registry.groupBy(key).agg(F.max("version").alias("_v"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return (
        added.withColumn("_n", rank)
        .join(highest, key, "left")
        .withColumn("version", (F.coalesce("_v", F.lit(0)) + F.col("_n")).cast("int"))
        .drop("_n", "_v")
    )


def register(registry: DataFrame, added: DataFrame) -> DataFrame:
    return registry.unionByName(next_versions(registry, added))


def latest_versions(registry: DataFrame, key: str = "process_name") -> DataFrame:
    rest = [c for c in registry.columns if c != key]
    return registry.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(key, "_r.*")


def versions_of(registry: DataFrame, process: str) -> DataFrame:
    return registry.where(F.col("process_name") == process).orderBy("version")


