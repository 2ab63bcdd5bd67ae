"""Telemetry as DataFrames: family schemas, the unified table, raw decoding,
and an adapter that derives telemetry from a plain ``events`` table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hostlens import constants as C
from hostlens.functions import scalars as X
from hostlens.functions.dims import syscall_dim

_L, _S = T.LongType(), T.StringType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


_KEY = dict(event_id=_L, host_id=_L, ts_ns=_L, pid=_L, comm=_S)

FAMILY_FIELDS: dict[int, dict[str, T.DataType]] = {
    C.SYSCALL: dict(tgid=_L, uid=_L, syscall_nr=_L, syscall_name=_S, ret=_L, args=T.ArrayType(_L)),
    C.NETWORK: dict(src_ip=_S, dst_ip=_S, src_port=_L, dst_port=_L, protocol=_S, bytes_count=_L, direction=_S),
    C.FILE: dict(path=_S, operation=_S, flags=_L, ret=_L, bytes_count=_L),
    C.PROCESS: dict(ppid=_L, exe_path=_S, cmdline=_S, action=_S, exit_code=_L),
    C.INJECTION: dict(uid=_L, target_pid=_L, method=_S),
    C.CONTAINER: dict(uid=_L, action=_S, flags=_L),
    C.LOLBIN: dict(ppid=_L, uid=_L),
    C.ANTIFORENSIC: dict(uid=_L, action=_S, path=_S),
    C.DNS_TUNNEL: dict(uid=_L, dst_ip=_S, dst_port=_L, payload_size=_L),
}


def family_schema(family: int) -> T.StructType:
    return _schema(**_KEY, **FAMILY_FIELDS[family])


def _all_fields() -> dict[str, T.DataType]:
    fields: dict[str, T.DataType] = {}
    for family in FAMILY_FIELDS.values():
        fields.update(family)
    return fields


TELEMETRY_SCHEMA = _schema(**_KEY, fam=T.IntegerType(), **_all_fields())


def empty_family(spark: SparkSession, family: int) -> DataFrame:
    return spark.createDataFrame([], family_schema(family))


def union_families(spark: SparkSession, families: dict[int, DataFrame | None]) -> DataFrame:
    """One telemetry table out of the family tables that are there.

    A family that is absent contributes nothing; its columns are still part of
    the result.
    """
    shaped = spark.createDataFrame([], TELEMETRY_SCHEMA)
    parts = [
        df.withColumn("fam", F.lit(family).cast("int"))
        for family, df in sorted(families.items())
        if df is not None
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, shaped)


def load_families(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Read the family tables under ``paths``; a path that cannot be read is
    left out instead of failing the run."""
    from pyspark.errors import AnalysisException

    found: dict[int, DataFrame | None] = {}
    for family, path in paths.items():
        try:
            found[family] = spark.read.schema(family_schema(family)).parquet(path)
        except AnalysisException:
            found[family] = None
    return union_families(spark, found)


def split_families(telemetry: DataFrame) -> dict[int, DataFrame]:
    """The nine typed family views of one mixed table."""
    have = set(telemetry.columns)
    return {
        family: telemetry.where(F.col("fam") == family).select(
            *[c for c in (*_KEY, *fields) if c in have]
        )
        for family, fields in FAMILY_FIELDS.items()
    }


def own_fields(telemetry: DataFrame) -> DataFrame:
    """The mixed table with every field null outside the families that have it, as
    splitting and uniting the families gives, in one pass."""
    return conform(telemetry).where(F.col("fam").isin(*FAMILY_FIELDS)).select(
        *_KEY, "fam",
        *[F.when(F.col("fam").isin(*[n for n, have in FAMILY_FIELDS.items() if f in have]), F.col(f)).alias(f) for f in _all_fields()],
    )


def conform(df: DataFrame) -> DataFrame:
    """Add missing telemetry columns as typed nulls, in schema order."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TELEMETRY_SCHEMA.fields
        ]
    )


# --- raw records ----------------------------------------------------------------

def decode(raw: DataFrame, family: int, spark: SparkSession | None = None) -> DataFrame:
    """Raw records of one family (numeric codes, packed addresses, C strings)
    to the typed columns of that family."""
    col = F.col
    base = [col("event_id"), col("host_id"), col("ts_ns"), col("pid")]
    comm = X.c_string(col("comm")).alias("comm")
    if family == C.SYSCALL:
        dim = F.broadcast(syscall_dim(spark or raw.sparkSession))
        name = F.coalesce(col("syscall_name"), F.concat(F.lit("syscall_"), col("syscall_nr").cast("string")))
        return raw.join(dim, "syscall_nr", "left").select(
            *base, comm, "tgid", "uid", "syscall_nr", name.alias("syscall_name"),
            X.to_signed64(col("ret")).alias("ret"), "args",
        )
    if family == C.NETWORK:
        return raw.select(
            *base, comm,
            X.ipv4_text(col("src_ip")).alias("src_ip"), X.ipv4_text(col("dst_ip")).alias("dst_ip"),
            "src_port", "dst_port", X.protocol_label(col("protocol")).alias("protocol"),
            "bytes_count", X.direction_label(col("direction")).alias("direction"),
        )
    if family == C.FILE:
        return raw.select(
            *base, comm, X.c_string(col("path")).alias("path"),
            X.file_operation_label(col("operation")).alias("operation"),
            "flags", X.to_signed64(col("ret")).alias("ret"), "bytes_count",
        )
    if family == C.PROCESS:
        return raw.select(
            *base, comm, "ppid", X.c_string(col("exe_path")).alias("exe_path"),
            X.c_string(col("cmdline")).alias("cmdline"),
            X.process_action_label(col("action")).alias("action"), "exit_code",
        )
    if family == C.INJECTION:
        return raw.select(
            *base, comm, "uid", "target_pid", X.injection_method_label(col("method")).alias("method")
        )
    if family == C.CONTAINER:
        return raw.select(
            *base, comm, "uid", X.container_action_label(col("action")).alias("action"), "flags"
        )
    if family == C.LOLBIN:
        return raw.select(*base, comm, "ppid", "uid")
    if family == C.ANTIFORENSIC:
        return raw.select(
            *base, comm, "uid", X.antiforensic_action_label(col("action")).alias("action"),
            X.c_string(col("path")).alias("path"),
        )
    if family == C.DNS_TUNNEL:
        return raw.select(
            *base, comm, "uid", X.ipv4_text(col("dst_ip")).alias("dst_ip"), "dst_port", "payload_size"
        )
    raise ValueError(f"unknown event family: {family}")


# --- adapter ------------------------------------------------------------------------

_ADAPTER = (
    "event_id",
    "{TS} AS ts_ns",
    "user_id AS pid",
    "user_id % 4 AS host_id",
    "CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3"
    " WHEN 'signup' THEN 4 ELSE 5 + k % 5 END AS INT) AS fam",
    "CASE WHEN event_type='error' AND k % 5 = 2 THEN CASE event_id % 5 WHEN 0 THEN 'wget'"
    " WHEN 1 THEN 'python3' WHEN 2 THEN 'nc' WHEN 3 THEN 'bash' ELSE 'chmod' END"
    " ELSE CASE user_id % 8 WHEN 0 THEN 'nginx' WHEN 1 THEN 'sshd' WHEN 2 THEN 'postgres'"
    " WHEN 3 THEN 'python3' WHEN 4 THEN 'cron' WHEN 5 THEN 'bash' WHEN 6 THEN 'curl'"
    " ELSE 'node' END END AS comm",
    "CAST(CASE WHEN event_type='click' THEN (k*37 + event_id*7) % 340 END AS BIGINT) AS syscall_nr",
    "CASE WHEN event_type='purchase' THEN CASE k % 5"
    " WHEN 0 THEN concat('10.0.', CAST(k % 4 AS {S}), '.', CAST(event_id % 20 AS {S}))"
    " WHEN 1 THEN concat('172.', CAST(14 + k % 20 AS {S}), '.0.1')"
    " WHEN 2 THEN concat('192.168.1.', CAST(k AS {S}))"
    " ELSE concat('198.51.100.', CAST(k AS {S})) END END AS dst_ip",
    "CAST(CASE WHEN event_type='purchase' THEN CASE WHEN k % 10 = 0 THEN 9050"
    " WHEN k % 10 = 1 THEN 53 ELSE 1000 + k END"
    " WHEN event_type='error' AND k % 5 = 4 THEN 53 END AS BIGINT) AS dst_port",
    "CASE WHEN event_type='purchase' THEN CASE WHEN k % 10 = 1 THEN 'UDP'"
    " ELSE 'TCP' END END AS protocol",
    "CASE WHEN event_type='purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'outbound'"
    " ELSE 'inbound' END END AS direction",
    "CASE"
    " WHEN event_type IN ('purchase','view') THEN CAST(floor(value*1000) AS BIGINT) END AS bytes_count",
    "CASE WHEN event_type='view' THEN CASE k % 6 WHEN 0 THEN '/etc/shadow'"
    " WHEN 1 THEN concat('/var/www/html/p', CAST(k AS {S}), '.html')"
    " WHEN 2 THEN concat('/var/log/app/', CAST(k AS {S}), '.log')"
    " WHEN 3 THEN concat('/usr/bin/tool', CAST(k AS {S})) WHEN 4 THEN 'id_rsa'"
    " ELSE concat('/tmp/', CAST(k AS {S}), '.SH') END"
    " WHEN event_type='error' AND k % 5 = 3 THEN concat('/var/log/', CAST(k AS {S}), '.log') END AS path",
    "CASE WHEN event_type='view' THEN CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'read'"
    " WHEN 2 THEN 'write' ELSE 'unlink' END END AS operation",
    "CASE WHEN event_type='signup' THEN CASE event_id % 3 WHEN 0 THEN 'exec' WHEN 1 THEN 'fork'"
    " ELSE 'exit' END WHEN event_type='error' AND k % 5 = 1 THEN CASE event_id % 3"
    " WHEN 0 THEN 'setns' WHEN 1 THEN 'unshare' ELSE 'pivot_root' END"
    " WHEN event_type='error' AND k % 5 = 3 THEN CASE event_id % 3 WHEN 0 THEN 'unlink'"
    " WHEN 1 THEN 'timestomp' ELSE 'truncate' END END AS action",
    "CASE WHEN event_type='signup' THEN CASE k % 4 WHEN 0 THEN '/bin/bash'"
    " WHEN 1 THEN '/usr/bin/python3' WHEN 2 THEN '/usr/sbin/nginx'"
    " ELSE '/opt/app/' END END AS exe_path",
    "CASE WHEN event_type='signup' THEN CASE WHEN k % 7 = 0 THEN 'sh -c ls'"
    " ELSE 'app --serve' END END AS cmdline",
    "CASE WHEN event_type='error' AND k % 5 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'ptrace'"
    " WHEN 1 THEN 'proc_mem' ELSE 'process_vm_writev' END END AS method",
    "CASE"
    " WHEN event_type='error' AND k % 5 = 4 THEN CAST(101 + floor(value) AS BIGINT) END AS payload_size",
    "k AS k",
    "value AS value",
)

_SPARK = dict(TS="unix_micros(CAST(ts AS TIMESTAMP))*1000", S="STRING", K="CAST(get_json_object(props,'$.k') AS INT)")
_ANSI = dict(TS="epoch_us(ts)*1000", S="VARCHAR", K="CAST(props->>'$.k' AS INT)")


def adapter_sql(dialect: dict[str, str] = _ANSI) -> str:
    """The telemetry view over ``events`` as a query."""
    columns = ", ".join(c.format(**dialect) for c in _ADAPTER)
    return f"SELECT {columns} FROM (SELECT *, {dialect['K']} AS k FROM events) e"


def from_events(events: DataFrame) -> DataFrame:
    """Telemetry derived from ``events(event_id, ts, user_id, event_type, value, props)``."""
    return events.withColumn("k", F.expr(_SPARK["K"])).selectExpr(
        *[c.format(**_SPARK) for c in _ADAPTER]
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
