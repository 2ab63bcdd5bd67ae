"""Threat-layer events derived from base telemetry, and entry/exit pairing.

Every derivation is a filter and a projection on the base table, so that it
reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostlens import constants as C
from hostlens.config import Settings
from hostlens.functions import scalars as X
from hostlens.operators.ordered import consecutive_pairs

_KEY = ["event_id", "host_id", "ts_ns", "pid", "comm"]


def exclude_self(df: DataFrame, own_pids: list[int]) -> DataFrame:
    """Drop the idle task and the monitor's own processes."""
    return df.where(~F.col("tgid").isin(0, *own_pids))


def succeeded(df: DataFrame) -> DataFrame:
    return df.where(F.col("ret") == 0)


def attach_class(df: DataFrame) -> DataFrame:
    return df.where(F.col("mode").bitwiseAND(2) != 0)


def injections(telemetry: DataFrame) -> DataFrame:
    """Writes into another process: ptrace, process_vm_writev, /proc/<pid>/mem."""
    call = F.col("fam") == C.SYSCALL
    nr, args = F.col("syscall_nr"), F.col("args")
    ptrace = call & (nr == C.SYS_PTRACE) & F.element_at(args, 1).isin(*C.PTRACE_WRITE_REQUESTS)
    writev = call & (nr == C.SYS_VM_WRITEV)
    mem = (
        (F.col("fam") == C.FILE)
        & (F.col("operation") == "write")
        & F.col("path").rlike(r"^/proc/[^/]+/mem$")
    )
    return telemetry.where(ptrace | writev | mem).select(
        *_KEY,
        F.when(ptrace, F.try_element_at(args, F.lit(2)))
        .when(writev, F.try_element_at(args, F.lit(1)))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("target_pid"),
        F.when(mem, "proc_mem").when(writev, "process_vm_writev").otherwise("ptrace").alias("method"),
    )


def container_escapes(telemetry: DataFrame) -> DataFrame:
    nr, args = F.col("syscall_nr"), F.col("args")
    return telemetry.where(
        (F.col("fam") == C.SYSCALL) & nr.isin(C.SYS_SETNS, C.SYS_UNSHARE, C.SYS_PIVOT_ROOT)
    ).select(
        *_KEY,
        F.when(nr == C.SYS_SETNS, "setns")
        .when(nr == C.SYS_UNSHARE, "unshare")
        .otherwise("pivot_root")
        .alias("action"),
        F.when(nr == C.SYS_SETNS, F.try_element_at(args, F.lit(2)))
        .when(nr == C.SYS_UNSHARE, F.try_element_at(args, F.lit(1)))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("flags"),
    )


def lolbin_watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in C.LOLBIN_EXEC_WATCHLIST], "comm string")


def lolbins(telemetry: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Execs of watched programs; the fixed list is a pushed-down IN filter, a
    list kept as a table is a semi join."""
    execs = telemetry.where((F.col("fam") == C.PROCESS) & (F.col("action") == "exec"))
    if watchlist is None:
        execs = execs.where(F.col("comm").isin(*C.LOLBIN_EXEC_WATCHLIST))
    else:
        execs = execs.join(watchlist, "comm", "left_semi")
    return execs.select(*_KEY)


def log_tampering(changes: DataFrame) -> DataFrame:
    """Truncations and timestamp changes on paths that begin with /var/log."""
    return changes.where(
        F.col("action").isin("truncate", "timestomp") & F.col("path").startswith("/var/log")
    )


def log_deletions(files: DataFrame) -> DataFrame:
    """Unlinks of files whose directory is called ``log``, wherever it lies."""
    parent = F.try_element_at(F.split("path", "/"), F.lit(-2))
    return files.where((F.col("operation") == "unlink") & (parent == "log")).select(
        *_KEY, F.lit("unlink").alias("action"), X.parent_slash_name(F.col("path")).alias("path")
    )


def dns_tunnels(network: DataFrame) -> DataFrame:
    return network.where(
        (F.col("protocol") == "UDP")
        & (F.col("dst_port") == C.DNS_PORT)
        & (F.col("bytes_count") > C.DNS_MIN_SUSPICIOUS_BYTES)
    ).select(*_KEY, "dst_ip", "dst_port", F.col("bytes_count").alias("payload_size"))


def destination(df: DataFrame) -> DataFrame:
    return df.withColumn("dst_ip", F.coalesce("msg_addr", "sock_addr"))


def enter_exit(
    df: DataFrame, keys: list[str], carry_enter: list[str], carry_exit: list[str], settings: Settings
) -> DataFrame:
    """Pair each entry with the exit that follows it directly on its thread.

    A second entry replaces an open one; an exit without an open entry and an
    entry without an exit give nothing.  ``kind`` is ``enter`` or ``exit``.
    """
    chunk = F.expr(f"ts_ns div {settings.order_chunk_ns}L")
    both = list(dict.fromkeys(["kind", *carry_enter, *carry_exit]))
    pairs = consecutive_pairs(df, keys, ["ts_ns", "event_id"], both, chunk)
    return pairs.where((F.col("prev.kind") == "enter") & (F.col("cur.kind") == "exit")).select(
        *keys,
        F.col("prev.event_id").alias("enter_id"),
        F.col("cur.event_id").alias("exit_id"),
        F.col("prev.ts_ns").alias("enter_ns"),
        F.col("cur.ts_ns").alias("exit_ns"),
        *[F.col(f"prev.{c}").alias(c) for c in carry_enter],
        *[F.col(f"cur.{c}").alias(c) for c in carry_exit],
    )


def with_syscall_names(calls: DataFrame, dim: DataFrame) -> DataFrame:
    return calls.join(F.broadcast(dim), "syscall_nr", "left").withColumn(
        "syscall_name",
        F.coalesce("syscall_name", F.concat(F.lit("syscall_"), F.col("syscall_nr").cast("string"))),
    )
