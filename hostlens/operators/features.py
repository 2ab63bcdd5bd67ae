"""The 427-value feature vector of a window.

Two aggregations per window, both with map-side partial sums:

* ``counter_block``: rows are first folded into 100 ms slices of a window, so
  a busy process collapses to ten rows per second before its window is put
  together.  All counters and flags and the three temporal values come from it.
* ``token_block``: rows are turned into tokens (syscall slot, syscall pair,
  address, port, opened path, path character), counted per window and token,
  then folded into the frequency arrays, the distinct counts and the entropy.

Each block reads only the columns it needs; they meet at window level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostlens import constants as C
from hostlens.config import Settings
from hostlens.functions import scalars as X
from hostlens.functions.dims import NUM_FEATURES, feature_index
from hostlens.operators.ordered import consecutive_pairs

COUNTER_COLUMNS = [
    "ts_ns", "event_id", "fam", "comm", "syscall_nr", "dst_ip", "dst_port", "direction",
    "bytes_count", "path", "operation", "action", "exe_path", "cmdline", "payload_size",
]
TOKEN_COLUMNS = [
    "ts_ns", "event_id", "fam", "comm", "syscall_nr", "dst_ip", "dst_port", "path", "operation",
]


def _is(family: int) -> Column:
    return F.col("fam") == family


MEASURES = [
    "n", "outbound", "bytes_sent", "bytes_recv", "tor", "private", "dns", "dns_bytes", "dns_max", "system_files", "exec_opens",
    "writes", "log_deletions", "timestomps", "spawns", "shell", "priv_esc", "injection", "namespaces", "pivot", "lolbins",
    "lolbin_bits",
]
#: how the values of a measure are folded; all others are summed
FOLDS = {name: "max" for name in ("tor", "private", "dns_max", "shell", "priv_esc", "injection", "pivot")} | {"lolbin_bits": "or"}


def fold(name: str, value: Column | str) -> Column:
    return {"sum": F.sum, "max": F.max, "or": F.bit_or}[FOLDS.get(name, "sum")](value)


def row_measures() -> dict[str, Column]:
    """What one event adds to a window; name -> value, of which null adds nothing."""
    col = F.col
    path = F.coalesce(col("path"), F.lit(""))
    outbound = _is(C.NETWORK) & (col("direction") == "outbound")
    inbound = _is(C.NETWORK) & ~F.coalesce(col("direction") == "outbound", F.lit(False))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    value = lambda cond, v: F.when(cond, F.col(v)).otherwise(F.lit(0))
    lol = _is(C.LOLBIN)
    measures = [
        F.lit(1),
        one(outbound),
        value(outbound, "bytes_count"),
        value(inbound, "bytes_count"),
        one(_is(C.NETWORK) & X.is_tor_port(col("dst_port"))),
        one(_is(C.NETWORK) & X.is_rfc1918(col("dst_ip"))),
        one(_is(C.DNS_TUNNEL)),
        value(_is(C.DNS_TUNNEL), "payload_size"),
        value(_is(C.DNS_TUNNEL), "payload_size"),
        one(_is(C.FILE) & (X.in_system_dir(path) | X.is_sensitive_path(path))),
        one(_is(C.FILE) & (col("operation") == "open") & X.looks_executable(path)),
        one(_is(C.FILE) & (col("operation") == "write")),
        one(_is(C.ANTIFORENSIC) & col("action").isin("unlink", "truncate")),
        one(_is(C.ANTIFORENSIC) & (col("action") == "timestomp")),
        one(_is(C.PROCESS) & col("action").isin("exec", "fork")),
        one(_is(C.PROCESS) & X.is_shell(col("comm"), col("exe_path"), col("cmdline"))),
        one(_is(C.SYSCALL) & X.is_priv_esc(col("syscall_nr"))),
        one(_is(C.INJECTION)),
        one(_is(C.CONTAINER) & col("action").isin("setns", "unshare")),
        one(_is(C.CONTAINER) & (col("action") == "pivot_root")),
        one(lol),
        F.when(lol, X.lolbin_bits(col("comm"))).otherwise(F.lit(0)),
    ]
    return dict(zip(MEASURES, measures, strict=True))


def slice_measures() -> dict[str, Column]:
    """What is summed, maximised or or-ed per slice; name -> column."""
    return {name: F.count("*") if name == "n" else fold(name, value) for name, value in row_measures().items()}


def counter_block(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Counters, flags, first and last timestamp and active slices per window.

    Whether two events fall into the same 100 ms slice is counted from the
    first event of the window.  A clock-aligned slice covers at most two such
    slices, so its first and last timestamp are enough to count them.
    """
    measures = slice_measures()
    slices = windowed.groupBy(*keys, F.expr(f"ts_ns div {C.SLICE_NS}L").alias("_slice")).agg(
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
        *[m.alias(name) for name, m in measures.items()],
    )
    line = Window.partitionBy(*keys).orderBy("_slice")
    opened = F.first("first_ns").over(line)
    bucket = lambda c: F.expr(f"({c} - _opened) div {C.SLICE_NS}L")
    active = (
        F.when(F.col("_before").isNull() | (bucket("first_ns") != bucket("_before")), 1).otherwise(0)
        + F.when(bucket("last_ns") != bucket("first_ns"), 1).otherwise(0)
    )
    return (
        slices.withColumn("_opened", opened)
        .withColumn("_before", F.lag("last_ns").over(line))
        .groupBy(*keys)
        .agg(
            F.min("first_ns").alias("first_ns"),
            F.max("last_ns").alias("last_ns"),
            F.sum(active).alias("active_slices"),
            *[fold(name, name).alias(name) for name in measures],
        )
    )


def syscall_pairs(events: DataFrame, entity: list[str], settings: Settings) -> DataFrame:
    """Consecutive syscalls of a process: slots of both, and when."""
    calls = events.where(_is(C.SYSCALL)).select(
        *entity, "ts_ns", "event_id", X.syscall_slot(F.col("syscall_nr")).alias("slot")
    )
    chunk = F.expr(f"ts_ns div {settings.order_chunk_ns}L")
    pairs = consecutive_pairs(calls, entity, ["ts_ns", "event_id"], ["slot"], chunk)
    return pairs.select(
        *entity,
        F.col("cur.ts_ns").alias("ts_ns"),
        F.col("cur.event_id").alias("event_id"),
        F.col("prev.ts_ns").alias("prev_ns"),
        X.bigram_bucket(F.col("prev.slot"), F.col("cur.slot")).alias("bucket"),
    )


# token kinds
K_CALL, K_PAIR, K_IP, K_PORT, K_OPEN, K_CHAR, K_COMM = range(1, 8)


def _token(kind: int, num: Column | None = None, txt: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).cast("tinyint").alias("kind"),
        (num if num is not None else F.lit(None)).cast("int").alias("num"),
        (txt if txt is not None else F.lit(None)).cast("string").alias("txt"),
    )


def event_tokens(windowed: DataFrame, keys: list[str]) -> DataFrame:
    path = F.coalesce(F.col("path"), F.lit(""))
    comm = _token(K_COMM, txt=F.coalesce(F.col("comm"), F.lit("")))
    chars = F.transform(
        F.filter(F.split(path, ""), lambda c: c != ""), lambda c: _token(K_CHAR, txt=c)
    )
    opened = F.when(
        F.col("operation") == "open", F.array(_token(K_OPEN, txt=path))
    ).otherwise(F.array().cast("array<struct<kind:tinyint,num:int,txt:string>>"))
    tokens = (
        F.when(_is(C.SYSCALL), F.array(comm, _token(K_CALL, X.syscall_slot(F.col("syscall_nr")))))
        .when(
            _is(C.NETWORK),
            F.array(comm, _token(K_IP, txt=F.col("dst_ip")), _token(K_PORT, F.col("dst_port"))),
        )
        .when(_is(C.FILE), F.concat(F.array(comm), opened, chars))
        .otherwise(F.array(comm))
    )
    return windowed.select(*keys, "ts_ns", F.inline(tokens))


def token_counts(
    windowed: DataFrame, pairs_windowed: DataFrame | None, keys: list[str]
) -> DataFrame:
    """Rows and last timestamp per window and token."""
    tokens = event_tokens(windowed, keys)
    if pairs_windowed is not None:
        whole = pairs_windowed.where(F.col("prev_ns") >= F.col("win_start"))
        tokens = tokens.unionByName(
            whole.select(
                *keys,
                "ts_ns",
                F.lit(K_PAIR).cast("tinyint").alias("kind"),
                F.col("bucket").alias("num"),
                F.lit(None).cast("string").alias("txt"),
            )
        )
    return tokens.groupBy(*keys, "kind", "num", "txt").agg(
        F.count("*").alias("n"), F.max("ts_ns").alias("seen_ns")
    )


def token_block(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse frequencies (at most 335 and 50 entries), distinct counts,
    path entropy in bits and the name of the newest event."""
    kind = lambda k: F.col("kind") == k
    n_of = lambda k: F.coalesce(F.sum(F.when(kind(k), F.col("n"))), F.lit(0))
    distinct = lambda k: F.sum(F.when(kind(k), 1).otherwise(0))
    entry = F.struct(F.col("num"), F.col("n"))
    entries = lambda k: F.sort_array(F.collect_list(F.when(kind(k), entry)))
    chars = n_of(K_CHAR)
    n_log_n = F.sum(F.when(kind(K_CHAR), F.col("n") * F.log2(F.col("n").cast("double"))))
    return counts.groupBy(*keys).agg(
        n_of(K_CALL).alias("calls"),
        entries(K_CALL).alias("call_entries"),
        n_of(K_PAIR).alias("pairs"),
        entries(K_PAIR).alias("pair_entries"),
        distinct(K_IP).alias("ips"),
        distinct(K_PORT).alias("ports"),
        distinct(K_OPEN).alias("opened"),
        F.when(chars > 0, F.log2(chars.cast("double")) - n_log_n / chars)
        .otherwise(F.lit(0.0))
        .alias("entropy"),
        F.max_by(
            F.col("txt"), F.when(kind(K_COMM), F.struct("seen_ns", "txt"))
        ).alias("last_comm"),
    )


def _dense(entries: str, total: str, size: int) -> Column:
    """Sorted (slot, count) entries to a dense array of shares.

    Each entry is preceded by its gap of zeros, so the cost is that of writing
    the array once.
    """
    e = F.col(entries)
    slot_before = lambda i: F.coalesce(F.get(e, i - 1)["num"], F.lit(-1))
    runs = F.transform(
        e,
        lambda x, i: F.concat(
            F.array_repeat(F.lit(0.0), x["num"] - slot_before(i) - 1), F.array(x["n"] / F.col(total))
        ),
    )
    last = F.coalesce(F.try_element_at(e, F.lit(-1))["num"], F.lit(-1))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), F.lit(size - 1) - last))


def semantic_features(window_seconds: int) -> dict[str, Column]:
    """The 42 named features as expressions over both blocks."""
    col, sat = F.col, X.saturate
    seconds = float(max(window_seconds, 1))
    rate = lambda c: col(c) / F.lit(seconds)
    flag = lambda c: col(c).cast("double")
    values = {
        "unique_remote_ips": sat(col("ips"), C.CAP_UNIQUE_IPS),
        "unique_remote_ports": sat(col("ports"), C.CAP_UNIQUE_PORTS),
        "outbound_connection_rate": sat(rate("outbound"), C.CAP_CONN_RATE),
        "bytes_sent_per_second": sat(rate("bytes_sent"), C.CAP_BYTES_RATE),
        "bytes_recv_per_second": sat(rate("bytes_recv"), C.CAP_BYTES_RATE),
        "is_using_tor_port": flag("tor"),
        "is_connecting_to_rfc1918": flag("private"),
        "avg_dns_query_size": sat(
            F.when(col("dns") > 0, col("dns_bytes") / col("dns")).otherwise(F.lit(0.0)),
            C.CAP_DNS_SIZE,
        ),
        "dns_query_rate": sat(rate("dns"), C.CAP_DNS_RATE),
        "max_dns_payload_bytes": sat(col("dns_max"), C.CAP_DNS_SIZE),
        "unique_files_opened": sat(col("opened"), C.CAP_FILES),
        "files_in_system_dirs": sat(col("system_files"), C.CAP_FILES),
        "executable_files_opened": sat(col("exec_opens"), C.CAP_FILES),
        "files_written_count": sat(col("writes"), C.CAP_FILES),
        "entropy_of_file_paths": sat(col("entropy"), C.ENTROPY_BITS),
        "log_deletion_count": sat(col("log_deletions"), C.CAP_ANTIFORENSIC),
        "timestamp_modification_count": sat(col("timestomps"), C.CAP_ANTIFORENSIC),
        "child_processes_spawned": sat(col("spawns"), C.CAP_SPAWNS),
        "is_shell_spawned": flag("shell"),
        "privilege_escalation_attempt": flag("priv_esc"),
        "is_injection_target": flag("injection"),
        "namespace_change_count": sat(col("namespaces"), C.CAP_NAMESPACE),
        "pivot_root_attempt": flag("pivot"),
        "lolbin_execution_count": sat(col("lolbins"), C.CAP_LOLBIN),
    }
    for i, name in enumerate(C.LOLBINS):
        values[f"lolbin_{name}"] = F.getbit(col("lolbin_bits"), F.lit(i)).cast("double")
    span_ms = (col("last_ns") - col("first_ns")) / F.lit(1e6)
    buckets = float(max(int(seconds) * C.SLICES_PER_SECOND, 1))
    values["window_duration_ms"] = F.least(span_ms / F.lit(seconds * 1000.0), F.lit(1.0))
    values["events_per_second"] = sat(rate("n"), C.CAP_EVENT_RATE)
    values["cpu_time_ratio"] = F.least(col("active_slices") / F.lit(buckets), F.lit(1.0))
    return values


def blocks(events: DataFrame, windowing, entity: list[str], settings: Settings) -> DataFrame:
    """Counter and token block of every window."""
    keys = windowing.keys
    pick = lambda cols: windowing.assign(
        events.select(*entity, *[c for c in cols if c not in entity])
    )
    counters = counter_block(pick(COUNTER_COLUMNS), keys)
    pairs = windowing.assign(syscall_pairs(events, entity, settings))
    tokens = token_block(token_counts(pick(TOKEN_COLUMNS), pairs, keys), keys)
    return counters.join(tokens, keys)


def assembled(settings: Settings) -> Column:
    """The vector out of the columns of both blocks."""
    named = semantic_features(settings.window_seconds)
    return F.concat(
        _dense("call_entries", "calls", C.NUM_SYSCALLS),
        _dense("pair_entries", "pairs", C.NUM_BIGRAMS),
        F.array(*[X.clamp01(v) for v in named.values()]),
    )


def vectors(events: DataFrame, windowing, entity: list[str], settings: Settings) -> DataFrame:
    """``keys, first_ns, last_ns, n, last_comm, features``, 427 features in [0, 1].

    Shares lie in [0, 1] by construction; the named features are clamped.
    """
    return (
        blocks(events, windowing, entity, settings)
        .select(
            *windowing.keys,
            "first_ns",
            "last_ns",
            "n",
            "last_comm",
            assembled(settings).alias("features"),
        )
    )


def checked(vecs: DataFrame) -> DataFrame:
    """Fail the job when a vector does not have exactly 427 values."""
    wrong = F.concat(
        F.lit("feature vector length "), F.size("features"), F.lit(f" != {NUM_FEATURES}")
    )
    return vecs.withColumn(
        "features",
        F.when(F.size("features") == NUM_FEATURES, F.col("features")).otherwise(
            F.raise_error(wrong)
        ),
    )


def feature(name: str) -> Column:
    """One feature by name out of the vector column."""
    return F.element_at("features", feature_index()[name] + 1)


TOKEN_MEASURES = {"unique_remote_ips", "unique_remote_ports", "unique_files_opened", "entropy_of_file_paths"}


def named_features(events: DataFrame, windowing, entity: list[str], names: list[str], settings: Settings) -> DataFrame:
    """Some of the semantic features per window, computing only the block or
    blocks they come from."""
    keys = windowing.keys
    pick = lambda cols: windowing.assign(
        events.select(*entity, *[c for c in cols if c not in entity])
    )
    wanted = set(names)
    parts = []
    if wanted - TOKEN_MEASURES:
        parts.append(counter_block(pick(COUNTER_COLUMNS), keys))
    if wanted & TOKEN_MEASURES:
        parts.append(token_block(token_counts(pick(TOKEN_COLUMNS), None, keys), keys))
    table = parts[0] if len(parts) == 1 else parts[0].join(parts[1], keys)
    values = semantic_features(settings.window_seconds)
    return table.select(*keys, *[X.clamp01(values[n]).alias(n) for n in names])


def frequency_block(events: DataFrame, windowing, entity: list[str], settings: Settings) -> DataFrame:
    """Dense syscall and syscall-pair shares per window."""
    keys = windowing.keys
    calls = events.where(_is(C.SYSCALL)).select(
        *entity, *[c for c in TOKEN_COLUMNS if c not in entity]
    )
    pairs = windowing.assign(syscall_pairs(events, entity, settings))
    tokens = token_block(token_counts(windowing.assign(calls), pairs, keys), keys)
    return tokens.select(
        *keys,
        "calls",
        _dense("call_entries", "calls", C.NUM_SYSCALLS).alias("call_shares"),
        "pairs",
        _dense("pair_entries", "pairs", C.NUM_BIGRAMS).alias("pair_shares"),
    )
