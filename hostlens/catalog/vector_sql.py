"""SQL for windows, features and vectors, built for a key and a source table."""

from __future__ import annotations

from hostlens import constants as C
from hostlens.catalog.common import STRIDE, W, DAY, cte, lit_list
from hostlens.functions.dims import feature_index

OCTET = r"(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def prefix_sql(col: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in prefixes) + ")"


def base_sql(col: str) -> str:
    return f"list_extract(string_split(rtrim({col}, '/'), '/'), -1)"


SYSTEM = prefix_sql("path", C.SYSTEM_DIRS)
SENSITIVE = f"({prefix_sql('path', C.SENSITIVE_PREFIXES)} OR {base_sql('path')} IN {lit_list(C.SENSITIVE_BASENAMES)})"
EXECUTABLE = (
    "(" + " OR ".join(f"lower(path) LIKE '%{s}'" for s in C.EXEC_SUFFIXES) + f" OR {prefix_sql('path', C.EXEC_DIRS)})"
)
PRIVATE = (
    f"(regexp_full_match(dst_ip, '{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}') AND (starts_with(dst_ip, '10.') OR "
    "starts_with(dst_ip, '192.168.') OR (starts_with(dst_ip, '172.') AND "
    "TRY_CAST(string_split(dst_ip, '.')[2] AS INT) BETWEEN 16 AND 31)))"
)
TOR = f"dst_port IN {lit_list(C.TOR_PORTS)}"
SHELL = (
    f"(lower(comm) IN {lit_list(C.SHELLS)} OR lower({base_sql('exe_path')}) IN {lit_list(C.SHELLS)} "
    f"OR lower({base_sql('string_split(cmdline, chr(32))[1]')}) IN {lit_list(C.SHELLS)})"
)
SLOT = "CASE WHEN syscall_nr BETWEEN 0 AND 334 THEN syscall_nr ELSE 334 END"


def lolbin_sql(name: str) -> str:
    return f"lower(comm) IN {lit_list(C.LOLBIN_ALIASES.get(name, (name,)))}"


def semantic_sql(seconds: int) -> dict[str, str]:
    """Aggregate expression of each semantic feature except entropy and the
    active slices, which need their own tables."""
    cnt = lambda c: f"count(*) FILTER (WHERE {c})"
    sat = lambda x, cap: f"least(({x}) / {cap}, 1.0)"
    flag = lambda c: f"CAST(coalesce(max(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS DOUBLE)"
    s = float(seconds)
    out = {
        "unique_remote_ips": sat("count(DISTINCT dst_ip) FILTER (WHERE fam = 2)", C.CAP_UNIQUE_IPS),
        "unique_remote_ports": sat("count(DISTINCT dst_port) FILTER (WHERE fam = 2)", C.CAP_UNIQUE_PORTS),
        "outbound_connection_rate": sat(f"{cnt(chr(102) + 'am = 2 AND direction = ' + repr('outbound'))} / {s}", C.CAP_CONN_RATE),
        "bytes_sent_per_second": sat(f"coalesce(sum(bytes_count) FILTER (WHERE fam = 2 AND direction = 'outbound'), 0) / {s}", C.CAP_BYTES_RATE),
        "bytes_recv_per_second": sat(f"coalesce(sum(bytes_count) FILTER (WHERE fam = 2 AND direction <> 'outbound'), 0) / {s}", C.CAP_BYTES_RATE),
        "is_using_tor_port": flag(f"fam = 2 AND {TOR}"),
        "is_connecting_to_rfc1918": flag(f"fam = 2 AND {PRIVATE}"),
        "avg_dns_query_size": sat("coalesce(avg(payload_size) FILTER (WHERE fam = 9), 0)", C.CAP_DNS_SIZE),
        "dns_query_rate": sat(f"{cnt('fam = 9')} / {s}", C.CAP_DNS_RATE),
        "max_dns_payload_bytes": sat("coalesce(max(payload_size) FILTER (WHERE fam = 9), 0)", C.CAP_DNS_SIZE),
        "unique_files_opened": sat("count(DISTINCT path) FILTER (WHERE fam = 3 AND operation = 'open')", C.CAP_FILES),
        "files_in_system_dirs": sat(cnt(f"fam = 3 AND ({SYSTEM} OR {SENSITIVE})"), C.CAP_FILES),
        "executable_files_opened": sat(cnt(f"fam = 3 AND operation = 'open' AND {EXECUTABLE}"), C.CAP_FILES),
        "files_written_count": sat(cnt("fam = 3 AND operation = 'write'"), C.CAP_FILES),
        "log_deletion_count": sat(cnt("fam = 8 AND action IN ('unlink', 'truncate')"), C.CAP_ANTIFORENSIC),
        "timestamp_modification_count": sat(cnt("fam = 8 AND action = 'timestomp'"), C.CAP_ANTIFORENSIC),
        "child_processes_spawned": sat(cnt("fam = 4 AND action IN ('exec', 'fork')"), C.CAP_SPAWNS),
        "is_shell_spawned": flag(f"fam = 4 AND {SHELL}"),
        "privilege_escalation_attempt": flag(f"fam = 1 AND syscall_nr IN {lit_list(C.PRIV_ESC_SYSCALLS)}"),
        "is_injection_target": flag("fam = 5"),
        "namespace_change_count": sat(cnt("fam = 6 AND action IN ('setns', 'unshare')"), C.CAP_NAMESPACE),
        "pivot_root_attempt": flag("fam = 6 AND action = 'pivot_root'"),
        "lolbin_execution_count": sat(cnt("fam = 7"), C.CAP_LOLBIN),
        "window_duration_ms": f"least(((max(ts_ns) - min(ts_ns)) / 1e6) / {s * 1000.0}, 1.0)",
        "events_per_second": sat(f"count(*) / {s}", C.CAP_EVENT_RATE),
    }
    for name in C.LOLBINS:
        out[f"lolbin_{name}"] = flag(f"fam = 7 AND {lolbin_sql(name)}")
    return out


def register_vectors(p: str, entity: list[str], source: str, windowing: str = "hopping") -> list[str]:
    """CTEs ``{p}win``, ``{p}sem``, ``{p}vec`` (sparse) and ``{p}dense`` for windows
    of ``source`` per ``entity``; returns the window key."""
    e = ", ".join(entity)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in entity)
    if windowing == "hopping":
        key = [*entity, "k"]
        cte(f"{p}starts", f"SELECT {e}, min(ts_ns) AS s FROM {source} GROUP BY ALL", source)
        cte(
            f"{p}win",
            f"SELECT * EXCLUDE (k) RENAME (wk AS k) FROM (SELECT t.*, s, unnest([(ts_ns - s) // {STRIDE} - 1, (ts_ns - s) // {STRIDE}]) AS wk "
            f"FROM {source} t JOIN {p}starts b ON {on('t', 'b')}) WHERE wk >= 0 AND ts_ns < s + wk * {STRIDE} + {W}",
            f"{p}starts",
        )
        cte(
            f"{p}pwin",
            f"SELECT * EXCLUDE (s) RENAME (wk AS k) FROM (SELECT t.*, s, unnest([(ts_ns - s) // {STRIDE} - 1, (ts_ns - s) // {STRIDE}]) AS wk "
            f"FROM {p}pairs t JOIN {p}starts b ON {on('t', 'b')}) WHERE wk >= 0 AND ts_ns < s + wk * {STRIDE} + {W} AND prev_ns >= s + wk * {STRIDE}",
            f"{p}starts", f"{p}pairs",
        )
    elif windowing == "aligned":
        key = [*entity, "k"]
        hop = f"unnest([ts_ns // {STRIDE} - 1, ts_ns // {STRIDE}]) AS k"
        cte(f"{p}win", f"SELECT * EXCLUDE (k), {hop} FROM {source}", source)
        cte(f"{p}pwin", f"SELECT * FROM (SELECT *, {hop} FROM {p}pairs) WHERE prev_ns >= k * {STRIDE}", f"{p}pairs")
    elif windowing == "whole":
        key = list(entity)
        cte(f"{p}win", f"SELECT * FROM {source}", source)
        cte(f"{p}pwin", f"SELECT * FROM {p}pairs", f"{p}pairs")
    else:
        key = [*entity, "tick"]
        from hostlens.catalog.common import TICK

        cte(f"{p}latest", f"SELECT {e}, (ts_ns + {TICK - 1}) // {TICK} AS tick, max(ts_ns) AS latest_ns FROM {source} GROUP BY ALL", source)
        cte(
            f"{p}win",
            f"SELECT t.*, b.tick FROM {source} t JOIN {p}latest b ON {on('t', 'b')} AND t.ts_ns BETWEEN latest_ns - {W} AND latest_ns",
            f"{p}latest",
        )
        cte(
            f"{p}pwin",
            f"SELECT t.*, b.tick FROM {p}pairs t JOIN {p}latest b ON {on('t', 'b')} AND t.ts_ns BETWEEN latest_ns - {W} AND latest_ns "
            f"AND t.prev_ns >= latest_ns - {W}",
            f"{p}latest", f"{p}pairs",
        )
    cte(
        f"{p}pairs",
        f"SELECT * FROM (SELECT {e}, ts_ns, lag(ts_ns) OVER w AS prev_ns, (lag({SLOT}) OVER w * 337 + {SLOT}) % 50 AS bucket "
        f"FROM {source} WHERE fam = 1 WINDOW w AS (PARTITION BY {e} ORDER BY ts_ns, event_id)) WHERE prev_ns IS NOT NULL",
        source,
    )
    ks = ", ".join(key)
    using = f"USING ({ks})"
    cte(
        f"{p}entropy",
        f"SELECT {ks}, least(-sum(n / t * log2(n / t)) / 8, 1.0) AS entropy FROM (SELECT {ks}, n, sum(n) OVER (PARTITION BY {ks}) AS t FROM "
        f"(SELECT {ks}, c, count(*) AS n FROM (SELECT {ks}, unnest(string_split(path, '')) AS c FROM {p}win WHERE fam = 3) "
        f"WHERE c <> '' GROUP BY ALL)) GROUP BY ALL",
        f"{p}win",
    )
    cte(
        f"{p}slices",
        f"SELECT {ks}, least(count(DISTINCT (ts_ns - f) // 100000000) / {float(DAY * 10)}, 1.0) AS cpu FROM "
        f"(SELECT {ks}, ts_ns, min(ts_ns) OVER (PARTITION BY {ks}) AS f FROM {p}win) GROUP BY ALL",
        f"{p}win",
    )
    named = semantic_sql(DAY)
    cols = ", ".join(f"{x} AS {n}" for n, x in named.items())
    cte(
        f"{p}sem",
        f"SELECT b.*, coalesce(entropy, 0.0) AS entropy_of_file_paths, cpu AS cpu_time_ratio FROM (SELECT {ks}, max(ts_ns) AS last_ns, count(*) AS n, "
        f"arg_max(comm, ts_ns) AS last_comm, {cols} FROM {p}win GROUP BY {ks}) b LEFT JOIN {p}entropy {using} JOIN {p}slices {using}",
        f"{p}win", f"{p}entropy", f"{p}slices",
    )
    index = feature_index()
    every = [*named, "entropy_of_file_paths", "cpu_time_ratio"]
    entries = ", ".join(f"{{'idx': {index[n]}, 'v': CAST({n} AS DOUBLE)}}" for n in every)
    cte(
        f"{p}vec",
        f"SELECT {ks}, idx, v FROM (SELECT {ks}, unnest([{entries}], recursive := true) FROM {p}sem) "
        f"UNION ALL SELECT {ks}, {SLOT} AS idx, count(*) / sum(count(*)) OVER (PARTITION BY {ks}) FROM {p}win WHERE fam = 1 GROUP BY {ks}, {SLOT} "
        f"UNION ALL SELECT {ks}, 335 + bucket, count(*) / sum(count(*)) OVER (PARTITION BY {ks}) FROM {p}pwin GROUP BY {ks}, bucket",
        f"{p}sem", f"{p}pwin",
    )
    cte(
        f"{p}dense",
        f"SELECT {ks}, r.idx, coalesce(x.v, 0.0) AS v FROM (SELECT DISTINCT {ks} FROM {p}win) w "
        f"CROSS JOIN (SELECT unnest(range(427)) AS idx) r LEFT JOIN {p}vec x USING ({ks}, idx)",
        f"{p}vec",
    )
    return key


register_vectors("p_", ["host_id", "pid"], "tel")
register_vectors("a_", ["host_id", "pid"], "tel", "aligned")
cte("train_src", "SELECT * FROM tel WHERE ts_ns < 1705795200000000000", "tel")
register_vectors("c_", ["host_id", "comm"], "train_src")
cte("score_src", "SELECT * FROM tel WHERE ts_ns >= 1705795200000000000", "tel")
register_vectors("t_", ["host_id", "pid"], "score_src", "ticks")
register_vectors("tt_", ["host_id", "pid"], "tel", "ticks")
cte("explain_src", "SELECT * FROM tel WHERE host_id = 3 AND pid = 7", "tel")
register_vectors("e_", ["host_id", "pid"], "explain_src", "whole")
