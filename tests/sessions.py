"""Short literal sessions with features that can be worked out by hand."""

from hostlens import constants as C
from hostlens.sources.telemetry import TELEMETRY_SCHEMA

BASE = 2_000_000_000_000
MS = 1_000_000


def call(nr):
    return dict(fam=C.SYSCALL, syscall_nr=nr)


def net(dst_ip, dst_port, n, direction="outbound"):
    return dict(fam=C.NETWORK, dst_ip=dst_ip, dst_port=dst_port, bytes_count=n, direction=direction, protocol="TCP")


def file(path, operation):
    return dict(fam=C.FILE, path=path, operation=operation)


def proc(comm, action="exec", exe="", cmdline=""):
    return dict(fam=C.PROCESS, comm=comm, action=action, exe_path=exe, cmdline=cmdline)


def frame(spark, rows, pid=6606, host_id=0, base=BASE, step=MS, comm="app"):
    """Events ``step`` apart; a row may set its own ``ts_ns``, ``pid``..."""
    names = [f.name for f in TELEMETRY_SCHEMA.fields]
    out = []
    for i, r in enumerate(rows):
        full = dict(event_id=i, host_id=host_id, pid=pid, comm=comm, ts_ns=base + i * step)
        full.update(r)
        out.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(out, TELEMETRY_SCHEMA)


SESSIONS = {
    "credential_dumping": (
        [file(p, o) for p in ("/etc/shadow", "/etc/passwd", "/root/.ssh/id_rsa") for o in ("open", "read")],
        {"unique_files_opened": 0.06, "files_in_system_dirs": 0.12, "entropy_of_file_paths": 0.454968},
    ),
    "reverse_shell": (
        [proc("bash", exe="/bin/bash", cmdline="bash -i"), net("198.51.100.66", 4444, 256)],
        {"child_processes_spawned": 0.05, "is_shell_spawned": 1.0, "unique_remote_ips": 0.02,
         "unique_remote_ports": 0.02, "outbound_connection_rate": 1 / 600, "bytes_sent_per_second": 256 / 3e7},
    ),
    "lateral_movement": (
        [net(f"10.0.0.{i}", 22, 512) for i in (5, 6, 7)] + [proc("ssh", exe="/usr/bin/ssh", cmdline="ssh 10.0.0.5")],
        {"unique_remote_ips": 0.06, "unique_remote_ports": 0.02, "outbound_connection_rate": 0.005,
         "bytes_sent_per_second": 1536 / 3e7, "is_connecting_to_rfc1918": 1.0, "child_processes_spawned": 0.05},
    ),
    "privilege_escalation": (
        [call(105), call(101), dict(fam=C.INJECTION, method="ptrace", target_pid=1)],
        {"syscall_105_freq": 0.5, "syscall_101_freq": 0.5, "syscall_bigram_36": 1.0,
         "privilege_escalation_attempt": 1.0, "is_injection_target": 1.0},
    ),
    "cryptocurrency_mining": (
        [net("203.0.113.9", 3333 if i % 2 else 4444, 4096) for i in range(8)] + [call(318)] * 40
        + [dict(fam=C.LOLBIN, comm="curl")],
        {"unique_remote_ips": 0.02, "unique_remote_ports": 0.04, "outbound_connection_rate": 8 / 600,
         "bytes_sent_per_second": 32768 / 3e7, "syscall_318_freq": 1.0, "syscall_bigram_34": 1.0,
         "lolbin_execution_count": 0.1, "lolbin_curl": 1.0},
    ),
    "process_injection": (
        [dict(fam=C.INJECTION, method=m, target_pid=1234) for m in ("ptrace", "proc_mem", "process_vm_writev")],
        {"is_injection_target": 1.0},
    ),
    "container_escape": (
        [dict(fam=C.CONTAINER, action=a) for a in ("setns", "unshare", "pivot_root")],
        {"namespace_change_count": 0.4, "pivot_root_attempt": 1.0},
    ),
    "lolbin_execution": (
        [dict(fam=C.LOLBIN, comm=c) for c in ("wget", "nc", "base64", "chmod")],
        {"lolbin_execution_count": 0.4, "lolbin_wget": 1.0, "lolbin_nc": 1.0, "lolbin_base64": 1.0, "lolbin_chmod": 1.0},
    ),
    "antiforensic_log_clearing": (
        [dict(fam=C.ANTIFORENSIC, action=a, path="/var/log/auth.log") for a in ("unlink", "truncate", "timestomp")],
        {"log_deletion_count": 0.4, "timestamp_modification_count": 0.2},
    ),
    "dns_tunneling": (
        [dict(fam=C.DNS_TUNNEL, payload_size=n, dst_port=53) for n in (220, 300, 380, 420, 480)],
        {"avg_dns_query_size": 360 / 512, "dns_query_rate": 5 / 600, "max_dns_payload_bytes": 480 / 512},
    ),
    "attack_window": (
        [proc("bash", exe="/bin/bash", cmdline="bash"), file("/etc/shadow", "read"), call(59)],
        {"is_shell_spawned": 1.0, "child_processes_spawned": 0.05, "files_in_system_dirs": 0.02,
         "entropy_of_file_paths": 0.409702, "syscall_59_freq": 1.0},
    ),
}
TEMPORAL = ("window_duration_ms", "events_per_second", "cpu_time_ratio")
