"""Fixed values of the telemetry contract.

These lists, codes, caps and phrases are part of the data contract: results
are only comparable when they are equal, so they are stated as they are.
"""

# Event family codes.
SYSCALL, NETWORK, FILE, PROCESS = 1, 2, 3, 4
INJECTION, CONTAINER, LOLBIN, ANTIFORENSIC, DNS_TUNNEL = 5, 6, 7, 8, 9

FAMILY_NAMES = {
    1: "syscall",
    2: "network",
    3: "file",
    4: "process",
    5: "injection",
    6: "container",
    7: "lolbin",
    8: "antiforensic",
    9: "dns_tunnel",
}

# Code labels used when raw records are decoded.
PROTOCOL_LABELS = {6: "TCP", 17: "UDP"}
DIRECTION_LABELS = {0: "outbound", 1: "inbound"}
FILE_OPERATIONS = {0: "open", 1: "read", 2: "write", 3: "unlink"}
PROCESS_ACTIONS = {0: "exec", 1: "fork", 2: "exit"}
INJECTION_METHODS = {0: "ptrace", 1: "proc_mem", 2: "process_vm_writev"}
CONTAINER_ACTIONS = {0: "setns", 1: "unshare", 2: "pivot_root"}
ANTIFORENSIC_ACTIONS = {0: "unlink", 1: "timestomp", 2: "truncate"}

# Vector layout.
NUM_SYSCALLS = 335
NUM_BIGRAMS = 50
BIGRAM_FACTOR = 337

# Syscall numbers with a special meaning.
SENSITIVE_SYSCALLS = (105, 106, 157, 59, 322, 62, 101)
PRIV_ESC_SYSCALLS = (105, 106, 117, 119, 157, 101)
SYS_PTRACE, SYS_VM_WRITEV = 101, 311
SYS_SETNS, SYS_UNSHARE, SYS_PIVOT_ROOT = 308, 272, 155
# ptrace requests that attach to or write into the target
# (POKETEXT, POKEDATA, POKEUSR, ATTACH, SEIZE).
PTRACE_WRITE_REQUESTS = (4, 5, 6, 16, 16902)

# Names of the syscalls that appear in explanations by default; the whole
# table is read from the kernel header (see functions.dims.syscall_dim).
KEY_SYSCALL_NAMES = {
    0: "read",
    1: "write",
    3: "close",
    8: "lseek",
    9: "mmap",
    13: "rt_sigaction",
    16: "ioctl",
    59: "execve",
    62: "kill",
    101: "ptrace",
    105: "setuid",
    106: "setgid",
    117: "setresuid",
    119: "setresgid",
    155: "pivot_root",
    157: "prctl",
    202: "futex",
    257: "openat",
    272: "unshare",
    308: "setns",
    311: "process_vm_writev",
    318: "getrandom",
    322: "execveat",
}

# Paths.
SENSITIVE_PREFIXES = (
    "/etc/shadow",
    "/etc/passwd",
    "/etc/sudoers",
    "/root/.ssh/",
    "/proc/*/mem",
    "/dev/mem",
    "/.ssh/id_rsa",
    "/.ssh/authorized_keys",
)
SENSITIVE_BASENAMES = (
    "shadow", "passwd", "sudoers", ".ssh", "mem", "id_rsa", "authorized_keys",
)
SYSTEM_DIRS = ("/etc", "/proc", "/sys", "/dev", "/root", "/boot")
EXEC_SUFFIXES = (".so", ".sh", ".bin", ".elf", ".py", ".pl", ".rb", ".out")
EXEC_DIRS = ("/bin", "/sbin", "/usr/bin", "/usr/sbin", "/usr/local/bin", "/usr/local/sbin")

# Programs.
SHELLS = ("sh", "bash", "zsh", "dash", "ksh", "fish", "csh", "tcsh", "ash", "busybox")
LOLBINS = (
    "wget", "curl", "python", "perl", "bash", "nc", "ncat", "socat",
    "base64", "xxd", "dd", "crontab", "at", "systemctl", "chmod",
)
LOLBIN_ALIASES = {"python": ("python", "python3", "python2")}
# Programs whose exec produces a LOLBin event at derivation time.
LOLBIN_EXEC_WATCHLIST = (
    "wget", "curl", "python", "python3", "perl", "bash", "nc", "ncat",
    "socat", "base64", "xxd", "dd", "crontab", "at", "systemctl", "chmod",
)

# Network.
TOR_PORTS = (9050, 9051, 9001, 9030)
DNS_PORT, DNS_MIN_SUSPICIOUS_BYTES = 53, 100

# Saturation caps.
CAP_UNIQUE_IPS = 50.0
CAP_UNIQUE_PORTS = 50.0
CAP_CONN_RATE = 20.0
CAP_BYTES_RATE = 1_000_000.0
CAP_DNS_SIZE = 512.0
CAP_DNS_RATE = 20.0
CAP_FILES = 50.0
CAP_ANTIFORENSIC = 5.0
CAP_SPAWNS = 20.0
CAP_NAMESPACE = 5.0
CAP_LOLBIN = 10.0
CAP_EVENT_RATE = 1000.0
ENTROPY_BITS = 8.0
SLICE_NS = 100_000_000
SLICES_PER_SECOND = 10

# Names of the semantic features, in vector order.
NETWORK_FEATURES = (
    "unique_remote_ips",
    "unique_remote_ports",
    "outbound_connection_rate",
    "bytes_sent_per_second",
    "bytes_recv_per_second",
    "is_using_tor_port",
    "is_connecting_to_rfc1918",
    "avg_dns_query_size",
    "dns_query_rate",
    "max_dns_payload_bytes",
)
FILE_FEATURES = (
    "unique_files_opened",
    "files_in_system_dirs",
    "executable_files_opened",
    "files_written_count",
    "entropy_of_file_paths",
    "log_deletion_count",
    "timestamp_modification_count",
)
PROCESS_FEATURES = (
    "child_processes_spawned",
    "is_shell_spawned",
    "privilege_escalation_attempt",
    "is_injection_target",
    "namespace_change_count",
    "pivot_root_attempt",
    "lolbin_execution_count",
)
TEMPORAL_FEATURES = ("window_duration_ms", "events_per_second", "cpu_time_ratio")

# Explanations.
MIN_CONTRIBUTION = 0.05
TOP_PHRASES = 3
TOP_FEATURES = 5
PHRASES = {
    "unique_remote_ips": "contacted an unusual number of remote IPs",
    "unique_remote_ports": "probed an unusual number of remote ports",
    "outbound_connection_rate": "opened outbound connections at a high rate",
    "bytes_sent_per_second": "sent data at an unusually high rate",
    "bytes_recv_per_second": "received data at an unusually high rate",
    "is_using_tor_port": "connected to a Tor port",
    "is_connecting_to_rfc1918": "connected to a private/internal address",
    "unique_files_opened": "opened an unusual number of distinct files",
    "files_in_system_dirs": "accessed sensitive system files",
    "executable_files_opened": "opened executable files",
    "files_written_count": "wrote to an unusual number of files",
    "entropy_of_file_paths": "accessed files with high-entropy paths",
    "child_processes_spawned": "spawned an unusual number of child processes",
    "is_shell_spawned": "spawned a shell process",
    "privilege_escalation_attempt": "attempted privilege escalation (setuid/ptrace)",
    "window_duration_ms": "showed an unusual activity span",
    "events_per_second": "generated events at an unusually high rate",
    "cpu_time_ratio": "ran with an unusually high activity duty cycle",
    "is_injection_target":
        "is a Process Injection Target (a foreign process is writing its memory)",
    "namespace_change_count": "changed namespaces — possible Container Escape preparation",
    "pivot_root_attempt": "made a Container Escape Attempt (pivot_root)",
    "lolbin_execution_count": "executed Living-Off-The-Land binaries (LOLBins)",
    "log_deletion_count": "deleted or truncated log files (anti-forensic evidence destruction)",
    "timestamp_modification_count": "tampered with file timestamps (timestomping)",
    "avg_dns_query_size": "issued oversized DNS queries",
    "dns_query_rate": "issued DNS queries at an unusually high rate",
    "max_dns_payload_bytes": "shows DNS Tunneling Exfiltration (oversized DNS payloads)",
}
CRITICAL_FEATURES = (
    "is_injection_target",
    "pivot_root_attempt",
    "namespace_change_count",
    "lolbin_execution_count",
    "log_deletion_count",
    "timestamp_modification_count",
    "avg_dns_query_size",
    "dns_query_rate",
    "max_dns_payload_bytes",
)
SALIENCE_CRITICAL = 3.0
SALIENCE_LOLBIN = 2.5
SALIENCE_PHRASE = 1.0
SALIENCE_SENSITIVE_SYSCALL = 1.0
SALIENCE_SYSCALL = 0.2
SALIENCE_BIGRAM = 0.3

# Severity.
SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}

# Threat signatures: (threat, feature, test, technique ids).
SIGNATURES = (
    ("credential_dumping", "files_in_system_dirs", "gt0", "T1003"),
    ("reverse_shell", "is_shell_spawned", "eq1", "T1059 / T1571"),
    ("lateral_movement", "is_connecting_to_rfc1918", "eq1", "T1021"),
    ("data_exfiltration", "bytes_sent_per_second", "gt0", "T1041"),
    ("privilege_escalation", "privilege_escalation_attempt", "eq1", "T1068 / T1055"),
    ("privilege_escalation", "is_injection_target", "eq1", "T1068 / T1055"),
    ("cryptocurrency_mining", "outbound_connection_rate", "gt0", ""),
    ("process_injection", "is_injection_target", "eq1", "T1055"),
    ("container_escape", "namespace_change_count", "gt0", "T1611"),
    ("container_escape", "pivot_root_attempt", "eq1", "T1611"),
    ("lolbin_execution", "lolbin_execution_count", "gt0", "T1218"),
    ("lolbin_execution", "lolbin_nc", "eq1", "T1218"),
    ("lolbin_execution", "lolbin_chmod", "eq1", "T1218"),
    ("lolbin_execution", "lolbin_wget", "eq1", "T1218"),
    ("antiforensic_log_clearing", "log_deletion_count", "gt0", "T1070"),
    ("antiforensic_log_clearing", "timestamp_modification_count", "gt0", "T1070"),
    ("dns_tunneling", "max_dns_payload_bytes", "gt0", "T1048 / T1071.004"),
    ("dns_tunneling", "avg_dns_query_size", "gt0", "T1048 / T1071.004"),
    ("dns_tunneling", "dns_query_rate", "gt0", "T1048 / T1071.004"),
)
