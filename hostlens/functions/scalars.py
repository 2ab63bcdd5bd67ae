"""Column expressions: decoding of raw values, predicates on paths, ports,
addresses and programs, and the arithmetic shared by features and scores.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from hostlens import constants as C

U64 = "decimal(20,0)"


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def has_prefix(col: Column, prefixes) -> Column:
    return any_of(col.startswith(p) for p in prefixes)


# --- decoding ---------------------------------------------------------------

def c_string(raw: Column) -> Column:
    """NUL-terminated bytes to trimmed text; bad UTF-8 becomes U+FFFD."""
    head = F.substring_index(raw.cast("string"), "\u0000", 1)
    return F.btrim(F.make_valid_utf8(head), F.lit(" \t\n\r\f\v"))


def to_signed64(unsigned: Column) -> Column:
    wide = unsigned.cast(U64)
    limit = F.lit("9223372036854775808").cast(U64)
    wrap = F.lit("18446744073709551616").cast(U64)
    return F.when(wide >= limit, wide - wrap).otherwise(wide).cast("bigint")


def ipv4_text(packed: Column) -> Column:
    """Address packed with its first octet in the low byte."""
    v = packed.cast("bigint")
    octet = lambda shift: F.shiftright(v, shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", octet(0), octet(8), octet(16), octet(24))


def label(code: Column, labels: dict[int, str], prefix: str = "") -> Column:
    """Name of a code, or the prefixed number when the code is not known."""
    chain = reduce(
        lambda acc, item: acc.when(code == item[0], item[1]) if acc is not None
        else F.when(code == item[0], item[1]),
        labels.items(),
        None,
    )
    return chain.otherwise(F.concat(F.lit(prefix), code.cast("string")))


def protocol_label(code: Column) -> Column:
    return label(code, C.PROTOCOL_LABELS)


def direction_label(code: Column) -> Column:
    return label(code, C.DIRECTION_LABELS)


def file_operation_label(code: Column) -> Column:
    return label(code, C.FILE_OPERATIONS, "operation_")


def process_action_label(code: Column) -> Column:
    return label(code, C.PROCESS_ACTIONS, "action_")


def injection_method_label(code: Column) -> Column:
    return label(code, C.INJECTION_METHODS, "method_")


def container_action_label(code: Column) -> Column:
    return label(code, C.CONTAINER_ACTIONS, "action_")


def antiforensic_action_label(code: Column) -> Column:
    return label(code, C.ANTIFORENSIC_ACTIONS, "action_")


def be16_to_host(v: Column) -> Column:
    v = v.cast("int")
    return F.shiftright(v, 8).bitwiseOR(F.shiftleft(v, 8)).bitwiseAND(0xFFFF)


def exit_status(code: Column) -> Column:
    return F.shiftright(code.cast("bigint"), 8).bitwiseAND(0xFF)


def flatten_argv(argv: Column, max_args: int = 16, max_chars: int = 255) -> Column:
    return F.substring(F.array_join(F.slice(argv, 1, max_args), " "), 1, max_chars)


def duration_seconds(text: Column) -> Column:
    """``90s``/``15m``/``1h``/``7d``, any letter case, to seconds."""
    t = F.lower(F.trim(text))
    size = F.regexp_extract(t, r"^(\d+)\s*([smhd])$", 1)
    unit = F.regexp_extract(t, r"^(\d+)\s*([smhd])$", 2)
    factor = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    )
    return F.try_to_number(size, F.lit("9999999999")).cast("bigint") * factor


# --- paths and programs -----------------------------------------------------

def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def parent_slash_name(path: Column) -> Column:
    """``<parent>/<name>``, the two last components of a path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1))


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"\S+", 0)


def is_sensitive_path(path: Column) -> Column:
    return has_prefix(path, C.SENSITIVE_PREFIXES) | basename(path).isin(*C.SENSITIVE_BASENAMES)


def in_system_dir(path: Column) -> Column:
    return has_prefix(path, C.SYSTEM_DIRS)


def looks_executable(path: Column) -> Column:
    lowered = F.lower(path)
    return any_of(lowered.endswith(s) for s in C.EXEC_SUFFIXES) | has_prefix(path, C.EXEC_DIRS)


def is_shell(comm: Column, exe_path: Column, cmdline: Column) -> Column:
    """One of the three names of the process is a shell."""
    text = lambda c: F.coalesce(c, F.lit(""))
    names = (
        F.lower(text(comm)),
        F.lower(basename(text(exe_path))),
        F.lower(basename(first_token(text(cmdline)))),
    )
    return any_of(n.isin(*C.SHELLS) for n in names)


def is_priv_esc(nr: Column) -> Column:
    return nr.isin(*C.PRIV_ESC_SYSCALLS)


def lolbin_bits(comm: Column) -> Column:
    """Bit ``i`` is set when ``comm`` stands for watchlist entry ``i``."""
    name = F.lower(F.coalesce(comm, F.lit("")))
    bits = F.lit(0)
    for i, entry in enumerate(C.LOLBINS):
        aliases = C.LOLBIN_ALIASES.get(entry, (entry,))
        bits = bits + F.when(name.isin(*aliases), 1 << i).otherwise(0)
    return bits.cast("int")


# --- network ----------------------------------------------------------------

_OCTET = r"(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IPV4_PATTERN = r"^" + r"\.".join([_OCTET] * 4) + r"$"


def is_tor_port(port: Column) -> Column:
    return port.isin(*C.TOR_PORTS)


def is_rfc1918(ip: Column) -> Column:
    """Private IPv4 address; text that is not an IPv4 address is not private."""
    second = F.split(ip, r"\.")[1].try_cast("int")
    private = (
        ip.startswith("10.")
        | ip.startswith("192.168.")
        | (ip.startswith("172.") & second.between(16, 31))
    )
    return F.coalesce(private & ip.rlike(IPV4_PATTERN), F.lit(False))


# --- arithmetic ---------------------------------------------------------------

def saturate(value: Column, cap: float) -> Column:
    if cap <= 0:
        return F.lit(0.0)
    return F.least(value / F.lit(float(cap)), F.lit(1.0))


def clamp01(value: Column) -> Column:
    """Into [0, 1]; NaN, infinities and null become 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, as ``%.<digits>f`` does in C.

    ``round`` and ``bround`` look at the shortest decimal text instead, which
    differs when that text ends in a 5 the binary value lies above or below.
    """
    scale = 10.0 ** (digits + 1)
    product = value * scale
    split = value * 134217729.0
    high = split - (split - value)
    lost = (high * scale - product) + (value - high) * scale  # rounding error of the product
    whole = F.rint(product)
    side = (product - whole) + lost  # where the value lies from the nearest step
    on_five = (F.abs(product - whole) < 1e-3) & (F.pmod(F.abs(whole), F.lit(10.0)) == 5.0)
    return (
        F.when(on_five & (side > 0), (whole + 5.0) / scale)
        .when(on_five & (side < 0), (whole - 5.0) / scale)
        .when(on_five, F.bround(value, digits))
        .otherwise(F.round(value, digits))
    )


def fixed_text(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_half_even(value, digits))


def syscall_slot(nr: Column) -> Column:
    last = C.NUM_SYSCALLS - 1
    return F.when(nr.between(0, last), nr).otherwise(last).cast("int")


def bigram_bucket(a: Column, b: Column) -> Column:
    return F.pmod(a * C.BIGRAM_FACTOR + b, F.lit(C.NUM_BIGRAMS)).cast("int")


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def severity(score: Column, settings) -> Column:
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
    return (
        F.when(s >= settings.critical, "CRITICAL")
        .when(s >= settings.high, "HIGH")
        .when(s >= settings.medium, "MEDIUM")
        .otherwise("LOW")
    )


def severity_rank(sev: Column) -> Column:
    chain = None
    for name, rank in C.SEVERITY_RANK.items():
        chain = F.when(sev == name, rank) if chain is None else chain.when(sev == name, rank)
    return chain.otherwise(0)


def family_name(code: Column) -> Column:
    chain = None
    for k, name in C.FAMILY_NAMES.items():
        chain = F.when(code == k, name) if chain is None else chain.when(code == k, name)
    return chain.otherwise("other")
