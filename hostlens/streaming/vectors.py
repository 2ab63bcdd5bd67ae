"""The 427-value vector of a process as a stream.

The windows are those of ``windows.aligned``: W seconds long, every W/2, counted
from the epoch.  A window is two panes of W/2, which do not overlap, so an event
belongs to one pane.  The state of a bucket of processes (``live.dealt``) holds what
their open panes add up to: for every process, pane and token (a measure, a syscall
slot, an address, a path, a 100 ms slice...) one number, and the syscalls of the pane,
which can be put in order only when no earlier one can arrive.

A micro-batch adds one packed part per Arrow batch, so its work follows its own
rows, not the size of the state; parts that begin with the same pane are merged into
one when there are ``COMPACT`` of them.  A timer at the end of a pane closes the windows
that are over: it puts two panes together and lets the older one go.  Order of arrival
does not matter as long as events come before the watermark; events behind it are
dropped by Spark.

What leaves the state are the columns of the counter and token block; the vector
is assembled from them by the expressions of the batch operator.

One bucket is one key: its micro-batch goes through one task, Arrow batch by
Arrow batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from hostlens import constants as C
from hostlens.config import Settings
from hostlens.functions import scalars as X
from hostlens.operators import features as FE
from hostlens.streaming import live as L

#: parts of a stretch of panes that are merged into one
COMPACT = 16
# kinds of tokens beyond those of the batch operator; measures follow from MEASURE on
FIRST, LAST, STEP, MEASURE = 20, 21, 22, 100
HOW = {MEASURE + i: FE.FOLDS[m] for i, m in enumerate(FE.MEASURES) if m in FE.FOLDS} | {FE.K_COMM: "max", FIRST: "min", LAST: "max"}
TOKENS = pa.schema([
    ("host_id", pa.int64()), ("pid", pa.int64()), ("pane", pa.int64()),
    ("kind", pa.int16()), ("num", pa.int64()), ("txt", pa.string()), ("v", pa.int64()), ("event_id", pa.int64()),
])
BLOCKS = (
    "host_id bigint, pid bigint, k bigint, first_ns bigint, last_ns bigint, active_slices bigint, "
    + ", ".join(f"{m} bigint" for m in FE.MEASURES)
    + ", calls bigint, call_entries array<struct<num:int,n:bigint>>, pairs bigint, pair_entries array<struct<num:int,n:bigint>>, "
    "ips bigint, ports bigint, opened bigint, entropy double, last_comm string"
)


def _token(kind: int, num: Column | None = None, txt: Column | None = None, v: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).cast("smallint").alias("kind"),
        (num if num is not None else F.lit(None)).cast("bigint").alias("num"),
        (txt if txt is not None else F.lit(None)).cast("string").alias("txt"),
        (v if v is not None else F.lit(1)).cast("bigint").alias("v"),
    )


def event_tokens(stream: DataFrame, settings: Settings) -> DataFrame:
    """(host_id, pid, event_time, event_id, pane, kind, num, txt, v): what each event adds.

    Measures of zero are left out; a path stands for its characters, which are
    counted when its window closes.
    """
    col, is_a = F.col, lambda family: F.col("fam") == family
    ts, slot = col("ts_ns"), X.syscall_slot(col("syscall_nr"))
    path = F.coalesce(col("path"), F.lit(""))
    some = lambda cond, *tokens: F.when(F.coalesce(cond, F.lit(False)), F.array(*tokens)).otherwise(F.array().cast("array<struct<kind:smallint,num:bigint,txt:string,v:bigint>>"))
    slice_no = F.expr(f"ts_ns div {C.SLICE_NS}L")
    measures = [_token(MEASURE + i, v=value) for i, value in enumerate(FE.row_measures().values())]
    tokens = F.concat(
        F.array(_token(FE.K_COMM, txt=F.coalesce(col("comm"), F.lit("")), v=ts), _token(FIRST, slice_no, v=ts), _token(LAST, slice_no, v=ts)),
        F.filter(F.array(*measures), lambda m: m["v"] != 0),
        some(is_a(C.SYSCALL), _token(FE.K_CALL, slot), _token(STEP, slot, v=ts)),
        some(is_a(C.NETWORK), _token(FE.K_IP, txt=col("dst_ip")), _token(FE.K_PORT, col("dst_port"))),
        some(is_a(C.FILE) & (col("operation") == "open"), _token(FE.K_OPEN, txt=path)),
        some(is_a(C.FILE), _token(FE.K_CHAR, txt=path)),
    )
    return stream.select(
        "host_id", "pid", "event_time", "event_id", F.expr(f"ts_ns div {settings.stride_ns}L").alias("pane"), F.inline(tokens)
    )


def folded(rows: pa.Table) -> pa.Table:
    """Tokens of each process and pane once, their values folded as their kind asks for; syscalls as they are."""
    step = pc.equal(rows["kind"], STEP)
    keys = [n for n in rows.column_names if n not in ("v", "event_id")]
    sums = rows.filter(pc.invert(step)).group_by(keys, use_threads=False).aggregate([("v", "sum"), ("v", "min"), ("v", "max")])
    kinds, v = sums["kind"].to_numpy(), sums["v_sum"].to_numpy().copy()
    for how in ("min", "max"):
        mine = np.isin(kinds, [kind for kind, h in HOW.items() if h == how])
        v[mine] = sums[f"v_{how}"].to_numpy()[mine]
    tokens = sums.select(keys).append_column("v", pa.array(v)).append_column("event_id", pa.nulls(len(v), pa.int64()))
    bits = pa.array([kind for kind, h in HOW.items() if h == "or"], pa.int16())
    is_bits = pc.is_in(tokens["kind"], bits)
    if pc.any(is_bits).as_py():
        some = rows.filter(pc.is_in(rows["kind"], bits)).group_by(keys, use_threads=False).aggregate([("v", "distinct")])
        ored = pa.array([reduce(or_, values) for values in some["v_distinct"].to_pylist()], pa.int64())
        some = some.select(keys).append_column("v", ored).append_column("event_id", pa.nulls(len(ored), pa.int64()))
        tokens = pa.concat_tables([tokens.filter(pc.invert(is_bits)), some])
    return pa.concat_tables([tokens.select(rows.column_names), rows.filter(step)]).combine_chunks()


def _merged(parts: list[bytes]) -> tuple[dict[tuple[int, int | None, str | None], int], pa.Table]:
    """What parts add up to over all their processes and panes: tokens, and the syscalls."""
    rows = folded(pa.concat_tables(map(L.unpack, parts)).select(TOKENS.names[3:]))
    step = pc.equal(rows["kind"], STEP)
    kinds, nums, txts, values, _ = (c.to_pylist() for c in rows.filter(pc.invert(step)).columns)
    return dict(zip(zip(kinds, nums, txts), values)), rows.filter(step)


def _runs(of: np.ndarray) -> np.ndarray:
    """Where in sorted numbers a new one begins."""
    return np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)


def _entries(of: np.ndarray, nums: np.ndarray, counts: np.ndarray, n: int) -> list[list[dict]]:
    """(num, n) of each of ``n`` windows, of rows sorted by window and number."""
    out: list[list[dict]] = [[] for _ in range(n)]
    for w, num, times in zip(of.tolist(), nums.astype(np.int64).tolist(), counts.tolist()):
        out[w].append({"num": num, "n": times})
    return out


def _entropies(of: list[int], paths: list[str], times: list[int], n: int) -> np.ndarray:
    """Entropy of the characters in the paths of each window."""
    chars: dict[int, Counter[str]] = {}
    known: dict[str, list[tuple[str, int]]] = {}
    for w, path, many in zip(of, paths, times):
        if path not in known:
            known[path] = list(Counter(path).items())
        own = chars.setdefault(w, Counter())
        for c, count in known[path]:
            own[c] += count * many
    out = np.zeros(n)
    for w, own in chars.items():
        if own:
            x = np.fromiter(own.values(), float, len(own))
            out[w] = np.log2(x.sum()) - (x * np.log2(x)).sum() / x.sum()
    return out


def window_blocks(rows: pa.Table) -> pd.DataFrame:
    """Counter and token block of windows, of their tokens (folded; ``k`` in place of ``pane``)."""
    kinds, nums, v = (rows[c].to_numpy() for c in ("kind", "num", "v"))
    names = rows.select(["host_id", "pid", "k"]).to_pandas()
    w = names.groupby(["host_id", "pid", "k"], dropna=False, sort=False).ngroup().to_numpy()
    _, at = np.unique(w, return_index=True)
    n, out = len(at), names.iloc[at].reset_index(drop=True)

    measures = np.zeros((n, len(FE.MEASURES)), np.int64)
    is_measure = kinds >= MEASURE
    measures[w[is_measure], kinds[is_measure] - MEASURE] = v[is_measure]

    def of(kind, *by):
        """Rows of a kind in order of their window and columns."""
        mine = np.flatnonzero(kinds == kind)
        return mine[np.lexsort((*[c[mine] for c in reversed(by)], w[mine]))]

    # slices are cut by the clock; the ones to count start at the first event
    slices = of(FIRST, nums)
    firsts, lasts, ws = v[slices], v[of(LAST, nums)], w[slices]
    begins = _runs(ws)
    opened = firsts[begins][ws]
    opens, ends = (firsts - opened) // C.SLICE_NS, (lasts - opened) // C.SLICE_NS
    more = ends != opens
    anew = np.append(True, opens[1:] != ends[:-1])
    anew[begins] = True
    out["first_ns"], out["last_ns"] = firsts[begins], lasts[np.append(begins[1:], len(ws)) - 1]
    out["active_slices"] = np.bincount(ws, anew.astype(int) + more, n).astype(np.int64)
    out[FE.MEASURES] = measures

    calls = of(FE.K_CALL, nums)
    out["calls"] = np.bincount(w[calls], v[calls], n).astype(np.int64)
    out["call_entries"] = _entries(w[calls], nums[calls], v[calls], n)
    steps = of(STEP, v, rows["event_id"].to_numpy())
    slots, ws = nums[steps].astype(np.int64), w[steps]
    next_to = ws[1:] == ws[:-1]
    buckets = ((slots[:-1] * C.BIGRAM_FACTOR + slots[1:]) % C.NUM_BIGRAMS)[next_to]
    pairs, counts = np.unique(ws[:-1][next_to] * C.NUM_BIGRAMS + buckets, return_counts=True)
    out["pairs"] = np.bincount(pairs // C.NUM_BIGRAMS, counts, n).astype(np.int64)
    out["pair_entries"] = _entries(pairs // C.NUM_BIGRAMS, pairs % C.NUM_BIGRAMS, counts, n)
    for name, kind in (("ips", FE.K_IP), ("ports", FE.K_PORT), ("opened", FE.K_OPEN)):
        out[name] = np.bincount(w[kinds == kind], minlength=n)
    paths = np.flatnonzero(kinds == FE.K_CHAR)
    out["entropy"] = _entropies(w[paths].tolist(), rows["txt"].take(paths).to_pylist(), v[paths].tolist(), n)
    comms = np.flatnonzero(kinds == FE.K_COMM)
    named = pd.DataFrame({"w": w[comms], "v": v[comms], "txt": rows["txt"].take(comms).to_pylist()})
    out["last_comm"] = named.sort_values(["w", "v", "txt"]).drop_duplicates("w", keep="last")["txt"].to_numpy()
    return out[[f.split()[0] for f in BLOCKS.split(", ")]]


class WindowVectors(L.HeldParts):
    """Open panes of a bucket of processes; emits the blocks of windows when they are over."""

    def __init__(self, stride_ns: int):
        self.period_ns = stride_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "pane bigint", "n int")
        self.data = handle.getMapState("data", "pane bigint, part int", "packed binary")
        self.closed = handle.getValueState("closed", "k bigint")

    def _add(self, first: int, packed: bytes, over: int | None = None) -> None:
        n = self.parts.getValue((first,))[0] if self.parts.containsKey((first,)) else 0
        if n + 1 >= COMPACT:
            packed = L.pack(folded(pa.concat_tables(map(L.unpack, [*self._take(first), packed]))))
        super()._add(first, packed, over)

    def _put(self, rows: pa.Table, over: int | None = None) -> None:
        for first, own in L.stretches(rows["pane"].to_numpy()):
            self._add(first, L.pack(rows if isinstance(own, slice) else rows.take(own)), over)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self._put(folded(pa.Table.from_pandas(batch[TOKENS.names], TOKENS, preserve_index=False)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self._over(timerValues)
        done = self.closed.get()[0] if self.closed.exists() else None
        if done is not None and done >= over - 2:
            return
        held = TOKENS.empty_table()
        for first in self._begun(over):
            if len(held) >= L.PART_ROWS:
                # what lies before this stretch is whole
                yield from self._close(held, done, first - 2)
                done = first - 2 if done is None else max(done, first - 2)
                held = held.filter(pc.greater_equal(held["pane"], first - 1))
            held = pa.concat_tables([held, *map(L.unpack, self._take(first))])
        yield from self._close(held, done, over - 2)
        open_panes = held.filter(pc.greater_equal(held["pane"], over - 1))
        if len(open_panes):
            self._put(folded(open_panes), over)
        self.closed.update((over - 2,))

    def _close(self, rows: pa.Table, after: int | None, last: int) -> Iterator[pd.DataFrame]:
        """Windows behind ``after`` up to ``last``, of all that their panes hold."""
        windows = []
        for back in (0, 1):
            k = pc.subtract(rows["pane"], back)
            some = pc.less_equal(k, last) if after is None else pc.and_(pc.greater(k, after), pc.less_equal(k, last))
            windows.append(rows.set_column(2, "k", k).filter(some))
        both = folded(pa.concat_tables(windows))
        if len(both):
            yield window_blocks(both)

    def close(self) -> None:
        pass


def vector_stream(stream: DataFrame, settings: Settings) -> DataFrame:
    """``host_id, pid, k, first_ns, last_ns, n, last_comm, features`` of every window
    that is over; ``stream`` carries ``event_time`` and its watermark."""
    if settings.stride_ns * 2 != settings.window_ns or settings.stride_ns % 1_000_000:
        raise ValueError("windows must be two panes of whole milliseconds")
    closed = (
        L.dealt(event_tokens(stream, settings).where("pane IS NOT NULL")).groupBy("_bucket")
        .transformWithStateInPandas(
            WindowVectors(settings.stride_ns), outputStructType=BLOCKS, outputMode="Append", timeMode="EventTime"
        )
    )
    return closed.select(
        "host_id", "pid", "k", "first_ns", "last_ns", "n", "last_comm", FE.assembled(settings).alias("features")
    )
