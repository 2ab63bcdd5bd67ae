"""Structured Streaming: sources, windowed features, keyed state, sinks.

Event time is ``ts_ns`` on the clock of the host; the watermark follows the
largest one seen, so replays give the same result as live runs.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostlens.config import NS, Settings
from hostlens.operators.features import slice_measures
from hostlens.operators.funnel import ORDER, Quota

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond memory, and what transformWithState asks for."""
    spark.conf.set(PROVIDER_CONF, ROCKSDB)


def event_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 100, glob: str | None = None) -> DataFrame:
    """Files appended to a directory as an unbounded table, rate limited so
    that nothing has to be dropped."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def with_event_time(df: DataFrame, delay_seconds: int, time: str = "ts_ns") -> DataFrame:
    return df.withColumn(
        "event_time", F.timestamp_micros(F.expr(f"{time} div 1000"))
    ).withWatermark("event_time", f"{delay_seconds} seconds")


def sliding_features(stream: DataFrame, settings: Settings, names: list[str] | None = None) -> DataFrame:
    """Counters of epoch-aligned sliding windows (W, W/2) per process, emitted
    when the watermark has passed their end."""
    measures = slice_measures()
    chosen = names or ["n", "outbound", "bytes_sent", "bytes_recv", "tor", "private", "dns",
                       "system_files", "writes", "spawns", "shell", "priv_esc", "injection",
                       "namespaces", "pivot", "lolbins", "lolbin_bits"]
    span = F.window(
        "event_time", f"{settings.window_seconds} seconds", f"{settings.window_ns // 2 // 1000} microseconds"
    )
    return (
        stream.groupBy(span.alias("w"), "host_id", "pid")
        .agg(*[measures[n].alias(n) for n in chosen])
        .select(F.unix_micros("w.start").alias("start_us"), "host_id", "pid", *chosen)
    )


def tick_counts(stream: DataFrame, settings: Settings) -> DataFrame:
    """Events per process and score interval, emitted when the interval is over."""
    span = F.window("event_time", f"{settings.score_interval_seconds} seconds")
    return (
        stream.groupBy(span.alias("w"), "host_id", "pid")
        .agg(F.count("*").alias("n"), F.max("ts_ns").alias("latest_ns"))
        .select(F.unix_micros("w.start").alias("start_us"), "host_id", "pid", "n", "latest_ns")
    )


def start_sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append", fmt: str = "parquet"):
    """Start a file sink; ``trigger`` is e.g. ``{"availableNow": True}`` or
    ``{"processingTime": "30 seconds"}``."""
    return (
        df.writeStream.outputMode(mode).format(fmt).option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


# --- rows of a key in order of event time ---------------------------------------------

#: buckets that processes are dealt to; one is one key of a state, so that calls to the state follow the
#: number of buckets and not that of processes (a change needs a new checkpoint)
BUCKETS = 256
#: rows of a bucket or key that are packed together, unless one period has more
PART_ROWS = 1 << 16


def dealt(stream: DataFrame) -> DataFrame:
    """``stream`` with the bucket of each process."""
    return stream.withColumn("_bucket", F.pmod(F.xxhash64("host_id", "pid"), F.lit(BUCKETS)).cast("int"))


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all()


def stretches(periods: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(first period, rows) of the stretches that rows are cut into.

    A stretch has whole periods and up to ``PART_ROWS`` rows; a period with more is one of its own.
    """
    at, counts = np.unique(periods, return_counts=True)
    if len(periods) <= PART_ROWS:
        if len(periods):
            yield int(at[0]), slice(None)
        return
    number, held = np.zeros(len(at), np.int64), 0
    for i, n in enumerate(counts):
        number[i] = number[i - 1] if i else 0
        if held and held + n > PART_ROWS:
            number[i], held = number[i] + 1, 0
        held += n
    of = number[np.searchsorted(at, periods)]
    for i in range(number[-1] + 1):
        yield int(at[np.searchsorted(number, i)]), np.flatnonzero(of == i)


class HeldParts(StatefulProcessor):
    """Packed rows of a bucket or key that wait for the watermark, in stretches of periods.

    A micro-batch adds a part to the stretch that begins where its rows do: calls to the
    state follow the number of micro-batches and rows, not that of periods.
    """

    period_ns: int

    def _read(self, first: int) -> list[bytes]:
        n = self.parts.getValue((first,))[0] if self.parts.containsKey((first,)) else 0
        return [bytes(self.data.getValue((first, i))[0]) for i in range(n)]

    def _take(self, first: int) -> list[bytes]:
        parts = self._read(first)
        for i in range(len(parts)):
            self.data.removeKey((first, i))
        self.parts.removeKey((first,))
        return parts

    def _add(self, first: int, packed: bytes, over: int | None = None) -> None:
        """Adds a part; a timer is set for the end of the first period that is not over."""
        n = self.parts.getValue((first,))[0] if self.parts.containsKey((first,)) else 0
        if not n:
            # a millisecond early: a timer is due when the watermark has passed it
            end = (first if over is None else max(first, over)) + 1
            self.handle.registerTimer(end * self.period_ns // 1_000_000 - 1)
        self.data.updateValue((first, n), (packed,))
        self.parts.updateValue((first,), (n + 1,))

    def _begun(self, over: int) -> list[int]:
        """Stretches that begin before period ``over``."""
        return sorted(first for (first,) in self.parts.keys() if first < over)

    def _over(self, timerValues) -> int:
        """The first period that the watermark has not passed."""
        return timerValues.getCurrentWatermarkInMs() * 1_000_000 // self.period_ns


class InEventTime(HeldParts):
    """Hands the rows of a bucket or key to ``inner`` in order of time, whatever order they arrive in.

    Rows wait, packed, in the period of time they belong to.  When the watermark has
    passed the end of a period nothing earlier can arrive, and a timer hands its rows
    over, sorted, with those of all periods that are over by then.  What comes behind
    the watermark is dropped by Spark.
    """

    def __init__(self, inner: StatefulProcessor, columns: list[str], order: list[str], time: str, period_ns: int):
        if period_ns <= 0 or period_ns % 1_000_000:
            raise ValueError("a period has whole milliseconds")
        self.inner, self.columns, self.order, self.time, self.period_ns = inner, columns, order, time, period_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)
        self.handle = handle
        self.parts = handle.getMapState("waiting_parts", "period bigint", "n int")
        self.data = handle.getMapState("waiting_rows", "period bigint, part int", "packed binary")

    def _put(self, rows: pd.DataFrame) -> None:
        for first, own in stretches(self._periods(rows)):
            self._add(first, pack(pa.Table.from_pandas(rows.iloc[own], preserve_index=False)))

    def _periods(self, rows: pd.DataFrame) -> np.ndarray:
        return (rows[self.time] // self.period_ns).to_numpy().astype(np.int64)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self._put(batch[self.columns])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self._over(timerValues)
        held, later = [], []
        for first in self._begun(over):
            if sum(map(len, held)) >= PART_ROWS:
                # what lies before this stretch is whole
                rows = pd.concat(held)
                before = self._periods(rows) < first
                yield from self._hand_over(key, rows[before], timerValues)
                held = [rows[~before]]
            for raw in self._take(first):
                rows = unpack(raw).to_pandas()
                due = self._periods(rows) < over
                held.append(rows[due])
                if not due.all():
                    later.append(rows[~due])
        if held:
            yield from self._hand_over(key, pd.concat(held), timerValues)
        if later:
            self._put(pd.concat(later))

    def _hand_over(self, key, rows: pd.DataFrame, timerValues) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield from self.inner.handleInputRows(key, iter([rows.sort_values(self.order)]), timerValues)

    def close(self) -> None:
        self.inner.close()


def _with_state(
    stream: DataFrame, keys: list[str], processor: StatefulProcessor, columns: list[str], out: str, order: list[str], time: str,
    period_seconds: float | None,
) -> DataFrame:
    """``processor`` over the rows of a key as they arrive or, with a period, by event time."""
    if period_seconds is None:
        return stream.select(*dict.fromkeys([*keys, *columns])).groupBy(*keys).transformWithStateInPandas(
            processor, outputStructType=out, outputMode="Append", timeMode="None"
        )
    needed = list(dict.fromkeys([*columns, time]))
    held = InEventTime(processor, needed, order, time, round(period_seconds * NS))
    timed = stream.where(F.col(time).isNotNull()).select(*dict.fromkeys([*keys, *needed]), "event_time")
    return timed.groupBy(*keys).transformWithStateInPandas(
        held, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class CarriedRows(StatefulProcessor):
    """Rows of the processes of a bucket, each in order behind the rows it carries over from earlier ones.

    What the processes of a bucket carry is one packed table, which is written anew with
    each call.
    """

    columns: list[str]
    order: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", "packed binary")

    def step(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """The output, and which of ``rows`` (with ``_process``, and ``_new`` where they are not carried) to carry."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [batch[self.columns].assign(_new=True) for batch in rows]
        known = self.carried.exists()
        if known:
            frames.insert(0, unpack(bytes(self.carried.get()[0])).to_pandas().assign(_new=False))
        frame = pd.concat(frames, ignore_index=True)
        frame["_process"] = frame.groupby(["host_id", "pid"], dropna=False, sort=False).ngroup()
        frame = frame.sort_values(["_process", "_new", *self.order], ignore_index=True)
        out, keep = self.step(frame)
        if keep.any():
            self.carried.update((pack(pa.Table.from_pandas(frame.loc[keep, self.columns], preserve_index=False)),))
        elif known:
            self.carried.clear()
        if len(out):
            yield out

    def close(self) -> None:
        pass


# --- trailing window and rolling context as keyed state ---------------------------

TRAILING_OUT = "host_id bigint, pid bigint, latest_ns bigint, event_count bigint, span_ns bigint, reaped boolean"


def _trailing_row(key, latest: int, count: int, span: int, reaped: bool) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "host_id": [key[0]], "pid": [key[1]], "latest_ns": [latest], "event_count": [count],
            "span_ns": [span], "reaped": [reaped],
        }
    )


class TrailingWindow(StatefulProcessor):
    """Last W seconds of a process as state: how many events per timestamp.

    After ``idle_ns`` of event time without events the state is dropped and a
    ``reaped`` row tells so.  Eviction is by time alone, so an old event behind
    a newer one goes as well.
    """

    def __init__(self, window_ns: int, idle_ns: int):
        self.window_ns, self.idle_ns = window_ns, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "ts_ns bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: Counter[int] = Counter()
        for ts, n in (self.counts.get() if self.counts.exists() else []):
            counts[ts] += n
        newest = max(counts, default=0)
        for batch in rows:
            newest = max(newest, int(batch["ts_ns"].max()))
            fresh = batch["ts_ns"][batch["ts_ns"] >= newest - self.window_ns]
            counts.update({int(ts): int(n) for ts, n in fresh.value_counts().items()})
        kept = {ts: n for ts, n in counts.items() if ts >= newest - self.window_ns}
        self.counts.put(list(kept.items()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.idle_ns) // 1_000_000)
        yield _trailing_row(key, newest, sum(kept.values()), newest - min(kept), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = max((r[0] for r in self.counts.get()), default=0)
        self.counts.clear()
        yield _trailing_row(key, newest, 0, 0, True)

    def close(self) -> None:
        pass


def trailing_state(stream: DataFrame, settings: Settings, idle_seconds: int | None = None) -> DataFrame:
    """Size of the trailing window of each process after every micro-batch, and
    a last row when an idle process is forgotten."""
    idle = (idle_seconds or 2 * settings.window_seconds) * NS
    return (
        stream.select("host_id", "pid", "ts_ns", "event_time")
        .groupBy("host_id", "pid")
        .transformWithStateInPandas(
            TrailingWindow(settings.window_ns, idle),
            outputStructType=TRAILING_OUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


CONTEXT_OUT = "host_id bigint, pid bigint, k bigint, context_size int, context_mean double"


class RollingContext(CarriedRows):
    """The values of the last L windows of a process; their mean once there are
    L of them."""

    columns, order = ["host_id", "pid", "k", "value"], ["k"]

    def __init__(self, length: int):
        self.length = length

    def step(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        n, values = len(rows), rows["value"].to_numpy(np.float64)
        _, begins, of, sizes = np.unique(rows["_process"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        at = np.arange(n) - begins[of]
        full = at >= self.length - 1
        total = np.zeros(n)
        for back in range(self.length - 1, -1, -1):
            total[full] += values[np.flatnonzero(full) - back]
        out = rows[["host_id", "pid", "k"]].assign(
            context_size=np.minimum(at + 1, self.length).astype(np.int32), context_mean=np.where(full, total / self.length, np.nan)
        )
        return out[rows["_new"].to_numpy()], at >= sizes[of] - (self.length - 1)


def rolling_context(stream: DataFrame, settings: Settings, period_seconds: float | None = None) -> DataFrame:
    """``stream(host_id, pid, k, value)``, one row per window.

    Windows of a process come in order over the micro-batches or, with
    ``period_seconds``, in any order, with ``ts_ns`` and a watermark on
    ``event_time``; they are then taken by time, a period after the other.
    """
    values = stream.withColumn("value", F.col("value").cast("double"))
    context = RollingContext(settings.sequence_length)
    return _with_state(dealt(values), ["_bucket"], context, context.columns, CONTEXT_OUT, context.order, "ts_ns", period_seconds)


# --- alert funnel as keyed state ------------------------------------------------------

FUNNEL_OUT = "host_id bigint, process_name string, pid bigint, timestamp_ns bigint, outcome string"


class FunnelState(StatefulProcessor):
    """Deduplication and rate limit of one host.

    Time of a host only moves on: a verdict older than the newest one of an
    earlier batch comes too late and gets the outcome ``late``.  ``quiet`` is read
    for the processes of a batch only; ``ends`` lists processes by the period in
    which their silence ends, so that those that are over are found without
    reading the rest.
    """

    def __init__(self, settings: Settings):
        self.settings = settings
        self.period = max(1, settings.dedup_seconds) * NS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quiet = handle.getMapState("quiet", "process_name string", "until_ns bigint")
        self.ends = handle.getMapState("ends", "period bigint", "names string")
        self.slots = handle.getListState("slots", "until_ns bigint")
        self.newest = handle.getValueState("newest", "ts_ns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(ORDER)
        known = {}
        for process in pdf["process_name"].unique():
            if self.quiet.containsKey((process,)):
                known[process] = self.quiet.getValue((process,))[0]
        quota = Quota(self.settings, known, (r[0] for r in (self.slots.get() if self.slots.exists() else [])))
        newest = self.newest.get()[0] if self.newest.exists() else None
        outcomes, changed = [], {}
        for process, ts in zip(pdf["process_name"], pdf["timestamp_ns"].astype(int)):
            if newest is not None and ts < newest:
                outcomes.append("late")
                continue
            outcomes.append(quota.decide(process, ts))
            if outcomes[-1] == "sent":
                changed[process] = ts + self.settings.dedup_seconds * NS
        now = max(int(pdf["timestamp_ns"].max()), newest or 0)
        self.newest.update((now,))
        self.slots.put([(t,) for t in quota.slots])
        self._remember(changed)
        self._forget(now)
        yield pdf.assign(outcome=outcomes)[["host_id", "process_name", "pid", "timestamp_ns", "outcome"]]

    def _remember(self, changed: dict[str, int]) -> None:
        by_period: dict[int, list[str]] = {}
        for process, until in changed.items():
            self.quiet.updateValue((process,), (until,))
            by_period.setdefault(until // self.period, []).append(process)
        for period, names in by_period.items():
            old = json.loads(self.ends.getValue((period,))[0]) if self.ends.containsKey((period,)) else []
            self.ends.updateValue((period,), (json.dumps(sorted({*old, *names}, key=lambda x: (x is None, x or ""))),))

    def _forget(self, now: int) -> None:
        # alerts are sent before now, so at most two periods are still open
        over = [k[0] for k in (self.ends.keys() if self.ends.exists() else []) if (k[0] + 1) * self.period <= now]
        for period in over:
            for process in json.loads(self.ends.getValue((period,))[0]):
                if self.quiet.containsKey((process,)) and self.quiet.getValue((process,))[0] <= now:
                    self.quiet.removeKey((process,))
            self.ends.removeKey((period,))

    def close(self) -> None:
        pass


def funnel_stream(survivors: DataFrame, settings: Settings, period_seconds: float | None = None) -> DataFrame:
    """Outcome of every verdict that passed threshold and suppression.

    Verdicts arrive in time order per host, as the score trigger produces them, or
    are called late; with ``period_seconds`` and a watermark on ``event_time`` they
    arrive in any order and are taken by time.
    """
    columns = ["host_id", "process_name", "pid", "timestamp_ns"]
    return _with_state(
        survivors, ["host_id"], FunnelState(settings), columns, FUNNEL_OUT, ORDER, "timestamp_ns", period_seconds
    )


# --- entry and exit pairing ------------------------------------------------------------

PAIR_OUT = "host_id bigint, pid bigint, enter_id bigint, exit_id bigint, enter_ns bigint, exit_ns bigint"


class OpenEntry(CarriedRows):
    """The entry of a thread that still waits for its exit."""

    columns, order = ["host_id", "pid", "kind", "event_id", "ts_ns"], ["ts_ns", "event_id"]

    def step(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        enter, process = (rows["kind"] == "enter").to_numpy(), rows["_process"].to_numpy()
        same = process[1:] == process[:-1]
        at = np.flatnonzero(same & enter[:-1] & ~enter[1:])
        first, second = rows.iloc[at].reset_index(drop=True), rows.iloc[at + 1].reset_index(drop=True)
        out = first[["host_id", "pid"]].assign(
            enter_id=first["event_id"], exit_id=second["event_id"], enter_ns=first["ts_ns"], exit_ns=second["ts_ns"]
        )
        return out, np.append(~same, True) & enter


def pair_stream(calls: DataFrame, period_seconds: float | None = None) -> DataFrame:
    """Entries with their exits.  Without ``period_seconds`` halves must arrive in time
    order over the micro-batches; with it, and a watermark on ``event_time``, in any
    order: they are paired by time, a period after the other.  A half without a time is left out."""
    return _with_state(dealt(calls), ["_bucket"], OpenEntry(), OpenEntry.columns, PAIR_OUT, OpenEntry.order, "ts_ns", period_seconds)


# --- one stream, three tables ------------------------------------------------------------

def persist_and_score(
    stream: DataFrame,
    checkpoint: str,
    tables: dict[str, str],
    score: Callable[[DataFrame], dict[str, DataFrame]],
    trigger: dict | None = None,
):
    """Write events, verdicts and alerts of each micro-batch.

    ``score`` gives the verdict and alert tables of a batch of events.  Each
    batch goes to a folder named after its id, so a batch that is run again
    after a failure replaces what it had written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        made = {"events": batch, **score(batch)}
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{tables[name]}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def alert_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """New alerts of the alert table as a stream, for any number of readers."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


