"""Time windows per process.

A *windowing* knows how to put rows into windows: ``keys`` names the window
columns and ``assign`` adds them, together with ``win_start``, the smallest
timestamp that belongs to the window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from hostlens.config import Settings
from hostlens.operators.skew import attach_per_key

ROW_ID = ["ts_ns", "event_id"]


def session_starts(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.min("ts_ns").alias("session_start"), F.count("*").alias("session_rows")
    )


@dataclass(frozen=True)
class Hopping:
    """Windows of W seconds every W/2, anchored at the first event of a key.

    Right-open.  The window number ``k`` follows from arithmetic, so an event
    is never compared with windows it is not part of.
    """

    starts: DataFrame
    entity: list[str]
    settings: Settings

    @property
    def keys(self) -> list[str]:
        return [*self.entity, "k"]

    def assign(self, rows: DataFrame) -> DataFrame:
        st = self.settings
        placed = attach_per_key(
            rows, self.starts, self.entity, "session_rows", ROW_ID, st
        )
        newest = F.expr(f"(ts_ns - session_start) div {st.stride_ns}L")
        overlap = -(-st.window_ns // st.stride_ns)
        candidates = F.array(*[F.col("_newest") - i for i in range(overlap - 1, -1, -1)])
        offset = F.col("ts_ns") - F.col("session_start")
        k = F.col("k")
        return (
            placed.withColumn("_newest", newest)
            .withColumn("k", F.explode(candidates))
            .where((k >= 0) & (offset < k * st.stride_ns + st.window_ns))
            .withColumn("win_start", F.col("session_start") + k * st.stride_ns)
            .drop("_newest", "session_start", "session_rows")
        )


def hopping(events: DataFrame, entity: list[str], settings: Settings) -> Hopping:
    return Hopping(session_starts(events, entity), entity, settings)


@dataclass(frozen=True)
class Aligned:
    """Windows of W seconds every W/2, counted from the epoch.  Right-open."""

    entity: list[str]
    settings: Settings

    @property
    def keys(self) -> list[str]:
        return [*self.entity, "k"]

    def assign(self, rows: DataFrame) -> DataFrame:
        st = self.settings
        overlap = -(-st.window_ns // st.stride_ns)
        newest = F.expr(f"ts_ns div {st.stride_ns}L")
        k = F.col("k")
        return (
            rows.withColumn("k", F.explode(F.array(*[newest - i for i in range(overlap - 1, -1, -1)])))
            .where(F.col("ts_ns") < k * st.stride_ns + st.window_ns)
            .withColumn("win_start", k * st.stride_ns)
        )


@dataclass(frozen=True)
class Snapshots:
    """At each tick, the last W seconds of every process before its newest event.

    ``latest`` has one row per ``entity`` and tick in which the process was
    active.  Ticks split the rows of a busy process over time.
    """

    latest: DataFrame
    entity: list[str]
    settings: Settings

    @property
    def keys(self) -> list[str]:
        return [*self.entity, "tick"]

    def assign(self, rows: DataFrame) -> DataFrame:
        st = self.settings
        back = -(-st.window_ns // st.tick_ns)
        own = tick_of(st)
        spread = rows.withColumn("_own", own).withColumn(
            "tick", F.explode(F.sequence("_own", F.col("_own") + back))
        )
        return (
            attach_per_key(spread, self.latest, self.keys, "tick_rows", ROW_ID, st)
            # null where the process was idle in that tick
            .where(F.col("ts_ns").between(F.col("latest_ns") - st.window_ns, F.col("latest_ns")))
            .withColumn("win_start", F.col("latest_ns") - st.window_ns)
            .drop("_own", "latest_ns", "tick_rows")
        )


def tick_of(settings: Settings):
    """Number of the first tick at or after ``ts_ns``."""
    return F.expr(f"(ts_ns + {settings.tick_ns - 1}L) div {settings.tick_ns}L")


def snapshots(events: DataFrame, entity: list[str], settings: Settings) -> Snapshots:
    latest = (
        events.groupBy(*entity, tick_of(settings).alias("tick"))
        .agg(F.max("ts_ns").alias("latest_ns"), F.count("*").alias("tick_rows"))
    )
    return Snapshots(latest, entity, settings)


def repeat_idle(scored: DataFrame, entity: list[str], last_tick: int) -> DataFrame:
    """Repeat each snapshot at the ticks where its process was idle.

    The window of an idle process does not change, so neither does anything
    computed from it; the rows are repeated after scoring.
    """
    line = Window.partitionBy(*entity).orderBy("tick")
    until = F.coalesce(F.lead("tick").over(line) - 1, F.lit(last_tick))
    return (
        scored.withColumn("_until", F.greatest(until, F.col("tick")))
        .withColumn("_at", F.explode(F.sequence("tick", "_until")))
        .withColumn("idle", F.col("_at") > F.col("tick"))
        .withColumn("tick", F.col("_at"))
        .drop("_at", "_until")
    )


@dataclass(frozen=True)
class Whole:
    """All rows of a process as one window."""

    entity: list[str]

    @property
    def keys(self) -> list[str]:
        return list(self.entity)

    def assign(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("win_start", F.lit(-(1 << 63)).cast("bigint"))


# --- trailing windows -------------------------------------------------------

def latest_per_key(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.max("ts_ns").alias("latest_ns"), F.count("*").alias("key_rows")
    )


def trailing(
    events: DataFrame, keys: list[str], settings: Settings, now_ns: int | None = None
) -> DataFrame:
    """Rows no older than W before the newest row of their key, or before
    ``now_ns`` when it is given."""
    if now_ns is not None:
        return events.where(F.col("ts_ns") >= now_ns - settings.window_ns)
    located = attach_per_key(
        events, latest_per_key(events, keys), keys, "key_rows", ROW_ID, settings
    )
    return located.where(F.col("ts_ns") >= F.col("latest_ns") - settings.window_ns).drop(
        "latest_ns", "key_rows"
    )


def window_summary(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows kept and their span in milliseconds."""
    span = (F.max("ts_ns") - F.min("ts_ns")) / 1e6
    return windowed.groupBy(*keys).agg(
        F.count("*").alias("event_count"), span.alias("duration_ms")
    )


def trailing_counts(events: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """For every event the number of events of its key in the last W seconds.

    The timeline is cut into chunks of W.  A row is also handed to the next
    chunk as context, so each chunk is complete by itself and a key with very
    many rows is spread over its chunks.
    """
    w = settings.window_ns
    own = F.expr(f"ts_ns div {w}L")
    both = events.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array(F.col("_own"), F.col("_own") + 1))
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy("ts_ns").rangeBetween(-w, 0)
    return (
        both.withColumn("in_window", F.count("*").over(frame))
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_own", "_chunk")
    )


def alive_keys(events: DataFrame, keys: list[str], now_ns: int, settings: Settings) -> DataFrame:
    """Keys whose window is not empty at ``now_ns``."""
    return (
        events.where(F.col("ts_ns") >= now_ns - settings.window_ns).select(*keys).distinct()
    )


def drop_dead(windows: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    return windows.join(active, keys, "left_semi")


def dead(windows: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    return windows.join(active, keys, "left_anti")


# --- sequences of windows -----------------------------------------------------
# From here on a row is a window, not an event: a key has at most
# span / stride of them however many events it produced.

def sequences(vectors: DataFrame, entity: list[str], settings: Settings, value: str = "features") -> DataFrame:
    """All runs of L consecutive non-empty windows; a shorter session gives one
    run, padded at the front with its first window."""
    size = settings.sequence_length
    line = Window.partitionBy(*entity).orderBy("k")
    ahead = line.rowsBetween(0, size - 1)
    run = F.collect_list(value).over(ahead)
    rank = F.row_number().over(line)
    total = F.count("*").over(Window.partitionBy(*entity))
    pad = F.array_repeat(F.element_at("_run", 1), F.lit(size) - F.size("_run"))
    return (
        vectors.select(*entity, "k", run.alias("_run"), rank.alias("_rank"), total.alias("_n"))
        .where((F.size("_run") == size) | ((F.col("_n") < size) & (F.col("_rank") == 1)))
        .select(*entity, "k", F.concat(pad, "_run").alias("sequence"))
    )


def rolling_context(vectors: DataFrame, entity: list[str], order: str, settings: Settings, value: str = "features") -> DataFrame:
    """The last L windows up to each window, null until there are L."""
    size = settings.sequence_length
    back = Window.partitionBy(*entity).orderBy(order).rowsBetween(-(size - 1), 0)
    run = F.collect_list(value).over(back)
    return vectors.withColumn("context", F.when(F.size(run) == size, run))
