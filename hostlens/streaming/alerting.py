"""From events to alerts in one stream.

Every micro-batch stores its events.  Time moves on with the newest event, less
the lateness allowed; ticks that are over are scored from the stored events of
their windows by the operators of the batch path: snapshots, vectors,
``score_windows`` against the newest baselines, and the funnel.

What a batch has to know of earlier ones are tables as well, in a folder per
batch: the last windows of each process that had a baseline (context), the
alerts sent within the longer horizon (which is all the funnel remembers), and
one row of progress, written last, that names the folders still needed.  A batch
reads folders of earlier batches and overwrites its own, so a batch that failed
half way, or is run again, gives what it would have given.

A batch reads the events of its ticks and of one window before them, and the
context and alerts of processes and hosts that matter; nothing grows with the age
of the stream but the folders themselves.  Events that arrive after their tick
was scored are stored, counted as late and take part in later windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.config import NS, Settings
from hostlens.operators import alerts as A
from hostlens.operators import features as FE
from hostlens.operators import funnel as FN
from hostlens.operators import scoring as SC
from hostlens.operators import windows as W
from hostlens.sources.store import materialize

ENTITY = ["host_id", "pid"]
PROGRESS = (
    "batch_id bigint, newest_ns bigint, closed_tick bigint, events bigint, late bigint, "
    "event_batches array<struct<id:bigint,first_ns:bigint,last_ns:bigint>>, "
    "alert_batches array<struct<id:bigint,last_ns:bigint>>, context_batches array<bigint>"
)


@dataclass
class Progress:
    """What is known after a batch; the lists name the folders later ones need."""

    batch_id: int = -1
    newest_ns: int | None = None
    closed_tick: int | None = None
    events: int = 0
    late: int = 0
    event_batches: list[tuple[int, int, int]] = field(default_factory=list)
    alert_batches: list[tuple[int, int]] = field(default_factory=list)
    context_batches: list[int] = field(default_factory=list)


@dataclass
class LiveAlerts:
    """A stream of telemetry turned into events, verdicts and alerts under ``root``.

    ``baselines`` and ``rules`` are asked for every batch, so a new version takes
    effect with the next one.  ``now`` is the clock that suppression rules are held
    against.  After ``compact_every`` batches the context is written as one.
    """

    spark: SparkSession
    root: str
    settings: Settings
    baselines: Callable[[], DataFrame]
    rules: Callable[[], DataFrame]
    now: Column
    delay_seconds: int = 0
    safe_pids: DataFrame | None = None
    compact_every: int = 16

    def path(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def read(self, table: str, batches: list[int]) -> DataFrame:
        """Some folders of a table; ``batch_id`` is a column again."""
        paths = [self.path(table, b) for b in batches]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths)

    def table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None):
        return (
            stream.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{self.settings.score_interval_seconds} seconds"})).start()
        )

    def finish(self) -> None:
        """Score the ticks that are still open, as at shutdown."""
        last = self.table("progress").agg(F.max("batch_id")).first()[0]
        self.run(self.read("events", [last]).drop("batch_id").limit(0), last + 1, close_all=True)

    def run(self, batch: DataFrame, batch_id: int, close_all: bool = False) -> None:
        before = self._progress(batch_id - 1)
        batch.write.mode("overwrite").parquet(self.path("events", batch_id))
        after = self._advance(before, batch_id, close_all)
        self._score(before, after)
        row = (
            after.batch_id, after.newest_ns, after.closed_tick, after.events, after.late,
            after.event_batches, after.alert_batches, after.context_batches,
        )
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(self.path("progress", batch_id))

    def _progress(self, batch_id: int) -> Progress:
        if batch_id < 0:
            return Progress()
        try:
            row = self.spark.read.schema(PROGRESS).parquet(self.path("progress", batch_id)).first()
        except AnalysisException as missing:
            raise RuntimeError(f"no progress of batch {batch_id} under {self.root}") from missing
        lists = [[tuple(x) if isinstance(x, tuple) else x for x in row[c]] for c in ("event_batches", "alert_batches", "context_batches")]
        return Progress(batch_id, row.newest_ns, row.closed_tick, row.events, row.late, *lists)

    def _advance(self, before: Progress, batch_id: int, close_all: bool) -> Progress:
        """How far time moves with the stored events of a batch."""
        tick_ns = self.settings.tick_ns
        late = F.lit(False) if before.closed_tick is None else F.col("ts_ns") <= before.closed_tick * tick_ns
        n, first, last, late = (
            self.read("events", [batch_id]).agg(F.count("*"), F.min("ts_ns"), F.max("ts_ns"), F.count_if(late)).first()
        )
        newest = max((x for x in (before.newest_ns, last) if x is not None), default=None)
        closed = before.closed_tick
        if newest is not None:
            over = -(-newest // tick_ns) if close_all else (newest - self.delay_seconds * NS) // tick_ns
            closed = over if closed is None else max(closed, over)
        events = [*before.event_batches, *([(batch_id, first, last)] if n else [])]
        return Progress(batch_id, newest, closed, n, late, events, list(before.alert_batches), list(before.context_batches))

    def _due(self, before: Progress, after: Progress) -> DataFrame | None:
        """Vectors of the ticks that ended with this batch; drops what later ones cannot need."""
        st, upper = self.settings, None if after.closed_tick is None else after.closed_tick * self.settings.tick_ns
        if upper is None or after.closed_tick == before.closed_tick:
            return None
        lower = None if before.closed_tick is None else before.closed_tick * st.tick_ns - st.window_ns
        needed = [b for b, first, last in after.event_batches if first <= upper and (lower is None or last >= lower)]
        after.event_batches = [b for b in after.event_batches if b[2] >= upper - st.window_ns]
        if not needed:
            return None
        rows = self.read("events", needed).drop("batch_id").where(F.col("ts_ns") <= upper)
        if lower is not None:
            rows = rows.where(F.col("ts_ns") >= lower)
        latest = W.snapshots(rows, ENTITY, st).latest
        if before.closed_tick is not None:
            latest = latest.where(F.col("tick") > before.closed_tick)
        due = W.Snapshots(materialize(latest, "due-ticks"), ENTITY, st)
        return materialize(FE.vectors(rows, due, ENTITY, st), "due-vectors")

    def _context(self, before: Progress, entities: DataFrame | None) -> DataFrame | None:
        """The last windows of processes, from the newest folder that has them."""
        if not before.context_batches:
            return None
        known = self.read("context", before.context_batches)
        newest = known.groupBy(*ENTITY).agg(F.max("batch_id").alias("batch_id"))
        if entities is not None:
            newest = newest.join(entities, ENTITY, "left_semi")
        return known.join(newest, [*ENTITY, "batch_id"], "left_semi").drop("batch_id")

    def _score(self, before: Progress, after: Progress) -> None:
        st, due = self.settings, self._due(before, after)
        if due is None:
            return
        baselines = self.baselines()
        old = self._context(before, due.select(*ENTITY).distinct())
        windows = due if old is None else materialize(old.unionByName(due.select(*old.columns)), "windows-in-context")
        scored = SC.score_windows(windows, baselines, st, ENTITY, "tick", self.safe_pids)
        if before.closed_tick is not None:
            scored = scored.where(F.col("tick") > before.closed_tick)
        scored = materialize(scored, "due-verdicts")
        passed = FN.run_funnel(scored, self.rules(), self.now, [*ENTITY, "tick"], st, self._sent(before))
        verdicts = materialize(passed, "outcomes")
        verdicts.write.mode("overwrite").parquet(self.path("verdicts", after.batch_id))
        alerts = materialize(A.build_alerts(verdicts.where("outcome = 'sent'")), "alerts")
        alerts.write.mode("overwrite").parquet(self.path("alerts", after.batch_id))
        newest = alerts.agg(F.max("timestamp_ns")).first()[0]
        if newest is not None:
            after.alert_batches.append((after.batch_id, newest))
        horizon = max(st.dedup_seconds, st.rate_window_seconds) * NS
        after.alert_batches = [b for b in after.alert_batches if b[1] >= after.closed_tick * st.tick_ns - horizon]
        self._keep_context(before, after, windows, baselines)

    def _sent(self, before: Progress) -> DataFrame | None:
        if not before.alert_batches:
            return None
        return self.read("alerts", [b for b, _ in before.alert_batches]).select("host_id", "process_name", "pid", "timestamp_ns")

    def _keep_context(self, before: Progress, after: Progress, windows: DataFrame, baselines: DataFrame) -> None:
        """The last L windows with a baseline of the processes this batch has seen."""
        known = baselines.select("host_id", F.col("comm").alias("last_comm"))
        back = F.row_number().over(Window.partitionBy(*ENTITY).orderBy(F.desc("tick")))
        kept = (
            windows.join(known, ["host_id", "last_comm"], "left_semi")
            .withColumn("_back", back).where(F.col("_back") <= self.settings.sequence_length).drop("_back").select(*windows.columns)
        )
        after.context_batches.append(after.batch_id)
        if len(after.context_batches) > self.compact_every:
            rest = self._context(before, None).join(windows.select(*ENTITY).distinct(), ENTITY, "left_anti")
            kept = kept.unionByName(rest.select(*kept.columns))
            after.context_batches = [after.batch_id]
        kept.write.mode("overwrite").parquet(self.path("context", after.batch_id))
