"""Alert funnel: threshold, suppression, deduplication, rate limit.

The first two steps look at one verdict and are plain expressions.  The other
two depend on which alerts of the host were sent before, so the verdicts of a
host are walked in time order.  Nothing is remembered longer than the longer of
the two horizons, so a host's verdicts fall into stretches, separated by at least
one empty cell of that length, that know nothing of each other and are walked in
parallel, each once.  A walk streams over sorted narrow rows and holds only what
can still matter, however long its stretch is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostlens.config import NS, Settings
from hostlens.sources.store import materialize, rule_is_active


def suppressed_by_rule(verdicts: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Adds ``is_suppressed``: an active rule of the process lies above the score.

    Rules are per process name; the rule table goes through an ordinary join
    that adaptive execution broadcasts when it is measured to be small.
    """
    active = rules.where(rule_is_active(now)).select("process_name", "max_score_suppress")
    return (
        verdicts.join(active, "process_name", "left")
        .withColumn(
            "is_suppressed",
            F.coalesce(F.col("final_score") < F.col("max_score_suppress"), F.lit(False)),
        )
        .drop("max_score_suppress")
    )


def first_steps(settings: Settings) -> Column:
    """Outcome of the two stateless steps; null for verdicts that go on."""
    return F.when(F.col("final_score") < settings.high, "below_threshold").when(
        F.col("is_suppressed"), "suppressed"
    )


class Quota:
    """What one host has sent that still matters, at a moment that only moves on.

    ``quiet`` says until when a process is a duplicate; ``slots`` until when each
    alert counts towards the limit of the host.
    """

    def __init__(self, settings: Settings, quiet: dict[str, int] | None = None, slots: Iterable[int] = ()):
        self.dedup_ns = settings.dedup_seconds * NS
        self.rate_ns = settings.rate_window_seconds * NS
        self.limit = settings.max_alerts_per_window
        self.quiet = dict(quiet or {})
        self.ends = deque(sorted(((end, process) for process, end in self.quiet.items()), key=lambda x: x[0]))
        self.slots = deque(slots)

    def advance(self, ts: int) -> None:
        """Forget what ends before ``ts``."""
        while self.ends and self.ends[0][0] <= ts:
            end, process = self.ends.popleft()
            if self.quiet.get(process) == end:
                del self.quiet[process]
        while self.slots and self.slots[0] < ts:
            self.slots.popleft()

    def decide(self, process: str, ts: int) -> str:
        self.advance(ts)
        if process in self.quiet:
            return "deduped"
        if len(self.slots) >= self.limit:
            return "rate_limited"
        self.send(process, ts)
        return "sent"

    def send(self, process: str, ts: int) -> None:
        """Take an alert into account, whoever decided to send it."""
        if self.dedup_ns > 0:
            self.quiet[process] = ts + self.dedup_ns
            self.ends.append((ts + self.dedup_ns, process))
        self.slots.append(ts + self.rate_ns)


ORDER = ["timestamp_ns", "process_name", "pid"]


def _walker(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, quota = None, Quota(settings)
        for batch in batches:
            stretches = zip(batch["host_id"].astype("Int64"), batch["_stretch"])
            outcomes = []
            rows = zip(stretches, batch["timestamp_ns"], batch["process_name"], batch["_earlier"])
            for (host, stretch), ts, process, earlier in rows:
                here = (None if pd.isna(host) else host, stretch)
                if at != here:
                    at, quota = here, Quota(settings)
                if earlier:
                    quota.advance(ts)
                    quota.send(process, ts)
                outcomes.append(None if earlier else quota.decide(process, ts))
            yield batch.assign(outcome=outcomes)

    return run


def stretches(survivors: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``_stretch``, a number per host that grows where nothing lies in a whole
    cell of the longer horizon.  Only occupied cells are put in order per host."""
    cell = max(settings.dedup_seconds, settings.rate_window_seconds) * NS + 1
    placed = survivors.withColumn("_cell", F.expr(f"timestamp_ns div {cell}L"))
    occupied = Window.partitionBy("_host").orderBy("_at")
    gap = F.col("_at") - F.lag("_at").over(occupied) > 1
    cells = (
        placed.select(F.col("host_id").alias("_host"), F.col("_cell").alias("_at")).distinct()
        .withColumn("_new", F.coalesce(gap, F.lit(False)).cast("long"))
        .withColumn("_stretch", F.sum("_new").over(occupied)).drop("_new")
    )
    same = F.col("host_id").eqNullSafe(F.col("_host")) & F.col("_cell").eqNullSafe(F.col("_at"))
    return placed.join(cells, same).drop("_host", "_at", "_cell")


def walk(survivors: DataFrame, row_key: list[str], settings: Settings, sent: DataFrame | None = None) -> DataFrame:
    """Outcome ``sent``, ``deduped`` or ``rate_limited`` of each survivor.

    Verdicts of a host are taken in order of time, process name and pid.  Each
    row is moved to the walk of its stretch once; ``survivors`` is read twice.
    ``sent`` (host_id, process_name, pid, timestamp_ns) are alerts decided before,
    none later than a survivor of its host: all that a walk has to know of the past
    are those of the longer horizon.
    """
    columns = list(dict.fromkeys(["host_id", *ORDER, *row_key]))
    narrow = survivors.select(*columns, F.lit(False).alias("_earlier"))
    if sent is not None:
        blank = [F.lit(None).cast(survivors.schema[c].dataType).alias(c) for c in columns if c not in ("host_id", *ORDER)]
        narrow = narrow.unionByName(sent.select("host_id", *ORDER, *blank, F.lit(True).alias("_earlier")))
    rows = stretches(narrow, settings)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", outcome string"
    placed = rows.repartition("host_id", "_stretch").sortWithinPartitions("host_id", "_stretch", *ORDER)
    return placed.mapInPandas(_walker(settings), schema).where("NOT _earlier").drop("_stretch", "_earlier")


def run_funnel(
    verdicts: DataFrame, rules: DataFrame, now: Column, row_key: list[str], settings: Settings, sent: DataFrame | None = None
) -> DataFrame:
    """All verdicts with their ``outcome``: below_threshold, suppressed,
    deduped, rate_limited or sent.  ``sent`` as in ``walk``."""
    staged = suppressed_by_rule(verdicts, rules, now).withColumn("outcome", first_steps(settings)).drop("is_suppressed")
    survivors = materialize(staged.where(F.col("outcome").isNull()).drop("outcome"), "funnel-survivors")
    walked = walk(survivors, row_key, settings, sent).select(*row_key, "outcome")
    return staged.where(F.col("outcome").isNotNull()).unionByName(survivors.join(walked, row_key))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("host_id", "outcome").agg(F.count("*").alias("n"))
