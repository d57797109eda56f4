"""Durable timers, outboxes, recurring schedules and run listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.log import DELETE, KIND, OP, SEQ, Database, SnapshotTooOld


def due(timers: DataFrame, now, durable: int | None = None, limit: int | None = None) -> DataFrame:
    """Timers at or before ``now``, seen at the durable sequence, in firing order."""
    found = timers if durable is None else timers.where(F.col(SEQ) <= durable)
    found = found.where(F.col("fire_at") <= F.lit(now)).orderBy("fire_at", "timer_id")
    return found if limit is None else found.limit(limit)


def cancel(timers: DataFrame, cancelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The timers left, and for each cancelled id whether there was such a timer."""
    left = timers.join(cancelled.select("timer_id"), "timer_id", "left_anti")
    known = timers.select("timer_id", F.lit(True).alias("__known")).distinct()
    return left, cancelled.join(known, "timer_id", "left").select("timer_id", F.coalesce("__known", F.lit(False)).alias("cancelled"))


def admit(due_timers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inbox rows of due timers, and the schedule rows to delete."""
    inbox = due_timers.select(F.col("timer_id").alias("message_id"), F.col("fire_at").alias("at"), F.lit("timer").alias("source"))
    return inbox, due_timers.select("timer_id", "fire_at")


def recurring(schedules: DataFrame, start: str, every: Column, until: Column) -> DataFrame:
    """All firings from ``start`` to ``until``; each follows the one before, not the clock."""
    return schedules.withColumn("fire_at", F.explode(F.sequence(F.col(start), until, every)))


def recurring_by(schedules: DataFrame, firings: Column) -> DataFrame:
    """Firings that a handler of its own gives, as an array of times over a schedule's columns."""
    return schedules.withColumn("fire_at", F.explode(firings))


def outbox_batch(outbox: DataFrame, cursor: int, durable: int, limit: int) -> DataFrame:
    found = outbox.where((F.col(SEQ) > cursor) & (F.col(SEQ) <= durable))
    return found.orderBy(SEQ, "message_id").limit(limit)


def listing(runs: DataFrame, name: str | None = None, lifecycle: str | None = None, deployment: str | None = None, target: str | None = None, after=None, size: int = 100) -> DataFrame:
    found = runs
    for column, value in (("name", name), ("lifecycle", lifecycle), ("deployment", deployment), ("target", target)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if after is not None:
        found = found.where(F.col("run_id") > F.lit(after))
    return found.orderBy("run_id").limit(size)


def depths(inbox: DataFrame, timers: DataFrame, outbox: DataFrame) -> DataFrame:
    """How many rows wait in each."""
    out = None
    for name, rows in (("inbox", inbox), ("timers", timers), ("outbox", outbox)):
        one = rows.agg(F.count("*").alias("depth")).select(F.lit(name).alias("queue"), "depth")
        out = one if out is None else out.unionByName(one)
    return out


def forensics(run_id, inbox: DataFrame, journal: DataFrame, timers: DataFrame) -> DataFrame:
    """All that is stored about one run, in time order."""
    parts = [d.where(F.col("run_id") == F.lit(run_id)).select("run_id", F.lit(n).alias("kind"), "at", "detail") for n, d in (("inbox", inbox), ("journal", journal), ("timer", timers))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("at", "kind")


def relay(db: Database, table: str, limit: int, deliver: Callable[[DataFrame], None]) -> int:
    """Deliver the oldest ``limit`` rows of an outbox table, then delete them in one commit; returns how many. A failure before the
    commit leaves them to be delivered again."""
    from palimpsest.operators.visibility import current

    keys = db.keys[table]
    waiting = current(db.log(table), keys).orderBy(SEQ, *keys).limit(limit)
    n = waiting.count()
    if n:
        deliver(waiting)
        db.append_all({table: waiting.select(*keys).withColumns({OP: F.lit(0), KIND: F.lit(DELETE)})})
    return n


def start_cursor(policy: str, durable: int, checkpoint: int | None = None, oldest: int = 0) -> int:
    """Where a source is admitted from: ``beginning``, ``current`` (the durable sequence) or ``checkpoint``. A checkpoint that is gone is an error,
    unless ``fast_forward`` takes the oldest commit left, or ``replay`` the beginning."""
    if policy == "beginning":
        return 0
    if policy == "current":
        return durable
    if policy in ("checkpoint", "fast_forward", "replay"):
        if checkpoint is None:
            return 0
        if checkpoint + 1 >= oldest:
            return checkpoint
        if policy == "checkpoint":
            raise SnapshotTooOld(checkpoint, oldest)
        return oldest - 1 if policy == "fast_forward" else 0
    raise ValueError(f"unknown policy {policy}")


def admitted(page: DataFrame, run_id: Column, before: DataFrame | None = None) -> DataFrame:
    """A page of a source's durable feed as inbox rows: ``run_id, nth`` and the page's columns. A run's rows are numbered in feed order, above the
    ``inbox`` (run_id, nth) that it has already; rows routed to no run are left out."""
    routed = page.withColumn("run_id", run_id).where("run_id IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(SEQ, OP)).cast("long")
    if before is None:
        return routed.withColumn("nth", nth)
    last = before.groupBy("run_id").agg(F.max("nth").alias("__last"))
    return routed.join(last, "run_id", "left").withColumn("nth", nth + F.coalesce("__last", F.lit(0))).drop("__last")


def step(triggers: DataFrame, state: DataFrame, next_state: Column, messages: Column, timers: Column) -> dict[str, DataFrame]:
    """One step of every run with a trigger: its new ``state``, the ``outbox`` messages (an array) and the ``timers`` (an array of times) that
    the handler's expressions over trigger and state columns give."""
    both = triggers.join(state, "run_id", "left")
    return {
        "state": both.select("run_id", next_state.alias("state")),
        "outbox": both.select("run_id", F.posexplode(messages).alias("nth", "message")),
        "timers": both.select("run_id", F.explode(timers).alias("fire_at")),
    }


def describe(runs: DataFrame, journal: DataFrame, inbox: DataFrame, timers: DataFrame) -> DataFrame:
    """Each run with its last step and what waits for it: ``steps, last_at, waiting, due``."""
    out = runs
    for rows, counts in (
        (journal, [F.count("*").alias("steps"), F.max("at").alias("last_at")]), (inbox, [F.count("*").alias("waiting")]), (timers, [F.count("*").alias("due")]),
    ):
        out = out.join(rows.groupBy("run_id").agg(*counts), "run_id", "left")
    return out.fillna(0, ["steps", "waiting", "due"])


def history(journal: DataFrame, run_id, after=None, size: int = 100) -> DataFrame:
    """A page of one run's steps, in order."""
    found = journal.where(F.col("run_id") == F.lit(run_id))
    if after is not None:
        found = found.where(F.col("at") > F.lit(after))
    return found.orderBy("at").limit(size)


#: What each target of a run query shows.
_TARGETS = {"state": ("run_id", "state"), "visibility": ("run_id", "lifecycle", "deployment"), "execution": ("run_id", "lifecycle", "steps")}


def run_query(runs: DataFrame, target: str, run_id=None, closed: tuple[str, ...] = ()) -> DataFrame:
    """A run query's answer with ``accepted``: a run in a ``closed`` lifecycle is rejected, and its columns are NULL."""
    if target not in _TARGETS:
        raise ValueError(f"unknown target {target}")
    found = runs if run_id is None else runs.where(F.col("run_id") == F.lit(run_id))
    accepted = ~F.col("lifecycle").isin(list(closed))
    shown = [F.col(c) if c == "run_id" else F.when(accepted, F.col(c)).alias(c) for c in _TARGETS[target]]
    return found.select(*shown, accepted.alias("accepted"))
