"""Projections that follow tables commit by commit.

A projection reads the commits of its sources above its frontier (a sequence for each source), hands whole commits to its handler, and publishes the
handler's rows and the new frontier by one commit of the output database. So outputs and cursor never part, a commit is
never split, and a run that is repeated starts from what was published.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.log import DELETE, KIND, OP, PUT, SEQ, Database, SnapshotTooOld, from_rows

FRONTIERS = "frontiers"
FRONTIER_SCHEMA = T.StructType([T.StructField("projection", T.StringType()), T.StructField("source", T.StringType()), T.StructField("frontier", T.LongType())])


def runs(log: DataFrame, after: int = 0) -> DataFrame:
    """The sequence runs of a log above a cursor: ``seq, rows, first, last``, a row a commit."""
    return log.where(F.col(SEQ) > after).groupBy(SEQ).agg(F.count("*").alias("rows"), F.min(OP).alias("first"), F.max(OP).alias("last"))


def scheduled(sources: list[DataFrame], frontiers: list[int], limit: int) -> DataFrame:
    """The next ``limit`` runs of several sources: by sequence, then by the order in which the sources are declared. ``seq, source_index, rows``."""
    out = None
    for i, (log, frontier) in enumerate(zip(sources, frontiers)):
        one = runs(log, frontier).select(SEQ, F.lit(i).alias("source_index"), "rows")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(SEQ, "source_index").limit(limit)


@dataclass
class Projection:
    """``handler`` takes a log of whole commits for each source and gives rows (with ``op_index`` and ``kind``) for each output table.

    ``recompute`` is what happens when a source no longer has the commits above the frontier: ``fail``, or ``rebuild``, which clears
    the outputs and replays the sources' current rows as puts of one sequence.
    """

    name: str
    sources: dict[str, Database]
    output: Database
    handler: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    recompute: str = "fail"
    tables: list[str] = field(default_factory=list)

    def frontier(self) -> dict[str, int]:
        """The sequence of each source up to which the published outputs go."""
        from palimpsest.operators.visibility import current

        rows = current(self.output.log(FRONTIERS).where(F.col("projection") == self.name), ["projection", "source"])
        return {s: 0 for s in self.sources} | {r.source: r.frontier for r in rows.collect()}

    def _publish(self, rows: dict[str, DataFrame], frontier: dict[str, int]) -> int:
        spark = self.output.spark
        cursor = spark.createDataFrame([(self.name, s, n) for s, n in frontier.items()], FRONTIER_SCHEMA).coalesce(1)
        return self.output.append_all(rows | {FRONTIERS: cursor.withColumns({OP: F.lit(0), KIND: F.lit(PUT)})})

    def step(self, commits: int | None = None) -> bool:
        """Apply the next commits, at most so many sequences, and publish; false if there is none."""
        at = self.frontier()
        ends = {s: db.refresh() for s, db in self.sources.items()}
        if not any(ends[s] > at[s] for s in at):
            return False
        for source, db in self.sources.items():
            if at[source] + 1 < db.floor(source) and ends[source] > at[source]:
                if self.recompute == "fail":
                    raise SnapshotTooOld(at[source], db.floor(source))
                self.rebuild(ends)
                return True
        # A bound over all sources together keeps sequences in order across them.
        bound = None if commits is None else min(at.values()) + commits
        upto = {s: ends[s] if bound is None else max(at[s], min(ends[s], bound)) for s in at}
        self._publish(self.handler({s: db.log(s, at[s], upto[s]) for s, db in self.sources.items()}), upto)
        return True

    def rebuild(self, ends: dict[str, int]) -> None:
        """Clear the outputs and project the sources' current rows, in one commit."""
        from palimpsest.operators.visibility import current

        states = {s: from_rows(current(db.log(s, upto=ends[s]), db.keys[s]).drop(SEQ), ends[s]) for s, db in self.sources.items()}
        rows = self.handler(states)
        for table in self.tables or list(rows):
            old = current(self.output.log(table), self.output.keys[table]).select(*self.output.keys[table])
            gone = old.withColumns({OP: F.lit(-1), KIND: F.lit(DELETE)})
            rows[table] = rows[table].unionByName(gone, allowMissingColumns=True) if table in rows else gone
        self._publish(rows, ends)

    def run(self, commits: int | None = None) -> dict[str, int]:
        """Steps until nothing is left; returns the frontier."""
        while self.step(commits):
            pass
        return self.frontier()


def reached(dependencies: dict[str, list[str]], frontiers: dict[str, dict[str, int]], target: str, wanted: dict[str, int]) -> list[str]:
    """The projections that ``target`` must still wait for until it covers ``wanted`` (a sequence for each table): itself and those that it reads,
    in the order in which they must run. A cycle is an error, and so is a table that none of them reads."""
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 1:
            raise ValueError(f"a cycle through {name}")
        if name in state:
            return
        state[name] = 1
        for other in dependencies.get(name, []):
            visit(other)
        state[name] = 2
        order.append(name)

    visit(target)
    unread = [t for t in wanted if not any(t in frontiers.get(p, {}) for p in order)]
    if unread:
        raise ValueError(f"{target} does not follow {unread}")
    return [p for p in order if any(frontiers.get(p, {}).get(t, wanted[t]) < n for t, n in wanted.items())]
