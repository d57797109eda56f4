"""Projections: materialized views as queries over logs and current states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.log import SEQ
from palimpsest.operators import visibility


def secondary_index(state: DataFrame, by: str, row_id: list[str]) -> DataFrame:
    return state.where(F.col(by).isNotNull()).select(F.col(by).alias("lookup"), *row_id)


def counter(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"))


def ranked(state: DataFrame, rank: str, tie: str, key: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by rank descending, then tie and key ascending, with their position.

    The limit is taken before the numbering, so only ``n`` rows ever meet in one task.
    """
    order = [F.desc(rank), F.asc(tie), *[F.asc(k) for k in key]]
    return state.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def ranked_by(state: DataFrame, rank: Column, tie: Column, key: Column, n: int, **encoded: Column) -> DataFrame:
    """As ``ranked``, with the rank, the tie, the output key and what is stored given as expressions: ``key``, the encoded columns, ``position``."""
    rows = state.select(rank.alias("__rank"), tie.alias("__tie"), key.alias("key"), *[c.alias(name) for name, c in encoded.items()])
    return ranked(rows, "__rank", "__tie", ["key"], n).select("key", *encoded, "position")


def fan_out(log: DataFrame, handler, key: list[str]) -> DataFrame:
    """A handler that makes many writes of one row: ``handler`` gives an array of structs, each a row of the output, of which ``key`` is
    the key. The last write of a commit to an output key stands."""
    rows = log.select("seq", "op_index", F.posexplode(handler).alias("__nth", "__write"))
    rows = rows.select("seq", "op_index", "__nth", "__write.*")
    rest = [c for c in rows.columns if c not in (*key, "seq", "op_index", "__nth")]
    last = rows.groupBy(*key, "seq").agg(F.max_by(F.struct(*rest), F.struct("op_index", "__nth")).alias("__last"))
    return last.select(*key, "seq", *[F.col(f"__last.{c}").alias(c) for c in rest])


def unique_output(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows``, failing on a repeated output key."""
    n = F.count("*").over(Window.partitionBy(*key))
    fail = F.raise_error(F.lit("duplicate output key")).cast("boolean")
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, fail).otherwise(F.lit(True))).drop("__n")


def frontier_lookup(source: DataFrame, log: DataFrame, keys: list[str], on: list[str], frontier: int | None) -> DataFrame:
    """Rows of a source with another table's state at that table's frontier, not its newest one."""
    if frontier is None:
        raise ValueError("the other table has no frontier")
    state = visibility.current(log, keys, frontier)
    return source.join(state.withColumnRenamed(SEQ, "state_seq"), on, "left")


def as_of_lookup(source: DataFrame, log: DataFrame, on: list[str], at: str, values: list[str]) -> DataFrame:
    """Each row of ``source`` with the newest row of ``log`` at or before its own ``at``.

    Both sides are merged in one sort by key and time, and the last log row is carried forward, so the work does not grow with the pairs of rows that share a key.
    """
    right = log.select(*on, F.col(SEQ).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(SEQ).alias("seq"), *values).alias("__right"))
    left_values = [c for c in source.columns if c not in on]
    left = source.select(*on, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left_values).alias("__left"))
    both = right.unionByName(left, allowMissingColumns=True)
    frame = Window.partitionBy(*on).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(frame)).where("__side = 1")
    return found.select(*on, *[F.col(f"__left.{c}").alias(c) for c in left_values], F.col("__found.seq").alias("found_seq"), *[F.col(f"__found.{v}").alias(v) for v in values])


def expand(source: DataFrame, membership: DataFrame, on: str, row_id: str) -> DataFrame:
    """Grants (``lookup_key``, ``row_id``): every row for every key that its group admits."""
    return source.join(membership, on).select("lookup_key", F.col(row_id).alias("row_id")).distinct()


def folded(source: DataFrame, fold, expand_) -> DataFrame:
    """A visibility index from two functions over DataFrames: ``fold`` makes the members from the source, ``expand_`` their grants
    (lookup_key, row_id, mirror); equal grants are one."""
    return canonical(expand_(fold(source)), "mirror")


def canonical(grants: DataFrame, mirror: str) -> DataFrame:
    """One row a grant; equal duplicates merge, duplicates with different mirrors fail."""
    fail = F.raise_error(F.lit("conflicting mirrors of a grant")).cast("string")
    both = grants.groupBy("lookup_key", "row_id").agg(F.min(mirror).alias(mirror), F.max(mirror).alias("__max"))
    return both.withColumn(mirror, F.when(F.col(mirror).eqNullSafe(F.col("__max")), F.col(mirror)).otherwise(fail)).drop("__max")


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """What a view must write: ``change`` is added, removed or changed; equal rows do not appear."""
    old = before.withColumn("__old", F.lit(True))
    new = after.withColumn("__new", F.lit(True))
    if value:
        old, new = old.withColumnRenamed(value, "__before"), new.withColumnRenamed(value, "__after")
    both = old.join(new, keys, "full_outer")
    same = F.col("__before").eqNullSafe(F.col("__after")) if value else F.lit(True)
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "changed")
    out = both.withColumn("change", change).where("change IS NOT NULL")
    extra = [F.col("__before").alias("before"), F.col("__after").alias("after")] if value else []
    return out.select(*keys, *extra, "change")


def scan_visible(index: DataFrame, lookup_keys: list[str]) -> DataFrame:
    return index.where(F.col("lookup_key").isin(lookup_keys)).select("row_id").distinct()


def lookup_keys(context: dict, by: str) -> list[str]:
    """The keys of a subject, a tenant, or its distinct groups in order, without empty ones."""
    if by == "groups":
        return sorted({g for g in context.get("groups", []) if g})
    return [context[by]] if context.get(by) else []


def apply_dag(sources: dict[str, DataFrame], stages: list[tuple[str, list[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Projections over projections: (name, inputs, function) in any order. A cycle, or an unknown input, is an error."""
    done, left = dict(sources), list(stages)
    while left:
        ready = [s for s in left if all(i in done for i in s[1])]
        if not ready:
            raise ValueError(f"cycle or unknown input among {[s[0] for s in left]}")
        for name, inputs, f in ready:
            done[name] = f(*[done[i] for i in inputs])
        left = [s for s in left if s[0] not in done]
    return done


def schedule(runs: DataFrame) -> DataFrame:
    """The order in which ready runs are applied: by sequence, then by the source's declaration."""
    return runs.orderBy("seq", "source_index")


def rebuild(state: DataFrame, seq: int) -> DataFrame:
    """A projection's input when its cursor is too old: the current rows as puts of one sequence."""
    from palimpsest.log import from_rows

    return from_rows(state, seq)


def bucket_counts(events: DataFrame, by: list[str], ts: str, width: str) -> DataFrame:
    return events.groupBy(*by, F.window(ts, width).start.alias("bucket")).agg(F.count("*").alias("n"))


def moving_total(events: DataFrame, by: list[str], ts: str, value: Column, seconds: int) -> DataFrame:
    """Each event with the total of its last ``seconds``, itself and its contemporaries included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(*by).orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("__t", micros).withColumn("total", F.sum(value).over(frame)).drop("__t")


def crossings(totals: DataFrame, by: list[str], order: list[str], threshold) -> DataFrame:
    """Events at which the total reaches the threshold or falls below it again."""
    from palimpsest.operators.cdc import state_transitions

    return state_transitions(totals, by, order, F.col("total") >= F.lit(threshold))


def window_summary(rows: DataFrame, ts: str, start, end, value: str, alert: Column) -> DataFrame:
    """Count, alerts, least, greatest and mean over ``start <= ts < end``; NULL statistics if empty."""
    inside = rows.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    return inside.agg(F.count("*").alias("n"), F.count_if(alert).alias("alerts"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each entity, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in by]
    head = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("head"))
    return head.select(*by, *[F.col(f"head.{c}").alias(c) for c in rest])
