"""Current-state retention: thresholds, global ranks, and what a policy reclaims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("fail", "exclude", "lowest", "highest")


def threshold(primary: Column, cutoff, ascending: bool = True, missing: str = "fail") -> Column:
    """Whether a row is retained: at or above the cutoff if ascending, else at or below. For a missing value ``exclude`` retains,
    ``lowest`` retains in descending order only, ``highest`` in ascending order only, ``fail`` raises."""
    keeps = primary >= F.lit(cutoff) if ascending else primary <= F.lit(cutoff)
    without = {
        "fail": F.raise_error(F.lit("a row has no sort key")).cast("boolean"),
        "exclude": F.lit(True), "lowest": F.lit(not ascending), "highest": F.lit(ascending),
    }[missing]
    return F.when(primary.isNull(), without).otherwise(keeps)


def _rank_order(primary: str, tie: str, key: str, ascending: bool, missing: str) -> list[Column]:
    # A missing value is placed in natural order, which a descending rank then reverses.
    if ascending:
        first = F.asc_nulls_first(primary) if missing == "lowest" else F.asc_nulls_last(primary)
    else:
        first = F.desc_nulls_last(primary) if missing == "lowest" else F.desc_nulls_first(primary)
    return [first, F.asc_nulls_first(tie), F.asc(key)]


def rank_retained(rows: DataFrame, primary: str, tie: str, key: str, limit: int, ascending: bool = False, missing: str = "fail") -> DataFrame:
    """The first ``limit`` rows by primary (either way), tie and key (ascending): a top-N, not a global sort."""
    if missing == "exclude":
        rows = rows.where(F.col(primary).isNotNull())
    elif missing == "fail":
        fail = F.raise_error(F.lit("a row has no sort key")).cast("boolean")
        rows = rows.where(F.when(F.col(primary).isNull(), fail).otherwise(F.lit(True)))
    return rows.orderBy(*_rank_order(primary, tie, key, ascending, missing)).limit(limit)


def boundary(retained: DataFrame, primary: str, tie: str, key: str, ascending: bool = False, missing: str = "fail") -> DataFrame:
    """The last retained row."""
    position = F.row_number().over(Window.orderBy(*_rank_order(primary, tie, key, ascending, missing)))
    return retained.withColumn("__p", position).orderBy(F.desc("__p")).limit(1).drop("__p")


def churn(published: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """Keys that entered and keys that left the retained set."""
    entered = retained.select(key).join(published.select(key), key, "left_anti").withColumn("churn", F.lit("entered"))
    exited = published.select(key).join(retained.select(key), key, "left_anti").withColumn("churn", F.lit("exited"))
    return entered.unionByName(exited)


def classify(rows: DataFrame, retained: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``state``: retained, deferred (a snapshot pins it) or reclaimable."""
    marked = rows.join(retained.select(key, F.lit(True).alias("__kept")), key, "left").join(pinned.select(key, F.lit(True).alias("__pinned")).distinct(), key, "left")
    state = F.when(F.col("__kept"), "retained").when(F.col("__pinned"), "deferred").otherwise("reclaimable")
    return marked.withColumn("state", state).drop("__kept", "__pinned")


def stats(classified: DataFrame, size: str) -> DataFrame:
    return classified.groupBy("state").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def recent_slots(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with the slot each is written to."""
    return rows.orderBy(*order).limit(n).withColumn("slot", F.row_number().over(Window.orderBy(*order)) - 1)


def garbage(listed: DataFrame, live: DataFrame, tracked: DataFrame, pinned: DataFrame, key: str, age: Column, grace: int, budget: int | None = None) -> DataFrame:
    """Objects by what holds them: reference, snapshot, grace, or nothing (orphan; at most ``budget`` of them are due for
    deletion now, the oldest keys first)."""
    out = listed.withColumn("__young", age < F.lit(grace))
    for name, keys in (("live", live), ("tracked", tracked), ("pinned", pinned)):
        out = out.join(keys.select(key, F.lit(True).alias(f"__{name}")).distinct(), key, "left")
    state = (
        F.when(F.col("__live"), "referenced").when(F.col("__pinned"), "snapshot").when(F.col("__young"), "grace").when(F.col("__tracked"), "tracked").otherwise("orphan")
    )
    out = out.withColumn("state", state).drop("__live", "__tracked", "__pinned", "__young")
    if budget is None:
        return out.withColumn("due", F.col("state") == "orphan")
    due = out.where("state = 'orphan'").orderBy(key).limit(budget).select(key, F.lit(True).alias("due"))
    return out.join(due, key, "left").withColumn("due", F.coalesce("due", F.lit(False)))
