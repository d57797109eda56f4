"""The log against a model in plain Python: same answers at every sequence, however the log is laid out."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.log import Batch, Conflict, Database, SnapshotTooOld
from palimpsest.operators import feed, merge, visibility

OPS = st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["put", "delete", "merge"]), st.integers(0, 9)), min_size=1, max_size=3), min_size=1, max_size=6)
SCHEMA = "k string, seq long, op_index int, kind string, v long"


def rows(commits):
    return [(k, s, i, kind, None if kind == "delete" else v) for s, ops in enumerate(commits, 1) for i, (k, kind, v) in enumerate(ops)]


def model(commits, at):
    state = {}
    for s, ops in enumerate(commits, 1):
        if s > at:
            break
        for k, (kind, v) in {k: (kind, v) for k, kind, v in ops}.items():
            if kind == "put":
                state[k] = v
            elif kind == "delete":
                state.pop(k, None)
            else:
                state[k] = state.get(k, 0) + v
    return state


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS)
def test_state_matches_model(spark, commits):
    log = spark.createDataFrame(rows(commits), SCHEMA)
    for at in (len(commits), len(commits) // 2):
        found = visibility.resolve(log.repartition(3), ["k"], {"v": merge.Sum()}, at).collect()
        assert {r.k: r.v for r in found} == model(commits, at)
        found = visibility.resolve(log.repartition(3), ["k"], {"v": merge.Sum()}, at, heavy=2).collect()
        assert {r.k: r.v for r in found} == model(commits, at)
    trimmed = visibility.trim(visibility.merges_as_puts(visibility.last_of_commit(log, ["k"]), ["k"], "v", merge.Sum().running), ["k"], len(commits) - 1)
    state = visibility.current(trimmed, ["k"]).collect()
    assert {r.k: r.v for r in state} == model(commits, len(commits))


def test_ordered_merges_keep_order_and_empty_tables(spark):
    log = spark.createDataFrame([("a", 1, 0, "put", "x"), ("a", 3, 0, "merge", "z"), ("a", 2, 0, "merge", "y"), ("b", 1, 1, "delete", None), ("b", 4, 0, "merge", "q")], "k string, seq long, op_index int, kind string, v string")
    for part in (log, log.repartition(4), log.orderBy(F.desc("seq"))):
        assert {r.k: r.v for r in visibility.resolve(part, ["k"], {"v": merge.Append()}).collect()} == {"a": "xyz", "b": "q"}
    assert visibility.resolve(log.limit(0), ["k"], {"v": merge.Append()}).count() == 0
    with pytest.raises(Exception, match="merge operator"):
        visibility.current(log, ["k"]).collect()


def test_null_handling_of_operators(spark):
    log = spark.createDataFrame([("a", 1, 0, "put", None), ("a", 2, 0, "merge", 4), ("a", 3, 0, "merge", None)], SCHEMA)
    operators = {"v": merge.FirstNonNull()}
    assert visibility.resolve(log, ["k"], operators).first().v == 4
    assert visibility.resolve(log, ["k"], {"v": merge.LastNonNull()}).first().v == 4
    assert visibility.resolve(log, ["k"], {"v": merge.Sum()}).first().v == 4


def test_database(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    db = Database(spark, f"file://{tmp_path}", {"t": schema}, {"t": ["k"]})
    with pytest.raises(ValueError):
        db.commit(Batch())
    first = db.commit(Batch().put("t", {"k": "a"}, v=1).put("t", {"k": "a"}, v=2).delete("t", {"k": "b"}))
    second = db.commit(Batch().put("t", {"k": "b"}, v=5).read("t", {"k": "a"}, first))
    with pytest.raises(Conflict):
        db.commit(Batch().put("t", {"k": "b"}, v=6).read("t", {"k": "b"}, first))
    assert {r.k: r.v for r in visibility.current(db.log("t"), ["k"]).collect()} == {"a": 2, "b": 5}
    assert {r.k: r.v for r in visibility.current(db.log("t"), ["k"], first).collect()} == {"a": 2}
    changes = feed.changes_since(db.log("t"), (first, 0)).collect()
    assert [(r.seq, r.op_index) for r in changes] == [(first, 1), (first, 2), (second, 0)]
    again = Database(spark, f"file://{tmp_path}", {"t": schema}, {"t": ["k"]})
    assert again.sequence == second
    assert db.append("t", spark.createDataFrame([("z", 9)], schema)) == second + 1
    assert db.run(lambda at, b: b.put("t", {"k": "y"}, v=1) and at)[1] == second + 2


def test_too_old_and_horizon(spark):
    log = spark.createDataFrame([("a", 5, 0, "put", 1)], SCHEMA)
    with pytest.raises(SnapshotTooOld):
        feed.changes_since(log, (2, 0), oldest=5)
    assert feed.changes_since(log, (4, 9), oldest=5).count() == 1
    assert visibility.horizon(10, None) is None and visibility.horizon(10, 3) == 8 and visibility.horizon(10, 3, 4) == 4


def test_transactions_and_compaction(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    folder, keys = f"file://{tmp_path}", {"t": ["k"], "u": ["k"]}
    db = Database(spark, folder, {"t": schema, "u": schema}, keys)
    first = db.commit(Batch().put("t", {"k": "a"}, v=1).put("u", {"k": None}, v=1))
    tx = db.begin()
    assert tx.read("t", {"k": "a"}) == {"k": "a", "v": 1} and tx.read("t", {"k": "b"}) is None
    tx.put("t", {"k": "a"}, v=2).delete("u", {"k": None})
    assert tx.read("t", {"k": "a"})["v"] == 2 and tx.scan("u").count() == 0
    other = Database(spark, folder, {"t": schema, "u": schema}, keys)
    other.append("u", spark.createDataFrame([("z", 1)], schema))
    assert tx.commit() == first + 2  # the sequence between was taken by the other writer, on keys that were not read
    late = Batch().put("t", {"k": "c"}, v=1).read("u", {"k": None}, first)
    with pytest.raises(Conflict):
        db.commit(late)
    with pytest.raises(ValueError):
        tx.put("t", {"k": "a"}, v=3).commit()
    before = [{r.k: r.v for r in visibility.current(db.log(t), ["k"]).collect()} for t in ("t", "u")]
    assert before == [{"a": 2}, {"z": 1}]
    assert db.floor("t") == 0 and db.compact() == first + 2 and db.floor("t") == first + 3
    again = Database(spark, folder, {"t": schema, "u": schema}, keys)
    assert again.sequence == first + 2 and [{r.k: r.v for r in visibility.current(again.log(t), ["k"]).collect()} for t in ("t", "u")] == before
    assert {r.k: r.v for r in visibility.current(again.log("t"), ["k"], first).collect()} == {"a": 1}
    # A commit that stops before its manifest is no commit.
    (tmp_path / "commits" / f"{first + 3:020d}.json").write_text('{"seq"')
    assert Database(spark, folder, {"t": schema, "u": schema}, keys).sequence == first + 2
    assert again.append("t", spark.createDataFrame([("d", 4)], schema)) == first + 4
