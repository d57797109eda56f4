"""Streams give what batches give, at every number of micro-batches."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import projections, visibility
from palimpsest.operators.cdc import state_transitions
from palimpsest.plans.logs import event_log
from palimpsest.streaming import feeds


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('log')}"
    rows = event_log(spark, "/root/testdata/sf0.001").where("kind <> 'merge'")
    for i in range(3):
        rows.where(f"seq > {i * 350} AND seq <= {(i + 1) * 350}").coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def stream(spark, log):
    return feeds.read_log(spark, log[0], log[1].schema, files=1)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_mirror_and_counter(spark, log, tmp_path):
    keys = ["user_id", "event_type"]
    feeds.both(stream(spark, log), f"{tmp_path}/c1", f"{tmp_path}/log", f"{tmp_path}/mirror", keys).awaitTermination()
    assert same(feeds.read_mirror(spark, f"{tmp_path}/mirror", keys).select(*log[1].columns[:2], "note"), visibility.current(log[1], keys).select(*log[1].columns[:2], "note"))
    assert spark.read.parquet(f"{tmp_path}/log").count() == log[1].count()
    feeds.mirror(stream(spark, log), f"{tmp_path}/c3", f"{tmp_path}/m2", keys).awaitTermination()
    assert feeds.read_mirror(spark, f"{tmp_path}/m2", keys).count() == visibility.current(log[1], keys).count()
    q = feeds.counter(stream(spark, log), f"{tmp_path}/c2", f"{tmp_path}/n", ["event_type"])
    q.awaitTermination()
    assert same(feeds.read_counter(spark, f"{tmp_path}/n", ["event_type"]), projections.counter(log[1], ["event_type"]))
    assert sum(p["rows"] for p in feeds.progress(q)) == log[1].count()


def test_feed_and_relay(spark, log, tmp_path):
    feeds.append_feed(stream(spark, log), f"{tmp_path}/c", f"{tmp_path}/o", F.col("kind") == "put").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == log[1].where("kind = 'put'").count()
    seen = []
    feeds.outbox_relay(stream(spark, log), f"{tmp_path}/r", lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == log[1].where("kind = 'put'").count()


def test_stateful_transitions(spark, log, tmp_path):
    high = F.coalesce(F.col("amount") > 40, F.lit(False))
    found = feeds.stateful_transitions(stream(spark, log), "user_id", "seq", high)
    q = found.writeStream.format("memory").queryName("flips").outputMode("append").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    wanted = state_transitions(log[1], ["user_id"], ["seq"], high).select(F.col("user_id").cast("string"), F.col("seq"), "transition")
    assert sorted(map(tuple, spark.sql("SELECT * FROM flips").collect())) == sorted(map(tuple, wanted.collect()))


def test_compacted_mirror(spark, log, tmp_path):
    keys = ["user_id", "event_type"]
    feeds.mirror(stream(spark, log), f"{tmp_path}/c", f"{tmp_path}/m", keys).awaitTermination()
    feeds.compact_mirror(spark, f"{tmp_path}/m", f"{tmp_path}/one", keys)
    columns = [*keys, "note", "seq"]
    assert same(feeds.read_mirror(spark, f"{tmp_path}/one", keys).select(columns), feeds.read_mirror(spark, f"{tmp_path}/m", keys).select(columns))
    assert spark.read.parquet(f"{tmp_path}/one").count() == log[1].select(keys).distinct().count()
