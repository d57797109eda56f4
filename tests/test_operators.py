import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import cdc, policy, projections, retention, scan, search, workflow
from palimpsest.sources import formats, kafka
from palimpsest.spec import FieldSpec, SpecError, TableSpec

SPEC = TableSpec("t", ("k",), (FieldSpec(1, "k", "string", False), FieldSpec(2, "n", "int64"), FieldSpec(3, "ok", "bool"), FieldSpec(4, "x", "float64")))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("a", 1, True, 0.5), ("ab", None, None, float("nan")), ("b", 3, False, None), ("é", 4, True, 1.0)], "k string, n long, ok boolean, x double")


def keys(df):
    return [r.k for r in df.collect()]


def test_scan(table):
    p = scan.Predicate
    assert keys(scan.scan(table, ["k"], "a", "b")) == ["a", "ab"]
    assert keys(scan.scan(table, ["k"], options=scan.ScanOptions(reverse=True, limit=2))) == ["é", "b"]
    assert keys(scan.scan(table, ["k"], options=scan.ScanOptions(limit=0))) == []
    assert keys(scan.scan_prefix(table, ["k"], "a")) == ["a", "ab"]
    one = scan.ScanOptions(("n", "n"), p("all", parts=(p("true"), p("at_least", "n", 3))), limit=1)
    assert scan.scan(table, ["k"], options=one, spec=SPEC).columns == ["k", "n"] and keys(scan.scan(table, ["k"], options=one, spec=SPEC)) == ["b"]
    for clause, wanted in ((p("equals", "n", None), ["ab"]), (p("equals", "x", float("nan")), []), (p("is", "ok", True), ["a", "é"])):
        assert keys(scan.scan(table, ["k"], options=scan.ScanOptions(predicate=clause), spec=SPEC)) == wanted
    for bad in (p("equals", "zz", 1), p("at_least", "x", 1), p("equals", "k", None), p("is", "ok", 1), p("equals", "n", "1")):
        with pytest.raises(SpecError):
            scan.scan(table, ["k"], options=scan.ScanOptions(predicate=bad), spec=SPEC)
    with pytest.raises(SpecError):
        scan.scan(table, ["k"], options=scan.ScanOptions(predicate=p("is", "ok", True)))
    with pytest.raises(SpecError):
        scan.scan(table, ["k"], options=scan.ScanOptions(columns=("zz",)), spec=SPEC)
    assert scan.prefix_end(b"a\xff") == b"b" and scan.prefix_end(b"\xff") is None


def test_paging_and_report(spark, table, tmp_path):
    page, cursor = scan.keyset_page(table, "k", None, 4)
    assert page.count() == 4 and cursor.first().next_cursor is None
    assert scan.keyset_page(table, "k", None, 2)[1].first().next_cursor == "ab"
    table.write.parquet(f"{tmp_path}/t")
    report = scan.execution_report(spark.read.parquet(f"{tmp_path}/t").where("n >= 3"))
    assert report["rows"] == 2 and any("GreaterThanOrEqual(n,3)" in x for x in report["pushed"])


def test_ranks_and_thresholds(spark):
    storm = spark.createDataFrame([("050", "002", "delta"), ("050", "001", "alpha"), ("050", "001", "aardvark"), ("040", "003", "bravo"), (None, "000", "zero")], "p string, t string, k string")
    order = lambda **o: [r.k for r in retention.rank_retained(storm, "p", "t", "k", 9, **o).collect()]
    assert order(missing="exclude") == ["aardvark", "alpha", "delta", "bravo"]
    assert order(missing="lowest")[-1] == "zero" and order(missing="highest")[0] == "zero"
    assert order(missing="lowest", ascending=True)[0] == "zero" and order(missing="highest", ascending=True)[-1] == "zero"
    with pytest.raises(Exception, match="sort key"):
        order()
    rows = spark.createDataFrame([(90,), (120,), (180,), (None,)], "v long")
    for ascending, missing, wanted in ((True, "exclude", 3), (True, "lowest", 2), (True, "highest", 3), (False, "lowest", 2), (False, "highest", 1)):
        assert rows.where(retention.threshold(F.col("v"), 100, ascending, missing)).count() == wanted
    with pytest.raises(Exception, match="sort key"):
        rows.where(retention.threshold(F.col("v"), 100)).collect()


def test_cdc_rules(spark):
    raw = spark.createDataFrame([
        (1, '{"op":"c","after":{"id":"1","status":"open"},"source":{"db":"d","schema":"s","table":"o"}}', "x.d.s.o"), (2, None, "x.d.s.o"), (3, '{"op":"c"}', "x.d.s.o"),
        (4, '{"op":"d","after":{"id":"1"}}', "x"), (5, '{"op":"z"}', "x"), (6, '{"op":"u","before":{"id":"1","status":"open"},"after":{"id":"1","status":"done"},"source":{"snapshot":"last"}}', "y"),
    ], "n int, value string, topic string")
    events = cdc.check_topic(cdc.decode(raw, "id string, status string"))
    assert [r.error for r in events.orderBy("n").collect()] == [None, None, "after image missing", "delete with an after image", "unknown operation", "topic does not match its table"]
    is_open = cdc.RowPredicate("column", "status", "open")
    not_open = cdc.RowPredicate("not", parts=(is_open,))
    marked = cdc.membership(events.where("n IN (1, 6)"), not_open).orderBy("n").collect()
    assert [(r.was_in, r.is_in) for r in marked] == [(False, False), (False, True)]
    assert [r.transition for r in cdc.transitions(events.where("n IN (1, 6)"), is_open).orderBy("n").collect()] == ["entered", "exited"]
    assert [r.kind for r in cdc.mirror_changes(events.where("n IN (1, 2, 6)"), is_open).orderBy("n").collect()] == ["put", "delete"]
    assert events.select(cdc.snapshot_phase(F.col("snapshot")).alias("p")).where("p = 'last'").count() == 1
    assert events.where(cdc.admits("derived")).count() == 0 and set(cdc.materialize(events, is_open)) == {"log", "mirror"}
    with pytest.raises(ValueError):
        cdc.materialize(events, is_open, "other")


def test_policies(spark):
    rows = spark.createDataFrame([("t1/a", "x"), ("t2/b", None)], "id string, owner string")
    rule = policy.Policy("prefix", "{tenant}/")
    assert rule.visible(rows, {"tenant": "t1"}, "id").count() == 1
    assert rows.select(rule.key(F.lit("k"), {"tenant": "t1"}).alias("k")).first().k == "t1/k"
    clause = policy.Clause("context", "owner", "user")
    assert policy.audit(rows, clause.on(scalar.json_row(rows), {"user": "x"})).first().asDict() == {"scanned": 2, "returned": 1, "filtered": 1}
    assert policy.Policy("procedure").visible(rows, {}, "id").count() == 0
    for kind, shape in (("prefix", "aggregate"), ("index", "write"), ("procedure", "point"), ("predicate", "multi_table")):
        with pytest.raises(policy.Denied):
            policy.Policy(kind).check(shape)
    assert projections.lookup_keys({"groups": ["b", "", "a", "b"]}, "groups") == ["a", "b"]


def test_search():
    assert search.chunk("é" * 130, 256) == ["é" * 128, "é" * 2] and search.chunk("") == []
    with pytest.raises(ValueError):
        search.chunk("€", 2)


def test_search_over_tables(spark):
    docs = spark.createDataFrame([(1, "Foo-bar9 éa Foo"), (2, None), (3, "")], "id long, text string")
    index = search.postings(docs, ["id"], "text")
    assert sorted(r.term for r in index.collect()) == ["a", "bar9", "foo"]
    assert search.matches_all(index, ["id"], ["foo", "a"]).count() == 1 and search.matches_all(index, ["id"], [], docs).count() == 3
    parts = search.chunks(docs, "id", "text")
    assert search.snippets(parts, "id", ["foo", "bar9"]).first().snippet == "Foo-bar9 éa Foo"
    assert scalar.render("{a}-{b}", {"a": 1, "b": 2}) == "1-2"


def test_projections(spark):
    a = spark.createDataFrame([("g", 1, "x"), ("g", 1, "x")], "lookup_key string, row_id long, m string")
    assert projections.canonical(a, "m").count() == 1
    with pytest.raises(Exception, match="conflicting"):
        projections.canonical(a.unionByName(a.withColumn("m", F.lit("y"))), "m").collect()
    with pytest.raises(Exception, match="duplicate"):
        projections.unique_output(a, ["row_id"]).collect()
    with pytest.raises(ValueError):
        projections.apply_dag({}, [("x", ["y"], None), ("y", ["x"], None)])
    with pytest.raises(ValueError):
        projections.frontier_lookup(a, a, ["row_id"], ["row_id"], None)
    empty = projections.window_summary(spark.createDataFrame([], "ts long, v double"), "ts", 0, 9, "v", F.col("v") > 1).first()
    assert (empty.n, empty.alerts, empty.least, empty.mean) == (0, 0, None, None)


def test_workflow(spark):
    t = datetime.datetime(2024, 1, 1)
    timers = spark.createDataFrame([(1, t, 1), (2, t, 9)], "timer_id long, fire_at timestamp, seq long")
    assert workflow.due(timers, t, durable=5).count() == 1
    inbox, gone = workflow.admit(workflow.due(timers, t))
    assert inbox.count() == gone.count() == 2
    log = spark.createDataFrame([(1, t, "x")], "run_id long, at timestamp, detail string")
    assert [r.kind for r in workflow.forensics(1, log, log, log).collect()] == ["inbox", "journal", "timer"]


def test_sources(spark, tmp_path, table):
    formats.write_log(table.selectExpr("k", "1L seq", "0 op_index", "'put' kind", "n"), f"{tmp_path}/log", ["k"], 2, bloom=True)
    assert formats.read(spark, f"{tmp_path}/log", "parquet").count() == 4
    formats.write_pruned(table, f"{tmp_path}/p", ["k"])
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["k"]
    with pytest.raises(ValueError):
        formats.read(spark, f"{tmp_path}/log", "json")
    assert kafka.start_position({}, "latest") == "latest" and kafka.start_position({"t": {"0": 3}}, "earliest") == {"t": {"0": 3}}
    with pytest.raises(ValueError):
        kafka.start_position({}, "middle")
    assert kafka.retained(table, F.col("n") > 1).count() == 2
