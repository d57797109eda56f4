"""The query catalogue: every operator applied to the test tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import cdc, feed, merge, policy, projections, retention, scan, search, visibility, workflow
from palimpsest.plans.logs import CDC_SQL, EVENT_LOG_SQL, ITEM_LOG_SQL, cdc_events, event_log, item_log
from palimpsest.sources.formats import read_table, statistics
from palimpsest.spec import FieldSpec, TableSpec, evolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["user_id", "event_type"]

CUSTOMER = TableSpec("customer", ("c_custkey",), (
    FieldSpec(1, "c_custkey", "int64", False), FieldSpec(2, "c_name", "string"), FieldSpec(3, "c_nationkey", "int64"),
    FieldSpec(4, "c_acctbal", "float64"), FieldSpec(5, "c_mktsegment", "string"),
))
ORDERS = TableSpec("orders", ("o_orderkey",), (
    FieldSpec(1, "o_orderkey", "int64", False), FieldSpec(2, "o_custkey", "int64"), FieldSpec(3, "o_orderstatus", "string"),
    FieldSpec(4, "o_totalprice", "float64"), FieldSpec(5, "o_orderpriority", "string"),
))


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _shown(rows: DataFrame, **instead) -> DataFrame:
    """``rows`` with a value in the place of NULL, so that every client prints them alike."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string") if kinds[c] == "boolean" else F.col(c), F.lit(v)) for c, v in instead.items()})


# Scans


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_read(spark, d):
    return scan.point(read_table(spark, d, "customer"), {"c_custkey": 42}).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def range_scan(spark, d):
    options = scan.ScanOptions(columns=("o_custkey", "o_totalprice"))
    return scan.scan(read_table(spark, d, "orders"), ["o_orderkey"], 100, 900, options, ORDERS)


@query("SELECT c_name, c_custkey, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def prefix_scan(spark, d):
    return scan.scan_prefix(read_table(spark, d, "customer"), ["c_name"], "Customer#0000000").select("c_name", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 5000 AND o_custkey >= 500 ORDER BY o_orderkey DESC LIMIT 25")
def reverse_limit_scan(spark, d):
    options = scan.ScanOptions(("o_totalprice",), scan.Predicate("at_least", "o_custkey", 500), True, 25)
    return scan.scan(read_table(spark, d, "orders"), ["o_orderkey"], None, 5000, options, ORDERS)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 700")
def projected_predicate_scan(spark, d):
    both = scan.Predicate("all", parts=(scan.Predicate("equals", "o_orderstatus", "F"), scan.Predicate("true"), scan.Predicate("at_least", "o_custkey", 700)))
    return scan.scan(read_table(spark, d, "orders"), ["o_orderkey"], options=scan.ScanOptions(("o_custkey",), both), spec=ORDERS)


@query("SELECT event_id, user_id FROM events WHERE nullif(event_type, 'click') IS NOT DISTINCT FROM NULL")
def null_safe_equals(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    wanted = scan.Predicate("equals", "event_type", None).column_filter()
    return e.where(wanted).select("event_id", "user_id")


@query("SELECT event_id, event_id % 2 = 0 AS even FROM events WHERE CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END = TRUE")
def bool_equals(spark, d):
    e = read_table(spark, d, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("even"))
    e = e.withColumn("flag", F.when(F.col("event_id") % 5 != 0, F.col("even")))
    return e.where(scan.Predicate("is", "flag", True).column_filter()).drop("flag")


@query("SELECT p_partkey, p_name AS title, 'none' AS note, coalesce(p_size, 0) AS p_size FROM part")
def schema_evolution_fill(spark, d):
    old = TableSpec("part", ("p_partkey",), (FieldSpec(1, "p_partkey", "int64", False), FieldSpec(2, "p_name", "string"), FieldSpec(3, "p_brand", "string"), FieldSpec(4, "p_size", "int64")))
    new = TableSpec("part", ("p_partkey",), (FieldSpec(1, "p_partkey", "int64", False), FieldSpec(2, "title", "string"), FieldSpec(4, "p_size", "int64"), FieldSpec(5, "note", "string", False, "none")), 2)
    return evolve(read_table(spark, d, "part"), old, new)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey > 200 ORDER BY c_custkey LIMIT 20")
def keyset_page(spark, d):
    return scan.keyset_page(read_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 200, 20)[0]


@query("SELECT CASE WHEN count(*) > 20 THEN 220 END AS next_cursor FROM customer WHERE c_custkey > 200")
def keyset_cursor(spark, d):
    return scan.keyset_page(read_table(spark, d, "customer").select("c_custkey"), "c_custkey", 200, 20)[1]


# Visibility


_CURRENT = """
    WITH {log}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq DESC) AS r
                      FROM log WHERE kind <> 'merge' {bound})
    SELECT user_id, event_type, amount, coalesce(CAST(active AS VARCHAR), 'none') AS active, note, seq FROM h WHERE r = 1 AND kind = 'put'"""


@query(_CURRENT.format(log=EVENT_LOG_SQL.strip(), bound=""))
def current_state(spark, d):
    return _shown(visibility.current(event_log(spark, d).where("kind <> 'merge'"), KEYS), active="none")


@query(_CURRENT.format(log=EVENT_LOG_SQL.strip(), bound="AND seq <= 4000"))
def as_of_snapshot(spark, d):
    return _shown(visibility.current(event_log(spark, d).where("kind <> 'merge'"), KEYS, 4000), active="none")


@query(_CURRENT.format(log=EVENT_LOG_SQL.strip(), bound="AND seq <= 4000") + " AND user_id = 7")
def read_as_of(spark, d):
    return _shown(scan.point(visibility.current(event_log(spark, d).where("kind <> 'merge'"), KEYS, 4000), {"user_id": 7}), active="none")


@query(_CURRENT.format(log=EVENT_LOG_SQL.strip(), bound="AND seq <= 6000") + " AND user_id >= 10 AND user_id < 30 AND starts_with(event_type, 's')")
def scan_as_of(spark, d):
    state = visibility.current(event_log(spark, d).where("kind <> 'merge'"), KEYS, 6000)
    return _shown(scan.scan(state.where(F.col("event_type").startswith("s")), KEYS, 10, 30), active="none")


@query(f"""
    WITH {ITEM_LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, seq ORDER BY op_index DESC) AS r FROM items)
    SELECT l_suppkey, seq, op_index, kind, quantity FROM l WHERE r = 1""")
def same_batch_last_wins(spark, d):
    return visibility.last_of_commit(item_log(spark, d), ["l_suppkey"])


_RESOLVED = f"""
    WITH {EVENT_LOG_SQL}, b AS (
        SELECT *, max(CASE WHEN kind <> 'merge' THEN seq END) OVER (PARTITION BY user_id, event_type) AS base FROM log
    ), live AS (SELECT * FROM b WHERE base IS NULL OR seq >= base)"""


@query(_RESOLVED + """
    SELECT user_id, event_type, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount, coalesce(CAST(arg_min(active, seq) FILTER (active IS NOT NULL) AS VARCHAR), 'none') AS active,
           arg_max(note, seq) FILTER (note IS NOT NULL) AS note, max(seq) AS seq
    FROM live GROUP BY ALL HAVING bool_or(kind <> 'delete')""")
def merge_sum(spark, d):
    operators = {"amount": merge.Sum(), "active": merge.FirstNonNull(), "note": merge.LastNonNull()}
    return _shown(visibility.resolve(event_log(spark, d), KEYS, operators, single=True), active="none")


@query(_RESOLVED + """
    SELECT user_id, event_type, string_agg(note, ',' ORDER BY seq) AS note, max(amount) AS amount, max(seq) AS seq
    FROM live GROUP BY ALL HAVING bool_or(kind <> 'delete')""")
def merge_append_ordered(spark, d):
    return visibility.resolve(event_log(spark, d), KEYS, {"note": merge.Append(","), "amount": merge.Extreme()}, single=True)


@query(_RESOLVED + """, k AS (SELECT user_id, event_type FROM live GROUP BY ALL HAVING bool_or(kind = 'delete') AND bool_or(kind = 'merge'))
    SELECT user_id, event_type, CAST(sum(amount) AS BIGINT) AS amount, max(seq) AS seq FROM live JOIN k USING (user_id, event_type) GROUP BY ALL""")
def merge_after_delete(spark, d):
    log = event_log(spark, d)
    state = visibility.resolve(log, KEYS, {"amount": merge.Sum()}, single=True)
    last = log.where("kind <> 'merge'").groupBy(*KEYS).agg(F.max_by("kind", "seq").alias("base")).where("base = 'delete'")
    return state.join(last.select(*KEYS), KEYS, "left_semi")


@query(_RESOLVED + """
    SELECT user_id, event_type, CAST(sum(amount * 3 + 1) AS BIGINT) AS amount, max(seq) AS seq
    FROM live WHERE kind <> 'delete' GROUP BY ALL""")
def merge_custom_fold(spark, d):
    fold = merge.Fold(F.lit(0).cast("long"), lambda total, x: total + x * 3 + 1)
    return visibility.resolve(event_log(spark, d), KEYS, {"amount": fold}, single=True)


@query(f"""
    WITH {EVENT_LOG_SQL}, g AS (
        SELECT *, sum(CASE WHEN kind = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS epoch FROM log)
    SELECT user_id, event_type, seq, CASE WHEN kind = 'merge' THEN 'put' ELSE kind END AS kind,
           CASE WHEN kind = 'merge' THEN CAST(coalesce(sum(amount) OVER (PARTITION BY user_id, event_type, epoch ORDER BY seq), 0) AS BIGINT) ELSE amount END AS amount
    FROM g""")
def merge_to_put_rewrite(spark, d):
    found = visibility.merges_as_puts(event_log(spark, d), KEYS, "amount", merge.Sum().running)
    return found.select(*KEYS, "seq", "kind", "amount")


@query(f"""
    WITH {EVENT_LOG_SQL}, t AS (SELECT *, max(CASE WHEN seq <= 5000 THEN seq END) OVER (PARTITION BY user_id, event_type) AS newest FROM log)
    SELECT user_id, event_type, seq, kind FROM t WHERE seq > 5000 OR seq = newest""")
def mvcc_trim(spark, d):
    return visibility.trim(event_log(spark, d), KEYS, 5000).select(*KEYS, "seq", "kind")


@query(f"""
    WITH {EVENT_LOG_SQL} SELECT user_id, event_type, seq, kind FROM log
    WHERE seq >= 9000 OR kind = 'delete' OR amount IS NULL OR seq + amount * 100 > 7000""")
def ttl_filter(spark, d):
    keep = visibility.ttl(F.col("seq") + F.col("amount") * 100, 7000)
    return visibility.compact(event_log(spark, d), keep, 9000).select(*KEYS, "seq", "kind")


# Feeds


@query(f"WITH {ITEM_LOG_SQL} SELECT l_suppkey, seq, op_index, kind, quantity FROM items WHERE (seq, op_index) > (5000, 1) AND seq <= 9000 ORDER BY seq, op_index LIMIT 500")
def changes_since(spark, d):
    return feed.changes_since(item_log(spark, d), (5000, 1), 9000, 500)


@query(f"WITH {ITEM_LOG_SQL} SELECT l_suppkey, seq, op_index, kind, quantity FROM items WHERE (seq, op_index) > (8000, 2) AND seq <= 8300")
def durable_changes(spark, d):
    return feed.changes_since(item_log(spark, d), (8000, 2), 8300)


@query(f"WITH {ITEM_LOG_SQL} SELECT min(seq) AS oldest, max(seq) AS newest, 10 < min(seq) AS too_old FROM items WHERE seq > 1000")
def too_old_check(spark, d):
    return feed.floor(item_log(spark, d).where("seq > 1000")).withColumn("too_old", F.lit(10) < F.col("oldest"))


@query(f"WITH {ITEM_LOG_SQL} SELECT l_suppkey, seq, op_index, quantity FROM items")
def sharded_feed_merge(spark, d):
    log = item_log(spark, d).select("l_suppkey", "seq", "op_index", "quantity")
    return feed.merged([log.where(F.col("l_suppkey") % 3 == i) for i in range(3)])


@query(f"WITH {EVENT_LOG_SQL} SELECT event_type, greatest(0, 10000 - max(seq)) AS lag FROM log WHERE seq <= 9990 GROUP BY ALL")
def projection_lag(spark, d):
    seen = event_log(spark, d).where("seq <= 9990").groupBy("event_type").agg(F.max("seq").alias("frontier"))
    return seen.select("event_type", feed.lag(F.lit(10000).cast("long"), F.col("frontier")).alias("lag"))


@query(f"""
    WITH {EVENT_LOG_SQL} SELECT count(*) AS rows, min(seq) AS oldest, max(seq) AS newest,
           count(*) FILTER (kind = 'delete') AS deletes, count(*) FILTER (kind = 'merge') AS merges FROM log""")
def table_statistics(spark, d):
    return statistics(event_log(spark, d), KEYS).drop("keys")


# Change data capture

ATTENTION = cdc.RowPredicate("and", parts=(
    cdc.RowPredicate("column", "status", "F"),
    cdc.RowPredicate("not", parts=(cdc.RowPredicate("column", "priority", "5-LOW"),)),
))
_IN = "coalesce({0}_status = 'F' AND {0}_priority <> '5-LOW', FALSE)"
_WAS, _IS = _IN.format("before"), _IN.format("after")


@query(f"WITH {CDC_SQL} SELECT event_id, id, op FROM cdc WHERE tombstone OR {_WAS} OR {_IS}")
def cdc_event_log(spark, d):
    return cdc.event_log(cdc_events(spark, d), ATTENTION).select("event_id", "id", "op")


@query(f"""
    WITH {CDC_SQL}, m AS (
        SELECT *, CASE WHEN tombstone THEN NULL WHEN {_IS} THEN 'put' WHEN op IN ('u', 'd') OR {_WAS} THEN 'delete' END AS kind FROM cdc
    ), h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS r FROM m WHERE kind IS NOT NULL)
    SELECT id, after_status AS status, after_priority AS priority FROM h WHERE r = 1 AND kind = 'put'""")
def cdc_mirror(spark, d):
    log = cdc.materialize(cdc_events(spark, d), ATTENTION, "mirror")["mirror"]
    log = log.select("id", F.col("after.status").alias("status"), F.col("after.priority").alias("priority"), F.col("event_id").alias("seq"), F.lit(0).alias("op_index"), "kind")
    return visibility.current(log, ["id"]).drop("seq")


@query(f"""
    WITH {CDC_SQL} SELECT event_id, id, CASE WHEN {_IS} THEN 'entered' ELSE 'exited' END AS transition FROM cdc WHERE {_WAS} <> {_IS}""")
def cdc_transitions(spark, d):
    return cdc.transitions(cdc_events(spark, d), ATTENTION).select("event_id", "id", "transition")


@query(f"""
    WITH {CDC_SQL} SELECT event_id, after_status AS status, CASE WHEN after_status IS NOT NULL THEN 'hidden' END AS priority,
           CASE WHEN after_status IS NOT NULL THEN 'x' END AS region FROM cdc""")
def cdc_redaction(spark, d):
    image = cdc.projected(F.col("after"), ["status", "priority"], {"priority": "hidden", "region": "x"})
    return cdc_events(spark, d).select("event_id", image.alias("i")).select("event_id", "i.status", "i.priority", "i.region")


@query(f"WITH {CDC_SQL} SELECT op, count(*) AS n FROM cdc WHERE NOT tombstone AND after_status IS NOT NULL AND (op = 'c' OR id = 10) GROUP BY ALL")
def cdc_predicate_tree(spark, d):
    p = cdc.RowPredicate("or", parts=(cdc.RowPredicate("operation", value="c"), cdc.RowPredicate("key", "id", 10), cdc.RowPredicate("none")))
    events = cdc_events(spark, d).where(cdc.admits("no_snapshots_or_tombstones"))
    return events.where(p.on("after")).groupBy("op").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 5 = 0 THEN 'd' ELSE 'c' END AS op,
           CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS status,
           CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'unknown operation'
                WHEN o_orderkey % 5 = 0 THEN 'delete with an after image' END AS error, o_orderkey % 13 = 0 AS tombstone
    FROM orders""")
def cdc_decode(spark, d):
    k = F.col("o_orderkey")
    op = F.when(k % 7 == 0, "x").when(k % 5 == 0, "d").otherwise("c")
    envelope = F.to_json(F.struct(op.alias("op"), F.struct(F.col("o_orderstatus").alias("status")).alias("after")))
    raw = read_table(spark, d, "orders").select("o_orderkey", F.when(k % 13 != 0, envelope).alias("value"))
    return cdc.decode(raw, "status string").select("o_orderkey", "op", F.col("after.status").alias("status"), "error", "tombstone")


@query("""
    WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice >= 250000 AS now,
                      lag(o_totalprice >= 250000, 1, FALSE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders)
    SELECT o_custkey, o_orderkey, CASE WHEN now THEN 'entered' ELSE 'exited' END AS transition FROM s WHERE now <> was""")
def state_transitions(spark, d):
    found = cdc.state_transitions(read_table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], F.col("o_totalprice") >= 250000)
    return found.select("o_custkey", "o_orderkey", "transition")


@query("SELECT o_orderkey % 4 AS partition, max(o_orderkey) + 1 AS next_offset FROM orders GROUP BY ALL")
def kafka_progress(spark, d):
    from palimpsest.sources import kafka

    records = read_table(spark, d, "orders").select(F.lit("orders").alias("topic"), (F.col("o_orderkey") % 4).alias("partition"), F.col("o_orderkey").alias("offset"))
    return kafka.progress(records).drop("topic")


@query("""
    WITH m AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'O' THEN 'put' END AS kind FROM orders),
    h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM m WHERE kind IS NOT NULL)
    SELECT o_custkey, o_orderkey FROM h WHERE r = 1 AND kind = 'put'""")
def kafka_mirror(spark, d):
    from palimpsest.sources import kafka

    records = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("offset"))
    kind = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "put")
    return visibility.current(kafka.as_log(records, kind), ["o_custkey"]).select("o_custkey", "o_orderkey")


# Lookups


@query(f"""
    WITH {EVENT_LOG_SQL}, h AS (SELECT user_id, event_type, amount, seq, kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq DESC) AS r
                                FROM log WHERE kind <> 'merge' AND seq <= 5000)
    SELECT o.o_orderkey, o.user_id, coalesce(h.amount, -1) AS amount, coalesce(h.seq, -1) AS state_seq
    FROM (SELECT o_orderkey, o_custkey % 150 AS user_id, 'click' AS event_type FROM orders) o
    LEFT JOIN (SELECT * FROM h WHERE r = 1 AND kind = 'put') h ON o.user_id = h.user_id AND o.event_type = h.event_type""")
def frontier_lookup_join(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.lit("click").alias("event_type"))
    log = event_log(spark, d).where("kind <> 'merge'").select(*KEYS, "amount", "seq", "op_index", "kind")
    found = projections.frontier_lookup(orders, log, KEYS, KEYS, 5000).select("o_orderkey", "user_id", "amount", "state_seq")
    return _shown(found, amount=-1, state_seq=-1)


@query(f"""
    WITH o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, o_orderkey % 10000 AS at FROM orders),
    l AS (SELECT user_id, event_id + 1 AS seq, event_type FROM events)
    SELECT o.o_orderkey, o.user_id, o.at, coalesce(l.seq, -1) AS found_seq, coalesce(l.event_type, 'none') AS event_type FROM o ASOF LEFT JOIN l ON o.user_id = l.user_id AND o.at >= l.seq""")
def as_of_join(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.col("o_orderkey") % 10000).alias("at"))
    log = read_table(spark, d, "events").select("user_id", (F.col("event_id") + 1).alias("seq"), "event_type")
    return _shown(projections.as_of_lookup(orders, log, ["user_id"], "at", ["event_type"]), found_seq=-1, event_type="none")


_GRANTS = "SELECT DISTINCT r_name AS lookup_key, c_custkey AS row_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _grants(spark, d):
    members = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = members.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("lookup_key"))
    return projections.expand(read_table(spark, d, "customer"), members, "c_nationkey", "c_custkey")


@query(_GRANTS)
def visibility_index(spark, d):
    return _grants(spark, d)


@query(f"""
    WITH g AS ({_GRANTS}), a AS (SELECT * FROM g WHERE row_id % 7 <> 0), b AS (SELECT * FROM g WHERE row_id % 5 <> 0)
    SELECT lookup_key, row_id, CASE WHEN row_id % 7 = 0 THEN 'added' ELSE 'removed' END AS change FROM g WHERE (row_id % 7 = 0) <> (row_id % 5 = 0)""")
def visibility_transitions(spark, d):
    g = _grants(spark, d)
    return projections.diff(g.where("row_id % 7 <> 0"), g.where("row_id % 5 <> 0"), ["lookup_key", "row_id"])


@query(f"SELECT DISTINCT row_id FROM ({_GRANTS}) WHERE lookup_key IN (SELECT r_name FROM region WHERE r_regionkey IN (1, 3))")
def visibility_scan(spark, d):
    names = read_table(spark, d, "region").where("r_regionkey IN (1, 3)").select(F.col("r_name").alias("lookup_key"))
    return _grants(spark, d).join(names, "lookup_key", "left_semi").select("row_id").distinct()


@query(f"""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'x' END AS before, c_mktsegment AS after, 'changed' AS change
    FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment <> 'x'""")
def view_diff(spark, d):
    new = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = new.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("x"))
    return projections.diff(old, new, ["c_custkey"], "c_mktsegment")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark, d):
    return read_table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).where("n > 1")


# Policies


@query(f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT row_id FROM ({_GRANTS}) WHERE lookup_key = (SELECT min(r_name) FROM region))")
def policy_semi_filter(spark, d):
    first = read_table(spark, d, "region").agg(F.min("r_name").alias("lookup_key"))
    grants = _grants(spark, d).join(first, "lookup_key", "left_semi")
    return policy.Policy("index").visible(read_table(spark, d, "customer"), {}, "c_custkey", grants=grants).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def policy_prefix(spark, d):
    rule = policy.Policy("prefix", "Customer#{tenant}")
    rule.check("prefix")
    return rule.visible(read_table(spark, d, "customer"), {"tenant": "00000001"}, "c_name").select("c_custkey", "c_name")


SEGMENT = policy.Clause("all", parts=(
    policy.Clause("context", "c_mktsegment", "segment"),
    policy.Clause("any", parts=(policy.Clause("literal", "c_nationkey", 3), policy.Clause("literal", "c_nationkey", 5), policy.Clause("literal", "absent", 1))),
))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 5)")
def policy_predicate(spark, d):
    rows = read_table(spark, d, "customer")
    return policy.Policy("predicate", clause=SEGMENT).visible(rows, {"segment": "BUILDING"}, "c_custkey", scalar.json_row(rows)).select("c_custkey")


@query("SELECT count(*) AS scanned, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 5)) AS returned, count(*) FILTER (NOT (c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 5))) AS filtered FROM customer")
def authorize_counts(spark, d):
    rows = read_table(spark, d, "customer")
    return policy.audit(rows, SEGMENT.on(scalar.json_row(rows), {"segment": "BUILDING"}))


@query("SELECT c_custkey, 99 AS resume FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) WHERE c_mktsegment = 'BUILDING'")
def policy_page(spark, d):
    rows = read_table(spark, d, "customer")
    return policy.page(rows, F.col("c_mktsegment") == "BUILDING", "c_custkey", 100).select("c_custkey", "resume")


@query("""
    SELECT o_orderkey, (o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_orderstatus = 'O')) AND o_custkey < 700 AS allowed FROM orders""")
def policy_write(spark, d):
    changes = read_table(spark, d, "orders").withColumns({"had": F.col("o_orderkey") % 3 != 0, "covered": F.col("o_orderkey") % 2 == 0})
    return policy.writable(changes, F.col("o_orderstatus") == "O", F.col("o_custkey") < 700, "had", "covered").select("o_orderkey", "allowed")


# Projections


@query(_CURRENT.format(log=EVENT_LOG_SQL.strip(), bound="").replace("user_id, event_type, amount, coalesce(CAST(active AS VARCHAR), 'none') AS active, note, seq", "note AS lookup, user_id, event_type"))
def secondary_index(spark, d):
    return projections.secondary_index(visibility.current(event_log(spark, d).where("kind <> 'merge'"), KEYS), "note", KEYS)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counter(spark, d):
    return projections.counter(read_table(spark, d, "events"), KEYS)


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, user_id, n, row_number() OVER (ORDER BY n DESC, user_id, event_type) AS position FROM c
    ORDER BY n DESC, user_id, event_type LIMIT 15""")
def multi_stage_topn(spark, d):
    stages = [
        ("top", ["counts"], lambda c: projections.ranked(c, "n", "user_id", ["event_type"], 15)),
        ("counts", ["events"], lambda e: projections.counter(e, KEYS)),
    ]
    return projections.apply_dag({"events": read_table(spark, d, "events")}, stages)["top"]


_BALANCE = "CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END"


def _ranking(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("points"))


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_name, c_custkey) AS position FROM customer ORDER BY c_acctbal DESC, c_name, c_custkey LIMIT 20")
def ranked_materialization(spark, d):
    rows = read_table(spark, d, "customer")
    return projections.ranked(rows, "c_acctbal", "c_name", ["c_custkey"], 20).select("c_custkey", "c_acctbal", "position")


@query(f"SELECT c_custkey, {_BALANCE} AS points FROM customer ORDER BY points DESC NULLS FIRST, c_name, c_custkey LIMIT 300")
def rank_retention(spark, d):
    return retention.rank_retained(_ranking(spark, d), "points", "c_name", "c_custkey", 300, missing="highest").select("c_custkey", "points")


@query(f"SELECT c_custkey, {_BALANCE} AS points FROM customer WHERE {_BALANCE} IS NOT NULL ORDER BY points, c_name, c_custkey LIMIT 300")
def rank_retention_excluding(spark, d):
    return retention.rank_retained(_ranking(spark, d), "points", "c_name", "c_custkey", 300, True, "exclude").select("c_custkey", "points")


_TOP = "SELECT c_custkey FROM customer WHERE {} ORDER BY c_acctbal DESC, c_name, c_custkey LIMIT 100"


@query(f"""
    WITH a AS ({_TOP.format("c_custkey % 4 <> 0")}), b AS ({_TOP.format("c_custkey % 3 <> 0")})
    SELECT c_custkey, 'entered' AS churn FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)
    UNION ALL SELECT c_custkey, 'exited' FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)""")
def rank_churn(spark, d):
    rows = read_table(spark, d, "customer")
    top = [retention.rank_retained(rows.where(w), "c_acctbal", "c_name", "c_custkey", 100) for w in ("c_custkey % 4 <> 0", "c_custkey % 3 <> 0")]
    return retention.churn(top[0], top[1], "c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE {_BALANCE} IS NULL OR {_BALANCE} >= 5000")
def threshold_retention(spark, d):
    return _ranking(spark, d).where(retention.threshold(F.col("points"), 5000.0, True, "exclude")).select("c_custkey")


@query(f"""
    WITH r AS (SELECT c_custkey, {_BALANCE} >= 5000 AS kept FROM customer),
    s AS (SELECT CASE WHEN coalesce(kept, FALSE) THEN 'retained' WHEN c_custkey % 10 = 1 THEN 'deferred' ELSE 'reclaimable' END AS state, c_custkey FROM r)
    SELECT state, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS bytes FROM s GROUP BY ALL""")
def retention_stats(spark, d):
    rows = _ranking(spark, d)
    kept = rows.where(retention.threshold(F.col("points"), 5000.0, True, "lowest"))
    return retention.stats(retention.classify(rows, kept, rows.where("c_custkey % 10 = 1"), "c_custkey"), "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_name, c_custkey LIMIT 50) ORDER BY c_acctbal, c_name DESC LIMIT 1")
def rank_boundary(spark, d):
    top = retention.rank_retained(read_table(spark, d, "customer"), "c_acctbal", "c_name", "c_custkey", 50)
    return retention.boundary(top, "c_acctbal", "c_name", "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS slot FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_items(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return retention.recent_slots(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 10)


@query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST, o_orderkey LIMIT 200")
def due_date_list(spark, d):
    due = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return read_table(spark, d, "orders").orderBy(F.asc_nulls_last(due), "o_orderkey").limit(200).select("o_orderkey")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def tail_of_log(spark, d):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return read_table(spark, d, "conversations").select("conv_id", "turn", "role", r.alias("r")).where("r <= 2").drop("r")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_state_upsert(spark, d):
    return projections.latest(read_table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def batch_dedup(spark, d):
    return projections.latest(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


_SUMMARY = """
    SELECT count(*) AS n, count(*) FILTER (value > 100) AS alerts, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean
    FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"""


@query(_SUMMARY)
def window_summary(spark, d):
    import datetime

    rows = scan.point(read_table(spark, d, "events"), {"user_id": 8})
    start, end = datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 20)
    return projections.window_summary(rows, "ts", start, end, "value", F.col("value") > 100).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def bucket_counts(spark, d):
    return projections.bucket_counts(read_table(spark, d, "events"), ["event_type"], "ts", "1 hour")


_MOVING = """
    WITH t AS (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS total FROM events)"""


@query(_MOVING + " SELECT event_id, total FROM t")
def moving_window(spark, d):
    return projections.moving_total(read_table(spark, d, "events"), ["user_id"], "ts", F.lit(1), 86400).select("event_id", "total")


@query(_MOVING + """, s AS (SELECT *, total >= 4 AS now, lag(total >= 4, 1, FALSE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM t)
    SELECT user_id, event_id, total, CASE WHEN now THEN 'entered' ELSE 'exited' END AS transition FROM s WHERE now <> was""")
def moving_window_crossings(spark, d):
    totals = projections.moving_total(read_table(spark, d, "events"), ["user_id"], "ts", F.lit(1), 86400)
    return projections.crossings(totals, ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id", "total", "transition")


# Search

_TERMS = """
    terms AS (SELECT DISTINCT doc_id, lower(t) AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS t FROM documents) WHERE t <> '')"""


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM terms GROUP BY ALL")
def search_index_terms(spark, d):
    return projections.counter(search.postings(read_table(spark, d, "documents"), ["doc_id"], "text"), ["term"])


@query(f"WITH {_TERMS} SELECT doc_id FROM terms WHERE term IN ('the', 'and', 'with') GROUP BY doc_id HAVING count(*) = 3")
def search_all_terms(spark, d):
    return search.matches_all(search.postings(read_table(spark, d, "documents"), ["doc_id"], "text", ["the", "and", "with"]), ["doc_id"], ["the", "and", "with"])


@query(f"""WITH {_TERMS}, m AS (SELECT doc_id FROM terms WHERE term IN ('the', 'was') GROUP BY doc_id HAVING count(*) = 2)
    SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM m) ORDER BY source, doc_id LIMIT 50""")
def search_query(spark, d):
    docs = read_table(spark, d, "documents")
    ids = search.matches_all(search.postings(docs, ["doc_id"], "text", ["the", "was"]), ["doc_id"], ["the", "was"])
    return search.fetch(ids, docs, ["doc_id"], ["source", "doc_id"], 50).select("doc_id", "source")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest, 'n_chars:' || lpad(CAST(n_chars AS VARCHAR), 20, '0') AS term FROM documents")
def digest_and_number_terms(spark, d):
    return read_table(spark, d, "documents").select("doc_id", scalar.digest(F.col("text")).alias("digest"), scalar.number_term("n_chars", F.col("n_chars")).alias("term"))


@query("SELECT doc_id FROM documents WHERE starts_with(source, 'src1') AND lang = 'en' AND n_chars BETWEEN 500 AND 2000")
def blob_query(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("alias"), F.col("lang").alias("content_type"), F.col("n_chars").alias("size_bytes"))
    return docs.where(search.blob_filter("src1", "en", size=(500, 2000))).select("doc_id")


# Overlays


@query("""
    WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0),
    p AS (SELECT o_orderkey, 'Z' AS o_orderstatus, o_orderkey % 8 = 0 AS deleted FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 8 = 0)
    SELECT o_orderkey, coalesce(p.o_orderstatus, b.o_orderstatus) AS o_orderstatus FROM b FULL JOIN p USING (o_orderkey) WHERE NOT coalesce(deleted, FALSE)""")
def overlay_merge(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    pending = orders.where("o_orderkey % 6 = 0 OR o_orderkey % 8 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus"), (F.col("o_orderkey") % 8 == 0).alias("deleted"))
    return scan.overlay(orders.where("o_orderkey % 4 <> 0"), pending, ["o_orderkey"])


_PATH = "'c' || o_custkey % 40 || '/' || o_orderstatus || '/' || o_orderkey"


@query(f"""
    WITH f AS (SELECT {_PATH} AS path, o_custkey % 40 AS c, o_orderstatus AS s, o_orderkey AS k FROM orders),
    base AS (SELECT * FROM f WHERE k % 10 <> 0), delta AS (SELECT * FROM f WHERE k % 5 = 0)
    SELECT path, k FROM base WHERE path NOT IN (SELECT path FROM delta) AND c <> 7 AND NOT (c = 9 AND s = 'F')
    UNION ALL SELECT path, k FROM delta""")
def whiteout_overlay(spark, d):
    path = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"))
    files = read_table(spark, d, "orders").select(path.alias("path"), F.col("o_orderkey").alias("k"))
    hidden = spark.createDataFrame([("c7",), ("c9/F",)], "path string")
    return scan.whiteout_overlay(files.where("k % 10 <> 0"), files.where("k % 5 = 0"), hidden, "path")


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'referenced' WHEN doc_id % 17 = 0 THEN 'snapshot'
                     WHEN n_chars < 500 THEN 'grace' WHEN doc_id % 3 = 0 THEN 'tracked' ELSE 'orphan' END AS state FROM documents)
    SELECT doc_id, state, state = 'orphan' AND row_number() OVER (PARTITION BY state ORDER BY doc_id) <= 30 AS due FROM s""")
def gc_classification(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars")
    found = retention.garbage(docs, read_table(spark, d, "labels"), docs.where("doc_id % 3 = 0"), docs.where("doc_id % 17 = 0"), "doc_id", F.col("n_chars"), 500, 30)
    return found.select("doc_id", "state", "due")


# Workflows


def _timers(spark, d):
    return read_table(spark, d, "events").select(F.col("event_id").alias("timer_id"), F.col("ts").alias("fire_at"), (F.col("event_id") + 1).alias("seq"), "user_id")


@query("SELECT event_id AS timer_id, ts AS fire_at FROM events WHERE event_id + 1 <= 4000 AND ts <= TIMESTAMP '2024-01-10 12:00:00' ORDER BY ts, event_id LIMIT 100")
def due_timers(spark, d):
    import datetime

    return workflow.due(_timers(spark, d), datetime.datetime(2024, 1, 10, 12), 4000, 100).select("timer_id", "fire_at")


@query("SELECT event_id * 3 AS timer_id, event_id * 3 <= (SELECT max(event_id) FROM events) AS cancelled FROM events")
def cancel_timers(spark, d):
    wanted = read_table(spark, d, "events").select((F.col("event_id") * 3).alias("timer_id"))
    return workflow.cancel(_timers(spark, d), wanted)[1]


@query("SELECT event_id, unnest(generate_series(ts, TIMESTAMP '2024-02-01 00:00:00', INTERVAL 5 DAY)) AS fire_at FROM events WHERE event_type = 'signup'")
def recurring_schedule(spark, d):
    rows = read_table(spark, d, "events").where("event_type = 'signup'").select("event_id", "ts")
    return workflow.recurring(rows, "ts", F.expr("INTERVAL 5 DAYS"), F.lit("2024-02-01 00:00:00").cast(rows.schema["ts"].dataType)).drop("ts")


@query("SELECT event_id + 1 AS seq, event_id AS message_id FROM events WHERE event_id + 1 > 300 AND event_id + 1 <= 900 ORDER BY 1, 2 LIMIT 200")
def outbox_batch(spark, d):
    rows = read_table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("message_id"))
    return workflow.outbox_batch(rows, 300, 900, 200)


@query("SELECT event_id AS run_id, event_type AS lifecycle FROM events WHERE event_type = 'error' AND event_id > 500 ORDER BY event_id LIMIT 40")
def workflow_listing(spark, d):
    runs = read_table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("lifecycle"))
    return workflow.listing(runs, lifecycle="error", after=500, size=40)


@query("SELECT 'inbox' AS queue, count(*) FILTER (event_type = 'click') AS depth FROM events UNION ALL SELECT 'timers', count(*) FILTER (event_type = 'view') FROM events UNION ALL SELECT 'outbox', count(*) FILTER (event_type = 'error') FROM events")
def workflow_depths(spark, d):
    e = read_table(spark, d, "events")
    return workflow.depths(*[e.where(F.col("event_type") == t) for t in ("click", "view", "error")])


@query("SELECT event_id AS message_id, ts AS at, 'timer' AS source FROM events WHERE ts <= TIMESTAMP '2024-01-02 00:00:00'")
def timer_admission(spark, d):
    import datetime

    return workflow.admit(workflow.due(_timers(spark, d), datetime.datetime(2024, 1, 2)))[0]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The window summary over the smallest tables."""
    return window_summary(spark, d)
