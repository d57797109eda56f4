"""More of the query catalogue: writes and transactions, projections that follow tables, key codecs, files, shard maps, workflows,
and the rules that decide without data, as rows (a case and its verdict)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import codecs, scalar
from palimpsest.log import DELETE, KIND, MERGE, OP, PUT, SEQ, Conflict, Database, SnapshotTooOld, conflicts
from palimpsest.operators import cdc, feed, files, merge, policy, projections, reshard, scan, search, visibility, workflow
from palimpsest.plans.logs import CDC_SQL, EVENT_LOG_SQL, ITEM_LOG_SQL, cdc_events, event_log, item_log
from palimpsest.plans.queries import _CURRENT, _IN, _IS, _RESOLVED, _WAS, ATTENTION, KEYS, ORDERS, _shown, query
from palimpsest.sources import kafka
from palimpsest.sources.formats import read_table
from palimpsest.sources.workspace import new_folder
from palimpsest.spec import FieldSpec, Precondition, SpecError, TableSpec, migrate, normalize_records
from palimpsest.streaming import incremental


def _table(**columns: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


def _verdicts(spark: SparkSession, cases: dict[str, object]) -> DataFrame:
    """Each case with what its function gives, or the name of the error that it raises."""
    rows = []
    for name, ask in cases.items():
        try:
            rows.append((name, str(ask())))
        except (SpecError, policy.Denied, SnapshotTooOld, Conflict, ValueError) as error:
            rows.append((name, type(error).__name__))
    return spark.createDataFrame(rows, "case string, verdict string")


def _values(cases: dict[str, object]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k, str(v).replace("'", "''")) for k, v in cases.items()) + ') AS t("case", verdict)'


# Scans


@query(_CURRENT.format(log=EVENT_LOG_SQL.strip(), bound="AND seq <= 7000") + " AND starts_with(event_type, 'p')")
def prefix_scan_as_of(spark, d):
    state = visibility.current(event_log(spark, d).where("kind <> 'merge'"), ["event_type", "user_id"], 7000)
    return _shown(scan.scan_prefix(state, ["event_type", "user_id"], "p"), active="none")


_PARTS = "p AS (SELECT o_orderkey // 512 AS part, o_orderkey AS k FROM orders), w AS (SELECT part, min(k) AS first, count(*) AS rows, lead(min(k)) OVER (ORDER BY min(k)) AS next FROM p GROUP BY part)"


@query(f"""
    WITH {_PARTS} SELECT count(*) AS considered, count(*) FILTER (NOT hit) AS pruned, CAST(coalesce(sum(rows) FILTER (hit), 0) AS BIGINT) AS scanned,
           (SELECT count(*) FROM orders WHERE o_orderkey >= 700 AND o_orderkey < 1900) AS returned
    FROM (SELECT rows, first < 1900 AND (next IS NULL OR next > 700) AS hit FROM w)""")
def scan_report(spark, d):
    return scan.report(read_table(spark, d, "orders"), "o_orderkey", F.floor(F.col("o_orderkey") / 512), 700, 1900)


@query(f"WITH {_PARTS} SELECT part, first, rows, first < 1900 AND (next IS NULL OR next > 700) AS overlaps FROM w")
def key_windows(spark, d):
    return scan.key_windows(read_table(spark, d, "orders"), "o_orderkey", F.floor(F.col("o_orderkey") / 512), 700, 1900)


@query("""
    SELECT count(*) FILTER (m) AS selected, count(*) FILTER (NOT m) AS dropped FROM (
        SELECT p_partkey >= 10 AND p_partkey < 1500 AND p_size % 3 = 0 AND p_size NOT IN (6, 12) AS m FROM part)""")
def selection_masks(spark, d):
    at, size = F.col("p_partkey"), F.col("p_size")
    mask = scan.intersect(scan.all_selected(), scan.slice_of(at, 10, 1500), size % 3 == 0, ~scan.from_positions(size, [6, 12]))
    return scan.survivors(read_table(spark, d, "part"), mask)


@query("""
    WITH p AS (SELECT o_orderkey // 100 AS part, o_custkey AS k FROM orders), w AS (SELECT part, min(k) AS least, max(k) AS most, bool_or(k % 64 = 77 % 64) AS mark FROM p GROUP BY part)
    SELECT part FROM w WHERE 77 BETWEEN least AND most AND mark""")
def skip_index_probe(spark, d):
    index = scan.skip_index(read_table(spark, d, "orders"), "o_custkey", F.floor(F.col("o_orderkey") / 100), 64)
    return scan.probe(index, 77, 64)


RECORD = TableSpec("record", ("id",), (
    FieldSpec(1, "id", "int64", False), FieldSpec(2, "name", "string"), FieldSpec(3, "price", "float64"), FieldSpec(4, "large", "bool", False, False),
))


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size > 25 AS large FROM part WHERE starts_with(p_name, 'red')")
def typed_record_scan(spark, d):
    """Records stored as JSON text, decoded by their specification, scanned by prefix."""
    stored = read_table(spark, d, "part").select(F.to_json(F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("large"),
    )).alias("record"))
    decoded = stored.select(F.from_json("record", RECORD.schema()).alias("r")).select("r.*")
    return scan.scan_prefix(normalize_records(decoded, RECORD), ["name", "id"], "red").select("id", "name", "price", "large")


@query(f"""
    WITH {ITEM_LOG_SQL}, {EVENT_LOG_SQL.strip()}, c AS (
        SELECT 'events' AS "table", seq, op_index, kind FROM log UNION ALL SELECT 'items', seq, op_index, kind FROM items)
    SELECT * FROM c WHERE seq > 2000 AND seq <= 2600 ORDER BY seq, op_index, "table" """)
def commit_log_scan(spark, d):
    parts = [t.select(F.lit(n).alias("table"), SEQ, OP, KIND) for n, t in (("events", event_log(spark, d)), ("items", item_log(spark, d)))]
    return feed.changes_since(parts[0].unionByName(parts[1]), (2000, 1 << 30), 2600).orderBy(SEQ, OP, "table")


@query(f"""
    WITH {EVENT_LOG_SQL} SELECT event_type, max(seq) AS visible, coalesce(max(seq) FILTER (seq <= 6000), 0) AS durable, count(*) FILTER (seq > 6000) AS pending
    FROM log GROUP BY ALL""")
def table_watermarks(spark, d):
    return feed.frontiers(event_log(spark, d), ["event_type"], 6000)


@query(f"WITH {EVENT_LOG_SQL} SELECT event_type, greatest(500, min(seq)) AS floor FROM log WHERE seq > user_id * 8 GROUP BY ALL")
def feed_floors(spark, d):
    return feed.floors(event_log(spark, d).where("seq > user_id * 8"), ["event_type"], 500)


@query(f"""
    WITH {EVENT_LOG_SQL}, f AS (SELECT user_id, seq, op_index, 'file' AS activity, note AS detail FROM log WHERE kind = 'put'
        UNION ALL SELECT user_id, seq, op_index, 'blob', event_type FROM log WHERE kind = 'delete')
    SELECT user_id, seq, activity, detail FROM f WHERE seq > 1500 AND seq <= 4500 AND user_id = 12 ORDER BY seq LIMIT 50""")
def activity_feed(spark, d):
    log = event_log(spark, d)
    made = log.where("kind = 'put'").select("user_id", SEQ, OP, F.lit("file").alias("activity"), F.col("note").alias("detail"))
    gone = log.where("kind = 'delete'").select("user_id", SEQ, OP, F.lit("blob").alias("activity"), F.col("event_type").alias("detail"))
    return feed.changes_since(made.unionByName(gone).where("user_id = 12"), (1500, 0), 4500, 50).drop(OP)


# Files in tables


def _tree(spark, d):
    """Documents as files /lang/source/id; folders have the numbers below the documents'."""
    docs = read_table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    top = docs.select("lang").distinct().select(F.lit(files.ROOT).cast("long").alias("parent"), F.col("lang").alias("name"), F.xxhash64("lang").alias("inode"))
    mid = docs.select("lang", "source").distinct().select(F.xxhash64("lang").alias("parent"), F.col("source").alias("name"), F.xxhash64("lang", "source").alias("inode"))
    low = docs.select(F.xxhash64("lang", "source").alias("parent"), F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("inode"))
    folders = top.unionByName(mid).select("inode", F.lit("folder").alias("kind"), F.lit(0).cast("long").alias("size"))
    inodes = folders.unionByName(docs.select(F.col("doc_id").alias("inode"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size")))
    return docs, inodes, top.unionByName(mid).unionByName(low)


@query("SELECT CAST(doc_id AS VARCHAR) AS name, 'file' AS kind, strlen(coalesce(text, '')) AS size FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents WHERE lang = 'en')")
def vfs_readdir(spark, d):
    docs, inodes, entries = _tree(spark, d)
    source = docs.where("lang = 'en'").agg(F.min("source")).first()[0]
    return files.readdir(inodes, entries, f"/en/{source}").select("name", "kind", "size")


@query("SELECT count(*) AS n, 'folder' AS kind, CAST(0 AS BIGINT) AS size FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM documents WHERE lang = 'fr'))")
def vfs_stat(spark, d):
    _, inodes, entries = _tree(spark, d)
    return files.stat(inodes, entries, "/fr/").groupBy("kind", "size").agg(F.count("*").alias("n")).select("n", "kind", "size")


@query("SELECT doc_id AS inode, substring(hex(encode(text)), 2 * 700 + 1, 2 * 900) AS data FROM documents WHERE strlen(text) > 512")
def vfs_pread(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text"))
    return files.pread(files.chunked(docs, "doc_id", "text", 512), 512, 700, 900).select("inode", F.hex("data").alias("data"))


@query("""
    WITH a AS (SELECT 'd/' || doc_id AS path, sha256(text) AS digest FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL),
    b AS (SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE text END) AS digest FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def worktree_status(spark, d):
    """What a work tree has that its index has not, and the other way round, by path and content."""
    docs = read_table(spark, d, "documents").where("text IS NOT NULL")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    index = docs.where("doc_id % 5 <> 0").select(path, F.sha2("text", 256).alias("digest"))
    tree = docs.where("doc_id % 3 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 7 == 0, "new").otherwise(F.col("text")), 256).alias("digest"))
    return projections.diff(index, tree, ["path"], "digest").select("path", "change")


# Writes


def _customers(spark, d) -> DataFrame:
    return read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")


_CUSTOMER = _table(c_custkey="long", c_mktsegment="string", c_nationkey="int")
_ORDER = _table(o_orderkey="long", o_custkey="long", amount="long")


def _ops(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumns({OP: F.lit(0), KIND: F.lit(kind)})


def _database(spark, d) -> Database:
    """Three commits: customers; orders with the customers of segment BUILDING gone; customers of nation 3 moved."""
    customers, orders = _customers(spark, d), read_table(spark, d, "orders")
    db = Database(spark, new_folder(spark, "database"), {"customers": _CUSTOMER, "orders": _ORDER}, {"customers": ["c_custkey"], "orders": ["o_orderkey"]})
    db.append("customers", customers)
    gone = _ops(customers.where("c_mktsegment = 'BUILDING'").select("c_custkey"), DELETE)
    db.append_all({"orders": _ops(orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("long").alias("amount")), PUT), "customers": gone})
    db.append("customers", customers.where("c_nationkey = 3").withColumn("c_mktsegment", F.lit("MOVED")))
    return db


@query("""
    SELECT 'customers' AS "table", 1 AS seq, 'put' AS kind, count(*) AS n FROM customer
    UNION ALL SELECT 'orders', 2, 'put', count(*) FROM orders UNION ALL SELECT 'customers', 2, 'delete', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'customers', 3, 'put', count(*) FROM customer WHERE c_nationkey = 3""")
def batch_commit(spark, d):
    """Puts and deletes of two tables in one commit, as the commit log has them after a compaction too."""
    db = _database(spark, d)
    db.compact()
    again = Database(spark, db.folder, {"customers": _CUSTOMER, "orders": _ORDER}, db.keys)
    return again.commit_log(["customers", "orders"]).groupBy("table", SEQ, KIND).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE (c_mktsegment <> 'BUILDING' OR c_nationkey = 3) AND c_custkey % 5 <> 0 UNION ALL SELECT -1, 'mine', 0")
def transaction_view(spark, d):
    """A transaction's own writes over its snapshot; another writer's commit stays out of sight."""
    db = _database(spark, d)
    tx = db.begin()
    for key in [r.c_custkey for r in _customers(spark, d).where("c_custkey % 5 = 0").select("c_custkey").collect()]:
        tx.delete("customers", {"c_custkey": key})
    tx.put("customers", {"c_custkey": -1}, c_mktsegment="first", c_nationkey=0).put("customers", {"c_custkey": -1}, c_mktsegment="mine", c_nationkey=0)
    db.append("customers", _customers(spark, d).withColumn("c_mktsegment", F.lit("other")))
    return tx.scan("customers")


@query(_values({"commit": 4, "read": "None", "conflict": "Conflict", "null key": "Conflict", "retried": 6, "ended": "ValueError"}))
def transaction_rules(spark, d):
    """What a commit, a missing key, a newer commit on a read key (a null one too), a retry and a second end give."""
    schema = _table(k="string", v="long")
    db = Database(spark, new_folder(spark, "rules"), {"t": schema}, {"t": ["k"]})
    for key in ("a", "b", None):
        db.append("t", spark.createDataFrame([(key, 1)], schema))
    one, two, three, four = db.begin(), db.begin(), db.begin(), db.begin()

    def conflicting(tx, key):
        tx.read("t", {"k": key})
        return tx.put("t", {"k": "z"}, v=0).commit()

    cases = {
        "read": lambda: one.read("t", {"k": "none"}), "commit": lambda: one.put("t", {"k": "a"}, v=2).put("t", {"k": None}, v=2).commit(), "conflict": lambda: conflicting(two, "a"),
        "null key": lambda: conflicting(three, None), "ended": two.abort, "aborted": four.abort,
    }
    found = _verdicts(spark, cases).where("case <> 'aborted'")
    stale = Database(spark, db.folder, {"t": schema}, {"t": ["k"]})
    stale.append("t", spark.createDataFrame([("c", 1)], schema))  # so that the first try of the other writer meets a taken sequence
    return found.unionByName(_verdicts(spark, {"retried": lambda: db.run(lambda at, b: b.put("t", {"k": "c"}, v=at).read("t", {"k": "c"}, at))[1]}))


@query(f"""
    WITH {ITEM_LOG_SQL} SELECT s_suppkey AS l_suppkey, s_suppkey * 140 AS at, max(seq) AS newer FROM supplier JOIN items ON l_suppkey = s_suppkey
    GROUP BY ALL HAVING max(seq) > s_suppkey * 140""")
def occ_conflicts(spark, d):
    reads = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 140).alias("at"))
    return conflicts(reads, item_log(spark, d), ["l_suppkey"])


_BEFORE = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"


@query(_BEFORE)
def volume_clone(spark, d):
    """A table's rows at a sequence, exported as one commit of a new database."""
    db = _database(spark, d)
    state = visibility.current(db.log("customers", upto=2), ["c_custkey"]).drop(SEQ)
    clone = Database(spark, new_folder(spark, "clone"), {"customers": _CUSTOMER}, {"customers": ["c_custkey"]})
    clone.append("customers", state)
    return visibility.current(clone.log("customers"), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT count(*) - 60 AS waiting, min(event_id) FILTER (event_id >= 60) AS oldest, CAST(60 AS BIGINT) AS delivered FROM events")
def outbox_relay(spark, d):
    """Three rounds of at most 25 messages, with the last one over at 60: each is delivered, then deleted."""
    schema = _table(message_id="long", user_id="long")
    db = Database(spark, new_folder(spark, "outbox"), {"outbox": schema}, {"outbox": ["message_id"]})
    db.append("outbox", read_table(spark, d, "events").select(F.col("event_id").alias("message_id"), "user_id"))
    delivered = sum(workflow.relay(db, "outbox", n, lambda rows: rows.count()) for n in (25, 25, 10))
    left = visibility.current(db.log("outbox"), ["message_id"])
    return left.agg(F.count("*").alias("waiting"), F.min("message_id").alias("oldest"), F.lit(delivered).cast("long").alias("delivered"))


_MAPS = reshard.ShardMap(1, tuple(i % 4 for i in range(64))), reshard.ShardMap(2, tuple(i % 5 for i in range(64)))


@query("SELECT CAST(i AS INTEGER) AS partition, CAST(i % 4 AS INTEGER) AS source, CAST(i % 5 AS INTEGER) AS target FROM range(64) t(i) WHERE i % 4 <> i % 5")
def reshard_plan(spark, d):
    return reshard.plan(spark, *_MAPS)


@query("SELECT CAST(o_orderkey % 64 % 4 AS INTEGER) AS source, CAST(o_orderkey % 64 % 5 AS INTEGER) AS target, count(*) AS n FROM orders WHERE o_orderkey % 64 % 4 <> o_orderkey % 64 % 5 GROUP BY ALL")
def reshard_moves(spark, d):
    part = (F.col("o_orderkey") % 64).cast("int")
    return reshard.moving(read_table(spark, d, "orders"), part, *_MAPS).groupBy("source", "target").agg(F.count("*").alias("n"))


_FIRST = TableSpec("t", ("k",), (FieldSpec(1, "k", "string", False), FieldSpec(2, "v", "int64")))
_SECOND = TableSpec("t", ("k",), (FieldSpec(1, "k", "string", False), FieldSpec(2, "w", "int64"), FieldSpec(3, "x", "string", False, "")), 2)
_BROKEN = TableSpec("t", ("k",), (FieldSpec(1, "k", "int64", False),), 2)


@query(_values({
    "ensure": "['t']", "ensure again": 1, "install": 2, "same version": "SpecError", "type change": "SpecError", "metadata": "{'a': '1'}", "refused": "SpecError",
    "allowed": 2, "any": "True", "all": "False", "not": "True",
}))
def migration_actions(spark, d):
    one = migrate({}, "ensure", _FIRST)
    two = migrate(one, "install", _SECOND)
    there, gone = Precondition("exists", "t"), Precondition("missing", "t")
    return _verdicts(spark, {
        "ensure": lambda: sorted(one), "ensure again": lambda: migrate(one, "ensure", _SECOND)["t"].version, "install": lambda: two["t"].version,
        "same version": lambda: migrate(two, "install", _SECOND), "type change": lambda: migrate(one, "install", _BROKEN),
        "metadata": lambda: migrate(one, "metadata", table="t", metadata={"a": "1"})["t"].metadata, "refused": lambda: migrate(one, "install", _SECOND, gone),
        "allowed": lambda: migrate(one, "install", _SECOND, Precondition("version", "t", 1))["t"].version,
        "any": lambda: Precondition("any", parts=(gone, there)).holds(one), "all": lambda: Precondition("all", parts=(gone, there)).holds(one),
        "not": lambda: Precondition("not", parts=(gone,)).holds(one),
    })


# Predicates and policies


@query(_values({
    "fits": "None", "unknown field": "SpecError", "wrong type": "SpecError", "null on a key": "SpecError", "null on a nullable": "None", "bool on a number": "SpecError",
    "row table": "SpecError", "row table without": "ok",
}))
def predicate_checks(spark, d):
    p = scan.Predicate
    orders = read_table(spark, d, "orders")

    def plain(options):
        scan.scan(orders, ["o_orderkey"], 1, 2, options)
        return "ok"

    return _verdicts(spark, {
        "fits": lambda: p("at_least", "o_custkey", 5).check(ORDERS), "unknown field": lambda: p("equals", "none", 1).check(ORDERS),
        "wrong type": lambda: p("equals", "o_orderstatus", 5).check(ORDERS), "null on a key": lambda: p("equals", "o_orderkey", None).check(ORDERS),
        "null on a nullable": lambda: p("equals", "o_orderstatus", None).check(ORDERS), "bool on a number": lambda: p("is", "o_custkey", True).check(ORDERS),
        "row table": lambda: plain(scan.ScanOptions(predicate=p("at_least", "o_custkey", 5))), "row table without": lambda: plain(scan.ScanOptions(("o_custkey",))),
    })


_SHAPES = ("point", "prefix", "write", "aggregate", "join")
_ALLOWED = {"prefix": ("point", "prefix", "write"), "predicate": ("point", "prefix", "write"), "index": ("point", "prefix"), "procedure": ()}


@query(_values({f"{k} {s}": "allowed" if s in a else "Denied" for k, a in _ALLOWED.items() for s in _SHAPES}))
def policy_shapes(spark, d):
    return _verdicts(spark, {f"{k} {s}": (lambda k=k, s=s: policy.Policy(k).check(s) or "allowed") for k in _ALLOWED for s in _SHAPES})


@query("SELECT c_custkey FROM customer WHERE FALSE")
def policy_procedure_only(spark, d):
    return policy.Policy("procedure").visible(read_table(spark, d, "customer"), {}, "c_custkey").select("c_custkey")


@query(_values({"subject": "['s1']", "tenant": "['t1']", "groups": "['a', 'b']", "no groups": "[]", "no tenant": "[]"}))
def lookup_keys(spark, d):
    of = projections.lookup_keys
    context = {"subject": "s1", "tenant": "t1", "groups": ["b", "", "a", "b"]}
    return _verdicts(spark, {
        "subject": lambda: of(context, "subject"), "tenant": lambda: of(context, "tenant"), "groups": lambda: of(context, "groups"),
        "no groups": lambda: of({}, "groups"), "no tenant": lambda: of({"tenant": ""}, "tenant"),
    })


# History and compaction


@query(f"""
    WITH {EVENT_LOG_SQL}, h AS (SELECT least(greatest(0, max(seq) - 2999), 6500) AS horizon FROM log), t AS (
        SELECT log.*, horizon, max(CASE WHEN seq <= horizon THEN seq END) OVER (PARTITION BY user_id, event_type) AS newest FROM log, h)
    SELECT kind, horizon, count(*) AS n FROM t WHERE seq > horizon OR seq = newest GROUP BY ALL""")
def horizon_trim(spark, d):
    """The log that history of 3000 sequences needs while a snapshot holds 6500."""
    log = event_log(spark, d)
    at = visibility.horizon(feed.floor(log).first().newest, 3000, 6500)
    return visibility.trim(log, KEYS, at).groupBy(KIND).agg(F.lit(at).cast("long").alias("horizon"), F.count("*").alias("n"))


@query(f"WITH {EVENT_LOG_SQL} SELECT user_id, event_type, seq, kind FROM log WHERE seq >= 8000 OR coalesce(amount % 2 = 0 OR note = 'e11', TRUE)")
def compaction_filter(spark, d):
    keep = (F.col("amount") % 2 == 0) | (F.col("note") == "e11")
    return visibility.compact(event_log(spark, d), keep, 8000).select(*KEYS, SEQ, KIND)


@query(f"""
    WITH {EVENT_LOG_SQL}, g AS (SELECT *, sum(CASE WHEN kind = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS epoch FROM log),
    r AS (SELECT *, max(amount) OVER e AS most, string_agg(note, ',') OVER e AS notes,
                 last_value(active IGNORE NULLS) OVER e AS newest FROM g WINDOW e AS (PARTITION BY user_id, event_type, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_type, seq, CASE WHEN kind = 'merge' THEN most ELSE coalesce(amount, -1) END AS amount,
           CASE WHEN kind = 'merge' THEN notes ELSE coalesce(note, 'none') END AS note,
           coalesce(CAST(CASE WHEN kind = 'merge' THEN newest ELSE active END AS VARCHAR), 'none') AS active FROM r""")
def merge_rewrite_any(spark, d):
    operators = {"amount": merge.Extreme(), "note": merge.Append(","), "active": merge.LastNonNull()}
    found = visibility.rewrite_merges(event_log(spark, d), KEYS, operators, single=True)
    return _shown(found.select(*KEYS, SEQ, "amount", "note", "active"), amount=-1, note="none", active="none")


@query(f"""
    WITH {ITEM_LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, seq ORDER BY op_index DESC) AS r FROM items),
    m AS (SELECT l_suppkey, seq, CASE WHEN kind = 'put' AND seq % 3 = 0 THEN 'merge' ELSE kind END AS kind, quantity FROM l WHERE r = 1),
    g AS (SELECT *, sum(CASE WHEN kind = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY seq) AS epoch FROM m)
    SELECT l_suppkey, seq, kind = 'delete' AS gone, CASE WHEN kind = 'merge' THEN CAST(coalesce(sum(quantity) FILTER (kind <> 'delete') OVER (PARTITION BY l_suppkey, epoch ORDER BY seq), 0) AS BIGINT) ELSE quantity END AS quantity FROM g""")
def merge_rewrite_commits(spark, d):
    """Commits that touch a key several times are one operation of it before merges become puts."""
    log = item_log(spark, d).withColumn(KIND, F.when((F.col(KIND) == PUT) & (F.col(SEQ) % 3 == 0), MERGE).otherwise(F.col(KIND)))
    found = visibility.rewrite_merges(log, ["l_suppkey"], {"quantity": merge.Sum()})
    return found.select("l_suppkey", SEQ, (F.col(KIND) == DELETE).alias("gone"), "quantity")


@query(_RESOLVED + """
    SELECT user_id, event_type, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount, max(note) AS note, max(seq) AS seq FROM live GROUP BY ALL HAVING bool_or(kind <> 'delete')""")
def merge_heavy_keys(spark, d):
    """Keys with many rows are folded by partial aggregates, without meeting in one task."""
    return visibility.resolve(event_log(spark, d), KEYS, {"amount": merge.Sum(), "note": merge.Extreme()}, single=True, heavy=6)


# Keys


@query("SELECT c_custkey, printf('%016X', c_custkey) AS u64, printf('%04X', c_nationkey + 32768) AS i16, printf('%08X', c_nationkey - 12 + 2147483648) AS i32, c_custkey AS back FROM customer")
def codec_keys(spark, d):
    key = codecs.signed(F.col("c_custkey"))
    return read_table(spark, d, "customer").select(
        "c_custkey", F.hex(codecs.unsigned(F.col("c_custkey"))).alias("u64"), F.hex(codecs.signed(F.col("c_nationkey"), 2)).alias("i16"),
        F.hex(codecs.signed(F.col("c_nationkey") - 12, 4)).alias("i32"), codecs.read_signed(key).alias("back"),
    )


@query("SELECT c_custkey, printf('%08X', strlen(c_mktsegment)) || hex(encode(c_mktsegment)) || hex(encode(c_name)) AS entry, c_mktsegment AS lookup, c_name AS row_id FROM customer")
def codec_index_keys(spark, d):
    key = codecs.length_prefixed(F.col("c_mktsegment"), F.col("c_name"))
    lookup, row_id = codecs.split_prefixed(F.col("key"))
    rows = read_table(spark, d, "customer").select("c_custkey", key.alias("key"))
    return rows.select("c_custkey", F.hex("key").alias("entry"), lookup.cast("string").alias("lookup"), row_id.cast("string").alias("row_id"))


@query("SELECT o_orderkey, printf('%08X', o_orderkey % 4) || printf('%016X', o_orderkey) AS entry FROM orders")
def codec_entry_keys(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.hex(codecs.entry_key(F.col("o_orderkey") % 4, F.col("o_orderkey"))).alias("entry"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey - 700 DESC, o_orderkey) AS position FROM orders ORDER BY position LIMIT 200")
def composite_order_key(spark, d):
    """The order of text, a number descending and a number, by one binary key."""
    key = codecs.composite(codecs.escaped(F.col("o_orderpriority")), codecs.descending(codecs.signed(F.col("o_custkey") - 700)), codecs.unsigned(F.col("o_orderkey")))
    return projections.ranked_by(read_table(spark, d, "orders"), F.lit(0), key, F.col("o_orderkey"), 200).select(F.col("key").alias("o_orderkey"), "position")


@query("SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS points, row_number() OVER (ORDER BY floor(c_acctbal) DESC, c_nationkey, c_custkey) AS position FROM customer ORDER BY position LIMIT 30")
def leaderboard_folded(spark, d):
    """Points and a time folded into one primary key, the key's own order breaking ties."""
    points = F.floor("c_acctbal").cast("long")
    folded = codecs.composite(codecs.descending(codecs.signed(points)), codecs.unsigned(F.col("c_nationkey"), 4))
    return projections.ranked_by(read_table(spark, d, "customer"), F.lit(0), folded, F.col("c_custkey"), 30, points=points).withColumnRenamed("key", "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000004')")
def binary_prefix_scan(spark, d):
    rows = read_table(spark, d, "customer").select(F.col("c_name").cast("binary").alias("key"), "c_custkey", "c_name")
    return scan.scan_prefix(rows, ["key"], b"Customer#00000004").select("c_custkey", "c_name")


@query("""SELECT doc_id, lower('attrs:{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n":' || n_chars || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS term FROM documents""")
def canonical_json_terms(spark, d):
    term = scalar.json_term("attrs", source=F.col("source"), lang=F.col("lang"), n=F.col("n_chars"))
    return read_table(spark, d, "documents").select("doc_id", F.lower(term).alias("term"))


# Change data capture


@query(f"""
    WITH {CDC_SQL} SELECT printf('%08X', id % 4) || printf('%016X', event_id) AS entry, id, CASE WHEN {_IS} THEN 'entered' ELSE 'exited' END AS transition
    FROM cdc WHERE {_WAS} <> {_IS}""")
def cdc_transition_entries(spark, d):
    events = cdc_events(spark, d).withColumn("partition", F.col("id") % 4)
    return cdc.transition_entries(events, ATTENTION, "partition", "event_id").select(F.hex("entry").alias("entry"), "id", "transition")


_KEPT, _MIRRORED = f"tombstone OR {_WAS} OR {_IS}", f"NOT tombstone AND ({_IS} OR op IN ('u', 'd') OR {_WAS})"


@query(f"""
    WITH {CDC_SQL}, n AS (SELECT count(*) FILTER ({_KEPT}) AS l, count(*) FILTER ({_MIRRORED}) AS m FROM cdc)
    SELECT 'event_log' AS mode, 'log' AS output, l AS n FROM n UNION ALL SELECT 'mirror', 'mirror', m FROM n UNION ALL SELECT 'hybrid', 'log', l FROM n UNION ALL SELECT 'hybrid', 'mirror', m FROM n""")
def cdc_modes(spark, d):
    events, out = cdc_events(spark, d), None
    for mode in ("event_log", "mirror", "hybrid"):
        for name, rows in cdc.materialize(events, ATTENTION, mode).items():
            one = rows.agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), F.lit(name).alias("output"), "n")
            out = one if out is None else out.unionByName(one)
    return out


_MARKERS = ("false", "true", "first", "first_in_data_collection", "last", "last_in_data_collection", "incremental", None)
_PHASES = ("live", "initial", "first", "first", "last", "last_in_collection", "incremental", "live")


@query("WITH m AS (SELECT o_orderkey, o_orderkey % 8 AS i FROM orders) SELECT " + "CASE i " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHASES)) + " END AS phase, count(*) AS n FROM m GROUP BY ALL")
def cdc_snapshot_phases(spark, d):
    marker = F.element_at(F.array(*[F.lit(m).cast("string") for m in _MARKERS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read_table(spark, d, "orders").select(cdc.snapshot_phase(marker).alias("phase")).groupBy("phase").agg(F.count("*").alias("n"))


@query(f"""
    WITH {CDC_SQL}, s AS (SELECT *, event_id % 3 = 0 AS snap FROM cdc)
    SELECT 'all' AS policy, count(*) AS n FROM s UNION ALL SELECT 'no_snapshots', count(*) FILTER (NOT snap) FROM s
    UNION ALL SELECT 'no_snapshots_or_tombstones', count(*) FILTER (NOT snap AND NOT tombstone) FROM s UNION ALL SELECT 'derived', 0""")
def cdc_event_policies(spark, d):
    events = cdc_events(spark, d).withColumn("snapshot", F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"))
    names = ("all", "no_snapshots", "no_snapshots_or_tombstones", "derived")
    counted = events.agg(*[F.count_if(cdc.admits(p)).alias(p) for p in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("n")) for p in names])).alias("x")).select("x.*")


@query(f"WITH {CDC_SQL}, t AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'customers' ELSE 'parts' END AS source_table FROM cdc) SELECT source_table, op, count(*) AS n FROM t WHERE source_table IN ('orders', 'parts') GROUP BY ALL")
def cdc_table_filter(spark, d):
    names = F.element_at(F.array(F.lit("orders"), F.lit("customers"), F.lit("parts")), (F.col("event_id") % 3 + 1).cast("int"))
    events = cdc_events(spark, d).withColumn("source_table", names)
    return cdc.tables(events, ["orders", "parts"]).groupBy("source_table", "op").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'c' AS op, o_orderstatus AS status FROM orders")
def cdc_other_decoder(spark, d):
    """Envelopes of another kind, made usual by a decoder of their own."""
    raw = read_table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("INSERT "), "o_orderstatus").alias("value"))
    usual = lambda v: F.to_json(F.struct(F.lit("c").alias("op"), F.struct(F.substring_index(v, " ", -1).alias("status")).alias("after")))
    return cdc.decode_with(raw, usual, "status string").where("error IS NULL").select("o_orderkey", "op", F.col("after.status").alias("status"))


# Kafka


def _records(spark, d) -> DataFrame:
    return read_table(spark, d, "orders").select(
        F.lit("orders").alias("topic"), (F.col("o_custkey") % 3).cast("int").alias("partition"), F.col("o_orderkey").alias("offset"), "o_custkey", F.col("o_orderstatus").alias("status"),
    )


_RECORDS = "r AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS partition, o_orderkey AS \"offset\", o_custkey, o_orderstatus AS status FROM orders)"


@query(f"""
    WITH {_RECORDS}, k AS (SELECT * FROM r WHERE o_custkey % 7 <> 0),
    h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY "offset" DESC) AS n FROM k WHERE status <> 'P')
    SELECT 'progress' AS what, partition, max("offset") + 1 AS n FROM r GROUP BY ALL
    UNION ALL SELECT 'appended', partition, count(*) FROM k GROUP BY ALL
    UNION ALL SELECT 'mirrored', partition, CAST(sum("offset") AS BIGINT) FROM h WHERE n = 1 AND status = 'O' GROUP BY ALL""")
def kafka_ingest(spark, d):
    """Three batches, the second overlapping the first: appended and mirrored with the offsets beside them, every record once."""
    schemas = {
        "records": _table(topic="string", partition="int", offset="long", o_custkey="long", status="string"),
        "mirror": _table(o_custkey="long", partition="int", offset="long"), "offsets": _table(topic="string", partition="int", next_offset="long"),
    }
    db = Database(spark, new_folder(spark, "kafka"), schemas, {"records": ["topic", "partition", "offset"], "mirror": ["o_custkey"], "offsets": ["topic", "partition"]})
    kind = F.when(F.col("status") == "F", DELETE).when(F.col("status") == "O", PUT)
    last = read_table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    for low, high in ((0, last // 2), (last // 3, last // 2 + last // 4), (0, last)):
        kafka.ingest(db, _records(spark, d).where(f"offset > {low} AND offset <= {high} OR offset = {low}"), ["o_custkey"], F.col("o_custkey") % 7 != 0, kind)
    progress = visibility.current(db.log("offsets"), ["topic", "partition"]).select(F.lit("progress").alias("what"), "partition", F.col("next_offset").alias("n"))
    appended = db.log("records").groupBy("partition").agg(F.count("*").alias("n")).select(F.lit("appended").alias("what"), "partition", "n")
    mirror = visibility.current(db.log("mirror"), ["o_custkey"]).groupBy("partition").agg(F.sum("offset").alias("n")).select(F.lit("mirrored").alias("what"), "partition", "n")
    return progress.unionByName(appended).unionByName(mirror)


@query(f"WITH {_RECORDS} SELECT 'orders' AS topic, partition, CASE WHEN partition = 1 THEN 77 ELSE min(\"offset\") END AS start FROM r GROUP BY partition")
def kafka_start_positions(spark, d):
    bounds = _records(spark, d).groupBy("topic", "partition").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"))
    persisted = spark.createDataFrame([("orders", 1, 77)], "topic string, partition int, next_offset long")
    return kafka.start_positions(bounds, persisted, "earliest")


@query(f"WITH {_RECORDS} SELECT partition, \"offset\", CAST(o_custkey AS VARCHAR) AS key, status AS value FROM r WHERE status = 'F' AND o_custkey % 2 = 0")
def kafka_append_only(spark, d):
    """The records that a filter retains, keyed by partition and offset."""
    records = _records(spark, d).withColumns({"key": F.col("o_custkey").cast("string"), "value": F.col("status"), "timestamp": F.lit(None).cast("timestamp")})
    kept = kafka.retained(records, F.when(F.col("status") == "F", F.col("o_custkey") % 2 == 0))
    return kafka.as_append_only(kept).select("partition", "offset", "key", "value")


# Projections that follow tables


@query(f"WITH {ITEM_LOG_SQL} SELECT seq, count(*) AS rows, min(op_index) AS first, max(op_index) AS last FROM items WHERE seq > 4000 GROUP BY seq")
def sequence_runs(spark, d):
    return incremental.runs(item_log(spark, d), 4000)


@query(f"""
    WITH {ITEM_LOG_SQL}, {EVENT_LOG_SQL.strip()}, r AS (
        SELECT seq, 0 AS source_index, count(*) AS rows FROM items WHERE seq > 300 GROUP BY seq UNION ALL SELECT seq, 1, count(*) FROM log WHERE seq > 310 GROUP BY seq)
    SELECT * FROM r ORDER BY seq, source_index LIMIT 120""")
def source_schedule(spark, d):
    return incremental.scheduled([item_log(spark, d), event_log(spark, d)], [300, 310], 120)


def _followed(spark, d, compacted: bool = False, recompute: str = "fail"):
    """A projection that counts customers and orders by customer's nation, over the database of three commits, in an output database."""
    db = _database(spark, d)
    if compacted:
        db.compact()
    out = Database(
        spark, new_folder(spark, "output"), {"seen": _table(source="string", id="long", seq_seen="long"), incremental.FRONTIERS: incremental.FRONTIER_SCHEMA},
        {"seen": ["source", "id"], incremental.FRONTIERS: ["projection", "source"]},
    )

    def handler(logs):
        parts = [logs[s].select(F.lit(s).alias("source"), F.col(k).alias("id"), F.col(SEQ).alias("seq_seen"), OP, KIND) for s, k in (("customers", "c_custkey"), ("orders", "o_orderkey"))]
        newest = parts[0].unionByName(parts[1])
        head = newest.groupBy("source", "id").agg(F.max_by(F.struct("seq_seen", KIND), F.struct("seq_seen", OP)).alias("h"))
        return {"seen": head.select("source", "id", "h.seq_seen", F.lit(0).alias(OP), f"h.{KIND}")}

    return db, out, incremental.Projection("seen", {"customers": db, "orders": db}, out, handler, recompute, ["seen"])


_SEEN = """
    SELECT 'customers' AS source, c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 3 ELSE 1 END AS seq_seen FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey = 3
    UNION ALL SELECT 'orders', o_orderkey, 2 FROM orders"""


@query(_SEEN)
def projection_apply(spark, d):
    """Two sources followed commit by commit, outputs and frontier published together."""
    _, out, followed = _followed(spark, d)
    followed.run(1)
    return visibility.current(out.log("seen"), ["source", "id"]).select("source", "id", "seq_seen")


@query("SELECT * FROM (VALUES ('customers', 1, 1), ('orders', 1, 1), ('customers', 2, 2), ('orders', 2, 2), ('customers', 3, 3), ('orders', 3, 3)) AS t(source, step, frontier)")
def projection_frontiers(spark, d):
    """The frontier vector after each published step."""
    _, out, followed = _followed(spark, d)
    followed.run(1)
    return out.log(incremental.FRONTIERS).select("source", F.col(SEQ).cast("int").alias("step"), F.col("frontier").cast("int").alias("frontier"))


@query("SELECT source, id, 3 AS seq_seen FROM (" + _SEEN + ")")
def projection_rebuild(spark, d):
    """The sources' commits are gone into a compacted log: the outputs are cleared and made from current rows at one sequence."""
    _, out, followed = _followed(spark, d, True, "rebuild")
    out.append("seen", spark.createDataFrame([("orders", -1, 0)], "source string, id long, seq_seen long"))  # a stale row, which must go
    followed.run()
    return visibility.current(out.log("seen"), ["source", "id"]).select("source", "id", "seq_seen")


@query(_values({
    "too old": "SnapshotTooOld", "first of two": "['counts', 'top']", "direct": "[]", "only the last": "['top']", "cycle": "ValueError", "not followed": "ValueError",
}))
def frontier_waits(spark, d):
    """Which projections a reader must wait for, and what fails closed."""
    needs = {"top": ["counts"], "counts": []}
    at = {"counts": {"events": 5}, "top": {"events": 3}}
    wait = incremental.reached
    return _verdicts(spark, {
        "too old": lambda: _followed(spark, d, True)[2].run(), "first of two": lambda: wait(needs, at, "top", {"events": 9}), "direct": lambda: wait(needs, at, "counts", {"events": 5}),
        "only the last": lambda: wait(needs, at, "top", {"events": 4}), "cycle": lambda: wait({"a": ["b"], "b": ["a"]}, {}, "a", {}), "not followed": lambda: wait(needs, at, "top", {"orders": 1}),
    })


@query(f"""
    WITH {EVENT_LOG_SQL}, w AS (
        SELECT 'user' AS scope, CAST(user_id AS VARCHAR) AS id, seq, amount FROM log WHERE kind = 'put' UNION ALL SELECT 'type', event_type, seq, amount FROM log WHERE kind = 'put')
    SELECT scope, id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM w GROUP BY ALL""")
def projection_fan_out(spark, d):
    """A handler that writes two rows for each row it reads."""
    write = lambda scope, c: F.struct(F.lit(scope).alias("scope"), c.cast("string").alias("id"), F.col("amount").alias("amount"))
    found = projections.fan_out(event_log(spark, d).where("kind = 'put'"), F.array(write("user", F.col("user_id")), write("type", F.col("event_type"))), ["scope", "id"])
    return found.groupBy("scope", "id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("SELECT DISTINCT 'g' || c_nationkey % 4 AS lookup_key, c_custkey AS row_id, c_mktsegment AS mirror FROM customer WHERE c_custkey % 3 <> 0")
def visibility_fold(spark, d):
    """An index made by two functions: members that fold out of the source, and the grants that each expands to, twice."""
    fold = lambda rows: rows.where("c_custkey % 3 <> 0").withColumn("g", F.concat(F.lit("g"), (F.col("c_nationkey") % 4).cast("string")))
    grants = lambda m: m.select(F.explode(F.array("g", "g")).alias("lookup_key"), F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("mirror"))
    return projections.folded(read_table(spark, d, "customer"), fold, grants)


# Search

_CHUNKS = """
    RECURSIVE cut AS (
        SELECT doc_id, CAST(-1 AS INTEGER) AS chunk_index, '' AS chunk, coalesce(text, '') AS rest FROM documents
        UNION ALL
        SELECT doc_id, chunk_index + 1, left(rest, n), substr(rest, n + 1) FROM (
            SELECT *, CASE WHEN strlen(left(rest, 256)) = length(left(rest, 256)) THEN 256
                           ELSE list_max(list_filter(range(64, 257), lambda n: strlen(left(rest, CAST(n AS INTEGER))) <= 256)) END AS n FROM cut WHERE rest <> '')
    ), chunks AS (SELECT doc_id, chunk_index, chunk FROM cut WHERE chunk_index >= 0)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, chunk FROM chunks")
def text_chunks(spark, d):
    return search.chunks(read_table(spark, d, "documents"), "doc_id", "text")


@query(f"""
    WITH {_CHUNKS}, f AS (SELECT doc_id, arg_min(chunk, chunk_index) AS chunk FROM chunks WHERE contains(lower(chunk), 'the') AND contains(lower(chunk), 'and') GROUP BY doc_id)
    SELECT doc_id, substr(trim(regexp_replace(chunk, '\\s+', ' ', 'g')), 1, 120) AS snippet FROM f""")
def search_snippet(spark, d):
    parts = search.chunks(read_table(spark, d, "documents"), "doc_id", "text")
    return search.snippets(parts, "doc_id", ["the", "and"])


@query(f"""
    WITH {_CHUNKS}, t AS (
        SELECT DISTINCT doc_id, 'text' AS kind, lower(x) AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(chunk, '[^A-Za-z0-9]+')) AS x FROM chunks) WHERE x <> ''
        UNION ALL SELECT doc_id, 'metadata', lower('lang:{{"v":"' || lang || '"}}') FROM documents WHERE lang IS NOT NULL
        UNION ALL SELECT doc_id, 'number', 'n_chars:' || lpad(CAST(n_chars AS VARCHAR), 20, '0') FROM documents WHERE n_chars IS NOT NULL
        UNION ALL SELECT doc_id, 'tag', 'tag:' || lower(source) FROM documents WHERE source IS NOT NULL)
    SELECT kind, term, count(*) AS n FROM t GROUP BY ALL""")
def search_index_build(spark, d):
    docs = read_table(spark, d, "documents")
    exact = F.when(F.col("lang").isNotNull(), F.col("lang"))
    found = search.index_terms(docs.where("lang IS NOT NULL"), "doc_id", {"lang": exact}, {"n_chars": F.col("n_chars")}, F.array("source"), search.chunks(docs, "doc_id", "text"))
    return found.groupBy("kind", "term").agg(F.count("*").alias("n"))


# Shards


_CRC = """
    crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) ORDER BY i) AS t FROM range(0, 256) r(i))"""


@query(f"""
    WITH {_CRC}, k AS (SELECT CAST(o_orderkey AS VARCHAR) AS s FROM orders),
    c AS (SELECT xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT)),
                                 lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM k, crc_table)
    SELECT CAST(crc % 64 % 5 AS INTEGER) AS shard, count(*) AS n FROM c GROUP BY ALL""")
def shard_route_counts(spark, d):
    part = scalar.route(F.col("o_orderkey").cast("string"), 64)
    rows = read_table(spark, d, "orders").select(scalar.shard_of(part, [i % 5 for i in range(64)]).alias("shard"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


# Workflows


def _runs(spark, d):
    return read_table(spark, d, "events").select((F.col("user_id") % 40).alias("run_id"), F.col("event_id").alias("at"), "event_type", "value")


@query("""
    WITH p AS (SELECT event_id + 1 AS seq, user_id % 40 AS run_id FROM events WHERE event_type IN ('click', 'view') AND event_id + 1 > 1000 AND event_id + 1 <= 3000 ORDER BY seq LIMIT 400)
    SELECT run_id, seq, 10 + row_number() OVER (PARTITION BY run_id ORDER BY seq) AS nth FROM p WHERE run_id <> 7""")
def source_admission(spark, d):
    """A page of a durable feed, routed to runs and numbered behind what their inboxes have."""
    log = event_log(spark, d).where("event_type IN ('click', 'view')").select("user_id", SEQ, OP)
    page = feed.changes_since(log, (1000, 0), 3000, 400)
    run_id = F.when(F.col("user_id") % 40 != 7, F.col("user_id") % 40)
    waiting = spark.range(40).select(F.col("id").alias("run_id"), F.lit(10).cast("long").alias("nth"))
    return workflow.admitted(page, run_id, waiting).select("run_id", SEQ, "nth")


@query(_values({"beginning": 0, "current": 90, "checkpoint": 50, "checkpoint gone": "SnapshotTooOld", "fast forward": 59, "replay": 0, "none yet": 0, "unknown": "ValueError"}))
def recovery_policies(spark, d):
    at = workflow.start_cursor
    return _verdicts(spark, {
        "beginning": lambda: at("beginning", 90), "current": lambda: at("current", 90), "checkpoint": lambda: at("checkpoint", 90, 50, 20),
        "checkpoint gone": lambda: at("checkpoint", 90, 50, 60), "fast forward": lambda: at("fast_forward", 90, 50, 60), "replay": lambda: at("replay", 90, 50, 60),
        "none yet": lambda: at("checkpoint", 90), "unknown": lambda: at("other", 90),
    })


@query("""
    WITH t AS (SELECT event_id AS run_id, event_type FROM events WHERE event_id < 500), s AS (SELECT run_id, event_type, CASE WHEN run_id % 2 = 0 THEN run_id % 5 END AS state FROM t)
    SELECT 'state' AS output, run_id, CAST(coalesce(state, 0) + 1 AS VARCHAR) AS detail FROM s
    UNION ALL SELECT 'outbox', run_id, event_type || '!' FROM s WHERE event_type <> 'error' UNION ALL SELECT 'outbox', run_id, 'done' FROM s WHERE event_type <> 'error'
    UNION ALL SELECT 'timers', run_id, CAST(run_id + 10 AS VARCHAR) FROM s WHERE coalesce(state, 0) > 2""")
def workflow_step(spark, d):
    """Triggers against run states: new states, messages and timers from one handler of expressions."""
    triggers = read_table(spark, d, "events").where("event_id < 500").select(F.col("event_id").alias("run_id"), "event_type")
    state = triggers.where("run_id % 2 = 0").select("run_id", (F.col("run_id") % 5).alias("state"))
    before = F.coalesce("state", F.lit(0))
    messages = F.when(F.col("event_type") != "error", F.array(F.concat("event_type", F.lit("!")), F.lit("done")))
    found = workflow.step(triggers, state, before + 1, messages, F.when(before > 2, F.array(F.col("run_id") + 10)))
    columns = {"state": "state", "outbox": "message", "timers": "fire_at"}
    parts = [found[n].select(F.lit(n).alias("output"), "run_id", F.col(c).cast("string").alias("detail")) for n, c in columns.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, event_id + unnest([1, 2, 4, 8, 16]) * 60 AS fire_at FROM events WHERE event_type = 'signup'")
def recurring_custom(spark, d):
    """A handler that doubles its interval."""
    rows = read_table(spark, d, "events").where("event_type = 'signup'").select("event_id")
    return workflow.recurring_by(rows, F.transform(F.array(*[F.lit(1 << i) for i in range(5)]), lambda n: F.col("event_id") + n * 60))


@query("""
    WITH r AS (SELECT user_id % 40 AS run_id, event_id, event_type FROM events)
    SELECT run_id, count(*) FILTER (event_type = 'click') AS steps, coalesce(max(event_id) FILTER (event_type = 'click'), -1) AS last_at,
           count(*) FILTER (event_type = 'view') AS waiting, count(*) FILTER (event_type = 'error') AS due FROM r GROUP BY run_id""")
def run_describe(spark, d):
    rows = _runs(spark, d)
    of = lambda kind: rows.where(F.col("event_type") == kind)
    return _shown(workflow.describe(rows.select("run_id").distinct(), of("click"), of("view"), of("error")), last_at=-1)


@query("SELECT event_id AS at, event_type FROM events WHERE user_id % 40 = 11 AND event_id > 300 ORDER BY event_id LIMIT 20")
def run_history(spark, d):
    return workflow.history(_runs(spark, d), 11, 300, 20).select("at", "event_type")


@query("""
    SELECT kind, "at", detail FROM (
        SELECT CASE event_type WHEN 'click' THEN 'inbox' WHEN 'view' THEN 'journal' ELSE 'timer' END AS kind, event_id AS "at", event_type AS detail, user_id % 40 AS run_id FROM events
        WHERE event_type IN ('click', 'view', 'error')) WHERE run_id = 9""")
def run_forensics(spark, d):
    rows = _runs(spark, d).withColumnRenamed("event_type", "detail")
    inbox, journal, timers = [rows.where(F.col("detail") == k) for k in ("click", "view", "error")]
    return workflow.forensics(9, inbox, journal, timers).select("kind", "at", "detail")


@query("SELECT event_id AS run_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'none') AS lifecycle, coalesce(CASE WHEN event_type <> 'error' THEN user_id END, -1) AS steps, event_type <> 'error' AS accepted FROM events")
def run_query(spark, d):
    runs = read_table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("lifecycle"), F.col("user_id").alias("steps"))
    return _shown(workflow.run_query(runs, "execution", closed=("error",)), lifecycle="none", steps=-1)
