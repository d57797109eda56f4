"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct 5-word shingles, by 64-bit hash. Equal sets are one node.
A node's sketch is its K smallest hashes. Inverted lists of retained values propose pairs, the union
sketch of a pair filters them, and the full sets decide.

A pair at or above the threshold shares retained values except with a probability far below one in
a billion (``_least``). Lists are never expanded into all pairs:

* a list proposes each member with its leader; links make components, and only members of different components matter further;
* values that more than HOT nodes retain are hot. Nodes whose sketches they do not dominate are found by
  their other values alone, so passages that many documents share propose nothing;
* what is left, members of different components in one list, is compared exhaustively: in lists of
  at most HOT members by a join, in larger ones by cells of two bounded blocks that hold the members' full sets. A cell
  gives a forest of its links, fewer rows than it has members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.hashing import byte_groups, hash_words, joined, mix
from palimpsest.llm.shared import Workspace, fresh, hand_back, lean, settle, spread_join, system_memory
from palimpsest.llm.tables import Table

WORDS = 5
#: Link at intersection / union of at least so many percent.
PERCENT = 75
#: A value is hot that more nodes retain.
HOT = 24
#: Leaders that a list's members may have. Which one a list takes depends on its value, so a member of several lists meets several.
STAR_ROUNDS = 3
#: Members of a block of a hot list and their shingles, and the ratio of sizes of a size class: sizes that can be linked are in one or in neighbouring classes.
BLOCK, BLOCK_SHINGLES = 4_096, 1_000_000
SIZE_CLASS = 4 / 3
MISS = 1e-9
#: Keys of texts that are looked up where the texts are scanned, 8 bytes each in a file of every machine; more are joined.
MAPPED_KEYS = 50_000_000


def _least(k: int, percent: int = PERCENT) -> int:
    """The least overlap of a union sketch of ``k`` values that keeps all but MISS of the pairs at the threshold."""
    p, below = percent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if below > MISS:
            return m
    return k


@dataclass(frozen=True)
class Plan:
    """How pairs are proposed.

    ``k`` hashes make a sketch. ``plain`` of a node's values are
    listed, enough that a pair above the threshold shares one, and ``shared`` of them at least; all its cold values if
    over ``mixed`` of its sketch is hot; and ``dominated_values`` hot ones too if over ``dominated`` is, so much that a
    pair might share hot values only.
    """

    k: int = 64
    plain: int = 24
    shared: int = 3
    mixed: float = 0.2
    dominated: float = (_least(64) - 1) / 64
    dominated_values: int = 16


DOCUMENTS = Plan()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    data, starts = joined(texts)
    if not len(data):
        return [np.zeros(0, np.int64) for _ in texts]
    hashes, at = hash_words(_FOLD[data], _INSIDE[data])
    bounds = np.searchsorted(at, np.append(starts, len(data)))
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * _FACTOR + hashes[j : j + len(rolled)]
    rolled = mix(rolled).view(np.int64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = np.uint64((int(whole) * int(_FACTOR) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([whole], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def digest_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame, words: int = WORDS, k: int = DOCUMENTS.k) -> DataFrame:
    """``row, doc_id, key, n_shingles, digest, sketch`` of (row, doc_id, key, text) rows."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            texts = table.column(3).to_pylist()
            for a, b in byte_groups(texts):
                sets = shingle_sets(texts[a:b], words)
                digests = list(map(digest_of, sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for c in table.columns[:3]), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()), pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "key", "n_shingles", "digest", "sketch"],
                )

    return rows.mapInArrow(lean(run), "row long, doc_id long, key long, n_shingles long, digest binary, sketch array<long>")


def full_sets(texts: DataFrame, keys: Table | None, words: int = WORDS) -> DataFrame:
    """``digest, shingles`` of (key, text) rows, by a scan. Only texts whose key is in ``keys`` are shingled (all, if that is
    None), repeated ones of a task once."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for table in tables:
            own = table.column(0).to_numpy()
            some = np.flatnonzero(keys.has(own)) if keys is not None else np.arange(len(own))
            _, first = np.unique(own[some], return_index=True)
            some = [i for i in some[np.sort(first)].tolist() if int(own[i]) not in done]
            if len(done) > 1_000_000:
                done.clear()
            done.update(int(own[i]) for i in some)
            texts_ = table.column(1).take(pa.array(some, pa.int64())).to_pylist()
            for a, b in byte_groups(texts_):
                sets = shingle_sets(texts_[a:b], words)
                digests = list(map(digest_of, sets))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    return texts.mapInArrow(lean(run), "digest binary, shingles array<long>")


def sets_by_scan(texts: DataFrame, ends: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``node, body`` of ``ends`` (node, key, digest), the body being the set, found among ``texts`` (key, text) by key and then by digest."""
    wanted = work.stage(ends, f"ends-{name}")
    if wanted.count() <= MAPPED_KEYS:
        found = full_sets(texts, Table.write(wanted.select("key").distinct(), work, f"keys-{name}"))
    else:
        found = full_sets(texts.join(wanted.select("key").distinct(), "key", "left_semi"), None)
    one = found.groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = work.stage(one.join(wanted.select("node", "digest"), "digest").select("node", F.col("shingles").alias("body")), f"bodies-{name}")
    work.drop(f"ends-{name}", f"keys-{name}")
    return sets


def as_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of sets, as they are."""
    found = column.combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    bounds, values = found.offsets.to_numpy(), found.values.to_numpy()
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _forest(k: int, percent: int, sets_of: Callable[[pa.ChunkedArray], list[np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
    """What finds a cell's links. Members have ``side`` 0 (met by others), 1 (meet them) or 2 (both), and a ``body`` that gives their set."""
    least = _least(k, percent)

    def run(table: pa.Table) -> pa.Table:
        system_memory()
        table = table.combine_chunks()
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        component = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        own = sets_of(table.column("body"))
        sizes = np.array([len(x) for x in own], np.int64)
        left, right = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
        out: list[tuple[int, int]] = []

        def gathered(parts: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            together, owner = np.concatenate(parts), np.repeat(of, [len(x) for x in parts])
            order = np.argsort(together, kind="stable")
            return together[order], owner[order]

        def shared(mine: np.ndarray, gathered_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            """How many of ``mine`` each member has."""
            together, owner = gathered_
            lo, hi = np.searchsorted(together, mine), np.searchsorted(together, mine, "right")
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            return np.bincount(owner[at], minlength=len(own))

        def near(i: int, among: np.ndarray) -> np.ndarray:
            small, large = np.minimum(sizes[among], sizes[i]), np.maximum(sizes[among], sizes[i])
            return among[(component[among] != component[i]) & (100 * small >= percent * large)]

        if len(left) and len(right):
            sketches_, whole = gathered([own[j][:k] for j in right], right), None
            for i in left.tolist():
                if not len(near(i, right)):
                    continue
                alike = shared(own[i][:k], sketches_)
                among = near(i, right[(alike[right] >= least) | (sizes[right] <= k) | (sizes[i] <= k)])
                if len(among) > 16:
                    if whole is None:
                        whole = gathered([own[j] for j in right], right)
                    both = shared(own[i], whole)[among]
                else:
                    both = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for j in among], np.int64)
                for j in among[100 * both >= percent * (sizes[among] + sizes[i] - both)].tolist():
                    if component[j] != component[i]:
                        out.append((min(node[i], node[j]), max(node[i], node[j])))
                        component[component == component[j]] = component[i]
        hand_back()
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(y) for _, y in out], pa.int64())})

    return run


class Linker:
    """One run over nodes.

    ``nodes`` are (node, n, sketch), and ``bodies(ends, name)`` gives the stored (node, body) of
    the nodes in a table's ``node`` column: their sets, or what ``sets_of`` makes sets from. ``exact`` says that ``n`` is the size of the set; else it is
    a bound of it. ``leaders`` is how many leaders a list's members may have.
    """

    exact = True
    sets_of = staticmethod(as_sets)

    def __init__(self, nodes: DataFrame, bodies: Callable[[DataFrame, str], DataFrame], work: Workspace, percent: int, plan: Plan = DOCUMENTS) -> None:
        self.nodes, self.bodies, self.work, self.percent, self.plan = nodes, bodies, work, percent, plan
        self.leaders = STAR_ROUNDS

    def values(self) -> DataFrame:
        """``node, values``: what the nodes may be listed under."""
        return self.nodes.select("node", F.col("sketch").alias("values"))

    def repeated(self) -> DataFrame:
        """``node, pos, value, hot`` of the elements of ``values`` that several nodes have, stored."""
        values = self.values()
        entries = values.select("node", F.posexplode("values").alias("pos", "value"))
        counted = entries.groupBy("value").agg(F.count("*").alias("count")).where("count > 1")
        counted = self.work.stage(counted.select("value", "count", (F.col("count") > HOT).alias("hot")), "counted")
        n, total = counted.agg(F.count("*"), F.sum("count")).first()
        if n <= MAPPED_KEYS:
            # Most values are of one node alone: they are left out where they are read.
            table = Table.write(counted.select(F.col("value").alias("key")), self.work, "repeated")

            def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in tables:
                    for at in range(0, len(batch), 20_000):
                        part = batch.slice(at, 20_000)
                        lists = part.column(1)
                        own, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                        some = np.flatnonzero(table.has(own))
                        node = np.repeat(part.column(0).to_numpy(), sizes)[some]
                        pos = (np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[some].astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, pos, own[some])], names=["node", "pos", "value"])

            entries = values.mapInArrow(lean(run), "node long, pos int, value long")
        settle(self.work.spark)
        found = self.work.stage(spread_join(entries, counted, "value", "count", total or 0), "entries")
        self.work.drop("counted", "repeated")
        settle(self.work.spark)
        return found

    def lists(self) -> DataFrame:
        """``value, node, n, hot, plain`` of the listed values that several nodes retain, stored.

        Values of one node alone are gone after the count; their places still count in a node's first ``plain``.
        """
        plan = self.plan
        repeated = self.repeated()
        own = repeated.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "value", "hot"))).alias("all"))
        own = own.join(self.nodes.select("node", "n"), "node").withColumn("size", F.least("n", F.lit(plan.k)))
        own = own.select("node", "n", "size", "all", F.filter("all", lambda e: e["hot"]).alias("hots"))
        share = F.size("hots") / F.col("size")
        cold_before = lambda e: e["pos"] - F.size(F.filter("hots", lambda h: h["pos"] < e["pos"]))
        plain = F.filter("all", lambda e: ~e["hot"] & (cold_before(e) < plan.plain))
        kept = F.when(share <= plan.mixed, plain).otherwise(F.filter("all", lambda e: ~e["hot"]))
        hots = F.when(share > plan.dominated, F.slice("hots", 1, plan.dominated_values)).otherwise(F.slice("hots", 1, 0))
        is_plain = (share <= plan.mixed) & (F.col("size") - F.size("hots") >= plan.plain)
        listed = own.select("node", "n", is_plain.alias("plain"), F.explode(F.concat(kept, hots)).alias("e"))
        lists = self.work.stage(listed.select("e.value", "e.hot", "node", "n", "plain"), "lists")
        self.work.drop("entries")
        return lists

    def sized(self, x: Column, y: Column) -> Column:
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y) if self.exact else F.lit(True)

    def star(self, lists: DataFrame) -> DataFrame:
        """Pairs of each member with its list's leader, the member of smallest hash."""
        ranked = lists.withColumn("h", F.xxhash64("node", F.pmod("value", F.lit(self.leaders))))
        heads = ranked.groupBy("value").agg(F.min(F.struct("h", "node", "n")).alias("head"), F.count("*").alias("members"))
        total = lists.count()
        both = spread_join(lists, heads, "value", "members", total).where((F.col("node") != F.col("head.node")) & self.sized(F.col("n"), F.col("head.n")))
        return both.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()

    def opened(self, lists: DataFrame, of: DataFrame | None) -> DataFrame:
        """``lists`` with each member's component, without the lists of one component, stored."""
        if of is None:
            return lists.withColumn("component", F.col("node"))
        both = lists.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        both = self.work.stage(both, "labelled")
        several = both.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
        found = spread_join(both, several.where("x < y").select("value", "members"), "value", "members", lists.count())
        found = self.work.stage(found, "open")
        self.work.drop("labelled", "lists")
        return found

    def met(self, lists: DataFrame) -> DataFrame:
        """Pairs of members of different components in the lists that are not hot."""
        cold = lists.where("not hot").select("value", "node", "n", "component", "plain")
        other = cold.select("value", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_component"), F.col("plain").alias("b_plain"))
        pairs = cold.join(other, "value").where((F.col("node") < F.col("b")) & (F.col("component") != F.col("b_component")) & self.sized(F.col("n"), F.col("b_n")))
        # Two plain nodes above the threshold share several lists, so one alone says nothing.
        pairs = pairs.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"), F.first(F.col("plain") & F.col("b_plain")).alias("both_plain"))
        return pairs.where(~F.col("both_plain") | (F.col("shared") >= self.plan.shared)).select("a", "b")

    def cells(self, hot: DataFrame) -> DataFrame:
        """The links between different components in hot lists, found cell by cell.

        A list of one block is one cell, to which each member goes once. In a larger one, members are dealt to blocks by size class and by
        hash, and those outside the list's largest component meet all of their own class and the next ones. So no task sees more than two blocks.
        """
        per = hot.groupBy("value", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"))
        per = per.groupBy("value").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.sum("s").alias("s"), F.sum("sign").alias("sign"))
        # Values of one passage have the same members, who need to meet once.
        per = per.groupBy("all", "sign", "s").agg(F.min("value").alias("value"), F.min_by("main", "value").alias("main"))
        slots = lambda n, s: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
        per = per.select("value", F.col("main.component").alias("main"), F.col("all").alias("members"), (slots(F.col("all"), F.col("s")) == 1).alias("small"))
        per = self.work.stage(per, "parts")
        own = spread_join(hot, per, "value", "members", hot.count())
        size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(SIZE_CLASS) + 1e-12).cast("int")
        own = self.work.stage(own.withColumns({"size": size if self.exact else F.lit(0), "minor": F.col("component") != F.col("main")}), "members")
        bodies = self.bodies(own.select("node"), "hot")
        columns = ["value", "node", "component"]
        zero = [F.lit(0).alias(c) for c in ("y", "i", "j")]
        placed = own.where("small").select(*columns, *zero, F.when(F.col("minor"), 2).otherwise(0).alias("side"))
        large = own.where("NOT small")
        if large.take(1):
            reach = math.ceil(math.log(100 / self.percent) / math.log(SIZE_CLASS) - 1e-9) if self.exact else 0
            dealt = large.groupBy("value", F.col("size").alias("y")).agg(F.count("*").alias("n"), F.sum("n").alias("s"))
            dealt = dealt.select("value", "y", slots(F.col("n"), F.col("s")).alias("slots"))
            near = large.where("minor").withColumn("y", F.explode(F.sequence(F.col("size") - reach, F.col("size") + reach)))
            guests = near.groupBy("value", "y").agg(F.count("*").alias("n"), F.sum("n").alias("s"))
            # A class that no member outside the main component meets has nothing to compare. Value and class are few keys beside the members.
            dealt = self.work.stage(dealt.join(guests, ["value", "y"]).select("value", "y", "slots", slots(F.col("n"), F.col("s")).alias("guests")), "dealt")
            slot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
            each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
            minor = near.join(dealt, ["value", "y"]).select(*columns, "y", slot(F.col("guests")).alias("i"), each(F.col("slots")).alias("j"), F.lit(1).alias("side"))
            every = large.withColumn("y", F.col("size")).join(dealt, ["value", "y"])
            every = every.select(*columns, "y", each(F.col("guests")).alias("i"), slot(F.col("slots")).alias("j"), F.lit(0).alias("side"))
            placed = placed.unionByName(minor).unionByName(every)
        links = placed.join(bodies, "node").groupBy("value", "y", "i", "j").applyInArrow(_forest(self.plan.k, self.percent, self.sets_of), "a long, b long")
        links = self.work.stage(links.distinct(), "links-hot")
        self.work.drop("parts", "members", "dealt", "bodies-hot")
        return links

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the filter by union sketch."""
        k = self.plan.k
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
        met = pairs.join(a, "a").join(b, "b")
        met = met.select("a", "b", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k).alias("u"), F.array_intersect("sa", "sb").alias("i"))
        overlap = F.size(F.array_intersect("u", "i"))
        whole = 100 * overlap >= self.percent * F.size("u")
        return met.where(F.when(F.size("u") < k, whole).otherwise(overlap >= _least(k, self.percent))).select("a", "b")

    def tested(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that pass the filter and the full sets."""
        pairs = self.work.stage(pairs, f"pairs-{name}")
        settle(self.work.spark)
        likely = self.work.stage(self.likely(pairs), f"likely-{name}")
        bodies = self.bodies(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))), name)
        both = likely.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("bb")), "b").join(bodies.select(F.col("node").alias("a"), F.col("body").alias("ba")), "a")
        linked = self.work.stage(self.verified(both), f"links-{name}")
        self.work.drop(f"bodies-{name}", f"likely-{name}")
        settle(self.work.spark)
        return linked

    def verified(self, both: DataFrame) -> DataFrame:
        """The pairs (a, b, ba, bb) whose sets are similar enough."""
        both = both.select("a", "b", F.size(F.array_intersect("ba", "bb")).alias("shared"), (F.size("ba") + F.size("bb")).alias("all"))
        return both.where(100 * F.col("shared") >= self.percent * (F.col("all") - F.col("shared"))).select("a", "b")

    def run(self) -> DataFrame:
        """``node, component`` of every linked node, stored."""
        lists = self.lists()
        settle(self.work.spark)
        links, of = [], None
        if self.leaders:
            links.append(self.tested(self.star(lists), "star"))
            of = self.work.stage(components(links[0], self.work, "rounds-star"), "components-star")
        lists = self.opened(lists, of)
        settle(self.work.spark)
        pairs = self.met(lists)
        if self.leaders:
            pairs = pairs.join(self.work.read(pairs, "pairs-star"), ["a", "b"], "left_anti")
        links.append(self.tested(pairs, "rest"))
        hot = lists.where("hot")
        if hot.take(1):
            settle(self.work.spark)
            links.append(self.cells(hot))
        self.work.drop("open", "lists", "pairs-star", "pairs-rest")
        if of is not None and not any(x.take(1) for x in links[1:]):
            return of
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        return self.work.stage(components(every, self.work, "rounds"), "components")


def near_duplicates(docs: DataFrame, spark: SparkSession, text: str = "text", percent: int = PERCENT, plan: Plan = DOCUMENTS, row: str | None = None) -> DataFrame:
    """Every row's component of near-duplicates: ``row, doc_id, n_shingles, component_id, kept, component``.

    The component is the smallest doc_id reachable over links of at least ``percent``
    per cent; equal sets are linked, and rows without words are linked with nothing. ``kept`` is
    ``doc_id = component_id``; a null doc_id counts as last, and a component of null ids alone has a null component_id.
    ``component`` tells components apart whatever their ids; it is null without words. Repeated rows get a row each, ties are one
    component, very long texts are one set each. An empty table gives no rows. ``row`` names a column of ``docs`` with a long of each row's
    own; without one rows are numbered. Other columns are not read.
    """
    work = Workspace(spark, "near")
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    texts = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text(docs, text)).alias("key"), _text(docs, text).alias("text"))
    signed = work.stage(sketches(texts, k=plan.k), "sketches")
    found = work.stage(signed.drop("sketch"), "found")
    full, empty = found.where("n_shingles > 0"), found.where("n_shingles = 0")
    first = F.min(F.struct("row", "key", "n_shingles")).alias("first")
    equal = full.groupBy("digest").agg(first, F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    equal = work.stage(equal.select("digest", F.col("first.row").alias("node"), F.col("first.key").alias("key"), F.col("first.n_shingles").alias("n"), "least", "copies"), "equal")
    nodes = signed.select(F.col("row").alias("node"), "sketch").join(equal.select("node", "n"), "node")
    nodes = work.stage(nodes, "nodes")
    work.drop("sketches")
    settle(spark)

    def sets(ends: DataFrame, name: str) -> DataFrame:
        ends = equal.select("node", "key", "digest").join(ends, "node", "left_semi")
        return sets_by_scan(texts.select("key", "text"), ends, work, name)

    linked = Linker(nodes, sets, work, percent, plan).run()
    work.drop("nodes")
    settle(spark)
    of = equal.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = work.stage(of.join(least, "component").select("digest", "component", "component_id", "copies"), "labels")
    columns = ["row", "doc_id", "n_shingles", "component_id", "component"]
    out = spread_join(full, labels, "digest", "copies", full.count()).select(columns)
    out = out.unionByName(empty.select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, spark: SparkSession, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: of its smallest doc_id (null last) the first row. Rows
    without words, of null and empty texts too, stay. Repeated rows are one component; documents are told apart by their
    texts alone, so equal or null ids of different texts lose nothing. An empty table gives no rows. All columns come back and no others, whatever their names.

    The rows are written with a number each before they are compared, so that they are the same rows whenever they are read again.
    """
    row = fresh("__row", docs.columns)
    numbered = Workspace(spark, "near-rows").stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, spark, text, row=row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first).select(F.col("first.row").alias(row))
    kept = kept.unionByName(found.where("component IS NULL").select(F.col("row").alias(row)))
    return numbered.join(kept, row, "left_semi").drop(row)
