"""Toxicity by class-conditional Kneser-Ney models.

One bigram model for toxic and one for ordinary documents. Each discounts its counts of a word after a context and
gives the freed mass to its word model; that discounts its own word counts and gives the freed mass to a backoff
distribution that both share: how many different left neighbours
a word has in the whole labelled corpus. So a word that is rare in either class is judged by the same
backoff counts and says little, while an expression that only toxic documents use says much, though each of its
words be ordinary.

A document is scored by the toxic minus the ordinary log-likelihood for each word, as
means over its passages, its most toxic words and the whole, by the bigrams and by the words alone, and a logistic fit makes that a probability.

Words and pairs of neighbours are counted exactly, by 64-bit hash, in Spark aggregates that grow with the corpus. The
ratios are a sorted table in files; every Python worker maps a local copy of it, so nothing of it passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.hashing import byte_groups, hash_words, joined, mix
from palimpsest.llm.language import _FOLD
from palimpsest.llm.shared import Workspace, held_out, lean, settle, settle_fully
from palimpsest.llm.tables import Table

DISCOUNT = 0.75
#: Bytes of texts that are taken together, and pairs of words that a task adds up before it hands them on.
GROUP_BYTES = 500_000
COUNTED_PAIRS = 2_000_000
#: Last bits of a pair's key, which depend on both words; the first are the context's.
KEY_BITS = 44
#: Words of a passage, and sizes of the sets of a text's most toxic words, wherever they are.
PASSAGES = (1, 5)
WORST = (3,)
#: Documents that fit the probability, a bound; they alone are not counted by the models.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Of each of the two levels, bigrams and words.
LEVEL_MEASURES = len(PASSAGES) + len(WORST) + 1
MEASURES = 2 * LEVEL_MEASURES

_COUNTS = "before long, word long, toxic long, ordinary long"


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all texts' words and of the word before each (0 at the start of a text), and the text that each is in.
    Words are runs of letters, case aside."""
    data, starts = joined(texts)
    folded = _FOLD[data]
    hashes, at = hash_words(folded, folded != 32)
    owner = np.searchsorted(starts, at, side="right") - 1
    hashes = hashes.view(np.int64)
    return hashes, np.where(np.diff(owner, prepend=-1) != 0, 0, np.roll(hashes, 1)), owner


def _count(texts: DataFrame, labels: Table) -> DataFrame:
    """Class counts of each word after each left neighbour in ``texts`` (doc_id, text), in ranges of ``bucket``, a
    context's first bits. ``labels`` has how often a document is labelled with each class."""

    names = [x.split()[0] for x in _COUNTS.split(", ")]

    def added(parts: list[tuple]) -> list[np.ndarray]:
        before, hashes, *each = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((hashes, before))
        before, hashes = before[order], hashes[order]
        first = np.flatnonzero((np.diff(hashes, prepend=hashes[0] + 1) != 0) | (np.diff(before, prepend=before[0]) != 0))
        return [before[first], hashes[first], *(np.add.reduceat(x[order], first) for x in each)]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for table in tables:
            ids = table.column(0).to_numpy()
            weight = np.stack([labels.get(ids, i, 0.0) for i in (0, 1)]).astype(np.int32)
            chosen = np.flatnonzero(weight.sum(axis=0))
            weight, texts_ = weight[:, chosen], table.column(1).take(pa.array(chosen)).to_pylist()
            for a, b in byte_groups(texts_, GROUP_BYTES):
                hashes, before, owner = words(texts_[a:b])
                if len(hashes):
                    parts.append((before, hashes, *weight[:, a:b][:, owner]))
                    held += len(hashes)
                if held > COUNTED_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in added(parts)], names=names)
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in added(parts)], names=names)

    found = texts.mapInArrow(lean(run), _COUNTS).withColumn("bucket", F.shiftright("before", KEY_BITS)).repartitionByRange("bucket")
    return found.groupBy("bucket", "before", "word").agg(*[F.sum(c).cast("long").alias(c) for c in ("toxic", "ordinary")])


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash of each pair of hashes, in the order of the context's first bits."""
    low = np.int64((1 << KEY_BITS) - 1)
    return (before & ~low) | ((mix(before.view(np.uint64)).view(np.int64) ^ word) & low)


@dataclass(frozen=True)
class Ratios:
    """Log of P(word | before, toxic) / P(word | before, ordinary).

    ``words`` has ``ratio`` of each word alone, for others ``unseen``, and ``context``, the log ratio of the masses that
    the two classes free after it. Where a pair of words does not occur its ratio is the sum of both; ``pairs`` has what the others differ from that by.
    """

    words: Table
    pairs: Table
    unseen: float

    def alone(self, hashes: np.ndarray) -> np.ndarray:
        return self.words.get(hashes, 0, self.unseen)

    def after(self, before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return self.alone(hashes) + self.words.get(before, 1, 0.0) + self.pairs.get(pair_keys(before, hashes), 0, 0.0)


def log_ratios(counts: DataFrame, work: Workspace, discount: float = DISCOUNT) -> Ratios:
    """The ratios of all words and pairs that occur in ``counts`` (before, word, toxic, ordinary), computed where the counts are."""
    classes = ("toxic", "ordinary")
    rows = work.stage(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in classes], (F.count("*") + 0.5).alias("types")), "words")
    sums = [F.sum(c).alias(c) for c in (*classes, "types")]
    freed = [F.sum(F.least(F.col(c), F.lit(discount))).alias(f"{c}_freed") for c in classes]
    total = rows.agg(*sums, *freed).first()

    def backoff(c: str) -> float:
        return total[f"{c}_freed"] / total[c] if total[c] else 1.0

    def probability(c: str):
        own = F.greatest(F.col(c) - discount, F.lit(0)) / total[c] if total[c] else F.lit(0)
        # Half a neighbour is every word's, one that does not occur too.
        return own + backoff(c) * F.col("types") / ((total.types or 0) + 0.5)

    ratio, context = (F.log(F.col(f"{x}_toxic") / F.col(f"{x}_ordinary")) for x in ("p", "left"))
    unseen = float(np.log(backoff("toxic") / backoff("ordinary")))
    alone = rows.select("word", *[probability(c).alias(f"p_{c}") for c in classes])
    contexts = counts.groupBy("bucket", "before").agg(
        *[F.when(F.sum(c) > 0, F.sum(F.least(F.col(c), F.lit(discount))) / F.sum(c)).otherwise(1.0).alias(f"left_{c}") for c in classes]
    )
    both = alone.join(contexts.withColumnRenamed("before", "word"), "word", "full")
    shown = [F.coalesce(ratio, F.lit(unseen)).alias("ratio"), F.coalesce(context, F.lit(0.0)).alias("context")]
    shown += [F.coalesce(f"p_{c}", F.lit(0.0)).alias(f"p_{c}") for c in classes]
    found = Table.write(both.select(F.col("word").alias("key"), *shown).select("key", *[F.col(c).cast("float").alias(c) for c in ("ratio", "context", "p_toxic", "p_ordinary")]), work, "ratios")
    work.drop("words")
    settle_fully(work.spark)  # the words' shuffles, before those of the pairs

    def differ(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            before, word, *numbers = (table.column(c).to_numpy() for c in ("before", "word", "toxic", "ordinary", "n_toxic", "n_ordinary", "left_toxic", "left_ordinary"))
            after = []
            for i in (0, 1):
                n, in_all, left = numbers[i::2]
                # A context that a class does not know leaves all its mass to the words.
                freed = np.where(in_all > 0, left / np.maximum(in_all, 1), 1.0)
                after.append(np.log(np.maximum(n - discount, 0) / np.maximum(in_all, 1) + freed * found.get(word, 2 + i, 1.0)))
            differs = after[0] - after[1] - found.get(word, 0, unseen) - found.get(before, 1, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(before, word)), pa.array(differs.astype(np.float32))], names=["key", "differs"])

    # Ranges of buckets hold whole contexts, and ranges of the pairs' keys, which begin with the bucket.
    one = Window.partitionBy("bucket", "before")
    met = counts.repartitionByRange("bucket").withColumns({f"n_{c}": F.sum(c).over(one) for c in classes} | {f"left_{c}": F.sum(F.least(F.col(c), F.lit(discount)).cast("double")).over(one) for c in classes})
    pairs = met.mapInArrow(lean(differ), "key long, differs float")
    return Ratios(found, Table.write(pairs, work, "pairs", ranges=True), unseen)


@dataclass(frozen=True)
class Model:
    """The words' ``ratios``, and the logistic fit of the measures."""

    ratios: Ratios
    weights: np.ndarray
    bias: float

    def measures(self, texts: list[bytes]) -> np.ndarray:
        """Length-normalised log-ratios of each text: its best passages, its most toxic words, and the
        whole. What is shorter than a passage or set counts as if ordinary words filled it up; without words, all 0."""
        hashes, before, owner = words(texts)
        out = np.zeros((len(texts), MEASURES))
        sizes = np.bincount(owner, minlength=len(texts))
        has = sizes > 0
        if not has.any():
            return out
        first = (np.cumsum(sizes) - sizes)[has]
        size = sizes[has]
        place = np.arange(len(hashes))
        end = np.repeat(first + size, size)
        for level, each in enumerate((self.ratios.after(before, hashes), self.ratios.alone(hashes))):
            own = out[:, level * LEVEL_MEASURES : (level + 1) * LEVEL_MEASURES]
            sums = np.concatenate(([0.0], np.cumsum(each)))
            for i, width in enumerate(PASSAGES):
                value = (sums[np.minimum(place + width, end)] - sums[place]) / width
                own[has, i] = np.maximum.reduceat(value, first)
            worst = np.concatenate(([0.0], np.cumsum(each[np.lexsort((-each, owner))])))
            for i, n in enumerate(WORST, len(PASSAGES)):
                own[has, i] = (worst[first + np.minimum(n, size)] - worst[first]) / n
            own[has, -1] = (sums[first + size] - sums[first]) / size
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ self.weights + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Newton's method; one class alone gives its share as the score of all."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        z = np.hstack([x, np.ones((len(x), 1))])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w)) * np.append(np.ones(x.shape[1]), 0) + 1e-9 * np.eye(len(w))
            w -= np.linalg.solve(hessian, z.T @ (p - y) + ridge * len(y) * np.append(w[:-1], 0))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The two models from all labelled rows but the held-out ones and those of the bounded sample that calibrates.

    Null labels and texts teach nothing. A document with several labels is counted with each.
    Without labels every score is one half.
    """
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", (F.col("toxic") != 0).alias("toxic"))
    texts = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    work = Workspace(docs.sparkSession, "toxicity")
    # Ids alone, at most CALIBRATION_ROWS and of a third of all, so small enough to broadcast.
    fold = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(3))
    sample = work.stage(usable.where(fold == 0).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS), "sample")
    counted = usable.join(F.broadcast(sample), "doc_id", "left_anti")
    # Labels are looked up where the texts are scanned, so no text moves.
    each = counted.groupBy(F.col("doc_id").cast("long").alias("key")).agg(*[F.count_if(F.col("toxic") == c).cast("float").alias(n) for n, c in (("toxic", True), ("ordinary", False))])
    counts = work.stage(_count(texts, Table.write(each, work, "labels")), "counts")
    settle(docs.sparkSession)  # the counts' shuffle
    plain = Model(log_ratios(counts, work), np.zeros(MEASURES), 0.0)
    work.drop("counts")
    settle_fully(docs.sparkSession)  # the pairs' shuffle, before every machine copies the table
    chosen = usable.join(F.broadcast(sample), "doc_id", "left_semi")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = table.column(0).to_pylist()
            for a, b in byte_groups(rows, GROUP_BYTES):
                columns = [pa.array(c) for c in plain.measures(rows[a:b]).T]
                yield pa.RecordBatch.from_arrays([table.column(1).slice(a, b - a), *columns], names=["toxic", *[f"m{i}" for i in range(len(columns))]])

    schema = "toxic boolean, " + ", ".join(f"m{i} double" for i in range(MEASURES))
    fitted = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(lean(run), schema).toPandas()
    fitted = fitted.sort_values(list(fitted.columns))  # so that the sums below have one order
    weights, bias = _logistic(fitted.iloc[:, 1:].to_numpy(np.float64), fitted["toxic"].to_numpy(np.float64)) if len(fitted) else (plain.weights, 0.0)
    return Model(plain.ratios, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``, from its whole text alone.

    Null and empty texts, and those without letters, get the score of a text that says nothing; very long texts are scored whole, by
    their worst passages and their mean. Texts with equal measures, repeated rows too, get equal scores; a score at the threshold is toxic. An empty
    table gives no rows; other columns are not read.
    """

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            texts = table.column(1).to_pylist()
            found = np.concatenate([model.scores(texts[a:b]) for a, b in byte_groups(texts, GROUP_BYTES)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([table.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns, whatever their names; nothing is shuffled.

    Null and empty texts count as a text that says nothing; very long texts are scored whole; a score at the threshold goes; repeated rows are
    judged each; an empty table gives no rows.
    """
    at = docs.columns.index(text)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for start in range(0, len(table), 2_000):
                part = table.slice(start, 2_000)
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                found = np.concatenate([model.scores(texts[a:b]) for a, b in byte_groups(texts, GROUP_BYTES)] or [np.zeros(0)])
                yield part.filter(pa.array(found < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
