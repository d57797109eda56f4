"""Language identification with error-correcting output codes.

Every language has a binary codeword. One classifier for each bit, logistic regression
over hashed byte n-grams of the letters, predicts that bit. Decoding weighs each bit's loss by how reliable the
bit was in training, chooses the codeword of least loss, and flags a text as ambiguous when
the second codeword is nearly as close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.hashing import byte_groups
from palimpsest.llm.shared import fresh, hand_back, held_out, lean

#: Training rows of each language, whole: the documented bound of the fit.
ROWS_PER_LANGUAGE = 1_500
#: Hashed n-gram features: of 1, 2, 3 bytes.
BITS = 15
#: Score difference of the best two languages below which a text is ambiguous.
AMBIGUOUS = 0.02
#: Languages that a model may know; the driver gets a row of each.
MAX_LANGUAGES = 1_000
#: Bytes of texts that are taken together.
GROUP_BYTES = 500_000

_SCHEMA = "doc_id long, lang_pred string, score double, second string, ambiguous boolean"


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1/-1 bits: the exhaustive code up to 6 languages (every split of them,
    once), else rows of a Hadamard matrix, all half its width apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.stack([np.where(splits >> i & 1, -1.0, 1.0) if i < n - 1 else np.ones(len(splits)) for i in range(n)])
    size = 1 << int(np.ceil(np.log2(n + 1)))
    rows = np.arange(size)
    parity = np.array([[bin(i & j).count("1") & 1 for j in rows] for i in rows])
    return np.where(parity, -1.0, 1.0)[1 : n + 1, 1:]


def _folding() -> np.ndarray:
    """ASCII upper case to lower, every other ASCII byte that is no letter to a space."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 32
    return table


_FOLD = _folding()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, one after another, and where each text's begin.

    Texts are framed by spaces, runs of non-letters count as one; n-grams over them, so words' first and
    last letters are features too.
    """
    data = np.frombuffer(b"  " + b"   ".join(texts) + b"  ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 3))) if len(texts) else np.zeros(0, np.int64)
    x = _FOLD[data].astype(np.uint32)
    dull = (x[1:-1] == 32) & (x[:-2] == 32)
    mask = np.uint32((1 << BITS) - 1)
    two = x[1:-1] * np.uint32(0x9E3779B1) ^ x[2:] * np.uint32(0x85EBCA6B)
    three = (two ^ x[:-2] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BITS)
    grams = np.stack([x[1:-1] & mask, (two * np.uint32(0x165667B1)) >> shift, three >> shift], axis=1)
    grams[dull] = 32
    return grams, starts


def _average(grams: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each text's features, for each bit; spaces weigh nothing."""
    used = (grams[:, 1] != 32) | (grams[:, 0] != 32)
    count = np.maximum(1, np.add.reduceat(used, starts))
    out = np.empty((len(starts), weights.shape[1]), np.float64)
    for b in range(weights.shape[1]):
        w = weights[:, b]
        each = w[grams[:, 0]] + w[grams[:, 1]] + w[grams[:, 2]]
        out[:, b] = np.add.reduceat(each * used, starts, dtype=np.float64)
    return out / count[:, None]


@dataclass(frozen=True)
class Model:
    """``weights`` [2**BITS, bits], ``bias`` [bits], ``trust`` [bits] and the ``code`` of each language."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        grams, starts = features(texts)
        return _average(grams, starts, self.weights) + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted logistic loss of every codeword, of every text."""
        against = -margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, against) * self.trust).sum(axis=2)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the languages by loss, and their shares, which sum to 1."""
        losses = self.losses(margins)
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        share /= share.sum(axis=1, keepdims=True)
        return np.argsort(losses, axis=1, kind="stable"), share


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur in a text, and how often."""
    grams, _ = features([text])
    return np.unique(grams[(grams[:, 1] != 32) | (grams[:, 0] != 32)], return_counts=True)


def fit(texts: list[bytes], languages: list[str]) -> Model:
    """``fit_counts`` of texts."""
    return fit_counts([gram_counts(text) for text in texts], languages)


class _Sums:
    """The products of a sparse matrix: for each ``to``, which ascend, the sum of ``value`` times the row ``of`` of a dense matrix."""

    def __init__(self, to: np.ndarray, of: np.ndarray, value: np.ndarray, together: int = 500_000) -> None:
        self.of, self.value = of, value
        self.starts = np.flatnonzero(np.diff(to, prepend=-1))
        self.targets = to[self.starts]
        cuts = np.searchsorted(self.starts, np.arange(0, len(to) + together, together))
        self.parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]

    def __call__(self, dense: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, dense.shape[1]), np.float32)
        ends = np.append(self.starts, len(self.of))
        for a, b in self.parts:
            here = slice(ends[a], ends[b])
            out[self.targets[a:b]] = np.add.reduceat(dense[self.of[here]] * self.value[here, None], self.starts[a:b] - ends[a], axis=0)
        return out


def gathered(counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' features and their shares in one array each, and how many features each text has."""
    counts = list(counts)
    col = np.concatenate([found for found, _ in counts] or [np.zeros(0)]).astype(np.uint16)
    value = np.concatenate([(n / max(1, n.sum() / 3)).astype(np.float32) for _, n in counts] or [np.zeros(0, np.float32)])
    return col, value, np.array([len(found) for found, _ in counts], np.int64)


def fit_counts(counts: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """``fit_gathered`` of texts' feature counts."""
    return fit_gathered(*gathered(counts), languages)


def fit_gathered(col: np.ndarray, value: np.ndarray, lengths: np.ndarray, languages: list[str], steps: int = 150, rate: float = 30.0, enough: float = 0.01) -> Model:
    """Fit every bit's classifier by gradient descent on mean n-gram counts, until its mean loss is ``enough`` or for ``steps`` steps.

    Languages weigh alike, however many rows each has. Without rows the model knows no language.
    """
    names = tuple(sorted(set(languages)))
    code = codewords(len(names))
    size = 1 << BITS
    if not names:
        return Model((), code, np.zeros((size, 1), np.float32), np.zeros(1), np.ones(1))
    of = np.array([names.index(x) for x in languages])
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    # Columns are scaled by the root of their mean, so rare n-grams learn as fast as common ones.
    scale = 1 / np.sqrt(np.bincount(col, value, size) / len(lengths) + 1e-4)
    value = value * scale.astype(np.float32)[col]
    order = np.argsort(col, kind="stable")
    by_row, by_column = _Sums(row, col, value), _Sums(col[order], row[order], value[order])
    share = (1 / np.bincount(of))[of] / len(names)
    target = code[of]
    bits = code.shape[1]
    weights, bias = np.zeros((size, bits), np.float32), np.zeros(bits)
    for _ in range(steps):
        wrong = target * (by_row(weights, len(lengths)) + bias)
        learning = (np.logaddexp(0, -wrong) * share[:, None]).sum(axis=0) >= enough
        if not learning.any():
            break
        gradient = -target * share[:, None] / (1 + np.exp(np.clip(wrong, -50, 50))) * learning
        weights -= rate * (by_column(gradient.astype(np.float32), size) + 1e-5 * weights * learning)
        bias -= rate * 0.1 * gradient.sum(axis=0)
    margins = by_row(weights, len(lengths)) + bias
    right = (((margins * target) > 0) * share[:, None]).sum(axis=0)
    trust = np.clip(2 * right - 1, 0.01, 1)
    return Model(names, code, (weights * scale[:, None]).astype(np.float32), bias, trust * bits / trust.sum())


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from at most ROWS_PER_LANGUAGE rows of each language, the first by a hash of their id.
    Whole texts count, on the executors. Held-out rows, null languages and null texts teach nothing."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = usable.select(F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("h"), "doc_id")
    # Each language's smallest hashes, found by a sample threshold: counts are aggregated, rows are not.
    counts = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} values")
    wanted = F.lit(False)
    for name, n in sorted(counts.items()):
        keep = min(1.0, 1.2 * ROWS_PER_LANGUAGE / n)
        wanted = wanted | ((F.col(lang) == name) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1))
    found = usable.where(wanted).select(
        F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("h"), F.md5(F.col(text).cast("binary")).alias("digest"), F.col(text).cast("binary").alias("text")
    )

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            each = [gram_counts(t) for t in table.column(3).to_pylist()]
            columns = [pa.array([x[i] for x in each], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*table.columns[:3], *columns], names=["lang", "h", "digest", "grams", "n"])

    counted = found.mapInArrow(lean(run), "lang string, h long, digest string, grams array<int>, n array<int>")
    rows = counted.orderBy("h", "digest").limit(2 * ROWS_PER_LANGUAGE * max(1, len(counts))).toArrow()
    taken: dict[str, int] = {}
    chosen = []
    languages = rows.column("lang").to_pylist()
    for i, name in enumerate(languages):
        if taken.get(name, 0) < ROWS_PER_LANGUAGE:
            taken[name] = taken.get(name, 0) + 1
            chosen.append(i)
    found = gathered(tuple(rows.column(c)[i].values.to_numpy() for c in ("grams", "n")) for i in chosen)
    del rows  # the driver need not hold the counts twice
    model = fit_gathered(*found, [languages[i] for i in chosen])
    del found
    pa.default_memory_pool().release_unused()
    hand_back()
    return model


def _judge(model: Model, texts: list[bytes], letters: list[bool]) -> tuple[list[str], list[float], list[str | None], list[bool]]:
    """Language, score, second language and ambiguity of each text."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    seconds, flags = [None] * len(texts), [True] * len(texts)
    known = [i for i, x in enumerate(letters) if x and model.languages]
    for a, b in byte_groups([texts[i] for i in known], GROUP_BYTES):
        group = known[a:b]
        order, share = model.decode(model.margins([texts[i] for i in group]))
        for i, by, s in zip(group, order, share):
            names[i], scores[i] = model.languages[by[0]], min(1.0, float(s[by[0]]))
            flags[i] = False
            if len(by) > 1:
                seconds[i] = model.languages[by[1]]
                flags[i] = bool(s[by[0]] - s[by[1]] < AMBIGUOUS)
    return names, scores, seconds, flags


def _body(text: str):
    return F.coalesce(F.col(text), F.lit(""))


def _letter(text: str):
    return _body(text).rlike(r"\p{L}")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, second, ambiguous`` of every row of ``docs``, from its whole text alone.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if the
    model knows no language. Languages equally near come in alphabetical order, and such a text is ambiguous. Very long texts are averaged like
    others. Repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            names, scores, seconds, flags = _judge(model, table.column(1).to_pylist(), table.column(2).to_pylist())
            arrays = [table.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(seconds, pa.string()), pa.array(flags, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "second", "ambiguous"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body(text).cast("binary").alias("text"), _letter(text).alias("letter"))
    return narrow.mapInArrow(lean(run), _SCHEMA)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language that is not ambiguous, with all their columns, whatever their names; nothing is shuffled.

    Null and empty texts, and those without a letter, go; so do ties of two languages. Very long texts are judged whole, repeated rows
    each; an empty table gives no rows.
    """
    width, at = len(docs.columns), docs.columns.index(text)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for start in range(0, len(table), 2_000):
                part = table.slice(start, 2_000)
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                names, _, _, flags = _judge(model, texts, part.column(width).to_pylist())
                mask = pa.array([n != "und" and not f for n, f in zip(names, flags)], pa.bool_())
                yield part.select(list(range(width))).filter(mask)

    return docs.select("*", _letter(text).alias(fresh("__letter", docs.columns))).mapInArrow(lean(run), docs.schema)
