"""Operators against second implementations in plain Python: shard draws, class models, decoding, and the pipeline's stages."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import language, packing, queries, sharding, toxicity
from palimpsest.llm.shared import Workspace
from palimpsest.llm.tables import Table

FOLDER = "/root/testdata/sf0.001"


def draw(key, node):
    digest = hashlib.md5(f"{'' if key is None else key}/{node.name}".encode()).hexdigest()
    return -math.log((int(digest[:13], 16) + 0.5) / 16**13) / node.weight


def descend(key, node):
    while node.shard is None:
        node = min(node.children, key=lambda c: draw(key, c))
    return node.shard


@pytest.mark.parametrize("layout", [[[[1.0] * 4] * 2] * 5, [[[1, 3], [2]], [[5]], [[1], [1, 1, 7]]]])
def test_shards_are_the_least_draws(spark, odd, layout):
    tree = sharding.HashTree.build(layout)
    found = sharding.assign(odd, tree, spark).collect()
    for shard in {r.shard for r in found}:
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in sorted(found, key=lambda r: r.slot) if r.shard == shard]
        assert keys == sorted(keys)
    assert all((r.shard, r.grown_shard) == (descend(r.doc_id, tree.root), descend(r.doc_id, tree.grown().root)) for r in found)


def test_ratios_are_those_of_the_models(spark):
    """Every bigram of both classes, and ones that do not occur, against the formulas on plain counts."""
    toxic = [["you", "are", "bad", "bad", "luck"], ["you", "bad"], ["bad", "you", "are"]]
    ordinary = [["you", "are", "good", "luck"], ["good", "luck", "are", "you"], ["are", "good"], ["luck"]]
    texts = [(i, " ".join(t)) for i, t in enumerate(toxic + ordinary)]
    rows = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in texts], "doc_id long, text binary")
    classes = spark.createDataFrame([(i, float(i < len(toxic)), float(i >= len(toxic))) for i, _ in texts], "key long, toxic float, ordinary float")
    work = Workspace(spark, "test")
    ratios = toxicity.log_ratios(work.stage(toxicity._count(rows, Table.write(classes, work, "labels")), "counts"), work)

    d = toxicity.DISCOUNT
    pairs = [Counter((a, b) for t in c for a, b in zip([None, *t], t)) for c in (toxic, ordinary)]
    types = Counter(w for _, w in set(pairs[0]) | set(pairs[1]))

    def probability(c, before, word):
        alone = Counter()
        for (_, w), n in pairs[c].items():
            alone[w] += n
        total = sum(alone.values())
        shared = (types[word] + 0.5) / (sum(x + 0.5 for x in types.values()) + 0.5)
        p = max(alone[word] - d, 0) / total + sum(min(n, d) for n in alone.values()) / total * shared
        after = {w: n for (b, w), n in pairs[c].items() if b == before}
        if not after:
            return p
        in_all = sum(after.values())
        return max(after.get(word, 0) - d, 0) / in_all + sum(min(n, d) for n in after.values()) / in_all * p

    words = ["you", "are", "bad", "good", "luck", "never"]
    number = {w: toxicity.words([w.encode()])[0][0] for w in words} | {None: np.int64(0)}
    for before in [None, *words]:
        found = ratios.after(np.full(len(words), number[before]), np.array([number[w] for w in words]))
        wanted = [math.log(probability(0, before, w) / probability(1, before, w)) for w in words]
        assert np.allclose(found, wanted, atol=1e-4), before


def grams(text):
    """Feature counts of a text by plain loops."""
    data = b"  " + text + b"  "
    x = [b + 32 if 65 <= b <= 90 else 32 if b < 128 and not 97 <= b <= 122 else b for b in data]
    out, low = Counter(), 0xFFFFFFFF
    for i in range(1, len(x) - 1):
        if x[i] == 32 and x[i - 1] == 32:
            continue
        two = (x[i] * 0x9E3779B1 & low) ^ (x[i + 1] * 0x85EBCA6B & low)
        three = ((two ^ (x[i - 1] * 0xC2B2AE35 & low)) * 0x27D4EB2F) & low
        out.update((x[i], (two * 0x165667B1 & low) >> (32 - language.BITS), three >> (32 - language.BITS)))
    return out


def test_decoding_is_the_least_weighted_loss(spark, docs):
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text and r.lang]
    model = language.fit([r.text.encode() for r in rows[:80]], [r.lang for r in rows[:80]])
    texts = [r.text.encode() for r in rows[80:110]] + [b"x", "Été à".encode(), b"1 2 3 a"]
    margins = model.margins(texts)
    for text, own in zip(texts, margins):
        counts = grams(text)
        n = sum(counts.values()) / 3
        plain = sum(c * model.weights[g].astype(float) for g, c in counts.items()) / n + model.bias
        assert np.allclose(own, plain, atol=1e-3)
    order, share = model.decode(margins)
    for own, by, s in zip(margins, order, share):
        loss = [sum(t * math.log1p(math.exp(-b * m)) for t, b, m in zip(model.trust, code, own)) for code in model.code]
        assert by[0] == int(np.argmin(loss)) and math.isclose(sum(s), 1, abs_tol=1e-9)


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_every_stage_does_its_work_on_its_input(spark, request, table):
    """Stages on plain and on odd tables, each with its own input, against plain Python where there is no model in it."""
    df = request.getfixturevalue(table)
    stages = dict(corpus_pipeline.STAGES)
    before = rows_of(df)

    kept = rows_of(stages["identify_language"](spark, df, FOLDER))
    found = language.predict(df, language.train(df)).collect()
    assert sum(kept.values()) == sum(r.lang_pred != "und" and not r.ambiguous for r in found) and not kept - before
    assert not any(not re.search(r"[^\W\d_]", t or "") for _, t in kept)

    kept = rows_of(stages["drop_toxic"](spark, df, FOLDER))
    model = toxicity.train(df, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert sum(kept.values()) == toxicity.score(df, model).where("predicted = 0").count() and not kept - before

    copies = stages["drop_copies"](spark, df, FOLDER)
    groups = defaultdict(list)
    for (key, text), n in before.items():
        groups[strip(text)].append((-len(text or ""), key is None, key or 0))
    assert sorted((k is None, k or 0, -len(t or "")) for k, t in rows_of(copies).elements()) == sorted((g[1], g[2], g[0]) for g in map(min, groups.values()))

    near = stages["drop_near_copies"](spark, df, FOLDER)
    left = [(shingles(t), k) for k, t in rows_of(near).elements()]
    full = [x for x in left if x[0]]
    assert len(left) - len(full) == sum(n for (_, t), n in before.items() if not shingles(t))
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, (a, _) in enumerate(full) for b, _ in full[:i])
    assert near.columns == copies.columns == df.columns

    places = stages["pack_sequences"](spark, df, FOLDER).collect()
    assert Counter(r.doc_id for r in places if r.piece == 0) == Counter(k for (k, _), n in before.items() for _ in range(n))
    bins = Counter()
    for r in places:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= packing.SEQUENCE


def test_stages_of_nothing(spark, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, empty, FOLDER)
        assert found.columns == empty.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0


def test_held_out_rows():
    assert [i for i in range(30) if zlib.crc32(str(i).encode()) % 4 == 2] and queries.held_out
