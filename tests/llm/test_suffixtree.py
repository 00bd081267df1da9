"""The suffix tree's scores against the same model built from dictionaries."""

import zlib
from collections import Counter, defaultdict
from math import log, log2, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from wellkin.llm import suffixtree

END = b"\n"


def tokens(text):
    return [w for part in suffixtree.words(text) for w in part] + [END]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def model(train, depth, least_count, least_bits):
    grams = Counter()
    for t in train:
        for size in range(1, depth + 2):
            grams.update(tuple(t[i : i + size]) for i in range(len(t) - size + 1))
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(1 for g in grams if len(g) == 1)
    after = defaultdict(dict)
    for g, c in grams.items():
        if len(g) > 1:
            after[g[:-1]][g[-1]] = c

    def frequent(context):
        return all(grams[context[:k]] >= least_count for k in range(1, len(context) + 1)) and all(
            grams[context[k:]] >= least_count for k in range(len(context))
        )

    def p(context, word):
        if not context:
            return (grams[word,] + 1) / (n + v + 1)
        mass = len(after[context])
        return (after[context].get(word, 0) + mass * p(context[1:], word)) / (grams[context] + mass)

    def state(context):
        if not context:
            return True
        if not frequent(context):
            return False
        total, shorter = grams[context], grams[context[1:]] if len(context) > 1 else n
        bits = sum(
            c / total * log2(c / total * shorter / grams[(*context[1:], w)])
            for w, c in after[context].items()
        )
        return bits - (len(after[context]) - 1) / (2 * total * log(2)) >= least_bits

    return grams, n, v, p, state


def scores_by_force(table, depth, least_count, least_bits):
    grams, n, v, p, state = model([tokens(t) for i, t in table if not held(i)], depth, least_count, least_bits)
    out, states = [], Counter()
    for i, text in table:
        t, base, score = tokens(text), 0.0, 0.0
        for k, word in enumerate(t):
            base += log10(p((), word))
            context = next(c for d in range(depth, -1, -1) if d <= k and state(c := tuple(t[k - d : k])))
            states[len(context)] += 1
            score += log10(p(context, word))
        out.append((i, held(i), len(t), sum(grams[w,] > 0 for w in t), n, base, score))
    return sorted(out, key=repr), states


@pytest.fixture(scope="module")
def table():
    # Small vocabularies, so that contexts of two words are frequent.
    rng = np.random.default_rng(3)
    common = [" ".join(rng.choice(["aa", "bb", "Cc", "dd", "é"], 60, p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(30)]
    chains = ["the cat sat on the mat and the dog sat on the log " * 8, "on the mat the cat sat \n on the log"] * 5
    return [(r[0], r[1]) for r in rows() if r[0] != 55] + [
        (200 + i, t) for i, t in enumerate([*common, *chains])
    ]


@pytest.mark.parametrize("depth, least_count, least_bits", [(2, 8, 0.02), (3, 5, 0.1), (1, 1, 0.0)])
def test_scores_by_force(spark, table, depth, least_count, least_bits):
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, suffixtree.score(frame, depth, least_count, least_bits).collect()), key=repr)
    want, states = scores_by_force(table, depth, least_count, least_bits)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    assert min(states[d] for d in range(depth + 1)) > 0


def test_probabilities_after_a_context_sum_to_one(table):
    grams, n, v, p, state = model([tokens(t) for _, t in table], 2, 8, 0.02)
    known = [g[0] for g in grams if len(g) == 1]
    for context in ((), (b"the",), (b"on", b"the"), (b"aa", b"bb")):
        # What is left goes to the one word that training never showed.
        assert sum(p(context, w) for w in known) + p(context, b"?") == pytest.approx(1)


def test_no_training_rows_empty_table_and_other_columns(spark, table):
    frame = spark.createDataFrame(table, "doc_id long, text string")
    none = frame.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    got = suffixtree.score(none.limit(4)).collect()
    assert len(got) == 4 and {(r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0.0, 0.0)}
    assert suffixtree.score(frame.limit(0)).collect() == []
    named = frame.select("*", *[F.lit("x").alias(c) for c in ("block", "score", "words", "held_out")])
    first = sorted(map(tuple, suffixtree.score(named).collect()), key=repr)
    assert np.allclose([r[5:] for r in first], [r[5:] for r in sorted(map(tuple, suffixtree.score(frame).collect()), key=repr)])


def test_long_texts_are_split_between_words():
    text = "word \t" * 40 + "long" * 30
    whole = [w for part in suffixtree.words(text) for w in part]
    slices, suffixtree.SLICE = suffixtree.SLICE, 7
    try:
        assert [w for part in suffixtree.words(text) for w in part] == whole == text.encode().split()
    finally:
        suffixtree.SLICE = slices


def test_the_tree_beats_the_words_alone_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = suffixtree.score(docs).filter("held_out").collect()
    assert sum(r.score > r.base_score for r in got) > 0.7 * len(got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
