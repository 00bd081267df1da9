"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of their first letters, hashed.  The machine adds a weight per term and, for every pair
of terms, the dot product of their factors, so a pair such as an insult and a group's name can
weigh more than its words do.  Terms enter the machine if their association with the label
passes a chi-square test on the sample; the others have weight zero.

Labels are learned from a bounded sample of labelled rows outside the held-out fold.  Defined
results: null and empty texts have no terms and get the score of the bias; documents without a
label are scored like the rest; null labels are never learned; without any labelled row every
score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus
from wellkin.llm.decontaminate import words

FOLD, THRESHOLD = 4, 0.3
#: Labelled rows to learn from, hash space, factors, steps, step size, penalty.
SAMPLE, DIMS, FACTORS, STEPS, RATE, PENALTY = 20_000, 1 << 20, 8, 250, 0.05, 1e-4
#: Chi-square value a term must pass, and the most terms kept.
CHI_SQUARE, TERMS = 15.0, 8_192
#: Bytes of a word's start that are terms of their own.
PREFIXES = (4, 5, 6)
#: Distinct terms of one sampled text that are learned from, lowest hashes first.
TEXT_TERMS = 20_000

#: Bias, index of each kept hash, weights, factors.
Machine = tuple[float, dict[int, int], np.ndarray, np.ndarray]


def terms(text: str | None) -> set[int]:
    """Hashes of the distinct words and of their first letters, which compounds share."""
    crc, mask, found = zlib.crc32, DIMS - 1, set(words(text))
    out = {crc(w) & mask for w in found}
    for n in PREFIXES:
        out.update([crc(w, n) & mask for w in {w[:n] for w in found if len(w) > n}])
    return out


def _pair_sum(rows: np.ndarray, index: np.ndarray, n: int, v: np.ndarray):
    """Sum of factors by row, and the sum over all pairs of terms of their dot products."""
    total = np.stack([np.bincount(rows, v[index, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, (v[index] ** 2).sum(axis=1), n)
    return total, 0.5 * ((total**2).sum(axis=1) - squares)


def fit(sets: list[np.ndarray], label: np.ndarray) -> Machine:
    """Logistic loss by full-batch Adam from a fixed start."""
    n, positive = len(sets), float(label.sum())
    if not n or positive in (0.0, float(n)):
        bias = -20.0 if not positive else 20.0
        return bias, {}, np.zeros(0), np.zeros((0, FACTORS))
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes, index = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(index)
    toxic = np.bincount(index, label[rows])
    expected = seen * positive / n
    spread = expected * (1 - positive / n) * (1 - seen / n)
    value = (toxic - expected) ** 2 / np.maximum(spread, 1e-9)
    order = np.argsort(-value, kind="stable")[:TERMS]
    keep = np.sort(order[(value[order] >= CHI_SQUARE) & (seen[order] >= 3)])
    place = np.full(len(hashes), -1)
    place[keep] = np.arange(len(keep))
    used = place[index] >= 0
    rows, index = rows[used], place[index[used]]
    rng = np.random.default_rng(7)
    params = [np.array([np.log(positive / (n - positive))]), np.zeros(len(keep))]
    params.append(rng.normal(0, 0.05, (len(keep), FACTORS)))
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        bias, w, v = params
        total, pairs = _pair_sum(rows, index, n, v)
        score = bias + np.bincount(rows, w[index], n) + pairs
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) / n
        each = error[rows]
        grad_v = np.stack(
            [np.bincount(index, each * total[rows, f], len(keep)) for f in range(FACTORS)], axis=1
        ) - v * np.bincount(index, each, len(keep))[:, None]
        grads = [np.array([error.sum()]), np.bincount(index, each, len(keep)) + PENALTY * w]
        grads.append(grad_v + PENALTY * v)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), {int(h): i for i, h in enumerate(hashes[keep])}, params[1], params[2]


def score_texts(texts: pd.Series, machine: Machine) -> np.ndarray:
    bias, place, w, v = machine
    rows, index = [], []
    for i, text in enumerate(texts):
        found = [place[h] for h in terms(text) if h in place]
        rows += [i] * len(found)
        index += sorted(found)
    rows, index, n = np.array(rows, np.int64), np.array(index, np.int64), len(texts)
    pairs = _pair_sum(rows, index, n, v)[1] if len(rows) else 0.0
    raw = bias + (np.bincount(rows, w[index], n) if len(rows) else np.zeros(n)) + pairs
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Machine:
    """Fit on at most `size` labelled rows outside the held-out fold, lowest id hashes first."""
    digest = F.xxhash64(F.col("doc_id"), F.lit("toxic"))
    labelled = labels.filter("toxic is not null and doc_id is not null")
    labelled = labelled.filter(~corpus.fold(FOLD)).select("doc_id", "toxic")
    known = (
        corpus.low_hashes(labelled, digest, size)
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), "k")
        .orderBy("k", "toxic")
        .limit(size)
    )

    @F.pandas_udf("array<int>")
    def hashed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(terms(t))[:TEXT_TERMS])

    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(known), "doc_id")
        .select("k", "toxic", hashed("text").alias("terms"))
        .orderBy("k", "toxic", "terms")
        .limit(size)
    )

    def fitted(rows: pd.DataFrame) -> Machine:
        order = np.lexsort((rows["toxic"], rows["k"]))
        sets = [np.asarray(rows["terms"].iloc[i], np.int64) for i in order]
        return fit(sets, rows["toxic"].to_numpy(float)[order])

    return corpus.fit_in_task(sample, fitted)


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """All columns of `docs` and toxic_score."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, size))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(text, shared.value))

    return docs.withColumn("toxic_score", scored("text"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, corpus.table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        corpus.fold(FOLD).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
