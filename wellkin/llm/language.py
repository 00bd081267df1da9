"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the byte n-grams (n = 1, 2, 3, hashed) present in both, divided
by the root of the product of their own numbers.  A bounded sample of labelled rows, by language
and of texts of any length, gives the Nystroem landmarks and the ridge regression, one language
against the rest.  Whole texts become presence bits where they are read; only these travel.  Because the
presence kernel is a dot product, landmarks, Nystroem map and ridge weights multiply out to one
matrix; texts are scored by batched products of their presence rows with it.

Defined results: a null text or one without a letter is ``und`` with score 0; null languages
and null texts are never learned; equal scores go to the language that sorts first; without any
labelled row every text is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellkin.llm import corpus

#: Remainder base of the held-out fold.
FOLD = 4
#: Hash space of n-grams, n-gram lengths, landmarks, ridge, labelled rows to learn from.
DIMS, ORDERS, LANDMARKS, RIDGE, SAMPLE = 1 << 13, (1, 2, 3), 256, 1e-2, 4_000
#: Rows and bytes of one presence matrix.
ROWS, BYTES = 64, 1 << 20
#: Rows to learn from that each language may have, however many languages share the sample.
LEAST_ROWS = 64

NONE = "und"
#: Score under which no language claims a text; 0.5 is the border between one and the rest.
LEAST_SCORE = 0.3


def _raw(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode() + b" "


def presence(texts: list[bytes]) -> np.ndarray:
    """Rows x DIMS: 1 where the text has an n-gram of that hash."""
    out = np.zeros((len(texts), DIMS), bool)
    for start in range(0, len(texts)):
        raw = np.frombuffer(texts[start], np.uint8)
        row = out[start]
        for piece in range(0, len(raw), BYTES):
            part = raw[piece : piece + BYTES + max(ORDERS) - 1].astype(np.uint32)
            code = part
            for n in ORDERS:
                if n > 1:
                    if len(part) < n:
                        break
                    code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
                mixed = (code ^ np.uint32(n << 28)) * np.uint32(2_654_435_761)
                row[mixed >> np.uint32(32 - 13)] = True
    return out


def _normal(seen: np.ndarray) -> np.ndarray:
    x = seen.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(packed: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of the fitted classifier, from presence rows as packed bits."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((DIMS, 0), np.float32)

    def normal(at: list[int] | range) -> np.ndarray:
        bits = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1)
        return _normal(np.unpackbits(bits, axis=1))

    n = len(packed)
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    by_lang = [[i for i, lang in enumerate(langs) if lang == name] for name in names]
    share = -(-LANDMARKS // len(names))
    marks = normal(sorted(i for rows in by_lang for i in rows[:share]))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    parts = [range(i, min(i + ROWS, n)) for i in range(0, n, ROWS)]
    z = np.concatenate([(normal(part) @ marks.T).astype(np.float64) @ root for part in parts])
    z = np.hstack([z, np.ones((n, 1))])
    # Each language's rows weigh as much as the rest, so rare languages are learned too.
    weight = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1))
    beta = []
    for k in range(len(names)):
        zw = z * weight[:, [k]]
        beta.append(np.linalg.solve(z.T @ zw + RIDGE / n * np.eye(z.shape[1]), zw.T @ y[:, k]))
    beta = np.array(beta).T
    folded = marks.T @ (root @ beta[:-1])
    # The bias travels as a last row.
    return names, np.vstack([folded, beta[-1:]]).astype(np.float32)


def _shares(known: DataFrame, quota: Callable[[int], int]) -> tuple[DataFrame, int]:
    """(lang, below): the hash under which about twice the quota of a language's rows lie; the quota.

    There is a row per language, and the driver holds a column of the model for each anyway.
    """
    totals = known.groupBy("lang").count().collect()
    size = quota(max(1, len(totals)))
    rows = []
    for lang, total in totals:
        share = min(1.0, 2 * size / total)
        rows.append((lang, int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1))
    return known.sparkSession.createDataFrame(rows, "lang string, below long"), size


def learn(docs: DataFrame, size: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fit on each language's labelled training rows of lowest hashes: all share `size` evenly.

    Texts of any length count whole.  A language has its part even if it is rare, LEAST_ROWS rows
    at least, or all it has.
    """
    known = docs.filter("lang is not null and text is not null").filter(~corpus.fold(FOLD))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit("lang")).alias("k"))
    shares, quota = _shares(known, lambda names: max(LEAST_ROWS, size // names))

    @F.pandas_udf("binary")
    def bits(text: pd.Series) -> pd.Series:
        return text.map(lambda t: np.packbits(presence([_raw(t)])[0]).tobytes())

    low = known.join(F.broadcast(shares), "lang").filter("k <= below")
    rows = low.select("lang", "k", bits("text").alias("bits"))
    # Equal hashes are repeated rows, so which of them is taken makes no difference.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    sample = rows.withColumn("place", place).filter(F.col("place") <= quota).drop("place")

    def fitted(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        rows = rows.sort_values(["k", "lang"])
        return fit(list(rows["bits"]), list(rows["lang"]))

    return corpus.fit_in_task(sample, fitted)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """All columns of `docs` and lang_pred, lang_score."""
    return _labelled(docs, learn(docs, size))


def _labelled(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for batch in batches:
            pred, score = [NONE] * len(batch), np.zeros(len(batch))
            at = [i for i, t in enumerate(batch) if names and _has_letter(t)]
            for start in range(0, len(at), ROWS):
                part = at[start : start + ROWS]
                x = _normal(presence([_raw(batch.iloc[i]) for i in part]))
                value = x @ matrix[:-1] + matrix[-1]
                best = value.argmax(axis=1)
                for i, b, v in zip(part, best, value.max(axis=1), strict=True):
                    pred[i], score[i] = names[b], min(1.0, max(0.0, 0.5 + float(v) / 2))
            yield pd.DataFrame({"lang_pred": pred, "lang_score": score})

    name = "_language"
    out = docs.withColumn(name, label("text"))
    return out.select("*", f"{name}.lang_pred", f"{name}.lang_score").drop(name)


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` whose text has a language, all columns.

    Null and letterless texts go, and texts that score less than `least_score`: those that every
    language's own classifier clearly counts among the rest.  Without any labelled row there is
    no language to find; then only null and letterless texts go.
    """
    own = docs.columns
    kept = docs.select("doc_id", "text", "lang", F.struct(*own).alias("_row"))
    model = learn(kept)
    if model[0]:
        found = _labelled(kept, model).filter(F.col("lang_pred") != NONE)
        found = found.filter(F.col("lang_score") >= least_score)
    else:
        found = kept.filter(F.pandas_udf(lambda texts: texts.map(_has_letter), "boolean")("text"))
    return found.select("_row.*")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select(
        "doc_id",
        corpus.fold(FOLD).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
