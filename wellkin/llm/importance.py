"""Importance resampling towards a target corpus, over hashed word n-grams.

Bytes are the unit: a table of 256 bytes lower-cases ASCII letters and blanks every separator,
``bytes.split`` yields the words, and an n-gram's crc32 continues from the crc32 of the n-gram
one word shorter.  Counters reduce the features of a batch before they are hashed, buckets
reduce them before the shuffle.  A bucket's gain is the log ratio of its smoothed shares in
target and source; a document's weight is the floored mean of its gains, its score the weight
plus seeded Gumbel noise, and the highest scores are drawn.

What the driver sees is bounded by parameters: a count for each bucket and one for each
distinct score.  A score is a whole number within 1000 ln(features * buckets) of zero plus
noise between -3,200 and 22,200, so there are at most some 200,000 of them in any corpus.
Places are given within a score, after rows alike in every column became one with a count;
noise spreads different ids, so one score holds under a thousandth of them.

Defined results: a null or empty text has no words, weight 0 and is never drawn; ties go to the
smaller id, null ids last; rows alike in all results are drawn one by one and each get a rank
of their own; a null id's noise is that of the empty id; an empty target makes the weights what
the smoothing alone gives; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellkin.llm import corpus
from wellkin.plans.stored import store

#: Longest n-gram, buckets, seed of the noise, least words of a candidate, percent drawn.
WORDS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Different features that a task counts, and whose buckets a worker remembers.
HELD = 400_000


def _byte(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 0x20
    return b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20


TABLE = bytes(map(_byte, range(256)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def longer(found: list[bytes], n: int) -> Iterator[int]:
    """crc32 of every run of 2 to n consecutive words joined by a blank."""
    blanked = [b" " + w for w in found]
    seeds = [zlib.crc32(w) for w in found]
    for size in range(2, n + 1):
        seeds = [zlib.crc32(w, seed) for seed, w in zip(seeds, blanked[size - 1 :])]
        yield from seeds


def counted(docs: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, crcs = np.zeros(buckets, np.int64), Counter(), Counter()

        def reduce() -> None:
            for word, c in held.items():
                total[zlib.crc32(word) % buckets] += c
            for crc, c in crcs.items():
                total[crc % buckets] += c
            held.clear()
            crcs.clear()

        for batch in batches:
            for text in batch["text"]:
                found = words(text)
                held.update(found)
                if n > 1:
                    crcs.update(longer(found, n))
                if len(held) + len(crcs) > HELD:
                    reduce()
        reduce()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    each = docs.select("text").mapInPandas(count, "bucket long, n long")
    rows = each.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(buckets, np.int64)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares in target and source, floored."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


class _Gains(dict):
    """Gain of a word; forgets all when full."""

    def __init__(self, by_bucket: list[int]):
        self.by_bucket = by_bucket

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = gain = self.by_bucket[zlib.crc32(word) % len(self.by_bucket)]
        return gain


def noise(seed: int, doc_id: int | None) -> int:
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, by_bucket: np.ndarray, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    table = by_bucket.tolist()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = _Gains(table)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc = None if pd.isna(doc) else int(doc)
                found = words(text)
                summed, size = sum(map(gain.__getitem__, found)), len(found)
                if n > 1:
                    for crc in longer(found, n):
                        summed += table[crc % len(table)]
                        size += 1
                weight = summed // size if size else 0
                rows.append((doc, len(found), size, weight, weight + noise(seed, doc)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    # An id goes to Python as its digits, so that a batch with null ids keeps the others exact.
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(
        weigh, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """`scored` with rank: 1, 2, ... for the highest scores among documents of enough words."""
    able = F.col("n_words") >= least_words
    histogram = scored.filter(able).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    take = percent * int(histogram["count"].sum()) // 100
    before = (histogram["count"].cumsum() - histogram["count"]).to_numpy(np.int64)
    reached = histogram[before < take]
    scores = reached["score"].to_numpy(np.int64)
    least = int(scores[-1]) if len(scores) else None
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= least)
    offsets = scored.sparkSession.createDataFrame(
        pd.DataFrame({"score": scores, "before": before[: len(scores)]}), "score long, before long"
    )
    alike = scored.filter(high).groupBy(scored.columns).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(
        F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words"
    )
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        alike.withColumn("upto", upto)
        .join(F.broadcast(offsets), "score")
        .select(
            *scored.columns,
            F.explode(
                F.sequence(
                    F.col("before") + F.col("upto") - F.col("copies") + 1, F.col("before") + F.col("upto")
                )
            ).alias("place"),
        )
    )
    ranked = placed.select(*scored.columns, F.when(F.col("place") <= take, F.col("place")).alias("rank"))
    return scored.filter(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn) of every document."""
    by_bucket = gains(counted(docs, n, buckets), counted(target, n, buckets))
    scored = store(weighted(docs, by_bucket, n, seed), "weights")
    return drawn(scored, least_words, percent)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    target = corpus.table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL = rf"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
source AS (SELECT doc_id, r, unnest(w) AS w FROM doc),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM source UNION SELECT w FROM target)),
hashed AS (
  SELECT w, xor(list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2))::BIGINT for i in range(1, length(x) // 2 + 1)]),
    lambda c, b: list_reduce(
      [xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)
    ), 4294967295) % {BUCKETS} AS bucket FROM word),
s AS (SELECT bucket, count(*) AS s FROM source JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT range AS bucket, CAST(floor(1000 * ln(
    CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM source) + {BUCKETS}) AS DOUBLE)
    / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM target) + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM range({BUCKETS}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
summed AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g
  FROM source JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
weight AS (
  SELECT doc_id, r, coalesce(n, 0) AS n_features,
    CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM doc LEFT JOIN summed USING (r)),
scored AS (
  SELECT doc_id, r, n_features, weight,
    weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM weight),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank,
    count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)"""

ORACLE = {"op12_importance": _SQL}
