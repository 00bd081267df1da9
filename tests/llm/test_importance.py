"""Importance resampling against a plain computation, and the SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from tests.llm.conftest import rows
from wellkin.llm import importance

TARGET = ["word1 tail3 word5", None, "", "Word! word1-tail3", "é ünï word5 word5"]
SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string"


def features(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SPLIT.findall(lower)
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def by_force(table, target, n, buckets, seed, least, percent):
    s, t = Counter(), Counter()
    for _, text in table:
        s.update(f % buckets for f in features(text, n)[1])
    for text in target:
        t.update(f % buckets for f in features(text, n)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    }
    out = []
    for doc, text in table:
        n_words, found = features(text, n)
        weight = math.floor(sum(gain[f % buckets] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc, n_words, len(found), weight, score, None])
    able = [r for r in out if r[1] >= least]
    last = lambda r: (-r[4], r[0] is None, r[0], r[2], r[3])
    for rank, r in enumerate(sorted(able, key=last)[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def table():
    copies = [(300, "one two three four five six seven " * 4)] * 9
    ties = [(i % 3 + 400, "word1 tail3 word5 " * 8) for i in range(9)]
    return [(r[0], r[1]) for r in rows()] + copies + ties + [(None, "no id " * 20)] * 3


@pytest.mark.parametrize(
    "n, buckets, least, percent", [(1, 10_000, 20, 10), (3, 97, 5, 60), (2, 1_000, 1, 100), (1, 10, 20, 0)]
)
def test_by_force(spark, table, n, buckets, least, percent):
    docs = spark.createDataFrame(table, SCHEMA).repartition(4)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    made = importance.resample(docs, target, n, buckets, 2024, least, percent)
    want = by_force(table, TARGET, n, buckets, 2024, least, percent)
    # Rows alike in all but their rank share its ranks in any order.
    assert sorted(map(tuple, made.collect()), key=repr) == want


def test_words_beyond_the_memory_of_a_worker(monkeypatch, table):
    gain = importance._Gains([1, 2, 3])
    monkeypatch.setattr(importance, "HELD", 2)
    for word in (b"a", b"b", b"c", b"a"):
        assert gain[word] == [1, 2, 3][zlib.crc32(word) % 3] and len(gain) <= 2


def test_other_columns_and_empty_tables(spark, table):
    docs = spark.createDataFrame(table, SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    named = docs.select("*", *[F.lit("x").alias(c) for c in ("score", "weight", "rank", "copies", "before")])
    plain = sorted(map(tuple, importance.resample(docs, target).collect()), key=repr)
    assert sorted(map(tuple, importance.resample(named, target).collect()), key=repr) == plain
    assert importance.resample(docs.limit(0), target).collect() == []
    none = importance.resample(docs, target.limit(0)).collect()
    assert len(none) == len(table)


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    name = "op12_importance"
    assert difference(importance.op12_importance(spark, path), connect(path), importance.ORACLE[name]) is None
