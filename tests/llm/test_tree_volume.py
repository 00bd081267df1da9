"""What the suffix tree's blocks send and store, and contexts that several buckets share."""

import os

import numpy as np

from tests.llm.test_suffixtree import scores_by_force
from wellkin.llm import suffixtree


def stored_bytes(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def test_stored_bytes_stay_below_the_text(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i:05d}" for i in range(20000)])
    texts = [" ".join(words[(rng.zipf(1.3, 400) - 1) % 20000]) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffixtree, "BLOCK_BYTES", 200_000)
    paths = iter(range(100))
    monkeypatch.setattr(suffixtree, "fresh_path", lambda spark, name: f"{tmp_path}/{name}{next(paths)}")
    if hasattr(suffixtree, "store"):
        monkeypatch.setattr("wellkin.plans.stored.fresh_path", suffixtree.fresh_path)
    assert suffixtree.score(frame).count() == 1500
    assert stored_bytes(tmp_path) < sum(map(len, texts))


def test_contexts_shared_by_buckets_score_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    table = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", f"r{i}"], 50))) for i in range(60)]
    monkeypatch.setattr(suffixtree, "BLOCK_BYTES", 1)
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, suffixtree.score(frame, 2, 4, 0.02, hot_count=30).collect()), key=repr)
    want, states = scores_by_force(table, 2, 4, 0.02)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    assert min(states.values()) > 0
