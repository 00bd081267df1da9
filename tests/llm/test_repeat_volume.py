"""What the repeat search sends grows with repeats, not with common words or copies."""

import numpy as np
import pandas as pd

from wellkin.llm import repeats


def _block(texts, block=0):
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).assign(block=block)
    return rows.assign(id=rows["doc_id"] + 1000 * block, row_key=range(len(texts)))


def _answered(blocks, n_buckets=4):
    sent = pd.concat([repeats._anchors(b, n_buckets) for b in blocks])
    return pd.concat([repeats._repeated(g) for _, g in sent.groupby("bucket")])


def test_an_anchor_alone_sends_nothing():
    rng = np.random.default_rng(5)

    def noise():
        return "".join(chr(c) for c in rng.integers(97, 123, 100))

    # The words of 24 bytes are common to all texts, no window of 50 bytes is.
    texts = [f"{noise()} of the common words of {noise()}" for _ in range(300)]
    assert not len(_answered([_block(texts)]))


def test_copies_of_a_passage_are_not_hot(monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    passage = "".join(chr(c) for c in np.random.default_rng(6).integers(97, 123, 400))
    answered = _answered([_block([passage] * 30, b) for b in (0, 1)])
    assert len(answered) and all(not any(h) for h in answered["hot"])
