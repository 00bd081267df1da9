"""Quality rules by line labelling with a linear-chain conditional random field.

Each line of a text is described by a few yes/no features; the field scores labels from them
and from the label before, and Viterbi decoding marks every line content or boilerplate.  A
text is kept if content holds at least half of its characters and no base rule failed.

The field is trained by maximum likelihood on a bounded sample of documents with a quality
label, whose lines all take the document's label.  Defined results: null and empty texts have
no words, fail the base rule and are not kept; without labelled rows every line counts as
content; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus

#: Base rules: fewest words, highest per cent of repeated words.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Share of characters in content lines that keeps a text.
CONTENT_SHARE = 0.5
#: Labelled documents to learn from, most lines of one of them, steps, step size, penalty.
SAMPLE, SAMPLE_LINES, STEPS, RATE, PENALTY = 4_000, 60, 80, 0.15, 1e-3
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_BLANKS = " \t\n\v\f\r"
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
    np.uint64,
)

#: Bits of a line's features; a further bit, the bias, is always set.
FEATURES = (
    "few_words", "one_word", "long_line", "some_symbols", "many_symbols", "repeats", "mostly_repeats",
    "capitals", "digits", "sentence_end", "shouting", "seen_before", "notice", "long_words", "bias",
)
NOTICES = ("rights reserved", "copyright", "cookie", "subscribe", "click here", "log in", "sign up")

#: Line weights per label (boilerplate, content) and transition weights.
Field = tuple[np.ndarray, np.ndarray]


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(29))
    code = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        code += mixed[k : n - WINDOW + 1 + k] * _MULTIPLIERS[k]
        code ^= code >> np.uint64(31)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice[: len(code)])
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def line_features(text: str) -> tuple[list[int], list[int]]:
    """Feature bits and length of every line with a word."""
    masks, sizes, seen = [], [], set()
    bias = 1 << (len(FEATURES) - 1)
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        symbols = sum(map(line.count, SYMBOLS))
        distinct = len(set(words))
        lower = line.lower()
        upper = sum(map(str.isupper, words)) if line != lower else 0
        digits = sum(map(line.count, "0123456789"))
        mask = (
            bias
            | (n < 5)
            | (n == 1) << 1
            | (n > 60) << 2
            | (symbols * 50 > size) << 3
            | (symbols * 10 > size) << 4
            | (distinct * 4 < n * 3 and n > 9) << 5
            | (distinct * 2 < n and n > 9) << 6
            | (upper * 2 > n) << 7
            | (digits * 10 > size) << 8
            | (line.rstrip()[-1] in ".!?:;\"'") << 9
            | (lower.count("!!") * 4 > n) << 10
            | (line in seen) << 11
            | any(map(lower.__contains__, NOTICES)) << 12
            | (size > 20 * n) << 13
        )
        seen.add(line)
        masks.append(mask)
        sizes.append(size)
    return masks, sizes


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[..., None] >> np.arange(len(FEATURES)) & 1).astype(float)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp over an axis of two."""
    a, b = np.take(x, 0, axis), np.take(x, 1, axis)
    return np.logaddexp(a, b)


def fit(sequences: list[list[int]], labels: list[int]) -> Field:
    """Maximum likelihood by Adam; forward and backward sums run over all sequences at once."""
    known = [(s, y) for s, y in zip(sequences, labels, strict=True) if s]
    k = len(FEATURES)
    if len({y for _, y in known}) < 2:
        lean = np.zeros((k, 2))
        lean[-1, 1] = 1.0
        return lean, np.zeros((2, 2))
    longest = max(len(s) for s, _ in known)
    masks = np.array([s + [0] * (longest - len(s)) for s, _ in known])
    size = np.array([len(s) for s, _ in known])
    label = np.array([y for _, y in known])
    real = np.arange(longest)[None, :] < size[:, None]
    x = _bits(masks)
    n, lines = len(known), size.sum()
    truth = np.einsum("ntk,nl->kl", x * real[..., None], np.eye(2)[label])
    steps_true = np.diag([(size - 1)[label == c].sum() for c in (0, 1)]).astype(float)
    params, first, second = ([np.zeros((k, 2)), np.zeros((2, 2))] for _ in range(3))
    for step in range(1, STEPS + 1):
        w, move = params
        score = x @ w
        forward = np.zeros((longest, n, 2))
        forward[0] = score[:, 0]
        for t in range(1, longest):
            come = _log_sum(forward[t - 1][:, :, None] + move, 1) + score[:, t]
            forward[t] = np.where(real[:, t, None], come, forward[t - 1])
        total = _log_sum(forward[-1], 1)
        backward, pairs = np.zeros((n, 2)), np.zeros((2, 2))
        expected = np.zeros((k, 2))
        for t in range(longest - 1, -1, -1):
            on = real[:, t, None]
            marginal = np.exp(forward[t] + backward - total[:, None]) * on
            expected += x[:, t].T @ marginal
            if t:
                ahead = score[:, t] + backward
                both = forward[t - 1][:, :, None] + move + ahead[:, None, :] - total[:, None, None]
                pairs += (np.exp(both) * on[..., None]).sum(axis=0)
                backward = np.where(
                    on, _log_sum(move[None] + ahead[:, None, :], 2), backward
                )
        grads = [(expected - truth) / lines + PENALTY * w, (pairs - steps_true) / lines + PENALTY * move]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1]


def viterbi(scores: list[tuple[float, float]], move: list[list[float]]) -> list[int]:
    """Best labels of a sequence of (boilerplate, content) line scores."""
    if not scores:
        return []
    (bb, bc), (cb, cc) = move
    b, c = scores[0]
    back = []
    for sb, sc in scores[1:]:
        from_b, from_c = b + bb >= c + cb, b + bc > c + cc
        back.append((not from_b, not from_c))
        b, c = max(b + bb, c + cb) + sb, max(b + bc, c + cc) + sc
    now = c >= b
    out = [int(now)]
    for to_b, to_c in reversed(back):
        now = to_c if now else to_b
        out.append(int(now))
    return out[::-1]


def content_share(text: str | None, field: Field, known: dict[int, tuple[float, float]]) -> float:
    """Share of characters in lines that decode as content; 0 without lines."""
    masks, sizes = line_features(text or "")
    if not masks:
        return 0.0
    weights, move = field
    for m in masks:
        if m not in known:
            known[m] = tuple((_bits(np.array(m)) @ weights).tolist())
    labels = viterbi([known[m] for m in masks], move.tolist())
    return sum(s for s, y in zip(sizes, labels, strict=True) if y) / sum(sizes)


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Field:
    """Fit on at most `size` labelled documents of few lines, lowest id hashes first."""
    digest = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    labelled = labels.filter("quality is not null and doc_id is not null")
    known = (
        corpus.low_hashes(labelled.select("doc_id", "quality"), digest, size)
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "k")
        .orderBy("k", "quality")
        .limit(size)
    )

    @F.pandas_udf("array<int>")
    def described(text: pd.Series) -> pd.Series:
        return text.map(lambda t: line_features(t)[0])

    sample = (
        docs.select("doc_id", "text")
        .filter(F.size(F.split("text", "\n")) <= SAMPLE_LINES)
        .join(F.broadcast(known), "doc_id")
        .select("k", "quality", described("text").alias("lines"))
        .orderBy("k", "quality", "lines")
        .limit(size)
    )

    def fitted(rows: pd.DataFrame) -> Field:
        lines = [[int(m) for m in x] for x in rows["lines"]]
        order = sorted(range(len(rows)), key=lambda i: (rows["k"].iloc[i], lines[i]))
        labels = (rows["quality"] > 0).astype(int).tolist()
        return fit([lines[i] for i in order], [labels[i] for i in order])

    return corpus.fit_in_task(sample, fitted)


_OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " content_share double"
)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, content_share, base_failed and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf(_OUT)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field, known = shared.value, {}
        names = [part.split()[0] for part in _OUT.split(",")]
        for batch in batches:
            rows = [(*base_counts(t), content_share(t, field, known)) for t in batch]
            yield pd.DataFrame(rows, columns=names)

    m = docs.select("doc_id", measured("text").alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    verdict = ~failed & (F.col("content_share") >= CONTENT_SHARE)
    return m.select("*", failed.alias("base_failed"), verdict.alias("kept"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, corpus.table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "content_share",
    )
