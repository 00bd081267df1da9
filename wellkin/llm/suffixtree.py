"""Language-model scores from a probabilistic suffix tree over words.

Texts are token sequences: words, then one end.  A context is a run of up to `DEPTH` words.
Its next-token distribution is its training counts mixed with the distribution of the context
one word shorter (Witten-Bell: the shorter one counts as many tokens as the context has
different successors), down to the smoothed word counts at the root.  A context is a state of
the tree if it is seen `LEAST_COUNT` times and its distribution differs from that of the
context one word shorter: their relative entropy, less what sampling alone is expected to give
(Miller and Madow), is at least `LEAST_BITS`.  A token is scored in the longest state that the
words before it end with.  Both bounds are absolute, so the tree grows with the corpus.

Nothing of the tree is gathered or broadcast but the sums of at most 10,000 contexts a level.
Documents are packed into blocks of bounded size.  A block sends its words' counts to the buckets
that own their hashes and gets the corpus counts back; then, level by level, the grams of one more
word behind every context that is frequent enough, to the bucket that owns the context.  So one
bucket sees all that follows a context, counts it, judges the context, and answers the blocks.  The
grams behind a very frequent context are dealt to several buckets, by hash; their partial sums are
added up by the driver.  Blocks and answers are stored in buckets by block, so no pass moves the
packed texts again.  A gram whose count is known is not sent: it is none if that of its part
without the first word is none, and its own where that part is in one block only and trained once;
of the latter their number goes with the context.

Defined results: a null or empty text is the end token alone; null ids are never held out;
repeated rows each train and get equal scores; without training rows N and V are 0 and every
token has probability one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus
from wellkin.plans.stored import fresh_path

FOLD = 7
#: Longest context in words, least training occurrences of a context, least divergence in bits.
DEPTH, LEAST_COUNT, LEAST_BITS = 2, 2, 0.02
#: Bytes of text of a block, of a storage bucket, and of a slice of a text that is split at once.
BLOCK_BYTES, STORED_BYTES, SLICE = 4_000_000, 4_000_000, 8_000_000
#: Grams that a counting bucket holds, and most counting and storage buckets.
BUCKET_GRAMS, MOST_BUCKETS, MOST_STORED = 1_000_000, 60_000, 20_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The end token's place among word hashes.
END = xxhash.xxh64_intdigest(b"\n")


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in slices that end with a word."""
    raw, start = (text or "").encode().translate(_LOWER), 0
    while start < len(raw):
        stop = _BLANK.search(raw, start + SLICE)
        end = stop.start() if stop else len(raw)
        yield raw[start:end].split()
        start = end


_PACK = "docs binary, named binary, held binary, lengths binary, ids binary, words binary, counts binary"


class _Packer:
    """Documents as numbers of words, words as hashes; the last word is the end token."""

    def __init__(self):
        self.docs, self.held, self.lengths, self.ids, self.place = [], [], [], [], {}

    def add(self, doc: int | None, held: bool, text: str | None) -> None:
        size = 0
        for part in words(text):
            for word in set(part).difference(self.place):
                self.place[word] = len(self.place)
            self.ids.append(np.fromiter(map(self.place.__getitem__, part), np.int32, len(part)))
            size += len(part)
        self.docs.append(doc)
        self.held.append(held)
        self.lengths.append(size)

    def packed(self) -> pd.DataFrame:
        ids = np.concatenate([*self.ids, np.zeros(0, np.int32)])
        held, lengths = np.array(self.held, bool), np.array(self.lengths, np.int32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.place), np.uint64, len(self.place))
        counts = np.bincount(ids[np.repeat(~held, lengths)], minlength=len(hashes) + 1)
        counts[-1] = (~held).sum()
        return pd.DataFrame(
            {
                "docs": [np.array([d or 0 for d in self.docs], np.int64).tobytes()],
                "named": [np.array([d is not None for d in self.docs], bool).tobytes()],
                "held": [held.tobytes()],
                "lengths": [lengths.tobytes()],
                "ids": [ids.tobytes()],
                "words": [np.append(hashes, np.uint64(END)).tobytes()],
                "counts": [counts.astype(np.int64).tobytes()],
            }
        )


def packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, size = _Packer(), 0
        for batch in batches:
            for doc, held, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                pack.add(None if doc is None else int(doc), held, text)
                size += len(text or "") + 1
                if size >= BLOCK_BYTES:
                    yield pack.packed()
                    pack, size = _Packer(), 0
        if pack.docs:
            yield pack.packed()

    # An id goes to Python as its digits, so that nulls beside it cost no precision.
    named = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), corpus.fold(FOLD).alias("held_out"), "text"
    )
    return named.mapInPandas(run, _PACK).withColumn("block", F.monotonically_increasing_id())


def _mixed(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a gram from the hash of all but its last word and that word's."""
    x = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of what travels: a context's hash, a gram's hash beside its context.
CONTEXT, GRAM = 6, 5
#: A context with as many training occurrences is dealt to several buckets, at least; and the most of them.
HOT_COUNT, MOST_HOT = 200_000, 10_000


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then their next ones, and so on: `width` planes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, :width] = planes.T
    return values.view("<u8").ravel()


def _numbers(values: np.ndarray) -> bytes:
    """Numbers of which most are small: the bytes of the largest, then as many planes."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + zlib.compress(_planes(values, width), 1)


def _read(raw: bytes) -> np.ndarray:
    return _values(zlib.decompress(raw[1:]), raw[0]).astype(np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=size).astype(bool)


def _keyed(codes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket in the upper two bytes, what is sent of the hash in the lower six."""
    n = np.uint64(n_buckets)
    return (codes % n) << np.uint64(48) | _low(codes // n, CONTEXT)


def _low(codes: np.ndarray, width: int) -> np.ndarray:
    return codes & np.uint64((1 << 8 * width) - 1)


def _steps(hashes: np.ndarray) -> bytes:
    """Hashes as steps from one to the next: where they ascend, the upper bytes are small."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)), CONTEXT)


def _hashes(steps: bytes) -> np.ndarray:
    return _low(np.cumsum(_values(steps, CONTEXT), dtype=np.uint64), CONTEXT)


def _first(index: np.ndarray, size: int) -> np.ndarray:
    """Where each number comes first."""
    first = np.empty(size, np.int64)
    first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
    return first


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class _Level:
    """The different grams of one length in a block, in the order in which buckets get them.

    Runs are the contexts of the grams of a bucket.  Of the bucket number, the lowest bit tells
    that it is one of several that share the context."""

    def __init__(self, n_buckets: int, at, index, codes, parent, contexts, own, n, shorter, under, alone, hot_from: int):
        self.at, self.index, self.codes, self.own = at, index, codes, own
        self.shorter, self.under = shorter, under
        self.asked = (under > 1) | (under == 1) & ~alone
        # Contexts in the order of their buckets and of what is sent of their hashes.
        met = np.flatnonzero(np.bincount(parent, minlength=len(contexts)))
        keys = _keyed(contexts[met], n_buckets)
        place = np.empty(len(contexts), np.int64)
        place[met[np.argsort(keys, kind="stable")]] = np.arange(len(met))
        rank, key = place[parent], np.sort(keys)
        bucket, self.context = (key >> np.uint64(48))[rank], _low(key, CONTEXT)[rank]
        self.gram = _low(codes // np.uint64(n_buckets), GRAM)
        self.hot = n >= hot_from
        if self.hot.any():
            parts, code = (1 + n[self.hot] // hot_from).astype(np.uint64), codes[self.hot] // np.uint64(n_buckets)
            bucket[self.hot] = (bucket[self.hot] + code % parts) % np.uint64(n_buckets)
            self.bucket = bucket * np.uint64(2) + self.hot
            self.order = np.lexsort((rank, self.bucket))
        else:
            self.bucket = bucket * np.uint64(2)
            # All keys differ, so their order does not depend on how they are sorted.
            low = np.sort(rank.astype(np.uint64) << np.uint64(32) | np.arange(len(rank), dtype=np.uint64))
            self.order = _low(low, 4).astype(np.int64)
        self.runs = _starts(self.bucket[self.order], self.context[self.order])
        self.total = self.alone = self.successors = self.kept = None

    def dealt(self, block: int) -> pd.DataFrame:
        """One row for each bucket: its contexts, and the grams behind each of them."""
        head = self.order[self.runs]
        own = _starts(self.bucket[head])
        asked = self.asked[self.order]
        sizes = np.add.reduceat(asked, self.runs, dtype=np.int64)
        ones = np.add.reduceat(np.where(asked, 0, self.own[self.order]), self.runs)
        runs = np.split(np.arange(len(head)), own[1:])
        grams = [g[self.asked[g]] for g in np.split(self.order, self.runs[own[1:]])]
        made = {"block": block, "bucket": self.bucket[head][own].astype(np.int64)}
        made["contexts"] = [_steps(self.context[head[r]]) for r in runs]
        made["sizes"] = [_numbers(sizes[r]) for r in runs]
        made["ones"] = [_numbers(ones[r]) for r in runs]
        made["shorter"] = [_numbers(self.shorter[head[r]]) for r in runs]
        made["grams"] = [_planes(self.gram[g], GRAM) for g in grams]
        made["counts"] = [_numbers(self.own[g]) for g in grams]
        made["under"] = [_numbers(self.under[g]) for g in grams]
        return pd.DataFrame(made)

    def know(self, answers, hot: np.ndarray) -> None:
        """Counts of the grams and whether no other block has them, and of their contexts the
        successors and whether they are states."""
        self.total, self.alone = self.own.copy(), ~self.asked
        self.successors, self.kept = np.zeros(len(self.own), np.int64), np.zeros(len(self.own), bool)
        sent = _in_order(answers)
        if not sent:
            return
        asked = self.order[self.asked[self.order]]
        others, self.alone[asked] = _heard(sent)
        self.total[asked] += others
        each = [_read(a["successors"]) for a in sent]
        sizes = np.diff(np.append(self.runs, len(self.order)))
        self.successors[self.order] = np.repeat(np.concatenate(each), sizes)
        kept = [_flags(a["kept"], len(e)) for a, e in zip(sent, each, strict=True)]
        self.kept[self.order] = np.repeat(np.concatenate(kept), sizes)
        shared = np.flatnonzero(self.hot)
        if len(shared):
            found = np.searchsorted(hot["context"], self.context[shared])
            self.successors[shared], self.kept[shared] = hot["successors"][found], hot["kept"][found]


class Block:
    """A block's tokens in one run, and what is known of the grams that end at each of them."""

    def __init__(self, row, least_count: int = LEAST_COUNT):
        self.least_count = least_count
        lengths = np.frombuffer(row.lengths, np.int32).astype(np.int64)
        words, ids = np.frombuffer(row.words, np.uint64), np.frombuffer(row.ids, np.int32)
        self.lengths = lengths + 1
        ends = np.cumsum(self.lengths) - 1
        self.starts = ends - lengths
        self.stream = np.full(len(ids) + len(lengths), len(words) - 1, np.int32)
        inner = np.ones(len(self.stream), bool)
        inner[ends] = False
        self.stream[inner] = ids
        self.place = np.arange(len(self.stream)) - np.repeat(self.starts, self.lengths)
        self.held = np.frombuffer(row.held, bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.words = words
        #: Of the grams counted last: their hashes, and the number of the one that ends at each place.
        self.codes, self.number = words, self.stream
        self.counts: list[np.ndarray] = []
        self.levels: list[_Level] = []

    def know_words(self, totals: np.ndarray, alone: np.ndarray) -> None:
        self.counts.append(totals[self.stream])
        #: Where the gram counted last is one that no other block has.
        self.alone = alone[self.stream]

    def open_level(self, tokens: int, n_buckets: int, hot_from: int) -> _Level:
        """The grams behind each context of the next length that is frequent enough."""
        length, last = len(self.counts), self.counts[-1]
        at = np.flatnonzero(self.place >= length)
        # At `at - 1` ends the context, a gram counted one level before.
        at = at[last[at - 1] >= self.least_count]
        index, made = pd.factorize(self.number[at - 1].astype(np.int64) * len(self.words) + self.stream[at])
        first = at[_first(index, len(made))]
        parent, own = made // len(self.words), np.bincount(index, self.train[at], len(made)).astype(np.int64)
        codes = _mixed(self.codes[parent], self.words[self.stream[first]])
        shorter = self.counts[-2][first - 1] if length > 1 else np.full(len(first), tokens)
        level = _Level(
            n_buckets, at, index, codes, parent, self.codes, own,
            last[first - 1], shorter, last[first], self.alone[first], hot_from,
        )
        self.levels.append(level)
        return level

    def know_level(self, answers, hot: np.ndarray) -> None:
        level, size = self.levels[-1], len(self.stream)
        level.know(answers, hot)
        counts, self.alone, self.number = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, np.int64)
        counts[level.at] = level.total[level.index]
        self.alone[level.at] = level.alone[level.index]
        self.number[level.at], self.codes = level.index, level.codes
        self.counts.append(counts)

    def scores(self, tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each document by its words alone and by the tree."""
        root = (self.counts[0] + 1) / (tokens + distinct + 1.0)
        state, chain = root.copy(), root
        for length, level in enumerate(self.levels, 1):
            at = level.at
            mass = level.successors[level.index].astype(float)
            context_n = self.counts[length - 1][at - 1]
            longer = np.zeros(len(root))
            longer[at] = (self.counts[length][at] + mass * chain[at]) / (context_n + mass)
            state[at] = np.where(level.kept[level.index], longer[at], state[at])
            chain = longer
        return tuple(np.add.reduceat(np.log10(p), self.starts) for p in (root, state))


_WORDS = "block long, bucket long, grams binary, counts binary"
_GRAMS = (
    "block long, bucket long, contexts binary, sizes binary, ones binary, shorter binary,"
    " grams binary, counts binary, under binary"
)
_TOTALS = "block long, bucket long, others binary, alone binary, tokens long, distinct long"
_JUDGED = (
    "block long, bucket long, others binary, alone binary, successors binary, kept binary, shared binary"
)
#: What one bucket knows of a context that several share.
_SHARED = np.dtype([(n, "<u8") for n in ("context", "shorter", "n", "successors")] + [("gap", "<f8")])


def _dealt_words(block: int, words: np.ndarray, counts: np.ndarray, n_buckets: int) -> pd.DataFrame:
    key = _keyed(words, n_buckets)
    order = np.argsort(key, kind="stable")
    bucket, sent = key[order] >> np.uint64(48), _low(key[order], CONTEXT)
    own = _starts(bucket)
    made = {"block": block, "bucket": bucket[own].astype(np.int64)}
    made["grams"] = [_steps(p) for p in np.split(sent, own[1:])]
    made["counts"] = [_numbers(p) for p in np.split(counts[order], own[1:])]
    return pd.DataFrame(made)


def _in_order(answers) -> list:
    return sorted(answers if answers is not None else [], key=lambda a: a["bucket"])


def _heard(sent: list) -> tuple[np.ndarray, np.ndarray]:
    """How often the asked grams are in other blocks, and whether none of these has them."""
    others = [_read(a["others"]) for a in sent]
    alone = [_flags(a["alone"], len(o)) for a, o in zip(sent, others, strict=True)]
    return np.concatenate(others), np.concatenate(alone)


def _told_words(answers, words: np.ndarray, counts: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of a block's words, and which are in no other, from the buckets' answers."""
    total, alone = counts.copy(), np.zeros(len(words), bool)
    if sent := _in_order(answers):
        order = np.argsort(_keyed(words, n_buckets), kind="stable")
        others, alone[order] = _heard(sent)
        total[order] += others
    return total, alone


def _each(values: np.ndarray, sizes: list[int], write) -> list[bytes]:
    return [write(v) for v in np.split(values, np.cumsum(sizes)[:-1])]


def _totalled(rows: pd.DataFrame) -> pd.DataFrame:
    """How often the words that each block sent occur elsewhere, in its order."""
    sent = [_hashes(g) for g in rows["grams"]]
    counts, sizes = np.concatenate([_read(c) for c in rows["counts"]]), [len(s) for s in sent]
    index, _ = pd.factorize(np.concatenate(sent))
    total = np.bincount(index, counts).astype(np.int64)
    out = rows[["block", "bucket"]].copy()
    out["others"] = _each(total[index] - counts, sizes, _numbers)
    out["alone"] = _each((np.bincount(index) == 1)[index], sizes, _bits)
    out["tokens"], out["distinct"] = 0, 0
    out.iloc[0, out.columns.get_loc("tokens")] = int(total.sum())
    out.iloc[0, out.columns.get_loc("distinct")] = int((total > 0).sum())
    return out


def _is_state(n, shorter, successors, gap, least_bits: float) -> np.ndarray:
    bits = gap / n + np.log2(shorter / n)
    expected = (successors.astype(float) - 1) / (2 * n * np.log(2))
    return bits - expected >= least_bits


def _judged(rows: pd.DataFrame, least_bits: float) -> pd.DataFrame:
    """The same of the grams, and what they tell of the contexts before them."""
    sent = [_hashes(c) for c in rows["contexts"]]
    runs, lengths = [len(c) for c in sent], [len(g) // GRAM for g in rows["grams"]]
    each = {
        name: np.concatenate([_read(v) for v in rows[name]])
        for name in ("sizes", "ones", "shorter", "counts", "under")
    }
    grams = np.concatenate([_values(g, GRAM) for g in rows["grams"]])
    place, contexts = pd.factorize(np.concatenate(sent))
    first, size, counts = _first(place, len(contexts)), len(contexts), each["counts"]
    parent = np.repeat(place, each["sizes"]).astype(np.uint64)
    index, made = pd.factorize(parent << np.uint64(8 * GRAM) | grams)
    total = np.bincount(index, counts, len(made)).astype(np.int64)
    seen = total > 0
    of = (made[seen] >> np.uint64(8 * GRAM)).astype(np.int64)
    under, t = each["under"][_first(index, len(made))][seen], total[seen]
    # A gram that is not sent has one occurrence, as has the shorter one: it adds nothing to the gap.
    ones = np.bincount(place, each["ones"], size)
    n, successors = np.bincount(of, t, size) + ones, np.bincount(of, minlength=size) + ones.astype(np.int64)
    gap = np.bincount(of, t * (np.log2(t) - np.log2(under)), size)
    out = rows[["block", "bucket"]].copy()
    out["others"] = _each(total[index] - counts, lengths, _numbers)
    out["alone"] = _each((np.bincount(index, minlength=len(made)) == 1)[index], lengths, _bits)
    out["successors"] = _each(successors[place], runs, _numbers)
    shorter, kept, out["shared"] = each["shorter"][first], np.zeros(size, bool), None
    if rows["bucket"].iloc[0] % 2:
        known = np.empty(size, _SHARED)
        for name, values in zip(_SHARED.names, (contexts, shorter, n, successors, gap), strict=True):
            known[name] = values
        out.iloc[0, out.columns.get_loc("shared")] = known.tobytes()
    else:
        kept = _is_state(n, shorter, successors, gap, least_bits)
    out["kept"] = _each(kept[place], runs, _bits)
    return out[["block", "bucket", "others", "alone", "successors", "kept", "shared"]]


def _added(shared: list[bytes], least_bits: float) -> np.ndarray:
    """The contexts that several buckets share, by their hashes, with successors and verdict."""
    parts = np.frombuffer(b"".join(shared), _SHARED)
    contexts, first, place = np.unique(parts["context"], return_index=True, return_inverse=True)
    n, successors, gap = (
        np.bincount(place, parts[name].astype(float), len(contexts)) for name in ("n", "successors", "gap")
    )
    out = np.zeros(len(contexts), [("context", "<u8"), ("successors", "<i8"), ("kept", "?")])
    out["context"], out["successors"] = contexts, successors
    out["kept"] = _is_state(n, parts["shorter"][first], successors, gap, least_bits)
    return out


def _kept(df: DataFrame, name: str, n: int) -> DataFrame:
    """`df` written in `n` buckets by block, so that joins by block need no exchange."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    made = df.write.bucketBy(n, "block").option("path", fresh_path(spark, name))
    made.option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


class _Corpus:
    """Packed blocks, with what they have been told so far."""

    def __init__(self, docs: DataFrame, depth: int, least_count: int, least_bits: float, hot_count: int):
        self.depth, self.least_count, self.least_bits = depth, least_count, least_bits
        n_bytes = corpus.text_bytes(docs)
        self.stored = min(MOST_STORED, corpus.blocks_for(n_bytes, STORED_BYTES, 12))
        # Their numbers fit two bytes beside a hash.
        self.n_buckets = min(MOST_BUCKETS, corpus.blocks_for(n_bytes // 8, BUCKET_GRAMS, 64))
        # A task holds few blocks, so it writes few files without an exchange.
        self.blocks = _kept(packed(docs), "blocks", self.stored)
        self.shared: list[np.ndarray] = []
        n_buckets = self.n_buckets

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    codes, counts = np.frombuffer(row.words, np.uint64), np.frombuffer(row.counts, np.int64)
                    yield _dealt_words(row.block, codes, counts, n_buckets)

        asked = self.blocks.select("block", "words", "counts").mapInPandas(ask, _WORDS)
        answers = asked.groupBy("bucket").applyInPandas(_totalled, _TOTALS)
        sums = [F.sum(c).alias(c) for c in ("tokens", "distinct")]
        total = self._told(answers, "answers0", ("others", "alone"), sums).agg(*[F.sum(c) for c in ("tokens", "distinct")])
        self.tokens, self.distinct = (n or 0 for n in total.first())
        self.hot_from = max(hot_count, self.tokens // MOST_HOT)

    def _told(self, answers: DataFrame, name: str, columns: tuple[str, ...], more: list) -> DataFrame:
        """Adds each block's answers to it; returns them stored, with `more` aggregates of theirs."""
        sent = F.collect_list(F.struct("bucket", *columns)).alias(name)
        each = answers.repartition(self.stored, "block").groupBy("block").agg(sent, *more)
        kept = _kept(each, name, self.stored)
        self.blocks = self.blocks.join(kept.select("block", name), "block", "left")
        return kept

    def reader(self):
        """Makes a block of a row, with the counts of its words and of the levels known so far."""
        n_buckets, least, tokens, shared = self.n_buckets, self.least_count, self.tokens, list(self.shared)
        hot_from = self.hot_from

        def read(row) -> Block:
            block = Block(row, least)
            words, counts = np.frombuffer(row.words, np.uint64), np.frombuffer(row.counts, np.int64)
            block.know_words(*_told_words(row.answers0, words, counts, n_buckets))
            for length, hot in enumerate(shared, 1):
                block.open_level(tokens, n_buckets, hot_from)
                block.know_level(getattr(row, f"answers{length}"), hot)
            return block

        return read

    def deepen(self) -> None:
        """Count the grams one word longer than those counted and judge the contexts before them."""
        read, least_bits = self.reader(), self.least_bits
        tokens, n_buckets, hot_from = self.tokens, self.n_buckets, self.hot_from

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    level = read(row).open_level(tokens, n_buckets, hot_from)
                    if len(level.own):
                        yield level.dealt(row.block)

        needed = self.blocks.drop("docs", "named")
        judged = needed.mapInPandas(run, _GRAMS).groupBy("bucket").applyInPandas(
            lambda rows: _judged(rows, least_bits), _JUDGED
        )
        name = f"answers{len(self.shared) + 1}"
        shared = F.collect_list("shared").alias("shared")
        kept = self._told(judged, name, ("others", "alone", "successors", "kept"), [shared])
        # At most two rows for each `hot_from` training tokens.
        found = [r[0] for r in kept.select(F.explode("shared")).collect()]
        self.shared.append(_added(found, least_bits))


def score(
    docs: DataFrame,
    depth: int = DEPTH,
    least_count: int = LEAST_COUNT,
    least_bits: float = LEAST_BITS,
    hot_count: int = HOT_COUNT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    tree = _Corpus(docs, depth, least_count, least_bits, hot_count)
    for _ in range(depth):
        tree.deepen()
    read, tokens, distinct = tree.reader(), tree.tokens, tree.distinct

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = read(row)
                base, scores = block.scores(tokens, distinct)
                known_words = (block.counts[0] > 0).astype(np.int64)
                named = np.frombuffer(row.named, bool)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.arrays.IntegerArray(np.frombuffer(row.docs, np.int64).copy(), ~named),
                        "held_out": block.held,
                        "n_tokens": block.lengths,
                        "n_known": np.add.reduceat(known_words, block.starts),
                        "train_tokens": tokens,
                        "base_score": base,
                        "score": scores,
                    }
                )

    return tree.blocks.mapInPandas(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double",
    )


def op3_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))
