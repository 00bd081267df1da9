"""Exact repeats across documents from sparse enhanced suffix arrays.

Every window of `WINDOW` bytes has an anchor: the place of the smallest hash of its KEY-byte
strings.  Equal windows have equal anchors at equal places, so a window can only repeat where
its anchor's string does.  The work has three passes over blocks of documents:

1. A window that starts at least `HALF` bytes before its anchor holds the anchor's string and the
   HALF bytes before it, any other the string and the `AHEAD` bytes after it.  Blocks send the
   hashes of these longer strings, each once per block, to the bucket that owns the anchor's;
   buckets answer with those that occur in two documents.  The anchor's own 16 bytes, a few
   words, recur ever more often as a corpus grows, the longer strings hardly do.
2. For each answered string the block sends the bytes around its anchor (all windows that hold
   the string, those of both strings of an anchor together), equal contexts of a block once.  A bucket builds a suffix array of the anchors, with the
   longest common prefixes of neighbours, and scans it with a stack into the tree of common
   prefix intervals.  A window that starts j bytes before its anchor belongs to the interval
   whose prefix reaches its end; if the left extensions of the interval's members by j bytes
   are one string, the interval is one group of occurrences, else it is split by them.  The
   smallest document of each group of all occurrences is what decides removal.
3. The answered windows of a document are united into spans and cut out.

Neither a group's occurrences nor an anchor's contexts gather in one place without bound:
blocks send a context once, whatever its copies; the windows of an anchor of which blocks would
send more than `HOT` contexts go to the owners of its longer strings, and those of a longer string
with more than `HOT` contexts one by one to the owner of the window's bytes.  Copies of a passage
in many documents are one context of a block, so they do not make it hot.

Defined results: a null text is empty; texts shorter than a window keep all; rows with equal
ids never remove bytes from each other; a null id counts as larger than every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellkin.llm import corpus

#: Bytes of a repeated string, and of an anchor's string (at least 16, at most 24).
WINDOW, KEY = 50, 16
#: Text of a block, anchors of a bucket, bytes handled at once, contexts of a hot anchor.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES, HOT = 4_000_000, 16_000_000, 1 << 22, 4_096
NO_ID = (1 << 63) - 1
#: Bytes before an anchor's string, or after it, that the longer strings have.
HALF = (WINDOW - KEY) // 2
AHEAD = WINDOW - KEY - HALF + 1
#: Bytes of a hash as it is sent: two of the anchor's string, three of the longer string.
SENT = 5

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _key_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KEY bytes from every place on."""
    n = len(raw) - KEY + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for at, odd in zip((0, 8, KEY - 8), _ODD, strict=True):
        word = np.ndarray((n,), "<u8", raw.data, at, (1,))
        code ^= word * odd
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def _longer(hashes: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Hashes of strings that the KEY bytes from each of the places cover."""
    code = np.full(len(places[0]), len(places[0]) and 1, np.uint64)
    for place, odd in zip(places, _ODD, strict=True):
        code = (code ^ hashes[place]) * odd
        code ^= code >> np.uint64(31)
    return code


def _runs(raw: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """Runs of windows with one anchor and longer string: start, count, anchor (places in raw),
    hash of the anchor's string, hash of the longer string, hash of the context's two ends.

    `ends` are the ends of the texts that raw is made of; no window crosses one.
    """
    hashes = _key_hashes(raw)
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("start", "n", "anchor", "hash", "longer", "ends")})
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    low = np.uint64(max(1, int(len(raw)).bit_length()))
    least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    span, have = WINDOW - KEY + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if rest := span - have:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least[:n] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    inside = np.ones(n + 1, bool)
    inside[n] = False
    for end in ends:
        inside[max(0, end - WINDOW + 1) : min(n, end)] = False
    place = np.where(inside[:n], anchor, -1)
    change = np.flatnonzero(np.diff(place)) + 1
    starts = np.concatenate([[0], change])
    counts = np.diff(np.concatenate([starts, [n]]))
    good = place[starts] >= 0
    starts, counts = starts[good], counts[good]
    at = place[starts]
    # Windows that hold the bytes before the anchor come first, then those that hold the bytes after.
    early = np.clip(at - HALF - starts + 1, 0, counts)
    starts = np.stack([starts, starts + early], 1).ravel()
    counts = np.stack([early, counts - early], 1).ravel()
    at, after = np.repeat(at, 2), np.tile([False, True], len(at))
    some = counts > 0
    starts, counts, at, after = starts[some], counts[some], at[some], after[some]
    longer = np.empty(len(at), np.uint64)
    low, high = at[~after], at[after]
    longer[~after] = _longer(hashes, (low - HALF, low - HALF // 2, low))
    longer[after] = _longer(hashes, (high + AHEAD, high, high + AHEAD // 2))
    made = {"start": starts, "n": counts, "anchor": at, "hash": hashes[at].view(np.int64)}
    ends_of = _longer(hashes, (starts, at, starts + counts - 1 + WINDOW - KEY))
    return pd.DataFrame(made | {"longer": longer.view(np.int64), "ends": ends_of.view(np.int64)})


def _codes(runs: pd.DataFrame, n_buckets: int) -> np.ndarray:
    """Bucket and sent hash of each run; the bucket and the highest bytes are the anchor's alone."""
    key, longer = (runs[c].to_numpy(np.int64).view(np.uint64) for c in ("hash", "longer"))
    bits = np.uint64(8 * SENT)
    own = (key & np.uint64(0xFFFF)) << np.uint64(24) | (longer & np.uint64(0xFFFFFF))
    return ((key >> np.uint64(32)) % np.uint64(n_buckets)) << bits | own


def _packed(keys: np.ndarray) -> bytes:
    """The sent hashes, byte by byte: the highest of all, which are in order, side by side."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, SENT - 1 :: -1].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(SENT, -1)
    keys = np.zeros((planes.shape[1], 8), np.uint8)
    keys[:, :SENT] = planes[::-1].T
    return keys.view("<u8").ravel()


def _parts(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """(bytes, text ends, rows) of the texts of a block, PART_BYTES and one text at most over."""
    texts = [(t or "").encode() for t in rows["text"]]
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PART_BYTES or i == len(texts) - 1:
            part = texts[first : i + 1]
            ends = np.cumsum([len(t) for t in part])
            yield np.frombuffer(b"".join(part), np.uint8), ends, rows.iloc[first : i + 1]
            first, size = i + 1, 0


def _row_ranks(rows: pd.DataFrame) -> np.ndarray:
    """Rank of each row of a block by its key, the same in whatever order the rows come."""
    return np.unique(rows["row_key"].to_numpy(np.int64), return_inverse=True)[1].astype(np.int32)


def _different(place: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Different values at each of `size` places."""
    order = np.lexsort((of, place))
    place, of = place[order], of[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    return np.bincount(place[new], minlength=size)


def _anchors(rows: pd.DataFrame, n_buckets: int) -> pd.DataFrame:
    """Pass 1: (bucket, hashes) of a block; a count of 2 stands for more documents than one.

    With each goes in how many documents the block has it, and about how many contexts.
    """
    hashes, ids, kept = [], [], []
    for raw, ends, part in _parts(rows):
        runs = _runs(raw, ends)
        kept.append(runs["ends"].to_numpy(np.int64))
        hashes.append(_codes(runs, n_buckets))
        doc = part["id"].to_numpy(np.int64)
        ids.append(doc[np.searchsorted(ends, runs["anchor"].to_numpy(), "right")])
    code, doc, kept = np.concatenate(hashes), np.concatenate(ids), np.concatenate(kept)
    kinds, place = np.unique(code, return_inverse=True)
    counts, contexts = (_different(place, of, len(kinds)) for of in (doc, kept))
    bucket = kinds >> np.uint64(8 * SENT)
    names, starts = np.unique(bucket, return_index=True)
    stops = np.append(starts, len(bucket))[1:]
    return pd.DataFrame(
        {
            "block": np.full(len(names), rows["block"].iloc[0]),
            "bucket": names.astype(np.int64),
            "keys": [_packed(kinds[a:b]) for a, b in zip(starts, stops, strict=True)],
            **{
                name: [
                    np.minimum(n[a:b], 255).astype(np.uint8).tobytes()
                    for a, b in zip(starts, stops, strict=True)
                ]
                for name, n in (("docs", counts), ("contexts", contexts))
            },
        }
    )


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """Pass 1, bucket: which of each block's hashes occur in two documents, and how hot they are.

    1: the anchor's string has more than `HOT` contexts, 2: the longer one has.
    """
    keys = [_unpacked(k) for k in rows["keys"]]
    docs, contexts = (
        np.concatenate([np.frombuffer(d, np.uint8) for d in rows[c]]) for c in ("docs", "contexts")
    )
    kinds, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, docs, len(kinds))
    _, anchor = np.unique(kinds >> np.uint64(24), return_inverse=True)
    load = np.bincount(index, np.where(total[index] > 1, contexts, 0), len(kinds))
    hot = (np.bincount(anchor, load) > HOT)[anchor].astype(np.uint8) + (load > HOT)
    out, at = [], 0
    for block, bucket, own in zip(rows["block"], rows["bucket"], keys, strict=True):
        of = index[at : at + len(own)]
        at += len(own)
        if (seen := total[of] > 1).any():
            out.append((block, bucket, _packed(own[seen]), hot[of[seen]].astype(np.uint8).tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "keys", "hot"])


#: What a block sends to a bucket in pass 2, as packed arrays: contexts end to end, and for each
#: its size, its anchor's place, its windows, its smallest document and its number of owners; the
#: owners (row, place) that wait for an answer; and spans that are settled already.
_SENT = (
    "bucket long, block int, context binary, size binary, before binary, n binary, id binary,"
    " per binary, owners binary, spans binary"
)
_SENT_NAMES = [c.split()[0] for c in _SENT.split(",")]


def _joined(runs: pd.DataFrame) -> pd.DataFrame:
    """Runs that are not hot, those of one anchor together."""
    start, n, anchor = (runs[c].to_numpy(np.int64).copy() for c in ("start", "n", "anchor"))
    cold = runs["hot"].to_numpy() == 0
    second = np.zeros(len(runs), bool)
    second[1:] = (anchor[1:] == anchor[:-1]) & (start[1:] == start[:-1] + n[:-1]) & cold[1:] & cold[:-1]
    n[:-1] += np.where(second[1:], n[1:], 0)
    return runs.assign(n=n)[~second]


def _contexts(rows: pd.DataFrame, answered: pd.DataFrame, n_buckets: int) -> Iterator[pd.DataFrame]:
    """Pass 2, block: the contexts of answered anchors, equal ones once."""
    wanted = [
        (np.uint64(b) << np.uint64(8 * SENT)) | _unpacked(k)
        for b, k in zip(answered["bucket"], answered["keys"], strict=True)
    ]
    hot = [np.frombuffer(h, np.uint8) for h in answered["hot"]]
    if not wanted:
        return
    wanted, hot = np.concatenate(wanted), np.concatenate(hot)
    order = np.argsort(wanted)
    wanted, hot = wanted[order], hot[order]
    rows = rows.assign(rank=_row_ranks(rows))
    best: dict[tuple[bytes, int], list] = {}
    settled: list[tuple[int, int, int]] = []
    for raw, ends, part in _parts(rows):
        runs = _runs(raw, ends)
        key = _codes(runs, n_buckets)
        place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        runs = runs.assign(hot=hot[place])[wanted[place] == key]
        runs = _joined(runs)
        whole = raw.tobytes()
        text = np.searchsorted(ends, runs["anchor"].to_numpy(), "right")
        starts = np.concatenate([[0], ends[:-1]])[text]
        ids, row_keys = part["id"].to_numpy(np.int64)[text], part["rank"].to_numpy(np.int32)[text]
        for s, n, a, first, doc, row, is_hot in zip(
            runs["start"].tolist(), runs["n"].tolist(), runs["anchor"].tolist(), starts.tolist(),
            ids.tolist(), row_keys.tolist(), runs["hot"].tolist(), strict=True,
        ):
            pieces = ((s + i, 1) for i in range(n)) if is_hot > 1 else ((s, n),)
            for at, count in pieces:
                kind = (whole[at : at + count + WINDOW - 1], a - at)
                held = best.get(kind)
                if held is None:
                    best[kind] = [doc, count, is_hot, [(row, at - first)]]
                elif doc < held[0]:
                    settled += [(r, p, p + count + WINDOW - 1) for r, p in held[3]]
                    held[0], held[3] = doc, [(row, at - first)]
                elif doc == held[0]:
                    held[3].append((row, at - first))
                else:
                    settled.append((row, at - first, at - first + count + WINDOW - 1))
    block = int(rows["block"].iloc[0])
    dealt: dict[int, list[tuple]] = {}
    for (context, before), (doc, count, is_hot, owners) in best.items():
        if is_hot > 1:
            owner = context
        elif is_hot:
            early = before >= HALF
            owner = context[before - HALF * early : before + KEY + AHEAD * (not early)]
        else:
            owner = context[before : before + KEY]
        bucket = int.from_bytes(hashlib.blake2b(owner, digest_size=6).digest(), "little") % n_buckets
        dealt.setdefault(bucket, []).append((context, before, count, doc, owners))
    out = []
    for bucket, sent in dealt.items():
        texts, before, counts, ids, owners = zip(*sent, strict=True)
        small = [np.array(x, np.uint16).tobytes() for x in (list(map(len, texts)), before, counts)]
        per = np.fromiter(map(len, owners), np.int32, len(owners)).tobytes()
        waiting = np.array([o for own in owners for o in own], np.int32).tobytes()
        packed = (b"".join(texts), *small, np.array(ids, np.int64).tobytes(), per, waiting)
        out.append((bucket, block, *packed, None))
    if settled:
        done = np.array(settled, np.int32).tobytes()
        out.append((block % n_buckets, block, *[None] * 7, done))
    yield pd.DataFrame(out, columns=_SENT_NAMES)


def intervals(common: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """Common-prefix intervals of a suffix array: (left, right, length, length of the parent).

    `common[i]` is the common prefix of suffixes i - 1 and i.  Children come before parents, and
    the whole array is the last interval.
    """
    out, stack = [], [(0, 0)]
    for i in range(1, size):
        left = i - 1
        while stack and stack[-1][1] > common[i]:
            left, length = stack.pop()
            parent = max(common[i], stack[-1][1] if stack else 0)
            out.append((left, i, length, parent))
        if not stack or stack[-1][1] < common[i]:
            stack.append((left, common[i]))
    while stack:
        left, length = stack.pop()
        out.append((left, size, length, stack[-1][1] if stack else -1))
    return out


def _ranks(strings: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width byte rows, and common prefixes of neighbours in that order."""
    words = np.zeros((len(strings), -(-width // 8) * 8), np.uint8)
    words[:, :width] = strings
    columns = words.view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    near = strings[order]
    differs = near[1:] != near[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, np.concatenate([[0], common])


def smallest_of_windows(
    contexts: list[bytes], before: np.ndarray, counts: np.ndarray, ids: np.ndarray
) -> np.ndarray:
    """Contexts x places: the smallest id among all occurrences of each window, NO_ID elsewhere.

    Place j is the window that starts j bytes before the context's anchor.
    """
    n, reach = len(contexts), WINDOW - KEY
    size = np.fromiter(map(len, contexts), np.int64, n)
    # Both sides of the anchor in fixed width; what lies outside the context is filled with
    # zeros and never used, as only the context's own windows are looked at.
    flat = np.frombuffer(b"".join(contexts) + bytes(WINDOW), np.uint8)
    start = np.cumsum(size) - size + before
    right_of = start[:, None] + np.arange(WINDOW)
    ahead = size - before
    right = np.where(np.arange(WINDOW) < ahead[:, None], flat[np.minimum(right_of, len(flat) - 1)], 0)
    left_of = start[:, None] - 1 - np.arange(reach)
    left = np.where(np.arange(reach) < before[:, None], flat[np.maximum(left_of, 0)], 0)
    order, common = _ranks(right.astype(np.uint8), WINDOW)
    left_order, left_common = _ranks(left.astype(np.uint8), reach)
    tree = np.array(intervals(common.tolist(), n), np.int64).reshape(-1, 4)
    # Windows of context i start from before[i] down to before[i] - counts[i] + 1.
    most, least = before, before - counts + 1
    out = np.full((n, reach + 1), NO_ID)
    left_class = np.empty(n, np.int64)
    for j in range(reach + 1):
        depth = WINDOW - j
        reached = tree[(tree[:, 2] >= depth) & (tree[:, 3] < depth)]
        group = np.arange(n) + n  # suffixes in no interval stand alone
        wide = reached[:, 1] - reached[:, 0]
        inside = np.arange(wide.sum()) + np.repeat(reached[:, 0] - (np.cumsum(wide) - wide), wide)
        group[inside] = np.repeat(reached[:, 0], wide)
        of = np.empty(n, np.int64)
        of[order] = group
        left_class[left_order] = np.cumsum(np.concatenate([[0], left_common[1:] < j]))
        own = np.flatnonzero((least <= j) & (j <= most))
        if not len(own):
            continue
        kind, side, doc = of[own], left_class[own], ids[own]
        by = np.argsort(kind * (n + 1) + side, kind="stable")
        kind, side, doc = kind[by], side[by], doc[by]
        first = np.ones(len(by), bool)
        first[1:] = kind[1:] != kind[:-1]
        bounds = np.flatnonzero(first)
        diverse = np.maximum.reduceat(side, bounds) != np.minimum.reduceat(side, bounds)
        # Intervals with one left extension are one group; the others are split by it.
        split = np.repeat(diverse, np.diff(np.append(bounds, len(by))))
        first[1:] |= split[1:] & (side[1:] != side[:-1])
        bounds = np.flatnonzero(first)
        smallest = np.minimum.reduceat(doc, bounds)
        out[own[by], j] = np.repeat(smallest, np.diff(np.append(bounds, len(by))))
    return out


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Pass 2, bucket: spans (row, start, end) of repeated windows, one row for each block."""
    spans: dict[int, list[np.ndarray]] = {}
    passed = rows["spans"].notna()
    for block, done in zip(rows["block"][passed], rows["spans"][passed], strict=True):
        spans.setdefault(block, []).append(np.frombuffer(done, np.int32).reshape(-1, 3))
    asked = rows[~passed]
    if len(asked):

        def flat(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(asked[name]), kind).astype(np.int64)

        size, before, counts = (flat(name, np.uint16) for name in ("size", "before", "n"))
        ids, per = flat("id", np.int64), flat("per", np.int32)
        held = np.fromiter(map(len, asked["per"]), np.int64, len(asked)) // 4
        block_of = np.repeat(asked["block"].to_numpy(np.int64), held)
        whole, ends = b"".join(asked["context"]), np.cumsum(size).tolist()
        contexts = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        least = smallest_of_windows(contexts, before, counts, ids)
        context, start, end = _stretches(least < ids[:, None], before)
        owners = np.frombuffer(b"".join(asked["owners"]), np.int32).reshape(-1, 2)
        first = np.cumsum(per) - per
        n = per[context]
        at = np.arange(n.sum()) + np.repeat(first[context] - (np.cumsum(n) - n), n)
        row, place = owners[at].T
        found = np.stack([row, place + np.repeat(start, n), place + np.repeat(end, n)], axis=1)
        by = np.repeat(block_of[context], n)
        order = np.argsort(by, kind="stable")
        names, edges = np.unique(by[order], return_index=True)
        for block, a, b in zip(names.tolist(), edges, np.append(edges, len(by))[1:], strict=True):
            part = found[order[a:b]]
            spans.setdefault(block, []).append(part)
    out = [(b, np.concatenate(parts).astype(np.int32).tobytes()) for b, parts in spans.items()]
    return pd.DataFrame(out, columns=["block", "spans"])


def _stretches(cut: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and last byte (from its start) of every run of cut windows.

    Window j starts before - j bytes into the context.
    """
    edge = np.zeros((len(cut), 1), bool)
    low = np.nonzero(cut & ~np.hstack([edge, cut[:, :-1]]))
    high = np.nonzero(cut & ~np.hstack([cut[:, 1:], edge]))
    return low[0], before[low[0]] - high[1], before[low[0]] - low[1] + WINDOW


def _cut(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Pass 3: united spans and what they leave of every row of a block."""
    parts = [np.frombuffer(s, np.int32).reshape(-1, 3) for s in found["spans"]]
    spans = np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    out = []
    for row, text in zip(_row_ranks(rows), rows["text"], strict=True):
        a, b = np.searchsorted(spans[:, 0], row, "left"), np.searchsorted(spans[:, 0], row, "right")
        raw, united = (text or "").encode(), []
        for start, end in spans[a:b, 1:].tolist():
            if united and start <= united[-1][1]:
                united[-1][1] = max(united[-1][1], end)
            else:
                united.append([start, end])
        kept, at = [], 0
        for start, end in united:
            kept.append(raw[at:start])
            at = end
        kept.append(raw[at:])
        out.append((len(raw), united, b"".join(kept)))
    made = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
    made.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy())
    made.insert(1, "row_key", rows["row_key"].to_numpy())
    return made


def _spans(docs: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Blocked rows, and (block, spans) of their repeated windows.

    `extra` columns ride with the rows, which are dealt to their blocks once for all passes.
    """
    n_bytes = corpus.text_bytes(docs)
    n_buckets = corpus.blocks_for(n_bytes, BUCKET_BYTES)
    rows = corpus.blocked(docs, corpus.blocks_for(n_bytes, BLOCK_BYTES), extra).select(
        "block", "row_key", "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", *extra
    )
    sent = rows.groupBy("block").applyInPandas(
        lambda r: _anchors(r, n_buckets), "block int, bucket long, keys binary, docs binary, contexts binary"
    )
    answered = sent.groupBy("bucket").applyInPandas(
        _repeated, "block int, bucket long, keys binary, hot binary"
    )

    def contexts(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=_SENT_NAMES)
        return next(_contexts(r, a, n_buckets), none) if len(r) else none

    asked = (
        rows.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(contexts, _SENT)
    )
    return rows, asked.groupBy("bucket").applyInPandas(_settle, "block int, spans binary")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeats cut out of text, and n_chars brought up to date if there is one.

    A character that a cut divides goes with it.  Every row stays, even if nothing is left.  The
    other columns travel with the text under names of their own, so none can clash, and leave
    the last pass as the Arrow columns they came in.
    """
    names = docs.columns
    places = [f"_column{i}" for i in range(len(names))]
    at = dict(zip(names, places, strict=True))
    extra = tuple(at[n] for n in names if n not in ("doc_id", "text"))
    back = {at["doc_id"]: "doc_id", at["text"]: "text"}
    rows, spans = _spans(docs.toDF(*places).withColumnsRenamed(back), extra)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        needed = left.select(["doc_id", "row_key", "text"]).to_pandas(types_mapper=_nullable)
        made = _cut(needed, right.to_pandas())
        texts = [
            whole if not gone else kept.decode("utf-8", "ignore")
            for whole, gone, kept in zip(needed["text"], made["spans"], made["kept"], strict=True)
        ]
        texts = [t if isinstance(t, str) else None for t in texts]
        field = left.schema.field("text")
        out = left.set_column(left.schema.names.index("text"), field, pa.array(texts, field.type))
        return out.select(["doc_id", "text", *extra])

    order = ["doc_id", "text", *extra]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in order])
    changed = rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, schema)
    texts = changed.select(*[F.col(back.get(c, c)).alias(c) for c in places]).toDF(*names)
    if "n_chars" in names:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        same = F.col("text").isNull()
        texts = texts.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(length))
    return texts


def _nullable(kind: pa.DataType):
    """Whole numbers with nulls stay whole numbers."""
    return pd.Int64Dtype() if pa.types.is_integer(kind) else None


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    rows, spans = _spans(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        cut = _cut(r, s)
        return pd.DataFrame(
            {
                "doc_id": cut["doc_id"],
                "n_bytes": cut["n_bytes"],
                "n_removed": cut["n_bytes"] - cut["kept"].map(len),
                "n_spans": cut["spans"].map(len),
                "kept_sha256": cut["kept"].map(lambda k: hashlib.sha256(k).hexdigest()),
            }
        )

    return (
        rows.groupBy("block")
        .cogroup(spans.groupBy("block"))
        .applyInPandas(
            digest,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        )
    )
