"""Packing of tokenised documents into sequences by cutting-stock column generation.

Documents longer than a sequence are cut at multiples of its length; what remains is one piece
each.  Piece lengths are rounded up to a grid and counted.  The linear program over patterns
(how many pieces of each length fill one sequence) starts from first-fit patterns; a knapsack
over the dual prices finds the pattern that helps most until the gap is small.  Patterns are used as
often as the program says, rounded down; first-fit decreasing packs the counts left over.
Pieces are then ranked within their length and the ranks dealt to the patterns' places.

The histogram and the patterns are bounded by the grid, not by the corpus; everything per piece
stays in tables.  Ranks are made per (length, salt) and offset by the counts before, so one
length may hold most of the pieces.

Defined results: a null or empty text is its end token alone; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellkin.llm import corpus
from wellkin.plans.stored import store

#: Tokens of a sequence, end token, tokens per unit of the length grid.
LENGTH, END, GRID = 2_048, 1, 4
#: Stop when the bound shows this relative gap, or after so many columns.
GAP, COLUMNS = 1e-3, 600
#: Pieces ranked together.
RANK_ROWS = 10_000
#: Words whose ids a worker remembers.
REMEMBERED = 400_000

#: Any white space that isn't a single blank or line end between other characters.
_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")


class _Words(dict):
    """Ids, as little-endian bytes, of a word; forgets all when full."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.prefix + word), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids


@functools.lru_cache(maxsize=1)
def encoder(tokenizer: str, ranks: str):
    """text -> ids as bytes, the same ids as the tokenizer file gives.

    Byte-pair merges never cross the pattern's pieces, and a single blank or line end between
    two other characters always starts one, so words are encoded alone and remembered.  The
    rank file holds the same vocabulary; texts with the special token's string, which is one
    id, go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
    ).encode_ordinary
    full = Tokenizer.from_file(tokenizer)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    first, later = _Words(plain, ""), _Words(plain, " ")
    line_end = first["\n"]

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _IRREGULAR.search(text):
            return np.array(plain(text), "<u4").tobytes()
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(first[head] + b"".join(map(later.__getitem__, rest)))
        return line_end.join(out)

    return encode


def pieces(docs: DataFrame, tokenizer: str, ranks: str) -> DataFrame:
    """row_key, doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, doc, text in zip(
                batch["row_key"], batch["doc_id"], batch["text"], strict=True
            ):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, LENGTH):
                    part = ids[4 * start : 4 * (start + LENGTH)]
                    rows.append((key, doc, start, len(part) // 4, zlib.crc32(part), n))
            names = ["row_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    return keyed.mapInPandas(
        cut, "row_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def knapsack(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest price that fits, by dynamic programming over the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fits:
            value = best[room - sizes[:fits]] + price[:fits]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], taken[room] = value[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), counts


def _start(
    sizes: np.ndarray, demand: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis and its inverse: first-fit patterns, each used until a size is used up.

    No later pattern holds the size that a pattern uses up, so with sizes in that order the
    basis is lower triangular and is inverted row by row.
    """
    left, open_, columns, order = demand.astype(float), np.ones(len(sizes), bool), [], []
    while open_.any():
        room, column = capacity, np.zeros(len(sizes))
        for k in np.flatnonzero(open_)[::-1]:
            if not room:
                break
            column[k] = min(room // sizes[k], max(1, int(left[k])))
            room -= int(column[k] * sizes[k])
        uses = np.where(column > 0, left / np.maximum(column, 1), np.inf)
        out = int(uses.argmin())
        left = np.maximum(left - uses[out] * column, 0)
        open_[out] = False
        columns.append(column)
        order.append(out)
    basis = np.array(columns).T
    lower, m = basis[order], len(sizes)
    inverse = np.zeros((m, m))
    for i in range(m):
        inverse[i] = -(lower[i, :i, None] * inverse[:i]).sum(axis=0)
        inverse[i, order[i]] += 1.0
        inverse[i] /= lower[i, i]
    return basis, inverse


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(uses, pieces by size) of patterns that hold exactly the demand."""
    if not len(sizes):
        return []
    basis, inverse = _start(sizes, demand, capacity)
    for _ in range(COLUMNS):
        uses, price = (inverse * demand).sum(axis=1), inverse.sum(axis=0)
        value, column = knapsack(np.maximum(price, 0), sizes, capacity)
        bound = (price * demand).sum() / max(value, 1.0)
        if value <= 1 + 1e-9 or uses.sum() - bound <= GAP * uses.sum():
            break
        move = (inverse * column).sum(axis=1)
        ratio = np.where(move > 1e-9, np.maximum(uses, 0) / np.maximum(move, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    uses = np.floor(np.maximum((inverse * demand).sum(axis=1), 0) + 1e-7).astype(np.int64)
    columns = np.rint(basis).astype(np.int64)
    while (over := np.flatnonzero(columns @ uses > demand)).size:
        uses[np.flatnonzero((columns[over[0]] > 0) & (uses > 0))[0]] -= 1
    plans = [(int(n), columns[:, k]) for k, n in enumerate(uses) if n]
    return plans + _first_fit(sizes, demand - columns @ uses, capacity)


def _first_fit(
    sizes: np.ndarray, left: np.ndarray, capacity: int
) -> list[tuple[int, np.ndarray]]:
    """Greedy patterns, largest pieces first, each used as often as the counts allow."""
    left, plans = left.copy(), []
    while left.any():
        room, column = capacity, np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            column[k] = min(left[k], room // sizes[k])
            room -= column[k] * sizes[k]
        used = column > 0
        n = int((left[used] // column[used]).min())
        left -= n * column
        plans.append((n, column))
    return plans


class Places:
    """Which sequence the r-th piece of a size goes to."""

    def __init__(self, sizes: np.ndarray, plans: list[tuple[int, np.ndarray]]):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        uses = np.array([n for n, _ in plans], np.int64)
        first = np.cumsum(uses) - uses
        table = np.array([column for _, column in plans]).reshape(len(plans), len(sizes))
        for k, size in enumerate(sizes):
            at = np.flatnonzero(table[:, k])
            per, total = table[at, k], uses[at] * table[at, k]
            self.by_size[int(size)] = (np.cumsum(total) - total, per, first[at])

    def sequence(self, size: int, rank: np.ndarray) -> np.ndarray:
        start, per, first = self.by_size[size]
        k = np.searchsorted(start, rank, "right") - 1
        return first[k] + (rank - start[k]) // per[k]


def _ranked(cut: DataFrame, n_pieces: int) -> DataFrame:
    """`cut` with rank: 0, 1, ... within each size, without a whole size in one task."""
    salts = max(1, -(-n_pieces // RANK_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row_key", "start"), F.lit(salts)))
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "row_key", "start")
    numbered = salted.withColumn("r", F.row_number().over(within))
    return numbered.join(offsets, ["size", "salt"]).select(
        *cut.columns, (F.col("o") + F.col("r") - 1).alias("rank")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    size = F.ceil(F.col("length") / GRID).cast("int").alias("size")
    cut = store(pieces(docs, tokenizer, ranks).select("*", size), "pieces")
    histogram = cut.groupBy("size").count().toPandas().sort_values("size")
    sizes, demand = histogram["size"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    places = Places(sizes, solve(sizes, demand, LENGTH // GRID))
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("long")
    def sequence(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        sizes, ranks = size.to_numpy(), rank.to_numpy()
        for one in np.unique(sizes):
            at = sizes == one
            out[at] = shared.value.sequence(int(one), ranks[at])
        return pd.Series(out)

    dealt = _ranked(cut, int(demand.sum())).withColumn("sequence_id", sequence("size", "rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "row_key", "start")
    upto = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return dealt.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        (upto - F.col("length")).alias("offset"),
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))
