"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is the bitwise majority of the hashes of a document's word shingles.
Two fingerprints that differ in at most `distance` bits differ in at most a third of that in
one of three blocks of bits, so each block gets its own covering code: a perfect Hamming code
over the first 15 bits of the block and every value of the rest.  Its covering radius is 1, so
each fingerprint has a home anchor at distance 1 or less, and a partner within `t` bits of the
block lies within 1 + t of that anchor.  Fingerprints are therefore copied to every anchor
within covering radius plus threshold, and at each anchor the ones at home are compared with
all that are there.

Equal fingerprints are one row before anything is copied.  An anchor with more rows than a
cell should hold is cut into a grid of cells, so that no task gets a whole hot anchor and no
pair is lost.  A cell returns a spanning set of its links, not all pairs, which leaves the
components as they are.

Defined results: a null or empty text has no shingles and the fingerprint zero, which links
like any other; a text shorter than a shingle is one shingle; rows with equal ids keep one row
each; null ids get a component from their fingerprint's other members, null if there is none.
Where one row of a component is kept, components are told apart by their smallest fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellkin.llm import components, corpus
from wellkin.plans.stored import store

#: Words of a shingle and the most bits in which linked fingerprints differ.
SHINGLE, DISTANCE, SEED = 4, 4, 42
#: First bit and width of the three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: Rows of an anchor that are compared in one cell.
CELL_ROWS = 4_096
#: Rows of all cells that one task group compares, and pairs held in memory at once.
BUCKET_ROWS, PAIRS_AT_ONCE = 200_000, 2_000_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit majority of the shingles' XXH64; zero without shingles."""
    w = words(text)
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(w[i : i + shingle]), SEED) for i in range(n)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for i in range(0, n, 65_536):
        part = values[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of `docs` and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        values = [fingerprint(t, shingle) for t in text]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return docs.withColumn("fp", of("text"))


def _syndrome_table() -> np.ndarray:
    """For each value of the code's bits: the xor of the (1-based) places of its ones."""
    values = np.arange(1 << CODE_BITS)
    out = np.zeros(1 << CODE_BITS, np.int64)
    for bit in range(CODE_BITS):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


_SYNDROME = _syndrome_table()


def code_steps(reach: int) -> list[np.ndarray]:
    """By syndrome: the masks of at most `reach` bits that lead from a value to a codeword."""
    masks = np.array([m for m in range(1 << CODE_BITS) if m.bit_count() <= reach])
    return [masks[_SYNDROME[masks] == s] for s in range(1 << 4)]


def home(block: np.ndarray) -> np.ndarray:
    """The anchor within covering radius: the code's bits corrected, the others as they are."""
    place = _SYNDROME[block & ((1 << CODE_BITS) - 1)]
    return block ^ np.where(place > 0, 1 << np.maximum(place - 1, 0), 0)


def anchors(block: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and anchor of every anchor within `reach` bits of each block value."""
    free = width - CODE_BITS
    steps = {r: code_steps(r) for r in range(reach + 1)}
    syndrome = _SYNDROME[block & ((1 << CODE_BITS) - 1)]
    rows, found = [], []
    for far in range(1 << free):
        if (spent := far.bit_count()) > reach:
            continue
        for s in range(1 << 4):
            at = np.flatnonzero(syndrome == s)
            masks = steps[reach - spent][s]
            if len(at) and len(masks):
                rows.append(np.repeat(at, len(masks)))
                found.append((block[at, None] ^ masks[None, :] ^ (far << CODE_BITS)).ravel())
    return np.concatenate(rows), np.concatenate(found)


def _copies(fps: DataFrame, distance: int) -> DataFrame:
    """(anchor, fp, at_home): every fingerprint at every anchor it must meet others at."""
    reach = 1 + distance // len(BLOCKS)

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for k, (first, width) in enumerate(BLOCKS):
                block = (values.view(np.uint64) >> np.uint64(first)).astype(np.int64) & (
                    (1 << width) - 1
                )
                at_home = home(block)
                rows, found = anchors(block, width, reach)
                yield pd.DataFrame(
                    {
                        "anchor": found + (k << 32),
                        "fp": values[rows],
                        "at_home": at_home[rows] == found,
                    }
                )

    return fps.mapInPandas(copy, "anchor long, fp long, at_home boolean")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the nodes that the links a-b join one label, the smallest, in place."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(batch: pd.DataFrame, distance: int) -> pd.DataFrame:
    """A link from each fingerprint to the smallest that it reaches within these cells."""
    cell = pd.factorize(pd.MultiIndex.from_frame(batch[["anchor", "i", "j"]]))[0]
    own = batch["at_home"].to_numpy(bool)
    fps, node = np.unique(batch["fp"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(cell[~own], kind="stable")
    there, members = cell[~own][order], node[~own][order]
    homes, at = node[own], cell[own]
    low, high = np.searchsorted(there, at, "left"), np.searchsorted(there, at, "right")
    label, met = np.arange(len(fps)), np.cumsum(high - low)
    start = 0
    while start < len(homes):
        base = met[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(met, base + PAIRS_AT_ONCE)))
        n = (high - low)[start:end]
        first = np.repeat(low[start:end] - (np.cumsum(n) - n), n)
        b = members[np.arange(n.sum()) + first]
        a = np.repeat(homes[start:end], n)
        near = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= distance
        _merge(label, a[near], b[near])
        start = end
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[moved], "b": fps[label[moved]]})


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints that give the components of all links."""
    if distance // len(BLOCKS) > 3:
        raise ValueError("three blocks serve distances up to 11")
    copies = store(_copies(fps, distance), "anchors")
    sizes = copies.groupBy("anchor").agg(F.count("*").alias("rows"))
    large = sizes.filter(F.col("rows") > CELL_ROWS).select(
        "anchor", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("cut")
    )
    # At most (all rows / CELL_ROWS) anchors are large; the join is left to measured sizes.
    dealt = copies.join(large, "anchor", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    every = F.sequence(F.lit(0), F.col("cut") - 1)
    as_home = dealt.filter("at_home").select(
        "anchor", "fp", F.lit(True).alias("at_home"), own.alias("i"), F.explode(every).alias("j")
    )
    as_member = dealt.select(
        "anchor", "fp", F.lit(False).alias("at_home"), own.alias("j"), F.explode(every).alias("i")
    ).select("anchor", "fp", "at_home", "i", "j")
    cells = as_home.unionByName(as_member)

    total = sizes.agg(F.sum("rows")).first()[0] or 0
    tasks = corpus.blocks_for(total, BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("anchor", "i", "j"), F.lit(tasks)).cast("int")
    return (
        cells.groupBy(bucket.alias("bucket"))
        .applyInPandas(lambda rows: _compare(rows, distance), "a long, b long")
        .distinct()
    )


def _grouped(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """`docs` without text and with fp; (fp, least, group): the component by its smallest fingerprint."""
    marked = store(fingerprints(docs, shingle).drop("text"), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components.smallest_reachable(links(least.select("fp"), distance))
    grouped = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("group")
    )
    return marked, grouped


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """`docs` without text, with fp and component_id: the smallest doc_id reachable by links.

    component_id does not name a component: it is null where all ids are, and two components
    that share their smallest id have the same one.
    """
    marked, grouped = _grouped(docs, shingle, distance)
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(smallest, "group").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns, so that only rows alike in all of them share it."""
    maps = {name for name, kind in docs.dtypes if kind.startswith("map")}
    return F.xxhash64(*[F.map_entries(c) if c in maps else F.col(f"`{c}`") for c in docs.columns])


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: smallest id, then smallest hash of the whole row; all columns of
    `docs`.  Of rows alike in all columns one stays."""
    key = docs.select(F.col("doc_id"), F.col("text"), _row_key(docs).alias("row_key"))
    marked, grouped = _grouped(key, shingle, distance)
    # A fingerprint's first row is all that can be first in its component.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    by_fp = marked.groupBy("fp").agg(F.min(order).alias("first"))
    first = by_fp.join(grouped, "fp").groupBy("group").agg(F.min("first").alias("first"))
    keep = first.select(F.col("first.row_key").alias("row_key"))
    name = "_simhash_row"
    kept = docs.withColumn(name, _row_key(docs)).join(
        keep.withColumnRenamed("row_key", name), name, "left_semi"
    )
    return kept.dropDuplicates([name]).drop(name)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
