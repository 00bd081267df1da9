"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ten consecutive words of a benchmark item (a shorter item is one
window).  For each window length a shift table over word pairs says how far the search may
skip, a hash of the last pair selects the test strings that end there, and a direct comparison
confirms an occurrence.  Benchmark text travels to the tasks in blocks of bounded size, and
every block is held against all documents, so neither table has to be small.

Defined results: a null or empty text has no words and is never hit; items without words have
no windows; equal windows of several items count for each of them; repeated rows get equal
results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus
from wellkin.plans.stored import store

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4_000_000
#: Words of one piece of an item; pieces overlap so that no window is cut.
PIECE_WORDS = 4_096

_KEEP = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 32
    for b in range(256)
)

_FOUND = "row_key long, doc_id long, n_words long, spans array<array<int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class WuManber:
    """Test strings of one length, as word tuples with the items that hold them."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ending: dict[tuple, dict[tuple, set[str]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                part = pattern[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.skip), length - end)
            self.ending.setdefault(pattern[-self.block :], {})[pattern] = items

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of every occurrence."""
        shift, block, skip, length = self.shift, self.block, self.skip, self.length
        end, n = length, len(text)
        while end <= n:
            part = tuple(text[end - block : end])
            step = shift.get(part, skip)
            if step:
                end += step
                continue
            window = tuple(text[end - length : end])
            if items := self.ending[part].get(window):
                yield end - length, items
            end += 1


def windows(pieces: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """Search tables by window length, of (item, space-joined words) rows."""
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item, piece in pieces:
        w = piece.split()
        length = min(window, len(w))
        into = by_length.setdefault(length, {})
        for i in range(len(w) - length + 1):
            into.setdefault(tuple(w[i : i + length]), set()).add(item)
    return [WuManber(length, patterns) for length, patterns in sorted(by_length.items())]


def joined(spans: list) -> list[list[int]]:
    """Spans united where they overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    step = PIECE_WORDS - window + 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                w = words(text)
                for i in range(0, max(1, len(w) - window + 1), step) if w else ():
                    rows.append((item, b" ".join(w[i : i + PIECE_WORDS])))
            yield pd.DataFrame(rows, columns=["item", "piece"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInPandas(
        cut, "item string, piece binary"
    )


def _scan(docs: DataFrame, pieces: DataFrame, window: int, hit_only: bool) -> DataFrame:
    """Occurrences of one block of the benchmark in every document."""
    block = [(r["item"] or "", bytes(r["piece"])) for r in pieces.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = windows(shared.value, window)
        for batch in batches:
            rows = []
            for key, doc, text in zip(
                batch["row_key"], batch["doc_id"], batch["text"], strict=True
            ):
                w = words(text)
                spans, items = [], set()
                for table in tables:
                    for start, found in table.search(w):
                        spans.append((start, start + table.length))
                        items |= found
                if spans or not hit_only:
                    rows.append((key, doc, len(w), joined(spans), sorted(items)))
            out = pd.DataFrame(rows, columns=["row_key", "doc_id", "n_words", "spans", "items"])
            yield out.astype({"doc_id": "Int64"})

    return docs.mapInPandas(scan, _FOUND)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, spans (word ranges in any occurrence), items."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    pieces = _pieces(benchmark, window)
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    if n == 1:
        return _scan(keyed, pieces, window, False).drop("row_key")
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(n)))
    found = None
    for b in range(n):
        part = _scan(keyed, dealt.filter(F.col("block") == b), window, True)
        found = part if found is None else found.unionByName(part)
    nothing = dealt.filter(F.lit(False))
    merged = found.groupBy("row_key").agg(
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    every = _scan(keyed, nothing, window, False).drop("spans", "items")
    joined_up = every.join(merged, "row_key", "left")
    empty = F.array().cast("array<string>")
    return joined_up.select(
        "doc_id",
        "n_words",
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
        F.coalesce("items", empty).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""

    @F.pandas_udf("long")
    def covered(spans: pd.Series) -> pd.Series:
        return spans.map(lambda s: sum(b - a for a, b in joined(s)))

    found = occurrences(docs, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        covered("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any occurrence, all columns."""
    dealt = _pieces(benchmark, window)
    total = dealt.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(n)))
    if n > 1:
        dealt = store(dealt, "pieces")
    # Each block of the benchmark is a filter over the rows that the blocks before it left.
    for b in range(n):
        rows = dealt.filter(F.col("block") == b).select("item", "piece").collect()
        docs = docs.filter(_without([(r["item"] or "", bytes(r["piece"])) for r in rows], docs, window))
    return docs


def _without(block: list[tuple[str, bytes]], docs: DataFrame, window: int) -> Column:
    """Whether a text has no occurrence of a block's windows."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = windows(shared.value, window)
        for batch in batches:
            yield batch.map(
                lambda t: not any(True for table in tables for _ in table.search(words(t)))
            ).astype(bool)

    return clean("text")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(corpus.table(spark, sf_dir, "documents"), corpus.table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _oracle(window: int = WINDOW) -> str:
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {split} AS w FROM benchmark),
test AS (SELECT DISTINCT item, least(len(w), {window}) AS size,
    unnest([array_to_string(w[i : i + least(len(w), {window}) - 1], ' ')
      FOR i IN range(1, len(w) - least(len(w), {window}) + 2)]) AS words
  FROM item WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM test),
doc AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
place AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM doc, sizes
  WHERE len(w) >= size),
occurrence AS (SELECT r, place.size, i, item
  FROM place JOIN test ON place.size = test.size
    AND array_to_string(w[i : i + place.size - 1], ' ') = test.words),
hit AS (SELECT r, count(DISTINCT p) AS n FROM
  (SELECT r, unnest(range(i, i + size)) AS p FROM occurrence) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, item FROM occurrence) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


ORACLE = {"op10_decontaminate": _oracle()}
