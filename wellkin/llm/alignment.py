"""Alignment of the tokens that two tokenizers give the same text, byte by byte.

The byte offsets at which a token of both sequences ends cut them into groups; the last tokens
of a group end together and are a link.  A text is cut into byte ranges, each tokenised by
itself, and what a range knows about its groups is a *fragment*: an open prefix (tokens up to
its first common end), the closed groups after it, an open suffix (tokens after its last common
end).  A range without a common end is open as a whole.  Fragments compose associatively: the
left one's suffix and the right one's prefix together hold every token between their closed
groups, so the common ends among them are found there.  The fragments of a very long document
are made in different tasks and composed by a tree of bounded fan-in.

Each sequence is cut where its own tokenizer never joins what stands on both sides: the first
white space (blank or line end for the byte-level one, a lone blank for the other, none of
whose pieces has its blank mark after another character) after a character that isn't one.  The two sequences' cuts
therefore differ, and groups are open across them.  A text without such places is one range.

A short text whose white space is single blanks and line ends needs no ranges: both sequences end
a token at every word's end, so a word's fragment has closed groups only.  A worker aligns the
words that are new to it together, and a text's groups are its words', one after the other.

Counts of linked id pairs cover the whole corpus: blocks of documents count their pairs, the
counts are summed by pair, the highest of each B id is found, and the sums travel back to the
blocks that asked.  No table of pairs is gathered or broadcast.

Defined results: a null or empty text, or one that either tokenizer does not give back byte by
byte, has no tokens: counts are zero and the digest is empty; repeated rows each count; null ids
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus
from wellkin.plans.stored import store

#: Characters of a range, fragments composed at once, bytes of text of a block.
RANGE, FAN, BLOCK_BYTES = 1 << 16, 16, 8_000_000
#: Characters of short texts aligned at once, texts returned at once, words that a worker remembers.
AT_ONCE, RETURNED, REMEMBERED = 1 << 19, 500, 80_000

_CUT_A = re.compile(r"(?<=\S)(?=[ \n])")
#: The second tokenizer takes U+2581 for a blank, so a blank beside it does not stand alone.
_CUT_B = re.compile(r"(?<=[^\s\u2581])(?= [^\s\u2581])")
#: Any white space that isn't a single blank or line end between other characters.
_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")


@dataclass
class Open:
    """Tokens of both sequences whose groups aren't known yet; ends are byte offsets in the text."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def then(self, other: Open) -> Open:
        return Open(
            np.concatenate([self.a, other.a]),
            np.concatenate([self.a_ends, other.a_ends]),
            np.concatenate([self.b, other.b]),
            np.concatenate([self.b_ends, other.b_ends]),
        )

    def cut(self, a: int, b: int) -> tuple[Open, Open]:
        """The first a and b tokens, and the rest."""
        return (
            Open(self.a[:a], self.a_ends[:a], self.b[:b], self.b_ends[:b]),
            Open(self.a[a:], self.a_ends[a:], self.b[b:], self.b_ends[b:]),
        )


@dataclass
class Fragment:
    """head, closed groups as text (each led by a semicolon) and links, tail; body is None if all is open."""

    head: Open
    body: bytes | None
    links: np.ndarray
    tail: Open
    n_a: int
    n_b: int
    whole: bool


_NOTHING = Open(*[np.zeros(0, np.int64)] * 4)
_NO_LINKS = np.zeros(0, np.int64)


@functools.lru_cache(maxsize=32)
def _names(n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an id within a group, at a group's start, and at the start of its B tokens; and
    which of them are set."""
    names = np.array([f"{mark}{i}".encode() for mark in ",;|" for i in range(n_ids)])
    table = names.view(np.uint8).reshape(len(names), -1)
    return table, table > 0


def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) | b


def _groups(
    part: Open, a_last: np.ndarray, b_last: np.ndarray
) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Text, links and ends in the text of closed groups, given the places of their last tokens."""
    n_ids = 1 << (int(max(part.a.max(), part.b.max())) + 1).bit_length()
    n_a, n_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    ends = np.cumsum(n_a + n_b)
    first = ends - n_a - n_b
    out = np.empty(len(part.a) + len(part.b), np.int64)
    a_first, b_first = a_last + 1 - n_a, b_last + 1 - n_b
    out[np.arange(len(part.a)) + np.repeat(first - a_first, n_a)] = part.a
    out[np.arange(len(part.b)) + np.repeat(first + n_a - b_first, n_b)] = part.b
    out[first] += n_ids
    out[first + n_a] += 2 * n_ids
    table, used = _names(n_ids)
    used = used[out]
    text = table[out][used].tobytes()
    return text, code(part.a[a_last], part.b[b_last]), np.cumsum(used.sum(axis=1))[ends - 1]


def close(tokens: Open, n_a: int = 0, n_b: int = 0, whole: bool = True) -> Fragment:
    """What `tokens` tell by themselves."""
    if not len(tokens.a) or not len(tokens.b):
        return Fragment(tokens, None, _NO_LINKS, _NOTHING, n_a, n_b, whole)
    at = np.minimum(np.searchsorted(tokens.b_ends, tokens.a_ends), len(tokens.b) - 1)
    a_last = np.flatnonzero(tokens.b_ends[at] == tokens.a_ends)
    if not len(a_last):
        return Fragment(tokens, None, _NO_LINKS, _NOTHING, n_a, n_b, whole)
    b_last = at[a_last]
    head, rest = tokens.cut(a_last[0] + 1, b_last[0] + 1)
    body, links = b"", _NO_LINKS
    if len(a_last) > 1:
        inner, rest = rest.cut(a_last[-1] - a_last[0], b_last[-1] - b_last[0])
        body, links, _ = _groups(inner, a_last[1:] - a_last[0] - 1, b_last[1:] - b_last[0] - 1)
    return Fragment(head, body, links, rest, n_a, n_b, whole)


def _first_group(head: Open) -> tuple[bytes, np.ndarray]:
    """A prefix as a closed group, once its start is known."""
    return _groups(head, np.array([len(head.a) - 1]), np.array([len(head.b) - 1]))[:2]


def compose(left: Fragment, right: Fragment) -> Fragment:
    n_a, n_b, whole = left.n_a + right.n_a, left.n_b + right.n_b, left.whole and right.whole
    if not whole:
        return Fragment(_NOTHING, None, _NO_LINKS, _NOTHING, n_a, n_b, whole)
    between = close((left.head if left.body is None else left.tail).then(right.head))
    head, body, links, tail = between.head, between.body, between.links, between.tail
    if left.body is not None:
        if body is None:
            head, body, tail = left.head, left.body, head
            links = left.links
        else:
            text, link = _first_group(head)
            head, body = left.head, left.body + text + body
            links = np.concatenate([left.links, link, links])
    if right.body is not None:
        body, tail = body + right.body, right.tail
        links = np.concatenate([links, right.links])
    return Fragment(head, body, links, tail, n_a, n_b, whole)


#: n_a, n_b, groups and links of a text without tokens.
NONE = 0, 0, b"", _NO_LINKS


def finished(fragment: Fragment) -> tuple[int, int, bytes, np.ndarray]:
    """n_a, n_b, groups and links of a whole text."""
    if not fragment.whole or fragment.body is None:
        return NONE
    text, link = _first_group(fragment.head)
    return fragment.n_a, fragment.n_b, (text + fragment.body)[1:], np.concatenate([link, fragment.links])


def _byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """ids of both tokenizers and the bytes that each id stands for.

    The byte-level vocabulary numbers its pieces in the order of their merges, so its file is
    all that a rank-based encoder of the same ids needs.
    """

    def __init__(self, byte_level: str, pieces: str):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(byte_level, encoding="utf-8") as file:
            made = json.load(file)
        special = {t["content"] for t in made["added_tokens"]}
        names = _byte_names()
        ranks = {
            bytes(map(names.__getitem__, piece)): i
            for piece, i in made["model"]["vocab"].items()
            if piece not in special
        }
        first = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

        def encode_a(text: str) -> np.ndarray:
            return first.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

        self.encode_a = encode_a
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        second = SentencePieceProcessor(model_file=pieces)
        self.encode_b = second.encode
        named = [second.id_to_piece(i) for i in range(second.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(named)
        ]
        self.by_words = not any("\n" in p or "▁" in p.lstrip("▁") for p in named)
        self.words = _Words([], [], np.zeros((0, 2), np.int64), {})
        self.a_length, self.b_length = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))

    def fragment(self, a_text: str, a_start: int, b_text: str, b_start: int) -> Fragment:
        """Of two ranges of a text that start with a blank, and the byte offsets they start at."""
        a = self.encode_a(a_text)
        b = self.encode_b(b_text[1:]) if b_text else []
        if not (self._same(a_text, a.tolist(), self.a_bytes) and self._same(b_text, b, self.b_bytes)):
            return Fragment(_NOTHING, None, _NO_LINKS, _NOTHING, len(a), len(b), False)
        b = np.array(b, np.int64)
        tokens = Open(a, a_start + np.cumsum(self.a_length[a]), b, b_start + np.cumsum(self.b_length[b]))
        return close(tokens, len(a), len(b))

    @staticmethod
    def _same(text: str, ids: Iterable[int], names: list[bytes]) -> bool:
        return b"".join(map(names.__getitem__, ids)) == text.encode()

    def regular(self, text: str) -> bool:
        return self.by_words and not _IRREGULAR.search(text)

    def _learn(self, words: list[str]) -> None:
        """Align words by themselves; a word is led by the line end before it, else by a blank."""
        known, start = self.words, len(self.words.groups)
        known.place.update(zip(words, range(start, start + len(words))))
        spelt = [w if w[0] == "\n" else " " + w for w in words]
        # Where a line end leads, the tokenizer's own blank stands before it.
        pieces = [p[w[0] == "\n" :] for w, p in zip(words, self.encode_b(words), strict=True)]
        at, given = range(len(words)), itertools.chain.from_iterable
        if not self._same("".join(spelt), given(pieces), self.b_bytes):
            at = [i for i in at if self._same(spelt[i], pieces[i], self.b_bytes)]
            spelt, pieces = [spelt[i] for i in at], [pieces[i] for i in at]
        groups, links, counts = [None] * len(words), [b""] * len(words), np.zeros((len(words), 2), np.int64)
        if spelt:
            a, b = self.encode_a("".join(spelt)), np.fromiter(given(pieces), np.int64)
            a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
            place = np.minimum(np.searchsorted(b_ends, a_ends), len(b) - 1)
            a_last = np.flatnonzero(b_ends[place] == a_ends)
            b_last = place[a_last]
            text, codes, text_ends = _groups(Open(a, a_ends, b, b_ends), a_last, b_last)
            # Both sequences end a token with every word, so the words' ends are among the groups'.
            group = np.searchsorted(a_ends[a_last], np.cumsum([len(w.encode()) for w in spelt]))
            counts[at, 0] = np.diff(a_last[group], prepend=-1)
            counts[at, 1] = np.diff(b_last[group], prepend=-1)
            raw, low, first = codes.tobytes(), 0, 0
            for i, last, high in zip(at, (8 * (group + 1)).tolist(), text_ends[group].tolist()):
                groups[i], links[i] = text[low:high], raw[first:last]
                low, first = high, last
        known.groups += groups
        known.links += links
        known.counts = np.concatenate([known.counts, counts])

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        """n_a, n_b, groups and links of each of some regular texts."""
        split = [text.replace("\n", " \n").split(" ") for text in texts]
        words = set().union(*split)
        if len(self.words.groups) > REMEMBERED:
            self.words = _Words([], [], np.zeros((0, 2), np.int64), {})
        if new := list(words - self.words.place.keys()):
            self._learn(new)
        known = self.words
        for found in split:
            at = list(map(known.place.__getitem__, found))
            made = list(map(known.groups.__getitem__, at))
            if None in made:
                yield NONE
            else:
                n_a, n_b = known.counts[np.array(at)].sum(axis=0).tolist()
                links = b"".join(map(known.links.__getitem__, at))
                yield n_a, n_b, b"".join(made)[1:], np.frombuffer(links, np.int64)


@dataclass
class _Words:
    """Groups (None: not given back), links and token counts of words by themselves, by place."""

    groups: list[bytes | None]
    links: list[bytes]
    counts: np.ndarray
    place: dict[str, int]


@functools.lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """One pair in each worker."""
    return Tokenizers(byte_level, pieces)


def cuts(text: str, size: int) -> list[tuple[int, int]]:
    """Places where the two sequences are cut, about `size` characters apart, both ends included."""

    def upto(pattern: re.Pattern, limit: int, last: int) -> int:
        if last >= limit:
            return last
        found = pattern.search(text, limit)
        return found.start() if found else len(text)

    places = [(0, 0)]
    for limit in range(size, len(text), size):
        a, b = places[-1]
        place = upto(_CUT_A, limit, a), upto(_CUT_B, limit, b)
        if place != places[-1]:
            places.append(place)
    if places[-1] != (len(text), len(text)):
        places.append((len(text), len(text)))
    return places


_DONE = "doc_id long, n_a long, n_b long, groups_sha256 string, codes binary, counts binary"


def _row(doc: int | None, n_a: int, n_b: int, groups: bytes, links: np.ndarray) -> tuple:
    codes, counts = np.unique(links, return_counts=True)
    digest = hashlib.sha256(groups).hexdigest() if n_a else ""
    return doc, n_a, n_b, digest, codes.tobytes(), counts.astype("<u4").tobytes()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _DONE.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def _ids(column: pd.Series) -> list[int | None]:
    """Ids that travelled as their digits, so that nulls beside them cost no precision."""
    return [None if i is None else int(i) for i in column]


def _short(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = tokenizers(*files)

        def found(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
            plain = [bool(text) and both.regular(text) for text in texts]
            words = both.aligned([text for text, p in zip(texts, plain) if p])
            for text, p in zip(texts, plain):
                if p:
                    yield next(words)
                else:
                    yield finished(both.fragment(" " + text, 0, " " + text, 0)) if text else NONE

        for batch in batches:
            ids, texts, first = _ids(batch["doc_id"]), batch["text"].tolist(), 0
            while first < len(ids):
                last, size = first, 0
                while last < len(ids) and size < AT_ONCE:
                    size += len(texts[last] or "")
                    last += 1
                pairs = zip(ids[first:last], found(texts[first:last]), strict=True)
                made = (_row(doc, *one) for doc, one in pairs)
                while rows := list(itertools.islice(made, RETURNED)):
                    yield _frame(rows)
                first = last

    return docs.mapInPandas(run, _DONE)


def _ranges(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, k, n, a_text, a_start, b_text, b_start of the ranges of long texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                text = " " + text
                places, a_start, b_start = cuts(text, size), 0, 0
                for k, ((a, b), (a_to, b_to)) in enumerate(zip(places, places[1:])):
                    a_text, b_text = text[a:a_to], text[b:b_to]
                    yield pd.DataFrame(
                        {
                            "row": [row],
                            "doc_id": [doc],
                            "k": [k],
                            "n": [len(places) - 1],
                            "a_text": [a_text],
                            "a_start": [a_start],
                            "b_text": [b_text],
                            "b_start": [b_start],
                        }
                    )
                    a_start += len(a_text.encode())
                    b_start += len(b_text.encode())

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        run,
        "row long, doc_id string, k long, n long, a_text string, a_start long, b_text string, b_start long",
    )


_PARTS = "row long, doc_id string, k long, fragment binary"


def _long(docs: DataFrame, files: tuple[str, str], size: int) -> DataFrame:
    """Ranges tokenised wherever they are dealt, and their fragments composed level by level."""
    ranges = store(_ranges(docs, size), "ranges")
    longest = ranges.agg(F.max("n")).first()[0] or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = tokenizers(*files)
        for batch in batches:
            for one in batch.itertuples(index=False):
                made = both.fragment(one.a_text, one.a_start, one.b_text, one.b_start)
                yield pd.DataFrame(
                    {"row": [one.row], "doc_id": [one.doc_id], "k": [one.k], "fragment": [pickle.dumps(made)]}
                )

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        parts = map(pickle.loads, rows.sort_values("k")["fragment"])
        first = rows.iloc[0]
        made = pickle.dumps(functools.reduce(compose, parts))
        return pd.DataFrame(
            {"row": [first["row"]], "doc_id": [first["doc_id"]], "k": [first["node"]], "fragment": [made]}
        )

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, fragment in zip(_ids(batch["doc_id"]), batch["fragment"], strict=True):
                yield _frame([_row(doc, *finished(pickle.loads(fragment)))])

    parts = ranges.repartition("row", "k").mapInPandas(run, _PARTS)
    while longest > 1:
        node = F.floor(F.col("k") / FAN).cast("long").alias("node")
        parts = parts.select("*", node).groupBy("row", "node").applyInPandas(composed, _PARTS)
        longest = -(-longest // FAN)
    return parts.mapInPandas(end, _DONE)


def _asked(rows: pd.DataFrame) -> pd.DataFrame:
    codes = np.concatenate([np.frombuffer(c, np.int64) for c in rows["codes"]])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"]])
    distinct, index = np.unique(codes, return_inverse=True)
    n = np.bincount(index, counts, len(distinct)).astype(np.int64)
    return pd.DataFrame({"block": rows["block"].iloc[0], "code": distinct, "n": n})


def _answered(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    answers = answers.sort_values("code")
    codes = answers["code"].to_numpy(np.int64)
    total, best = answers["total"].to_numpy(np.int64), answers["best"].to_numpy(bool)
    n_links, n_best, summed = [], [], []
    for asked, counts in zip(rows["codes"], rows["counts"], strict=True):
        at = np.searchsorted(codes, np.frombuffer(asked, np.int64))
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        n_links.append(int(n.sum()))
        n_best.append(int(n[best[at]].sum()))
        summed.append(int((n * total[at]).sum()))
    out = rows[["doc_id", "n_a", "n_b", "groups_sha256"]].copy()
    # Every group ends in one link.
    out["n_groups"], out["n_links"], out["n_best"], out["count_sum"] = n_links, n_links, n_best, summed
    return out.astype({"doc_id": "Int64"})


def pair_counts(asked: DataFrame) -> DataFrame:
    """code, total, best (no pair of its B id has more) of every linked id pair."""
    total = asked.groupBy("code").agg(F.sum("n").alias("total"))
    b = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    total = store(total.select("code", "total", b), "pairs")
    most = total.groupBy("b").agg(F.max("total").alias("most"))
    return total.join(most, "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))


def align(
    docs: DataFrame,
    byte_level: str | None = None,
    pieces: str | None = None,
    size: int = RANGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    import public_tokenizers

    files = (
        byte_level or public_tokenizers.path("byte_bpe_50k.json"),
        pieces or public_tokenizers.path("piece_bpe_32k.model"),
    )
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= size
    both = _short(named.filter(short), files).unionByName(_long(named.filter(~short), files, size))
    done = store(both.withColumn("row", F.monotonically_increasing_id()), "aligned")
    n_blocks = corpus.blocks_for(corpus.text_bytes(docs), block_bytes)
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block")
    rows = done.select("*", block)
    asked = store(
        rows.select("block", "codes", "counts")
        .groupBy("block")
        .applyInPandas(_asked, "block int, code long, n long"),
        "asked",
    )
    answers = asked.select("block", "code").join(pair_counts(asked), "code")
    return (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(
            _answered,
            "doc_id long, n_a long, n_b long, groups_sha256 string, n_groups long, n_links long,"
            " n_best long, count_sum long",
        )
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))
