"""Token alignment against whole-text tokenisation, and the laws of its fragments."""

import base64
import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose, rows
from wellkin.llm import alignment
from wellkin.llm.alignment import Open, close, compose, finished

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def both():
    return alignment.Tokenizers(*FILES)


def groups_by_force(text):
    """Groups of a whole text: ids from the libraries, offsets counted one by one."""
    import sentencepiece
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    first = _encoding(tiktoken, ranks)
    second = _pieces(sentencepiece)
    names = {i: raw for raw, i in ranks.items()}
    if not text:
        return []
    want = (" " + text).encode()
    a, b = first.encode_ordinary(" " + text), second.encode(text)
    a_bytes = [names[i] for i in a]
    b_bytes = []
    for i in b:
        piece = second.id_to_piece(i)
        byte = len(piece) == 6 and piece.startswith("<0x")
        b_bytes.append(bytes.fromhex(piece[3:5]) if byte else piece.replace("▁", " ").encode())
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return []
    out, left, right, i, j, x, y = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            left.append(a[i])
            x += len(a_bytes[i])
            i += 1
        else:
            right.append(b[j])
            y += len(b_bytes[j])
            j += 1
        if x == y and left and right:
            out.append((tuple(left), tuple(right)))
            left, right = [], []
    assert not left and not right
    return out


def _encoding(tiktoken, ranks):
    if not hasattr(_encoding, "made"):
        _encoding.made = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoding.made


def _pieces(sentencepiece):
    if not hasattr(_pieces, "made"):
        _pieces.made = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    return _pieces.made


def named(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()


def align_by_force(table):
    found = [(doc, groups_by_force(text)) for doc, text in table]
    links = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups)
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc, groups in found:
        each = [links[a[-1], b[-1]] for a, b in groups]
        best = sum(links[a[-1], b[-1]] == most[b[-1]] for a, b in groups)
        out.append(
            (
                doc,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                len(groups),
                best,
                sum(each),
                hashlib.sha256(named(groups)).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=repr)


ODD = [
    (60, "a  b   c\n\n d\t e " * 40),
    (61, " leading and trailing  "),
    (62, "\n"),
    (63, " "),
    (64, "x" * 3_000),
    (65, "漢字かな交じり文" * 90 + " tail"),
    (66, "don't <|endoftext|> [INST] <s> </s> we'll"),
    (67, "mark ▁ inside"),
    (68, "nul \x00 bell \x07   　 \x85 \x1c end"),
    (69, "𝒳🙂👩‍👩‍👧 ﬁ é é " * 30),
    (70, "line\nline\n" * 300),
]


@pytest.fixture(scope="module")
def table():
    return [(r[0], r[1]) for r in rows()] + ODD


@pytest.fixture(scope="module")
def want(table):
    return align_by_force(table)


@pytest.mark.parametrize("size", [alignment.RANGE, 40])
def test_alignment_by_force(spark, table, want, size):
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = alignment.align(frame, size=size)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_alignment_ignores_other_columns_and_takes_empty_tables(spark, clashing):
    plain = alignment.align(clashing.select("doc_id", "text"))
    assert sorted(alignment.align(clashing).collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert alignment.align(clashing.limit(0)).collect() == []


TEXTS = st.lists(
    st.sampled_from(["word", " ", "\n", "  ", "'s", "12", "é", "漢", "🙂", "ly ", "\t", "▁", "aaaa", "\r\n"]),
    min_size=1, max_size=60,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_cut_texts_tokenise_as_whole_ones(text, size):
    full = " " + text
    places = alignment.cuts(full, size)
    assert places[0] == (0, 0) and places[-1] == (len(full), len(full))
    assert "".join(full[p[0] : q[0]] for p, q in zip(places, places[1:])) == full
    made = [[], []]
    for (a, b), (a_to, b_to) in zip(places, places[1:]):
        made[0] += both().encode_a(full[a:a_to]).tolist()
        made[1] += both().encode_b(full[b + 1 : b_to]) if b < b_to else []
    assert made[0] == named_tokenizer().encode(full, add_special_tokens=False).ids
    assert made[1] == both().encode_b(text)


@functools.cache
def named_tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(FILES[0])
    made.encode_special_tokens = True
    return made


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_tokenizer_files(text):
    got = named_tokenizer().encode(" " + text, add_special_tokens=False).ids
    assert both().encode_a(" " + text).tolist() == got


WORD = st.text(st.characters(exclude_categories=("Z", "C")), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(WORD, min_size=1, max_size=4).map(" ".join), min_size=1, max_size=4).map("\n".join))
def test_words_align_as_in_their_text(text):
    if not both().regular(text):
        return
    whole = finished(both().fragment(" " + text, 0, " " + text, 0))
    (words,) = both().aligned([text])
    assert words[:3] == whole[:3] and words[3].tolist() == whole[3].tolist()


@st.composite
def split_tokens(draw):
    """A text's tokens of both sequences dealt to ranges whose ends differ by sequence."""
    n = draw(st.integers(1, 40))
    ends = [sorted({*draw(st.lists(st.integers(1, n))), n}) for _ in range(2)]
    k = draw(st.integers(1, 6))
    marks = [[0, *sorted(draw(st.lists(st.integers(0, n), min_size=k - 1, max_size=k - 1))), n] for _ in range(2)]
    dealt = []
    for i in range(k):
        part = []
        for e, m in zip(ends, marks):
            own = [x for x in e if m[i] < x <= m[i + 1]]
            part += [np.array([x * 7 for x in own], np.int64), np.array(own, np.int64)]
        dealt.append(Open(*part))
    return ends, dealt


def seen(fragment):
    parts = [fragment.head, fragment.tail]
    return (
        [getattr(p, f).tolist() for p in parts for f in ("a", "a_ends", "b", "b_ends")],
        fragment.body,
        fragment.links.tolist(),
        fragment.n_a,
        fragment.n_b,
    )


@settings(max_examples=300, deadline=None)
@given(split_tokens(), st.randoms(use_true_random=False))
def test_fragments_compose_in_any_order(case, rng):
    ends, dealt = case
    parts = [close(p, len(p.a), len(p.b)) for p in dealt]
    whole = functools.reduce(compose, parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [compose(parts[i], parts[i + 1])]
    assert seen(parts[0]) == seen(whole)
    common = [0, *sorted(set(ends[0]) & set(ends[1]))]
    groups = [
        tuple(tuple(7 * x for x in e if low < x <= high) for e in ends) for low, high in zip(common, common[1:])
    ]
    n_a, n_b, text, links = finished(whole)
    assert (n_a, n_b, text) == (len(ends[0]), len(ends[1]), named(groups))
    assert links.tolist() == [(a[-1] << 32) | b[-1] for a, b in groups]


def test_long_text_in_linear_time():
    text = " " + prose(5, 400) * 400
    assert len(alignment.cuts(text, 1_000)) > 100
    assert alignment.cuts("x" * 2_000_000, 10) == [(0, 0), (2_000_000, 2_000_000)]
