"""Operators against brute force on a small table with nulls, empties, copies and a long text."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from wellkin.llm import (
    decontaminate,
    extract,
    language,
    licenses,
    packing,
    quality,
    repeats,
    simhash,
    toxicity,
)

NONE = -1


def by_id(frame):
    return sorted(map(tuple, frame.fillna({"doc_id": NONE}).collect()), key=repr)


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    save(docs, path)
    labels = [(i, i % 2, int(i in (3, 5, 7))) for i in range(1, 56)] + [(None, None, None)]
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), path, "labels")
    long_item = rows()[11][1]
    items = [(0, "Word"), (1, long_item), (2, None), (3, ""), (4, "!!"), (1, long_item), (5, "12-34")]
    save(spark.createDataFrame(items, "item_id long, text string"), path, "benchmark")
    return path


def cut_by_force(table):
    first = {}
    for i, t in table:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            key = raw[s : s + 50]
            first[key] = min(first.get(key, repeats.NO_ID), i if i is not None else repeats.NO_ID)
    out = []
    for i, t in table:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < (i if i is not None else repeats.NO_ID):
                gone[s : s + 50] = True
        kept = bytes(c for c, g in zip(raw, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i if i is not None else NONE, len(raw), int(gone.sum()), spans,
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, folder, monkeypatch):
    want = cut_by_force([r[:2] for r in rows()])
    assert by_id(repeats.op1_repeats(spark, folder)) == want
    assert any(r[2] for r in want)


def test_hot_anchors_and_small_parts_change_nothing(spark):
    texts = [bytes([97 + k % 7]) * 80 + b"shared" * 20 + bytes([98 + k % 5]) * 60 for k in range(30)]
    table = [(k, t.decode()) for k, t in enumerate(texts)]
    block = pd.DataFrame(table, columns=["doc_id", "text"]).assign(block=0, id=range(30))
    block["row_key"] = range(100, 130)
    for hot in (False, True):
        sent = repeats._anchors(block, 4)
        answered = pd.concat([repeats._repeated(g) for _, g in sent.groupby("bucket")])
        answered["hot"] = [np.full(len(k) // 4, hot).tobytes() for k in answered["keys"]]
        asked = next(repeats._contexts(block, answered, 4))
        spans = pd.concat([repeats._settle(g) for _, g in asked.groupby("bucket")])
        cut = repeats._cut(block, spans)
        got = [(i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest())
               for i, n, s, k in zip(cut.doc_id, cut.n_bytes, cut.spans, cut.kept)]
        assert sorted(got, key=repr) == cut_by_force(table)


def test_intervals_of_a_suffix_array():
    # mississippi: common prefixes of neighbours in suffix order
    common = [0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3]
    found = {(a, b, n) for a, b, n, _ in repeats.intervals(common, 11) if n}
    assert found == {(0, 4, 1), (2, 4, 4), (5, 7, 1), (7, 9, 2), (7, 11, 1), (9, 11, 3)}


def test_cut_documents_keep_columns_and_rows(clashing):
    cut = repeats.cut_repeats(clashing)
    assert cut.columns == clashing.columns and cut.count() == clashing.count()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = [(r["doc_id"] if r["doc_id"] is not None else NONE, digest(r["text"])) for r in cut.collect()]
    assert Counter(got) == Counter((r[0], r[-1]) for r in cut_by_force([r[:2] for r in rows()]))
    others = [c for c in cut.columns if c not in ("text", "n_chars")]
    assert cut.select(others).exceptAll(clashing.select(others)).count() == 0


def test_licenses_and_null_texts(spark):
    grant, notice = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-notice"]
    table = [
        (1, f"Intro. {grant.upper()}.\n\n{notice}! End"), (2, f"{notice}. {grant}."), (3, None), (4, ""),
        (5, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (5, "licensed, under CC-BY NC 4.0"),
    ]
    got = licenses.scan(spark.createDataFrame(table, "doc_id long, text string"))
    want = [
        (1, 2, "mit-grant,mit-notice", "MIT"), (2, 2, "mit-notice,mit-grant", ""), (3, 0, "", ""),
        (4, 0, "", ""), (5, 1, "cc-by-nc-4", "CC-BY-NC-4.0"),
        (5, 2, "cc-by-nc-4,all-rights", "CC-BY-NC-4.0,all-rights-reserved"),
    ]
    assert by_id(got) == want
    assert all(any(t in s for t in licenses.TRIGGERS) for s in licenses.SENTENCES.values())


def test_language(spark, folder, clashing):
    got = language.op4_language(spark, folder).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    empty = {50, 51, 52, 53, NONE}
    for r in got:
        if r["doc_id"] in empty:
            assert r["lang_pred"] == "und"
    kept = language.keep_identified(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({50, 51, 52, 53})


def test_the_least_score_rejects_texts(spark, docs):
    scores = {r["doc_id"]: r["lang_score"] for r in language.identify(docs).collect()}
    kept = {r["doc_id"] for r in language.keep_identified(docs, 0.9).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.9} and 0 < len(kept) < len(scores)


def test_rows_alike_but_in_one_column_have_a_defined_first(spark):
    data = [(1, "same words here again", s) for s in ("b", "a", "a", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    first = [simhash.keep_first(docs.repartition(n)).collect() for n in (1, 4)]
    assert first[0] == first[1] and len(first[0]) == 1


def test_decontamination_keeps_every_column_name(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, "clean words", "x", "y")], "doc_id long, text string, row_key string, block string")
    items = [(i, " ".join(f"{'w' if i == 3 else 'q'}{k}" for k in range(12))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        kept = decontaminate.keep_clean(docs, bench)
        assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_long_and_rare_languages_are_learned(spark):
    """Labelled texts over 16 KB count, and a language of few rows among many is predicted."""
    rng = np.random.default_rng(4)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))

    table = [(i, text("abcdef", 30), "xx") for i in range(2_000)]
    table += [(5_000 + i, text("uvwxyz", 30), "yy") for i in range(6)]
    table += [(6_000 + i, text("mnopqr", 4_000), "zz") for i in range(6)]
    table += [(7_000, text("uvwxyz", 40), None), (7_001, text("mnopqr", 40), None), (7_002, "12", "xx")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, size=192).collect()}
    assert all(got[i] == lang for i, _, lang in table if lang and i < 7_000)
    assert (got[7_000], got[7_001], got[7_002]) == ("yy", "zz", "und")


def test_without_a_labelled_row_texts_with_letters_stay(spark):
    table = [(1, "some words", None), (2, "12 !", None), (3, None, None), (None, "é", None), (4, "", "en")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").filter("lang is null")
    assert {r["doc_id"] for r in language.keep_identified(docs).collect()} == {1, None}


def test_quality_counts_and_viterbi(spark, folder):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.op5_quality(spark, folder).collect()}
    for i, t, *_ in rows():
        w = (t or "").encode().split()
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + x for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for x in range(5)}
        r = got[i, len(w)]
        assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert not (r["kept"] and r["base_failed"])
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        scores, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            value[tuple(y)] = sum(scores[k][y[k]] for k in range(n)) + sum(
                move[y[k - 1]][y[k]] for k in range(1, n))
        best = max(value, key=value.get)
        assert tuple(quality.viterbi([tuple(s) for s in scores.tolist()], move.tolist())) == best


def test_pair_that_only_interacts_is_learned(spark):
    """An insult with a group is toxic, either alone is not; unseen pairs of words stay clean."""
    rng = np.random.default_rng(3)
    sets, label = [], []
    for _ in range(3_000):
        a, b = rng.random(2) < 0.5
        sets.append(np.array(sorted([*rng.integers(10, 500, 5), *([1] * int(a)), *([2] * int(b))]), np.int64))
        label.append(float(a and b))
    machine = toxicity.fit([np.unique(s) for s in sets], np.array(label))
    bias, place, w, v = machine
    raw = lambda *t: bias + sum(w[place[x]] for x in t) + (
        float(v[place[t[0]]] @ v[place[t[1]]]) if len(t) > 1 else 0.0)
    assert raw(1, 2) > 0 > max(raw(1), raw(2), bias)


def test_toxicity_rows(spark, folder):
    got = toxicity.op6_toxicity(spark, folder).collect()
    assert len(got) == len(rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.op7_packing(spark, folder).toPandas()
    want = Counter()
    for i, t, *_ in rows():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i if i is not None else NONE, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, got[columns].fillna(NONE).astype(int).to_numpy().tolist())) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum([0, *s["length"][:-1]])).all()
        assert s["length"].sum() <= 2048


@pytest.mark.parametrize("text", ["a  b", " a", "a\n", "it's <|endoftext|> x", "a b", "x\r\ny", "é\tz"])
def test_remembered_words_give_the_tokenizers_ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    encode = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == exact


def test_cutting_stock_holds_the_demand():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 65)
    for demand in (rng.integers(1, 90, 64), np.ones(64, int)):
        plans = packing.solve(sizes, demand, 64)
        assert (sum(n * c for n, c in plans) == demand).all()
        assert all((c * sizes).sum() <= 64 for _, c in plans)
        assert sum(n for n, _ in plans) <= 1.05 * np.ceil((sizes * demand).sum() / 64) + 2


def test_extraction():
    weights = extract.fit([])
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='x'>Home</a></nav>"
        "<div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three.<p>"
        + "Four five six seven eight nine ten. " * 4
        + "<div class='cookie-notice'>We use cookies</div></article><script>if(a<b){'</p>'}</script>"
        "<div id=comments><p>nice post</p></div><footer>&copy; x</footer>"
    )
    text = extract.main_text(page, extract.Costs(weights))
    assert text.split("\n\n")[:2] == ["A & B", "One two three."]
    for gone in ("Home", "Buy", "cookies", "nice", "©", "if("):
        assert gone not in text
    for empty in (None, "", "<p>", "<", "<div class='", "<!-- x"):
        assert extract.main_text(empty, extract.Costs(weights)) in ("", "<")


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 7
        score = rng.normal(size=n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side, score=score, edges=edges):
            loss = sum(s if s > 0 else 0 for s, x in zip(score, side) if not x)
            loss += sum(-s if s < 0 else 0 for s, x in zip(score, side) if x)
            return loss + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([code >> k & 1 for k in range(n)]) for code in range(2**n))
        assert cost(extract.min_cut(score, edges)) == pytest.approx(best)


def by_force(table, bits=4):
    prints = {}
    for i, t in table:
        w = [x for x in (t or "").encode().translate(simhash._LOWER).split()]
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
        prints[i, t] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    values = set(prints.values())
    group = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= bits and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for (i, t), v in prints.items():
        if i is not None:
            least[group[v]] = min(least.get(group[v], i), i)
    return sorted(((i if i is not None else NONE, f"{prints[i, t]:016x}", least.get(group[prints[i, t]]))
                   for i, t in table), key=repr)


def test_simhash(spark, folder, clashing):
    want = by_force([r[:2] for r in rows()])
    assert by_id(simhash.op9_simhash(spark, folder)) == want
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    firsts = {c for _, _, c in want if c is not None}
    assert firsts <= {r["doc_id"] for r in kept.collect()}


def test_components_without_an_id_of_their_own_keep_a_row(spark):
    """Null ids and an id on two texts are no links: each unrelated text keeps exactly one row."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = texts[5].replace("f39", "changed")
    table = [
        (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[0]), (None, None), (None, ""),
        (7, texts[3]), (7, texts[4]), (7, texts[3]), (None, texts[4]), (9, texts[5]), (8, near),
    ]
    prints = [simhash.fingerprint(t) for t in (*texts, "")]
    far = [(a ^ b).bit_count() for k, a in enumerate(prints) for b in prints[:k]]
    reach = max(4, (prints[5] ^ simhash.fingerprint(near)).bit_count())
    assert min(far) > reach and reach < 12
    kept = simhash.keep_first(spark.createDataFrame(table, "doc_id long, text string"), distance=reach)
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, ""), (7, texts[3]), (7, texts[4]), (8, near)]
    assert got == Counter(want)


def test_anchors_cover_every_close_pair():
    rng = np.random.default_rng(5)
    for first, width in simhash.BLOCKS:
        x = rng.integers(0, 1 << width, 200)
        for flips in (0, 1):
            y = x ^ np.where(flips, 1 << rng.integers(0, width, 200), 0)
            rows_, found = simhash.anchors(y, width, 2)
            reach = {(int(r), int(a)) for r, a in zip(rows_, found)}
            assert all((k, int(a)) in reach for k, a in enumerate(simhash.home(x)))


def test_decontamination(spark, folder, docs, clashing):
    got = decontaminate.op10_decontaminate(spark, folder)
    items = {}
    for item, text in {(0, "Word"), (1, rows()[11][1]), (5, "12-34")}:
        w = decontaminate.words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            items.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    want = []
    for i, t, *_ in rows():
        w = decontaminate.words(t)
        hit, found = set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (own := items.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i if i is not None else NONE, len(w), len(hit), len(found), digest, bool(hit)))
    assert by_id(got) == sorted(want, key=repr)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    kept = decontaminate.keep_clean(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == sum(not r[-1] for r in want)


def test_many_benchmark_blocks_give_the_same(spark, folder, monkeypatch):
    whole = by_id(decontaminate.op10_decontaminate(spark, folder))
    kept = decontaminate.keep_clean(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    ).count()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert by_id(decontaminate.op10_decontaminate(spark, folder)) == whole
    assert decontaminate.keep_clean(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    ).count() == kept


def test_empty_tables(spark, tmp_path):
    from tests.llm.conftest import SCHEMA

    save(spark.createDataFrame([], SCHEMA), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    from wellkin.llm.catalog import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_pipeline_by_force(spark, folder):
    """Stages of the pipeline applied by plain Python to the same rows."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, folder)
    found = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    table = [r[:2] for r in rows() if r[1] and any(map(str.isalpha, r[1]))]
    groups = {c for _, _, c in by_force(table)}
    first = [(i, t) for i, t in dict.fromkeys(table) if i in groups]
    texts = {}
    for (i, t), (_, n, gone, *_r) in zip(
        sorted(first, key=lambda r: repr((r[0],))), cut_by_force(first), strict=True
    ):
        texts[i] = (t, gone)
    clean = {i for i, (t, gone) in texts.items() if gone == 0 and not any(
        w in (b"word",) for w in decontaminate.words(t)) and "12-34" not in t}
    hit = {20}  # the benchmark's own passage, which only its first document keeps whole
    assert clean - hit <= found
    assert found.isdisjoint({50, 51, 52, 53, 30 if 3 in found else 3})
