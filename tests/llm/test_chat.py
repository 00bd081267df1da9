"""Chat examples: exact round trips, digests against hashlib, and the SQL."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import connect, difference
from wellkin.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = st.text(st.sampled_from(list("<>[]/sINT\\é ")), max_size=14)
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello\n\n there"), (1, 2, "user", None),
    (1, 3, "assistant", ""), (1, 4, "user", "unanswered"),
    (2, 1, "assistant", "second"), (2, 0, "assistant", "first"),
    (3, 0, "user", "[INST] <s> </s> [/INST] <\\s> [\\\\INST]"), (3, 1, "assistant", "</s>[/INST]"),
    (4, None, "user", "null turn"), (4, 0, None, "null role"), (4, 1, "tool[INST]", "other role"),
    (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, 0, "assistant", "tie"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "𝒳🙂"),
    (6, 0, "system", "be brief"), (7, 0, "user", "<"), (7, 1, "assistant", "/s>"), (7, 2, "user", "["),
]
LONG = [(8, i, "assistant" if i % 2 else "user", f"turn {i} " * 5) for i in range(300)]


def ordered(rows):
    out = defaultdict(list)
    for conv, *turn in rows:
        out[conv].append(turn)
    low = lambda v: (v is not None, v)
    return {c: sorted(t, key=lambda x: tuple(map(low, x))) for c, t in out.items()}


def digests(rows):
    out = set()
    for conv, turns in ordered(rows).items():
        every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (every, loss)]
        out.add((conv, len(turns), sha[0], len(loss), sha[1]))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS + LONG, SCHEMA).repartition(3)


def test_read_back_gives_what_went_in(frame):
    got = chat.read_back(chat.examples(frame)).collect()
    assert {tuple(r)[:5] for r in got} == digests(ROWS + LONG) and len(got) == 9


def test_each_reply_has_all_turns_before_it_and_is_all_that_trains(frame):
    made = chat.examples(frame).withColumn("turns", chat.turns(F.col("text"))).collect()
    turns = ordered(ROWS + LONG)
    seen = defaultdict(list)
    for r in made:
        want = [(role or "", text or "") for _, role, text in turns[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == want[: r.n_turns]
        assert r.last == (r.n_turns == len(want))
        if r.loss_start is None:
            assert r.last and want[-1][0] != "assistant" and r.loss_chars == 0
            continue
        assert want[r.n_turns - 1][0] == "assistant"
        masked = r.text[r.loss_start : r.loss_start + r.loss_chars]
        assert r.text[r.loss_start + r.loss_chars :] == chat.CLOSE
        assert masked.count(chat.CLOSE) == masked.count(chat.HEAD) == 0
        seen[r.conv_id].append(r.n_turns)
    for conv, want in turns.items():
        replies = [i + 1 for i, t in enumerate(want) if t[1] == "assistant"]
        assert sorted(seen[conv]) == replies


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(CONTROL, CONTROL), min_size=1, max_size=40))
def test_control_strings_survive(spark, texts):
    rows = [(0, i, role, text) for i, (role, text) in enumerate(texts)]
    made = chat.examples(spark.createDataFrame(rows, SCHEMA)).filter("last")
    (row,) = made.select(chat.turns(F.col("text")).alias("turns")).collect()
    assert [(t.role, t.text) for t in row.turns] == texts


def test_other_columns_empty_tables_and_no_python(spark, frame):
    named = frame.select("*", *[F.lit("x").alias(c) for c in ("place", "piece", "end", "last", "whole")])
    plain = sorted(map(tuple, chat.examples(frame).collect()), key=repr)
    assert sorted(map(tuple, chat.examples(named).collect()), key=repr) == plain
    assert chat.read_back(chat.examples(frame.limit(0))).collect() == []
    plan = chat.read_back(chat.examples(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    name = "op11_chat_prefixes"
    assert difference(chat.op11_chat_prefixes(spark, path), connect(path), chat.ORACLE[name]) is None


def test_sql_agrees_on_odd_rows(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(chat.op11_chat_prefixes(spark, str(tmp_path)), con, chat.ORACLE["op11_chat_prefixes"]) is None
