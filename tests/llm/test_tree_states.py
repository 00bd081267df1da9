"""Contexts that a small corpus repeats are states of the tree."""

from wellkin.llm import suffixtree


def test_a_context_seen_a_few_times_is_a_state(spark):
    rows = [(i, f"north wind turns cold and north wind turns w{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixtree.score(frame).collect()
    words_alone = {r.doc_id: r.score for r in suffixtree.score(frame, least_count=10**6).collect()}
    assert len(got) == 40
    assert all(r.score > words_alone[r.doc_id] + 1 for r in got)


