"""A blank beside U+2581, which one tokenizer takes for a blank, is no place to cut."""

import pytest

from tests.llm.test_alignment import both
from wellkin.llm import alignment


@pytest.mark.parametrize("text", ["▁ 12", "a ▁ 12", "▁ ▁ 12", "word ▁12 word"])
@pytest.mark.parametrize("size", [1, 2, 3])
def test_pieces_of_cut_texts_are_those_of_the_whole(text, size):
    full, made = " " + text, []
    places = alignment.cuts(full, size)
    for (_, start), (_, end) in zip(places, places[1:]):
        made += both().encode_b(full[start + 1 : end]) if start < end else []
    assert made == both().encode_b(text)
