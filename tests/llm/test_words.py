import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import plain_words
from oakloom.llm.words import WordIds, sequence_key, words


@pytest.mark.parametrize("text, expected", [(None, []), ("", []), ("_ - !", []), ("ＡＢ ﬁx", ["ab", "fix"]), ("mo­del a_b", ["model", "a", "b"]), ("日本語 x1", ["日本語", "x1"])])
def test_words_of_known_texts(text, expected):
    assert words(text) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_are_those_of_the_definition(text):
    assert words(text) == plain_words(text)


def test_keys_keep_order_and_border():
    assert sequence_key(["a"], ["b"]) != sequence_key(["a", "b"], [])
    assert sequence_key(["a", "b"], []) != sequence_key(["b", "a"], [])


def test_ids_survive_forgetting():
    ids = WordIds()
    ids.most = 2
    first = ids["a"]
    for w in "bcdef":
        ids[w]
    assert ids["a"] == first and len(ids) <= 3
