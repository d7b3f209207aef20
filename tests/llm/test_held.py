"""A Python worker holds the words of one operator at a time."""

from rankfold.llm import bpe, near_dup, q_tokens
from rankfold.llm.held import cache


def test_an_operator_empties_the_caches_of_others():
    near_dup.shingles(near_dup.words("some words that are kept for the next task"))
    assert len(near_dup._WORDS) > 5
    with open(q_tokens.vocabulary_path(), "rb") as f:
        spec = f.read()
    model = bpe.model_of(bpe.BpeModel, spec)
    assert not near_dup._WORDS and bpe.model_of(bpe.BpeModel, spec) is model
    list(near_dup._sign(iter([])))
    assert not cache("bpe")
    ids = model.encode("some words")
    assert list(bpe.model_of(bpe.BpeModel, spec).encode("some words")) == list(ids)
