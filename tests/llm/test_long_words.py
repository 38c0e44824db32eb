import numpy as np
import public_tokenizers
import pytest

from parlance.llm import sentencepiece_codec
from parlance.llm.token_counts import count_in_trie
from parlance.llm.unigram import LONG, Pieces


@pytest.fixture(scope="module")
def search():
    return sentencepiece_codec.Viterbi(Pieces(public_tokenizers.path("piece_bpe_32k.model")))


def test_a_long_word_has_the_ids_of_the_batched_search(search, monkeypatch):
    r = np.random.default_rng(0)
    words = ["".join(r.choice(list("abcdethnéß漢\U0001f600xyzing"), n)) for n in (1, 2, 17, 60, LONG - 1, LONG)]
    batched = search.encode(words)
    for window in (7, sentencepiece_codec.WINDOW):
        monkeypatch.setattr(sentencepiece_codec, "WINDOW", window)
        assert all(search.long_word(w) == batched[w] for w in words)
    word = "".join(r.choice(list("abcdethnxyzing"), 40_000))
    assert len(search.encode([word])[word]) == 4 * count_in_trie([word], search.pieces)[word]


def test_two_substrings_of_one_hash_are_told_apart(search, monkeypatch):
    word, n = next(p for p in search.pieces.id if len(p) == 3 and len(search.encode([p])[p]) == 4), 3
    keys, scores, ids, codes, some = search.keys[n]
    monkeypatch.setitem(search.keys, n, (keys, scores, ids, codes * 0, some))  # the keys now stand for other texts
    found = search.encode([word])[word]
    assert len(found) > 4 and search.long_word(word) == found
