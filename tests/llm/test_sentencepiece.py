import random

import numpy as np
import public_tokenizers
import pytest

from bazaarlens.llm import sentencepiece as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  blanks ", "line\nend", "ñandú größer 日本語 \U0001f600", "▁marker", "tab\tnul\x00", "x" * 3000, "a b", "the the the"]


def brute(pieces, word):
    """(best score, pieces) by the plain recurrence; of equal scores the longest last piece."""
    number = {pieces.spelt[i]: i for i in pieces.ids.tolist()}
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(e):
            piece = word[b:e]
            if piece in number:
                cand = best[b][0] + pieces.scores[number[piece]], [*best[b][1], number[piece]]
            elif e - b == 1:
                cand = best[b][0] + pieces.unknown, [*best[b][1], *[int(pieces.id_of_byte[v]) for v in piece.encode()]]
            else:
                continue
            if best[e] is None or cand[0] > best[e][0]:
                best[e] = cand
    return best[-1][1]


@pytest.fixture(scope="module")
def pieces():
    p = sp.load(PATH)
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=PATH)
    p.spelt = {i: own.id_to_piece(i) for i in p.ids.tolist()}
    return p


def test_trie_finds_each_piece(pieces):
    trie = pieces.trie
    for i in random.Random(1).sample(range(len(pieces.ids)), 500):
        state = np.zeros(1, np.int64)
        for s in trie.symbols(np.array([ord(c) for c in pieces.spelt[int(pieces.ids[i])]])):
            state, ok = trie.step(state, np.array([s]))
            assert ok.all()
        assert trie.piece[state[0]] == i


def test_against_the_plain_recurrence(pieces, sample):
    words = sorted({sp.MARK + w for r in sample.limit(20).collect() for w in r.text.split(" ")})[:600]
    words += [sp.MARK + t for t in ODD] + ["aé\n日x", sp.MARK * 5 + "a"]
    words = [w for w in words if len(w) < 100]
    ids, at = sp.viterbi(pieces, words)
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == brute(pieces, w), w


def test_round_trip(docs, sample):
    texts = [*ODD, None, *[r.text for r in sample.collect()]]
    rows = {r.id: r for r in sp.decode(sp.encode(docs(texts), PATH), PATH).collect()}
    for i, t in enumerate(texts):
        assert rows[i].decoded == (t or "").replace(sp.MARK, " ")
    assert all(r.same for r in sp.round_trip(docs(texts), PATH).collect())


def test_whole_texts_are_segmented_as_one_word(pieces, docs):
    texts = ODD[:7] + ["a  bc the end  of", "  x"]
    rows = {r.id: np.frombuffer(r.ids, "<i4").tolist() for r in sp.encode(docs(texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == brute(pieces, sp.MARK + t.replace(" ", sp.MARK)), t


def test_no_rows_and_repeats(docs):
    assert sp.round_trip(docs([]), PATH).count() == 0
    assert sp.round_trip(docs(["a", "a"], [None, None]), PATH).count() == 2
