import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bazaarlens.llm import token_file as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\n b", "a \n\n  b", "it's  they'll 're", "tab\tx y", "nb sp ace", " x", "<|endoftext|> a", "b <|endoftext|>", "x<|endoftext|>y <|endoftext|> z", "<|endoftext |>", "a\x0b b", "\x0bc d\x0b e", "é́ ñ 日本 語", "a\x1c b", "12 3,4 .. !", "x" * 5000, "\n", "a\n", "\r\n z"]


def direct():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_stretches_give_the_ids_of_whole_texts(sample):
    texts = ODD + [r.text for r in sample.limit(60).collect()]
    encode = direct()
    ids, at = tf.token_ids(pa.array(texts), PATH)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encode(text), text


@pytest.mark.parametrize("kept", [0, 40, 10**6])
def test_pieces_are_encoded_once_a_worker(monkeypatch, kept):
    """Ids as by encoding each text alone, whatever is kept; what is kept is not encoded again, nor is a word with other signs behind it."""
    monkeypatch.setattr(tf, "KEPT", kept, raising=False)
    words = ["a", "it's", "Straße", "don't", "x1", "été", "É", "'", "can", "ſo", "I'll", "日本", "a\nb", "a.\n\nb", "a\n", "re", "s", "'s", "ǅ", "×"]
    signs = ["", ".", "',", "'\n", "...", "\nSo", ".\nSo!", "'\n's", "\n's", "\u00a0", "$$$", "-", "1", "_\nd_", "\n", "'s", "!\nre'"]
    texts = [" ".join(["so"] + [w + s for w in words[k:] + words[:k] for s in signs]) for k in range(4)]
    encode = direct()
    for part in (texts[:1], texts, ODD, texts + ODD):
        ids, at = tf.token_ids(pa.array(part), PATH)
        for k, text in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == encode(text), text
    fresh = [f"piece{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    one = pa.array([" ".join(["so", *fresh])])
    two = pa.array([" ".join(["so", *(w + "!" for w in fresh), *(w + ".\nso" for w in fresh)])])
    tf.token_ids(one, PATH)
    sent, real = [], tf._ids_of
    monkeypatch.setattr(tf, "_ids_of", lambda tokenizer, some: sent.extend(some) or real(tokenizer, some))
    ids, _ = tf.token_ids(two, PATH)
    assert ids.tolist() == encode(two[0].as_py())
    assert sum(map(len, sent)) < (200 if kept > 40 else 10_000)


@pytest.mark.parametrize("n,bits", [(1, 16), (2, 16), (3, 2), (300, 9), (50_000, 16)])
def test_code_lengths_and_round_trip(n, bits):
    rng = np.random.default_rng(n)
    counts = (1e7 / np.arange(1, n + 1) ** 1.5).astype(np.int64) + 1
    lengths = tf.code_lengths(counts, bits)
    assert lengths.max() <= bits and (n == 1 or (2.0 ** -lengths.astype(float)).sum() == 1)
    ids = rng.integers(0, n, 10_000).astype(np.uint32)
    for part in (ids, ids[:1], ids[:64], ids[:0]):
        data, marks = tf.encode(part, tf.canonical(lengths), lengths)
        assert (tf.decode(data, marks, len(part), tf.decoding_table(lengths)) == part).all()


def test_lengths_are_optimal_where_the_limit_does_not_bind():
    assert tf.code_lengths(np.array([1, 1, 2, 4, 0]), 16).tolist() == [3, 3, 2, 1, 0]
    assert tf.code_lengths(np.array([1, 1, 2, 4, 0]), 2).tolist() == [2, 2, 2, 2, 0]
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(5), 2)


def check(spark, df, tmp_path, **more):
    to = str(tmp_path / "f")
    tf.write_tokens(df, PATH, to, **more)
    encode = direct()
    got = sorted(tf.read_tokens(spark, to).collect(), key=lambda r: r.start)
    want, start = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0)), 0
    assert [r.id for r in got] == [i for i, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids)
        assert ids == [*encode(text), 2]
        start += len(ids)


def test_round_trip_through_files(spark, sample, tmp_path):
    check(spark, sample, tmp_path, block_ids=5000, shard_ids=50_000)


def test_odd_rows(spark, docs, tmp_path):
    check(spark, docs([*ODD, None], [*range(len(ODD)), None]), tmp_path)


def test_no_rows(spark, docs, tmp_path):
    check(spark, docs([]), tmp_path)


def test_query(spark, sample):
    encode = direct()
    got = {r.doc_id: r for r in tf.op1_token_file(spark, "/root/testdata/sf0.001").collect()}
    for r in sample.collect():
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array([*encode(r.text), 2], "<u4").tobytes())
