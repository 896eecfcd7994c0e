import hashlib

import numpy as np
import pytest

from cohortlab.llm import byte_bpe

TEXTS = [
    None, "", " ", "Hello world", "it's 3.14, ok?  \n\n tabs\tand   spaces ", "Ünïcödé — “quotes” 日本語 🙂🙂", "x" * 3000, " \n" * 500,
    "word " * 5000, "a1b2c3" * 800, "'s 't's'", "<|endoftext|>",
]


def plain(text):
    return byte_bpe.encoder(byte_bpe.RANKS, byte_bpe.PATTERN).encode_ordinary(text or "")


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_pieces_encode_like_the_whole(size):
    for text in TEXTS:
        got = np.frombuffer(byte_bpe.encode_text(text or "", size=size), "<u4").tolist()
        assert got == plain(text)
        assert "".join(byte_bpe.pieces(text or "", size)) == (text or "")


def test_a_text_without_boundaries_stays_whole():
    assert list(byte_bpe.pieces("x" * 1000, 10)) == ["x" * 1000]


def test_digests_round_trip(documents):
    rows = list(enumerate(TEXTS)) + [(3, "Hello world"), (None, "Hello world")]
    found = byte_bpe.digests(documents(rows)).collect()
    assert len(found) == len(rows)
    want = sorted(
        (str(i), len(plain(t)), hashlib.sha256(np.array(plain(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


def test_empty_table_and_clashing_columns(documents):
    docs = documents([]).withColumnRenamed("source", "ids")
    assert byte_bpe.digests(docs).count() == 0
    out = byte_bpe.encode(documents([(1, "ab")]).withColumnRenamed("source", "ids")).collect()[0]
    assert out["ids"] == np.array(plain("ab"), "<u4").tobytes()


def test_unknown_id_is_an_error(spark):
    bad = spark.createDataFrame([(bytearray(np.array([10_000_000], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(Exception, match="IndexError|list index"):
        byte_bpe.decode(bad).collect()
