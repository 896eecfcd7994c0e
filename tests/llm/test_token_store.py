import io
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from cohortlab.llm import token_store as ts

TEXTS = [
    "The quick brown fox, jumped.", "", None, "it's,a “quoted” word… don't. x<|endoftext|>y ÀÉ.́ İ ΣΑΣ a'S!! 'tis ½ z\x0by", "   ", "$$$,### end.'s (x)",
    "<|endoftext|>", "a<|startoftext|><|endoftext|> b <|endoftext|>", "<|EndOfText|> <|endoftext|", "<|endo ftext|>",
    "word " * 40_000, "xy" * 5000, "Ünïcödé, ÄÖ… 3,5.", "The quick brown fox, jumped.",
]


LIBRARY = Tokenizer.from_file(ts.TOKENIZER)


def whole(text):
    """Ids of the library, with its defaults, over the whole text."""
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_words_encode_like_whole_texts():
    got = ts.word_encoder(ts.TOKENIZER).batch(TEXTS)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(t) for t in TEXTS]


def test_cache_bound_does_not_change_results(monkeypatch):
    monkeypatch.setattr(ts, "CACHE_WORDS", 3)
    encoder = ts.WordEncoder(ts.TOKENIZER)
    for text in TEXTS:
        assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == whole(text)


@pytest.mark.parametrize("width", [2, 4])
def test_file_round_trip_and_partial_reads(width):
    docs = {k: np.arange(n, dtype="<u4") % 50_000 for k, n in enumerate([1, 0, 250, 99, 3])}
    out = io.BytesIO()
    writer = ts.Writer(out, width, frame_ids=100)
    for k, ids in docs.items():
        writer.add(k, ids.tobytes())
    writer.close()
    reader = ts.Reader(io.BytesIO(out.getvalue()))
    for i in reversed(range(len(docs))):
        assert reader.ids(i).tolist() == docs[i].tolist()
    one = ts.Reader(io.BytesIO(out.getvalue()))
    assert one.ids(4).tolist() == docs[4].tolist() and one.frames_read == 1
    # an ordinary reader sees the ids and skips index and seek table
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == np.concatenate(list(docs.values())).astype(f"<u{width}").tobytes()


def test_damage_is_found():
    out = io.BytesIO()
    writer = ts.Writer(out, 4, frame_ids=10)
    writer.add(1, np.arange(20, dtype="<u4").tobytes())
    writer.close()
    data = bytearray(out.getvalue())
    reader = ts.Reader(io.BytesIO(data))
    reader.entries[1] = (*reader.entries[1][:2], reader.entries[1][2] ^ 1)
    with pytest.raises(ValueError, match="damaged"):
        reader.frame(1)
    with pytest.raises(ValueError, match="seek table"):
        ts.Reader(io.BytesIO(bytes(data[:-1]) + b"x"))


def test_store_and_read_back(documents):
    rows = [(50 - k, t) for k, t in enumerate(TEXTS)] + [(45, "again")]
    store = ts.write(documents(rows).repartition(3))
    found = {}
    for r in ts.digests(store).collect():
        found.setdefault(r.doc_id, []).append(r)
    start = 0
    for key in sorted({i for i, _ in rows}):
        mine = sorted(found[key], key=lambda r: r.start)
        want = sorted((len(whole(t)) + 1, zlib.crc32(np.array([*whole(t), 1], "<u4").tobytes())) for i, t in rows if i == key)
        assert sorted((r.n_tokens, r.ids_crc32) for r in mine) == want
        for r in mine:
            assert r.start == start
            start += r.n_tokens
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in ts.fetch(store, [50, 48, 7]).collect()}
    assert got == {50: [*whole(TEXTS[0]), 1], 48: [1]}


def test_empty_table_and_missing_key(documents):
    assert ts.digests(ts.write(documents([]))).count() == 0
    store = ts.write(documents([(3, "b c"), (None, "x"), (-4, ""), (None, "y z")]).repartition(2))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in ts.digests(store).collect())
    assert [r[1] for r in got] == [None, None, -4, 3] and sorted(r[2] for r in got[:2]) == [2, 3]
    assert [r[0] for r in got] == [0, got[0][2], 5, 6]
    assert {r.doc_id for r in ts.fetch(store, [3, 9]).collect()} == {3}
