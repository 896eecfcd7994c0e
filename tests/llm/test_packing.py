import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import packing as pk

LIBRARY = Tokenizer.from_file(pk.TOKENIZER)
TEXTS = [
    "The quick brown fox, jumped.", "", None, "x<|endoftext|>y <|endoftext|>", "don't we'll I'D 1234 ½ ² \x85　 ", "  \n\n a\t b \r\n", "日本語の文章。" * 50,
    "word " * 40_000, "xy" * 50_000, "Ünïcödé, ÄÖ… 3,5. ​\U0001f600", "The quick brown fox, jumped.",
]


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_equal_the_library():
    coder = pk.encoder(pk.TOKENIZER)
    assert coder.fast is not None
    rnd = random.Random(5)
    odd = ["".join(rnd.choice(" \n\t'sTre12.,<|endoftext|>é中́  ") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    for text in [t for t in TEXTS if t] + odd:
        assert coder.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_word_vocabulary_goes_to_the_library():
    path = pk.public_tokenizers.path("word_bpe_49k.json")
    coder = pk.Encoder(path)
    assert coder.fast is None
    assert coder.ids("Hello, World").tolist() == Tokenizer.from_file(path).encode("Hello, World", add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (3000, [(0, 952), (952, 1024), (1976, 1024)])])
def test_only_the_first_piece_is_shorter(n, want):
    assert [(max(0, at), at + 1024 - max(0, at)) for at in pk.cut_points(n, 1024)] == want


def items(bins):
    out = collections.Counter()
    for p, n in bins.items():
        assert n > 0 and pk.fill(p) <= 100
        for size, times in p:
            assert times > 0
            out[size] += times * n
    return out


def plain_best_fit(loose, capacity):
    """Best fit decreasing, item by item."""
    room = []
    for size in sorted(collections.Counter(loose).elements(), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= size
        else:
            room.append(capacity - size)
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_grouped_best_fit_equals_item_by_item(seed):
    rnd = random.Random(seed)
    loose = {rnd.randint(1, 99): rnd.randint(1, 30) for _ in range(rnd.randint(1, 40))}
    bins = pk.best_fit({}, loose, 100)
    assert items(bins) == collections.Counter(loose)
    assert sorted(100 - pk.fill(p) for p, n in bins.items() for _ in range(n)) == plain_best_fit(loose, 100)


@pytest.mark.parametrize("seed", range(8))
def test_operators_keep_every_item(seed):
    rng = random.Random(seed)
    loose = {rng.randint(1, 99): rng.randint(1, 50) for _ in range(30)}
    a = pk.best_fit({}, loose, 100)
    b = pk.mutate(a, 100, rng)
    for _ in range(20):
        a, b = b, pk.crossover(a, b, 100, rng)
        assert items(b) == collections.Counter(loose)
        assert items(pk.mutate(b, 100, rng)) == collections.Counter(loose)


def test_islands_beat_best_fit(spark):
    counts = {44: 2, 24: 4, 22: 2, 21: 2, 17: 4, 8: 4, 6: 2, 30: 2, 12: 2, 35: 2, 27: 1}
    start, found = pk.best_fit({}, counts, 61), pk.plan(spark, counts, 61, islands=3, epochs=2, generations=60)
    assert pk.fitness(found) <= pk.fitness(start)
    total = collections.Counter()
    for p, n in found.items():
        assert pk.fill(p) <= 61
        for size, times in p:
            total[size] += times * n
    assert total == collections.Counter(counts)


def check(rows, texts):
    """Every document is there once, whole; sequences are gapless."""
    spots, found = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        spots[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for mine in spots.values():
        end = 0
        for at, n in sorted(mine):
            assert at == end and n > 0
            end += n
        assert end <= 1024
    for key, want in texts.items():
        ids = np.array(library(want), "<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        ends = [*starts[1:], len(ids)]
        assert sorted(found[key]) == [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert set(found) == set(texts)
    return len(spots)


def test_packing_of_documents(spark, documents):
    texts = {10 - k: t for k, t in enumerate(TEXTS)} | {None: "without id", 50: "a b c"}
    docs = documents(list(texts.items())).withColumn("_rank", pk.F.lit(1)).withColumn("offset", pk.F.lit("x")).repartition(3)
    cut, places = pk.pack(docs, islands=2, epochs=1, generations=5)
    rows = places.collect()
    n = check(rows, texts)
    lengths = collections.Counter(r.length for r in rows)
    assert n <= len(plain_best_fit(lengths, 1024))
    told = pk.sequences(cut.filter("doc_id IS NOT NULL"), places).collect()
    assert all(len(s.ids) == 4 * s.length for s in told)


def test_repeated_rows_and_empty_table(spark, documents):
    rows = [(1, "same"), (1, "same"), (1, "other"), (2, "same")]
    _, places = pk.pack(documents(rows))
    got = places.collect()
    assert len(got) == 4 and {(r.sequence_id, r.offset) for r in got} == {(0, 0), (0, 2), (0, 4), (0, 6)}
    assert pk.pack(documents([]))[1].count() == 0


def test_whole_table_is_packed_tightly(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pk.pack(docs)[1].collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
