import math
import random
from hashlib import sha256

import numpy as np
import pytest

from cohortlab.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def nearest(point, entries):
    far = [sum((a - b) ** 2 for a, b in zip(point, e, strict=True)) for e in entries]
    return far.index(min(far)), min(far)


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(k, [math.floor(4096 * float(x)) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            used = {}
            for _, v, _ in kept:
                used.setdefault(nearest(cut(v)[p], books[p])[0], []).append(cut(v)[p])
            for e, mine in used.items():
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found, totals = [], {}
    for k, v, label in kept:
        best = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        found.append((k, "".join(f"{i:02x}" for i, _ in best), sum(d for _, d in best), label))
        totals[label] = totals.get(label, 0) + found[-1][2]
    digest = sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(k, code, error, totals[label], digest) for k, code, error, label in found]


def vectors(n, dims=16, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.2))) for _ in range(dims)], rnd.choice([0, 1, 2, None])) for i in range(n)]
    return [*rows, (n, rows[5][1], 1), (n + 1, rows[5][1], 1), (5, rows[5][1], rows[5][2])]


def sort(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def test_codes_equal_brute_force(spark):
    rows = vectors(150)
    odd = [(900, None, 1), (901, [None] + [0.1] * 15, 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, None), (None, [0.25] * 16, None), (904, [100.0] * 16, 7), (-1, [0.0] * 16, 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("_label", vc.F.lit("x")).withColumn("v", vc.F.lit(1)).withColumn("code", vc.F.lit(1)).repartition(3)
    assert sort(vc.compress(docs).collect()) == sort(brute(rows + odd))


@pytest.mark.parametrize("n", [1, 3, 16])
def test_few_vectors_and_ties(spark, n):
    rows = [(i, [float(i % 2)] * 8, None) for i in range(n)]
    assert sort(vc.compress(spark.createDataFrame(rows, SCHEMA)).collect()) == sort(brute(rows))


def test_no_usable_vector(spark):
    got = vc.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = vectors(60)
    monkeypatch.setattr(vc, "sized", lambda staged, size: staged)
    assert sort(vc.compress(spark.createDataFrame(rows, SCHEMA)).collect()) == sort(brute(rows))


@pytest.mark.parametrize(("entries", "dims", "radius"), [(16, 8, 1), (16, 8, 10**6), (100, 3, 50), (130, 1, 7), (1, 4, 1)])
def test_slices_find_the_nearest_entry(entries, dims, radius):
    rnd = np.random.default_rng(entries + dims)
    book, points = rnd.integers(-300, 300, (entries, dims)), rnd.integers(-400, 400, (200, dims))
    book[-1] = book[0]
    index, far = vc.Slices(book).nearest(points, radius)
    assert list(zip(index.tolist(), far.tolist(), strict=True)) == [nearest(p, book.tolist()) for p in points.tolist()]


def test_masks_are_the_entries_of_the_cube():
    rnd = np.random.default_rng(1)
    book, points = rnd.integers(-50, 50, (70, 3)), rnd.integers(-50, 50, (40, 3))
    masks = vc.Slices(book).candidates(points, np.full(40, 20))
    for point, words in zip(points, masks, strict=True):
        inside = (np.abs(book - point) <= 20).all(1)
        assert [bool(int(words[e // 64]) >> (e % 64) & 1) for e in range(70)] == inside.tolist()
