import zlib
from hashlib import sha256

import pytest

from cohortlab.llm import merkle
from cohortlab.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(leaves, arity):
    """Root and, per leaf, the (place, siblings) of every level, node by node."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
            at[k] = i // arity
        level = [h(*r) for r in runs]
    return level[0], paths


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, path) of every row."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(((r[0], leaf_of(*r)) for r in rows if r[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((mine, *tree([d for _, d in mine], arity)))
    root, tops = tree([t[1] for t in trees], arity)
    return root, [
        (doc_id, digest, sub, root, path + top)
        for (mine, sub, paths), top in zip(trees, tops, strict=True)
        for (doc_id, digest), path in zip(mine, paths, strict=True)
    ]


def as_text(path):
    return ",".join(f"{at}:{''.join(others)}" for at, others in path)


ROWS = (
    [(i, f"text {i}", "en", "a", i) for i in range(300)]
    + [(i, "é" * (i % 7), "fr", None, None) for i in range(300, 317)]
    + [(400, None, None, None, None), (401, "", "", "", 0), (402, "x" * 100_000, "zz", "s", 3), (402, "x" * 100_000, "zz", "s", 3)]
    + [(None, "no id", "fr", "b", 1), (-5, "negative", "fr", "b", 1), (7, "same id", "en", "b", 1)]
)


@pytest.mark.parametrize(("arity", "height"), [(2, 7), (3, 2)])
def test_manifest_equals_brute_force(spark, arity, height):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("leaf", merkle.F.lit(1)).withColumn("pos", merkle.F.lit("clash")).repartition(3)
    root, want = brute(ROWS, arity)
    got = merkle.manifest(docs, arity, height).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*w[:4], as_text(w[4])) for w in want), key=key)
    assert {merkle.folded(r.leaf, r.path) for r in got} == {root}


@pytest.mark.parametrize("n", [0, 1, 3, 129])
def test_sizes_around_a_block(spark, n):
    rows = ROWS[:n]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)[1] if rows else []
    assert sorted(tuple(r) for r in got) == sorted((*w[:4], as_text(w[4])) for w in want)


def test_query_finds_the_tampered_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path)).collect()
    root, want = brute(ROWS)
    proofs = sorted(h(*[d for _, others in w[4] for d in others]) for w in want)
    assert sorted(r.proof_sha256 for r in got) == proofs
    by_leaf = {leaf_of(*r): r for r in ROWS}
    paths = {w[1]: w[4] for w in want}
    assert len(got) == len(ROWS)
    for r in got:
        row = by_leaf[r.leaf]
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
        digest = leaf_of(*row[:4], row[4] + 1) if changed else r.leaf
        if row[0] != 402:
            for at, others in paths[r.leaf]:
                digest = h(*others[:at], digest, *others[at:])
            assert r.folded_root == digest
        assert r.root == root and r.verified == (not changed)


def test_verify_names_changed_documents(spark):
    docs = spark.createDataFrame(ROWS[:40], SCHEMA)
    claimed = merkle.manifest(docs)
    changed = docs.withColumn("text", merkle.F.when(merkle.F.col("doc_id") == 3, "other").otherwise(merkle.F.col("text")))
    more = changed.unionByName(spark.createDataFrame([(99, "new", "en", "a", 3)], SCHEMA))
    assert {r.doc_id for r in merkle.verify(more, claimed).filter("NOT verified").collect()} == {3, 99}
