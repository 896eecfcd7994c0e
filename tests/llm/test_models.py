"""Language identification and the quality classifier: held-out accuracy and edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import language_id as li
from cohortlab.llm import quality_nbsvm as nb
from cohortlab.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
EDGES = [(900001, None), (900002, ""), (900003, "1234 !? 5"), (900004, "x"), (900005, "the and " * 40_000), (None, "the and of"), (900004, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def language(docs):
    return li.fit(docs.filter(~held_out()), rows=150)


def test_held_out_is_crc32_of_the_id(docs):
    import zlib

    got = {r.doc_id: r.h for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.items())


def test_language_accuracy_on_held_out_rows(docs, language):
    found = li.predict(docs.filter(held_out()).select("lang", "text"), language).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_rows(documents, language):
    out = li.predict(documents(EDGES).withColumnRenamed("source", "score").select("doc_id", "text", "score"), language)
    rows = out.collect()
    assert len(rows) == len(EDGES) and out.columns == ["doc_id", "lang_pred", "score", "rejected"]
    by = {r.doc_id: r for r in rows}
    for i in (900001, 900002, 900003):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[900004].lang_pred in language.labels and by[900005].lang_pred == "en"


def test_language_without_training_rows(documents):
    none = li.fit(documents([]))
    assert none is None
    assert [r.lang_pred for r in li.predict(documents([(1, "a")]), none).collect()] == ["und"]
    assert li.predict(documents([]), none).count() == 0


def test_language_scores_match_a_plain_sum(language):
    texts = ["Hello the world", "ß und", "a"]
    for text, row in zip(texts, language.scores(texts), strict=True):
        at, share = li.featurise(text)
        assert np.allclose(row, li.softmax((share @ language.logits[at] + language.bias) / language.temperature), atol=1e-4)


def test_quality_accuracy_and_edges(spark, docs, documents):
    labels = table(spark, SF, "labels")
    learn = docs.join(labels.filter(~held_out()).select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality")
    model = nb.fit(learn, rows=300)
    test = nb.predict(docs.join(labels.filter(held_out()).select("doc_id", "quality"), "doc_id").select("quality", "text"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in test]) > 0.95
    edge = nb.predict(documents(EDGES), model).collect()
    assert len(edge) == len(EDGES) and all(0 < r.score < 1 for r in edge)
    assert len({r.score for r in edge if r.doc_id in (900001, 900002)}) == 1
    assert nb.predict(documents([]), model).count() == 0


def test_quality_with_one_class_or_none(documents):
    one = nb.fit(documents([(1, "a b"), (2, "c")]).withColumn("quality", F.lit(1)))
    assert one.score(nb.features("zzz")) > 0.9
    zero = nb.fit(documents([]).withColumn("quality", F.lit(1)))
    assert 0 < zero.score(nb.features(None)) < 1


def test_dual_coordinate_descent_reaches_the_optimum():
    """The dual solution meets the optimality conditions of the hinge loss."""
    rng = random.Random(5)
    rows = [np.unique(np.array(rng.sample(range(40), 8), np.int32)) for _ in range(60)]
    y = np.array([1.0 if 3 in set(r.tolist()) or rng.random() < 0.2 else -1.0 for r in rows])
    r, cost = np.ones(nb.BUCKETS, np.float32), np.full(60, 0.5)
    saved, nb.PASSES = nb.PASSES, 400
    try:
        w, b = nb.descend(rows, y, r, cost)
    finally:
        nb.PASSES = saved
    loss = lambda w, b: (w @ w + b * b) / 2 + sum(c * max(0, 1 - t * (w[x].sum() / np.sqrt(len(x)) + b)) for x, t, c in zip(rows, y, cost))  # noqa: E731, B905
    at = loss(w, b)
    for _ in range(200):
        step = np.zeros(nb.BUCKETS)
        step[rng.randrange(40)] = rng.uniform(-0.05, 0.05)
        assert loss(w + step, b + rng.uniform(-0.02, 0.02)) >= at - 1e-3
