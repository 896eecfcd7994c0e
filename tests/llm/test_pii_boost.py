import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import pii_boost as pb
from cohortlab.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


TEXTS = [
    None, "", "no data", "é a@b.c, x.y+z@d-e.f.g. a@b@c.d a@b.c_d@e.f @x.y a@b 🙂q@w.ee", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 378282246310005 1 2 3", "+1 (555) 010-0123 +12 +1(((( +49 30 1234567 ext +123456789012345678",
    "7" * 20_000, "a" * 50_000, "+1" + "(" * 20_000, "1.2." * 3000, "a@b.c " * 400 + "é" + " 1.1.1.1" * 300, "x@y.z",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    secret = F.concat(F.lit("the password="), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 18), F.lit(" and more"))
    return pb.fit(docs.unionByName(spark.range(300).select((F.col("id") + 1_000_000).alias("doc_id"), secret.alias("text"))))


def test_base_spans_against_brute_force(documents, model):
    rows = [*enumerate(TEXTS), (None, "x@y.z"), (12, "x@y.z")]
    found = pb.report(documents(rows), model).collect()
    want = []
    for i, t in rows:
        spans = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *(sum(k == x for k, _, _ in spans) for x in PATTERNS), hashlib.sha256(text.encode()).hexdigest()))
        assert all(r.spans.startswith(text) for r in found if r.doc_id == i and i is not None)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == sorted(want)


def test_added_spans(documents, model):
    rows = [(1, "password=b7db7aa4a5fcc78305 ok"), (2, 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'), (3, "Plain prose, 12 apples and 3 pears; the year 1999."), (4, "mail a@b.cc")]
    got = {r.doc_id: r.spans for r in pb.report(documents(rows), model).collect()}
    assert got[3] == "" and got[4] == "email:5:11"
    for i, secret in ((1, "b7db7aa4a5fcc78305"), (2, "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae")):
        kind, a, b = got[i].split(":")
        assert secret in rows[i - 1][1][int(a) : int(b)]


def test_expression_scores_like_the_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 30, (400, len(pb.FEATURES))).astype(float)
    y = ((x[:, 1] > 12) ^ (x[:, 2] > 20)).astype(float)
    model = pb.train(x, y)
    want = model.start + pb.RATE * sum(pb.evaluate(t, x) for t in model.trees)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    got = {r.i: r.m for r in df.select("i", pb.margin(model, F.col("x")).alias("m")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)
    chosen = want >= model.threshold
    assert y[chosen].mean() > 0.95 and chosen.sum() > 50


def test_without_training_rows_nothing_is_added(documents):
    model = pb.fit(documents([]))
    rows = pb.report(documents([(1, "password=b7db7aa4a5fcc78305 a@b.cc")]), model).collect()
    assert rows[0].spans == "email:28:34"
    assert pb.report(documents([]), model).count() == 0


def test_redact(documents, model):
    docs = documents([(1, "é a@b.cc and 1.2.3.4."), (2, None), (3, "clean")]).withColumnRenamed("source", "pii")
    out = pb.redact(docs, model)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é [EMAIL] and [IP].", 2: None, 3: "clean"}


def test_prefix_sums(spark):
    for n in (0, 1, 128, 129, 1000):
        got = spark.range(1).select(pb.prefix_sums(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")) if n else F.array().cast("array<long>")).alias("s")).first().s
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]
