"""Long values are spans as a whole."""

from pyspark.sql import functions as F
from test_pii_boost import model  # noqa: F401

from cohortlab.llm import pii_boost as pb


def test_long_secrets(documents, model):  # noqa: F811
    key = "b7db7aa4a5fcc78305" * 20
    rows = [(1, f"the password={key} and more"), (2, f"my_token={key} x"), (3, f"the password={key}")]
    for r in pb.report(documents(rows), model).collect():
        text = dict(rows)[r.doc_id]
        kind, a, b = r.spans.split(":")
        assert key in text[int(a) : int(b)], r
    assert all(key[-8:] not in r.text for r in pb.redact(documents(rows), model).collect())


def test_overlapping_spans_become_one_secret(spark):
    text = "ab token=123 456 7890123 cd"
    near = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"
    cut = lambda k, a, b: F.struct(F.lit(k).alias("kind"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(text[a:b]).alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))
    good = F.array(cut("secret", 3, 12), cut("token", 0, 2), cut("number", 9, 24)).cast(near)
    got = spark.range(1).select(pb.with_secrets(F.lit(text), good).alias("s")).first().s
    assert [(s.kind, s.start, s.end, s.value) for s in got] == [("secret", 3, 24, text[3:24]), ("token", 0, 2, "ab")]


def test_long_disguised_address(documents):
    text = "x" * 100 + " (at) host.example"
    got = documents([(1, text)]).select(F.filter(pb.proposals(F.col("text")), lambda s: s["kind"] == "disguised").alias("s")).first().s
    assert [(s.start, s.end) for s in got] == [(0, len(text))]


def test_long_group_of_digits_is_one_proposal(documents):
    text = "id 1" + "234 5678 9" * 8 + "0 end"
    got = documents([(1, text)]).select(F.filter(pb.proposals(F.col("text")), lambda s: s["kind"] == "number").alias("s")).first().s
    assert [text[s.start : s.end] for s in got] == [text[3:-4]]
    text = "1" + " " * 50_000 + "x" + "7-" * 50_000
    got = documents([(1, text)]).select(F.filter(pb.proposals(F.col("text")), lambda s: s["kind"] == "number").alias("s")).first().s
    assert [(s.start, s.end) for s in got] == [(50_002, len(text) - 1)]


def test_model_does_not_depend_on_the_layout(documents):
    docs = documents([(i, f"call +44 20 7946 {i:04d} or card 4111 1111 1111 {1000 + i}, token={i * 7919:020d}a") for i in range(120)])
    assert pb.fit(docs.repartition(7), rows=100) == pb.fit(docs.coalesce(1), rows=100)
