import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, size=10):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add("null" if name is None else str(name))
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (10, "Short item é"), (2, ""), (3, None), (4, "!!!"), (2, "alpha beta"), (None, "gamma delta"), (1, LONG)]
DOCS = [
    (1, "start " + " ".join(f"W{i}," for i in range(5, 20)) + " end"), (2, None), (3, ""), (4, "?!"), (5, "short ITEM é."), (6, "w1 w2 w3"),
    (7, ("filler " * 3000) + LONG + (" filler" * 3000)), (8, "alpha, beta gamma delta alpha"), (8, "alpha, beta gamma delta alpha"), (None, LONG), (9, LONG + " " + LONG),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, documents, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.scan(documents(DOCS).select("doc_id", "text"), bench, block_bytes=block_bytes).collect()
    got = sorted((str(r.doc_id), r.n_words, len(r.hit_words), len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest()) for r in found)
    assert got == sorted((str(i), *brute(t, ITEMS)[:4]) for i, t in DOCS)


def test_report_on_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.report(documents([]), none).count() == 0
    row = dc.report(documents([(1, "a b")]), none).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_remove_cuts_spans_and_drops_mostly_copied(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(DOCS).withColumnRenamed("source", "hit_words")
    out = {r.doc_id: r for r in dc.remove(docs, bench).collect()}
    assert dc.remove(docs, bench).columns == docs.columns
    assert set(out) == {2, 3, 4, 6, 7}  # texts without words and clean ones stay, mostly copied ones go
    assert out[2].text is None and out[6].text == "w1 w2 w3" and out[6].hit_words == "s"
    assert "w1" not in out[7].text and out[7].text.count("filler") == 6000 and out[7].n_chars == len(out[7].text)


def test_cut_keeps_everything_else():
    text = "Aé, b! C–d  e"
    assert dc.cut(text, [1]) == "Aé, ! C–d  e"
    assert dc.cut("one two three four", [1, 2]) == "one  four"


def test_long_items_come_in_pieces_one_index_at_a_time(spark, documents, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(words) for _ in range(5_000)]
    items = [("long", " ".join(passage)), ("long", " ".join(passage)), ("short", "Only three words"), (None, " ".join(passage[40:70])), ("none", None)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = documents([(i, " ".join(passage[at : at + n])) for i, (at, n) in enumerate([(0, 12), (4_990, 10), (4_991, 9), (44, 30), (3_000, 500)])] + [(9, "x only THREE words y"), (10, None)])
    whole = dc.report(docs, benchmark).collect()
    live, most = set(), []
    plain = dc.build

    def counted(items, size):
        index = plain(items, size)
        live.add(id(index))
        most.append(sum(len(t or "") for _, t in items))
        return index

    monkeypatch.setattr(dc, "build", counted)
    cut = dc.scan(docs.select("doc_id", "text"), benchmark, block_bytes=4_000).collect()
    assert len(most) > 10 and max(most) < 12_000
    assert {r.doc_id: (r.n_words, len(r.hit_words), len(r.items)) for r in cut} == {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in whole}
    assert {r.doc_id: r.n_hit for r in whole} == {0: 12, 1: 10, 2: 0, 3: 30, 4: 500, 9: 3, 10: 0}


def test_clashing_names(spark, documents):
    benchmark = spark.createDataFrame([("a", "one two three"), ("b", "four five six " * 40)], "item_id string, text string")
    docs = documents([(1, "zero one two three four and more words to keep it")])
    for name in ("_scan_text", "_scan_items", "_row", "hit_words"):
        docs = docs.withColumn(name, F.lit(7))
    (got,) = dc.remove(docs, benchmark).collect()
    assert got._scan_text == got._scan_items == got._row == got.hit_words == 7 and "two" not in got.text
    (got,) = dc.scan(docs, benchmark, block_bytes=100).collect()
    assert got._row == 7 and got["items"] == ["a"]
