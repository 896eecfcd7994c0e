import re
from collections import Counter

from cohortlab.llm import adaptive_rules as ar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [
    None, "", "   \n\n", "a b c a b c", "é é é é", "one\ntwo\none\n one\n\n", "x y z\x0bq", "#$ | <a> & 5%*", "a a a", "a b", "1\r\n2\r\n1\r\n",
    "w " * 100, "p q r\n" * 50, " ".join(f"t{i}" for i in range(20_000)),
]


def test_counts_against_brute_force():
    found = ar.measure(TEXTS)
    for i, t in enumerate(TEXTS):
        got = tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute(t), (i, t)
    assert all(len(v) == 0 for v in ar.measure([]).values())


def prose(k, n=80):
    return " ".join(f"word{(k * 7919 + i * i) % 9973}" for i in range(n)) + "."


def test_verdicts_and_thresholds(documents):
    good = [(k, prose(k)) for k in range(300)]
    bad = [(1000, " ".join(["###"] + [f"w{i}$$" for i in range(80)])), (1001, "short"), (1002, None), (1003, "go on now " * 40), (1001, "short")]
    found = ar.verdicts(documents(good + bad)).collect()
    assert len(found) == 305
    by = {r.doc_id: r for r in found}
    assert all(by[k].kept for k in range(300))
    assert by[1000].base_failed is False and by[1000].kept is False and "symbol_ratio" in by[1000].reasons
    assert all(by[k].base_failed and not by[k].kept for k in (1001, 1002, 1003))


def test_null_groups_and_empty_tables(documents):
    docs = documents([(k, prose(k)) for k in range(5)], lang=None, source=None)
    assert all(r.kept for r in ar.verdicts(docs).collect())
    assert ar.verdicts(documents([])).count() == 0
    assert [r.kept for r in ar.verdicts(documents([(1, None)])).collect()] == [False]


def test_keep_returns_the_columns_it_was_given(documents):
    docs = documents([(1, prose(1)), (2, ""), (1, prose(1))]).withColumnRenamed("n_chars", "kept")
    out = ar.keep(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 1] and out.first().kept == len(prose(1))


def test_sketches_merge_like_one_sketch(documents):
    docs = documents([(k, prose(k, 60 + k)) for k in range(40)])
    one = ar.sketches(ar.score(docs.repartition(1))).groupBy("measure", "bucket").sum("n")
    many = ar.sketches(ar.score(docs.repartition(7))).groupBy("measure", "bucket").sum("n")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_sketch_quantiles_are_close(documents):
    import numpy as np
    from pyspark.sql import functions as F

    scored = ar.score(documents([(k, prose(k, 60 + 3 * k)) for k in range(60)]))
    row = ar.limits(ar.sketches(scored), ["lang"]).select(F.col("limits")["word_length"].alias("l")).first().l
    values = np.array([r.v for r in scored.select(ar.ratios()["word_length"].alias("v")).collect()])
    mid, hi = np.quantile(values, 0.5), np.quantile(values, ar.OUTER)
    assert abs(row.high - (mid + max(ar.SPREAD * (hi - mid), ar.MEASURES["word_length"][1]))) < 0.3
