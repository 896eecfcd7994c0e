"""PII: high-recall span generators, boosted trees over format and context, calibrated redaction.

Four base kinds (email, ip, card, phone) are fixed patterns with format checks
and are always part of the result. Further generators propose many, often
overlapping spans: assigned secrets, long tokens, groups of digits, disguised
addresses. Gradient-boosted trees score every proposal by its format and
context; proposals at or above a calibrated threshold are added unless they overlap a base span.

There are no labels for PII, so the trees learn from weak labels: strict
format rules on a bounded sample of documents. The threshold is the lowest that
keeps the wanted precision on a part of the sample the trees have not seen.

Matching, features and scores are DataFrame expressions on each row: nothing is
shuffled and no text is seen by Python. The small trees are fitted in numpy on
the driver and become CASE expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documents and proposals the trees may be fitted on.
SAMPLE_DOCS = 20_000
SAMPLE_ROWS = 20_000

TREES, DEPTH, RATE, BINS = 12, 3, 0.4, 16
PRECISION = 0.98
# Characters of context on both sides.
CONTEXT = 24

# The contract's patterns. They match the same spans as written there: repetitions that can't
# give back are possessive, and a run of characters is entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

SECRET = (
    r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\x20\"']{0,3}[=:][\x20\"']{0,3}[^\s\"',;]{4,}+"
)
TOKEN = r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+"
NUMBER = r"(?<![0-9])[0-9][0-9\x20().-]{6,}[0-9]"
DISGUISED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9.-]++"
MORE = (("secret", SECRET), ("token", TOKEN), ("number", NUMBER), ("disguised", DISGUISED))
KEYWORDS = r"(?i)(?:password|passwd|pwd|secret|token|key|auth|phone|tel|call|mail|card|account|iban|ssn)"


# --- expressions ----------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(x: Column, block: int = 128) -> Column:
    """Inclusive running sums of an array; blocks keep the work near linear for very long ones."""

    def short(a: Column) -> Column:
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long"))
        return F.aggregate(a, F.array().cast("array<long>"), lambda acc, v: F.concat(acc, F.array(last(acc) + v)))

    def long(a: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(a) / block).cast("int") - 1)
        parts = F.transform(numbers, lambda b: short(F.slice(a, b * block + 1, F.lit(block))))
        ends = lambda p: short(F.transform(p, lambda s: F.element_at(s, -1)))
        return let(
            F.struct(parts.alias("p"), ends(parts).alias("e")),
            lambda s: F.flatten(F.transform(s["p"], lambda part, i: F.transform(part, lambda v: v + F.when(i == 0, 0).otherwise(F.get(s["e"], i - 1))))),
        )

    return F.when(F.size(x) <= block, short(x)).otherwise(long(x))


def spans(text: Column, kind: str, pattern: str, near: str) -> Column:
    """Leftmost non-overlapping matches: (kind, start, end, value, before, after), code points, end exclusive.

    The text between matches gives the places; ``near`` is a cheap test that a text without matches fails.
    """

    def found(s: Column) -> Column:
        ends = prefix_sums(F.transform(s["m"], lambda v, i: (F.length(v) + F.length(F.get(s["p"], i))).cast("long")))
        return let(
            ends,
            lambda e: F.transform(
                s["m"],
                lambda v, i: F.struct(
                    F.lit(kind).alias("kind"), (F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"),
                    F.right(F.get(s["p"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(s["p"], i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>")
    return F.when(text.rlike(near), let(both, lambda s: F.when(F.size(s["m"]) > 0, found(s)).otherwise(empty))).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass the check; other lengths do not."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            one = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            two = F.when(i % 2 == 0, F.when(one > 4, 2 * one - 9).otherwise(2 * one)).otherwise(one)
            return acc + two

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return F.when(F.length(number).between(13, 19), let(number, total) % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid base spans, by kind as listed and then by start."""
    cheap = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
    kinds = zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True)
    passes = lambda kind: lambda s: valid(kind, s["value"])
    return F.concat(*[F.filter(spans(text, k, p, cheap[k]), passes(k)) for k, p in kinds])


def proposals(text: Column) -> Column:
    cheap = {"secret": "[=:]", "token": "[0-9]", "number": "[0-9]", "disguised": r"[(\[] ?at ?[)\]]"}
    return F.concat(*[spans(text, k, p, cheap[k]) for k, p in MORE])


FEATURES = ("kind", "length", "digits", "letters", "upper", "symbols", "distinct", "mixed", "luhn", "keyword", "glued", "plus")


def features(s: Column) -> Column:
    """Format and context of a proposal as numbers, in the order of ``FEATURES``."""
    value, n = s["value"], F.length(s["value"])
    count = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]", ""))
    kind = F.lit(0)
    for i, (name, _) in enumerate(MORE):
        kind = F.when(s["kind"] == name, F.lit(i)).otherwise(kind)
    shape = [
        kind, n, count("0-9"), count("A-Za-z"), count("A-Z"), F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
        F.size(F.array_distinct(F.split(value, ""))), (value.rlike("[0-9][A-Za-z]") | value.rlike("[A-Za-z][0-9]")).cast("int"),
        F.when(s["kind"] == "number", luhn(digits(value))).otherwise(False).cast("int"),
        F.concat(s["before"], value).rlike(KEYWORDS).cast("int"),
        s["before"].rlike("[A-Za-z0-9]$").cast("int"), s["before"].rlike(r"\+[0-9 ]*$").cast("int"),
    ]
    return F.array(*[x.cast("double") for x in shape])


def weak_label(s: Column) -> Column:
    """Strict rules that name some proposals personal data and the others not."""
    value = s["value"]
    tail = F.regexp_extract(value, r"[=:][\x20\"']*(.*)$", 1)
    secret = tail.rlike("[0-9]") & tail.rlike("[A-Za-z]") & (F.length(tail) >= 8)
    token = value.rlike("^AKIA[0-9A-Z]{16}$") | (value.rlike("^[0-9a-f]{32,}$") & value.rlike("[a-f]"))
    number = luhn(digits(value)) | (s["before"].rlike(r"(?i)(?:phone|tel|call|card|account|ssn)[^A-Za-z]*$") & F.length(digits(value)).between(9, 19))
    return (
        F.when(s["kind"] == "secret", secret).when(s["kind"] == "token", token).when(s["kind"] == "number", number).otherwise(value.rlike(r"\.[A-Za-z]{2,}"))
    ).cast("int")


# --- trees ----------------------------------------------------------------


@dataclass
class Node:
    """A split, or a leaf if there is no feature."""

    value: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Model:
    trees: list[Node]
    start: float
    threshold: float


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
    """Regression tree on gradients and hessians, best split over quantile borders."""
    leaf = Node(float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 20:
        return leaf
    top, found = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for at in np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[:-1])):
            low = x[:, f] <= at
            if 5 <= low.sum() <= len(x) - 5:
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - whole
                if gain > top:
                    top, found = gain, (f, float(at), low)
    if found is None:
        return leaf
    f, at, low = found
    return Node(leaf.value, f, at, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


def evaluate(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, evaluate(tree.low, x), evaluate(tree.high, x))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees for the logistic loss. Without rows of both classes nothing is ever selected."""
    if len(x) == 0 or len(set(y.tolist())) < 2:
        return Model([], 0.0, float("inf"))
    aside = np.arange(len(x)) % 4 == 0 if len(x) >= 40 else np.zeros(len(x), bool)
    learn = ~aside if len(set(y[~aside].tolist())) == 2 else np.ones(len(x), bool)
    start = float(np.log((y[learn].mean() + 1e-3) / (1 - y[learn].mean() + 1e-3)))
    model, score = Model([], start, 0.0), np.full(len(x), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x[learn], (y - p)[learn], (p * (1 - p))[learn], DEPTH)
        model.trees.append(tree)
        score = score + RATE * evaluate(tree, x)
    test = aside if len(set(y[aside].tolist())) == 2 else learn
    order = np.argsort(-score[test], kind="stable")
    s, right = score[test][order], np.cumsum(y[test][order])
    last = np.concatenate([s[1:] != s[:-1], [True]])  # equal scores are selected together
    good = np.flatnonzero(last & (right / np.arange(1, len(s) + 1) >= PRECISION))
    if not len(good):
        model.threshold = float("inf")
    else:
        # half way to the next lower score, so a proposal slightly unlike the sample's is still taken
        k = int(good[-1])
        model.threshold = float(s[k] + s[k + 1]) / 2 if k + 1 < len(s) else float(s[k]) - 1e-9
    return model


def margin(model: Model, x: Column) -> Column:
    """The model as an expression over an array of features."""

    def walk(tree: Node) -> Column:
        if tree.feature < 0:
            return F.lit(tree.value)
        return F.when(F.get(x, F.lit(tree.feature)) <= tree.at, walk(tree.low)).otherwise(walk(tree.high))

    total = F.lit(model.start)
    for tree in model.trees:
        total = total + RATE * walk(tree)
    return total


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", docs_wanted: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the ``rows`` proposals with the least hashes in a bounded sample of documents, itself chosen by a hash of the key: the same at every layout."""
    n = docs.count()
    rank = F.pmod(F.xxhash64(F.lit("pii"), F.col(key)), F.lit(1_000_000))
    sample = docs.filter(rank < max(1, round(1_000_000 * min(1.0, docs_wanted / max(1, n))))).filter(F.col(text).isNotNull())
    found = sample.select(F.col(key).alias("k"), F.explode(proposals(F.col(text))).alias("s"))
    found = found.select(F.xxhash64("k", "s.kind", "s.start", "s.value").alias("h"), features(F.col("s")).alias("x"), weak_label(F.col("s")).alias("y"))
    data = sorted(found.orderBy("h", "x", "y").limit(rows).drop("h").collect(), key=lambda r: (r["x"], r["y"]))
    order = np.random.default_rng(3).permutation(len(data))
    x = np.array([data[i]["x"] for i in order]).reshape(len(data), len(FEATURES))
    return train(x, np.array([float(data[i]["y"] or 0) for i in order]))


# --- the operator ---------------------------------------------------------


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_secrets(text: Column, good: Column) -> Column:
    """Selected spans of a text, where each run of overlapping spans with a secret in it is one secret from its first to its last character."""
    places = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["kind"] == "secret").alias("secret")))

    def put(acc: Column, s: Column) -> Column:
        def grown(last: Column) -> Column:
            return F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["secret"] | s["secret"]).alias("secret"))

        last = F.try_element_at(acc, F.lit(-1))
        over = F.coalesce(s["start"] < last["end"], F.lit(False))
        return F.when(over, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown(last)))).otherwise(F.concat(acc, F.array(s)))

    runs = F.aggregate(F.array_sort(places), F.array().cast("array<struct<start:bigint,end:bigint,secret:boolean>>"), put)

    def whole(r: Column) -> Column:
        cut = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
        begin = F.greatest(r["start"] - CONTEXT, F.lit(0))
        return F.struct(
            F.lit("secret").alias("kind"), r["start"].alias("start"), r["end"].alias("end"), cut(r["start"], r["end"]).alias("value"),
            cut(begin, r["start"]).alias("before"), cut(r["end"], r["end"] + CONTEXT).alias("after"),
        )

    def joined_by(secrets: Column) -> Column:
        alone = F.filter(good, lambda s: ~F.exists(secrets, lambda r: (s["start"] < r["end"]) & (r["start"] < s["end"])))
        return F.concat(F.transform(secrets, whole), alone)

    return let(F.filter(runs, lambda r: r["secret"]), joined_by)


def detect(docs: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: (base, added), arrays of spans (kind, start, end, value, before, after).

    Base spans are all there. A proposal is added if its score reaches the
    threshold and it overlaps no base span; added spans that overlap a secret
    become one span with it. Null and empty texts have no spans. A column named ``out`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    with_base = docs.withColumn(out, F.struct(base_spans(whole).alias("base"), proposals(whole).alias("near")))

    def over(s: Column, t: Column) -> Column:
        return (s["start"] < t["end"]) & (t["start"] < s["end"])

    def free(s: Column) -> Column:
        return ~F.exists(F.col(out)["base"], lambda b: over(s, b))

    good = F.filter(F.col(out)["near"], lambda s: free(s) & let(features(s), lambda x: margin(model, x) >= F.lit(model.threshold)))
    kept = F.when(F.exists(good, lambda s: s["kind"] == "secret"), let(good, lambda g: with_secrets(whole, g))).otherwise(good)
    added = kept if model.trees else F.slice(F.col(out)["near"], 1, 0)
    return with_base.withColumn(out, F.struct(F.col(out)["base"].alias("base"), added.alias("added")))


def report(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of every document. Repeated rows give repeated rows."""
    found = detect(docs.select(key, "text"), model)
    base = F.col("pii")["base"]
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        key, *counts, F.sha2(joined(base), 256).alias("base_sha256"),
        F.array_join(F.array_compact(F.array(*[F.nullif(joined(F.col("pii")[x]), F.lit("")) for x in ("base", "added")])), ",").alias("spans"),
    )


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; of overlapping spans the first that begins stays. Null stays null."""
    found = detect(docs, model, text, "_pii")
    every = F.array_sort(F.transform(F.concat(F.col("_pii")["base"], F.col("_pii")["added"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def put(acc: Column, s: Column) -> Column:
        new = F.struct(
            F.concat(acc["done"], F.substring(F.col(text), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("done"),
            s["end"].alias("at"),
        )
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    clean = F.aggregate(every, begin, put, lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"].cast("int") + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size(every) > 0, clean).otherwise(F.col(text))).drop("_pii")
