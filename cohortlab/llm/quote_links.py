"""Quotation linking: quoted passages lead to the messages they come from.

Lines that begin with ``>`` are quoted, one level per mark. Runs of lines of one
level are passages. Normalised lines and whole passages are hashed and joined
to the hashed lines and paragraphs that messages say themselves. All messages that
say one of the rarest lines of a passage are candidates (of the rarest ones, so many that
without them less than half of the passage is left), and the other lines are verified. A passage
belongs to the message that holds most of its characters, if that is half of
them or more; among equals to the nearest earlier message of the same conversation,
else to the first one of another conversation. A conversation's id is no time, so quotes may lead to
larger ids; inside a conversation only earlier turns are quoted.

Conversations that quote one another form one thread. Its messages are
ordered by reply depth, found by pointer jumping, so each comes after the one it
replies to; quotes are left out of their texts. Where replies form a cycle,
its smallest message (conversation, turn) replies to nothing.

Only DataFrame expressions. Equal passages and equal messages are one before they are
joined, so a common line costs one row per different message that says it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import stage
from cohortlab.llm.components import components
from cohortlab.scale import row_numbers

# Share of a passage's characters that its source must hold.
HELD = 0.5

MARKS = r"^[ \t>]*>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, pos, level, body) of every line; level 0 is the message's own."""
    line = messages.select("conv", "turn", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    return line.select(
        "conv", "turn", "row", "pos",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.trim(F.substr("line", F.length(marks) + 1)).alias("body"),
    )


def units(lines: DataFrame) -> DataFrame:
    """Hashed lines and passages: (conv, turn, row, level, run, whole, code, chars).

    A run is a passage: lines of one level next to each other, of level 0 up to a blank line.
    """
    filled = lines.withColumn("norm", normalised(F.col("body")))
    own = (F.col("level") > 0) | (F.col("norm") != "")
    message = Window.partitionBy("conv", "turn", "row", "level").orderBy("pos")
    runs = filled.filter(own).withColumn("run", F.col("pos") - F.row_number().over(message)).filter("norm <> ''")
    whole = runs.groupBy("conv", "turn", "row", "level", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ").alias("norm"),
        F.count(F.lit(1)).alias("n"),
    )
    shape = ["conv", "turn", "row", "level", "run"]
    each = runs.select(*shape, F.lit(False).alias("whole"), "norm")
    more = whole.filter("n > 1").select(*shape, F.lit(True).alias("whole"), "norm")
    return each.unionByName(more).select(*shape, "whole", F.xxhash64("norm").alias("code"), F.length("norm").alias("chars"))


def sources(passages: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (p, m): different messages ``m`` that hold most of a different passage ``p``; and (p, code), the hashes that led to them."""
    parts = stage(
        passages.dropDuplicates(["p"]).select("p", "all", F.explode(F.concat("lines", F.array(F.struct(F.col("full").alias("code"), F.col("all").alias("chars"), F.lit(True).alias("whole"))))).alias("u"))
        .select("p", "all", "u.*").filter("code IS NOT NULL"), "passage-parts",
    )
    texts = stage(messages.dropDuplicates(["m"]).select("m", F.explode("codes").alias("code")), "message-codes")
    often = texts.groupBy("code").agg(F.count(F.lit(1)).alias("often"))
    # a message with half of the passage has one of its rarest lines: those after them hold less than half
    rest = Window.partitionBy("p").orderBy(F.desc("often"), "code")
    ranked = parts.join(often, "code").withColumn("rest", F.sum(F.when(~F.col("whole"), F.col("chars")).otherwise(0)).over(rest))
    keys = stage(ranked.filter(F.col("whole") | (F.col("rest") >= HELD * F.col("all"))).select("p", "code").distinct(), "passage-keys")

    tried = keys.join(texts, "code").select("p", "m").distinct()
    held = (
        tried.join(parts, "p").join(texts, ["m", "code"])
        .groupBy("p", "m", "all")
        .agg(F.coalesce(F.sum(F.when(~F.col("whole"), F.col("chars"))), F.lit(0)).alias("some"), F.max(F.when(F.col("whole"), F.col("chars"))).alias("full"))
        .select("p", "m", F.greatest("some", F.coalesce("full", F.lit(0))).alias("held"), "all")
        .filter(F.col("held") >= HELD * F.col("all"))
    )
    held = stage(held, "passage-holders")
    most = held.groupBy("p").agg(F.max("held").alias("held"))
    return stage(held.join(most, ["p", "held"]).select("p", "m"), "passage-sources"), keys


def smallest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows of each value of ``by`` with the smallest (conv, row)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("conv", "row"))).filter(F.col("_n") <= n).drop("_n")


def links(found: DataFrame) -> DataFrame:
    """(conv, turn, row, level, run, chars, to_conv, to_turn, to_row) of every quoted passage; null targets if its source is unknown."""
    passage = ["conv", "turn", "row", "level", "run"]
    quoted = found.filter("level > 0")
    line = F.struct("code", "chars", F.lit(False).alias("whole"))
    passages = quoted.groupBy(*passage).agg(
        F.sum(F.when(~F.col("whole"), F.col("chars"))).alias("all"),
        F.array_sort(F.collect_list(F.when(~F.col("whole"), line))).alias("lines"),
        F.max(F.when(F.col("whole"), F.col("code"))).alias("full"),
    )
    passages = stage(passages.withColumn("p", F.xxhash64("lines", "full")), "passages")
    own = found.filter("level = 0").join(quoted.select("code").distinct(), "code", "left_semi")
    messages = own.groupBy("conv", "turn", "row").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    messages = stage(messages.withColumn("m", F.xxhash64("codes")), "sayings")
    best, keys = sources(passages, messages)

    # of each message and passage the first of two conversations: one may be the quote's own
    first = smallest(messages.groupBy("m", "conv").agg(F.min("row").alias("row"), F.min("turn").alias("turn")), "m", 2)
    first = best.join(first, "m").groupBy("p", "conv").agg(F.min("row").alias("row"), F.min("turn").alias("turn"))
    first = smallest(first, "p", 2).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("conv", "turn", "row"))).alias("firsts"))

    said = messages.select("conv", "turn", "row", "m", F.explode("codes").alias("code"))
    here = passages.select("conv", "p").distinct().join(keys, "p").join(said, ["conv", "code"])
    here = here.select("conv", "p", "m", "turn", "row").distinct().join(best, ["p", "m"], "left_semi").select("conv", "p", "turn", "row", F.lit(0).alias("level"))
    # quotes stand before own lines of the same turn, so a message is not its own source
    before = Window.partitionBy("conv", "p").orderBy("turn", F.desc("level"), "row").rowsBetween(Window.unboundedPreceding, -1)
    near = (
        passages.select("p", *passage, "all").unionByName(here, allowMissingColumns=True)
        .withColumn("near", F.last(F.when(F.col("level") == 0, F.struct("conv", "turn", "row")), ignorenulls=True).over(before))
        .filter("level > 0")
    )
    far = F.get(F.filter("firsts", lambda x: x["conv"] != F.col("conv")), F.lit(0))
    to = F.coalesce("near", far)
    return near.join(first, "p", "left").select(
        *passage, F.col("all").alias("chars"), to["conv"].alias("to_conv"), to["turn"].alias("to_turn"), to["row"].alias("to_row")
    )


def jumped(nodes: DataFrame) -> DataFrame:
    """(node, to, steps, least) of the table (node, parent) after enough jumps.

    ``to`` is null if a first message was reached, in ``steps`` steps. Else the
    node leads to a cycle: the values of ``to`` are all nodes of cycles then, and
    ``least`` of those is the smallest of their cycle. A round doubles the jumps.
    """
    at = stage(nodes.select("node", F.col("parent").alias("to"), F.col("parent").isNotNull().cast("long").alias("steps"), F.col("node").alias("least")), "jumps")
    seen = None
    while True:
        unsettled = at.filter("to IS NOT NULL")
        now = tuple(unsettled.agg(F.count(F.lit(1)), F.sum(F.xxhash64("least").cast("decimal(38,0)")), F.count_distinct("to")).first())
        if now[0] == 0 or now == seen:
            return at
        seen = now
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
        at = at.join(ahead, "to", "left").select(
            "node", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("least", "_least").alias("least")
        )
        at = stage(at, "jumps")


def depths(nodes: DataFrame) -> DataFrame:
    """(node, depth, cut): replies from the first message of the thread; ``cut`` nodes reply to nothing, as a cycle is broken there."""
    at = jumped(nodes)
    ring = at.filter("to IS NOT NULL").select(F.col("to").alias("node")).distinct()
    cut = stage(at.join(ring, "node", "left_semi").filter("node = least").select("node", F.lit(True).alias("cut")), "cuts")
    if not cut.isEmpty():
        at = jumped(nodes.join(cut, "node", "left").select("node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")))
    return at.join(cut, "node", "left").select("node", F.col("steps").alias("depth"), F.coalesce("cut", F.lit(False)).alias("cut"))


def threads(conversations: DataFrame) -> DataFrame:
    """One row per message: its thread, place in it, the message it replies to, and its text without quotes.

    Columns: conv_id, turn, role, thread_id, position (from 1), parent_conv and
    parent_turn (the message with most characters among the sources of its
    quotes of level 1, among equals one of the same conversation, then the later turn, then
    the larger conversation; without one the message before it; null for a first message and
    where a cycle is broken),
    n_quotes, n_linked, text. ``thread_id`` is the smallest conv_id joined by
    quotes. A null or empty text, or one of quotes alone, is an
    empty text. Messages without a conversation or turn are left out, as they
    have no place. Extra columns are left out. Repeated rows are messages of their own, next to each other.
    """
    rows = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    # a number per conversation; equal rows are told apart by it
    rows = stage(row_numbers(rows, ["turn", F.coalesce("role", F.lit("")), F.xxhash64("text")], "row", ["conv"]), "messages")
    lines = parsed(rows.filter(F.col("text") != ""))
    found = stage(units(lines), "units")
    linked = stage(links(found), "quotes")

    counts = linked.groupBy("conv", "row").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("to_conv").alias("n_linked"))
    votes = linked.filter("level = 1 AND to_conv IS NOT NULL").groupBy("conv", "row", "to_conv", "to_turn", "to_row").agg(F.sum("chars").alias("chars"))
    same = (F.col("to_conv") == F.col("conv")).cast("int").alias("same")
    source = votes.groupBy("conv", "row").agg(F.max(F.struct("chars", same, "to_turn", "to_conv", "to_row")).alias("s"))
    before = rows.select("conv", (F.col("row") + 1).alias("row"), F.struct("conv", "turn", "row").alias("before"))
    parents = (
        rows.select("conv", "turn", "row").join(source, ["conv", "row"], "left").join(before, ["conv", "row"], "left")
        .withColumn("parent", F.coalesce(F.when(F.col("s").isNotNull(), F.struct(F.col("s.to_conv").alias("conv"), F.col("s.to_turn").alias("turn"), F.col("s.to_row").alias("row"))), "before"))
        .select("conv", "row", "parent")
    )
    parents = stage(parents, "parents")
    joined = stage(components(linked.filter("to_conv <> conv").select(F.col("conv").alias("a"), F.col("to_conv").alias("b"))), "threads").withColumnRenamed("node", "conv")
    quoteless = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(MARKS)), "\n")
    return (
        rows.join(counts, ["conv", "row"], "left")
        .join(parents, ["conv", "row"], "left")
        .join(places(parents, joined), ["conv", "row"], "left")
        .withColumn("parent", F.when(~F.coalesce("cut", F.lit(False)), F.col("parent")))
        .select(
            F.col("conv").alias("conv_id"), "turn", "role",
            F.coalesce("component", "conv").alias("thread_id"),
            F.coalesce("place", "row").alias("position"),
            F.col("parent.conv").alias("parent_conv"),
            F.col("parent.turn").alias("parent_turn"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.trim(quoteless, F.lit(" \t\r\n")).alias("text"),
        )
    )


def places(parents: DataFrame, joined: DataFrame) -> DataFrame:
    """(conv, row, component, place, cut) of the messages of joined conversations; others keep the order of their turns."""
    inside = stage(parents.join(joined, "conv").select("conv", "row", "component", F.struct("conv", "row").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("parent.conv", "parent.row")).alias("parent")), "joined")
    deep = inside.join(depths(inside.select("node", "parent")), "node").select("conv", "row", "component", "depth", "cut")
    return row_numbers(deep, ["depth", "conv", "row"], "place", ["component"]).select("conv", "row", "component", "place", "cut")


def formatted(threads: DataFrame) -> DataFrame:
    """(thread_id, position, block): each message as a role-marked block, ready to be written in order."""
    return threads.select("thread_id", "position", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n")).alias("block"))
