import random

from cohortlab.llm import quote_links as ql

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there, how are you doing today?\nSecond paragraph goes here."),
    (1, 1, "assistant", "> Hello there, how are you\n> doing today?\n\nI am fine thanks."),
    (1, 2, "user", "Unrelated remark about cats."),
    (1, 3, "assistant", ">> Hello there, how are you doing today?\n> I am fine thanks.\nGreat to hear."),
    (1, 4, None, "> I AM fine, thanks\n> unrelated remark about cats!!\nBoth."),
    (2, 0, "user", "> Great to hear.\nJoining from elsewhere."),
    (2, 1, "assistant", None),
    (3, 0, "user", "> never said by anyone\nOk"),
    (3, None, "user", "x"), (None, 1, "user", "y"), (3, 1, "user", ""), (3, 1, "user", ""),
]


def told(spark, rows):
    return {(r.conv_id, r.turn, r.position): r for r in ql.threads(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_links_threads_and_order(spark):
    got = told(spark, ROWS)
    shown = {k[:2]: (r.thread_id, r.position, r.parent_conv, r.parent_turn, r.n_quotes, r.n_linked, r.text) for k, r in got.items() if k[0] != 3}
    assert shown == {
        (1, 0): (1, 1, None, None, 0, 0, "Hello there, how are you doing today?\nSecond paragraph goes here."),
        (1, 1): (1, 2, 1, 0, 1, 1, "I am fine thanks."),
        (1, 2): (1, 3, 1, 1, 0, 0, "Unrelated remark about cats."),
        (1, 3): (1, 4, 1, 1, 2, 2, "Great to hear."),
        (1, 4): (1, 5, 1, 2, 1, 1, "Both."),
        (2, 0): (1, 6, 1, 3, 1, 1, "Joining from elsewhere."),
        (2, 1): (1, 7, 2, 0, 0, 0, ""),
    }
    assert sorted((r.position, r.parent_turn, r.n_quotes, r.n_linked) for k, r in got.items() if k[0] == 3) == [(1, None, 1, 0), (2, 0, 0, 0), (3, 1, 0, 0)]
    assert len(got) == 10


def test_every_reply_comes_after_its_parent(spark):
    got = told(spark, ROWS)
    place = {}
    for (c, t, p), _ in got.items():
        place[c, t] = min(p, place.get((c, t), p))
    assert all(place[r.parent_conv, r.parent_turn] < r.position or (r.parent_conv, r.parent_turn) == (r.conv_id, r.turn) for r in got.values() if r.parent_conv)


def test_brute_force_over_generated_mail(spark):
    """Each reply quotes one known message whole; the link must find exactly it."""
    rows, want = [], {}
    for c in range(30):
        for t in range(6):
            body = f"message {c} {t} says thing{c * 31 + t}\nand more from {c} at {t}"
            if t:
                to = (c * 7 + t * 3) % t
                quoted = "\n".join("> " + x for x in f"message {c} {to} says thing{c * 31 + to}\nand more from {c} at {to}".split("\n"))
                want[c, t], body = (c, to), quoted + "\n" + body
            rows.append((c, t, "user", body))
    got = told(spark, rows)
    assert {(c, t): (r.parent_conv, r.parent_turn) for (c, t, _), r in got.items() if t} == want
    assert all(">" not in r.text and r.position == r.turn + 1 for r in got.values())


def test_marks_without_end_and_a_very_long_message(spark):
    rows = [(1, 0, "user", ">" * 50_000), (1, 1, "user", "word " * 50_000), (1, 2, "user", "> " + "word " * 50_000)]
    got = told(spark, rows)
    assert got[1, 0, 1].text == "" and (got[1, 2, 3].parent_turn, got[1, 2, 3].n_linked) == (1, 1)


def test_empty_table_and_blocks(spark):
    assert told(spark, []) == {}
    rows = ql.formatted(ql.threads(spark.createDataFrame(ROWS, SCHEMA)))
    assert [r.block for r in rows.filter("thread_id = 1").orderBy("position").limit(2).collect()][1] == "<|assistant|>\nI am fine thanks.\n"


def test_quotes_of_conversations_with_larger_ids(spark):
    got = told(spark, [(5, 0, "user", "> the answer is forty two\nWhy?"), (9, 0, "user", "Listen."), (9, 1, "user", "The answer is forty two.")])
    shown = {k[:2]: (r.thread_id, r.position, r.parent_conv, r.parent_turn, r.n_linked) for k, r in got.items()}
    assert shown == {(9, 0): (5, 1, None, None, 0), (9, 1): (5, 2, 9, 0, 0), (5, 0): (5, 3, 9, 1, 1)}


def test_a_common_closing_does_not_win(spark):
    rows = [
        (1, 0, "user", "Something else.\nBest regards"),
        (2, 0, "user", "Opening words of the day.\nSee you soon\nBest regards\nmore lines\nthat are not quoted"),
        (3, 0, "user", "> See you soon\n> Best regards\nNice."),
        (4, 0, "user", "> Best regards\nOnly that."),
    ]
    got = told(spark, rows)
    assert {k[0]: (r.parent_conv, r.parent_turn) for k, r in got.items()} == {1: (None, None), 2: (None, None), 3: (2, 0), 4: (1, 0)}


def test_cycles_are_broken_at_their_smallest_message(spark):
    rows = [
        (1, 0, "user", "> second saying\nfirst saying"),
        (2, 0, "user", "> third saying\nsecond saying"),
        (3, 0, "user", "> first saying\nthird saying"),
        (3, 1, "user", "a tail"),
        (4, 0, "user", "> a tail\nits end"),
    ]
    got = {k[:2]: (r.thread_id, r.position, r.parent_conv, r.parent_turn) for k, r in told(spark, rows).items()}
    assert got == {(1, 0): (1, 1, None, None), (3, 0): (1, 2, 1, 0), (2, 0): (1, 3, 3, 0), (3, 1): (1, 4, 3, 0), (4, 0): (1, 5, 3, 1)}


def brute_source(rows, conv, turn, quote):
    """The message that holds most of the quoted lines, in plain Python."""
    size = sum(map(len, quote))
    best = None
    for c, t, lines in rows:
        held = sum(len(x) for x in quote if x in lines)
        if 2 * held < size or (c == conv and t >= turn):
            continue
        rank = (-held, c != conv, -t if c == conv else c, t)
        best = min(best or (rank, c, t), (rank, c, t))
    return best and best[1:]


def test_brute_force_over_a_quoting_table(spark):
    """Parts of paragraphs, common lines and closings, quotes in all directions."""
    rng = random.Random(4)
    common = ["best regards", "thanks a lot", "hello all", "see below", "ok"]
    said, rows, want = [], [], {}
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            said.append((c, t, [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(150)} of note" for _ in range(rng.randrange(1, 6))]))
    for c, t, lines in said:
        quote = []
        if rng.random() < 0.6:
            other = rng.choice(said)[2]
            at = rng.randrange(len(other))
            quote = other[at : at + rng.randrange(1, 4)]
            if rng.random() < 0.2:
                quote = [*quote, "never said"]
            want[c, t] = brute_source(said, c, t, quote)
        rows.append((c, t, "user", "\n".join([*("> " + x for x in quote), "", *lines])))
    got = ql.links(ql.units(ql.parsed(spark.createDataFrame([(c, t, t + 1, x) for c, t, _, x in rows], "conv long, turn long, row long, text string")))).collect()
    assert {(r.conv, r.turn): r.to_conv is not None and (r.to_conv, r.to_turn) or None for r in got} == want
    out = told(spark, rows)
    place = {k[:2]: r.position for k, r in out.items()}
    assert all(place[r.parent_conv, r.parent_turn] < r.position for r in out.values() if r.parent_conv is not None)
    for thread in {r.thread_id for r in out.values()}:
        assert sorted(r.position for r in out.values() if r.thread_id == thread) == list(range(1, 1 + sum(r.thread_id == thread for r in out.values())))


def test_nulls_empty_table_repeats_and_extra_columns(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "user", "> hi there\nyes", "x"), (2, 0, "user", "hi there", None), (2, 0, "user", "hi there", None)]
    out = ql.threads(spark.createDataFrame(rows, SCHEMA + ", component string"))
    assert sorted((r.conv_id, r.turn, r.parent_conv, r.parent_turn) for r in out.collect() if r.n_linked) == [(1, 1, 2, 0)]
    assert out.count() == 4 and "component" not in out.columns
