"""Text features on hand-made titles and descriptions."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import text as X


def features(spark, title, description=""):
    df = spark.createDataFrame([(title, description)], "t string, d string")
    return df.select(X.text_features(F.col("t"), F.col("d")).alias("f")).first().f


def n_leaves(row):
    return sum(n_leaves(v) if hasattr(v, "asDict") else 1 for v in row)


def test_leaf_count_and_missing_text(spark):
    f = features(spark, None, None)
    assert n_leaves(f) == 59
    assert f.structure.characterCount == 0 and f.structure.wordCount == 0 and f.structure.segmentCount == 1
    assert f.language.languages == ["english"] and f.descriptionAnalysis.hashtags.position == "none"


@pytest.mark.parametrize(
    "title, separator, segments",
    [("a | b | c", "|", 3), ("a - b", "-", 2), ("a – b", "–", 2), ("a: b", ":", 2), ("a / b", "/", 2), ("ab", "none", 1), ("a|b:c", "|", 2)],
)
def test_separators(spark, title, separator, segments):
    s = features(spark, title).structure
    assert (s.separator, s.segmentCount, s.separatorConsistent) == (separator, segments, True)


def test_languages(spark):
    f = features(spark, "వంట Recipe").language
    assert f.scripts == ["latin", "telugu"] and f.languages == ["english", "telugu"]
    assert (f.primaryLanguage, f.secondaryLanguage, f.teluguRatio, f.englishRatio) == ("english", "telugu", 0.33, 0.67)
    f = features(spark, "వంటకం రెసిపీ").language
    assert (f.primaryLanguage, f.secondaryLanguage, f.hasLatinScript) == ("telugu", "none", False)
    assert features(spark, "नमस्ते").language.languages == ["hindi"]


def test_hooks(spark):
    f = features(spark, "Top 10 in 2024 ？").hooks
    assert f.isQuestion and f.hasNumber and f.numbers == "10, 2024"


@pytest.mark.parametrize(
    "title, style, caps",
    [("BEST DAY", "all-caps", "BEST, DAY"), ("The BEST day", "mixed", "BEST"), ("The Best Day", "title-case", ""), ("the best", "lowercase", ""), ("వంట", "lowercase", "")],
)
def test_capitalization(spark, title, style, caps):
    f = features(spark, title).formatting
    assert (f.capitalization, f.capsWords) == (style, caps)


def test_emoji(spark):
    f = features(spark, "🔥 big news today ok 🔥🎉").formatting
    assert f.hasEmoji and f.emojiPositions == "start, end" and f.emojiList == "🔥, 🎉, 🔥🎉"
    assert features(spark, "a ^ b").formatting.emojiList == "^"
    f = features(spark, "abc 👍 def").formatting
    assert (f.emojiList, f.emojiPositions) == ("👍", "middle")
    assert features(spark, "plain").formatting.emojiPositions == ""


def test_brackets_year_tags_marks(spark):
    f = features(spark, "A (b) [c] 2024 #one #రెండు § wow!").formatting
    assert (f.bracketType, f.bracketContent, f.year, f.hashtags) == ("round", "b", "2024", "#one, #రెండు")
    assert (f.specialChars, f.punctuationType, f.hasExclamation) == ("§", "exclamation", True)
    f = features(spark, "x {y}").formatting
    assert (f.bracketType, f.bracketContent, f.year, f.punctuationType) == ("curly", "y", "none", "none")


def test_description(spark):
    d = features(
        spark, "t",
        "0:00 intro\n1:30 cook\nhttps://instagram.com/a https://amzn.to/b\nhttps://youtube.com/playlist?list=1 https://youtu.be/x https://e.org\n"
        "Subscribe, like and comment. Sponsored #ad use code: X merch patreon\n#a #b",
    ).descriptionAnalysis
    assert d.structure.lineCount == 6 and d.timestamps.timestampCount == 2
    assert d.hashtags["count"] == 3 and d.hashtags.position == "end"
    assert all(d.ctas) and d.links.totalLinkCount == 5 and all(d.links[:5]) and all(d.monetization)


def test_blank_description_is_zero(spark):
    d = features(spark, "t", " \n\t ").descriptionAnalysis
    assert d.structure.length == 0 and d.structure.lineCount == 0 and not any(d.monetization)


def test_word_bounds_at_marks(spark):
    assert not features(spark, "t", "see #ad").descriptionAnalysis.monetization.hasSponsorMention
    assert features(spark, "t", "see #ad").descriptionAnalysis.monetization.hasDisclosure


@pytest.mark.parametrize("lines, position", [("#a\nb\nc", "start"), ("a\n#b\nc", "middle"), ("a\nb\n#c", "end"), ("#a\nb\n#c", "throughout"), ("a", "none")])
def test_hashtag_position(spark, lines, position):
    assert features(spark, "t", lines).descriptionAnalysis.hashtags.position == position


def test_cleaning(spark):
    df = spark.createDataFrame([("a\nb  c\t d ", '```json\n{"a": 1}\n```', "<b>x</b> ---- y\n\n\n\nz" + "q" * 600)], "s string, j string, e string")
    r = df.select(X.sanitize(F.col("s"), 5).alias("s"), X.strip_code_fence(F.col("j")).alias("j"), X.escape_markup(F.col("e"), 500).alias("e")).first()
    assert r.s == "ab c " and r.j == '{"a": 1}' and r.e.startswith("bx/b  y\n\nz") and len(r.e) == 500
    long = spark.createDataFrame([("t", "d" * 10_500), ("t", "  ")], "t string, d string")
    got = [r.x for r in long.select(X.analysis_input_text(F.col("t"), F.col("d"), X.MAX_INPUT_DESCRIPTION).alias("x")).collect()]
    assert len(got[0]) == len("TITLE:\nt\n\nDESCRIPTION:\n") + 10_000 and got[1].endswith("(no description provided)")


def test_marks_hold_for_every_match(spark):
    """Texts without a mark are not searched: each pattern finds the same as without marks."""
    texts = [
        "SUBscribed", "sub", "I LIKE it", "liked", "👍", "a👍b", "Commented", "comments", "#AD", "Sponsorship", "paid  Promotion", "brand partner", "COLLAB with me",
        "collaboration with x", "#Sponsored", "contains paid x", "include paid y", "#PaidPartnership", "Disclosure", "use code", "PROMO", "coupon", "Code :x", "discount",
        "Merchandise", "Shop. now", "store x", "Teespring", "spreadshop", "Bonfire", "Patreon", "KoFi", "ko-fi", "buyMeACoffee", "buy me a Coffee", "PayPal.me",
        "venmo", "CASH app", "superchat", "Super Thanks", "memberships join", "members join", "nothing here", "İ ſub K", " ", "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = {**X.CTA_PATTERNS, **X.MONEY_PATTERNS}
    assert set(X.MARKS) == set(patterns)
    found = df.select(X.description_features(F.col("t")).alias("f"), F.struct(*[F.col("t").rlike(p).alias(n) for n, p in patterns.items()]).alias("w")).collect()
    for r in found:
        assert {**r.f.ctas.asDict(), **r.f.monetization.asDict()} == r.w.asDict()
    assert all(any(r.w[n] for r in found) for n in patterns)
