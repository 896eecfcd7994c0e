"""Deterministic features of a title and a description.

Everything is a native expression, so a whole table goes through one
projection inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.binding import let
from cohortlab.functions.links import link_classes_in

# Scripts (regex ranges), separators and marks.
TELUGU = r"\x{0C00}-\x{0C7F}"
DEVANAGARI = r"\x{0900}-\x{097F}"
LATIN = "a-zA-Z"
SCRIPTS = [("latin", LATIN, "english"), ("telugu", TELUGU, "telugu"), ("devanagari", DEVANAGARI, "hindi")]
SEPARATORS = ["|", " - ", " – ", " — ", ":", " / "]
EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}"
    r"\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2702}-\x{27BF}\x{200D}\x{FE0F}\x{1F200}-\x{1F251}"
)
SIMPLE_EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}"
)
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x1C-\x1F\x85"
PLAIN_MARKS = r""",.!?'"\-:;|/()\[\]{}#@&+=*"""
QUESTION = r"[?？]"
HASHTAG = rf"#[{WORD}{TELUGU}]+"
YEAR = r"\b((?:19|20)\p{Nd}{2})\b"
TIMESTAMP = r"\p{Nd}{1,2}:\p{Nd}{2}"
BRACKETS = [("round", r"\(([^)]*)\)"), ("square", r"\[([^\]]*)\]"), ("curly", r"\{([^}]*)\}")]
CTA_PATTERNS = {
    "hasSubscribeCTA": r"(?i)\bsub(?:scribe|scribed)?\b",
    "hasLikeCTA": r"(?i)\b(?:like|liked|👍)\b",
    "hasCommentCTA": r"(?i)\bcomment(?:s|ed)?\b",
}
MONEY_PATTERNS = {
    "hasSponsorMention": (
        r"(?i)\b(?:sponsor(?:ed|ship)?|#ad|paid\s+(?:promotion|partnership)|brand\s+partner(?:ship)?|"
        r"collab(?:oration)?\s+with)\b"
    ),
    "hasDisclosure": (
        r"(?i)(?:\bdisclosure\b|#sponsored\b|#ad\b|\bpaid\s+promotion\b|\bcontains?\s+paid\b|"
        r"\bincludes?\s+paid\b|#paidpartnership\b)"
    ),
    "hasDiscountCode": r"(?i)\b(?:(?:use|promo|discount|coupon)\s*(?:code)?|code\s*:)\b",
    "hasMerchLink": r"(?i)\b(?:merch(?:andise)?|shop\.?\s|store\.?\s|teespring|spreadshop|bonfire)\b",
    "hasDonationLink": (
        r"(?i)\b(?:patreon|ko-?fi|buymeacoffee|buy\s*me\s*a\s*coffee|paypal\.me|venmo|cash\s*app|superchat|"
        r"super\s*thanks|member(?:ship)?s?\s*join)\b"
    ),
}
# Each match of a pattern above holds one of these, in lower case: texts without any are not searched.
MARKS = {
    "hasSubscribeCTA": ["sub"], "hasLikeCTA": ["like", "👍"], "hasCommentCTA": ["comment"],
    "hasSponsorMention": ["sponsor", "#ad", "paid", "brand", "collab"], "hasDisclosure": ["disclosure", "#sponsored", "#ad", "paid"],
    "hasDiscountCode": ["use", "promo", "discount", "coupon", "code"], "hasMerchLink": ["merch", "shop", "store", "teespring", "bonfire"],
    "hasDonationLink": ["patreon", "kofi", "ko-fi", "coffee", "paypal", "venmo", "cash", "super", "member"],
}
MAX_INPUT_DESCRIPTION = 10_000
NO_DESCRIPTION = "(no description provided)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def has_script(text: Column, ranges: str) -> Column:
    return text.rlike(f"[{ranges}]")


def has_number(text: Column) -> Column:
    return text.rlike("[0-9]")


def has_simple_emoji(text: Column) -> Column:
    return text.rlike(f"[{SIMPLE_EMOJI}]")


def title_structure(title: Column) -> Column:
    """Separator, segments and character counts."""
    separator, segments = F.lit("none"), F.lit(1)
    for sep in reversed(SEPARATORS):
        pieces = ((F.length(title) - F.length(F.replace(title, F.lit(sep), F.lit("")))) / len(sep) + 1).cast("int")
        separator = F.when(title.contains(sep), F.lit(sep.strip())).otherwise(separator)
        segments = F.when(title.contains(sep), pieces).otherwise(segments)
    return F.struct(
        segments.alias("segmentCount"),
        separator.alias("separator"),
        F.lit(True).alias("separatorConsistent"),
        F.length(title).alias("characterCount"),
        F.length(F.replace(title, F.lit(" "), F.lit(""))).alias("characterCountNoSpaces"),
        F.size(words(title)).alias("wordCount"),
        _count(title, f"[{TELUGU}]").alias("teluguCharacterCount"),
        _count(title, f"[{LATIN}]").alias("englishCharacterCount"),
    )


def detect_scripts(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has_script(text, r), F.lit(name)) for name, r, _ in SCRIPTS]))


def detect_languages(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(has_script(text, r), F.lit(lang)) for _, r, lang in SCRIPTS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("english")))


def title_language(title: Column) -> Column:
    def build(c: Column) -> Column:
        both = c["telugu"] + c["latin"]
        telugu_ratio = F.when(both > 0, c["telugu"] / both).otherwise(F.lit(0.0))
        latin_ratio = F.when(both > 0, c["latin"] / both).otherwise(F.lit(0.0))
        primary = F.when(telugu_ratio > 0.5, F.lit("telugu")).otherwise(F.lit("english"))
        other = F.get(F.array_except(c["languages"], F.array(primary)), F.lit(0))
        return F.struct(
            c["languages"].alias("languages"),
            primary.alias("primaryLanguage"),
            F.when(F.size(c["languages"]) > 1, other).otherwise(F.lit("none")).alias("secondaryLanguage"),
            c["scripts"].alias("scripts"),
            (c["telugu"] > 0).alias("hasTeluguScript"),
            (c["latin"] > 0).alias("hasLatinScript"),
            F.round(telugu_ratio, 2).alias("teluguRatio"),
            F.round(latin_ratio, 2).alias("englishRatio"),
        )

    return let(
        build, telugu=_count(title, f"[{TELUGU}]"), latin=_count(title, f"[{LATIN}]"), languages=detect_languages(title),
        scripts=detect_scripts(title),
    )


def title_hooks(title: Column) -> Column:
    return F.struct(
        title.rlike(QUESTION).alias("isQuestion"),
        title.rlike(r"\p{Nd}").alias("hasNumber"),
        F.array_join(_all(title, r"\p{Nd}+"), ", ").alias("numbers"),
    )


def emoji_list(text: Column) -> Column:
    """Single symbols in order, then runs of several, without repeats."""
    singles = _all(text, rf"[\p{{So}}\p{{Sk}}{EMOJI}]")
    runs = F.filter(
        _all(text, f"[{EMOJI}]+"), lambda r: F.length(F.regexp_replace(r, r"[\x{FE0F}\x{200D}]", "")) > 1
    )
    return F.array_distinct(F.concat(singles, runs))


def emoji_positions(text: Column) -> Column:
    """Thirds of the text in which a run of emoji starts.

    The text is cut at the runs and offsets are summed up, so the cost is
    linear; lambdas must not touch the text itself (it would be re-evaluated
    for every element).
    """
    pieces = F.arrays_zip(
        F.split(text, f"[{EMOJI}]+").alias("gap"), _all(text, f"[{EMOJI}]+").alias("run"),
        F.array_repeat(F.length(text), F.size(_all(text, f"[{EMOJI}]+"))).alias("n"),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("start"), F.lit(False).alias("middle"), F.lit(False).alias("end")
    )

    def step(acc: Column, piece: Column) -> Column:
        at, n = acc["at"] + F.length(piece["gap"]), piece["n"]
        in_start, in_end = at < n / 3, at > n / 3 * 2
        is_run = piece["run"].isNotNull()
        return F.struct(
            (at + F.coalesce(F.length(piece["run"]), F.lit(0))).alias("at"),
            (acc["start"] | (is_run & in_start)).alias("start"),
            (acc["middle"] | (is_run & ~in_start & ~in_end)).alias("middle"),
            (acc["end"] | (is_run & in_end)).alias("end"),
        )

    def names(acc: Column) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(acc[z], F.lit(z)) for z in ("start", "middle", "end")])), ", ")

    return F.when(text.rlike(f"[{EMOJI}]"), F.aggregate(pieces, start, step, names)).otherwise(F.lit(""))


CAPS_WORD = r"^[\x00-\x60\x7B-\x7F]{2,}$"  # fixed value: ASCII without lower-case letters


def capitalization(text: Column) -> Column:
    def build(c: Column) -> Column:
        has_latin = c["latin"] > 0
        all_caps = has_latin & (c["upper"] / F.greatest(c["latin"], F.lit(1)) > 0.8)
        partial = has_latin & ~all_caps & (F.size(c["caps"]) > 0)
        titled = F.forall(c["words"], lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
        style = (
            F.when(~has_latin, "lowercase").when(all_caps, "all-caps").when(partial, "mixed").when(titled, "title-case")
            .otherwise("lowercase")
        )
        return F.struct(
            style.alias("capitalization"),
            all_caps.alias("allCaps"),
            partial.alias("partialCaps"),
            F.when(has_latin, F.array_join(c["caps"], ", ")).otherwise("").alias("capsWords"),
        )

    caps = F.filter(words(text), lambda w: w.rlike(CAPS_WORD) & w.rlike("[A-Z]"))
    return let(build, latin=_count(text, "[A-Za-z]"), upper=_count(text, "[A-Z]"), words=words(text), caps=caps)


def brackets(text: Column) -> Column:
    """The first bracket kind found (round, square, curly) and what it holds."""
    def build(c: Column) -> Column:
        kind, content, any_kind = F.lit("none"), F.lit("none"), F.lit(False)
        for name, _ in reversed(BRACKETS):
            found = F.size(c[name]) > 0
            kind = F.when(found, F.lit(name)).otherwise(kind)
            content = F.when(found, F.array_join(c[name], ", ")).otherwise(content)
            any_kind = any_kind | found
        return F.struct(any_kind.alias("hasBrackets"), kind.alias("bracketType"), content.alias("bracketContent"))

    return let(build, **{name: _all(text, pattern, 1) for name, pattern in BRACKETS})


def special_chars(text: Column) -> Column:
    plain = F.regexp_replace(text, f"[{EMOJI}]+", "")
    odd = F.array_sort(
        F.array_distinct(_all(plain, f"[^{WORD}{SPACE}{TELUGU}{DEVANAGARI}{PLAIN_MARKS}]"))
    )
    return let(
        lambda c: F.struct((F.size(c["odd"]) > 0).alias("hasSpecialChars"), F.array_join(c["odd"], ", ").alias("specialChars")),
        odd=odd,
    )


def punctuation(text: Column) -> Column:
    def build(c: Column) -> Column:
        kind = (
            F.when(c["last"].isin("!", "！"), "exclamation")
            .when(c["last"].isin("?", "？"), "question")
            .when(c["last"].isin(".", "。"), "period")
            .otherwise("none")
        )
        return F.struct(
            (kind != "none").alias("endsWithPunctuation"),
            kind.alias("punctuationType"),
            c["exclaims"].alias("hasExclamation"),
            c["asks"].alias("hasQuestion"),
        )

    last = F.right(F.regexp_replace(text, rf"[{SPACE}]+$", ""), F.lit(1))
    return let(build, last=last, exclaims=text.contains("!"), asks=text.rlike(QUESTION))


FORMATTING_PARTS = {  # fixed values: field order of the formatting document
    "caps": ["capitalization", "allCaps", "partialCaps", "capsWords"],
    "brackets": ["hasBrackets", "bracketType", "bracketContent"],
    "special": ["hasSpecialChars", "specialChars"],
    "punctuation": ["endsWithPunctuation", "punctuationType", "hasExclamation", "hasQuestion"],
}


def title_formatting(title: Column) -> Column:
    def build(c: Column) -> Column:
        return F.struct(
            (F.size(c["emojis"]) > 0).alias("hasEmoji"),
            F.array_join(c["emojis"], ", ").alias("emojiList"),
            c["positions"].alias("emojiPositions"),
            (F.size(c["years"]) > 0).alias("hasYear"),
            F.coalesce(F.get(c["years"], F.lit(0)), F.lit("none")).alias("year"),
            (F.size(c["tags"]) > 0).alias("hasHashtag"),
            F.array_join(c["tags"], ", ").alias("hashtags"),
            *[c[part][name].alias(name) for part, names in FORMATTING_PARTS.items() for name in names],
        )

    return let(
        build, emojis=emoji_list(title), positions=emoji_positions(title), years=_all(title, YEAR, 1), tags=_all(title, HASHTAG),
        caps=capitalization(title), brackets=brackets(title), special=special_chars(title), punctuation=punctuation(title),
    )


def hashtag_position(description: Column) -> Column:
    """Third of the lines that holds hashtags, or 'throughout' / 'none'."""
    lines = F.split(strip(description), "\n")
    tagged = F.array_compact(F.transform(lines, lambda line, i: F.when(line.rlike(HASHTAG), i)))
    # the line count rides along as an array: a lambda would re-split the text per element
    sizes = F.array_repeat(F.size(lines), F.size(tagged))
    zones = F.array_distinct(
        F.zip_with(
            tagged, sizes, lambda i, n: F.when(i < n / 3, "start").when(i >= n / 3 * 2, "end").otherwise("middle")
        )
    )
    found = F.when(F.size(zones) >= 2, F.lit("throughout")).otherwise(F.coalesce(F.get(zones, F.lit(0)), F.lit("none")))
    return F.when(description.rlike(HASHTAG), found).otherwise(F.lit("none"))


def description_features(description: Column, strict_domains: bool = False) -> Column:
    """Structure, timestamps, hashtags, calls to action, links and money marks.

    A blank description gives zeros and false everywhere.
    """
    def build(c: Column) -> Column:
        def has(kind: str) -> Column:
            return F.array_contains(c["links"], kind)

        return F.struct(
            F.struct(c["length"].alias("length"), c["lines"].alias("lineCount")).alias("structure"),
            F.struct((c["stamps"] > 0).alias("hasTimestamps"), c["stamps"].alias("timestampCount")).alias("timestamps"),
            F.struct(c["tags"].alias("count"), c["position"].alias("position")).alias("hashtags"),
            F.struct(*[c[name].alias(name) for name in CTA_PATTERNS]).alias("ctas"),
            F.struct(
                has("social").alias("hasSocialMediaLinks"),
                has("affiliate").alias("hasAffiliateLinks"),
                has("video").alias("hasOtherVideoLinks"),
                has("playlist").alias("hasPlaylistLinks"),
                has("website").alias("hasWebsiteLink"),
                F.size(c["links"]).alias("totalLinkCount"),
            ).alias("links"),
            F.struct(*[c[name].alias(name) for name in MONEY_PATTERNS]).alias("monetization"),
        )

    def parts(b: Column) -> Column:
        text, low = b["text"], b["low"]

        def says(name: str, pattern: str) -> Column:
            marked = reduce(or_, [low.contains(mark) for mark in MARKS[name]])
            return F.when(marked, text.rlike(pattern)).otherwise(F.lit(False))

        return let(
            build, length=F.length(text), lines=F.when(b["filled"], _count(text, "\n") + 1).otherwise(F.lit(0)),
            stamps=_count(text, TIMESTAMP), tags=_count(text, HASHTAG), position=hashtag_position(text),
            links=link_classes_in(text, strict_domains),
            **{name: says(name, p) for name, p in {**CTA_PATTERNS, **MONEY_PATTERNS}.items()},
        )

    filled = description.rlike(rf"[^{SPACE}]")
    text = F.when(filled, description).otherwise(F.lit(""))
    # bound first: each of the parts would test and lower the whole text again
    return let(parts, filled=filled, text=text, low=F.lower(text))


def text_features(title: Column, description: Column, strict_domains: bool = False) -> Column:
    """All 59 features as one nested struct."""
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    return F.struct(
        title_structure(title).alias("structure"),
        title_language(title).alias("language"),
        title_hooks(title).alias("hooks"),
        title_formatting(title).alias("formatting"),
        description_features(description, strict_domains).alias("descriptionAnalysis"),
    )


def cut_to(text: Column, max_chars: int | None) -> Column:
    """The whole text, or its first ``max_chars`` characters if a limit is given."""
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def analysis_input_text(title: Column, description: Column, max_chars: int | None = None) -> Column:
    """Title and description as one text; ``max_chars`` (see MAX_INPUT_DESCRIPTION) cuts the description."""
    cut = cut_to(F.coalesce(description, F.lit("")), max_chars)
    body = F.when(cut.rlike(rf"[^{SPACE}]"), cut).otherwise(F.lit(NO_DESCRIPTION))
    return F.concat(F.lit("TITLE:\n"), title, F.lit("\n\nDESCRIPTION:\n"), body)


def strip_code_fence(text: Column) -> Column:
    """Drop a leading fence (with or without 'json') and a trailing one."""
    return strip(F.regexp_replace(strip(text), r"^```(?:json)?|```$", ""))


def sanitize(text: Column, max_length: int | None = None) -> Column:
    """Drop control characters, collapse white space, trim and cut."""
    no_control = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", "")
    return cut_to(strip(F.regexp_replace(no_control, rf"[{SPACE}]+", " ")), max_length)


def escape_markup(text: Column, max_length: int | None = None) -> Column:
    """Remove fences, rules and angle brackets; squeeze blank lines; cut."""
    for pattern, by in [("```", ""), ("---+", ""), ("===+", ""), ("\n{3,}", "\n\n"), ("[<>]", "")]:
        text = F.regexp_replace(text, pattern, by)
    return cut_to(text, max_length)
