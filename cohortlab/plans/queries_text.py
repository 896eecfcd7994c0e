"""Text feature and link queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions import links as L
from cohortlab.functions import metrics as M
from cohortlab.functions import text as X
from cohortlab.functions.nested import deep_merge
from cohortlab.plans import bindings as D
from cohortlab.plans.registry import query


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Titles with other scripts: the documents are Latin only, so letters of some
# titles are mapped to Telugu, Devanagari or emoji.
MAPS = [("abcdefghij", "అఆఇఈఉఊఋఎఏఐ"), ("nrst", "😀🎉☀✨"), ("aeiou", "अआइईउ")]
MAPPED_SQL = (
    "WITH "
    + D.TEXTS_SQL
    + f""",
mapped AS (
  SELECT doc_id, description, CASE doc_id % 4 WHEN 1 THEN translate(title, {q(MAPS[0][0])}, {q(MAPS[0][1])})
    WHEN 2 THEN translate(title, {q(MAPS[1][0])}, {q(MAPS[1][1])}) WHEN 3 THEN translate(title, {q(MAPS[2][0])}, {q(MAPS[2][1])}) ELSE title END AS t
  FROM texts
)"""
)


def mapped(spark, sf):
    t, k = F.col("title"), F.col("doc_id") % 4
    out = t
    for i, (a, b) in enumerate(MAPS, start=1):
        out = F.when(k == i, F.translate(t, a, b)).otherwise(out)
    return D.texts(spark, sf).withColumn("t", out)


# Pages as descriptions: tags become line breaks; the address comes first and
# every page number decides which call or money phrase follows.
PHRASES = [
    "Please subscribe and like", "sponsored #ad disclosure", "use code: SAVE", "shop. our merch on teespring",
    "join patreon or ko-fi", "leave comments at 0:15 and 12:34", "see https://www.instagram.com/me https://amzn.to/x",
    "more https://youtube.com/playlist?list=1 https://youtu.be/abc",
]
PAGES_SQL = f"""WITH described AS (
  SELECT page_id, url, url || chr(10) || regexp_replace(html, '<[^>]*>', chr(10), 'g') || chr(10) || CASE page_id % {len(PHRASES)}
    {" ".join(f"WHEN {i} THEN {q(p)}" for i, p in enumerate(PHRASES))} END AS d
  FROM pages
)"""


def described(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("page_id") % len(PHRASES) + 1).cast("int"))
    body = F.regexp_replace("html", "<[^>]*>", "\n")
    return D.pages(spark, sf).select("page_id", "url", F.concat(F.col("url"), F.lit("\n"), body, F.lit("\n"), phrase).alias("d"))


def n_of(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {q(pattern)})) AS INTEGER)"


def joined(lst: str) -> str:
    return f"array_to_string({lst}, ', ')"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


WORDS = f"list_filter(regexp_split_to_array(t, {q(f'[{X.SPACE}]+')}), lambda w: w <> '')"

SEPARATOR_SQL = "CASE " + " ".join(f"WHEN contains(t, {q(s)}) THEN {q(s.strip())}" for s in X.SEPARATORS) + " ELSE 'none' END"
SEGMENT_SQL = "CASE " + " ".join(f"WHEN contains(t, {q(s)}) THEN len(string_split(t, {q(s)}))" for s in X.SEPARATORS) + " ELSE 1 END"


@query(
    "title_structure",
    f"""{MAPPED_SQL} SELECT doc_id, CAST({SEGMENT_SQL} AS INTEGER) AS "segmentCount", {SEPARATOR_SQL} AS separator, true AS "separatorConsistent",
  CAST(length(t) AS INTEGER) AS "characterCount", CAST(length(replace(t, ' ', '')) AS INTEGER) AS "characterCountNoSpaces",
  CAST(len({WORDS}) AS INTEGER) AS "wordCount", {n_of("t", f"[{X.TELUGU}]")} AS "teluguCharacterCount", {n_of("t", f"[{X.LATIN}]")} AS "englishCharacterCount"
FROM mapped""",
)
def title_structure(spark, sf):
    """T2."""
    return mapped(spark, sf).select("doc_id", X.title_structure(F.col("t")).alias("s")).select("doc_id", "s.*")


LANG_SQL = f"""
counted AS (SELECT doc_id, t, {n_of("t", f"[{X.TELUGU}]")} AS te, {n_of("t", f"[{X.LATIN}]")} AS la, {n_of("t", f"[{X.DEVANAGARI}]")} AS de FROM mapped),
ratios AS (
  SELECT *, CASE WHEN te + la > 0 THEN te / (te + la) ELSE 0 END AS tr, CASE WHEN te + la > 0 THEN la / (te + la) ELSE 0 END AS lr,
    list_filter([CASE WHEN la > 0 THEN 'english' END, CASE WHEN te > 0 THEN 'telugu' END, CASE WHEN de > 0 THEN 'hindi' END], lambda x: x IS NOT NULL) AS found,
    list_filter([CASE WHEN la > 0 THEN 'latin' END, CASE WHEN te > 0 THEN 'telugu' END, CASE WHEN de > 0 THEN 'devanagari' END], lambda x: x IS NOT NULL) AS scripts
  FROM counted
),
primaries AS (SELECT *, CASE WHEN len(found) = 0 THEN ['english'] ELSE found END AS langs, CASE WHEN tr > 0.5 THEN 'telugu' ELSE 'english' END AS prim FROM ratios)"""


@query(
    "title_language",
    f"""{MAPPED_SQL},{LANG_SQL} SELECT doc_id, {joined("langs")} AS languages, prim AS "primaryLanguage",
  CASE WHEN len(langs) > 1 THEN list_filter(langs, lambda x: x <> prim)[1] ELSE 'none' END AS "secondaryLanguage", {joined("scripts")} AS scripts,
  te > 0 AS "hasTeluguScript", la > 0 AS "hasLatinScript", round(tr, 2) AS "teluguRatio", round(lr, 2) AS "englishRatio" FROM primaries""",
)
def title_language(spark, sf):
    """T3, T4, T5."""
    rows = mapped(spark, sf).select("doc_id", X.title_language(F.col("t")).alias("s")).select("doc_id", "s.*")
    return rows.withColumns({"languages": F.array_join("languages", ", "), "scripts": F.array_join("scripts", ", ")})


# digits and question marks are rare in the prose: the length and lang are added
HOOK_SQL = "title || ' ' || CAST(length(title) AS VARCHAR) || CASE WHEN lang = 'de' THEN '?' ELSE ' in 2024' END"


@query(
    "title_hooks",
    "WITH "
    + D.TEXTS_SQL
    + f""" SELECT doc_id, regexp_matches(t, {q(X.QUESTION)}) AS "isQuestion", regexp_matches(t, '[0-9]') AS "hasNumber",
  {joined("regexp_extract_all(t, '[0-9]+')")} AS numbers FROM (SELECT doc_id, {HOOK_SQL} AS t FROM texts)""",
)
def title_hooks(spark, sf):
    """T6."""
    t = F.expr("title || ' ' || CAST(length(title) AS STRING) || CASE WHEN lang = 'de' THEN '?' ELSE ' in 2024' END")
    return D.texts(spark, sf).select("doc_id", X.title_hooks(t).alias("s")).select("doc_id", "s.*")


EMOJI_CLASS = rf"[\p{{So}}\p{{Sk}}{X.EMOJI}]"
EMOJI_LIST = ordered_distinct(
    f"(regexp_extract_all(t, {q(EMOJI_CLASS)}) || list_filter(regexp_extract_all(t, {q(f'[{X.EMOJI}]+')}), lambda r: length(regexp_replace(r, {q('[' + chr(92) + 'x{FE0F}' + chr(92) + 'x{200D}]')}, '', 'g')) > 1))"
)
ZONES_SQL = f"""
chars AS (SELECT doc_id, t, length(t) AS n, list_transform(range(1, length(t) + 1), lambda i: regexp_matches(substr(t, i, 1), {q(f"[{X.EMOJI}]")})) AS e FROM mapped),
zones AS (
  SELECT doc_id, list_transform(list_filter(range(1, n + 1), lambda i: e[i] AND (i = 1 OR NOT e[i - 1])), lambda i:
    CASE WHEN i - 1 < n / 3 THEN 'start' WHEN i - 1 > n / 3 * 2 THEN 'end' ELSE 'middle' END) AS z FROM chars
)"""
CAPS = f"list_filter({WORDS}, lambda w: regexp_full_match(w, {q(chr(91) + chr(92) + 'x00-' + chr(92) + 'x60' + chr(92) + 'x7B-' + chr(92) + 'x7F]{2,}')}) AND regexp_matches(w, '[A-Z]'))"


def _bracket(column: str) -> str:
    when = " ".join(
        f"WHEN regexp_matches(t, {q(p)}) THEN " + (q(n) if column == "type" else joined(f"regexp_extract_all(t, {q(p)}, 1)"))
        for n, p in X.BRACKETS
    )
    return f"CASE {when} ELSE 'none' END"


ODD_CLASS = f"[^{X.WORD}{X.SPACE}{X.TELUGU}{X.DEVANAGARI}{X.PLAIN_MARKS}]"
ODD = f"list_sort(list_distinct(regexp_extract_all(regexp_replace(t, {q(f'[{X.EMOJI}]+')}, '', 'g'), {q(ODD_CLASS)})))"
PUNCT = "right(regexp_replace(t, '[\\s\\p{Z}]+$', ''), 1)"


@query(
    "title_formatting",
    f"""{MAPPED_SQL},{ZONES_SQL},
base AS (
  SELECT mapped.doc_id, t, {EMOJI_LIST} AS emojis, {CAPS} AS caps, {ODD} AS odd, {PUNCT} AS last, regexp_extract_all(t, {q(X.YEAR)}, 1) AS years,
    regexp_extract_all(t, {q(X.HASHTAG)}) AS tags, len(regexp_extract_all(t, '[A-Za-z]')) AS la, len(regexp_extract_all(t, '[A-Z]')) AS up, z,
    len(list_filter({WORDS}, lambda w: regexp_matches(w, '^\\p{{L}}') AND NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 AS titled
  FROM mapped JOIN zones USING (doc_id)
),
flags AS (SELECT *, la > 0 AND up / greatest(la, 1) > 0.8 AS allcaps, CASE WHEN last IN ('!', '！') THEN 'exclamation' WHEN last IN ('?', '？') THEN 'question' WHEN last IN ('.', '。') THEN 'period' ELSE 'none' END AS pt FROM base)
SELECT doc_id, len(emojis) > 0 AS "hasEmoji", {joined("emojis")} AS "emojiList",
  {joined("list_filter(['start', 'middle', 'end'], lambda p: list_contains(z, p))")} AS "emojiPositions", len(years) > 0 AS "hasYear", coalesce(years[1], 'none') AS year,
  len(tags) > 0 AS "hasHashtag", {joined("tags")} AS hashtags,
  CASE WHEN la = 0 THEN 'lowercase' WHEN allcaps THEN 'all-caps' WHEN len(caps) > 0 THEN 'mixed' WHEN titled THEN 'title-case' ELSE 'lowercase' END AS capitalization,
  allcaps AS "allCaps", la > 0 AND NOT allcaps AND len(caps) > 0 AS "partialCaps", CASE WHEN la > 0 THEN {joined("caps")} ELSE '' END AS "capsWords",
  regexp_matches(t, {q("|".join(p for _, p in X.BRACKETS))}) AS "hasBrackets", {_bracket("type")} AS "bracketType", {_bracket("content")} AS "bracketContent",
  len(odd) > 0 AS "hasSpecialChars", {joined("odd")} AS "specialChars", pt <> 'none' AS "endsWithPunctuation", pt AS "punctuationType",
  contains(t, '!') AS "hasExclamation", regexp_matches(t, {q(X.QUESTION)}) AS "hasQuestion"
FROM flags""",
)
def title_formatting(spark, sf):
    """T7 to T13."""
    return mapped(spark, sf).select("doc_id", X.title_formatting(F.col("t")).alias("s")).select("doc_id", "s.*")


def class_sql(u: str) -> str:
    host = f"regexp_extract(lower({u}), 'https?://(?:www\\.)?([^/]+)', 1)"
    social, aff, marks, video = (L._any_of(x) for x in (L.SOCIAL_DOMAINS, L.AFFILIATE_DOMAINS, L.AFFILIATE_MARKS, L.VIDEO_DOMAINS))
    return (
        f"CASE WHEN regexp_matches({host}, {q(social)}) THEN 'social' WHEN regexp_matches({host}, {q(aff)}) OR regexp_matches(lower({u}), {q(marks)}) THEN 'affiliate' "
        f"WHEN regexp_matches({host}, {q(video)}) THEN CASE WHEN regexp_matches(lower({u}), 'playlist|list=') THEN 'playlist' ELSE 'video' END ELSE 'website' END"
    )


ZONE_SQL = f"""CASE WHEN NOT regexp_matches(d, {q(X.HASHTAG)}) THEN 'none' ELSE (
  WITH l AS (SELECT string_split(regexp_replace(d, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), chr(10)) AS lines)
  SELECT CASE WHEN len(z) >= 2 THEN 'throughout' ELSE coalesce(z[1], 'none') END FROM (
    SELECT list_distinct(list_transform(list_filter(range(0, len(lines)), lambda i: regexp_matches(lines[i + 1], {q(X.HASHTAG)})), lambda i:
      CASE WHEN i < len(lines) / 3 THEN 'start' WHEN i >= len(lines) / 3 * 2 THEN 'end' ELSE 'middle' END)) AS z FROM l)
) END"""


@query(
    "description_features",
    f"""{PAGES_SQL},
classed AS (SELECT *, list_transform(regexp_extract_all(d, {q(L.URL_PATTERN)}), lambda u: {class_sql("u")}) AS c FROM described)
SELECT page_id, CAST(length(d) AS INTEGER) AS length, CAST(len(string_split(d, chr(10))) AS INTEGER) AS "lineCount",
  {n_of("d", X.TIMESTAMP)} > 0 AS "hasTimestamps", {n_of("d", X.TIMESTAMP)} AS "timestampCount", {n_of("d", X.HASHTAG)} AS hashtags,
  {", ".join(f'regexp_matches(d, {q(p)}) AS "{n}"' for n, p in X.CTA_PATTERNS.items())},
  list_contains(c, 'social') AS "hasSocialMediaLinks", list_contains(c, 'affiliate') AS "hasAffiliateLinks", list_contains(c, 'video') AS "hasOtherVideoLinks",
  list_contains(c, 'playlist') AS "hasPlaylistLinks", list_contains(c, 'website') AS "hasWebsiteLink", CAST(len(c) AS INTEGER) AS "totalLinkCount",
  {", ".join(f'regexp_matches(d, {q(p)}) AS "{n}"' for n, p in X.MONEY_PATTERNS.items())}
FROM classed""",
)
def description_features(spark, sf):
    """T14, T16, T17, T18."""
    rows = described(spark, sf).select("page_id", X.description_features(F.col("d")).alias("s"))
    return rows.select(
        "page_id", "s.structure.*", "s.timestamps.*", F.col("s.hashtags.count").alias("hashtags"), "s.ctas.*", "s.links.*", "s.monetization.*"
    )


@query("hashtag_position", f"{PAGES_SQL} SELECT page_id, {ZONE_SQL} AS position FROM described")
def hashtag_position(spark, sf):
    """T15."""
    return described(spark, sf).select("page_id", X.hashtag_position(F.col("d")).alias("position"))


@query(
    "url_classes",
    f"{PAGES_SQL} SELECT link_class, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, {class_sql('u')} AS link_class FROM (SELECT page_id, unnest(regexp_extract_all(d, {q(L.URL_PATTERN)})) AS u FROM described)) GROUP BY ALL",
)
def url_classes(spark, sf):
    """Links by class."""
    rows = described(spark, sf).select("page_id", F.explode(L.link_classes_in(F.col("d"))).alias("link_class"))
    # pages collapse first, so a class that holds most links is no hot group
    per_page = rows.groupBy("link_class", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("link_class").agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_pages"))


@query(
    "text_features",
    f"""{MAPPED_SQL} SELECT doc_id % 10 AS bucket, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(len({WORDS})) AS BIGINT) AS words,
  CAST(sum(length(description)) FILTER (WHERE regexp_matches(description, '[^\\s\\p{{Z}}]')) AS BIGINT) AS desc_chars,
  count(*) FILTER (WHERE regexp_matches(t, {q(f"[{X.TELUGU}]")})) AS telugu,
  count(*) FILTER (WHERE regexp_matches(t, {q(EMOJI_CLASS)})) AS emoji, count(*) FILTER (WHERE regexp_matches(description, {q(X.CTA_PATTERNS["hasLikeCTA"])})) AS like_cta
FROM mapped GROUP BY ALL""",
)
def text_features(spark, sf):
    """All 59 features of every document, summed up."""
    rows = mapped(spark, sf).select("doc_id", X.text_features(F.col("t"), F.col("description")).alias("f"))
    return rows.groupBy((F.col("doc_id") % 10).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("f.structure.characterCount").alias("chars"), F.sum("f.structure.wordCount").alias("words"),
        F.sum("f.descriptionAnalysis.structure.length").alias("desc_chars"), F.count_if("f.language.hasTeluguScript").alias("telugu"),
        F.count_if("f.formatting.hasEmoji").alias("emoji"), F.count_if("f.descriptionAnalysis.ctas.hasLikeCTA").alias("like_cta"),
    )


@query(
    "script_tests",
    f"""{MAPPED_SQL} SELECT doc_id, regexp_matches(t, {q(f"[{X.TELUGU}]")}) AS telugu, regexp_matches(t, '[a-zA-Z]') AS latin,
  regexp_matches(t, '[0-9]') AS number, regexp_matches(t, {q(f"[{X.SIMPLE_EMOJI}]")}) AS emoji FROM mapped""",
)
def script_tests(spark, sf):
    """M17."""
    t = F.col("t")
    return mapped(spark, sf).select(
        "doc_id", X.has_script(t, X.TELUGU).alias("telugu"), X.has_script(t, X.LATIN).alias("latin"),
        X.has_number(t).alias("number"), X.has_simple_emoji(t).alias("emoji"),
    )


@query(
    "deep_merge",
    "WITH "
    + D.TEXTS_SQL
    + """ SELECT doc_id, lang AS pattern, CAST(length(title) AS INTEGER) AS size, CASE WHEN toxic IS NULL THEN 'base' ELSE 'label' END AS kind, toxic AS extra
FROM texts LEFT JOIN labels USING (doc_id)""",
)
def deep_merge_query(spark, sf):
    """Overlay from labels wins where there is one."""
    labels = D.table(spark, sf, "labels").select("doc_id", "toxic")
    rows = D.texts(spark, sf).join(labels, "doc_id", "left").select(
        "doc_id",
        F.struct(F.struct(F.col("lang").alias("pattern"), F.length("title").alias("size")).alias("s"), F.lit("base").alias("kind")).alias("a"),
        F.when(F.col("toxic").isNotNull(), F.struct(F.struct(F.length("title").alias("size")).alias("s"), F.lit("label").alias("kind"), F.col("toxic").alias("extra"))).alias("b"),
    )
    # without an overlay the nested size stays as it was
    merged = deep_merge(F.col("a"), rows.schema["a"].dataType, F.col("b"), rows.schema["b"].dataType)
    return rows.select("doc_id", merged.alias("m")).select("doc_id", "m.s.*", "m.kind", "m.extra")


@query(
    "analysis_input_text",
    "WITH "
    + D.TEXTS_SQL
    + """ SELECT doc_id, 'TITLE:' || chr(10) || title || chr(10) || chr(10) || 'DESCRIPTION:' || chr(10) ||
  CASE WHEN regexp_matches(description, '[^\\s\\p{Z}]') THEN description ELSE '(no description provided)' END AS input FROM texts""",
)
def analysis_input_text(spark, sf):
    """T20."""
    return D.texts(spark, sf).select("doc_id", X.analysis_input_text(F.col("title"), F.col("description")).alias("input"))


@query(
    "strip_json_fences",
    """SELECT conv_id, turn, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS bare FROM conversations""",
)
def strip_json_fences(spark, sf):
    """Texts are fenced three ways and come back bare."""
    t, k = F.col("text"), F.col("turn") % 3
    fenced = F.when(k == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit("```\n"), t, F.lit("\n```\n"))).otherwise(
        F.concat(F.lit("  "), t, F.lit("\n"))
    )
    return D.table(spark, sf, "conversations").select("conv_id", "turn", X.strip_code_fence(fenced).alias("bare"))


@query(
    "sanitize_input",
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS clean FROM conversations""",
)
def sanitize_input(spark, sf):
    """T22."""
    return D.table(spark, sf, "conversations").select("conv_id", "turn", X.sanitize(F.col("text")).alias("clean"))


@query(
    "escape_text",
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '```', '', 'g'), '---+', '', 'g'), '===+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[<>]', '', 'g') AS escaped FROM pages""",
)
def escape_text(spark, sf):
    """T23."""
    return D.pages(spark, sf).select("page_id", X.escape_markup(F.col("html")).alias("escaped"))


# --- links ---------------------------------------------------------------------

# owner links derived from page addresses: every shape once per eight pages
LINK_SQL = """
linked AS (
  SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://www.youtube.com/@Handle' || page_id WHEN 1 THEN 'https://youtube.com/@handle' || page_id || '?x=1'
    WHEN 2 THEN 'https://www.youtube.com/channel/UC' || lpad(CAST(page_id AS VARCHAR), 22, '0') WHEN 3 THEN 'https://www.youtube.com/c/Name' || page_id || '/videos'
    WHEN 4 THEN 'https://www.youtube.com/user/u' || page_id WHEN 5 THEN 'youtube/' || url WHEN 6 THEN '' ELSE url END AS link
  FROM pages
)"""


def linked(spark, sf):
    return D.pages(spark, sf).withColumn(
        "link",
        F.expr(
            """CASE page_id % 8 WHEN 0 THEN 'https://www.youtube.com/@Handle' || page_id WHEN 1 THEN 'https://youtube.com/@handle' || page_id || '?x=1'
    WHEN 2 THEN 'https://www.youtube.com/channel/UC' || lpad(CAST(page_id AS STRING), 22, '0') WHEN 3 THEN 'https://www.youtube.com/c/Name' || page_id || '/videos'
    WHEN 4 THEN 'https://www.youtube.com/user/u' || page_id WHEN 5 THEN 'youtube/' || url WHEN 6 THEN '' ELSE url END"""
        ),
    )


PARSED_SQL = (
    LINK_SQL
    + f""",
parsed AS (
  SELECT *, CASE {" ".join(f"WHEN regexp_matches(link, {q(p)}) THEN {q(k)}" for k, p in L.OWNER_PATTERNS)} END AS type,
    CASE {" ".join(f"WHEN regexp_matches(link, {q(p)}) THEN regexp_extract(link, {q(p)}, 1)" for _, p in L.OWNER_PATTERNS)} END AS identifier
  FROM linked
)"""
)


@query("parse_channel_url", f"WITH {PARSED_SQL} SELECT page_id, type, identifier FROM parsed")
def parse_channel_url(spark, sf):
    """M13."""
    return linked(spark, sf).select("page_id", L.parse_owner_url(F.col("link")).alias("p")).select("page_id", "p.type", "p.identifier")


@query("extract_handle", f"WITH {LINK_SQL} SELECT page_id, lower(regexp_extract(link, '/@([^/?]+)', 1)) AS handle FROM linked")
def extract_handle(spark, sf):
    """M14."""
    return linked(spark, sf).select("page_id", L.handle_of(F.col("link")).alias("handle"))


@query(
    "url_to_progress_id",
    f"""WITH {LINK_SQL}, ids AS (SELECT page_id, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+')
  THEN replace(regexp_replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/', ''), '/', '_')
  ELSE left(regexp_replace(link, '[^a-zA-Z0-9@_-]', '_', 'g'), 100) END AS id FROM linked)
SELECT page_id, CASE WHEN id = '' THEN 'unknown' ELSE id END AS id FROM ids""",
)
def url_to_progress_id(spark, sf):
    """M15."""
    return linked(spark, sf).select("page_id", L.progress_id(F.col("link")).alias("id"))


@query(
    "resolution_quota_cost",
    f"""WITH {PARSED_SQL} SELECT type, count(*) AS n, CAST(sum(CASE type WHEN 'channelId' THEN 0 WHEN 'handle' THEN 1 WHEN 'user' THEN 1
  WHEN 'customUrl' THEN CASE WHEN page_id % 16 = 3 THEN 1 ELSE 101 END END) AS BIGINT) AS cost FROM parsed GROUP BY ALL""",
)
def resolution_quota_cost(spark, sf):
    """Lookup cost; half of the custom links need a search."""
    kind = L.parse_owner_url(F.col("link"))["type"]
    cost = L.lookup_cost(F.col("type"), F.col("page_id") % 16 == 3)
    return linked(spark, sf).withColumn("type", kind).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"))


@query(
    "safe_key",
    """SELECT doc_id, CASE WHEN strlen(k) <= 200 THEN k ELSE left(k, list_max(list_filter(range(0, 198), lambda n: strlen(left(k, n)) <= 197))) || '...' END AS key
FROM (SELECT doc_id, text AS k FROM documents)""",
)
def safe_key(spark, sf):
    """Keys cut at whole characters."""
    return D.table(spark, sf, "documents").select("doc_id", M.safe_key(F.col("text")).alias("key"))
