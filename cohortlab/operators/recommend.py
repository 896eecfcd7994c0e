"""Recommendations for a table of requests.

Insights come in as small result tables (at most 20 gaps, 10 saturated
topics, 30 keywords, 9 formats, 7 days, 24 hours). They enter the plan as
scalar subqueries, so a request row never joins another table but the five-row
type dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.text import sanitize
from cohortlab.operators import templates as P

TEXTS = "array<string>"


@dataclass
class Insights:
    """Result tables that recommendations read; any of them may be missing."""

    gaps: DataFrame | None = None  # topic, avg_vps, n_items, opportunity_score
    saturated: DataFrame | None = None  # topic, content_share
    keywords: DataFrame | None = None  # keyword, avg_vps, multiplier, usage_count, usage_percent
    formats: DataFrame | None = None  # format, multiplier, n_items, usage_percent, recommended
    slots: DataFrame | None = None  # dim, slot, avg_views, multiplier, label
    optimal: DataFrame | None = None  # day, hour, description, multiplier
    elements: DataFrame | None = None  # category, rank, element, lift, sample_size, avoid
    patterns: DataFrame | None = None  # pattern, lift, sample_size
    words: DataFrame | None = None  # word, multiplier, band, rank
    n_items: int | None = None
    version: str | None = None


def resolve_type(name: Column) -> Column:
    """Valid type, alias or the default."""
    low = F.lower(F.coalesce(name, F.lit("")))
    aliases = F.create_map(*[F.lit(x) for kv in P.TYPE_ALIASES.items() for x in kv])
    return F.when(low.isin(P.TYPES), low).otherwise(F.coalesce(F.try_element_at(aliases, low), F.lit(P.DEFAULT_TYPE)))


def validate(requests: DataFrame) -> DataFrame:
    """Clean the inputs; ``reject_reason`` is null for usable requests."""
    cleaned = requests.withColumns(
        {
            "topic": sanitize(F.col("topic"), P.MAX_TOPIC),
            "angle": sanitize(F.col("angle"), P.MAX_ANGLE),
            "audience": sanitize(F.col("audience"), P.MAX_AUDIENCE),
        }
    )
    reason = F.when(F.col("topic") == "", "Topic is required and must be a non-empty string").when(
        (F.coalesce("type", F.lit("")) != "") & ~F.col("type").isin(P.TYPES),
        f"Invalid content type. Must be one of: {', '.join(P.TYPES)}",
    )
    return cleaned.withColumns(
        {
            "reject_reason": reason,
            "type": F.when(F.coalesce("type", F.lit("")) == "", F.lit(P.DEFAULT_TYPE)).otherwise(F.col("type")),
            "angle": F.when(F.col("angle") != "", F.col("angle")),
            "audience": F.when(F.col("audience") != "", F.col("audience")).otherwise(F.lit(P.DEFAULT_AUDIENCE)),
        }
    )


def validate_generation(rows: DataFrame) -> DataFrame:
    """Reject saved generations with a bad type or a missing body."""
    reason = F.when(
        ~F.coalesce(F.col("type"), F.lit("")).isin("ideas", "recommendation"),
        'Invalid type. Must be "ideas" or "recommendation".',
    ).when(F.col("request").isNull() | F.col("response").isNull(), "Both request and response fields are required.")
    return rows.withColumn("reject_reason", reason)


def recent_generations(rows: DataFrame, kind: str | None = None, n: int = 50) -> DataFrame:
    rows = rows if kind is None else rows.filter(F.col("type") == kind)
    return rows.orderBy(F.desc("saved_at"), "id").limit(n)


def with_dimension(requests: DataFrame) -> DataFrame:
    """Attach the template row of the type (five rows, always broadcast)."""
    return requests.join(F.broadcast(P.type_dimension(requests.sparkSession)), "type")


def fill_template(template: Column, topic: Column, modifier: Column) -> Column:
    for name, value in [
        ("{dish}", topic), ("{dish_telugu}", F.concat(topic, F.lit(" (తెలుగు)"))), ("{topic}", topic),
        ("{topic_telugu}", F.concat(topic, F.lit(" తెలుగు"))), ("{modifier}", modifier), ("{location}", topic),
        ("{number}", F.lit("10")),
    ]:
        template = F.replace(template, F.lit(name), value)
    return template


def titles(topic: Column, angle: Column, templates: Column) -> Column:
    modifier = F.coalesce(angle, F.lit(P.DEFAULT_MODIFIER))
    return F.struct(
        F.concat(topic, F.lit(" | "), modifier).alias("english"),
        F.concat(topic, F.lit(f" | {P.DEFAULT_TELUGU_WORD}")).alias("telugu"),
        fill_template(F.get(templates, F.lit(0)), topic, modifier).alias("combined"),
        F.lit("above-average").alias("predicted_ctr"),
        F.transform(F.slice(templates, 2, 2), lambda t: fill_template(t, topic, modifier)).alias("alternatives"),
    )


def image_text(topic: Column) -> Column:
    return F.get(F.split(F.upper(topic), " "), F.lit(0))


def tag_groups(topic: Column, kind: Column) -> dict[str, Column]:
    low = F.lower(topic)
    suffix = F.when(kind == "recipe", "recipe").otherwise("video")
    return {
        "primary": F.concat(F.array(low, F.concat_ws(" ", low, suffix)), F.col("tags_primary")),
        "secondary": F.concat(
            F.array(F.concat(low, F.lit(" telugu")), F.concat(F.lit("how to "), low)), F.col("tags_secondary")
        ),
        "telugu": F.col("tags_telugu"),
        "longtail": F.concat(
            F.array(F.concat(low, F.lit(" in telugu")), F.concat(low, F.lit(" for beginners"))), F.col("tags_longtail")
        ),
        "brand": F.array().cast(TEXTS),
    }


def tag_struct(groups: dict[str, Column]) -> Column:
    text = F.array_join(F.concat(*groups.values()), ", ")
    return F.struct(
        *[col.alias(name) for name, col in groups.items()],
        text.alias("full"),
        F.length(text).alias("characters"),
        F.least(F.lit(100.0), F.length(text) / P.TAG_LIMIT * 100).alias("utilization"),
    )


def complete_tags(given: Column) -> Column:
    """Given tag groups, missing ones from the type defaults."""
    none = F.array().cast(TEXTS)
    groups = {
        g: F.coalesce(given.getField(g), F.col(f"tags_{g}")) for g in ("primary", "secondary", "telugu", "longtail")
    }
    return tag_struct({**groups, "brand": F.coalesce(given.getField("brand"), none)})


def with_insights(rows: DataFrame, insights: Insights) -> DataFrame:
    """Add the small insight lists as columns (scalar subqueries, run once).

    ``_best``: best slot, ``_days``: days by multiplier, ``_open`` and
    ``_full``: lower-case topics with high opportunity and saturated ones.
    """
    best, days = F.lit(None).cast("struct<day:string,hour:int,multiplier:double>"), F.array().cast(TEXTS)
    if insights.optimal is not None and insights.slots is not None:
        best = insights.optimal.select(F.struct("day", "hour", "multiplier")).scalar()
        days = insights.slots.filter("dim = 'day'").agg(  # at most 7 days
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("multiplier")).alias("x"), "slot"))), lambda s: s["slot"]
            )
        ).scalar()

    def topics(table: DataFrame | None) -> Column:
        # the lists were ranked and cut where they were made; all of them count here
        if table is None:
            return F.array().cast(TEXTS)
        return table.agg(F.array_sort(F.collect_set(F.lower("topic")))).scalar()

    return rows.withColumns(
        {"_best": best, "_days": days, "_open": topics(insights.gaps), "_full": topics(insights.saturated)}
    )


def posting(n_items: int | None = None) -> Column:
    """Best slot and two other days, or the default slot."""
    default = F.struct(
        F.lit(P.DEFAULT_POSTING["best_day"]).alias("best_day"), F.lit(P.DEFAULT_POSTING["best_time"]).alias("best_time"),
        F.array(*[F.lit(x) for x in P.DEFAULT_POSTING["alternatives"]]).alias("alternatives"),
        F.lit(P.DEFAULT_POSTING["reasoning"]).alias("reasoning"),
    )
    day, multiplier = F.col("_best.day"), F.col("_best.multiplier")
    time = F.concat(F.col("_best.hour").cast("string"), F.lit(":00 IST"))
    others = F.slice(F.array_except(F.col("_days"), F.array(day)), 1, 2)
    why = F.concat(
        F.lit(f"Based on analysis of {n_items} videos, "), day, F.lit(" at "), time, F.lit(" has "),
        F.format_string("%.1f", F.round(multiplier, 1)), F.lit("x average performance"),
    )
    known = F.struct(
        day.alias("best_day"), time.alias("best_time"),
        F.transform(others, lambda d: F.concat(d, F.lit(" "), time)).alias("alternatives"), why.alias("reasoning"),
    )
    return F.when(day.isNotNull() & F.col("_best.hour").isNotNull(), known).otherwise(default)


def topic_flags(topic: Column) -> tuple[Column, Column]:
    """(saturated, high opportunity): the topic contains a listed one."""
    low = F.lower(topic)

    def hit(listed: str) -> Column:
        return F.exists(listed, lambda t: F.contains(low, t))

    return hit("_full"), hit("_open")


def prediction(topic: Column, kind: Column, version: str | None = None) -> Column:
    saturated, open_topic = topic_flags(topic)
    good = F.array_compact(
        F.array(
            F.when(open_topic, F.lit("Topic has high opportunity score (low competition, good views)")),
            F.lit("Bilingual title format reaches wider audience"),
            F.lit("Thumbnail follows high-performing patterns"),
            F.when(kind == "recipe", F.lit("Recipe content has consistent audience demand")),
        )
    )
    risk = F.array_compact(F.array(F.when(saturated, F.lit("Topic is saturated - need unique angle to stand out"))))
    return F.struct(
        F.struct(F.col("views_low").alias("low"), F.col("views_medium").alias("medium"), F.col("views_high").alias("high")).alias(
            "expected_views"
        ),
        F.lit("medium" if version else "low").alias("confidence"),
        good.alias("positive_factors"),
        risk.alias("risk_factors"),
    )


def one_plan(production: DataFrame) -> DataFrame:
    """The plan of each known type; two plans of one type are an error, so there are at most ``len(P.TYPES)`` rows."""
    plan = F.struct(*[c for c in production.columns if c != "type"])
    kind = production.select(plan.alias("p")).schema["p"].dataType
    twice = F.raise_error(F.lit("two production plans for one type")).cast(kind)
    rows = production.filter(F.col("type").isin(P.TYPES)).groupBy("type")
    return rows.agg(F.first(plan).alias("_plan"), F.count(F.lit(1)).alias("_n")).select(
        "type", F.when(F.col("_n") == 1, F.col("_plan")).otherwise(twice).alias("_plan")
    ).select("type", "_plan.*")


def recommend(
    requests: DataFrame, insights: Insights, production: DataFrame | None = None, model: str = "template"
) -> DataFrame:
    """One wide recommendation row per valid request."""
    rows = with_insights(with_dimension(requests), insights)
    topic, kind = F.col("topic"), F.col("type")
    image = F.struct(image_text(topic).alias("text"), *[F.col(f) for f in P.IMAGE_FIELDS])
    out = rows.select(
        "request_id", "topic", "type", "angle", "audience",
        titles(topic, F.col("angle"), F.col("templates")).alias("titles"),
        image.alias("image"),
        tag_struct(tag_groups(topic, kind)).alias("tags"),
        posting(insights.n_items).alias("posting"),
        prediction(topic, kind, insights.version).alias("prediction"),
        F.struct(
            F.lit(model).alias("model"), F.lit(insights.version).alias("insights_version"),
            F.lit(model == "template").alias("fallback_used"),
        ).alias("metadata"),
    )
    if production is not None:
        out = out.join(F.broadcast(one_plan(production)), "type", "left")
    return out


def fill_sections(parsed: DataFrame, base: DataFrame, sections: list[str], key: str = "request_id") -> DataFrame:
    """Given sections of a response, the template's where missing."""
    given = parsed.select(key, *[F.col(s).alias(f"_{s}") for s in sections])
    rows = base.join(given, key, "left")
    return rows.withColumns({s: F.coalesce(f"_{s}", s) for s in sections}).drop(*[f"_{s}" for s in sections])


def _plain(number: Column) -> Column:
    """Number without trailing zeros, at most two digits."""
    return F.regexp_replace(number.cast("decimal(20,2)").cast("string"), r"\.?0+$", "")


def _ideas(insights: Insights) -> DataFrame:
    """Up to 5 ideas: best gaps first, padded with keywords."""
    keywords = insights.keywords.withColumn("_k", F.struct(-F.col("multiplier"), F.col("keyword")))
    listed = keywords.orderBy("_k").limit(5)
    top_keywords = listed.agg(F.transform(F.array_sort(F.collect_list("_k")), lambda k: k["keyword"])).scalar()
    best_format = (
        insights.formats.filter("recommended").agg(F.min_by("format", F.struct(-F.col("multiplier"), F.col("format")))).scalar()
    )
    angle = F.when(
        best_format.isNotNull(), F.concat(best_format, F.lit(" style — low competition, high viewer interest"))
    ).otherwise(F.lit("Underserved topic with high viewer demand"))
    gap_rows = (
        insights.gaps.orderBy(F.desc("opportunity_score"), "topic").limit(5)
        .withColumn("_top", top_keywords)
        .select(
            F.lit(0).alias("_src"), F.struct((-F.col("opportunity_score")).alias("a"), F.col("topic").alias("b")).alias("_o"),
            "topic", angle.alias("angle"),
            F.concat(
                F.lit("Opportunity score of "), F.format_string("%.0f", F.round("opportunity_score", 0)), F.lit(" with only "),
                F.col("n_items").cast("string"), F.lit(" existing videos and "), _plain(F.col("avg_vps")), F.lit(" avg views."),
            ).alias("why"),
            F.col("opportunity_score").alias("score"), F.slice("_top", 1, 3).alias("keywords"),
        )
    )
    times = F.format_string("%.1f", F.round("multiplier", 1))
    others = F.slice(F.filter("_top", lambda k: k != F.col("keyword")), 1, 2)
    keyword_rows = listed.withColumn("_top", top_keywords).select(
        F.lit(1).alias("_src"), F.struct((-F.col("multiplier")).alias("a"), F.col("keyword").alias("b")).alias("_o"),
        F.col("keyword").alias("topic"),
        F.concat(F.lit("High-value keyword with "), times, F.lit("x view multiplier")).alias("angle"),
        F.concat(
            F.lit('Keyword "'), F.col("keyword"), F.lit('" drives '), times, F.lit("x more views but is only used in "),
            F.format_string("%.0f", F.round("usage_percent", 0)), F.lit("% of videos."),
        ).alias("why"),
        F.least(F.lit(100.0), F.col("multiplier") * 20).alias("score"),
        F.concat(F.array("keyword"), others).alias("keywords"),
    )
    return gap_rows.unionByName(keyword_rows).orderBy("_src", "_o").limit(5)


def idea_rows(requests: DataFrame, insights: Insights) -> DataFrame:
    """Five ideas per request; the request only sets the suggested type."""
    ideas = _ideas(insights)
    packed = ideas.agg(F.array_sort(F.collect_list(F.struct("_src", "_o", "topic", "angle", "why", "score", "keywords")))).scalar()
    return requests.select("request_id", F.col("type").alias("suggested_type"), F.posexplode(packed).alias("_i", "_x")).select(
        "request_id", (F.col("_i") + 1).alias("rank"), F.col("_x.topic").alias("topic"), F.col("_x.angle").alias("angle"),
        F.col("_x.why").alias("why"), F.round("_x.score", 3).alias("score"), "suggested_type",
        F.col("_x.keywords").alias("keywords"),
    )


def digest(insights: Insights) -> DataFrame:
    """The ranked entries a recommendation shows, as labelled rows."""
    def part(df: DataFrame, section: str, n: int, order: list[Column], label: Column, by: str | None = None) -> DataFrame:
        w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(section))
        ranked = df.withColumn("_label", label).withColumn("_rank", F.row_number().over(w.orderBy(*order)))
        name = F.concat(F.lit(f"{section}:"), F.col(by)) if by else F.lit(section)
        return ranked.filter(F.col("_rank") <= n).select(name.alias("section"), F.col("_rank").alias("rank"), F.col("_label").alias("label"))

    def x(col: str, digits: int = 1) -> Column:
        return F.format_string(f"%.{digits}f", F.round(col, digits))

    parts = []
    if insights.elements is not None:
        good = insights.elements.filter(~F.col("avoid"))
        label = F.concat(F.col("element"), F.lit(" ("), x("lift"), F.lit("x performance)"))
        parts.append(part(good, "element", 3, [F.col("rank")], label, "category"))
    if insights.words is not None:
        high = insights.words.filter("band = 'high'")
        parts.append(part(high, "power_word", 5, [F.col("rank")], F.concat(F.col("word"), F.lit(" ("), x("multiplier"), F.lit("x)"))))
    if insights.patterns is not None:
        parts.append(part(insights.patterns, "pattern", 3, [F.desc("lift"), F.col("pattern")], F.col("pattern")))
    if insights.gaps is not None:
        label = F.concat(F.col("topic"), F.lit(" (opportunity score: "), x("opportunity_score", 0), F.lit(")"))
        parts.append(part(insights.gaps, "high_opportunity", 3, [F.desc("opportunity_score"), F.col("topic")], label))
    if insights.saturated is not None:
        label = F.concat(F.col("topic"), F.when(F.col("content_share") > 20, F.lit(" (high competition)")).otherwise(F.lit(" (medium competition)")))
        parts.append(part(insights.saturated, "saturated", 3, [F.desc("opportunity_score"), F.col("topic")], label))
    if insights.keywords is not None:
        label = F.concat(
            F.col("keyword"), F.lit(" ("), x("multiplier"), F.lit("x views, used "), F.col("usage_count").cast("string"),
            F.lit(" times, "), x("usage_percent"), F.lit("% usage)"),
        )
        parts.append(part(insights.keywords, "keyword", 15, [F.desc("multiplier"), F.col("keyword")], label))
    if insights.formats is not None:
        label = F.concat(
            F.col("format"), F.lit(": "), x("multiplier"), F.lit("x views ("), F.col("n_items").cast("string"),
            F.lit(" videos, "), x("usage_percent"), F.lit("% of content)"),
        )
        parts.append(part(insights.formats, "format", 10, [F.desc("multiplier"), F.col("format")], label))
    if insights.optimal is not None:
        label = F.concat(
            F.col("day"), F.lit(" at "), F.col("hour").cast("string"), F.lit(":00 IST ("), x("multiplier"), F.lit("x performance)")
        )
        parts.append(insights.optimal.select(F.lit("optimal_posting").alias("section"), F.lit(1).alias("rank"), label.alias("label")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def insights_version(documents: DataFrame) -> DataFrame:
    """Version of the stored insights: when the image document was made."""
    made = F.max(F.when(F.col("insight_type") == "thumbnails", F.col("generated_at")))
    return documents.agg(made.alias("version"), (F.count(F.lit(1)) > 0).alias("has_insights"))
