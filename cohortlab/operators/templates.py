"""Template dimensions of the recommendation job.

The production plan of a type (segments, shots, scripts) is a table the caller
brings: ``recommend(..., production=df)`` with (type, production).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Content types, aliases and defaults.
TYPES = ["recipe", "vlog", "tutorial", "review", "challenge"]
TYPE_ALIASES = {
    "cooking": "recipe", "cook": "recipe", "food": "recipe", "travel": "vlog", "daily": "vlog", "howto": "tutorial",
    "how-to": "tutorial", "guide": "tutorial", "unboxing": "review",
}
DEFAULT_TYPE = "recipe"
DEFAULT_AUDIENCE = "Telugu audience"
MAX_TOPIC, MAX_ANGLE, MAX_AUDIENCE = 200, 500, 200
TAG_LIMIT = 500

# Title templates; the first is the primary one, the next two the alternatives.
TITLE_TEMPLATES = {
    "recipe": [
        "{dish} Recipe | {dish_telugu} | {modifier}",
        "{modifier} {dish} | {dish_telugu} | Restaurant Style",
        "SECRET {dish} Recipe | {dish_telugu} రహస్యం",
    ],
    "vlog": [
        "My {topic} Experience | {topic_telugu}",
        "A Day in {location} | {topic_telugu}",
        "{topic} Vlog | {topic_telugu} | Telugu",
    ],
    "tutorial": [
        "How to {topic} | {topic_telugu} | Complete Guide",
        "{topic} for Beginners | {topic_telugu}",
        "{topic} Tutorial | {topic_telugu} | Step by Step",
    ],
    "review": [
        "{topic} Review | {topic_telugu} | Honest Opinion",
        "Is {topic} Worth It? | {topic_telugu}",
        "{topic} - Complete Review | {topic_telugu}",
    ],
    "challenge": [
        "{topic} Challenge | {topic_telugu}",
        "I Tried {topic} | {topic_telugu} | Challenge",
        "{number} {topic} Challenge | {topic_telugu}",
    ],
}
DEFAULT_MODIFIER = "SECRET"
DEFAULT_TELUGU_WORD = "రహస్యం"

# Default tags per type and group.
DEFAULT_TAGS = {
    "recipe": {
        "primary": ["recipe", "cooking", "food"],
        "secondary": ["homemade", "easy recipe", "how to cook"],
        "telugu": ["వంటకం", "తెలుగు వంట", "రెసిపీ"],
        "longtail": ["easy recipe at home", "step by step recipe"],
    },
    "vlog": {
        "primary": ["vlog", "telugu vlog", "daily vlog"],
        "secondary": ["lifestyle", "day in my life"],
        "telugu": ["వ్లాగ్", "తెలుగు వ్లాగ్", "రోజువారీ"],
        "longtail": ["telugu vlogger", "indian vlogger"],
    },
    "tutorial": {
        "primary": ["tutorial", "how to", "guide"],
        "secondary": ["learn", "tips", "beginner"],
        "telugu": ["ట్యుటోరియల్", "నేర్చుకోండి", "గైడ్"],
        "longtail": ["complete guide", "step by step tutorial"],
    },
    "review": {
        "primary": ["review", "honest review", "opinion"],
        "secondary": ["unboxing", "first look", "worth it"],
        "telugu": ["రివ్యూ", "అభిప్రాయం"],
        "longtail": ["honest opinion", "should you buy"],
    },
    "challenge": {
        "primary": ["challenge", "fun", "entertainment"],
        "secondary": ["trying", "first time", "experiment"],
        "telugu": ["ఛాలెంజ్", "వినోదం"],
        "longtail": ["challenge video", "funny challenge"],
    },
}

# Expected view range per type (low, medium, high).
VIEW_RANGES = {
    "recipe": (10000, 50000, 200000),
    "vlog": (5000, 25000, 100000),
    "tutorial": (8000, 40000, 150000),
    "review": (5000, 30000, 120000),
    "challenge": (15000, 75000, 300000),
}

# Image layout per type.
IMAGE_FIELDS = [
    "layout", "face_required", "face_expression", "face_position", "face_size", "eye_contact", "visual",
    "visual_position", "text_position", "text_color", "text_style", "arrow_to", "border_color", "background", "accent",
]
IMAGE_SPECS = {
    "recipe": [
        "split-composition", True, "surprised or excited", "right-third", "large", True, "food-close-up",
        "left-center", "top-left", "#FFFF00", "bold-with-outline", "food", "#FFFFFF", "#FF6B35", "#FFFF00",
    ],
    "vlog": [
        "full-frame", True, "happy or curious", "center", "large", True, "location-background",
        "full-frame", "top-center", "#FFFFFF", "bold-shadow", None, "#FFFFFF", "#3498DB", "#FFFFFF",
    ],
    "tutorial": [
        "instructional", False, "focused", "corner", "medium", False, "subject-matter",
        "center", "top-left", "#FFFFFF", "bold", "subject", None, "#2C3E50", "#E74C3C",
    ],
    "review": [
        "product-focus", True, "thinking or surprised", "right-third", "medium", True, "product",
        "left-center", "top-left", "#FFFF00", "bold", "product", "#FFFF00", "#9B59B6", "#FFFF00",
    ],
    "challenge": [
        "dramatic", True, "shocked or excited", "center", "large", True, "challenge-items",
        "around-face", "top-center", "#FF0000", "bold-shadow", None, "#FF0000", "#E74C3C", "#FFFF00",
    ],
}

# Posting slot used without timing insights.
DEFAULT_POSTING = {
    "best_day": "Saturday",
    "best_time": "18:00 IST",
    "alternatives": ["Sunday 12:00 IST", "Friday 19:00 IST"],
    "reasoning": "Weekend evenings typically have highest Telugu audience engagement",
}


def type_dimension(spark: SparkSession) -> DataFrame:
    """One row per content type with its templates, tags, range and image spec."""
    image = ", ".join(f"{f} {'BOOLEAN' if f in ('face_required', 'eye_contact') else 'STRING'}" for f in IMAGE_FIELDS)
    rows = [
        (
            t, TITLE_TEMPLATES[t], *[DEFAULT_TAGS[t][g] for g in ("primary", "secondary", "telugu", "longtail")],
            *VIEW_RANGES[t], *IMAGE_SPECS[t],
        )
        for t in TYPES
    ]
    return spark.createDataFrame(
        rows,
        "type STRING, templates ARRAY<STRING>, tags_primary ARRAY<STRING>, tags_secondary ARRAY<STRING>, "
        "tags_telugu ARRAY<STRING>, tags_longtail ARRAY<STRING>, views_low BIGINT, views_medium BIGINT, "
        f"views_high BIGINT, {image}",
    )
