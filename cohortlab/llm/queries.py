"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import adaptive_rules, byte_bpe, decontaminate, fuzzy_lines, jaccard_join, language_id, merkle, packing, pii_boost, quality_nbsvm, quote_links, token_store, twins, vector_codes
from cohortlab.llm.common import held_out, sized, stage, table
from cohortlab.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


@query("op1_token_store")
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digests(token_store.write(table(spark, sf_dir, "documents")))


@query("op3_decontaminate", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM items), spots AS (
  SELECT d.doc_id, s.n, u.i, array_to_string(list_slice(d.w, u.i, u.i + s.n - 1), ' ') AS g
  FROM d, sizes AS s, unnest(range(1, len(d.w) - s.n + 2)) AS u(i)
  WHERE len(d.w) >= s.n
), found AS (SELECT spots.doc_id, spots.i, spots.n, items.item_id FROM spots JOIN items USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p.k) AS n_hit FROM found, unnest(range(i, i + n)) AS p(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_adaptive_rules")
def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.verdicts(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    return language_id.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


@query("op6_quality_nbsvm")
def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = stage(table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "quality"), "labels")
    # 16 bytes a row: broadcast while small, so that texts are not shuffled; else joined by shuffle
    model = quality_nbsvm.fit(docs.select("doc_id", "text").join(sized(labels, 16), "doc_id"))
    scored = quality_nbsvm.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op2_fuzzy_lines")
def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.dedup(docs).select(
        "doc_id",
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op4_quote_links")
def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quote_links.threads(table(spark, sf_dir, "conversations"))
    return told.withColumn("text_sha256", F.sha2("text", 256)).drop("text", "role")


@query("op9_pii_boost")
def op9_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_boost.report(docs, pii_boost.fit(docs))


@query("op12_merkle_manifest", """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS r(i)
), fields AS (
  SELECT doc_id, lang, n_chars,
    [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN [CAST(doc_id AS VARCHAR), source, lang]] AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
    list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS digits
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
    CASE WHEN n_chars IS NOT NULL
        AND xor(list_reduce(list_prepend(4294967295, digits), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
      THEN sha256(array_to_string(head, '') || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || body) END AS changed
  FROM fields, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), nodes AS (
  SELECT lang, 0 AS lev, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT lang, lev + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lev, pos // 2, n
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS lev, pos, digest, n FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lev, pos // 2, n
), heights AS (SELECT DISTINCT lang, lev FROM nodes WHERE n > 1), top_heights AS (SELECT DISTINCT lev FROM top WHERE n > 1),
below AS (
  SELECT l.lang, l.pos, h.lev, (l.pos >> h.lev) % 2 AS odd, s.digest AS other
  FROM leaves AS l JOIN heights AS h ON l.lang IS NOT DISTINCT FROM h.lang
  LEFT JOIN nodes AS s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lev = h.lev AND s.pos = xor(l.pos >> h.lev, 1)
), above AS (
  SELECT r.lang, 1000 + h.lev AS lev, (r.pos >> h.lev) % 2 AS odd, s.digest AS other
  FROM subroots AS r CROSS JOIN top_heights AS h LEFT JOIN top AS s ON s.lev = h.lev AND s.pos = xor(r.pos >> h.lev, 1)
), path AS (
  SELECT lang, pos, list(CASE WHEN other IS NULL THEN '-' WHEN odd = 1 THEN 'L' || other ELSE 'R' || other END ORDER BY lev) AS steps
  FROM (SELECT * FROM below UNION ALL SELECT l.lang, l.pos, a.lev, a.odd, a.other FROM leaves AS l JOIN above AS a ON l.lang IS NOT DISTINCT FROM a.lang)
  GROUP BY lang, pos
), proven AS (
  SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    sha256(array_to_string([s[2:] FOR s IN coalesce(p.steps, [])], '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(l.changed, l.leaf), coalesce(p.steps, [])), lambda d, s: CASE s[1]
      WHEN 'L' THEN sha256(s[2:] || d) WHEN 'R' THEN sha256(d || s[2:]) ELSE sha256(d) END) AS folded_root
  FROM leaves AS l JOIN subroots AS r ON l.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN path AS p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM proven
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"])
    found = merkle.manifest(docs.withColumn("_changed", F.when(tampered & F.col("n_chars").isNotNull(), changed)), carry=["_changed"])
    found = merkle.fold(found.withColumn("_claimed", F.coalesce("_changed", "leaf")), "_claimed")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_vector_codes", twins.vector_codes())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))[1]
