"""The driver's queries for the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, exact_dedup, filter_audit, jaccard, language_id, lm_score, packing, pii, quality, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the surrogates. A real run takes it from its secret store.
PII_KEY = "not-a-real-secret"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, "n_entities")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.Vocabulary.public())


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    template = chat.Template()
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.segments(turns, template), template)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scored(_table(spark, sf_dir, "documents"))
    per_word = F.round(F.col("log_score") / F.col("n_words"), 6)
    return out.select("doc_id", "n_words", F.when(F.col("n_words") > 0, per_word).alias("log_score_per_word"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id get a prediction, are never learned from, and have a null ``held_out``."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    profiles = language_id.learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = language_id.identified(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_source_divergence_audit": op11_source_divergence_audit,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_exact_dedup": op13_exact_dedup,
}

#: Shingles as in textbatch: lower case, runs of ASCII letters, digits and non-ASCII characters, five words, or all words of a shorter text.
_SHINGLES = """
{name}_words AS (
  SELECT {key}, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL
),
{name} AS (
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM {name}_words
)"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": "WITH "
    + _SHINGLES.format(name="d", key="doc_id", table="documents")
    + ","
    + _SHINGLES.format(name="b", key="item_id", table="benchmark")
    + """,
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
short AS (SELECT DISTINCT item_id, array_to_string(w, ' ') AS words FROM b_words WHERE len(w) BETWEEN 1 AND 4),
hits AS (
  SELECT doc_id, item_id, count(*) AS shared_shingles FROM d JOIN b USING (shingle) WHERE item_id NOT IN (SELECT item_id FROM short) GROUP BY doc_id, item_id
  UNION ALL SELECT DISTINCT doc_id, item_id, 1 FROM d_words JOIN short ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || words || ' ')
)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles::DOUBLE / item_shingles AS containment
FROM hits JOIN n USING (item_id) WHERE shared_shingles >= 0.8 * item_shingles""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d),
r AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM r""",
    "op6_ngram_jaccard_join": "WITH RECURSIVE "
    + _SHINGLES.format(name="d", key="doc_id", table="documents")
    + """,
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = least.doc_id)::BIGINT AS n_links FROM least""",
    "op8_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
t AS (
  SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
    length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) AS inside,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(said, '' ORDER BY nth)) AS turns_sha256,
  sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY nth)) AS loss_sha256,
  sum(length('### : </turn>') + 1 + length(role) + inside)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'assistant' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE before = 'system' AND role = 'user' END)
    AND arg_max(role, nth) IN ('user', 'assistant') AS valid
FROM t GROUP BY conv_id""",
    "op9_lm_scoring": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, i, w[i] AS w2, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w0 FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
n1 AS (SELECT w2, count(*) AS c FROM g GROUP BY ALL), o1 AS (SELECT r, w2, count(*) AS c FROM g GROUP BY ALL),
n2 AS (SELECT w1, w2, count(*) AS c FROM g WHERE i > 1 GROUP BY ALL), o2 AS (SELECT r, w1, w2, count(*) AS c FROM g WHERE i > 1 GROUP BY ALL),
n3 AS (SELECT w0, w1, w2, count(*) AS c FROM g WHERE i > 2 GROUP BY ALL), o3 AS (SELECT r, w0, w1, w2, count(*) AS c FROM g WHERE i > 2 GROUP BY ALL),
m AS (SELECT (SELECT count(*) FROM g) AS words),
s AS (
  SELECT g.r, g.i, least(g.i, 3) AS most, greatest(m.words - len(t.w), 1) AS rest, n1.c - o1.c AS c1, coalesce(n2.c - o2.c, 0) AS c2, coalesce(n3.c - o3.c, 0) AS c3
  FROM g JOIN t USING (r) CROSS JOIN m JOIN n1 USING (w2) JOIN o1 ON o1.r = g.r AND o1.w2 = g.w2
  LEFT JOIN n2 ON n2.w1 = g.w1 AND n2.w2 = g.w2 LEFT JOIN o2 ON o2.r = g.r AND o2.w1 = g.w1 AND o2.w2 = g.w2
  LEFT JOIN n3 ON n3.w0 = g.w0 AND n3.w1 = g.w1 AND n3.w2 = g.w2 LEFT JOIN o3 ON o3.r = g.r AND o3.w0 = g.w0 AND o3.w1 = g.w1 AND o3.w2 = g.w2
),
b AS (SELECT s.*, p.c1 AS b1, p.c2 AS b2 FROM s LEFT JOIN s p ON p.r = s.r AND p.i = s.i - 1),
l AS (
  SELECT r, sum(CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / b2) WHEN c2 > 0 THEN ln(c2::DOUBLE / b1) + (most - 2) * ln(0.4)
    WHEN c1 > 0 THEN ln(c1::DOUBLE / rest) + (most - 1) * ln(0.4) ELSE most * ln(0.4) - ln(rest::DOUBLE) END) AS score
  FROM b GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN round(score / len(w), 6) END AS log_score_per_word
FROM t LEFT JOIN l USING (r)""",
    "op11_source_divergence_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (coalesce(n.n, 0) + v.v) AS p, 1 + 1000000000 * (k.c + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200""",
    "op12_filter_interaction_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(m.doc_id > first, false) AS e
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id
),
cell AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS filter FROM o, range(1, 6) AS r(step)),
r AS (
  SELECT part, filter_order, step, filter, failed, n, good, toxic, contains(failed, filter) AS fails,
    length(translate(failed, before, '')) < length(failed) AS earlier
  FROM cell, s
),
a AS (
  SELECT part, filter_order, step::INTEGER AS step, filter, sum(CASE WHEN NOT earlier AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT earlier AND fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN earlier AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT earlier AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT earlier AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM a""",
    "op13_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)""",
}
