"""Input frames derived from the given tables, and the same derivations as SQL.

``documents`` plays candidate rows: gold spans come from one detector pattern and
predictions from another, so both sides disagree in natural ways.  ``orders`` joined
to ``customer`` plays decided spans with three-class scores.  ``conversations`` plays
turns, also with capitalised or long words turned into ``<TAG>`` placeholders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import probability as P
from ..functions import tokens as T
from ..functions.text import SPACE_CLASS, TOKEN_PATTERN
from ..plans.layout import load, load_text

GOLD_PATTERN = (
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\+?[0-9][0-9() \-]{7,}[0-9]"
)
PRED_PATTERN = r"[A-Za-z0-9._\-]*@[A-Za-z0-9.\-]+|[0-9][0-9.\-]{3,}[0-9]|\p{Lu}\p{L}{11,}"


# What Spark searches: the same matches, but a run of letters that no @ follows is not gone back over, and a
# text without an @ is not searched for addresses at all.
_SEARCHED = {
    side: (pattern.replace(mail, f"{mail}+", 1), pattern.split("|", 1)[1])
    for side, pattern, mail in (("gold", GOLD_PATTERN, r"[A-Za-z0-9._%+\-]+"), ("pred", PRED_PATTERN, r"[A-Za-z0-9._\-]*"))
}


# --- documents as candidate rows -------------------------------------------------------
def documents(spark: SparkSession, root: str) -> DataFrame:
    return load_text(spark, root, "documents", "doc_id", "text", "lang", "source").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("subject"),
        F.col("source").alias("speaker_role"))


def tokenized(spark: SparkSession, root: str) -> DataFrame:
    return T.with_tokens(documents(spark, root))


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """``id, subject, speaker_role, text, tokens, gold_*, pred_*``."""
    df = documents(spark, root).withColumn("tokens", F.expr(T.tokenize_sql("text")))
    for side, (full, plain) in _SEARCHED.items():
        spans = F.when(F.contains("text", F.lit("@")), T.regex_spans("text", full)).otherwise(T.regex_spans("text", plain))
        df = df.withColumn(f"{side}_chars", spans)
        df = df.withColumn(f"{side}_labels", L.labels_of_text("text", "tokens", f"{side}_chars"))
    return df


def _matches(prefix: str, pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""
{prefix}_hits AS (
  SELECT CAST({key} AS VARCHAR) AS id, regexp_extract_all({text}, '{pattern}') AS hits,
         string_split_regex({text}, '{pattern}') AS gaps
  FROM {source} WHERE regexp_matches({text}, '{pattern}')),
{prefix}_chars AS (
  SELECT id, pos, h AS txt, e - length(h) AS s, e FROM (
    SELECT id, pos, h, CAST(sum(length(g) + length(h)) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS e FROM (
      SELECT id, unnest(hits) AS h, unnest(gaps[1:len(hits)]) AS g, generate_subscripts(hits, 1) AS pos
      FROM {prefix}_hits)))"""


def tokens_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""
chunks AS (
  SELECT CAST({key} AS VARCHAR) AS id, regexp_extract_all({text}, '[{SPACE_CLASS}]*(?:{TOKEN_PATTERN})') AS cs FROM {source}),
tok AS MATERIALIZED (
  SELECT id, pos - 1 AS i, token, e - length(token) AS s, e FROM (
    SELECT id, pos, regexp_extract(c, '{TOKEN_PATTERN}') AS token,
           CAST(sum(length(c)) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS e
    FROM (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM chunks)))"""


def _painted(prefix: str) -> str:
    """Merged character spans painted on tokens, and the token spans they form."""
    return f"""
{prefix}_marked AS (
  SELECT id, s, e, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e) AS k
  FROM (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
        FROM {prefix}_chars)),
{prefix}_merged AS (SELECT id, k, min(s) AS s, max(e) AS e FROM {prefix}_marked GROUP BY id, k),
{prefix}_lab AS MATERIALIZED (
  SELECT id, i, CASE WHEN i = fi THEN 'B' ELSE 'I' END AS lab FROM (
    SELECT t.id, t.i, min(t.i) OVER (PARTITION BY t.id, m.k) AS fi,
           row_number() OVER (PARTITION BY t.id, t.i ORDER BY m.s DESC) AS rn
    FROM tok t JOIN {prefix}_merged m ON t.id = m.id AND t.s < m.e AND t.e > m.s) WHERE rn = 1),
{prefix}_spans AS MATERIALIZED (
  SELECT id, min(i) AS s, max(i) + 1 AS e FROM (
    SELECT id, i, sum(CASE WHEN lab = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM {prefix}_lab)
  GROUP BY id, g)"""


CANDIDATES_SQL = ",".join([
    tokens_sql(), _matches("gold", GOLD_PATTERN), _matches("pred", PRED_PATTERN), _painted("gold"), _painted("pred"),
    """
rowstat AS MATERIALIZED (
  SELECT d.id, d.subject, d.speaker_role, coalesce(n, 0) AS n_tokens, coalesce(g, 0) AS gold, coalesce(p, 0) AS pred,
         coalesce(tp, 0) AS tp
  FROM (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS subject, source AS speaker_role FROM documents) d
  LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) a ON a.id = d.id
  LEFT JOIN (SELECT id, count(*) AS g FROM gold_spans GROUP BY id) b ON b.id = d.id
  LEFT JOIN (SELECT id, count(*) AS p FROM pred_spans GROUP BY id) c ON c.id = d.id
  LEFT JOIN (SELECT g.id, count(*) AS tp FROM gold_spans g JOIN pred_spans p ON g.id = p.id AND g.s = p.s AND g.e = p.e
             GROUP BY g.id) x ON x.id = d.id)""",
])


def candidates_sql(body: str) -> str:
    return f"WITH {CANDIDATES_SQL}\n{body}"


def spans_sql(body: str) -> str:
    return candidates_sql(body)


# --- orders as decided spans ------------------------------------------------------------
ENTITY_BY_PRIORITY = {
    "1-URGENT": "PERSON", "2-HIGH": "LOCATION", "3-MEDIUM": "EMAIL_ADDRESS", "4-NOT SPECIFIED": "COURSE",
}


def decisions(spark: SparkSession, root: str, model: int = 1) -> DataFrame:
    """Gold and predicted actions with scores; ``model`` varies the score arithmetic."""
    orders = load(spark, root, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    customer = load(spark, root, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("subject"), "c_nationkey")
    gold = F.when(F.col("o_orderstatus") == "F", "REDACT").when(
        F.col("o_orderstatus") == "O", "KEEP").otherwise("REVIEW")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = 7919 + 2 * model, 104729 + 2 * model
    entity = F.when(F.lit(False), F.lit(None).cast("string"))
    for priority, kind in ENTITY_BY_PRIORITY.items():
        entity = entity.when(F.col("o_orderpriority") == priority, kind)
    df = orders.join(customer, "o_custkey").select(
        k.cast("string").alias("id"), c.cast("string").alias("session_id"), "subject",
        F.when(F.col("c_nationkey") < 12, "student").otherwise("tutor").alias("speaker_role"),
        entity.alias("entity_type"),
        F.when(F.col("o_totalprice") < 150000, "natural").otherwise("challenge").alias("eval_slice"),
        gold.alias("gold_action"),
        F.when(gold == "REDACT", "PRIVATE").when(gold == "KEEP", "CURRICULAR").alias("semantic_role"),
        ((k * a) % 997 / 997 + F.when(gold == "REDACT", 0.6).otherwise(0.0)).alias("s_redact"),
        ((c * b + k * 13) % 991 / 991 + F.when(gold == "KEEP", 0.6).otherwise(0.0)).alias("s_keep"),
        ((k * 31 + c * 17) % 983 / 983 * 0.5 + F.when(gold == "REVIEW", 0.3).otherwise(0.0)).alias("s_review"),
        (F.col("o_totalprice") / 1000).alias("latency_ms"),
        F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice") / 100000).alias("cost"),
    )
    df = P.normalise(df, "s_redact", "s_keep", "s_review").drop("s_redact", "s_keep", "s_review")
    return df.withColumn("predicted_action", P.argmax())


def decisions_sql(name: str = "dec", model: int = 1) -> str:
    a, b = 7919 + 2 * model, 104729 + 2 * model
    return f"""
{name}_raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS session_id, c_mktsegment AS subject,
    CASE WHEN c_nationkey < 12 THEN 'student' ELSE 'tutor' END AS speaker_role,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'PERSON' WHEN '2-HIGH' THEN 'LOCATION' WHEN '3-MEDIUM' THEN 'EMAIL_ADDRESS'
         WHEN '4-NOT SPECIFIED' THEN 'COURSE' END AS entity_type,
    CASE WHEN o_totalprice < 150000 THEN 'natural' ELSE 'challenge' END AS eval_slice,
    CASE o_orderstatus WHEN 'F' THEN 'REDACT' WHEN 'O' THEN 'KEEP' ELSE 'REVIEW' END AS gold_action,
    CASE o_orderstatus WHEN 'F' THEN 'PRIVATE' WHEN 'O' THEN 'CURRICULAR' END AS semantic_role,
    CAST((o_orderkey * {a}) % 997 AS DOUBLE) / 997 + CASE o_orderstatus WHEN 'F' THEN 6e-1 ELSE 0e0 END AS sr,
    CAST((o_custkey * {b} + o_orderkey * 13) % 991 AS DOUBLE) / 991 + CASE o_orderstatus WHEN 'O' THEN 6e-1 ELSE 0e0 END AS sk,
    CAST((o_orderkey * 31 + o_custkey * 17) % 983 AS DOUBLE) / 983 * 5e-1
      + CASE WHEN o_orderstatus IN ('F', 'O') THEN 0e0 ELSE 3e-1 END AS sv,
    o_totalprice / 1000 AS latency_ms, CASE WHEN o_totalprice > 20000 THEN o_totalprice / 100000 END AS cost
  FROM orders JOIN customer ON o_custkey = c_custkey),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN pr >= pk AND pr >= pv THEN 'REDACT' WHEN pk >= pv THEN 'KEEP' ELSE 'REVIEW' END AS predicted_action
  FROM (SELECT * EXCLUDE (sr, sk, sv), sr / (sr + sk + sv) AS pr, sk / (sr + sk + sv) AS pk, sv / (sr + sk + sv) AS pv
        FROM {name}_raw))"""


# --- conversations as turns -------------------------------------------------------------
TAGGING = (
    (r"\p{Ll}{15,}", "<PHONE_NUMBER>"),
    (r"\p{Ll}{13,14}", "<EMAIL_ADDRESS>"),
    (r"\p{Ll}{12}", "<ODD_TAG>"),
    (r"\p{Ll}{11}", "<NRP>"),
    (r"\p{Lu}\p{Ll}{7,}", "<LOCATION>"),
    (r"\p{Lu}\p{Ll}{4,6}", "<PERSON>"),
    (r"\p{Lu}\p{Ll}{3}", "<COURSE>"),
)


def turns(spark: SparkSession, root: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "student").otherwise("volunteer")
    return load_text(spark, root, "conversations").select(
        F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").alias("turn_index"),
        role.alias("speaker_role"), "text",
        F.when(F.col("conv_id") % 2 == 0, "english").otherwise("social_studies").alias("subject"))


def tagged_turns(spark: SparkSession, root: str) -> DataFrame:
    text = F.col("text")
    for pattern, tag in TAGGING:
        text = F.regexp_replace(text, pattern, tag)
    return turns(spark, root).withColumn("text", text)


TURNS_SQL = """
turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, turn AS turn_index,
         CASE role WHEN 'user' THEN 'student' ELSE 'volunteer' END AS speaker_role, text,
         CASE WHEN conv_id % 2 = 0 THEN 'english' ELSE 'social_studies' END AS subject
  FROM conversations)"""


def _tagged_text(text: str = "text") -> str:
    for pattern, tag in TAGGING:
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return text


TAGGED_SQL = TURNS_SQL + f""",
tagged AS MATERIALIZED (SELECT * EXCLUDE (text), {_tagged_text()} AS text FROM turns)"""


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE_CLASS}]+', ' ', 'g'))"
