"""Tokens, label arrays and spans (T) over whole documents."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import rules as R
from ..functions import tokens as T
from ..functions.text import stable_hash
from . import inputs as I
from .registry import query


@query("t1_tokenize", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(text, '{I.TOKEN_PATTERN}') AS ts FROM documents)""")
def tokenize(spark, root):
    ts = T.tokenize(F.col("text"))
    return I.documents(spark, root).select(
        "id", F.size(ts).cast("long").alias("n_tokens"), F.md5(F.array_join(ts, " ")).alias("digest"))


@query("t2_tokenize_with_offsets", f"""
WITH {I.tokens_sql()}
SELECT id, count(*) AS n_tokens, sum(s) AS sum_start, sum(e) AS sum_end, sum((i + 1) * s) AS weighted_start, max(e) AS last_end
FROM tok GROUP BY id""")
def tokenize_with_offsets(spark, root):
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)
    return I.tokenized(spark, root).filter(F.size("tokens") > 0).select(
        "id", F.size("tokens").cast("long").alias("n_tokens"),
        total(F.col("starts")).alias("sum_start"), total(F.col("ends")).alias("sum_end"),
        total(F.transform("starts", lambda s, i: s.cast("long") * (i + 1))).alias("weighted_start"),
        F.element_at("ends", -1).cast("long").alias("last_end"))


@query("t3_char_to_token_span", f"""
WITH {I.tokens_sql()}, {I._matches("gold", I.GOLD_PATTERN)}
SELECT g.id, g.s AS char_start, g.e AS char_end, min(t.i) AS token_start, max(t.i) + 1 AS token_end
FROM gold_chars g JOIN tok t ON t.id = g.id AND t.s < g.e AND t.e > g.s GROUP BY g.id, g.s, g.e""")
def char_to_token_span(spark, root):
    df = T.explode_rows(I.tokenized(spark, root), T.regex_spans("text", I.GOLD_PATTERN), "c")
    span = T.token_span("starts", "ends", "c.start", "c.`end`")
    return df.withColumn("t", span).select(
        "id", F.col("c.start").cast("long").alias("char_start"), F.col("c.end").cast("long").alias("char_end"),
        F.col("t.start").cast("long").alias("token_start"), F.col("t.end").cast("long").alias("token_end"))


def _label_rows(df, labels):
    """Positions and labels of the non-O tokens only."""
    return df.select("id", F.posexplode_outer(labels).alias("i", "label")).filter("label <> 'O'").select(
        "id", F.col("i").cast("long").alias("i"), "label")


PAINT_ALL = """
painted AS (
  SELECT id, i, CASE WHEN i = fi THEN 'B-SUSPECT' ELSE 'I-SUSPECT' END AS label FROM (
    SELECT t.id, t.i, {first} AS fi, row_number() OVER (PARTITION BY t.id, t.i ORDER BY a.s DESC, a.e DESC) AS rn
    FROM tok t JOIN {spans} a ON {on}) WHERE rn = 1)
SELECT id, i, label FROM painted"""


@query("t4_token_spans_to_bio", f"""
WITH {I.tokens_sql()}, {I._matches("pred", I.PRED_PATTERN)},
ts AS (SELECT p.id, min(t.i) AS s, max(t.i) + 2 AS e FROM pred_chars p JOIN tok t ON t.id = p.id AND t.s < p.e AND t.e > p.s
       GROUP BY p.id, p.s, p.e),
n AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
ok AS (SELECT DISTINCT ts.id, s, e FROM ts JOIN n USING (id) WHERE e <= n),
""" + PAINT_ALL.format(first="a.s", spans="ok", on="t.id = a.id AND t.i >= a.s AND t.i < a.e"))
def token_spans_to_bio(spark, root):
    """Predicted spans widened by one token, so they overlap and may leave the row."""
    df = I.tokenized(spark, root)
    exact = L.project_spans_sql("starts", "ends", T.regex_spans_sql("text", I.PRED_PATTERN))
    wide = f"transform({exact}, s -> named_struct('start', s.start, 'end', s.`end` + 1))"
    return _label_rows(df, L.labels_from_token_spans("size(tokens)", wide))


BOTH = f"{I.GOLD_PATTERN}", f"{I.PRED_PATTERN}"


@query("t5_annotations_to_bio", f"""
WITH {I.tokens_sql()}, {I._matches("gold", I.GOLD_PATTERN)}, {I._matches("pred", I.PRED_PATTERN)},
ann AS (SELECT DISTINCT id, s, e FROM (SELECT id, s, e FROM gold_chars UNION ALL SELECT id, s, e FROM pred_chars)),
""" + PAINT_ALL.format(first="min(t.i) OVER (PARTITION BY t.id, a.s, a.e)", spans="ann",
                       on="t.id = a.id AND t.s < a.e AND t.e > a.s"))
def annotations_to_bio(spark, root):
    df = I.tokenized(spark, root)
    both = f"concat({', '.join(T.regex_spans_sql('text', p) for p in (I.GOLD_PATTERN, I.PRED_PATTERN))})"
    return _label_rows(df, L.labels_from_char_spans("starts", "ends", both))


@query("t6_merged_intervals_to_bio", f"""
WITH {I.tokens_sql()}, {I._matches("gold", I.GOLD_PATTERN)}, {I._painted("gold")}
SELECT id, i, lab || '-SUSPECT' AS label FROM gold_lab""")
def merged_intervals_to_bio(spark, root):
    df = I.tokenized(spark, root)
    labels = L.labels_from_merged_spans("starts", "ends", T.regex_spans_sql("text", I.GOLD_PATTERN))
    return _label_rows(df, labels)


# Span readers need orphan I labels: here every token with a digit is I, and B when capitalised before it.
ODD_LABELS_SQL = f"""
WITH {I.tokens_sql()},
odd AS (SELECT id, i, CASE WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'B' WHEN regexp_matches(token, '^[\\p{{Ll}}]{{1,3}}$') THEN 'I' ELSE 'O' END AS lab FROM tok),
flag AS (SELECT *, lag(lab) OVER (PARTITION BY id ORDER BY i) AS pl FROM odd)"""


def _odd_labels(df):
    return df.withColumn("labels", F.transform("tokens", lambda t: F.when(t.rlike(r"^\p{Lu}"), "B-SUSPECT").when(
        t.rlike(r"^[\p{Ll}]{1,3}$"), "I-SUSPECT").otherwise("O")))


def _span_rows(df, spans):
    spread = T.explode_rows(df.select("id", spans.alias("spans")), F.col("spans"), "s")
    return spread.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("s.start").cast("long")).alias("sum_start"),
        F.sum(F.col("s.end").cast("long")).alias("sum_end"))


_SPAN_ROWS_SQL = """
SELECT id, count(*) AS n_spans, sum(s) AS sum_start, sum(e) AS sum_end FROM (
  SELECT id, g, min(i) AS s, max(i) + 1 AS e FROM run WHERE g > 0 AND lab <> 'O' GROUP BY id, g) GROUP BY id"""


@query("t7_bio_to_spans_lenient", ODD_LABELS_SQL + """,
block AS (SELECT *, sum(CASE WHEN lab = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS o,
                 sum(CASE WHEN lab = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS b FROM flag),
run AS (SELECT id, i, lab, CASE WHEN max(CASE WHEN lab = 'B' THEN i END) OVER (PARTITION BY id, o ORDER BY i) IS NULL
                            THEN 0 ELSE b END AS g FROM block)""" + _SPAN_ROWS_SQL)
def bio_to_spans_lenient(spark, root):
    return _span_rows(_odd_labels(I.tokenized(spark, root).select("id", "tokens")), L.spans_lenient("labels"))


@query("t8_bio_to_spans_scoring", ODD_LABELS_SQL + """,
run AS (SELECT id, i, lab, sum(CASE WHEN lab = 'B' OR (lab = 'I' AND coalesce(pl, 'O') = 'O') THEN 1 ELSE 0 END)
               OVER (PARTITION BY id ORDER BY i) AS g FROM flag)""" + _SPAN_ROWS_SQL)
def bio_to_spans_scoring(spark, root):
    return _span_rows(_odd_labels(I.tokenized(spark, root).select("id", "tokens")), L.spans_scoring("labels"))


@query("t9_mask_to_labels", ODD_LABELS_SQL + """
SELECT id, sum(CASE WHEN lab <> 'O' AND coalesce(pl, 'O') = 'O' THEN 1 ELSE 0 END) AS n_begin,
       sum(CASE WHEN lab <> 'O' AND coalesce(pl, 'O') <> 'O' THEN 1 ELSE 0 END) AS n_inside,
       sum(CASE WHEN lab <> 'O' AND coalesce(pl, 'O') = 'O' THEN i ELSE 0 END) AS begin_at
FROM flag GROUP BY id""")
def mask_to_labels(spark, root):
    df = _odd_labels(I.tokenized(spark, root).select("id", "tokens")).filter(F.size("tokens") > 0)
    df = df.withColumn("fused", L.mask_to_labels("transform(labels, x -> x <> 'O')"))
    n = lambda v: F.size(F.filter("fused", lambda x: x == v)).cast("long")
    at = F.aggregate(F.transform("fused", lambda x, i: F.when(x == "B-SUSPECT", i).otherwise(0)),
                     F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("id", n("B-SUSPECT").alias("n_begin"), n("I-SUSPECT").alias("n_inside"), at.alias("begin_at"))


def _gold_span_rows(spark, root):
    df = I.candidates(spark, root).select("id", "tokens", "gold_labels", "pred_labels")
    return df.select("id", "tokens", L.spans_lenient("gold_labels").alias("gold"), L.spans_lenient("pred_labels").alias("pred"))


@query("t10_span_text_and_preview", I.candidates_sql("""
SELECT g.id, g.s AS token_start, string_agg(t.token, ' ' ORDER BY t.i) FILTER (t.i >= g.s AND t.i < g.e) AS span_text,
  string_agg(CASE WHEN t.i = g.s THEN '[[ ' ELSE '' END || t.token || CASE WHEN t.i + 1 = g.e THEN ' ]]' ELSE '' END, ' ' ORDER BY t.i) AS preview
FROM gold_spans g JOIN tok t ON t.id = g.id AND t.i >= g.s - 8 AND t.i < g.e + 8 GROUP BY g.id, g.s, g.e"""))
def span_text_and_preview(spark, root):
    df = T.explode_rows(_gold_span_rows(spark, root), F.col("gold"), "s")
    return df.select("id", F.col("s.start").cast("long").alias("token_start"),
                     L.span_text("tokens", "s").alias("span_text"),
                     L.preview("tokens", "s").alias("preview"))


@query("t11_masked_preview")
def masked_preview(spark, root):
    df = T.explode_rows(_gold_span_rows(spark, root), F.col("pred"), "s")
    return df.select("id", F.col("s.start").cast("long").alias("token_start"), L.masked_preview(
        "tokens", "s", "gold", "pred").alias("preview"))


@query("t12_span_overlap", I.candidates_sql("""
SELECT g.id, g.s AS gold_start, g.e AS gold_end, count(p.s) AS n_overlapping
FROM gold_spans g LEFT JOIN pred_spans p ON g.id = p.id AND g.s < p.e AND p.s < g.e GROUP BY g.id, g.s, g.e"""))
def span_overlap(spark, root):
    """Both span lists stay on their row, so the theta join needs no shuffle."""
    df = T.explode_rows(_gold_span_rows(spark, root).select("id", "pred", "gold"), F.col("gold"), "g")
    hits = L.overlap_count("g", "pred")
    return df.select("id", F.col("g.start").cast("long").alias("gold_start"),
                     F.col("g.end").cast("long").alias("gold_end"), hits.cast("long").alias("n_overlapping"))


@query("t13_subsequence_search", f"""
WITH {I.tokens_sql()}, b AS (SELECT id, lower(token) AS token, i, lead(lower(token)) OVER (PARTITION BY id ORDER BY i) AS nx FROM tok)
SELECT id, min(i) FILTER (replace(token, 'ß', 'ss') = 'of' AND replace(nx, 'ß', 'ss') = 'the') AS token_start FROM b GROUP BY id""")
def subsequence_search(spark, root):
    df = I.tokenized(spark, root).select("id", "tokens").filter(F.size("tokens") > 0)
    hit = L.find_subsequence("tokens", "array('OF', 'The', ' ')")
    return df.select("id", hit["start"].cast("long").alias("token_start"))


_DIRECT_SQL = " ".join(
    f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in (
        ("EMAIL_ADDRESS", r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"),
        ("URL", r"(?i)(?:(?:https?://|www\.)[^\s]+|\b(?:[A-Z0-9-]+\.)+(?:com|org|net|edu|gov|io|co|us|me|ai|app|dev|gg|tv|ly)\b(?:/[^\s]*)?)"),
        ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"),
        ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
        ("DATE_OF_BIRTH", r"(?i)\b(?:dob|d\.o\.b\.|date of birth|birthdate|born)\b"),
        ("US_DRIVER_LICENSE", r"(?i)\bDLN?[A-Z0-9-]{6,}\b"),
    ))


@query("r1_direct_identifiers", f"""
SELECT lang, source, reason, count(*) AS n FROM (SELECT lang, source, CASE {_DIRECT_SQL} END AS reason FROM (
  SELECT lang, source, text FROM documents UNION ALL SELECT 'page', 'page', html FROM pages)) GROUP BY ALL""")
def direct_identifiers(spark, root):
    docs = I.load_text(spark, root, "documents", "lang", "source", "text")
    pages = I.load_text(spark, root, "pages", "html").select(
        F.lit("page").alias("lang"), F.lit("page").alias("source"), F.col("html").alias("text"))
    hit = R.detect_direct_id(F.col("text"))
    return docs.unionByName(pages).groupBy("lang", "source", hit["reason"].alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query("r23_stable_hash", """
SELECT CAST(doc_id AS VARCHAR) AS id, sha1('17:' || doc_id) AS seeded, sha1(CAST(doc_id AS VARCHAR)) AS plain FROM documents""")
def stable_hash_key(spark, root):
    return I.load(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("id"), stable_hash(F.col("doc_id"), 17).alias("seeded"),
        stable_hash(F.col("doc_id")).alias("plain"))


@query("r22_prompt_fingerprint", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def prompt_fingerprint(spark, root):
    return I.load(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
