"""Span metrics and audits (A1-A3, A10-A15, J1, J4) over whole documents."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.tokens import explode_rows
from ..operators import audit as A
from ..operators import metrics as M
from . import inputs as I
from .registry import query

_SLICED = """,
unf AS (
  SELECT 'overall' AS slice, 'all' AS value, * FROM rowstat UNION ALL
  SELECT 'subject', subject, * FROM rowstat UNION ALL
  SELECT 'speaker_role', speaker_role, * FROM rowstat UNION ALL
  SELECT 'token_bucket', CASE WHEN n_tokens <= 4 THEN '1-4' WHEN n_tokens <= 8 THEN '5-8' WHEN n_tokens <= 16 THEN '9-16' ELSE '17+' END, *
  FROM rowstat UNION ALL
  SELECT 'positive_rows', 'only', * FROM rowstat WHERE gold > 0),
met AS (
  SELECT slice, value, count(*) AS count, sum(n_tokens) AS token_count,
    coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(pred), 0), 0) AS precision, coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(gold), 0), 0) AS recall,
    coalesce(2.0 * sum(tp) / nullif(sum(gold) + sum(pred), 0), 0) AS f1,
    count(*) FILTER (gold > 0) AS gold_positive_rows, count(*) FILTER (pred > 0) AS predicted_positive_rows
  FROM unf GROUP BY slice, value)"""


def _metrics_frame(spark, root):
    return M.candidate_metrics(I.candidates(spark, root))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("a1_span_f1", f"""
WITH {I.CANDIDATES_SQL}{_SLICED} SELECT count, token_count, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM met WHERE slice = 'overall'""")
def span_f1(spark, root):
    out = _metrics_frame(spark, root).filter("slice = 'overall'").select("count", "token_count", "precision", "recall", "f1")
    return _rounded(out, "precision", "recall", "f1")


@query("a2_candidate_metrics_by_slice", f"""
WITH {I.CANDIDATES_SQL}{_SLICED} SELECT slice, value, count, token_count, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, gold_positive_rows, predicted_positive_rows FROM met""")
def candidate_metrics_by_slice(spark, root):
    return _rounded(_metrics_frame(spark, root), "precision", "recall", "f1")


@query("a3_worst_context_recall", f"""
WITH {I.CANDIDATES_SQL}{_SLICED} SELECT round(min(recall), 6) AS worst_context_recall FROM met WHERE slice = 'subject'""")
def worst_context_recall(spark, root):
    return _rounded(M.worst_context_recall(_metrics_frame(spark, root)), "worst_context_recall")


# Seeds are the gold spans; the action comes from the span's own look.
def _hits(spark, root, blind=False):
    """``blind``: the detector proposes nothing in documents of even number."""
    df = I.candidates(spark, root).select("id", "subject", "speaker_role", "tokens", "gold_labels", "pred_labels")
    if blind:
        none = F.transform("pred_labels", lambda x: F.lit("O"))
        df = df.withColumn("pred_labels", F.when(F.col("id").cast("long") % 2 == 0, none).otherwise(F.col("pred_labels")))
    texts = (f"transform({L.spans_lenient_sql('gold_labels')}, s -> named_struct('start', s.start, 'end', s.`end`, "
             f"'span_text', {L.span_text_sql('tokens', 's')}))")
    seeds = ("transform(plain, s -> named_struct('start', s.start, 'end', s.`end`, 'span_text', s.span_text, "
             "'action_label', if(s.span_text like '%@%', 'REVIEW', 'REDACT'), 'entity_type', case when s.span_text like '%@%' "
             "then 'EMAIL_ADDRESS' when s.span_text like '%.%' then 'IP_ADDRESS' else 'PHONE_NUMBER' end))")
    return A.seed_hits(df.withColumn("plain", F.expr(texts)).withColumn("seeds", F.expr(seeds)).drop("plain"))


_SEEDS = """,
seed AS (
  SELECT id, subject, speaker_role, s, e, span_text, hit,
    CASE WHEN span_text LIKE '%@%' THEN 'EMAIL_ADDRESS' WHEN span_text LIKE '%.%' THEN 'IP_ADDRESS' ELSE 'PHONE_NUMBER' END AS entity_type,
    span_text NOT LIKE '%@%' AS is_redact, span_text LIKE '%@%' OR span_text LIKE '%.%' AS direct
  FROM (SELECT g.id, d.lang AS subject, d.source AS speaker_role, g.s, g.e,
          (SELECT string_agg(t.token, ' ' ORDER BY t.i) FROM tok t WHERE t.id = g.id AND t.i >= g.s AND t.i < g.e) AS span_text,
          EXISTS (SELECT 1 FROM pred_spans p WHERE p.id = g.id AND p.s < g.e AND g.s < p.e) AS hit
        FROM gold_spans g JOIN documents d ON CAST(d.doc_id AS VARCHAR) = g.id))"""


@query("a10_candidate_audit", I.candidates_sql("").rstrip() + _SEEDS + """,
u AS (SELECT 'overall' AS slice, 'all' AS value, * FROM seed UNION ALL SELECT 'subject', subject, * FROM seed
      UNION ALL SELECT 'speaker_role', speaker_role, * FROM seed)
SELECT slice, value, count(*) AS seed_count, count(*) FILTER (is_redact) AS redact_seed_count,
  round(avg(CAST(hit AS INT)), 6) AS seed_coverage,
  round(CAST(count(*) FILTER (is_redact AND hit) AS DOUBLE) / nullif(count(*) FILTER (is_redact), 0), 6) AS candidate_redact_recall,
  round(CAST(count(*) FILTER (is_redact AND direct) AS DOUBLE) / nullif(count(*) FILTER (is_redact), 0), 6) AS direct_id_redact_recall,
  round(CAST(count(*) FILTER (is_redact AND (hit OR direct)) AS DOUBLE) / nullif(count(*) FILTER (is_redact), 0), 6) AS protected_redact_recall
FROM u GROUP BY slice, value""")
def candidate_audit(spark, root):
    out = A.seed_coverage(_hits(spark, root), {"subject": F.col("subject"), "speaker_role": F.col("speaker_role")})
    return _rounded(out, "seed_coverage", "candidate_redact_recall", "direct_id_redact_recall", "protected_redact_recall")


@query("a10_volume_multiplier", I.candidates_sql("""
SELECT sum(gold) AS gold_span_count, sum(pred) AS predicted_span_count,
  round(CAST(sum(pred) AS DOUBLE) / sum(gold), 6) AS candidate_volume_multiplier FROM rowstat"""))
def volume_multiplier(spark, root):
    return _rounded(A.volume(I.candidates(spark, root)), "candidate_volume_multiplier")


@query("a10_recall_by_type", I.candidates_sql("").rstrip() + _SEEDS + """
SELECT entity_type AS type, count(*) AS spans, round(avg(CAST(hit AS INT)), 6) AS recall FROM seed GROUP BY entity_type""")
def recall_by_type(spark, root):
    return _rounded(A.recall_by_type(_hits(spark, root), F.col("seed.entity_type")), "recall")


@query("a10_rare_type_mean_recall", I.candidates_sql("").rstrip() + _SEEDS + """
SELECT round(avg(r), 6) AS rare_type_mean_recall FROM (
  SELECT avg(CAST(hit AS INT)) AS r FROM seed WHERE entity_type IN ('IP_ADDRESS', 'PHONE_NUMBER') GROUP BY entity_type)""")
def rare_type_mean_recall(spark, root):
    out = A.rare_type_mean(A.recall_by_type(_hits(spark, root), F.col("seed.entity_type")))
    return _rounded(out, "rare_type_mean_recall")


@query("a11_miss_buckets", I.candidates_sql("").rstrip() + _SEEDS + """,
m AS (SELECT * FROM seed WHERE is_redact AND NOT (hit AND CAST(id AS BIGINT) % 2 = 1) AND NOT direct)
SELECT slice, value, count(*) AS n FROM (
  SELECT 'entity_type' AS slice, entity_type AS value FROM m UNION ALL SELECT 'speaker_role', speaker_role FROM m
  UNION ALL SELECT 'subject', subject FROM m UNION ALL
  SELECT 'span_length', CASE WHEN e - s <= 1 THEN '1' WHEN e - s = 2 THEN '2' WHEN e - s <= 4 THEN '3-4' ELSE '5+' END FROM m)
GROUP BY slice, value""")
def miss_buckets(spark, root):
    return A.miss_buckets(_hits(spark, root, blind=True), F.col("subject"), F.col("speaker_role"))


_ERR = """,
err AS (
  SELECT 'fp' AS error_type, p.id, p.s, p.e, EXISTS (SELECT 1 FROM gold_spans g WHERE g.id = p.id AND g.s < p.e AND p.s < g.e) AS touches
  FROM pred_spans p ANTI JOIN gold_spans g ON g.id = p.id AND g.s = p.s AND g.e = p.e
  UNION ALL
  SELECT 'fn', g.id, g.s, g.e, EXISTS (SELECT 1 FROM pred_spans p WHERE g.id = p.id AND g.s < p.e AND p.s < g.e)
  FROM gold_spans g ANTI JOIN pred_spans p ON g.id = p.id AND g.s = p.s AND g.e = p.e),
named AS (
  SELECT error_type, x.id, s, e, span_text,
    CASE WHEN touches THEN 'boundary error'
         WHEN regexp_matches(text, '[\\x{200e}\\x{200f}\\x{feff}\\t\\n]') THEN 'tokenization/formatting issue'
         WHEN error_type = 'fn' AND regexp_matches(lower(span_text), '@|http|www|\\.com|\\.org|gmail|email|discord|instagram|snap|phone') THEN 'URL/contact miss'
         WHEN error_type = 'fp' AND (regexp_matches(span_text, '^(?:[0-9]+|[-xyz+*/=().,%^<>])(?: (?:[0-9]+|[-xyz+*/=().,%^<>]))*$')
              OR (regexp_matches(span_text, '[0-9]') AND regexp_matches(span_text, '[-+*/=^<>]'))) THEN 'math-expression false positive'
         WHEN error_type = 'fp' AND regexp_matches(span_text, '\\p{L}') AND NOT regexp_matches(span_text, '(?:^| )[\\p{L}--\\p{Lu}]')
              AND NOT regexp_matches(span_text, '(?:^| )\\p{Ll}') THEN 'curricular/person-name false positive'
         ELSE 'annotation ambiguity' END AS bucket
  FROM (SELECT err.*, (SELECT string_agg(t.token, ' ' ORDER BY t.i) FROM tok t WHERE t.id = err.id AND t.i >= err.s AND t.i < err.e) AS span_text
        FROM err) x JOIN documents d ON CAST(d.doc_id AS VARCHAR) = x.id)""".replace(
    "AND NOT regexp_matches(span_text, '(?:^| )[\\p{L}--\\p{Lu}]')\n              ", "")


def _errors(spark, root):
    df = I.candidates(spark, root).select("id", "subject", "text", "tokens", "gold_labels", "pred_labels")
    return A.span_errors(df).drop("text", "tokens", "gold_labels", "pred_labels")


@query("a12_error_buckets", I.candidates_sql("").rstrip() + _ERR + """
SELECT error_type, bucket, count(*) AS n, sum(s) AS sum_start FROM named GROUP BY error_type, bucket""")
def error_buckets(spark, root):
    return _errors(spark, root).groupBy("error_type", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("span.start").cast("long")).alias("sum_start"))


@query("a13_top_failure_patterns", I.candidates_sql("").rstrip() + _ERR + """
SELECT bucket, count(*) AS n FROM named GROUP BY bucket ORDER BY n DESC, bucket LIMIT 2""")
def top_failure_patterns(spark, root):
    return A.top_patterns(_errors(spark, root))


@query("a13_error_samples")
def error_samples(spark, root):
    return A.error_samples(_errors(spark, root), 10).select("error_type", "rank", "id", "span_text", "bucket", "preview")


@query("a14_positive_rates", I.candidates_sql("""
SELECT subject, round(CAST(count(*) FILTER (pred > 0) AS DOUBLE) / count(*), 6) AS predicted_positive_row_rate,
  round(CAST(sum(coalesce(n, 0)) AS DOUBLE) / sum(n_tokens), 6) AS predicted_positive_token_rate
FROM rowstat LEFT JOIN (SELECT id, count(*) AS n FROM pred_lab GROUP BY id) USING (id) GROUP BY subject"""))
def positive_rates(spark, root):
    out = A.positive_rates(I.candidates(spark, root), keys=["subject"])
    return _rounded(out, "predicted_positive_row_rate", "predicted_positive_token_rate")


@query("a15_dataset_summary", I.candidates_sql("").rstrip() + _SEEDS + """
SELECT slice, value, count(*) AS n FROM (
  SELECT 'type' AS slice, entity_type AS value FROM seed UNION ALL SELECT 'speaker_role', speaker_role FROM seed
  UNION ALL SELECT 'subject', subject FROM seed) GROUP BY slice, value""")
def dataset_summary(spark, root):
    return A.count_distribution(_hits(spark, root), {
        "type": F.col("seed.entity_type"), "speaker_role": F.col("speaker_role"), "subject": F.col("subject")})


@query("j4_seed_overlap_join", I.candidates_sql("""
SELECT g.id, g.s AS gold_start, p.s AS pred_start, least(g.e, p.e) - greatest(g.s, p.s) AS shared_tokens
FROM gold_spans g JOIN pred_spans p ON g.id = p.id AND g.s < p.e AND p.s < g.e"""))
def seed_overlap_join(spark, root):
    """The same overlap as a join between two span tables; the id is the equi key."""
    base = I.candidates(spark, root).select("id", "gold_labels", "pred_labels")
    side = lambda c, n: explode_rows(base.select("id", L.spans_lenient(c).alias("ss")), F.col("ss"), "s").select(
        "id", F.col("s.start").cast("long").alias(f"{n}_start"), F.col("s.end").cast("long").alias(f"{n}_end"))
    g, p = side("gold_labels", "gold"), side("pred_labels", "pred")
    both = g.join(p, (g["id"] == p["id"]) & (g["gold_start"] < p["pred_end"]) & (p["pred_start"] < g["gold_end"]))
    return both.select(g["id"], "gold_start", "pred_start", (
        F.least("gold_end", "pred_end") - F.greatest("gold_start", "pred_start")).alias("shared_tokens"))
