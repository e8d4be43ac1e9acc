"""Validation, alignment, set checks and label rules."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import rules as R
from ..functions import tokens as T
from ..operators import quality as Q
from ..operators import spans as S
from . import inputs as I
from .registry import query


def _damaged(spark, root):
    """Candidate rows with faults that come from the data: null languages, and a label lost by the hash of the id."""
    df = I.tokenized(spark, root)
    labels = F.expr("transform(slice(tokens, 1, size(tokens) - if(substring(sha1(id), 1, 1) in ('0', '1', '2', '3') and size(tokens) > 0, 1, 0)), t -> 'O')")
    return df.select("id", F.when(F.col("subject") != "es", F.col("subject")).alias("subject"),
                     F.when(F.col("speaker_role") != "src3", F.col("tokens")).alias("tokens"), labels.alias("labels"), "speaker_role")


_N = f"n AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, len(regexp_extract_all(text, '{I.TOKEN_PATTERN}')) AS n FROM documents)"


@query("q1_record_violations", f"""WITH {_N} SELECT id, 'missing subject' AS problem FROM n WHERE lang = 'es' UNION ALL SELECT id, 'missing tokens' FROM n WHERE source = 'src3'
UNION ALL SELECT id, 'tokens/labels length mismatch' FROM n WHERE source <> 'src3' AND n > 0 AND substring(sha1(id), 1, 1) IN ('0', '1', '2', '3')""")
def record_violations(spark, root):
    return Q.candidate_violations(_damaged(spark, root))


@query("s3_action_violations", "SELECT CAST(doc_id AS VARCHAR) AS id, 'missing action_label' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def action_violations(spark, root):
    docs = I.load(spark, root, "documents")
    lab = I.load(spark, root, "labels").select("doc_id", F.when(F.col("toxic") == 1, "REDACT").otherwise("KEEP").alias("action_label"))
    rows = docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("span_text"), F.col("source").alias("context_text"), "action_label")
    return Q.action_violations(rows)


@query("q2_duplicate_ids", "SELECT id, count(*) AS n FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS id FROM lineitem UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || '-1' FROM orders) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, root):
    a = I.load(spark, root, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    b = I.load(spark, root, "orders").select(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("1")).alias("id"))
    return Q.duplicate_ids(a, b)


@query("q3_prediction_alignment", f"""WITH {_N}, h AS (SELECT *, substring(sha1(id), 1, 1) AS h FROM n), g AS (SELECT id, n FROM h WHERE h NOT IN ('0', '1')), p AS (SELECT id, n + CASE WHEN h IN ('4', '5') THEN 1 ELSE 0 END AS n FROM h WHERE h NOT IN ('2', '3'))
SELECT coalesce(g.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'missing' WHEN g.id IS NULL THEN 'extra' ELSE 'length' END AS status FROM g FULL JOIN p ON g.id = p.id WHERE p.id IS NULL OR g.id IS NULL OR g.n <> p.n""")
def prediction_alignment(spark, root):
    """Missing, extra and longer predictions are those of certain hashes of the id."""
    df = I.documents(spark, root).withColumn("labels", T.tokenize(F.col("text"))).withColumn("h", F.substring(F.sha1("id"), 1, 1))
    gold = df.filter("h not in ('0', '1')").select("id", "labels")
    longer = F.when(F.col("h").isin("4", "5"), F.array(F.lit("O"))).otherwise(F.array().cast("array<string>"))
    pred = df.filter("h not in ('2', '3')").select("id", F.concat("labels", longer).alias("predicted_labels"))
    return Q.alignment(gold, pred)


@query("q4_prediction_coverage", "SELECT CAST(doc_id AS VARCHAR) AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def prediction_coverage(spark, root):
    ids = lambda t: I.load(spark, root, t).select(F.col("doc_id").cast("string").alias("id"))
    return Q.coverage(ids("documents"), ids("labels"))


@query("q5_id_set_difference", "WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT CAST(k AS VARCHAR) AS id, 'left' AS side FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT CAST(k AS VARCHAR), 'right' FROM o WHERE k NOT IN (SELECT k FROM c)")
def id_set_difference(spark, root):
    """Customers in credit against customers with a pending order; each side has ids that the other lacks."""
    return Q.id_difference(I.load(spark, root, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id")),
                           I.load(spark, root, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("id")))


@query("q6_split_leakage", "SELECT CAST(o_custkey AS VARCHAR) AS dialogue_id, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def split_leakage(spark, root):
    return Q.leakage(I.load(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("dialogue_id"), F.col("o_orderstatus").alias("split")))


@query("q7_exclude_used_sessions", f"WITH {I.TURNS_SQL} SELECT dialogue_id, count(*) AS n FROM turns WHERE dialogue_id NOT IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE role = 'system') GROUP BY dialogue_id")
def exclude_used_sessions(spark, root):
    used = I.load(spark, root, "conversations").filter("role = 'system'").select(F.col("conv_id").cast("string").alias("dialogue_id"))
    return Q.exclude_used(I.turns(spark, root), used).groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"))


@query("j6_anti_join_done_rows", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def anti_join_done_rows(spark, root):
    done = I.load(spark, root, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return I.load(spark, root, "orders").join(done, "o_custkey", "left_anti").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("q8_provisional_labels", "SELECT o_orderpriority AS split, count(*) AS rows, count(*) FILTER (o_totalprice < 5000 OR o_orderstatus = 'P') AS provisional, o_orderpriority = '1-URGENT' OR count(*) FILTER (o_totalprice < 5000 OR o_orderstatus = 'P') = 0 AS allowed FROM orders GROUP BY o_orderpriority")
def provisional_labels(spark, root):
    rows = I.load(spark, root, "orders").select(
        F.col("o_orderpriority").alias("split"), F.when(F.col("o_totalprice") < 5000, True).alias("provisional_action"),
        F.when(F.col("o_orderstatus") == "P", "legacy_redact_only").alias("label_source"))
    return Q.provisional_counts(rows, ["1-URGENT"])


@query("q9_split_audit", I.candidates_sql("""SELECT subject, count(*) AS rows, sum(n_tokens) AS tokens, count(*) FILTER (gold > 0) AS positive_rows, round(CAST(count(*) FILTER (gold > 0) AS DOUBLE) / count(*), 6) AS positive_row_rate,
  sum(coalesce(n, 0)) AS positive_tokens, round(CAST(sum(coalesce(n, 0)) AS DOUBLE) / sum(n_tokens), 6) AS positive_token_rate, round(CAST(sum(n_tokens) AS DOUBLE) / count(*), 3) AS avg_tokens_per_row, max(n_tokens) AS max_tokens_per_row
FROM rowstat LEFT JOIN (SELECT id, count(*) AS n FROM gold_lab GROUP BY id) USING (id) GROUP BY subject"""))
def split_audit(spark, root):
    return Q.split_audit(I.candidates(spark, root), "subject", "gold_labels")


_DRIFT = "o AS (SELECT regexp_extract(p_type, '^\\w+') AS label, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1), w AS (SELECT regexp_extract(p_type, '\\w+$') AS label, count(*) AS n FROM part GROUP BY 1)"


def _drift(spark, root):
    part = I.load(spark, root, "part")
    count = lambda df, pattern: df.groupBy(F.regexp_extract("p_type", pattern, 0).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return Q.count_drift(count(part.filter("p_size < 25"), r"^\w+"), count(part, r"\w+$"))


_DRIFTED = f"""WITH {_DRIFT}, d AS (SELECT coalesce(o.label, w.label) AS label, coalesce(o.n, 0) AS old, coalesce(w.n, 0) AS new FROM o FULL JOIN w ON o.label = w.label)"""


@query("q11_count_drift", f"{_DRIFTED} SELECT *, new - old AS delta, CASE WHEN new = 0 THEN 'removed' WHEN old = 0 THEN 'added' ELSE 'both' END AS status FROM d")
def count_drift(spark, root):
    return _drift(spark, root)


@query("q11_drift_totals", f"{_DRIFTED} SELECT sum(least(old, new)) AS overlap_count, sum(greatest(old - new, 0)) AS removed_count, sum(greatest(new - old, 0)) AS added_count FROM d")
def drift_totals(spark, root):
    return Q.drift_totals(_drift(spark, root))


@query("q12_metric_diff", "WITH m AS (SELECT o_orderpriority AS path, avg(o_totalprice) AS value, avg(o_totalprice) FILTER (o_totalprice > 2000) AS recorded FROM orders GROUP BY 1) SELECT path, round(value, 4) AS value, 'differs' AS problem FROM m WHERE round(value, 4) <> round(recorded, 4)")
def metric_diff(spark, root):
    orders = I.load(spark, root, "orders")
    table = lambda df: df.groupBy(F.col("o_orderpriority").alias("path")).agg(F.avg("o_totalprice").alias("value"))
    return Q.metric_diff(table(orders.filter("o_totalprice > 2000")), table(orders)).select("path", F.round("value", 4).alias("value"), "problem")


@query("q13_unlabelled_rows", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
def unlabelled_rows(spark, root):
    lab = I.load(spark, root, "labels").select("doc_id", F.when(F.col("quality") == 1, "KEEP").otherwise("maybe").alias("action_label"))
    return Q.unlabelled(I.load(spark, root, "documents").join(lab, "doc_id", "left")).select(F.col("doc_id").cast("string").alias("id"))


@query("q14_pending_rows", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def pending_rows(spark, root):
    todo = I.load(spark, root, "documents").select(F.col("doc_id").alias("id"), "lang")
    done = I.load(spark, root, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "REDACT").otherwise("KEEP").alias("predicted_action"), F.lit("m1").alias("model"))
    return Q.pending(todo, done, {"model": "m1"}).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("q15_completeness", "SELECT count(*) AS rows, count(*) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS complete FROM orders")
def completeness(spark, root):
    """Orders against the number of different orders that line items name."""
    expected = I.load(spark, root, "lineitem").agg(F.count_distinct("l_orderkey").alias("n")).scalar()
    return Q.is_complete(I.load(spark, root, "orders"), expected)


# --- span heuristics over every token run of the documents -----------------------------------
_TOKEN_STATS = f"""WITH {I.tokens_sql()}, w AS (SELECT id, i, token, lead(token) OVER (PARTITION BY id ORDER BY i) AS nx FROM tok)"""


@query("r2_contact_grade_phone", f"""{_TOKEN_STATS} SELECT count(*) FILTER (regexp_matches(lower(token), '@|http|www|\\.com|\\.org|gmail|email|discord|instagram|snap|phone')) AS contact,
  count(*) FILTER (contains(lower(token), 'grade') OR regexp_matches(lower(token), '^[0-9]{{1,2}}(st|nd|rd|th)$')) AS grade, count(*) FILTER (len(regexp_extract_all(token, '[0-9]')) >= 7) AS phone FROM tok""")
def contact_grade_phone(spark, root):
    t = T.explode_rows(I.documents(spark, root).select(T.tokenize(F.col("text")).alias("ts")), F.col("ts"), "t")
    n = lambda c: F.count_if(c)
    return t.agg(n(R.is_contact_like(F.col("t"))).alias("contact"), n(R.is_grade_level(F.col("t"))).alias("grade"), n(R.is_probable_phone(F.col("t"))).alias("phone"))


def _runs(spark, root):
    """Predicted spans with their tokens."""
    df = I.candidates(spark, root).select("id", "tokens", L.spans_lenient("pred_labels").alias("ss"))
    rows = T.explode_rows(df, F.col("ss"), "s")
    return rows.select("id", F.col("s.start").cast("long").alias("start"), F.expr("slice(tokens, s.start + 1, s.`end` - s.start)").alias("ts"))


_RUNS = I.candidates_sql("").rstrip() + """,
rn AS (SELECT p.id, p.s AS start, string_agg(t.token, ' ' ORDER BY t.i) AS st FROM pred_spans p JOIN tok t ON t.id = p.id AND t.i >= p.s AND t.i < p.e GROUP BY p.id, p.s)"""
_NAME = r"regexp_matches(st, '(^| )\p{L}[^ ]*[A-Za-z0-9]|(^| )[A-Za-z]') AND NOT regexp_matches(st, '(^| )\p{Ll}')"
_MATH = r"(NOT regexp_matches(st, '^[xyzXYZ]$') AND regexp_matches(st, '[\p{L}\p{N}]') AND ((regexp_matches(lower(st), '^([0-9]+|[-xyz+*/=().,%^<>])( ([0-9]+|[-xyz+*/=().,%^<>]))*$') AND regexp_matches(st, '[0-9]')) OR (NOT regexp_matches(lower(st), '^([0-9]+|[-xyz+*/=().,%^<>])( ([0-9]+|[-xyz+*/=().,%^<>]))*$') AND contains(st, ' ') AND regexp_matches(st, '[0-9]') AND regexp_matches(st, '[-+*/=^<>]'))))"


@query("r3_name_like", f"{_RUNS} SELECT id, start, {_NAME} AS name_like FROM rn")
def name_like(spark, root):
    return _runs(spark, root).select("id", "start", R.is_name_like(F.col("ts")).alias("name_like"))


@query("r4_math_like", f"{_RUNS} SELECT id, start, {_MATH} AS math_like FROM rn")
def math_like(spark, root):
    return _runs(spark, root).select("id", "start", R.is_math_like(F.col("ts")).alias("math_like"))


@query("r6_entity_guess", f"""{_RUNS} SELECT id, start, CASE WHEN regexp_matches(lower(st), '@|http|www|\\.com|\\.org|gmail|email|discord|instagram|snap|phone') THEN CASE WHEN contains(lower(st), 'http') OR contains(lower(st), 'www') THEN 'URL' ELSE 'CONTACT' END
  WHEN contains(lower(st), 'grade') OR regexp_matches(lower(st), '^[0-9]{{1,2}}(st|nd|rd|th)$') THEN 'GRADE_LEVEL' WHEN len(regexp_extract_all(st, '[0-9]')) >= 7 THEN 'PHONE_NUMBER' WHEN {_NAME} THEN 'PERSON' END AS entity_type FROM rn""")
def entity_guess(spark, root):
    return _runs(spark, root).select("id", "start", R.guess_entity_type(F.array_join("ts", " "), F.col("ts")).alias("entity_type"))


@query("r13_pool_suggestion", f"""{_RUNS} SELECT id, start, CASE WHEN regexp_matches(lower(st), '@|http|www|\\.com|\\.org|gmail|email|discord|instagram|snap|phone') THEN 'REDACT' WHEN {_MATH} THEN 'KEEP' ELSE 'REVIEW' END AS suggested FROM rn""")
def pool_suggestion(spark, root):
    return _runs(spark, root).select("id", "start", R.pool_suggestion(F.array_join("ts", " "), F.col("ts")).alias("suggested"))


@query("r5_math_like_spans")
def math_like_spans(spark, root):
    """Checked against a plain twin in the tests; SQL over every 1-4 token run is slow."""
    df = I.documents(spark, root).select("id", R.math_like_spans(T.tokenize(F.col("text"))).alias("ss"))
    rows = T.explode_rows(df, F.col("ss"), "s")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.start").cast("long")).alias("sum_start"), F.sum(F.col("s.end").cast("long")).alias("sum_end"))


@query("r7_titlecase_probes")
def titlecase_probes(spark, root):
    """Order-dependent; checked against a plain twin in the tests."""
    df = I.documents(spark, root).select("id", R.titlecase_probes(T.tokenize(F.col("text"))).alias("ss"))
    rows = T.explode_rows(df, F.col("ss"), "s")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.start").cast("long")).alias("sum_start"), F.sum(F.col("s.end").cast("long")).alias("sum_end"))


@query("r8_speaker_roles", "SELECT CASE upper(trim(l_returnflag)) WHEN 'T' THEN 'teacher' WHEN 'O' THEN 'observer' ELSE 'student' END AS r1, CASE upper(trim(l_linestatus)) WHEN 'T' THEN 'teacher' WHEN 'O' THEN 'observer' ELSE 'student' END AS r2, count(*) AS n FROM lineitem GROUP BY ALL")
def speaker_roles(spark, root):
    return I.load(spark, root, "lineitem").groupBy(R.speaker_role(F.lower("l_returnflag")).alias("r1"), R.speaker_role(F.col("l_linestatus")).alias("r2")).agg(F.count(F.lit(1)).alias("n"))


@query("r18_binary_labels", f"WITH {I.decisions_sql('dec')} SELECT gold_action, CASE WHEN gold_action <> 'REVIEW' THEN gold_action END AS dropped, CASE gold_action WHEN 'REVIEW' THEN 'KEEP' ELSE gold_action END AS kept, CASE gold_action WHEN 'REVIEW' THEN 'REDACT' ELSE gold_action END AS redacted, count(*) AS n FROM dec GROUP BY ALL")
def binary_labels(spark, root):
    g = F.col("gold_action")
    return I.decisions(spark, root).groupBy("gold_action").agg(F.count(F.lit(1)).alias("n")).select(
        "gold_action", R.binary_label(g, "drop").alias("dropped"), R.binary_label(g, "keep").alias("kept"), R.binary_label(g, "redact").alias("redacted"), "n")


@query("r19_semantic_roles", f"WITH {I.decisions_sql('dec')} SELECT gold_action, semantic_role, coalesce(semantic_role, CASE gold_action WHEN 'REDACT' THEN 'PRIVATE' WHEN 'KEEP' THEN 'CURRICULAR' ELSE 'AMBIGUOUS' END) AS role, count(*) AS n FROM dec GROUP BY ALL")
def semantic_roles(spark, root):
    df = I.decisions(spark, root).groupBy("gold_action", "semantic_role").agg(F.count(F.lit(1)).alias("n"))
    return df.select("gold_action", "semantic_role", R.semantic_role(F.lower(F.concat(F.lit(" "), "semantic_role")), F.col("gold_action")).alias("role"), "n")


# --- model responses built from the decisions --------------------------------------------------
def responses(spark, root):
    """One raw response per decision; its shape depends on price and priority."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = lambda a, r: F.concat(F.lit('{"action_label": '), a, F.lit(', "semantic_role": '), r, F.lit("}"))
    act, role = F.col("predicted_action"), F.coalesce("semantic_role", F.lit("AMBIGUOUS"))
    lat = F.col("latency_ms")
    raw = (
        F.when(lat < 60, F.concat(F.lit("```json\n"), body(q(act), q(role)), F.lit("\n```")))
        .when(lat < 120, body(act, q(role)))
        .when(lat < 180, F.concat(F.lit("<think>hm {x}</think>  "), body(q(act), q(role))))
        .when(lat < 240, body(q(F.concat(act, F.lit("S"))), q(F.lower(role))))
        .when(lat < 300, F.concat(F.lit('{"action_label": "'), act, F.lit('"}')))
        .when(lat < 360, body(q(F.lit("MAYBE")), q(role)))
        .otherwise(F.concat(F.lit(" "), body(q(act), q(role)), F.lit("\n")))
    )
    return I.decisions(spark, root).select("id", "predicted_action", "latency_ms", raw.alias("raw_text"))


_RESP = f"WITH {I.decisions_sql('dec')}, rr AS (SELECT *, coalesce(semantic_role, 'AMBIGUOUS') AS role FROM dec)"


@query("r20_parse_response", f"""{_RESP} SELECT CASE WHEN latency_ms < 60 OR latency_ms >= 360 THEN predicted_action END AS action_label, CASE WHEN latency_ms < 60 OR latency_ms >= 360 THEN role END AS semantic_role,
  CASE WHEN latency_ms < 60 THEN NULL WHEN latency_ms < 180 THEN 'invalid JSON object' WHEN latency_ms < 240 THEN 'bad action_label' WHEN latency_ms < 300 THEN 'unexpected keys' WHEN latency_ms < 360 THEN 'bad action_label' END AS error, count(*) AS n FROM rr GROUP BY ALL""")
def parse_response(spark, root):
    v = R.parse_response(F.col("raw_text"))
    return responses(spark, root).select(v.alias("v")).groupBy("v.action_label", "v.semantic_role", "v.error").agg(F.count(F.lit(1)).alias("n"))


@query("r21_parse_response_tolerant", f"""{_RESP} SELECT CASE WHEN latency_ms < 240 OR latency_ms >= 360 THEN predicted_action END AS action_label, CASE WHEN latency_ms < 240 OR latency_ms >= 360 THEN role END AS semantic_role,
  CASE WHEN latency_ms < 240 THEN NULL WHEN latency_ms < 300 THEN 'unexpected keys' WHEN latency_ms < 360 THEN 'bad action_label' END AS error, count(*) AS n FROM rr GROUP BY ALL""")
def parse_response_tolerant(spark, root):
    v = R.parse_response_tolerant(F.col("raw_text"))
    return responses(spark, root).select(v.alias("v")).groupBy("v.action_label", "v.semantic_role", "v.error").agg(F.count(F.lit(1)).alias("n"))
