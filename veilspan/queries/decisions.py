"""Decision metrics, calibration and review policies."""

from pyspark.sql import functions as F

from ..constants import ACTIONS, ASYMMETRIC_ANCHORS, SIMPLE_ANCHORS
from ..functions import probability as P
from ..operators import audit as A
from ..operators import metrics as M
from ..operators import policy as Y
from ..session import cut_lineage
from . import inputs as I
from .registry import query

DEC = I.decisions_sql("dec")
_SLICES = ("subject", "speaker_role", "entity_type", "semantic_role", "eval_slice")


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _unfold_sql(table, columns="gold_action, predicted_action"):
    parts = [f"SELECT 'overall' AS slice, 'all' AS value, {columns} FROM {table}"]
    parts += [f"SELECT '{s}', {s}, {columns} FROM {table} WHERE {s} IS NOT NULL" for s in _SLICES]
    return " UNION ALL ".join(parts)


def _metrics_sql(source, keys="slice, value"):
    """Accuracy, macro-F1 and REDACT recall of rows ``keys, gold_action, predicted_action``."""
    return f"""
lab AS (SELECT {keys}, label, sum(s) AS support, sum(p) AS predicted, sum(h) AS tp FROM (
  SELECT {keys}, gold_action AS label, 1 AS s, 0 AS p, CASE WHEN gold_action = predicted_action THEN 1 ELSE 0 END AS h FROM {source}
  UNION ALL SELECT {keys}, predicted_action, 0, 1, 0 FROM {source}) GROUP BY ALL),
rep AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall,
  coalesce(2e0 * tp / nullif(support + predicted, 0), 0) AS f1 FROM lab)"""


_ACTION = """SELECT slice, value, sum(support) AS count, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(coalesce(max(recall) FILTER (label = 'REDACT'), 0), 6) AS redact_recall FROM rep"""


@query("a4_action_metrics", f"WITH {DEC}, u AS ({_unfold_sql('dec')}), {_metrics_sql('u')} {_ACTION} WHERE slice = 'overall' GROUP BY slice, value")
def action_metrics(spark, root):
    return rounded(M.action_metrics(M.confusion(I.decisions(spark, root), ())))


@query("a5_action_metrics_by_slice", f"WITH {DEC}, u AS ({_unfold_sql('dec')}), {_metrics_sql('u')} {_ACTION} GROUP BY slice, value")
def action_metrics_by_slice(spark, root):
    return rounded(M.action_metrics(M.confusion(I.decisions(spark, root))))


@query("a5_worst_context_redact_recall", f"""WITH {DEC}, u AS ({_unfold_sql('dec')}), {_metrics_sql('u')}
SELECT round(min(r), 6) AS worst_context_redact_recall FROM (SELECT coalesce(max(recall) FILTER (label = 'REDACT'), 0) AS r FROM rep
WHERE slice = 'subject' GROUP BY value)""")
def worst_context_redact_recall(spark, root):
    conf = M.confusion(I.decisions(spark, root), ("subject",))
    return rounded(M.worst_context_redact_recall(M.action_metrics(conf)))


@query("a6_classification_report", f"""WITH {DEC}, u AS (SELECT 'overall' AS slice, gold_action, predicted_action FROM dec), {_metrics_sql('u', 'slice')}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM rep UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support) FROM rep UNION ALL
SELECT 'accuracy', round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), sum(support) FROM rep""")
def classification_report(spark, root):
    return rounded(M.classification_report(M.confusion(I.decisions(spark, root), ())))


@query("a7_keep_rates", f"""WITH {DEC} SELECT round(avg(CASE WHEN predicted_action = 'KEEP' THEN 1e0 ELSE 0e0 END) FILTER (gold_action = 'KEEP'), 6) AS cerr,
  round(avg(CASE WHEN predicted_action = 'REDACT' THEN 1e0 ELSE 0e0 END) FILTER (gold_action = 'KEEP'), 6) AS orr FROM dec""")
def keep_rates(spark, root):
    return rounded(M.keep_rates(I.decisions(spark, root)))


_DISTS = ", ".join(f"count(*) FILTER ({c} = '{a}') AS {s}_{a.lower()}" for s, c in (
    ("gold", "gold_action"), ("predicted", "predicted_action")) for a in ACTIONS)


@query("a8_decision_totals", f"""WITH {DEC} SELECT count(*) AS count, round(CAST(count(*) FILTER (predicted_action = 'REVIEW') AS DOUBLE) / count(*), 6) AS review_rate,
  {_DISTS}, round(avg(cost), 6) AS avg_cost, round(avg(latency_ms), 6) AS avg_latency_ms FROM dec""")
def decision_totals(spark, root):
    return rounded(M.decision_totals(I.decisions(spark, root)))


# --- calibration ---------------------------------------------------------------------------
_TEMPS = ", ".join(f"(CAST('{t!r}' AS DOUBLE))" for t in Y.temperature_grid())
_SCALED = """
SELECT * EXCLUDE (er, ek, ev), CASE WHEN abs(t - 1) < 1e-9 THEN pr ELSE er / (er + ek + ev) END AS qr,
  CASE WHEN abs(t - 1) < 1e-9 THEN pk ELSE ek / (er + ek + ev) END AS qk, CASE WHEN abs(t - 1) < 1e-9 THEN pv ELSE ev / (er + ek + ev) END AS qv
FROM (SELECT * EXCLUDE (lr, lk, lv), exp(lr - greatest(lr, lk, lv)) AS er, exp(lk - greatest(lr, lk, lv)) AS ek, exp(lv - greatest(lr, lk, lv)) AS ev
  FROM (SELECT *, ln(greatest(pr, 1e-12)) / t AS lr, ln(greatest(pk, 1e-12)) / t AS lk, ln(greatest(pv, 1e-12)) / t AS lv FROM {src}))"""
FIT = f"""
loss AS (SELECT t, avg(-ln(greatest(CASE gold_action WHEN 'REDACT' THEN qr WHEN 'KEEP' THEN qk ELSE qv END, 1e-12))) AS nll
  FROM ({_SCALED.format(src=f"(SELECT pr, pk, pv, gold_action, t FROM dec, (VALUES {_TEMPS}) x(t))")}) GROUP BY t),
temp AS (SELECT t FROM loss ORDER BY nll, t LIMIT 1)"""
FEAT = f"""
feat AS MATERIALIZED (SELECT *, greatest(qr, qk, qv) AS confidence, abs(qr - qk) AS margin, qv AS review_probability,
  -(qr * ln(greatest(qr, 1e-12)) + qk * ln(greatest(qk, 1e-12)) + qv * ln(greatest(qv, 1e-12))) AS entropy
  FROM ({_SCALED.format(src="(SELECT * FROM dec, temp)")}))"""
CAL = f"WITH {DEC}, {FIT}, {FEAT}"


@query("p1_normalise_and_argmax", f"WITH {DEC} SELECT id, round(pr, 6) AS redact, round(pk, 6) AS keep, round(pv, 6) AS review, predicted_action FROM dec")
def normalise_and_argmax(spark, root):
    return rounded(I.decisions(spark, root).select("id", F.col("p_redact").alias("redact"), F.col("p_keep").alias("keep"), F.col("p_review").alias("review"), "predicted_action"))


@query("p2_temperature_scaling", f"WITH {DEC} SELECT id, round(qr, 6) AS redact, round(qk, 6) AS keep, round(qv, 6) AS review FROM ({_SCALED.format(src='(SELECT *, 17e-1 AS t FROM dec)')})")
def temperature_scaling(spark, root):
    df = P.temper(I.decisions(spark, root).withColumn("t", F.lit(1.7)), "t")
    return rounded(df.select("id", *[F.col(f"q_{n}").alias(n) for n in P.CLASSES]))


@query("p3_temperature_losses", f"WITH {DEC}, {FIT} SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM loss")
def temperature_losses(spark, root):
    return rounded(Y.temperature_losses(I.decisions(spark, root)))


@query("p3_fit_temperature", f"WITH {DEC}, {FIT} SELECT round(t, 6) AS temperature FROM temp")
def fit_temperature(spark, root):
    return rounded(Y.fit_temperature(I.decisions(spark, root)))


def _calibrated(spark, root):
    df = I.decisions(spark, root)
    return Y.with_features(df, cut_lineage(Y.fit_temperature(df)))


@query("p4_features", f"""{CAL} SELECT id, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(review_probability, 6) AS review_probability,
  round(entropy, 6) AS entropy, round(entropy / ln(3), 6) AS normalized_entropy FROM feat""")
def features(spark, root):
    return rounded(_calibrated(spark, root).select(
        "id", *P.FEATURES))


_RATES = ", ".join(f"('{s}', '{r}', CAST({r} AS DOUBLE))" for s in ("confidence", "margin", "entropy", "review_probability") for r in SIMPLE_ANCHORS)
_RATES += ", " + ", ".join(f"('{s}', '{r}', CAST({r} AS DOUBLE))" for s in ("redact_confidence", "keep_confidence", "redact_margin", "keep_margin") for r in ASYMMETRIC_ANCHORS)
THR = f"""
long AS (SELECT 'confidence' AS series, confidence AS v FROM feat UNION ALL SELECT 'margin', margin FROM feat
  UNION ALL SELECT 'entropy', -entropy FROM feat UNION ALL SELECT 'review_probability', -review_probability FROM feat
  UNION ALL SELECT lower(predicted_action) || '_confidence', confidence FROM feat WHERE predicted_action <> 'REVIEW'
  UNION ALL SELECT lower(predicted_action) || '_margin', margin FROM feat WHERE predicted_action <> 'REVIEW'),
thr AS (SELECT series, rt, rate, k, CASE WHEN series IN ('entropy', 'review_probability') THEN -v ELSE v END AS threshold FROM (
  SELECT l.series, rt, rate, rn, v, greatest(1, least(n, CAST(ceil(rate * n) AS BIGINT))) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY v) AS rn, count(*) OVER (PARTITION BY series) AS n FROM long) l
  JOIN (VALUES {_RATES}) r(series, rt, rate) ON l.series = r.series) WHERE rn = k)"""


@query("p6_tail_thresholds", f"{CAL}, {THR} SELECT series, rate, k, round(threshold, 6) AS threshold FROM thr")
def tail_thresholds(spark, root):
    return rounded(Y.tail_thresholds(_calibrated(spark, root)))


def _grid_sql():
    structs = []
    for i, (name, params) in enumerate(Y._plans()):
        fields = ", ".join(f"'{p}': " + (f"m['{params[p]}']" if p in params else "CAST(NULL AS DOUBLE)") for p in Y.PARAMETERS)
        structs.append(f"{{'ord': {i}, 'strategy': '{name}', {fields}}}")
    return f"""
m AS (SELECT map_from_entries(list((series || '@' || rt, threshold))) AS m FROM thr),
allg AS (SELECT unnest(g, recursive := true) FROM (SELECT unnest([{', '.join(structs)}]) AS g FROM m)),
grid AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY strategy, {', '.join(f'round({p}, 12)' for p in Y.PARAMETERS)} ORDER BY ord) AS rn
  FROM allg) WHERE rn = 1)"""


GRID = _grid_sql()
DEFER = """CASE WHEN predicted_action = 'REVIEW' THEN false WHEN strategy = 'confidence' THEN confidence <= max_confidence
  WHEN strategy = 'margin' THEN margin <= max_margin WHEN strategy = 'entropy' THEN entropy >= min_entropy
  WHEN strategy = 'review_probability' THEN review_probability >= min_review_probability
  WHEN strategy = 'composite' THEN confidence <= max_confidence OR margin <= max_margin OR entropy >= min_entropy OR review_probability >= min_review_probability
  WHEN strategy = 'asymmetric_confidence' THEN confidence <= CASE predicted_action WHEN 'REDACT' THEN redact_max_confidence ELSE keep_max_confidence END
  WHEN strategy = 'asymmetric_margin' THEN margin <= CASE predicted_action WHEN 'REDACT' THEN redact_max_margin ELSE keep_max_margin END
  ELSE false END"""


def _f(cond):
    return f"CAST(count(*) FILTER ({cond}) AS DOUBLE)"


def _deferral_sql(keys):
    g, b, x = "gold_action", "base_action", "final_action"
    f1 = [f"(2e0 * {_f(f'{g} = {a!r} AND {x} = {a!r}')} / nullif({_f(f'{g} = {a!r}')} + {_f(f'{x} = {a!r}')}, 0))" for a in ACTIONS]
    macro = f"list_avg([{', '.join(f1)}])"
    r = lambda n, d: f"{_f(n)} / nullif({_f(d)}, 0)"
    return f"""{keys}, count(*) AS count, {_f(f'{g} = {x}')} / count(*) AS accuracy, {macro} AS macro_f1,
  coalesce({r(f"{g} = 'REDACT' AND {x} = 'REDACT'", f"{g} = 'REDACT'")}, 0) AS redact_recall,
  {r(f"{g} = 'KEEP' AND {x} = 'KEEP'", f"{g} = 'KEEP'")} AS cerr, {r(f"{g} = 'KEEP' AND {x} = 'REDACT'", f"{g} = 'KEEP'")} AS orr,
  {_f(f"{x} = 'REVIEW'")} / count(*) AS review_rate, 1 - {_f(f"{x} = 'REVIEW'")} / count(*) AS automation_rate, count(*) FILTER (deferred) AS deferred_count,
  {r(f"{g} = 'REDACT' AND {x} <> 'KEEP'", f"{g} = 'REDACT'")} AS protected_redact_rate, 1 - {r(f"{g} = 'REDACT' AND {x} <> 'KEEP'", f"{g} = 'REDACT'")} AS redact_leak_rate,
  {r(f"{g} = 'REDACT' AND {x} = 'REVIEW'", f"{g} = 'REDACT'")} AS gold_redact_defer_rate,
  {r(f"{g} = 'REVIEW' AND {x} = 'REVIEW'", f"{g} = 'REVIEW'")} AS gold_review_coverage, {r(f"{g} = 'REVIEW' AND {x} = 'REVIEW'", f"{x} = 'REVIEW'")} AS review_precision,
  {_f(f"{b} <> {g}")} / count(*) AS base_error_rate, {r(f"{b} <> {g} AND deferred", f"{b} <> {g}")} AS deferred_error_coverage,
  {r(f"{b} = {g} AND deferred", f"{b} = {g}")} AS deferred_correct_rate"""


_NUMS = ("accuracy", "macro_f1", "redact_recall", "cerr", "orr", "review_rate", "automation_rate", "protected_redact_rate", "redact_leak_rate",
         "gold_redact_defer_rate", "gold_review_coverage", "review_precision", "base_error_rate", "deferred_error_coverage", "deferred_correct_rate")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _NUMS)
SWEEP = f"""
dcd AS MATERIALIZED (SELECT ord, strategy, subject, gold_action, predicted_action AS base_action, deferred, CASE WHEN deferred THEN 'REVIEW' ELSE predicted_action END AS final_action
  FROM (SELECT f.subject, f.gold_action, f.predicted_action, g.ord, g.strategy, {DEFER} AS deferred FROM feat f, grid g)),
wc AS (SELECT ord, min(r) AS worst_context_redact_recall FROM (SELECT ord, subject, coalesce({_f("gold_action = 'REDACT' AND final_action = 'REDACT'")} / nullif({_f("gold_action = 'REDACT'")}, 0), 0) AS r
  FROM dcd GROUP BY ord, subject) GROUP BY ord),
swp AS MATERIALIZED (SELECT s.*, worst_context_redact_recall FROM (SELECT {_deferral_sql('ord, strategy')} FROM dcd GROUP BY ord, strategy) s JOIN wc USING (ord))"""
FULL = f"{CAL}, {THR}, {GRID}, {SWEEP}"
_CHOSEN = """SELECT ord, strategy FROM swp WHERE review_rate <= {t} + 1e-9 ORDER BY coalesce(gold_review_coverage, 0) DESC, coalesce(protected_redact_rate, 0) DESC,
  coalesce(macro_f1, 0) DESC, coalesce(orr, 0), review_rate, ord LIMIT 1"""


@query("p7_policy_grid", f"{CAL}, {THR}, {GRID} SELECT ord, strategy, {', '.join(f'round({p}, 6) AS {p}' for p in Y.PARAMETERS)} FROM grid")
def policy_grid(spark, root):
    return rounded(Y.policy_grid(Y.tail_thresholds(_calibrated(spark, root))))


def _swept(spark, root):
    _, cal, grid = Y.calibrate(I.decisions(spark, root))
    return cal, grid, cut_lineage(Y.sweep(cal, grid))


@query("p8_policy_sweep", f"{FULL} SELECT ord, strategy, count, deferred_count, {_ROUNDED}, round(worst_context_redact_recall, 6) AS worst_context_redact_recall FROM swp")
def policy_sweep(spark, root):
    return rounded(_swept(spark, root)[2])


@query("p9_policy_choice", f"{FULL} SELECT ord, strategy, round(review_rate, 6) AS review_rate, round(gold_review_coverage, 6) AS gold_review_coverage FROM swp WHERE ord IN (SELECT ord FROM ({_CHOSEN.format(t='15e-2')}))")
def policy_choice(spark, root):
    chosen = Y.choose_policy(_swept(spark, root)[2], 0.15, fallback=False)
    return rounded(chosen.select("ord", "strategy", "review_rate", "gold_review_coverage"))


@query("p10_policy_fallback", f"""{FULL} SELECT ord, strategy, round(review_rate, 6) AS review_rate FROM (SELECT * FROM swp ORDER BY abs(review_rate - 1e-3) , coalesce(protected_redact_rate, 0) DESC,
  worst_context_redact_recall DESC, coalesce(macro_f1, 0) DESC, coalesce(orr, 0), ord LIMIT 1)""")
def policy_fallback(spark, root):
    """No policy can stay under 0.1 % review here, so the nearest one is returned."""
    return rounded(Y.choose_policy(_swept(spark, root)[2], 0.001).select("ord", "strategy", "review_rate"))


@query("p11_apply_to_evaluation", f"""{FULL}, {I.decisions_sql('ev', 2)}, ch AS ({_CHOSEN.format(t='15e-2')}),
evf AS (SELECT *, greatest(qr, qk, qv) AS confidence, abs(qr - qk) AS margin, qv AS review_probability,
  -(qr * ln(greatest(qr, 1e-12)) + qk * ln(greatest(qk, 1e-12)) + qv * ln(greatest(qv, 1e-12))) AS entropy FROM ({_SCALED.format(src='(SELECT * FROM ev, temp)')})),
evd AS (SELECT gold_action, predicted_action AS base_action, deferred, CASE WHEN deferred THEN 'REVIEW' ELSE predicted_action END AS final_action FROM (
  SELECT f.gold_action, f.predicted_action, {DEFER} AS deferred FROM evf f, grid g WHERE g.ord IN (SELECT ord FROM ch)))
SELECT count, deferred_count, {_ROUNDED} FROM (SELECT {_deferral_sql("1 AS one")} FROM evd)""")
def apply_to_evaluation(spark, root):
    _, decided = Y.evaluate_policy(I.decisions(spark, root), I.decisions(spark, root, 2), 0.15)
    return rounded(M.deferral_metrics(M.decision_cells(decided)))


FIXED = "(SELECT *, 'composite' AS strategy, 4e-1 AS max_confidence, 5e-2 AS max_margin, 108e-2 AS min_entropy, 4e-1 AS min_review_probability, 0e0 AS redact_max_confidence, 0e0 AS keep_max_confidence, 0e0 AS redact_max_margin, 0e0 AS keep_max_margin FROM feat)"
DECIDED = f"""decided AS MATERIALIZED (SELECT *, CASE WHEN deferred THEN 'REVIEW' ELSE base_action END AS final_action FROM (
  SELECT id, session_id, subject, speaker_role, entity_type, semantic_role, eval_slice, gold_action, predicted_action AS base_action, confidence, {DEFER} AS deferred FROM {FIXED}))"""


def _decided(spark, root):
    """Decisions under one fixed composite policy."""
    values = dict(strategy="composite", max_confidence=0.4, max_margin=0.05, min_entropy=1.08, min_review_probability=0.4)
    policy = F.struct(*[F.lit(values.get(c, 0.0)).alias(c) for c in ("strategy", *Y.PARAMETERS)])
    df = _calibrated(spark, root).withColumn("base_predicted_action", F.col("predicted_action"))
    df = df.withColumn("deferred", P.should_defer(F.col("base_predicted_action"), policy))
    return df.withColumn("predicted_action", F.when(F.col("deferred"), "REVIEW").otherwise(F.col("predicted_action")))


@query("p5_deferral_policy", f"{CAL}, {DECIDED} SELECT id, base_action, final_action, deferred FROM decided")
def deferral_policy(spark, root):
    return _decided(spark, root).select(
        "id", F.col("base_predicted_action").alias("base_action"), F.col("predicted_action").alias("final_action"), "deferred")


@query("a9_deferral_metrics", f"{CAL}, {DECIDED} SELECT count, deferred_count, {_ROUNDED} FROM (SELECT {_deferral_sql('1 AS one')} FROM decided)")
def deferral_metrics(spark, root):
    return rounded(M.deferral_metrics(M.decision_cells(_decided(spark, root))))


@query("p26_escalation_queue", f"{CAL}, {DECIDED} SELECT id, subject, entity_type, base_action FROM decided WHERE deferred")
def escalation_queue(spark, root):
    return Y.escalation_queue(_decided(spark, root)).select(
        "id", "subject", "entity_type", F.col("base_predicted_action").alias("base_action"))


@query("p26_disagreement_packet", f"""{CAL}, {DECIDED}, e AS (SELECT *, coalesce(entity_type, 'n/a') AS kind FROM decided WHERE final_action <> gold_action),
top AS (SELECT kind FROM e GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 3)
SELECT kind, rank, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS rank FROM e WHERE kind IN (SELECT kind FROM top)) WHERE rank <= 20""")
def disagreement_packet(spark, root):
    return Y.disagreement_packet(_decided(spark, root)).select("kind", "rank", "id")


@query("p25_review_budget_curve", f"""{FULL} SELECT ord, strategy, round(review_rate, 6) AS review_rate, round(redact_leak_rate, 6) AS redact_leak_rate,
  round(gold_review_coverage, 6) AS gold_review_coverage, round(macro_f1, 6) AS macro_f1,
  round(max(macro_f1) OVER (ORDER BY review_rate, ord ROWS UNBOUNDED PRECEDING), 6) AS best_macro_f1 FROM swp""")
def review_budget_curve(spark, root):
    return rounded(Y.budget_curve(_swept(spark, root)[2]))


# --- overrides ------------------------------------------------------------------------------
def _with_span(df):
    """Give decisions a span text whose look depends on the row."""
    text = F.when(F.col("latency_ms") > 400, F.concat(F.lit("write user"), "id", F.lit("@mail.example.com"))).when(
        F.col("latency_ms") > 300, F.concat(F.lit("see www.site"), "id", F.lit(".org"))).otherwise(F.concat(F.lit("number "), "id"))
    return df.withColumn("span_text", text)


_OVR = f"""ovr AS MATERIALIZED (SELECT *, CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN 'entity_type' WHEN latency_ms > 300 THEN 'pattern' END AS src,
  CASE WHEN entity_type = 'EMAIL_ADDRESS' OR latency_ms > 400 THEN 'EMAIL_ADDRESS' WHEN latency_ms > 300 THEN 'URL' END AS reason FROM dec)"""


@query("p12_direct_id_override", f"WITH {DEC}, {_OVR} SELECT id, src AS source, reason, CASE WHEN src IS NULL THEN predicted_action ELSE 'REDACT' END AS predicted_action, round(CASE WHEN src IS NULL THEN pr ELSE 1 END, 6) AS p_redact FROM ovr")
def direct_id_override(spark, root):
    out = Y.override_direct_ids(_with_span(I.decisions(spark, root)))
    return rounded(out.select("id", "override.source", "override.reason", "predicted_action", "p_redact"))


@query("a28_override_summary", f"WITH {DEC}, {_OVR} SELECT slice, value, count(*) AS n FROM (SELECT 'reason' AS slice, reason AS value FROM ovr WHERE src IS NOT NULL UNION ALL SELECT 'source', src FROM ovr WHERE src IS NOT NULL) GROUP BY slice, value")
def override_summary(spark, root):
    return A.override_summary(Y.override_direct_ids(_with_span(I.decisions(spark, root))))


@query("a28_override_spot_check", f"WITH {DEC}, {_OVR} SELECT id, predicted_action AS base_action, 'REDACT' AS patched_action, reason FROM ovr WHERE src IS NOT NULL ORDER BY id LIMIT 10")
def override_spot_check(spark, root):
    base = _with_span(I.decisions(spark, root))
    return A.override_spot_check(base, Y.override_direct_ids(base))


# The same derivations on decisions whose direct identifiers are overridden first.
_PATCHED = f"""{DEC.replace('dec AS MATERIALIZED', 'dec0 AS MATERIALIZED')},
dec AS MATERIALIZED (SELECT * EXCLUDE (pr, pk, pv, predicted_action, sure), CASE WHEN sure THEN 1e0 ELSE pr END AS pr, CASE WHEN sure THEN 0e0 ELSE pk END AS pk, CASE WHEN sure THEN 0e0 ELSE pv END AS pv,
  CASE WHEN sure THEN 'REDACT' ELSE predicted_action END AS predicted_action FROM (SELECT *, coalesce(entity_type = 'EMAIL_ADDRESS', false) OR latency_ms > 300 AS sure FROM dec0))"""


@query("p13_policy_end_to_end", f"""WITH {_PATCHED}, {FIT}, {FEAT}, {THR}, {GRID}, {SWEEP} SELECT ord, strategy, count, deferred_count, {_ROUNDED}, round(worst_context_redact_recall, 6) AS worst_context_redact_recall
FROM swp WHERE ord IN (SELECT ord FROM ({_CHOSEN.format(t='15e-2')}))""")
def policy_end_to_end(spark, root):
    patched = Y.override_direct_ids(_with_span(I.decisions(spark, root)))
    chosen, _ = Y.evaluate_policy(patched, patched, 0.15)
    return rounded(chosen)


@query("p14_sample_weights", f"WITH {DEC} SELECT id, round(1e6 * (1e0 / count(*) OVER (PARTITION BY subject)) * (1e0 / count(*) OVER (PARTITION BY gold_action)), 6) AS weight_ppm FROM dec")
def sample_weights(spark, root):
    out = Y.sample_weights(I.decisions(spark, root), "subject", "gold_action")
    return out.select("id", F.round(F.col("weight") * 1e6, 6).alias("weight_ppm"))


@query("p27_cascade_ablation", f"""{CAL}, {DECIDED}, {_OVR}, st AS (
  SELECT 'rules' AS stage, gold_action, 'KEEP' AS base_action, CASE WHEN src IS NULL THEN 'KEEP' ELSE 'REDACT' END AS final_action, false AS deferred FROM ovr UNION ALL
  SELECT 'encoder', gold_action, base_action, base_action, false FROM decided UNION ALL
  SELECT 'deferral', gold_action, base_action, final_action, deferred FROM decided UNION ALL
  SELECT 'reviewer', gold_action, base_action, CASE WHEN deferred THEN gold_action ELSE base_action END, deferred FROM decided)
SELECT stage, count, deferred_count, {_ROUNDED} FROM (SELECT {_deferral_sql('stage')} FROM st GROUP BY stage)""")
def cascade_ablation(spark, root):
    d = _decided(spark, root).select("gold_action", "base_predicted_action", "predicted_action", "deferred")
    rules = Y.override_direct_ids(_with_span(I.decisions(spark, root))).select(
        "gold_action", F.lit("KEEP").alias("base_predicted_action"),
        F.when(F.col("override").isNull(), "KEEP").otherwise("REDACT").alias("predicted_action"), F.lit(False).alias("deferred"))
    base = F.col("base_predicted_action")
    # One pass over the decisions gives three stages.
    stages = F.inline(F.array(
        F.struct(F.lit("encoder").alias("stage"), base.alias("x"), F.lit(False).alias("y")),
        F.struct(F.lit("deferral").alias("stage"), F.col("predicted_action").alias("x"), F.col("deferred").alias("y")),
        F.struct(F.lit("reviewer").alias("stage"), F.when(F.col("deferred"), F.col("gold_action")).otherwise(base).alias("x"), F.col("deferred").alias("y"))))
    later = d.select("gold_action", "base_predicted_action", stages).select(
        "stage", "gold_action", "base_predicted_action", F.col("x").alias("predicted_action"), F.col("y").alias("deferred"))
    return rounded(Y.cascade_ablation(rules.withColumn("stage", F.lit("rules")).unionByName(later)))


# --- comparisons ------------------------------------------------------------------------------
@query("a16_pool_summary", f"WITH {DEC} SELECT subject, eval_slice, sum(n) AS rows, count(*) AS sessions, max(n) AS max_rows_per_session FROM (SELECT subject, eval_slice, session_id, count(*) AS n FROM dec GROUP BY ALL) GROUP BY ALL")
def pool_summary(spark, root):
    return A.pool_summary(I.decisions(spark, root))


@query("a17_mix_summary", f"WITH {DEC}, {I.decisions_sql('ev', 2)}, mix AS (SELECT 'base' AS source, * FROM dec UNION ALL SELECT 'added', * FROM ev) SELECT source, slice, value, count(*) AS n FROM (SELECT source, 'subject' AS slice, subject AS value FROM mix UNION ALL SELECT source, 'label', predicted_action FROM mix UNION ALL SELECT source, 'entity_type', coalesce(entity_type, 'unknown') FROM mix) GROUP BY ALL")
def mix_summary(spark, root):
    mix = I.decisions(spark, root).withColumn("source", F.lit("base")).unionByName(
        I.decisions(spark, root, 2).withColumn("source", F.lit("added")))
    return A.count_distribution(mix, {
        "subject": F.col("subject"), "label": F.col("predicted_action"), "entity_type": F.col("entity_type")}, ["source"])


def _annotators(spark, root):
    side = lambda m: I.decisions(spark, root, m).select(
        "id", F.when(F.col("latency_ms") > 20 * m, F.col("predicted_action")).alias("action_label"), "semantic_role")
    return A.paired_annotations(side(1), side(2))


_ANN = f"""WITH {DEC}, {I.decisions_sql('ev', 2)}, pr AS (SELECT d.id, CASE WHEN d.latency_ms > 20 THEN d.predicted_action END AS l, CASE WHEN e.latency_ms > 40 THEN e.predicted_action END AS r,
  d.semantic_role AS lr, e.semantic_role AS rr FROM dec d JOIN ev e USING (id)),
pp AS (SELECT *, l IS NOT NULL AND r IS NOT NULL AS labelled, l IS NOT NULL AND r IS NOT NULL AND l = r AND lr IS NOT DISTINCT FROM rr AS agree FROM pr)"""


@query("a19_annotator_agreement", f"{_ANN} SELECT count(*) FILTER (labelled) AS shared_labelled, count(*) FILTER (agree) AS shared_agree, round(CAST(count(*) FILTER (agree) AS DOUBLE) / count(*) FILTER (labelled), 6) AS agreement FROM pp")
def annotator_agreement(spark, root):
    return rounded(A.agreement(_annotators(spark, root)))


@query("a19_annotation_pairs", f"{_ANN} SELECT l || ':' || coalesce(lr, 'None') || '->' || r || ':' || coalesce(rr, 'None') AS pair, count(*) AS n FROM pp WHERE labelled GROUP BY pair")
def annotation_pairs(spark, root):
    return A.agreement_pairs(_annotators(spark, root))


@query("a19_disagreements", f"{_ANN} SELECT id, l AS left_label, r AS right_label, lr AS left_role, rr AS right_role FROM pp WHERE NOT agree")
def disagreements(spark, root):
    return A.disagreements(_annotators(spark, root))


_BUCKETS = "('gold_keep_or_review_to_redact'), ('gold_private_not_redact'), ('gold_review_not_review')"
_MATCH = """CASE bucket WHEN 'gold_keep_or_review_to_redact' THEN gold_action IN ('KEEP', 'REVIEW') AND {x} = 'REDACT'
  WHEN 'gold_private_not_redact' THEN coalesce(semantic_role = 'PRIVATE', false) AND {x} <> 'REDACT' ELSE gold_action = 'REVIEW' AND {x} <> 'REVIEW' END"""
_BROWS = f"{CAL}, {DECIDED}, b AS (SELECT * FROM (SELECT *, {_MATCH.format(x='base_action')} AS bm, {_MATCH.format(x='final_action')} AS sm FROM decided, (VALUES {_BUCKETS}) v(bucket)) WHERE bm OR sm)"


@query("a20_bucket_counts", f"{_BROWS} SELECT bucket, count(*) FILTER (bm) AS base_count, count(*) FILTER (sm) AS selected_count FROM b GROUP BY bucket")
def bucket_counts(spark, root):
    return A.bucket_counts(A.bucket_rows(_decided(spark, root)))


@query("a20_bucket_examples", f"{_BROWS} SELECT bucket, rank, id FROM (SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY sm DESC, bm DESC, id) AS rank FROM b) WHERE rank <= 12")
def bucket_examples(spark, root):
    return A.bucket_examples(A.bucket_rows(_decided(spark, root))).select("bucket", "rank", "id")


def _two(cte):
    return f"""{CAL}, {DECIDED}, db AS (SELECT subject, speaker_role, entity_type, semantic_role, eval_slice, gold_action, base_action AS predicted_action FROM decided),
ds AS (SELECT subject, speaker_role, entity_type, semantic_role, eval_slice, gold_action, final_action AS predicted_action FROM decided),
u AS (SELECT 'b' AS side, * FROM ({_unfold_sql('db')}) UNION ALL SELECT 's', * FROM ({_unfold_sql('ds')})), {_metrics_sql('u', 'side, slice, value')},
mm AS (SELECT side, slice, value, sum(support) AS count, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM rep GROUP BY ALL) {cte}"""


@query("a21_slice_verdicts", _two("""SELECT slice, value, s.count AS count, round(b.accuracy, 6) AS base_accuracy, round(b.macro_f1, 6) AS base_macro_f1, round(s.accuracy, 6) AS selected_accuracy,
  round(s.macro_f1, 6) AS selected_macro_f1, CASE WHEN s.macro_f1 - b.macro_f1 >= 1e-1 OR s.accuracy - b.accuracy >= 1e-1 THEN 'improved materially'
  WHEN s.macro_f1 > b.macro_f1 OR s.accuracy > b.accuracy THEN 'improved slightly' ELSE 'did not improve' END AS assessment
FROM (SELECT * FROM mm WHERE side = 'b') b JOIN (SELECT * FROM mm WHERE side = 's') s USING (slice, value)"""))
def slice_verdicts(spark, root):
    d = _decided(spark, root)
    selected = M.action_metrics(M.confusion(d))
    base = M.action_metrics(M.confusion(d.withColumn("predicted_action", F.col("base_predicted_action"))))
    return rounded(A.slice_verdicts(base, selected))


@query("a22_residual_concentration", f"""{CAL}, {DECIDED}, c AS (SELECT coalesce(entity_type, 'n/a') AS type, count(*) AS n FROM decided WHERE final_action <> gold_action GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, type) AS r FROM c)
SELECT sum(n) AS error_count, string_agg(type, ',' ORDER BY r) FILTER (r <= 3) AS top_types, round(CAST(sum(n) FILTER (r <= 2) AS DOUBLE) / sum(n), 6) AS top_two_share,
  CAST(sum(n) FILTER (r <= 2) AS DOUBLE) / sum(n) >= 6e-1 AS concentrated FROM o""")
def residual_concentration(spark, root):
    return rounded(A.residual_concentration(_decided(spark, root)))


_MODELS = ("first", "second", "third")


def _three_models(spark, root):
    """Predictions of three models as one long table, pivoted by id: a single shuffle."""
    long = None
    for i, name in enumerate(_MODELS, start=1):
        part = I.decisions(spark, root, i).select("id", "gold_action", F.lit(name).alias("model"), "predicted_action")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("id", "gold_action").pivot("model", list(_MODELS)).agg(F.first("predicted_action"))


_PIVOT = f"WITH {DEC}, {I.decisions_sql('d2', 2)}, {I.decisions_sql('d3', 3)}, pv AS (SELECT id, dec.gold_action, dec.predicted_action AS first, d2.predicted_action AS second, d3.predicted_action AS third FROM dec JOIN d2 USING (id) JOIN d3 USING (id))"


@query("j3_models_by_id", f"{_PIVOT} SELECT * FROM pv")
def models_by_id(spark, root):
    return _three_models(spark, root)


@query("a23_model_error_buckets", f"""{_PIVOT} SELECT bucket, count(*) AS n FROM (SELECT 'all_wrong' AS bucket FROM pv WHERE first <> gold_action AND second <> gold_action AND third <> gold_action UNION ALL
SELECT 'only_first_right' FROM pv WHERE first = gold_action AND second <> gold_action AND third <> gold_action UNION ALL
SELECT 'all_redact_against_keep_or_review' FROM pv WHERE gold_action <> 'REDACT' AND first = 'REDACT' AND second = 'REDACT' AND third = 'REDACT') GROUP BY bucket""")
def model_error_buckets(spark, root):
    return A.model_error_buckets(_three_models(spark, root), list(_MODELS), "first").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("a29_hardest_review_misses", f"{CAL} SELECT id, predicted_action, round(confidence, 6) AS confidence FROM feat WHERE gold_action = 'REVIEW' AND predicted_action <> 'REVIEW' ORDER BY feat.confidence DESC, id LIMIT 8")
def hardest_review_misses(spark, root):
    return rounded(A.hardest_review_misses(_calibrated(spark, root)).select("id", "predicted_action", "confidence"))


@query("j1_total_gold_prediction_join", f"""WITH {DEC}, {I.decisions_sql('ev', 2)} SELECT d.gold_action, e.predicted_action, count(*) AS n FROM dec d JOIN ev e USING (id) GROUP BY ALL""")
def total_gold_prediction_join(spark, root):
    from ..operators.quality import join_predictions

    gold = I.decisions(spark, root).select("id", "gold_action")
    pred = I.decisions(spark, root, 2).select("id", "predicted_action", F.col("latency_ms").alias("position"))
    return join_predictions(gold, pred, "position").groupBy("gold_action", "predicted_action").agg(F.count(F.lit(1)).alias("n"))


@query("j2_base_and_selected_join", f"{CAL}, {DECIDED} SELECT final_action, base_action, count(*) AS n FROM decided GROUP BY ALL")
def base_and_selected_join(spark, root):
    from ..operators.quality import join_base_and_selected

    gold = I.decisions(spark, root).select("id", "gold_action")
    base = I.decisions(spark, root).select("id", "predicted_action")
    both = join_base_and_selected(gold, base, _decided(spark, root))
    return both.filter("not mismatch").groupBy(
        F.col("selected_action").alias("final_action"), "base_action").agg(F.count(F.lit(1)).alias("n"))
