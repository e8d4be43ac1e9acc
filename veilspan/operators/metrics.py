"""Span and decision metrics by slice.

Every metric is a ratio of counts.  Rows are first reduced to counts per slice
combination (one shuffle, combined on the map side); slices, labels and policies
are then unfolded on that small table, never on the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACTIONS
from ..functions import labels as L


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    value = F.try_divide(num.cast("double"), den.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def token_bucket(count: Column) -> Column:
    return F.when(count <= 4, "1-4").when(count <= 8, "5-8").when(count <= 16, "9-16").otherwise("17+")


def unfold_slices(df: DataFrame, slices: Mapping[str, Column], overall: bool = True) -> DataFrame:
    """One copy per slice of an aggregated table; null slice values are dropped."""
    parts = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value"))] if overall else []
    parts += [F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value")) for n, c in slices.items()]
    return (
        df.withColumn("__s", F.explode(F.array(*parts))).filter("__s.value is not null")
        .select(F.col("__s.slice").alias("slice"), F.col("__s.value").alias("value"),
                *[c for c in df.columns])
    )


# --- span metrics ---------------------------------------------------------------------
def span_counts(df: DataFrame, gold: str = "gold_labels", pred: str = "pred_labels") -> DataFrame:
    """Per-row ``gold_n, pred_n, tp_n`` under the scoring reader; no shuffle."""
    spans = df.select("*", L.spans_scoring(gold).alias("__g"), L.spans_scoring(pred).alias("__p"))
    return spans.select(
        *df.columns,
        F.size("__g").alias("gold_n"), F.size("__p").alias("pred_n"),
        F.size(F.array_intersect("__g", "__p")).alias("tp_n"),
        L.has_positive(gold).alias("gold_pos"), L.has_positive(pred).alias("pred_pos"),
        F.size(gold).alias("token_count"),
    )


def candidate_metrics(df: DataFrame, subject: str = "subject", role: str = "speaker_role",
                      gold: str = "gold_labels", pred: str = "pred_labels") -> DataFrame:
    """P/R/F1 overall, by subject, role, length bucket and on positive rows only."""
    counted = span_counts(df.select(subject, role, gold, pred), gold, pred)
    cells = counted.groupBy(
        F.col(subject).alias("subject"), F.col(role).alias("speaker_role"),
        token_bucket(F.col("token_count")).alias("bucket"), "gold_pos",
    ).agg(
        F.count(F.lit(1)).alias("count"), F.sum("gold_n").alias("gold"), F.sum("pred_n").alias("pred"),
        F.sum("tp_n").alias("tp"), F.sum("token_count").alias("tokens"),
        F.sum(F.col("pred_pos").cast("int")).alias("pred_pos_rows"),
    )
    unfolded = unfold_slices(cells, {
        "subject": F.col("subject"), "speaker_role": F.col("speaker_role"), "token_bucket": F.col("bucket"),
        "positive_rows": F.when(F.col("gold_pos"), "only"),
    })
    grouped = unfolded.groupBy("slice", "value").agg(
        F.sum("count").alias("count"), F.sum("tokens").alias("token_count"),
        F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"),
        F.sum(F.when(F.col("gold_pos"), F.col("count")).otherwise(0)).alias("gold_positive_rows"),
        F.sum("pred_pos_rows").alias("predicted_positive_rows"),
    )
    p, r = ratio(F.col("tp"), F.col("pred"), 0), ratio(F.col("tp"), F.col("gold"), 0)
    return grouped.select(
        "slice", "value", "count", "token_count", p.alias("precision"), r.alias("recall"),
        ratio(2 * F.col("tp"), F.col("gold") + F.col("pred"), 0).alias("f1"),
        "gold_positive_rows", "predicted_positive_rows",
    )


def worst_context_recall(metrics: DataFrame) -> DataFrame:
    """Lowest recall over subjects; a subject without gold spans counts as 0."""
    return metrics.filter("slice = 'subject'").agg(F.min("recall").alias("worst_context_recall"))


# --- decision metrics -------------------------------------------------------------------
ACTION_SLICES = ("subject", "speaker_role", "entity_type", "semantic_role", "eval_slice")


def confusion(df: DataFrame, slices: Sequence[str] = ACTION_SLICES, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, slice, value, gold_action, predicted_action, n``."""
    cells = df.groupBy(*keys, *slices, "gold_action", "predicted_action").agg(F.count(F.lit(1)).alias("n"))
    return (
        unfold_slices(cells, {s: F.col(s) for s in slices})
        .groupBy(*keys, "slice", "value", "gold_action", "predicted_action").agg(F.sum("n").alias("n"))
    )


def label_report(conf: DataFrame, keys: Sequence[str] = ("slice", "value")) -> DataFrame:
    """Precision, recall, F1 and support of every label seen in gold or predictions."""
    hit = F.when(F.col("gold_action") == F.col("predicted_action"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold_action").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("tp")),
        F.struct(F.col("predicted_action").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp")),
    )
    per = conf.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    return per.select(
        *keys, "label", "support", "predicted", "tp",
        ratio(F.col("tp"), F.col("predicted"), 0).alias("precision"),
        ratio(F.col("tp"), F.col("support"), 0).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 0).alias("f1"),
    )


def action_metrics(conf: DataFrame, keys: Sequence[str] = ("slice", "value")) -> DataFrame:
    """Accuracy, macro-F1 over labels present, and REDACT recall."""
    return label_report(conf, keys).groupBy(*keys).agg(
        F.sum("support").alias("count"),
        ratio(F.sum("tp"), F.sum("support"), 0).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.max(F.when(F.col("label") == "REDACT", F.col("recall"))), F.lit(0.0)).alias("redact_recall"),
    )


def worst_context_redact_recall(metrics: DataFrame) -> DataFrame:
    return metrics.filter("slice = 'subject'").agg(F.min("redact_recall").alias("worst_context_redact_recall"))


def classification_report(conf: DataFrame) -> DataFrame:
    """Per-label rows plus accuracy, macro and weighted averages for the overall slice."""
    per = label_report(conf.filter("slice = 'overall'"), ("slice",)).drop("slice")
    rows = per.select("label", "precision", "recall", "f1", "support")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    weight = per.agg(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1"), F.sum("support").alias("support"))
    acc = ratio(F.sum("tp"), F.sum("support"), 0)
    accuracy = per.agg(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                       acc.alias("f1"), F.sum("support").alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weight)


def keep_rates(df: DataFrame) -> DataFrame:
    """Share of gold KEEP kept (cerr) and redacted (orr); null when there is none."""
    keep = F.col("gold_action") == "KEEP"
    share = lambda a: ratio(F.count_if(keep & (F.col("predicted_action") == a)), F.count_if(keep))
    return df.agg(share("KEEP").alias("cerr"), share("REDACT").alias("orr"))


def decision_totals(df: DataFrame) -> DataFrame:
    """Review rate, label distributions, mean cost and mean latency."""
    counts = [F.count_if(F.col(c) == a).alias(f"{side}_{a.lower()}")
              for side, c in (("gold", "gold_action"), ("predicted", "predicted_action")) for a in ACTIONS]
    return df.agg(
        F.count(F.lit(1)).alias("count"),
        ratio(F.count_if(F.col("predicted_action") == "REVIEW"), F.count(F.lit(1))).alias("review_rate"),
        *counts, F.avg("cost").alias("avg_cost"), F.avg("latency_ms").alias("avg_latency_ms"),
    )


# --- deferral metrics --------------------------------------------------------------------
CELL = ("gold_action", "base_predicted_action", "predicted_action", "deferred")


def decision_cells(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, *CELL).agg(F.count(F.lit(1)).alias("n"))


def deferral_metrics(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All deferral ratios from counts per (gold, base, final, deferred)."""
    n, gold, base, final = (F.col(c) for c in ("n", "gold_action", "base_predicted_action", "predicted_action"))
    deferred = F.col("deferred")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    rate = lambda num, den, empty=None: ratio(total(num), total(den), empty)
    true, wrong = F.lit(True), base != gold
    redact, review, keep = gold == "REDACT", gold == "REVIEW", gold == "KEEP"
    support = {a: total(gold == a) for a in ACTIONS}
    guessed = {a: total(final == a) for a in ACTIONS}
    tp = {a: total((gold == a) & (final == a)) for a in ACTIONS}
    f1 = [ratio(2 * tp[a], support[a] + guessed[a]) for a in ACTIONS]
    # A label absent from both sides has no F1 and does not enter the mean.
    present = sum(F.when(x.isNotNull(), 1).otherwise(0) for x in f1)
    macro = sum(F.coalesce(x, F.lit(0.0)) for x in f1) / present
    protected = rate(redact & (final != "KEEP"), redact)
    return cells.groupBy(*keys).agg(
        F.sum(n).alias("count"),
        ratio(total(gold == final), F.sum(n)).alias("accuracy"),
        macro.alias("macro_f1"),
        rate(redact & (final == "REDACT"), redact, 0).alias("redact_recall"),
        rate(keep & (final == "KEEP"), keep).alias("cerr"),
        rate(keep & (final == "REDACT"), keep).alias("orr"),
        rate(final == "REVIEW", true).alias("review_rate"),
        (1.0 - rate(final == "REVIEW", true)).alias("automation_rate"),
        total(deferred).alias("deferred_count"),
        protected.alias("protected_redact_rate"),
        (1.0 - protected).alias("redact_leak_rate"),
        rate(redact & (final == "REVIEW"), redact).alias("gold_redact_defer_rate"),
        rate(review & (final == "REVIEW"), review).alias("gold_review_coverage"),
        rate(review & (final == "REVIEW"), final == "REVIEW").alias("review_precision"),
        rate(wrong, true, 0).alias("base_error_rate"),
        rate(wrong & deferred, wrong).alias("deferred_error_coverage"),
        rate(~wrong & deferred, ~wrong).alias("deferred_correct_rate"),
    )
