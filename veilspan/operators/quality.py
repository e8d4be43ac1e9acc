"""Validation, alignment, leakage and set checks.

Checks return tables of violations, so a job can report them all; ``require_none``
turns such a table into a failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACTIONS
from ..functions import labels as L
from ..functions.rules import canonical_type
from ..functions.tokens import explode_rows
from .metrics import ratio


class DataViolation(ValueError):
    """Raised when a required check finds rows."""


def require_none(violations: DataFrame, what: str, show: int = 10) -> None:
    """Fail with the first few violations; an empty table passes."""
    rows = violations.limit(show).collect()
    if rows:
        raise DataViolation(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


# --- records --------------------------------------------------------------------------------
def _reported(df: DataFrame, key: str, checks: Sequence[Column]) -> DataFrame:
    return explode_rows(df.select(F.col(key).cast("string").alias("id"), F.array_compact(F.array(*checks)).alias("__c")),
                        F.col("__c"), "problem").drop("__c")


def candidate_violations(df: DataFrame) -> DataFrame:
    """``id, problem`` for missing fields and token/label length mismatches."""
    checks = [F.when(F.col(c).isNull(), f"missing {c}") for c in ("id", "subject", "tokens", "labels")]
    checks.append(F.when(F.size("tokens") != F.size("labels"), "tokens/labels length mismatch"))
    return _reported(df, "id", checks)


def action_violations(df: DataFrame) -> DataFrame:
    return _reported(df, "id", [
        F.when(F.col(c).isNull(), f"missing {c}")
        for c in ("id", "subject", "span_text", "context_text", "action_label")])


def duplicate_ids(*tables: DataFrame, key: str = "id") -> DataFrame:
    ids = tables[0].select(key)
    for t in tables[1:]:
        ids = ids.unionByName(t.select(key))
    return ids.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def union_unique(*tables: DataFrame, key: str = "id") -> DataFrame:
    """Concatenation that fails on any repeated id."""
    require_none(duplicate_ids(*tables, key=key).orderBy(key), "duplicate ids")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# --- predictions ------------------------------------------------------------------------------
def alignment(gold: DataFrame, pred: DataFrame, labels: str = "labels", predicted: str = "predicted_labels") -> DataFrame:
    """Rows that are missing, extra or of another label length."""
    g = gold.select("id", F.size(labels).alias("__g"))
    p = pred.select("id", F.size(predicted).alias("__p"))
    status = F.when(F.col("__p").isNull(), "missing").when(F.col("__g").isNull(), "extra").when(
        F.col("__g") != F.col("__p"), "length")
    return g.join(p, "id", "full").select("id", status.alias("status")).filter("status is not null")


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    missing = gold.select("id").join(pred.select("id"), "id", "left_anti").withColumn("side", F.lit("missing"))
    extra = pred.select("id").join(gold.select("id"), "id", "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def id_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def last_predictions(pred: DataFrame, position: str) -> DataFrame:
    """One prediction per id: the last one written wins."""
    rest = [c for c in pred.columns if c != "id"]
    return pred.groupBy("id").agg(F.max_by(F.struct(*rest), position).alias("__r")).select("id", "__r.*")


def join_predictions(gold: DataFrame, pred: DataFrame, position: str | None = None) -> DataFrame:
    """Total join: extra predictions are ignored, a missing one raises."""
    if position:
        pred = last_predictions(pred, position).drop(position)
    both = gold.join(pred.withColumn("__hit", F.lit(True)), "id", "left")
    guard = F.when(F.col("__hit").isNull(), F.raise_error(F.concat(F.lit("missing prediction for id="), "id")).cast("boolean")).otherwise(True)
    return both.filter(guard).drop("__hit")


def join_base_and_selected(gold: DataFrame, base: DataFrame, selected: DataFrame) -> DataFrame:
    """Three-way join; ``mismatch`` marks rows whose recorded base action differs."""
    b = base.select("id", F.col("predicted_action").alias("base_action"))
    s = selected.select("id", F.col("predicted_action").alias("selected_action"), F.col("base_predicted_action").alias("__rec"), "deferred")
    out = join_predictions(join_predictions(gold, b), s)
    return out.withColumn("mismatch", F.col("__rec").isNotNull() & (F.col("__rec") != F.col("base_action"))).drop("__rec")


# --- splits -------------------------------------------------------------------------------------
def leakage(df: DataFrame, key: str = "dialogue_id", split: str = "split") -> DataFrame:
    """Keys seen in more than one split: one shuffle instead of pairwise intersections."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def exclude_used(df: DataFrame, used: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Drop rows whose key was used before; a used row without a key is an error."""
    require_none(used.filter(F.col(key).isNull()).select(key), f"null {key} in exclusion table")
    return df.join(used.select(key).distinct(), key, "left_anti")


def provisional_counts(df: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Rows with provisional labels per split, and whether the split may hold them."""
    provisional = F.coalesce(F.col("provisional_action"), F.lit(False)) | F.coalesce(
        F.col("label_source") == "legacy_redact_only", F.lit(False))
    out = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(provisional).alias("provisional"))
    return out.withColumn("allowed", (F.col("provisional") == 0) | (F.col("split").isin(*allowed) if allowed else F.lit(False)))


def split_audit(df: DataFrame, split: str, labels: str = "labels") -> DataFrame:
    n = F.size(labels)
    out = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(n).alias("tokens"),
        F.count_if(L.has_positive(labels)).alias("positive_rows"),
        F.sum(L.positive_count(labels)).alias("positive_tokens"), F.max(n).alias("max_tokens_per_row"))
    return out.select(
        split, "rows", "tokens", "positive_rows",
        F.round(ratio(F.col("positive_rows"), F.col("rows"), 0), 6).alias("positive_row_rate"),
        "positive_tokens", F.round(ratio(F.col("positive_tokens"), F.col("tokens"), 0), 6).alias("positive_token_rate"),
        F.round(ratio(F.col("tokens"), F.col("rows"), 0), 3).alias("avg_tokens_per_row"), "max_tokens_per_row")


def label_renames(df: DataFrame, raw: str) -> DataFrame:
    counts = df.groupBy(F.col(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("canonical", canonical_type(F.col("label"))).filter("label <> canonical")


def count_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old``/``new``: label, n.  Per-label delta and where the label exists."""
    both = old.select("label", F.col("n").alias("o")).join(new.select("label", F.col("n").alias("w")), "label", "full").fillna(0, ["o", "w"])
    return both.select(
        "label", F.col("o").alias("old"), F.col("w").alias("new"), (F.col("w") - F.col("o")).alias("delta"),
        F.when(F.col("w") == 0, "removed").when(F.col("o") == 0, "added").otherwise("both").alias("status"))


def drift_totals(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.sum(F.least("old", "new")).alias("overlap_count"),
        F.sum(F.greatest(F.col("old") - F.col("new"), F.lit(0))).alias("removed_count"),
        F.sum(F.greatest(F.col("new") - F.col("old"), F.lit(0))).alias("added_count"))


def metric_diff(recorded: DataFrame, computed: DataFrame, digits: int = 4) -> DataFrame:
    """``path, value`` tables; everything computed must be recorded, equal after rounding."""
    both = computed.join(recorded.select("path", F.col("value").alias("recorded")), "path", "left")
    problem = F.when(F.col("recorded").isNull(), "missing in recorded").when(
        F.round("recorded", digits) != F.round("value", digits), "differs")
    return both.withColumn("problem", problem).filter("problem is not null")


# --- annotation and scoring state ---------------------------------------------------------------
def unlabelled(df: DataFrame, label: str = "action_label") -> DataFrame:
    return df.filter(F.col(label).isNull() | ~F.col(label).isin(*ACTIONS))


def pending(todo: DataFrame, done: DataFrame, run: Mapping[str, str] | None = None, label: str = "predicted_action") -> DataFrame:
    """Rows still to score, after checking that the finished rows belong to this run."""
    require_none(duplicate_ids(done), "duplicate scored ids")
    require_none(unlabelled(done, label).select("id", label), "invalid scored labels")
    for name, value in (run or {}).items():
        require_none(done.filter(~F.col(name).eqNullSafe(F.lit(value))).select("id", name), f"{name} differs")
    return todo.join(done.select("id"), "id", "left_anti")


def is_complete(df: DataFrame, expected: int | Column) -> DataFrame:
    """``expected`` is a number or a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", (F.col("rows") == expected).alias("complete"))
