"""Audits and comparisons of span and decision predictions."""

from __future__ import annotations

from functools import reduce

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONTACT_HINTS, FORMAT_HINTS, RARE_TYPES
from ..functions import labels as L
from ..functions import rules as R
from ..functions.text import contains_any
from ..functions.tokens import explode_rows
from ..plans.scaled import first_k
from .metrics import ratio, unfold_slices


def span_length_bucket(length: Column) -> Column:
    return F.when(length <= 1, "1").when(length == 2, "2").when(length <= 4, "3-4").otherwise("5+")


# --- span audit -------------------------------------------------------------------------
def seed_hits(df: DataFrame, seeds: str = "seeds", pred: str = "pred_labels") -> DataFrame:
    """One row per seed span with ``candidate_hit``, ``direct_hit`` and ``protected``.

    ``seeds`` is ``array<struct<start,end,span_text,action_label,entity_type>>`` on the
    row, so the overlap test is an ``exists`` over two arrays of the same row.
    """
    held = df.withColumn("__p", L.spans_lenient(pred))
    rows = explode_rows(held, F.col(seeds), "seed")
    hit = L.overlaps_any("seed", "__p")
    direct = R.detect_direct_id(F.col("seed.span_text"), F.col("seed.entity_type")).isNotNull()
    return (
        rows.withColumn("candidate_hit", hit).withColumn("direct_hit", direct)
        .withColumn("protected", F.col("candidate_hit") | F.col("direct_hit"))
        .withColumn("is_redact", F.col("seed.action_label") == "REDACT")
        .drop("__p", seeds)
    )


def seed_coverage(hits: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """Seed coverage and REDACT recall by candidate, by direct rule, by either; per slice."""
    cells = hits.groupBy(*[c.alias(n) for n, c in slices.items()]).agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if("candidate_hit").alias("covered"),
        F.count_if("is_redact").alias("redact"),
        F.count_if(F.col("is_redact") & F.col("candidate_hit")).alias("redact_candidate"),
        F.count_if(F.col("is_redact") & F.col("direct_hit")).alias("redact_direct"),
        F.count_if(F.col("is_redact") & F.col("protected")).alias("redact_protected"),
    )
    out = unfold_slices(cells, {n: F.col(n) for n in slices}).groupBy("slice", "value").agg(
        *[F.sum(c).alias(c) for c in ("seeds", "covered", "redact", "redact_candidate", "redact_direct", "redact_protected")])
    return out.select(
        "slice", "value", F.col("seeds").alias("seed_count"), F.col("redact").alias("redact_seed_count"),
        ratio(F.col("covered"), F.col("seeds")).alias("seed_coverage"),
        ratio(F.col("redact_candidate"), F.col("redact")).alias("candidate_redact_recall"),
        ratio(F.col("redact_direct"), F.col("redact")).alias("direct_id_redact_recall"),
        ratio(F.col("redact_protected"), F.col("redact")).alias("protected_redact_recall"),
    )


def volume(df: DataFrame, gold: str = "gold_labels", pred: str = "pred_labels") -> DataFrame:
    n = lambda c: F.sum(F.size(L.spans_lenient(c)))
    return df.agg(
        n(gold).alias("gold_span_count"), n(pred).alias("predicted_span_count"),
        ratio(n(pred), n(gold)).alias("candidate_volume_multiplier"))


def recall_by_type(hits: DataFrame, kind: Column) -> DataFrame:
    return hits.groupBy(F.coalesce(kind, F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("spans"), ratio(F.count_if("candidate_hit"), F.count(F.lit(1))).alias("recall"))


def rare_type_mean(by_type: DataFrame, rare: Sequence[str] = RARE_TYPES) -> DataFrame:
    return by_type.filter(F.col("type").isin(*rare)).agg(F.avg("recall").alias("rare_type_mean_recall"))


def miss_buckets(hits: DataFrame, subject: Column, role: Column) -> DataFrame:
    """REDACT seeds neither proposed nor caught by rule, counted four ways."""
    missed = hits.filter(F.col("is_redact") & ~F.col("protected")).groupBy(
        F.coalesce(F.col("seed.entity_type"), F.lit("unknown")).alias("entity_type"),
        F.coalesce(role, F.lit("unknown")).alias("speaker_role"),
        span_length_bucket(F.col("seed.end") - F.col("seed.start")).alias("span_length"),
        subject.alias("subject"),
    ).agg(F.count(F.lit(1)).alias("n"))
    names = ("entity_type", "speaker_role", "span_length", "subject")
    return unfold_slices(missed, {n: F.col(n) for n in names}, overall=False).groupBy(
        "slice", "value").agg(F.sum("n").alias("n"))


# --- span errors --------------------------------------------------------------------------
def span_errors(df: DataFrame, gold: str = "gold_labels", pred: str = "pred_labels", raw: str = "text") -> DataFrame:
    """False positives and negatives with a bucket name and a masked preview."""
    base = df.select("*", L.spans_lenient(gold).alias("__g"), L.spans_lenient(pred).alias("__p"))
    tag = lambda spans, kind: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("span")))
    wrong = F.concat(
        tag(F.array_except("__p", "__g"), "fp"), tag(F.array_except("__g", "__p"), "fn"))
    rows = explode_rows(base, wrong, "__e").select(
        *df.columns, "__g", "__p", F.col("__e.kind").alias("error_type"), F.col("__e.span").alias("span"))
    fp = F.col("error_type") == "fp"
    words = F.slice(F.col("tokens"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    rows = rows.withColumn("span_text", L.span_text("tokens", "span")).withColumn("__w", words)
    touches = L.overlaps_any("span", "if(error_type = 'fp', __g, __p)")
    odd = lambda c: contains_any(c, FORMAT_HINTS)
    bucket = (
        F.when(touches, "boundary error")
        .when(odd(F.col(raw)) | odd(F.col("span_text")), "tokenization/formatting issue")
        .when(~fp & contains_any(F.lower("span_text"), CONTACT_HINTS), "URL/contact miss")
        .when(fp & R.error_math_like(F.col("__w")), "math-expression false positive")
        .when(fp & R.error_name_like(F.col("__w")), "curricular/person-name false positive")
        .otherwise("annotation ambiguity")
    )
    return rows.withColumn("bucket", bucket).withColumn(
        "preview", L.masked_preview("tokens", "span", "__g", "__p")
    ).drop("__g", "__p", "__w")


def error_samples(errors: DataFrame, limit: int) -> DataFrame:
    """Shortest previews first, per error type."""
    return first_k(errors, ["error_type"], [F.length("preview"), F.col("id"), F.col("span_text")], limit, "rank")


def top_patterns(errors: DataFrame, limit: int = 2) -> DataFrame:
    return errors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bucket").limit(limit)


def positive_rates(df: DataFrame, pred: str = "pred_labels", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        ratio(F.count_if(L.has_positive(pred)), F.count(F.lit(1)), 0).alias("predicted_positive_row_rate"),
        ratio(F.sum(L.positive_count(pred)), F.sum(F.size(pred)), 0).alias("predicted_positive_token_rate"))


# --- summaries ------------------------------------------------------------------------------
def count_distribution(df: DataFrame, fields: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Value counts of several fields in one pass: ``keys, slice, value, n``."""
    cells = df.groupBy(*keys, *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(f"__{n}") for n, c in fields.items()]
                       ).agg(F.count(F.lit(1)).alias("n"))
    return unfold_slices(cells, {n: F.col(f"__{n}") for n in fields}, overall=False).groupBy(
        *keys, "slice", "value").agg(F.sum("n").alias("n"))


def pool_summary(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Per subject and slice: rows, distinct sessions, and most rows of one session."""
    per = df.groupBy("subject", "eval_slice", session).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("subject", "eval_slice").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sessions"), F.max("n").alias("max_rows_per_session"))


# --- annotator agreement ----------------------------------------------------------------------
def paired_annotations(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left``/``right``: id, action_label, semantic_role (nullable)."""
    side = lambda d, s: d.select("id", F.col("action_label").alias(f"{s}_label"), F.col("semantic_role").alias(f"{s}_role"))
    both = side(left, "left").join(side(right, "right"), "id")
    labelled = F.col("left_label").isNotNull() & F.col("right_label").isNotNull()
    same = F.col("left_label").eqNullSafe(F.col("right_label")) & F.col("left_role").eqNullSafe(F.col("right_role"))
    return both.withColumn("labelled", labelled).withColumn("agree", labelled & same)


def agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count_if("labelled").alias("shared_labelled"), F.count_if("agree").alias("shared_agree"),
        ratio(F.count_if("agree"), F.count_if("labelled")).alias("agreement"))


def agreement_pairs(pairs: DataFrame) -> DataFrame:
    name = F.concat_ws("->", F.concat_ws(":", "left_label", F.coalesce("left_role", F.lit("None"))),
                       F.concat_ws(":", "right_label", F.coalesce("right_role", F.lit("None"))))
    return pairs.filter("labelled").groupBy(name.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~F.col("agree")).select("id", "left_label", "right_label", "left_role", "right_role")


# --- base against selected policy ---------------------------------------------------------------
BUCKETS = ("gold_keep_or_review_to_redact", "gold_private_not_redact", "gold_review_not_review")


def _in_bucket(name: str, action: Column) -> Column:
    gold = F.col("gold_action")
    return {
        BUCKETS[0]: gold.isin("KEEP", "REVIEW") & (action == "REDACT"),
        BUCKETS[1]: F.coalesce(F.col("semantic_role") == "PRIVATE", F.lit(False)) & (action != "REDACT"),
        BUCKETS[2]: (gold == "REVIEW") & (action != "REVIEW"),
    }[name]


def bucket_rows(df: DataFrame) -> DataFrame:
    """One row per (decision, bucket) that matches before or after deferral."""
    flags = F.array(*[F.struct(
        F.lit(b).alias("bucket"), _in_bucket(b, F.col("base_predicted_action")).alias("base_match"),
        _in_bucket(b, F.col("predicted_action")).alias("selected_match")) for b in BUCKETS])
    return explode_rows(df, flags, "__b").select(*df.columns, "__b.*").filter("base_match or selected_match")


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(
        F.count_if("base_match").alias("base_count"), F.count_if("selected_match").alias("selected_count"))


def bucket_examples(rows: DataFrame, limit: int = 12) -> DataFrame:
    order = [F.col("selected_match").cast("int").desc(), F.col("base_match").cast("int").desc(), F.col("id")]
    return first_k(rows, ["bucket"], order, limit, "rank")


def slice_verdicts(base: DataFrame, selected: DataFrame) -> DataFrame:
    """``base``/``selected``: slice, value, count, accuracy, macro_f1, redact_recall."""
    b = base.select("slice", "value", F.col("accuracy").alias("base_accuracy"), F.col("macro_f1").alias("base_macro_f1"))
    s = selected.select("slice", "value", "count", F.col("accuracy").alias("selected_accuracy"),
                        F.col("macro_f1").alias("selected_macro_f1"))
    df1 = F.col("selected_macro_f1") - F.col("base_macro_f1")
    dacc = F.col("selected_accuracy") - F.col("base_accuracy")
    verdict = (
        F.when(df1.isNull() | dacc.isNull(), "slice missing from one or both variants")
        .when((df1 >= 0.10) | (dacc >= 0.10), "improved materially")
        .when((df1 > 0) | (dacc > 0), "improved slightly").otherwise("did not improve")
    )
    return b.join(s, ["slice", "value"], "full").withColumn("assessment", verdict)


def residual_concentration(df: DataFrame, kind: str = "entity_type") -> DataFrame:
    """How much of the remaining error sits in the two most frequent types."""
    errors = df.filter(F.col("predicted_action") != F.col("gold_action"))
    counts = errors.groupBy(F.coalesce(F.col(kind), F.lit("n/a")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("error_count"))
    top = counts.orderBy(F.desc("n"), "type").limit(3)
    packed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "type", "n"))).alias("top"))
    n_at = lambda i: F.coalesce(F.get(F.col("top"), F.lit(i))["n"], F.lit(0))
    share = F.coalesce(ratio(n_at(0) + n_at(1), F.col("error_count")), F.lit(1.0))
    return total.withColumn("top", packed.scalar()).select(
        "error_count", F.array_join(F.transform("top", lambda t: t["type"]), ",").alias("top_types"),
        share.alias("top_two_share"), (share >= 0.60).alias("concentrated"))


def model_error_buckets(df: DataFrame, models: Sequence[str], focus: str) -> DataFrame:
    """``df``: gold_action plus one predicted-action column per model."""
    gold = F.col("gold_action")
    both = lambda f: reduce(lambda a, b: a & b, f)
    flags = F.array_compact(F.array(
        F.when(both([F.col(m) != gold for m in models]), "all_wrong"),
        F.when(both([(F.col(m) == gold) if m == focus else (F.col(m) != gold) for m in models]), f"only_{focus}_right"),
        F.when((gold != "REDACT") & both([F.col(m) == "REDACT" for m in models]), "all_redact_against_keep_or_review"),
    ))
    return explode_rows(df, flags, "bucket")


def usage_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, token sums and latency; the median is exact."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count_if("repair_used").alias("repair_count"),
        F.sum(F.coalesce("attempt_count", F.lit(1))).alias("attempt_count"),
        total("prompt_tokens"), total("completion_tokens"), total("total_tokens"), total("reasoning_tokens"),
        F.avg("latency_ms").alias("latency_avg"), F.percentile("latency_ms", F.lit(0.5)).alias("latency_median"),
        F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"))


def seed_aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per key; a single row has deviation 0."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), *[
        e for v in values for e in (
            F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_stdev"))])


def policy_stability(df: DataFrame, keys: Sequence[str], variant: str = "no_rules", target: float = 0.10) -> DataFrame:
    rows = df.filter((F.col("variant") == variant) & (F.abs(F.col("target_review_rate") - target) <= 1e-9))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seed_count"), F.count_distinct("strategy").alias("strategy_count"),
        F.avg("review_rate").alias("review_rate_mean"),
        F.coalesce(F.stddev_samp("review_rate"), F.lit(0.0)).alias("review_rate_stdev"),
        F.avg("macro_f1").alias("macro_f1_mean"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("macro_f1_stdev"),
        F.every(F.abs(F.col("legacy_redact_recall") - 1.0) <= 1e-9).alias("all_recall_one"))


def carry_forward_gate(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Better mean, or steadier choice at nearly equal quality with recall intact."""
    b = baseline.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("macro_f1_mean", "strategy_count", "review_rate_stdev")])
    drop = F.col("macro_f1_mean") - F.col("b_macro_f1_mean")
    fewer = F.col("strategy_count") < F.col("b_strategy_count")
    steadier = (F.col("review_rate_stdev") <= F.col("b_review_rate_stdev") * 0.75) | (F.col("review_rate_stdev") <= 0.0315)
    carry = (drop > 0) | ((fewer | steadier) & (drop >= -0.005) & F.col("all_recall_one"))
    return current.join(b, list(keys)).select(*keys, drop.alias("delta_macro_f1"), fewer.alias("strategy_collapsed"),
                         steadier.alias("review_stdev_improved"), carry.alias("carry_forward"))


def override_summary(df: DataFrame) -> DataFrame:
    """``df``: rows with a nullable ``override struct(source, reason)``."""
    hits = df.filter("override is not null").groupBy("override.reason", "override.source").agg(F.count(F.lit(1)).alias("n"))
    return unfold_slices(hits, {"reason": F.col("reason"), "source": F.col("source")}, overall=False).groupBy(
        "slice", "value").agg(F.sum("n").alias("n"))


def override_spot_check(base: DataFrame, patched: DataFrame, limit: int = 10) -> DataFrame:
    """First overridden ids with the action before and after."""
    hit = patched.filter("override is not null").select(
        "id", F.col("predicted_action").alias("patched_action"), F.col("override.reason").alias("reason"))
    return hit.orderBy("id").limit(limit).join(
        base.select("id", F.col("predicted_action").alias("base_action")), "id")


def hardest_review_misses(df: DataFrame, limit: int = 8) -> DataFrame:
    """Gold REVIEW decided otherwise, most confident first."""
    rows = df.filter((F.col("gold_action") == "REVIEW") & (F.col("predicted_action") != "REVIEW"))
    return rows.orderBy(F.desc("confidence"), "id").limit(limit)
