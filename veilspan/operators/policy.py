"""Calibration, review policies and run ranking.

Thresholds, the temperature and the policy grid are tiny, and reach the rows as
scalar subqueries; rows are never multiplied by the grid.  A sweep snaps every
feature to the nearest grid threshold on its losing side (which changes no
comparison), counts rows per snapped cell, and applies the at most 91 policies to
those cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ASYMMETRIC_ANCHORS, COMPOSITE_ANCHORS, SIMPLE_ANCHORS
from ..functions import probability as P
from ..functions import rules as R
from ..session import cut_lineage
from . import metrics as M

# Fixed search range of the temperature fit.
MIN_TEMPERATURE, MAX_TEMPERATURE, TEMPERATURE_STEPS = 0.25, 5.0, 96
_BINS = 1 << 13


# --- calibration ------------------------------------------------------------------------
def temperature_grid() -> list[float]:
    lo, hi = math.log(MIN_TEMPERATURE), math.log(MAX_TEMPERATURE)
    grid = {math.exp(lo + (hi - lo) * i / (TEMPERATURE_STEPS - 1)) for i in range(TEMPERATURE_STEPS)}
    return sorted(grid | {1.0})


def temperature_losses(df: DataFrame, gold: str = "gold_action") -> DataFrame:
    """Mean NLL per grid temperature.

    The grid is unfolded inside the scan stage and combined there, so each task
    sends 97 partial sums, not 97 copies of its rows.
    """
    return P.grid_losses(df, gold, temperature_grid()).groupBy("t").agg(F.avg("loss").alias("nll"))


def fit_temperature(df: DataFrame, gold: str = "gold_action") -> DataFrame:
    """One row ``temperature``: least NLL, lowest temperature on ties."""
    return temperature_losses(df, gold).agg(F.min_by("t", F.struct("nll", "t")).alias("temperature"))


def with_features(df: DataFrame, temperature: DataFrame | float = 1.0) -> DataFrame:
    """Add calibrated ``q_*`` and their features."""
    t = temperature.scalar() if isinstance(temperature, DataFrame) else F.lit(float(temperature))
    return P.with_features(P.temper(df.withColumn("__t", t), "__t").drop("__t"))


# --- thresholds ---------------------------------------------------------------------------
# Upper-tail series carry negated values so that every series is read from below.
def _series(df: DataFrame) -> DataFrame:
    base = F.col("predicted_action")
    item = lambda name, value: F.struct(F.lit(name).alias("series"), value.alias("v"))
    conf, margin = F.col("confidence"), F.col("margin")
    rows = F.array_compact(F.array(
        item("confidence", conf), item("margin", margin),
        item("entropy", -F.col("entropy")), item("review_probability", -F.col("review_probability")),
        F.when(base == "REDACT", item("redact_confidence", conf)), F.when(base == "KEEP", item("keep_confidence", conf)),
        F.when(base == "REDACT", item("redact_margin", margin)), F.when(base == "KEEP", item("keep_margin", margin)),
    ))
    return df.select(F.explode(rows).alias("s")).select("s.series", "s.v")


def tail_thresholds(df: DataFrame) -> DataFrame:
    """Exact k-th values ``series, rate, k, threshold`` with k = clamp(ceil(rate*n), 1, n).

    A histogram finds the bin of each k; only rows of those bins are then counted
    by value.  No global sort, and equal values collapse before they are ranked.
    """
    long = _series(df).withColumn("bin", F.floor(F.col("v") * _BINS))
    hist = long.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series").orderBy("bin")
    cum = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("series")))
    simple = F.array(*[F.lit(r) for r in SIMPLE_ANCHORS])
    asym = F.array(*[F.lit(r) for r in ASYMMETRIC_ANCHORS])
    rates = F.when(F.col("series").rlike("^(redact|keep)_"), asym).otherwise(simple)
    k = F.greatest(F.lit(1), F.least(F.col("total"), F.ceil(F.col("rate") * F.col("total"))))
    hits = cum.withColumn("rate", F.explode(rates)).withColumn("k", k).filter(
        (F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n")))
    targets = hits.select("series", "bin", "rate", "k", (F.col("k") - (F.col("upto") - F.col("n"))).alias("local_k"))
    # At most one target per (series, anchor): 56 rows.
    inside = long.join(F.broadcast(targets.select("series", "bin").distinct()), ["series", "bin"], "left_semi")
    values = inside.groupBy("series", "bin", "v").agg(F.count(F.lit(1)).alias("m"))
    wv = Window.partitionBy("series", "bin").orderBy("v")
    values = values.withColumn("vupto", F.sum("m").over(wv))
    found = values.join(F.broadcast(targets), ["series", "bin"]).filter(
        (F.col("local_k") <= F.col("vupto")) & (F.col("local_k") > F.col("vupto") - F.col("m")))
    upper = F.col("series").isin("entropy", "review_probability")
    return found.select("series", "rate", "k", F.when(upper, -F.col("v")).otherwise(F.col("v")).alias("threshold"))


# --- policy grid ----------------------------------------------------------------------------
PARAMETERS = (
    "max_confidence", "max_margin", "min_entropy", "min_review_probability",
    "redact_max_confidence", "keep_max_confidence", "redact_max_margin", "keep_max_margin",
)
_SIMPLE_PARAMETER = {
    "confidence": "max_confidence", "margin": "max_margin", "entropy": "min_entropy",
    "review_probability": "min_review_probability",
}


def _plans() -> list[tuple[str, dict[str, str]]]:
    """Strategy and ``parameter -> series@rate`` of every policy, in search order."""
    plans: list[tuple[str, dict[str, str]]] = [("none", {})]
    for name, parameter in _SIMPLE_PARAMETER.items():
        plans += [(name, {parameter: f"{name}@{r}"}) for r in SIMPLE_ANCHORS]
    plans += [("composite", {p: f"{n}@{r}" for n, p in _SIMPLE_PARAMETER.items()}) for r in COMPOSITE_ANCHORS]
    for kind in ("confidence", "margin"):
        plans += [
            (f"asymmetric_{kind}", {f"redact_max_{kind}": f"redact_{kind}@{a}", f"keep_max_{kind}": f"keep_{kind}@{b}"})
            for a in ASYMMETRIC_ANCHORS for b in ASYMMETRIC_ANCHORS
        ]
    return plans


def policy_grid(thresholds: DataFrame) -> DataFrame:
    """At most 91 policies ``ord, strategy, <parameters>`` in search order, without repeats."""
    key = F.concat_ws("@", "series", F.col("rate").cast("string"))
    lookup = thresholds.agg(F.map_from_entries(F.collect_list(F.struct(key, "threshold"))).alias("m"))
    rows = []
    for order, (name, params) in enumerate(_plans()):
        values = [f"try_element_at(m, '{params[p]}')" if p in params else "cast(null as double)" for p in PARAMETERS]
        fields = ", ".join(f"'{p}', {v}" for p, v in zip(PARAMETERS, values))
        present = " and ".join(f"map_contains_key(m, '{k}')" for k in params.values()) or "true"
        rows.append(f"if({present}, named_struct('ord', {order}, 'strategy', '{name}', {fields}), null)")
    grid = lookup.select(F.explode(F.expr(f"array_compact(array({', '.join(rows)}))")).alias("g")).select("g.*")
    same = Window.partitionBy("strategy", *[F.round(p, 12) for p in PARAMETERS]).orderBy("ord")
    return grid.withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n")


# --- sweep ----------------------------------------------------------------------------------
def _limits(grid: DataFrame) -> DataFrame:
    """The grid as one row of sorted threshold arrays plus the policies themselves."""
    collect = lambda *cs: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.collect_set(c) for c in cs]))))
    return grid.agg(F.struct(
        collect("max_confidence", "redact_max_confidence", "keep_max_confidence").alias("confidence"),
        collect("max_margin", "redact_max_margin", "keep_max_margin").alias("margin"),
        collect("min_entropy").alias("entropy"), collect("min_review_probability").alias("review_probability"),
    ).alias("limits"))


def _snap(df: DataFrame) -> DataFrame:
    """Replace features by the grid threshold that decides the same comparisons."""
    above = "coalesce(array_min(filter(__l.{0}, t -> t >= {0})), double('infinity'))"
    below = "coalesce(array_max(filter(__l.{0}, t -> t <= {0})), -double('infinity'))"
    return df.withColumns({
        **{c: F.expr(above.format(c)) for c in ("confidence", "margin")},
        **{c: F.expr(below.format(c)) for c in ("entropy", "review_probability")},
    })


SNAPPED = ("confidence", "margin", "entropy", "review_probability")


def snapped_cells(df: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row counts per (keys, gold, base, snapped features)."""
    snapped = _snap(df.withColumn("__l", _limits(grid).scalar()))
    return snapped.groupBy(*keys, "gold_action", F.col("predicted_action").alias("base_predicted_action"), *SNAPPED).agg(
        F.count(F.lit(1)).alias("n"))


def _decided(cells: DataFrame, grid: DataFrame, keep: Sequence[str]) -> DataFrame:
    policies = grid.agg(F.array_sort(F.collect_list(F.struct(*grid.columns))).alias("g")).scalar()
    spread = cells.withColumn("__g", policies).withColumn("g", F.explode("__g")).drop("__g")
    base = F.col("base_predicted_action")
    out = spread.withColumn("deferred", P.should_defer(base, F.col("g")))
    return out.select(
        *keep, F.col("g.ord").alias("ord"), F.col("g.strategy").alias("strategy"), "gold_action",
        "base_predicted_action", F.when(F.col("deferred"), "REVIEW").otherwise(base).alias("predicted_action"),
        "deferred", "n")


def sweep(df: DataFrame, grid: DataFrame, subject: str | None = "subject") -> DataFrame:
    """Deferral metrics of every policy, with the worst REDACT recall over subjects."""
    keys = [subject] if subject else []
    decided = _decided(snapped_cells(df, grid, keys), grid, keys)
    out = M.deferral_metrics(decided.groupBy("ord", "strategy", *M.CELL).agg(F.sum("n").alias("n")), ("ord", "strategy"))
    if not subject:
        return out
    hit = (F.col("gold_action") == "REDACT") & (F.col("predicted_action") == "REDACT")
    per = decided.groupBy("ord", subject).agg(M.ratio(
        F.sum(F.when(hit, F.col("n")).otherwise(0)),
        F.sum(F.when(F.col("gold_action") == "REDACT", F.col("n")).otherwise(0)), 0).alias("r"))
    return out.join(per.groupBy("ord").agg(F.min("r").alias("worst_context_redact_recall")), "ord")


def choose_policy(swept: DataFrame, target: float, fallback: bool = True) -> DataFrame:
    """Best policy within the review budget; else the nearest one (or nothing)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rate = F.col("review_rate")
    fits = rate <= target + 1e-9
    best = [z("gold_review_coverage").desc(), z("protected_redact_rate").desc(), z("macro_f1").desc(),
            z("orr").asc(), z("review_rate").asc(), F.col("ord").asc()]
    near = [F.abs(rate - target).asc(), z("protected_redact_rate").desc(), z("worst_context_redact_recall").desc(),
            z("macro_f1").desc(), z("orr").asc(), F.col("ord").asc()]
    eligible = swept.filter(fits).orderBy(*best).limit(1)
    if not fallback:
        return eligible
    nearest = swept.orderBy(*near).limit(1)
    found = eligible.agg(F.count(F.lit(1)).alias("n")).scalar()
    return eligible.unionByName(nearest.filter(found == 0))


def apply_policy(df: DataFrame, grid: DataFrame, chosen: DataFrame) -> DataFrame:
    """Decisions under one chosen policy (``chosen`` holds its ``ord``)."""
    policy = grid.join(chosen.select("ord"), "ord").agg(F.first(F.struct(*grid.columns)).alias("g")).scalar()
    out = df.withColumn("__g", policy).withColumn("base_predicted_action", F.col("predicted_action"))
    out = out.withColumn("deferred", P.should_defer(F.col("base_predicted_action"), F.col("__g")))
    return out.withColumn("strategy", F.col("__g.strategy")).withColumn(
        "predicted_action", F.when(F.col("deferred"), "REVIEW").otherwise(F.col("base_predicted_action"))).drop("__g")


def override_direct_ids(df: DataFrame, span_text: str = "span_text", entity_type: str = "entity_type") -> DataFrame:
    """Direct identifiers become REDACT with confidence 1; ``override`` says why."""
    df = df.withColumn("override", R.detect_direct_id(F.col(span_text), F.col(entity_type)))
    hit = F.col("override").isNotNull()
    return df.withColumns({
        "predicted_action": F.when(hit, "REDACT").otherwise(F.col("predicted_action")),
        **{f"p_{n}": F.when(hit, 1.0 if n == "redact" else 0.0).otherwise(F.col(f"p_{n}")) for n in P.CLASSES},
    })


def calibrate(df: DataFrame, subject: str = "subject") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(temperature, narrow rows with features, policy grid)``.

    Calibration reads its rows four times, so the six columns it needs are written once.

    The temperature (one row) and the grid (at most 91) are written out: they feed
    several later subqueries, and each would otherwise repeat its pass over the rows.
    """
    df = cut_lineage(df.select(subject, "gold_action", "predicted_action", *[f"p_{n}" for n in P.CLASSES]))
    temperature = cut_lineage(fit_temperature(df))
    cal = with_features(df, temperature)
    return temperature, cal, cut_lineage(policy_grid(tail_thresholds(cal)))


def evaluate_policy(calibration: DataFrame, evaluation: DataFrame, target: float, fallback: bool = True):
    """Fit, derive, sweep and choose on one split; apply to the other.

    Returns ``(chosen, decided)``; ``decided`` holds the evaluation rows.
    """
    temperature, cal, grid = calibrate(calibration)
    chosen = cut_lineage(choose_policy(cut_lineage(sweep(cal, grid)), target, fallback))
    return chosen, apply_policy(with_features(evaluation, temperature), grid, chosen)


def sample_weights(df: DataFrame, subject: str = "subject", label: str = "label") -> DataFrame:
    """1/n(subject) * 1/n(label); counts are joined back, so a hot subject stays spread."""
    by = lambda c, n: df.groupBy(c).agg(F.count(F.lit(1)).alias(n))
    out = df.join(by(subject, "__s"), subject).join(by(label, "__l"), label)
    return out.withColumn("weight", (1.0 / F.col("__s")) * (1.0 / F.col("__l"))).drop("__s", "__l")


# --- review budget and escalation ------------------------------------------------------------
def budget_curve(swept: DataFrame) -> DataFrame:
    """Policies by review rate with the best macro-F1 seen at or below that rate (at most 91 rows)."""
    w = Window.partitionBy(F.lit(0)).orderBy("review_rate", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return swept.select(
        "ord", "strategy", "review_rate", "redact_leak_rate", "gold_review_coverage", "macro_f1",
        F.max("macro_f1").over(w).alias("best_macro_f1"))


def escalation_queue(decided: DataFrame) -> DataFrame:
    return decided.filter("deferred")


def disagreement_packet(decided: DataFrame, kinds: int = 3, per_kind: int = 20, kind: str = "entity_type") -> DataFrame:
    """Errors of the most error-prone types, a fixed number each."""
    from ..plans.scaled import first_k

    errors = decided.filter(F.col("predicted_action") != F.col("gold_action")).withColumn(
        "kind", F.coalesce(F.col(kind), F.lit("n/a")))
    top = errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(kinds).select("kind")
    return first_k(errors.join(F.broadcast(top), "kind", "left_semi"), ["kind"], [F.col("id")], per_kind, "rank")


def cascade_ablation(stages: DataFrame) -> DataFrame:
    """``stages``: stage, gold_action, base_predicted_action, predicted_action, deferred."""
    return M.deferral_metrics(M.decision_cells(stages, ("stage",)), ("stage",))


def dev_objective(metrics: DataFrame, orr_weight: float, cost_weight: float, utility_weight: float = 0.0) -> DataFrame:
    """Min-context recall minus weighted over-redaction, utility drop and cost scaled to the dearest run."""
    dearest = metrics.agg(F.max("avg_cost").alias("m")).scalar()
    return metrics.withColumn("objective", F.col("worst_context_redact_recall") - orr_weight * F.coalesce("orr", F.lit(0.0))
                              - utility_weight * F.coalesce("utility_drop", F.lit(0.0))
                              - cost_weight * F.coalesce(F.try_divide(F.col("avg_cost"), dearest), F.lit(0.0)))


# --- run ranking -------------------------------------------------------------------------------
def _num(c: str, default: float = -1.0) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def guard_runs(runs: DataFrame, incumbent: str, volume_cap: float = 3.0, max_drop: float = 0.01) -> DataFrame:
    """Volume and regression guards against the incumbent's math recall."""
    base = runs.filter(F.col("label") == incumbent).agg(F.max(_num("math_recall")).alias("r")).scalar()
    out = runs.withColumn("math_recall_drop", base - _num("math_recall"))
    return (
        out.withColumn("passes_volume_guard", _num("dev_volume", 1e9) <= volume_cap)
        .withColumn("passes_math_guard", F.col("math_recall_drop") <= max_drop)
        .withColumn("eligible", F.col("passes_volume_guard") & F.col("passes_math_guard"))
        .withColumn("final_min_recall", F.least(_num("test_recall"), _num("second_recall")))
    )


def winner(guarded: DataFrame, incumbent: str, min_gain: float = 0.02) -> DataFrame:
    """Best eligible run (best of all when none is), with the promotion verdict."""
    any_ok = guarded.agg(F.max(F.col("eligible").cast("int")).alias("e")).scalar()
    floor = guarded.filter(F.col("label") == incumbent).agg(F.max("final_min_recall").alias("r")).scalar()
    pool = guarded.filter(F.col("eligible") | (any_ok == 0))
    best = pool.orderBy(F.desc("final_min_recall"), _num("rare_recall").desc(), _num("dev_volume", 1e9).asc(),
                        _num("test_f1").desc(), "label").limit(1)
    return best.withColumn("promoted", (F.col("label") != incumbent) & (F.col("final_min_recall") - floor >= min_gain))


def top_by_dev(guarded: DataFrame, count: int) -> DataFrame:
    return guarded.orderBy(F.col("eligible").cast("int").desc(), _num("dev_recall").desc(),
                           _num("dev_volume", 1e9).asc(), _num("dev_f1").desc(), "label").limit(count)


def best_checkpoint(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy(F.desc("score"), F.desc("step")).limit(1)


def best_checkpoint_by_policy(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy(F.desc("protected_redact_rate"), F.desc("worst_context_redact_recall"),
                               F.desc("macro_f1"), F.asc("review_rate_error"), F.asc("step")).limit(1)


def operating_point(runs: DataFrame, headline: str = "worst_context_recall") -> DataFrame:
    return runs.orderBy(F.desc(headline), F.desc("f1"), F.desc("worst_context_recall"), "label").limit(1)


def detector_sweep_choice(swept: DataFrame, volume_cap: float = 3.0) -> DataFrame:
    ok = _num("candidate_volume_multiplier", 1e9) <= volume_cap
    return swept.withColumn("eligible", ok).orderBy(
        F.col("eligible").cast("int").desc(), _num("recall").desc(), _num("candidate_volume_multiplier", 1e9).asc(),
        _num("f1").desc(), "threshold").limit(1)


def compare_runs(runs: DataFrame, baseline_f1: float, min_gap: float = 0.10) -> DataFrame:
    """Gap to the baseline, the best run flagged, and whether the best gap is large enough."""
    best = runs.agg(F.max("macro_f1").alias("b")).scalar()
    first = runs.agg(F.max_by("label", F.struct("macro_f1", "label")).alias("l")).scalar()
    return runs.withColumn("gap", F.col("macro_f1") - baseline_f1).withColumn("is_best", F.col("label") == first).withColumn(
        "recommended", best - baseline_f1 >= min_gap)


def confirm_over_seeds(seeds: DataFrame, incumbent_min_recall: float, min_gain: float = 0.02) -> DataFrame:
    return seeds.groupBy("config").agg(
        F.every(F.col("passes_math_guard") & F.col("passes_volume_guard")).alias("all_guards"),
        F.avg("final_min_recall").alias("mean_min_recall"),
    ).withColumn("confirmed", F.col("all_guards") & (F.col("mean_min_recall") >= incumbent_min_recall + min_gain))


def adaptation_gate(runs: DataFrame, baseline: str) -> DataFrame:
    """Best configuration against the baseline row on three gains."""
    b = lambda c: runs.filter(F.col("label") == baseline).agg(F.max(c).alias("x")).scalar()
    best = runs.filter(F.col("label") != baseline).orderBy(
        _num("protected_recall").desc(), _num("math_recall").desc(), _num("dev_recall").desc(), "label").limit(1)
    out = best.select(
        "label", (F.col("protected_recall") - b("protected_recall")).alias("protected_gain"),
        (F.col("seed_coverage") - b("seed_coverage")).alias("seed_gain"),
        (b("math_recall") - F.col("math_recall")).alias("math_drop"))
    return out.withColumn("accepted", (F.col("protected_gain") >= 0.05) & (F.col("seed_gain") > 0) & (F.col("math_drop") <= 0.01))


def pareto_front(runs: DataFrame, project: str, better_high: Sequence[str], better_low: Sequence[str] = ()) -> DataFrame:
    """Runs of a project not beaten on every measure at once; equal runs stay or go together.

    A front of fronts is the front: each task keeps only the different points that survive its own
    batches, the exact comparison runs on those few, and the runs at the points that remain are returned.
    """
    measures = [*better_high, *better_low]
    sign = [1.0] * len(better_high) + [-1.0] * len(better_low)
    points = runs.select(project, *measures)

    def survivors(batches):
        kept: dict = {}
        for batch in batches:
            for key, part in batch.groupby(project, dropna=False):
                pool = (pd.concat([kept[key], part]) if key in kept else part).drop_duplicates()
                score = pool[measures].to_numpy(dtype=float) * sign
                beaten = [
                    bool(((score >= row).all(axis=1) & (score > row).any(axis=1)).any()) for row in score
                ]
                kept[key] = pool[[not b for b in beaten]]
        yield from kept.values()

    local = points.mapInPandas(survivors, points.schema).distinct()
    other = local.select(F.col(project).alias("__p"), *[F.col(c).alias(f"__{c}") for c in measures])
    ge = [F.col(f"__{c}") >= F.col(c) for c in better_high] + [F.col(f"__{c}") <= F.col(c) for c in better_low]
    gt = [F.col(f"__{c}") > F.col(c) for c in better_high] + [F.col(f"__{c}") < F.col(c) for c in better_low]
    cond = F.col(project) == F.col("__p")
    for g in ge:
        cond = cond & g
    strictly = gt[0]
    for g in gt[1:]:
        strictly = strictly | g
    front = local.join(other, cond & strictly, "left_anti").select(*[F.col(c).alias(f"__{c}") for c in (project, *measures)])
    same = F.lit(True)
    for c in (project, *measures):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return runs.join(front, same, "left_semi")



