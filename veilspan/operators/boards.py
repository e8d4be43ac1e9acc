"""Leaderboards and points over experiment runs.

``runs``: project, agent, run_id, ts, metric, kind (hypothesis kind), gpu.
Lower metrics are better unless ``ascending=False``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scaled import first_k, ranked, running_min_before
from ..session import cut_lineage

CHUNKS = 64


def _signed(ascending: bool) -> Column:
    return F.col("metric") if ascending else -F.col("metric")


def leaderboard(runs: DataFrame, ascending: bool = True) -> DataFrame:
    """Per project and agent: best run with its kind (and ``gpu``, if given), run count, last update, and rank.

    Ranks are chunked at quantiles of the best metrics, so a project with very many agents is not sorted
    in one task, whatever the metric's scale; ranks do not depend on where the chunks are cut.
    """
    key = F.struct(_signed(ascending), F.col("run_id"))
    shown = ["metric", "kind", "run_id", *(["gpu"] if "gpu" in runs.columns else [])]
    best = runs.groupBy("project", "agent").agg(
        F.min_by(F.struct(*shown), key).alias("b"), F.count(F.lit(1)).alias("runs"), F.max("ts").alias("updated"))
    rows = cut_lineage(best.select("project", "agent", *[f"b.{c}" for c in shown], "runs", "updated"))
    signed = _signed(ascending)
    cuts = rows.agg(F.percentile_approx(signed, [k / CHUNKS for k in range(1, CHUNKS)])).first()[0] or []
    chunk = F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda x: x <= signed))
    return ranked(rows, ["project"], [signed, F.col("agent")], chunk, "rank")


def header(runs: DataFrame) -> DataFrame:
    return runs.groupBy("project").agg(F.count_distinct("agent").alias("agents"), F.count(F.lit(1)).alias("experiments"))


def improvements(runs: DataFrame, chunk: Column | None = None, ascending: bool = True) -> DataFrame:
    """``is_new_best`` and ``improvement`` (positive is better) against the agent's own previous best, by time."""
    by_day = F.date_trunc("day", "ts") if chunk is None else chunk
    signed = runs.withColumn("__m", _signed(ascending))
    out = running_min_before(signed, ["project", "agent"], [F.col("ts"), F.col("run_id")], by_day, "__m", "__best")
    new = F.col("__best").isNull() | (F.col("__m") < F.col("__best"))
    return out.withColumns({
        "previous_best": F.col("__best") if ascending else -F.col("__best"), "is_new_best": new,
        "improvement": F.when(new, F.col("__best") - F.col("__m"))}).drop("__m", "__best")


def snapshot(board: DataFrame, runs: DataFrame, top: int = 10) -> DataFrame:
    """Per project: top agents, global best (the first of the board) and experiment count."""
    lead = board.filter(F.col("rank") <= top).groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("rank", "agent", "metric"))).alias("top"), F.min_by("metric", "rank").alias("global_best"))
    return lead.join(header(runs), "project")


def mutation_frequency(hypotheses: DataFrame, pattern: str = r"^([a-z]+)") -> DataFrame:
    return hypotheses.groupBy("project", F.regexp_extract("hypothesis", pattern, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def loss_curves(runs: DataFrame, curve: str = "loss_curve") -> DataFrame:
    """``[[step, loss]]`` to rows."""
    return runs.select("run_id", F.posexplode(curve).alias("i", "p")).select(
        "run_id", "i", F.get("p", F.lit(0)).alias("step"), F.get("p", F.lit(1)).alias("loss"))


def adoption(runs: DataFrame) -> DataFrame:
    """Agents other than the first that used a kind after its first appearance."""
    first = runs.groupBy("kind").agg(F.min(F.struct("ts", "run_id", "agent")).alias("f"))
    later = runs.join(first, "kind").filter((F.col("ts") > F.col("f.ts")) & (F.col("agent") != F.col("f.agent")))
    return later.groupBy("kind").agg(F.count_distinct("agent").alias("adopters"))


# --- points -----------------------------------------------------------------------------------
def uptime_bonus(hours: Column) -> Column:
    """1 + 0.2 ln(1 + t/12)."""
    return 1 + 0.2 * F.log(1 + hours / 12)


def _since_first(df: DataFrame) -> DataFrame:
    first = df.groupBy("agent").agg(F.min("seconds").alias("__first"))
    return df.join(first, "agent").withColumn("hours", (F.col("seconds") - F.col("__first")) / 3600.0).drop("__first")


def presence_points(beats: DataFrame, epoch: int = 90, base: float = 10.0) -> DataFrame:
    """Cumulative points per agent; ``beats``: agent, seconds, weight.  An epoch counts once."""
    epochs = beats.groupBy("agent", (F.floor(F.col("seconds") / epoch) * epoch).alias("seconds")).agg(F.max("weight").alias("weight"))
    return _since_first(epochs).groupBy("agent").agg(
        F.count(F.lit(1)).alias("epochs"), F.sum(base * uptime_bonus(F.col("hours")) * F.col("weight")).alias("points"))


def work_points(work: DataFrame) -> DataFrame:
    """``work``: agent, seconds, tokens, unit_cost, multiplier."""
    return _since_first(work).groupBy("agent").agg(
        F.sum(F.col("tokens") * F.col("unit_cost") * F.col("multiplier") * uptime_bonus(F.col("hours"))).alias("points"))


def pass_rate(results: DataFrame) -> DataFrame:
    return results.groupBy("skill").agg(F.count(F.lit(1)).alias("tests"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def top_runs(runs: DataFrame, k: int) -> DataFrame:
    return first_k(runs, ["project"], [F.col("metric"), F.col("run_id")], k, "rank")
