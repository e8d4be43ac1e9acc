"""Three-class probability arithmetic: calibration, features and deferral tests.

Probabilities and features are flat double columns, added one stage per ``select``.
Packing them in structs would let the optimiser inline every field into every use,
and the generated code would outgrow the compiler.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12
CLASSES = ("redact", "keep", "review")
FEATURES = ("confidence", "margin", "review_probability", "entropy", "normalized_entropy")


def normalise(df: DataFrame, redact: str, keep: str, review: str, prefix: str = "p_") -> DataFrame:
    """Scores clipped at 0 and divided by their sum; null when all are 0."""
    raw = [F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))).alias(f"__{n}")
           for c, n in zip((redact, keep, review), CLASSES)]
    df = df.select("*", *raw)
    df = df.select("*", (F.col("__redact") + F.col("__keep") + F.col("__review")).alias("__total"))
    return df.select("*", *[F.try_divide(F.col(f"__{n}"), F.col("__total")).alias(f"{prefix}{n}") for n in CLASSES]).drop(
        "__total", *[f"__{n}" for n in CLASSES])


def argmax(prefix: str = "p_") -> Column:
    """Ties resolve to REDACT, then KEEP, then REVIEW."""
    r, k, v = (F.col(f"{prefix}{n}") for n in CLASSES)
    return F.when((r >= k) & (r >= v), "REDACT").when(k >= v, "KEEP").otherwise("REVIEW")


def _settled(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Add columns that later filters read as values.

    A filter is pushed through a projection by substituting its expressions; after a
    few stages of arithmetic that expression no longer compiles.  It is not pushed
    through a generator, and a one-element ``inline`` costs nothing.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*columns))))


def _logs(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("*", *[F.log(F.greatest(F.col(f"{prefix}{n}"), F.lit(EPSILON))).alias(f"__l{n}") for n in CLASSES])


def _softened(df: DataFrame, temperature: str) -> DataFrame:
    t = F.col(temperature)
    df = df.select("*", *[(F.col(f"__l{n}") / t).alias(f"__s{n}") for n in CLASSES])
    df = df.select("*", F.greatest(*[F.col(f"__s{n}") for n in CLASSES]).alias("__top"))
    df = df.select("*", *[F.exp(F.col(f"__s{n}") - F.col("__top")).alias(f"__e{n}") for n in CLASSES])
    return df.select("*", (F.col("__eredact") + F.col("__ekeep") + F.col("__ereview")).alias("__sum"))


_SCRATCH = [f"__{k}{n}" for k in "lse" for n in CLASSES] + ["__top", "__sum"]


def temper(df: DataFrame, temperature: str, prefix: str = "p_", out: str = "q_") -> DataFrame:
    """Temperature scaling by a column of temperatures; identity at 1."""
    same = F.abs(F.col(temperature) - 1.0) < 1e-9
    df = _softened(_logs(df, prefix), temperature)
    return _settled(df, [
        F.when(same, F.col(f"{prefix}{n}")).otherwise(F.col(f"__e{n}") / F.col("__sum")).alias(f"{out}{n}") for n in CLASSES
    ]).drop(*_SCRATCH)


def grid_losses(df: DataFrame, gold: str, grid: list[float], prefix: str = "p_") -> DataFrame:
    """``t, loss`` for every row and grid temperature."""
    gold_is = lambda kind: F.when(F.col(gold) == "REDACT", F.col(f"{kind}redact")).when(
        F.col(gold) == "KEEP", F.col(f"{kind}keep")).otherwise(F.col(f"{kind}review"))
    held = _logs(df.select(gold, *[f"{prefix}{n}" for n in CLASSES]), prefix).select("*", gold_is(prefix).alias("__pg"))
    spread = _softened(held.select("*", F.explode(F.array(*[F.lit(t) for t in grid])).alias("t")), "t")
    chosen = F.when(F.abs(F.col("t") - 1.0) < 1e-9, F.col("__pg")).otherwise(gold_is("__e") / F.col("__sum"))
    return spread.select("t", (-F.log(F.greatest(chosen, F.lit(EPSILON)))).alias("loss"))


def with_features(df: DataFrame, prefix: str = "q_") -> DataFrame:
    """Add :data:`FEATURES` of the probabilities under ``prefix``."""
    p = {n: F.col(f"{prefix}{n}") for n in CLASSES}
    plogp = lambda x: x * F.log(F.greatest(x, F.lit(EPSILON)))
    df = _settled(df, [
        F.greatest(*p.values()).alias("confidence"), F.abs(p["redact"] - p["keep"]).alias("margin"),
        p["review"].alias("review_probability"),
        (-(plogp(p["redact"]) + plogp(p["keep"]) + plogp(p["review"]))).alias("entropy")])
    return df.select("*", (F.col("entropy") / math.log(3)).alias("normalized_entropy"))


def should_defer(base: Column, q: Column) -> Column:
    """Whether policy ``q`` sends a decision to review; model-emitted REVIEW never defers."""
    conf, margin, entropy, review = (F.col(c) for c in ("confidence", "margin", "entropy", "review_probability"))
    kind = q["strategy"]
    redact = base == "REDACT"
    test = (
        F.when(kind == "confidence", conf <= q["max_confidence"])
        .when(kind == "margin", margin <= q["max_margin"])
        .when(kind == "entropy", entropy >= q["min_entropy"])
        .when(kind == "review_probability", review >= q["min_review_probability"])
        .when(kind == "composite", (conf <= q["max_confidence"]) | (margin <= q["max_margin"])
              | (entropy >= q["min_entropy"]) | (review >= q["min_review_probability"]))
        .when(kind == "asymmetric_confidence", conf <= F.when(redact, q["redact_max_confidence"]).otherwise(q["keep_max_confidence"]))
        .when(kind == "asymmetric_margin", margin <= F.when(redact, q["redact_max_margin"]).otherwise(q["keep_max_margin"]))
        .otherwise(F.lit(False))
    )
    return F.when(base == "REVIEW", F.lit(False)).otherwise(test)
