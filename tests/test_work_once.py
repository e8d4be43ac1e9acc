"""Texts are gone through once, however many spans, lists or queries read the outcome."""

from pyspark.sql import functions as F

from veilspan.functions import prompts as P
from veilspan.operators import sampling as N
from veilspan.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_excerpts_collapse_a_turn_before_its_tags(spark):
    """F18"""
    plan = plan_of(QUERIES["w12_span_excerpt"](spark, "/root/testdata/sf0.001"))
    above = plan[:plan.index("Generate")]
    assert r"x{85}\p{Z}]+,  " not in above and "low#" in above
    rows = spark.createDataFrame([(" a  <X>\tb ", "<X>"), ("long " * 60 + "<X>", "<X> "), ("", "<X>"), ("abc", "q"), (None, "q")], "t string, s string")
    flat = F.trim(F.regexp_replace("t", r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+", " "))
    both = rows.select(P.span_excerpt(F.col("t"), F.col("s")).alias("a"), P.excerpt_of(flat, F.lower(flat), F.col("s")).alias("b")).collect()
    assert all(r.a == r.b for r in both) and both[0].a == "a <X> b"


def test_selections_score_their_items_once(spark):
    """F13, F15, F19 to F22"""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    items = spark.range(40).select(
        F.when(F.col("id") % 2 == 0, "english").otherwise("social_studies").alias("subject"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("s"), F.col("id") % 9).alias("session_id"), F.when(F.col("id") % 3 == 0, "PERSON").otherwise("COURSE").alias("entity_type"),
        counted(F.lit(1)).alias("challenge"), counted((F.col("id") % 4).cast("int")).alias("private_prior"), F.lit(0).alias("person_private"), F.lit(0).alias("bonus"))
    for select in (lambda: N.select_natural(items, 6, 2, 17, "v2", 3, 1), lambda: N.select_challenge(items, 6, 2, 17)):
        before = seen.value
        assert select().count() == 12
        assert seen.value - before <= 80
