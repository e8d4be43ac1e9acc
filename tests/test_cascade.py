"""Plugged scorers and the cascade: every span ends in one place."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspan.operators import cascade as K
from veilspan.operators import policy as Y
from veilspan.operators import scoring as U
from veilspan.queries.inputs import GOLD_PATTERN
from veilspan.queries.selection import length_scorer, regex_detector, rule_scorer

TEXTS = ["mail ana@example.org or Alexandrinopolis", "", None, "http://a.b/Constantinopolitan 10.0.0.7 Alexandrinopolis", "call +49 555-123 4567, Alexandrinopolis!",
         "nothing here"]


def turns(spark):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(TEXTS)], "session_id string, turn_index long, text string")


def a_policy(spark, **limits):
    row = {"ord": 0, "strategy": "confidence", **{p: limits.get(p) for p in Y.PARAMETERS}}
    grid = spark.createDataFrame([row], "ord int, strategy string, " + ", ".join(f"{p} double" for p in Y.PARAMETERS))
    return K.FittedPolicy(spark.createDataFrame([(1.0,)], "t double"), grid, grid.select("ord"))


def always(redact, keep, review):
    return lambda: lambda batch: [(redact, keep, review)] * batch.num_rows


def test_plugged_candidates_equal_the_built_in_ones(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS) if t is not None], "id string, text string")
    a, b = (sorted(map(tuple, U.score_candidates(docs, f, pattern=GOLD_PATTERN).collect())) for f in (None, regex_detector))
    assert a == b and any("B-SUSPECT" in r[1] for r in a)


def test_a_scorer_is_made_once_per_task_and_sees_small_batches(spark):
    made, seen, largest = (spark.sparkContext.accumulator(0) for _ in range(3))

    def factory():
        made.add(1)

        def score(batch):
            seen.add(batch.num_rows), largest.add(int(batch.num_rows > 7))
            return [[] for _ in range(batch.num_rows)]

        return score

    docs = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("some text").alias("text"), F.lit(1).alias("other")).coalesce(2)
    out = U.with_candidate_labels(docs, factory, batch_rows=7)
    assert out.columns == ["id", "text", "other", "tokens", "predicted_labels"] and out.count() == 100
    assert (made.value, seen.value, largest.value) == (2, 100, 0)


def test_wrong_answers_fail_the_job(spark):
    docs = spark.createDataFrame([("1", "abc"), ("2", "de")], "id string, text string")
    with pytest.raises(PySparkException, match="answers to"):
        U.score_candidates(docs.coalesce(1), lambda: lambda batch: [[]]).collect()
    with pytest.raises(PySparkException, match="outside the text of 2"):
        U.score_candidates(docs, lambda: lambda batch: [[(0, 3)]] * batch.num_rows).collect()


def test_plugged_actions_keep_other_columns(spark):
    rows = spark.createDataFrame([("1", "a@b.org", "x", None, 7), ("2", "x", "the lesson", "EMAIL_ADDRESS", 8), ("3", "x", "the lesson", None, 9), ("4", "x", "", None, 1)],
                                 "id string, span_text string, context_text string, entity_type string, more int")
    got = {r.id: (r.predicted_action, r.confidence, r.more) for r in U.with_action_scores(rows, rule_scorer, batch_rows=2).collect()}
    assert got == {"1": ("REDACT", 0.9, 7), "2": ("REDACT", 0.9, 8), "3": ("KEEP", 0.9, 9), "4": ("REVIEW", 0.9, 1)}


def test_direct_identifiers_win_over_candidates_and_scores(spark):
    done = K.run(turns(spark), a_policy(spark, max_confidence=0.0), scorer=always(0.1, 0.8, 0.1), candidate_pattern=r"\p{Lu}\p{L}{9,}")
    assert sorted((r.turn_index, r.span_text, r.predicted_action) for r in done.decided.collect()) == [
        (0, "Alexandrinopolis", "KEEP"), (0, "ana@example.org", "REDACT"), (3, "10.0.0.7", "REDACT"), (3, "Alexandrinopolis", "KEEP"),
        (3, "http://a.b/Constantinopolitan", "REDACT"), (4, "+49 555-123 4567", "KEEP"), (4, "Alexandrinopolis", "KEEP")]
    assert {r.turn_index: r.redacted for r in done.rendered.collect()} == {
        0: "mail [EMAIL_ADDRESS_1] or Alexandrinopolis", 1: "", 2: None, 3: "[URL_1] [IP_1] Alexandrinopolis", 4: TEXTS[4], 5: TEXTS[5]}
    assert done.queue.count() == 0


def test_what_is_deferred_stays_in_the_text_and_waits(spark):
    def by_length():
        return lambda batch: [(0.6, 0.3, 0.1) if len(s) == 16 else (0.9, 0.05, 0.05) for s in batch.column("span_text").to_pylist()]

    done = K.run(turns(spark), a_policy(spark, max_confidence=0.7), scorer=by_length, candidate_pattern=r"\p{Lu}\p{L}{9,}")
    waiting = {(r.turn_index, r.span_text): (r.base_predicted_action, r.deferred) for r in done.queue.collect()}
    assert waiting == {(i, "Alexandrinopolis"): ("REDACT", True) for i in (0, 3, 4)} | {(4, "+49 555-123 4567"): ("REDACT", True)}
    assert {r.turn_index: r.redacted for r in done.rendered.collect()}[3] == "[URL_1] [IP_1] Alexandrinopolis"


def test_every_span_is_in_one_place(spark):
    done = K.run(turns(spark), a_policy(spark, max_confidence=0.4), detector=regex_detector, scorer=length_scorer)
    n = {r.predicted_action: r["count"] for r in done.decided.groupBy("predicted_action").count().collect()}
    replaced = done.rendered.agg(F.sum(F.size("spans"))).first()[0]
    assert replaced == n.get("REDACT", 0) and done.queue.count() == n.get("REVIEW", 0) and sum(n.values()) == 4
    assert K.run(turns(spark).limit(0), a_policy(spark), scorer=length_scorer).rendered.count() == 0
