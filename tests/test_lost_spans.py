import pytest
from pyspark.errors import PySparkException

from veilspan.operators import spans as S

KIND = "dialogue_id string, transcript string, spans array<struct<start:int,end:int,text:string,pii_type:string>>"
TEXT = "Student: my name is Ana\nVOLUNTEER: hello Ana"


def test_spans_that_cannot_be_placed_fail_the_job(spark):
    table = lambda *span: spark.createDataFrame([("d", TEXT, [span])], KIND)
    gone = table(5, 8, "Zoe", "person-name")
    for project in (S.project_turns, S.project_segments):
        with pytest.raises(PySparkException, match="Zoe"):
            project(gone).collect()
    at = TEXT.index("Ana\nVOL")
    crossing = table(at, at + 7, "Ana\nVOL", "person-name")
    with pytest.raises(PySparkException, match="in no single turn"):
        S.project_turns(crossing).collect()
    assert S.project_segments(crossing).count() == 1


def test_quarantine(spark):
    at = TEXT.index("Ana\nVOL")
    rows = [("d", TEXT, [(5, 8, "Zoe", "person-name"), (at, at + 7, "Ana\nVOL", None), (at, at + 3, "Ana", "person-name"), (11, 12, " ", "person-name")]),
            ("e", "no prefix", []), ("f", "", None), ("g", TEXT, [(0, 7, "Student", "person-name"), (len(TEXT) - 3, len(TEXT), "Ana", "person-name")])]
    done = S.project_with_quarantine(spark.createDataFrame(rows, KIND), "turn")
    assert sorted((r.dialogue_id, r.start, r.reason) for r in done.lost.collect()) == [
        ("d", 5, "text not nearby"), ("d", 11, "no token"), ("d", at, "in no single turn"), ("g", 0, "in no single turn")]
    assert done.counts == {"dialogues": 4, "placed": 2, "lost": 4}
    assert sorted(r.id for r in done.rows.filter("size(token_spans) > 0").collect()) == ["d-turn-0", "g-turn-1"]
    none = S.project_with_quarantine(spark.createDataFrame([], KIND), "segment")
    assert (none.rows.count(), none.lost.count(), none.counts["lost"]) == (0, 0, 0)


def test_planning_runs_nothing(spark):
    """No job starts before the rows are asked for."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        S.project_turns(spark.createDataFrame([("d", TEXT, [(5, 8, "Zoe", "person-name")])], KIND))
        assert list(tracker.getJobIdsForGroup("plan")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")
