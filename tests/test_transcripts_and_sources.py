"""Transcript parsing, offset repair, scans and sinks on literal fixtures."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspan.operators import quality as Q
from veilspan.operators import spans as S
from veilspan.sources import readers, sinks

TEXT = "intro line\nStudent: hi Ana\r\nmore Bo\nVOLUNTEER:  ok\n\nStudent:\nend"


def test_lines_and_turns(spark):
    df = spark.createDataFrame([(TEXT,), ("a\x0bb\x1cc",), ("",)], "t string")
    got = df.select(S.transcript_lines("t").alias("l"), S.transcript_turns("t").alias("u"), "t").collect()
    for r in got:
        want, at = [], 0
        for raw in r.t.splitlines(keepends=True) or [""]:
            want.append((at, raw.rstrip("\r\n")))
            at += len(raw)
        assert [(x.start, x.text) for x in r.l] == want
    turns = [(x.speaker_role, x.text, TEXT[x.start:x.end].replace("\r\n", "\n")) for x in got[0].u]
    assert turns == [("unknown", "intro line", "intro line"), ("student", "hi Ana\nmore Bo", "hi Ana\nmore Bo"),
                     ("volunteer", "ok\n", "ok\n"), ("student", "\nend", "\nend")]


def test_offset_repair_modes(spark):
    text = "say  Anna now and Anna again" + "." * 200 + "far"
    cases = [(5, 9, "Anna", "exact"), (5, 8, "Anna", "inclusive_end"), (4, 9, "Anna", "trimmed"), (3, 8, "Anna", "trimmed_inclusive_end"),
             (5, 8, "nna", "shift_right"), (12, 16, "Anna", "local_search"), (0, 3, "far", None), (9, 5, "Anna", None)]
    df = spark.createDataFrame([(i, text, *c[:3]) for i, c in enumerate(cases)], "i int, transcript string, start int, end int, text string")
    rows = {r.i: r for r in S.repair_offsets(df).collect()}
    for i, (s, e, want, mode) in enumerate(cases):
        r = rows[i]
        assert r.resolution == mode, (i, r)
        if mode:
            assert text[r.resolved_start:r.resolved_end] == want
    assert rows[5].resolved_start == 18  # nearest, not leftmost


def test_segments_merge_lines(spark):
    text = "l0\nl1 abc\nl2 def\nl3\nl4\nl5"
    spans = [dict(start=6, end=14), dict(start=17, end=19), dict(start=23, end=25)]
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int>>")
    got = [(x.start_line, x.end_line) for x in df.select(S.transcript_segments("t", "s").alias("g")).first().g]
    assert got == [(0, 0), (1, 3), (4, 4), (5, 5)]
    got = [(x.start_line, x.end_line) for x in df.select(S.transcript_segments("t", "slice(s, 1, 1)").alias("g")).first().g]
    assert got == [(0, 0), (1, 2), (3, 3), (4, 4), (5, 5)]


def test_ground_truth_to_candidate_rows(spark, tmp_path):
    body = {"transcript": TEXT, "pii_occurrences": [{"start": 23, "end": 25, "text": "Ana", "pii_type": "person-name"}, {"start": 33, "end": 35, "text": "Bo", "label": "odd"}]}
    (tmp_path / "d1.ground_truth.json").write_text(json.dumps(body))
    (tmp_path / "d2.ground_truth.json").write_text(json.dumps({"id": "named", "transcript": "Student: no one", "spans": []}))
    df = readers.read_ground_truth(spark, str(tmp_path))
    assert {r.dialogue_id for r in df.collect()} == {"d1.ground_truth", "named"}
    rows = {r.id: r for r in S.project_turns(df).collect()}
    one = rows["d1.ground_truth-turn-1"]
    assert list(zip(one.tokens, one.labels)) == [("hi", "O"), ("Ana", "B-SUSPECT"), ("more", "O"), ("Bo", "B-SUSPECT")]
    assert one.types == "NAME,ODD" and "d1.ground_truth-turn-3" in rows
    assert S.unprojected(df, S.project_segments(df)).count() == 0


def test_jsonl_and_validation(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    good = {"id": "1", "subject": "m", "tokens": ["é"], "labels": ["O"], "metadata": {"k": 1}}
    path.write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "id": "2", "labels": []}) + "\n" + json.dumps({"id": "3", "subject": "m"}) + "\n")
    assert [r.id for r in readers.read_candidate(spark, str(path), strict=False).collect()] == ["1"]
    with pytest.raises(PySparkException):
        readers.read_candidate(spark, str(path)).collect()
    raw = readers.read_jsonl(spark, str(path), readers.CANDIDATE_SCHEMA)
    assert sorted((r.id, r.problem) for r in Q.candidate_violations(raw).collect()) == [
        ("2", "tokens/labels length mismatch"), ("3", "missing labels"), ("3", "missing tokens")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{nope\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        readers.read_jsonl(spark, str(bad), readers.CANDIDATE_SCHEMA).collect()
    sinks.write_jsonl(raw.select("tokens"), str(tmp_path / "out"))
    assert any("\\u00E9" in p.read_text() or "\\u00e9" in p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_lesson_transcripts(spark, tmp_path):
    for folder, text in (("AU", "﻿00:00:01\tT\tGood morning\r\nTop of Form\nnoise\n00:00:09\tSN\t hi \n00:00:10\tO\tTop of Form"), ("copy/AU", None), ("XX", "00:00:01\tT\tno")):
        d = tmp_path / folder
        d.mkdir(parents=True)
        name = "Science AU1 transcript.txt" if folder != "XX" else "Science XX1 transcript.txt"
        (d / name).write_bytes(text.encode() if text else (tmp_path / "AU" / name).read_bytes())
    rows = readers.read_transcripts(spark, str(tmp_path), ["au "]).orderBy("turn_index").collect()
    assert [(r.dialogue_id, r.turn_index, r.speaker_role, r.text) for r in rows] == [
        ("timss-science-au1", 1, "teacher", "Good morning"), ("timss-science-au1", 2, "student", "hi")]
    (tmp_path / "copy/AU/Science AU1 transcript.txt").write_text("00:00:01\tT\tother")
    assert readers.transcript_conflicts(spark, str(tmp_path), ["AU"]).count() == 1
    with pytest.raises(PySparkException):
        readers.read_transcripts(spark, str(tmp_path), ["AU"]).collect()


def test_ledger_folders_and_summaries(spark, tmp_path):
    row = spark.createDataFrame([("c1", "action", "0.5", "keep", "a b")], ", ".join(f"{c} string" for c in sinks.LEDGER))
    for _ in range(2):
        sinks.append_ledger(row, str(tmp_path / "ledger"))
    assert sinks.read_ledger(spark, str(tmp_path / "ledger")).count() == 2
    now = dt.datetime(2026, 1, 2, 3, 4, 5)
    names = [sinks.run_folder(spark, str(tmp_path / "runs"), "My Run!", now).rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["20260102_030405_my-run", "20260102_030405_my-run_2", "20260102_030405_my-run_3"]
    for i, n in enumerate(names):
        (tmp_path / "runs" / n / "summary.json").write_text(json.dumps({"run_name": "m", "run_kind": "k", "selected_targets": [{"target_review_rate": 0.1, "strategy": f"s{i}", "macro_f1": 0.5}]}))
    found = readers.read_summaries(spark, str(tmp_path / "runs"))
    last = readers.latest_summary(found, "m", "k")
    assert [r.strategy for r in readers.target_entry(last, 0.1).collect()] == ["s2"]
    sinks.write_markdown(row, ["commit", "status"], str(tmp_path / "md"))
    assert "".join(p.read_text() for p in (tmp_path / "md").glob("part*")) == "| commit | status |\n|---|---|\n| c1 | keep |\n"


def test_quality_guards(spark):
    gold = spark.createDataFrame([("1", "KEEP"), ("2", "REDACT")], "id string, gold_action string")
    pred = spark.createDataFrame([("1", "KEEP", 1), ("1", "REDACT", 2), ("9", "KEEP", 3)], "id string, predicted_action string, pos int")
    with pytest.raises(PySparkException):
        Q.join_predictions(gold, pred, "pos").collect()
    both = Q.join_predictions(gold.filter("id = '1'"), pred, "pos").collect()
    assert [(r.id, r.predicted_action) for r in both] == [("1", "REDACT")]
    with pytest.raises(Q.DataViolation):
        Q.union_unique(gold, gold)
    with pytest.raises(Q.DataViolation):
        Q.pending(gold, pred.withColumn("predicted_action", F.lit("MAYBE")).filter("id = '9'"))
    with pytest.raises(Q.DataViolation):
        Q.exclude_used(gold.withColumnRenamed("id", "dialogue_id"), spark.createDataFrame([(None,)], "dialogue_id string")).collect()


def test_radius_context_goes_by_place_not_by_number(spark):
    from veilspan.operators.context import radius_context

    turns = spark.createDataFrame([("d", t, "s", f"t{t}") for t in (0, 5, 9, 100_000)], "dialogue_id string, turn_index long, speaker_role string, text string")
    got = {r.turn_index: r.context_text for r in radius_context(turns, 1).collect()}
    assert got == {0: "s: t0\ns: t5", 5: "s: t0\ns: t5\ns: t9", 9: "s: t5\ns: t9\ns: t100000", 100_000: "s: t9\ns: t100000"}
