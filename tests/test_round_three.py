"""Findings of round 3: queries against their SQL on small tables made for the fault."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.operators import sampling as N
from veilspan.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


def _both(spark, name, root):
    """The rows of a query and of its SQL on the same folder, as sorted text."""
    con = duckdb.connect()
    for f in os.listdir(root):
        source = f"{root}/{f}/*.parquet" if os.path.isdir(f"{root}/{f}") else f"{root}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{source}')")
    df = QUERIES[name](spark, str(root))
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    rows = lambda found: sorted(tuple(str(v) for v in r) for r in found)
    return rows(df.select(*cols).collect()), rows([[r[i] for i in at] for r in res.fetchall()])


def _talks(spark, root, texts):
    """``conversations`` of one turn for each text, in conversations 0, 1, ..."""
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


def test_bonus_counts_cues(spark, tmp_path):
    root = _talks(spark, tmp_path / "t", ["Berlin has a book", "Berlin saw a civil war", "Berlin bookish", "Berlin warlike", "Berlin booké", "Berlin 2"])
    got, want = _both(spark, "r12_curricular_bonus", root)
    assert got == want and [r[0] for r in got] == ["0", "0", "0", "0", "2", "2"]


def test_spans_repaired_to_one_place_stay_two(spark, tmp_path):
    root = _talks(spark, tmp_path / "t", ["abcd Berlin Berlin", "a Berlin Berlin"])
    got, want = _both(spark, "t21_turn_rows", root)
    assert got == want and {r[2] for r in got} == {"2"}


def test_language_markers_are_whole_words(spark, tmp_path):
    root = _talks(spark, tmp_path / "t", ["Berlin undécimo", "x", "Berlin UND", "x", "Berlin etles"])
    got, want = _both(spark, "r16_session_exclusion", root)
    assert got == want == [("2", "english")]


def test_long_numbers_look_like_phones(spark, tmp_path):
    orders = spark.read.parquet(f"{ROOT}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 9_000_000)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{ROOT}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    got, want = _both(spark, "u2_action_scoring", str(tmp_path))
    assert got == want and {r[1] for r in got} == {"REDACT"}


# Two ways of repair; the three lines as one segment, as the labels are crossed; one label of more than eight letters.
LABELLED = {"t15_offset_repair": 2, "t20_transcript_segments": 1, "t22_segment_rows": 1, "t23_supported_annotations": 1}


@pytest.mark.parametrize("name", LABELLED)
def test_speaker_labels_are_annotations(spark, tmp_path, name):
    rows = [(0, 0, "user", "one."), (0, 1, "assistant", "two."), (0, 2, "user", "three")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = _both(spark, name, str(tmp_path))
    assert got == want and len(got) == LABELLED[name]


def test_pool_rows_travel_without_the_tokens_of_their_text(spark):
    rows = spark.createDataFrame([("a", "x", ["Ann", "has", "12", "+", "3"], ["O"] * 5, ["O"] * 5)],
                                 "id string, subject string, tokens array<string>, gold_labels array<string>, pred_labels array<string>")
    pool = N.span_pool(rows)
    sent = [line for line in pool._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line or "RowNumber" in line or "Filter" in line]
    assert sent and not any("tokens" in line for line in sent)
    assert "tokens" not in pool._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert sorted((r.pool_source, r.start, r.end, r.span_text) for r in pool.collect()) == [
        ("math_probe", 1, 4, "has 12 +"), ("titlecase_probe", 0, 1, "Ann")]
