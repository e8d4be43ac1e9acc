"""The sink of one file a row, run names, and summaries by name."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspan.sources import readers, sinks
from veilspan.sources.keyed_files import KeyedFileWriter, write_keyed


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("_SUCCESS"))


def test_every_row_is_a_file(spark, tmp_path):
    rows = [(f"g{i % 3}/d{i}.txt", f"line {i}\nü") for i in range(40)] + [("top.txt", ""), ("g0/d0.txt", "line 0\nü")]
    write_keyed(spark.createDataFrame(rows, "name string, content string").repartition(5), f"file://{tmp_path}/out")
    root = f"{tmp_path}/out"
    assert listed(root) == sorted({n for n, _ in rows})
    for name, content in rows:
        with open(f"{root}/{name}", encoding="utf-8", newline="") as f:
            assert f.read() == content
    with open(f"{root}/_SUCCESS") as f:
        assert f.read() == "42"
    write_keyed(spark.createDataFrame([("top.txt", "new")], "name string, content string"), root)  # a plain path; the later content stays
    assert spark.read.text(f"{root}/top.txt").first().value == "new"


@pytest.mark.parametrize("name", ["", None, "../up.txt", "a//b", "/abs"])
def test_names_that_leave_the_folder_fail(spark, tmp_path, name):
    with pytest.raises((PySparkException, AttributeError)):
        write_keyed(spark.createDataFrame([("ok.txt", "x"), (name, "y")], "name string, content string").coalesce(1), f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out/_SUCCESS") and listed(f"{tmp_path}/out") in ([], ["ok.txt"])


def test_a_broken_write_leaves_no_draft(tmp_path):
    class Row:
        name = "a.txt"

        class content:
            @staticmethod
            def encode():
                raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        KeyedFileWriter(str(tmp_path)).write(iter([Row]))
    assert listed(tmp_path) == []


def test_run_names_are_numbered(spark):
    rows = [(i, "My Run!" if i % 3 else "", "2024-01-02 03:04:05" if i % 2 else "2024-01-02 03:04:06") for i in range(30)]
    df = spark.createDataFrame(rows, "run_id long, name string, at string").withColumn("started", F.to_timestamp("at"))
    got = {r.run_id: r.folder for r in sinks.run_folder_names(df).collect()}
    want, seen = {}, {}
    for i, name, at in rows:
        base = at.replace("-", "").replace(":", "").replace(" ", "_") + "_" + ("my-run" if name else "experiment")
        seen[base] = seen.get(base, 0) + 1
        want[i] = base if seen[base] == 1 else f"{base}_{seen[base]}"
    assert got == want


def test_newest_summary_of_each_name_and_kind(spark, tmp_path):
    body = lambda name, kind, f1: f'{{"run_name":"{name}","run_kind":"{kind}","selected_targets":[{{"target_review_rate":0.1,"strategy":"s","macro_f1":{f1}}}]}}'
    rows = [("20240101_000000_a/summary.json", body("a", "x", 0.1)), ("20240102_000000_a/summary.json", body("a", "x", 0.2)),
            ("20240103_000000_a/summary.json", body("a", "y", 0.3)), ("20240101_000000_b/summary.json", body("b", "x", 0.4))]
    write_keyed(spark.createDataFrame(rows, "name string, content string"), f"{tmp_path}/runs")
    found = readers.read_summaries(spark, f"{tmp_path}/runs")
    got = {(r.run_name, r.run_kind): r.macro_f1 for r in readers.target_entry(readers.latest_summaries(found), 0.1).collect()}
    assert got == {("a", "x"): 0.2, ("a", "y"): 0.3, ("b", "x"): 0.4}
    assert readers.target_entry(readers.latest_summary(found, "a", "x"), 0.1).first().macro_f1 == 0.2
