"""Sinks: JSON lines, JSON summaries, the run ledger, run folders and Markdown tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scaled import block, ranked

LEDGER = ("commit", "stage", "primary_metric", "status", "description")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One ASCII-escaped object per line, in parts."""
    df.write.mode(mode).option("writeNonAsciiCharacterAsCodePoint", True).json(path)


def summary_json(df: DataFrame) -> DataFrame:
    """Rows of an (already aggregated) summary as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))


def append_ledger(df: DataFrame, path: str) -> None:
    """Append ``commit, stage, primary_metric, status, description`` as tab-separated parts."""
    df.select(*LEDGER).write.mode("append").option("sep", "\t").csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(", ".join(f"{c} string" for c in LEDGER)).csv(path)


def slug(name: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(clean == "", "experiment").otherwise(clean)


def run_folder_names(runs: DataFrame, run_id: str = "run_id", name: str = "name", started: str = "started") -> DataFrame:
    """``runs`` with ``folder``, ``<timestamp>_<slug>``; of runs that would share one the later ids get ``_2``, ``_3`` and so on.

    ``run_id`` is a whole number.  What exists on disk already is the business of :func:`run_folder`.
    """
    base = F.concat(F.date_format(started, "yyyyMMdd_HHmmss"), F.lit("_"), slug(F.col(name)))
    numbered = ranked(runs.withColumn("__stem", base), ["__stem"], [F.col(run_id)], block(F.col(run_id)), "__n")
    more = F.when(F.col("__n") > 1, F.concat(F.lit("_"), F.col("__n").cast("string"))).otherwise("")
    return numbered.withColumn("folder", F.concat("__stem", more)).drop("__stem", "__n")


def run_folder(spark: SparkSession, root: str, name: str, now: dt.datetime | None = None) -> str:
    """Create ``<timestamp>_<slug>`` below ``root``; ``_2``, ``_3`` on collision."""
    stem = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "experiment"
    base = f"{root.rstrip('/')}/{(now or dt.datetime.now()):%Y%m%d_%H%M%S}_{stem}"
    jvm = spark.sparkContext._jvm
    for i in range(1, 10_000):
        folder = jvm.org.apache.hadoop.fs.Path(base if i == 1 else f"{base}_{i}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            fs.mkdirs(folder)
            return folder.toString()
    raise RuntimeError(f"no free run folder for {base}")


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Aggregated rows as Markdown table lines with their position (header first)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |"
    rule = "|" + "---|" * len(columns)
    top = df.sparkSession.range(2).select(F.col("id").alias("part"), F.when(F.col("id") == 0, head).otherwise(rule).alias("line"))
    return top.unionByName(df.select(F.lit(2).cast("long").alias("part"), line.alias("line")))


def write_markdown(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Write a (small, aggregated) report as one text file."""
    markdown_rows(df, columns).orderBy("part", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
