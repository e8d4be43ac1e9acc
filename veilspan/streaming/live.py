"""Live leaderboards with Structured Streaming.

The batch functions in :mod:`boards` give the same answers on the same events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_per_peer(stream: DataFrame, ascending: bool = True, replayed_within: str | None = None) -> DataFrame:
    """Best run and number of different runs per peer; lower metrics are better unless ``ascending=False``.

    Runs are told by their id before they are counted, so a replayed file or a second delivery changes neither the winner nor
    ``runs``.  Every id is kept in state, unless ``replayed_within`` says how long after a run its copies may come: then ids
    older than that are forgotten.
    """
    if replayed_within is None:
        stream = stream.dropDuplicates(["agent", "run_id"])
    else:
        stream = stream.withWatermark("ts", replayed_within).dropDuplicatesWithinWatermark(["agent", "run_id"])
    signed = F.col("metric") if ascending else -F.col("metric")
    best = F.min(F.struct(signed.alias("signed"), "run_id", "metric", "kind"))
    return stream.groupBy("agent").agg(best.alias("best"), F.count(F.lit(1)).alias("runs"), F.max("ts").alias("updated"))


def hourly(runs: DataFrame, ascending: bool = True) -> DataFrame:
    """One row per hour and project, of a table or a stream."""
    best = F.min("metric") if ascending else F.max("metric")
    return runs.groupBy(F.window("ts", "1 hour"), "project").agg(F.count(F.lit(1)).alias("runs"), best.alias("best"))


def hourly_snapshots(stream: DataFrame, lateness: str = "10 minutes", ascending: bool = True) -> DataFrame:
    """One row per closed hour and project; events later than ``lateness`` are dropped."""
    return hourly(stream.withWatermark("ts", lateness), ascending)


def with_open_hours(closed: DataFrame, runs: DataFrame, ascending: bool = True) -> DataFrame:
    """``closed`` and, counted from the table that the stream has read, the hours that the watermark left open."""
    return closed.unionByName(hourly(runs, ascending).join(closed.select("window", "project"), ["window", "project"], "left_anti"))


def drain(result: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process everything available and read back the output table.

    Each micro-batch writes its own sub-folder, so a replayed batch overwrites itself.
    In complete mode the last batch is the answer; in append mode all batches together.
    """
    spark = result.sparkSession
    out = f"{folder}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch:09d}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(
        availableNow=True).start()
    query.awaitTermination()
    table = spark.read.parquet(out)
    if mode == "complete":
        last = table.agg(F.max("epoch").alias("e")).scalar()
        table = table.filter(F.col("epoch") == last)
    return table.drop("epoch")
