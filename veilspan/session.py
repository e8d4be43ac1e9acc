"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veilspan", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none *and* runs in one local JVM (tests) is a
    temporary folder used; on a cluster a machine-local folder would be lost with its
    executor, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{name}-{sc.applicationId}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows once and go on from the written table.

    A table survives lost executors and is computed once; an eager ``checkpoint()``
    runs its plan twice unless the rows are cached.
    """
    path = f"{work_folder(df.sparkSession, 'cut')}/rows"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Like :func:`cut_lineage`; the shuffle files that made the table are removed when it is written, not at some later collection."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df, **options)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
