"""Merkle manifest of a table: a digest for each row, a root for all, and a proof of each row, by sibling-shift self-joins.

A tree is a table of nodes ``(grp, idx, digest)``.  At each level every node computes the places of its siblings
in its run of ``arity`` nodes (``idx XOR 1`` for binary trees, slot offsets otherwise) and equijoins the nodes with
them; then the rows of slot zero, which now know their whole run, emit the parents.  Both sides of that join
are dealt by ``(grp, run)``, so a level is one shuffle of its nodes, and a run (not a
group) is all that ever meets in one place: a language with a third of all rows is split like any other.

Groups have trees of their own; the roots of groups, in the order of their keys, are the nodes of one more tree.
Levels shrink by ``arity``, so a tree of 10^11 rows has twelve of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.storage import written

ARITY = 8
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
PATH = "array<struct<before:binary,after:binary>>"


def digest_of(*parts: Column) -> Column:
    """sha256 of the parts put together, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    """One or more digests as lower-case hex text."""
    return F.lower(F.hex(digests))


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return digest_of(*[framed(c) for c in columns])


def group_key(group: Column) -> Column:
    """A key that is never null and sorts like the group: null first, then by UTF-8 bytes."""
    text = group.cast("string")
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), text))


def places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in the ``grp`` by ``order`` from 0, and ``n``, the rows of the ``grp``.

    Rows are dealt by ranges and written; a window never spans more than one range, and only one small row for
    each range and group is carried on.  Ranges cut through groups of any size.
    """
    dealt = written(rows.repartitionByRange("grp", *[F.col(c).asc_nulls_first() for c in order])
                    .withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("grp", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"),
                           F.sum("c").over(Window.partitionBy("grp")).alias("n"))
    inside = Window.partitionBy("grp", "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (dealt.join(ranges, ["grp", "part"]).withColumn("idx", F.row_number().over(inside) - 1 + F.col("base"))
            .drop("part", "base"))


def _siblings(arity: int) -> Column:
    """Places of the other nodes of the run."""
    if arity == 2:
        found = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = F.col("idx") % arity
        found = F.array(*[F.col("run") * arity + (slot + d) % arity for d in range(1, arity)])
    return F.filter(found, lambda x: x < F.col("n"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` ``(grp, idx, n, digest, ...)`` of groups with more than one node, with ``run``, ``before`` and ``after``.

    ``before`` and ``after`` are the digests of the siblings left and right of the node, put together.
    """
    here = nodes.filter("n > 1").withColumn("run", F.floor(F.col("idx") / arity)).repartition("grp", "run")
    extra = [c for c in here.columns if c not in ("grp", "run", "idx", "n", "digest")]
    other = here.select("grp", "run", F.col("idx").alias("at"), F.col("digest").alias("sibling"))
    asked = here.withColumn("at", F.explode_outer(_siblings(arity)))
    slot = lambda k: F.max(F.when(F.col("at") % arity == k, F.col("sibling"))).alias(f"s{k}")
    met = asked.join(other, ["grp", "run", "at"], "left").groupBy("grp", "run", "idx", "n", "digest", *extra).agg(*map(slot, range(arity)))
    own = F.col("idx") % arity
    none = F.lit(bytearray())
    before = F.concat(*[F.coalesce(F.when(own > k, F.col(f"s{k}")), none) for k in range(arity)])
    after = F.concat(*[F.coalesce(F.when(own < k, F.col(f"s{k}")), none) for k in range(arity)])
    return met.select("grp", "idx", "n", "run", "digest", *extra, before.alias("before"), after.alias("after"))


def _written_level(nodes: DataFrame, arity: int) -> DataFrame:
    """The level with its siblings, written; both sides of the join keep the one shuffle by ``(grp, run)``."""
    conf = nodes.sparkSession.conf
    was = conf.get(CO_PARTITION, None)
    conf.set(CO_PARTITION, "false")
    try:
        return written(with_siblings(nodes, arity))
    finally:
        conf.unset(CO_PARTITION) if was is None else conf.set(CO_PARTITION, was)


def tree(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """All levels with siblings, leaves first, and ``(grp, digest)``, the root of each group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.filter("n = 1").select("grp", "digest")
    while most > 1:
        level = _written_level(nodes, arity)
        levels.append(level)
        nodes = level.filter(F.col("idx") % arity == 0).select(
            "grp", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
            digest_of(as_hex(F.concat("digest", "after"))).alias("digest"))
        roots = roots.union(nodes.filter("n = 1").select("grp", "digest"))
        most = -(-most // arity)
    return levels, roots


def with_paths(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` with what ``ends`` ``(grp, path, ...)`` holds for the group and the ``path`` from the leaf to its end.

    From the last level down, nodes take the path of their parent; those right under a root take the group's.
    """
    carried = [c for c in ends.columns if c not in ("grp", "path")]
    step = F.concat(F.array(F.struct("before", "after")), F.col("path")).alias("path")
    above = None
    for level in reversed(levels):
        kept = [c for c in level.columns if c not in ("n", "run", "before", "after")]
        met = level.filter(F.col("n") <= arity).join(ends, "grp").select(*kept, *carried, step)
        if above is not None:
            parent = above.select("grp", F.col("idx").alias("run"), *carried, "path")
            met = met.union(level.filter(F.col("n") > arity).join(parent, ["grp", "run"]).select(*kept, *carried, step))
        above = met
    alone = leaves.filter("n = 1").drop("n").join(ends, "grp")
    return alone if above is None else alone.select(*above.columns).union(above)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda held, x: digest_of(as_hex(F.concat(x["before"], held, x["after"]))))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level."""
    return digest_of(as_hex(F.aggregate(path, F.lit(bytearray()), lambda held, x: F.concat(held, x["before"], x["after"]))))


def manifest(rows: DataFrame, columns: Sequence[Column], group: Column, order: Column, carry: Column | None = None,
             arity: int = ARITY) -> DataFrame:
    """``(id, kept, leaf, subroot, root, path)`` of each row; digests are 32 bytes, ``path`` goes from leaf to root.

    A leaf is the digest of the framed ``columns``; in each ``group`` leaves ascend by ``order`` (``id``; null first), rows of
    one id by their digest; ``carry`` is kept beside the row.  Null values have a frame of their own, so null and the empty text
    differ; a null group is a group and comes first.  Repeated rows are leaves like others.  A lone leaf is
    its group's root, a lone group's root the root of all; no rows give no rows.  Only the
    given columns are read, so others may have any name.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    kept = F.lit(None).cast("string") if carry is None else carry
    leaves = written(rows.select(group_key(group).alias("grp"), order.alias("id"), leaf_digest(columns).alias("digest"), kept.alias("kept")))
    nodes = written(places(leaves, ["id", "digest"]).select("grp", "idx", "n", "digest", "id", "kept"))
    levels, subroots = tree(nodes, arity)
    named = written(places(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"]))
    tops, root = tree(named, arity)
    end = root.select("grp", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    ends = written(with_paths(named, tops, end, arity).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"))
    return with_paths(nodes, levels, ends, arity).select("id", "kept", F.col("digest").alias("leaf"), "subroot", "root", "path")
