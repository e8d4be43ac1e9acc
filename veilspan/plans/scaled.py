"""Ranks, running totals and neighbours that never put a whole hot group in one task.

A plain window sends every row of a group to one task.  When one dialogue or
source may hold a third of all rows that task never ends.  Here a group is cut
into chunks by a key that is monotone in the wanted order (a block of an integer
position, or the leading hex digits of a hash).  Rows are windowed per
``(group, chunk)``; only one small aggregate row per chunk is windowed per group,
and its running value is joined back.  Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
_CHUNK, _BASE = "__chunk", "__base"


def block(position: Column, size: int = CHUNK_ROWS) -> Column:
    """Chunk key for an integer position."""
    return F.floor(position / size)


def hash_block(hex_hash: Column, digits: int = 3) -> Column:
    """Chunk key for rows ordered by a hex hash: 4096 even slices per group."""
    return F.substring(hex_hash, 1, digits)


def _carry(totals: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*groups, _CHUNK, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(_BASE))


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], chunk: Column, name: str = "rank") -> DataFrame:
    """Exact ``row_number`` per group (or over everything when ``groups`` is empty)."""
    cut = df.withColumn(_CHUNK, chunk)
    totals = cut.groupBy(*groups, _CHUNK).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups, _CHUNK).orderBy(*order)
    return (
        cut.join(_carry(totals, groups, "n"), [*groups, _CHUNK])
        .withColumn(name, F.row_number().over(w) + F.col(_BASE))
        .drop(_CHUNK, _BASE)
    )


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[Column], chunk: Column, value: str, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running total of ``value`` per group in the given order."""
    cut = df.withColumn(_CHUNK, chunk)
    totals = cut.groupBy(*groups, _CHUNK).agg(F.sum(value).alias("n"))
    w = Window.partitionBy(*groups, _CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        cut.join(_carry(totals, groups, "n"), [*groups, _CHUNK])
        .withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col(_BASE))
        .drop(_CHUNK, _BASE)
    )


def running_min_before(df: DataFrame, groups: Sequence[str], order: Sequence[Column], chunk: Column, value: str,
                       name: str) -> DataFrame:
    """Minimum of ``value`` over the earlier rows of the group; null for the first."""
    cut = df.withColumn(_CHUNK, chunk)
    lows = cut.groupBy(*groups, _CHUNK).agg(F.min(value).alias("n"))
    earlier = Window.partitionBy(*groups).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = lows.select(*groups, _CHUNK, F.min("n").over(earlier).alias(_BASE))
    w = Window.partitionBy(*groups, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # least() skips nulls, so either side may be missing.
    return (
        cut.join(carried, [*groups, _CHUNK])
        .withColumn(name, F.least(F.min(value).over(w), F.col(_BASE)))
        .drop(_CHUNK, _BASE)
    )


def first_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` becomes a group limit before the shuffle, so a hot group
    sends at most ``k`` rows per input task.
    """
    rank = name or "__rank"
    w = Window.partitionBy(*groups).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return out if name else out.drop(rank)


def neighbours(df: DataFrame, groups: Sequence[str], order: str, payload: Sequence[str], size: int = CHUNK_ROWS,
               keep: Column | None = None) -> DataFrame:
    """Add structs ``prev`` and ``next`` holding ``payload`` of the adjacent rows.

    ``keep`` restricts which rows count as neighbours (for example non-blank turns).
    Only groups longer than one chunk contribute edge rows, so for ordinary
    dialogues the edge join carries nothing.
    """
    usable = F.lit(True) if keep is None else keep
    packed = F.when(usable, F.struct(*payload))
    cut = df.withColumn(_CHUNK, block(F.col(order), size)).withColumn("__pack", packed)
    w = Window.partitionBy(*groups, _CHUNK).orderBy(order)
    inside = cut.withColumn(
        "prev", F.last("__pack", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("next", F.first("__pack", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))

    long_groups = (
        cut.groupBy(*groups).agg(F.min(_CHUNK).alias("a"), F.max(_CHUNK).alias("b"))
        .filter("a < b").select(*groups)
    )
    kept = cut.filter(usable).join(long_groups, list(groups), "left_semi")
    ends = kept.groupBy(*groups, _CHUNK).agg(
        F.min_by("__pack", order).alias("head"), F.max_by("__pack", order).alias("tail"))
    # Chunks without usable rows still need the values carried past them.
    chunks = cut.join(long_groups, list(groups), "left_semi").select(*groups, _CHUNK).distinct()
    we = Window.partitionBy(*groups).orderBy(_CHUNK)
    edges = chunks.join(ends, [*groups, _CHUNK], "left").select(
        *groups, _CHUNK,
        F.last("tail", ignorenulls=True).over(we.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("head", ignorenulls=True).over(we.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    return (
        inside.join(edges, [*groups, _CHUNK], "left")
        .withColumn("prev", F.coalesce("prev", "__before"))
        .withColumn("next", F.coalesce("next", "__after"))
        .drop(_CHUNK, "__pack", "__before", "__after")
    )
