"""Small helpers that the operators share: words, folds and Arrow columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D (what ``bytes.split`` splits at)."""
    return text.split()


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def hash_sample(rows: DataFrame, group: str, key: str, size: int, most: int = 1024) -> DataFrame:
    """About ``2 * size`` rows of each ``group`` (all, if it has fewer), those of the least hash of ``key``.

    A threshold from the group's count, so that no group meets in one task.  Groups are labels or languages:
    more than ``most`` of them are an error.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} groups of {group}")
    if not counts:
        return rows
    share = F.create_map(*[F.lit(x) for g, n in counts for x in (g, min(1.0, 2.0 * size / n))])
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(place < F.element_at(share, F.col(group)))
