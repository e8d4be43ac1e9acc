"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is masked by ``2**(radius+1) - 1`` structured masks: bit position
``i`` gets a non-zero vector ``m(i)`` of ``radius + 1`` bits, and mask ``v`` keeps the
positions with ``<m(i), v> = 1 (mod 2)``.  The at most ``radius`` differing positions of
a pair span less than the whole space, so some ``v`` is orthogonal to all of them: the
pair agrees on all that mask keeps and meets in that table.  No pair is lost, by
construction.  A bucket of more than ``BUCKET`` different fingerprints is never held: it is
streamed out again under masks of the same structure over its free bits, until no
bucket is too large (fifteen free bits hold at most that many fingerprints).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.components import connected_components
from veilspan.llm.text import raw, words
from veilspan.llm.storage import written

BUCKET = 1 << 15
BLOCK = 1 << 16
ALL = (1 << 64) - 1


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without a word."""
    parts = words(text.lower())
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[x:y], seed) for x, y in zip(first[k:k + BLOCK], last[k:k + BLOCK])], np.uint64)
                    for k in range(0, n, BLOCK))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for block in blocks:
        bytes_of = block.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bytes_of, axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@lru_cache(maxsize=4096)
def covering_masks(free: int = ALL, radius: int = 4) -> list[int]:
    """Masks over the set bits of ``free``: any ``radius`` of those bits are all cleared by one of them.

    That holds whatever vectors the bits get; of three choices the one whose weakest mask keeps most bits
    is taken, since weak masks make large buckets: counting, a first-order code with a bent function as one
    more row, and a seeded draw.
    """
    bits, top = [i for i in range(64) if free >> i & 1], 2 ** (radius + 1)
    draw = random.Random(len(bits))
    bent = lambda k: (k & k >> 1 & 1) ^ (k >> 2 & k >> 3 & 1) ^ (k >> 4 & k >> 5 & 1)
    choices = ([k % (top - 1) + 1 for k in range(len(bits))], [(k | 64 | bent(k) << 7) % top or 1 for k in range(len(bits))],
               [draw.randrange(1, top) for _ in bits])
    made = [[sum(1 << bit for bit, m in zip(bits, vectors) if (m & v).bit_count() & 1) for v in range(1, top)] for vectors in choices]
    return max(made, key=lambda masks: min(m.bit_count() for m in masks))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for each row; ``fp`` is the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([signed(fingerprint(x, size)) for x in raw(column)], pa.int64())

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("fp"))


def _links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one bucket: each fingerprint with one that stands for its component.

    Breadth first: what is reached leaves the rest at once, so a bucket that is one dense group of near
    copies costs a few passes over it and not all of its pairs.
    """
    rest, found = fps, []
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        edge = seed
        while len(edge) and len(rest):
            block, edge = edge[:64], edge[64:]
            near = (np.bitwise_count(block[:, None] ^ rest[None, :]) <= radius).any(0)
            if near.any():
                found.append((rest[near], seed[0]))
                edge, rest = np.concatenate((edge, rest[near])), rest[~near]
    if not found:
        return fps[:0], fps[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([np.full(len(a), b) for a, b in found])


def _bucket_links(radius: int):
    """Reads rows sorted by (mask, key); yields links (hot false) and the rows of too large buckets under finer masks (hot true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(mask, key, fp, to, hot):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(x).view(np.int64)) for x in (mask, key, fp, to)] + [pa.array(np.full(len(fp), hot))],
                ["mask", "key", "fp", "to", "hot"])

        def finer(mask: int, fps: np.ndarray):
            for sub in covering_masks(ALL ^ mask, radius):
                whole = np.full(len(fps), mask | sub, np.uint64)
                yield out(whole, fps & whole, fps, fps, True)

        held, group, hot = [], None, False  # rows of the bucket that the last batch ended in

        def close():
            if hot or group is None:
                return
            fps = np.unique(np.concatenate(held))
            if len(fps) > 1:
                a, b = _links(fps, radius)
                if len(a):
                    yield out(np.zeros_like(a), np.zeros_like(a), a, b, False)

        for batch in batches:
            mask, key, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            if not len(fps):
                continue
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(fps)]))
            lone = (ends - starts == 1) & (starts > 0) & (ends < len(fps))
            for x, y in zip(starts[~lone].tolist(), ends[~lone].tolist()):
                if (mask[x], key[x]) != group:
                    yield from close()
                    held, group, hot = [], (mask[x], key[x]), False
                if hot:
                    yield from finer(int(mask[x]), fps[x:y])
                    continue
                held.append(fps[x:y].copy())
                if sum(map(len, held)) > BUCKET:
                    hot = True
                    yield from finer(int(mask[x]), np.concatenate(held))
                    held = []
        yield from close()

    return run


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints of ``fps`` that span every component at ``radius``."""
    masks = [signed(m) for m in covering_masks(ALL, radius)]
    rows = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = None
    while True:
        done = written(
            rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
            .mapInArrow(_bucket_links(radius), "mask long, key long, fp long, to long, hot boolean"))
        links = done.filter("not hot").select(F.col("fp").alias("a"), F.col("to").alias("b"))
        found = links if found is None else found.union(links)
        rows = done.filter("hot").select("mask", "key", "fp")
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    Fingerprints at ``radius`` or fewer differing bits are linked; ``component_id`` is the smallest id
    reachable.  A null or wordless text has fingerprint zero and is linked like any other; repeated rows
    stay; a row with a null id stays and takes its component's id (null if the component has no other
    id); an empty table gives an empty one.  Other columns are not read.
    """
    of = written(fingerprints(docs, doc_id, text, size))
    firsts = of.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(near_links(firsts.select("fp"), radius))
    at = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = at.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.join(at.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, doc_id: str, text: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with one row of each component that ``find`` gives to the rows ``(id, text)``, columns unchanged."""
    row = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), F.xxhash64(F.col(text)).alias("h"))
    keyed = docs.withColumn("__row", row)
    found = find(keyed.select(F.col("__row").alias("id"), F.col(text).alias("text")))
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__row"))
    again = Window.partitionBy("__row").orderBy("__row")
    return (keyed.join(kept, "__row", "left_semi").withColumn("__k", F.row_number().over(again))
            .filter("__k = 1").drop("__row", "__k"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, columns unchanged.

    The smallest id stays; among rows of that id, the least XXH64 of the text; of rows equal in both, one.
    Rows with a null id come after all others of their group.  An empty table stays empty.
    """
    return first_of_each(docs, doc_id, text, lambda keyed: near_duplicates(keyed, "id", "text", size, radius))
