"""Substring dedup by relative Lempel-Ziv parsing against a distributed reference index.

The reference of a document is all documents with smaller ids.  Its index is a table from each
``size``-word window to the first document in which it starts, dealt into blocks by the window's
hash, so that a lookup meets every block without a document being held against every other one.  A
document is then parsed greedily: a factor runs on as long as its windows start in one and the same
reference document; where that document changes, the windows across the boundary have been looked up
too, so no repeat is lost between two factors.  Factors of ``size`` or more words are the duplicate spans.

Most windows occur once, and are kept out of the index by anchors: of the ``anchor``-word grams
inside a window, the one of least hash.  Equal windows have equal anchors, so a window whose anchor
stands in a single document need not be looked up.  Anchors are about a fifth of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.storage import written
from veilspan.llm.text import raw, words

LAST = (1 << 63) - 1  # stands for a null id: after all others


def _mixed(grams: np.ndarray) -> np.ndarray:
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return grams ^ (grams >> np.uint64(29))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words: a polynomial of their XXH64, then mixed."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k: len(hashes) - n + 1 + k]
    return _mixed(out)


def _hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in tokens], np.uint64)


def window_anchors(hashes: np.ndarray, size: int, anchor: int) -> np.ndarray:
    """The least hash of an ``anchor``-word gram inside each window; every window has one."""
    grams = _grams(hashes, anchor)
    least = grams[: len(hashes) - size + 1].copy()
    for k in range(1, size - anchor + 1):
        np.minimum(least, grams[k: len(least) + k], out=least)
    return least


def anchor_rows(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """``(a, d)``: the different anchors of each row."""

    def run(batches):
        for batch in batches:
            ids, found, sizes = batch.column(0), [], []
            for text in raw(batch.column(1)):
                tokens = words(text)
                own = np.unique(window_anchors(_hashes(tokens), size, anchor)) if len(tokens) >= size else np.zeros(0, np.uint64)
                found.append(own), sizes.append(len(own))
            if found:
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), ids.take(at)], ["a", "d"])

    return docs.select("d", "t").mapInArrow(run, "a long, d long")


def window_rows(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """``(w, d)``: the different windows of each row whose anchor is among the row's ``repeated`` ones."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                repeated = part.column(2)
                flat, offsets = repeated.flatten().to_numpy(zero_copy_only=False).view(np.uint64), repeated.offsets.to_numpy()
                offsets, found, sizes = offsets - offsets[0], [], []
                for k, text in enumerate(raw(part.column(1))):
                    tokens = words(text)
                    own = np.zeros(0, np.uint64)
                    if len(tokens) >= size:
                        hashes = _hashes(tokens)
                        use = np.isin(window_anchors(hashes, size, anchor), flat[offsets[k]:offsets[k + 1]])
                        own = np.unique(_grams(hashes, size)[use])
                    found.append(own), sizes.append(len(own))
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), part.column(0).take(at)], ["w", "d"])

    return docs.select("d", "t", "repeated").mapInArrow(run, "w long, d long")


def factors(windows: np.ndarray, known: np.ndarray, source: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy parse: ``(first word, word after, source document)`` of each factor; ``known`` is sorted."""
    if not len(known) or not len(windows):
        return []
    at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
    hit = known[at] == windows
    origin = np.where(hit, source[at], -1)
    cuts = np.flatnonzero((hit[1:] != hit[:-1]) | (origin[1:] != origin[:-1])) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(windows)]))
    return [(int(a), int(b) + size - 1, int(origin[a])) for a, b in zip(starts, ends) if hit[a]]


def _parsed(size: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, removed, kept, spans = [], [], [], []
                for text, index in zip(raw(part.column(1)), part.column(2)):
                    tokens, found = words(text), []
                    if index.is_valid and len(tokens) >= size:
                        known = index.values.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
                        source, order = index.values.field(1).to_numpy(zero_copy_only=False), np.argsort(known)
                        found = factors(_grams(_hashes(tokens), size), known[order], source[order], size)
                    covered = np.zeros(len(tokens) + 1, np.int64)
                    for a, b, _ in found:
                        covered[a] += 1
                        covered[b] -= 1
                    gone = np.cumsum(covered)[:-1] > 0
                    counts.append(len(tokens)), removed.append(int(gone.sum()))
                    kept.append(b" ".join(w for w, x in zip(tokens, gone.tolist()) if not x) if found else b" ".join(tokens))
                    spans.append([{"start": a, "end": b, "source": s} for a, b, s in found])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(spans, kind)], ["d", "n_words", "n_removed", "kept", "factors"])

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 13, anchor: int = 5) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, factors)`` for each row of ``docs``.

    Every word under a ``size``-word window that also starts in a row with a smaller id is removed; windows are
    judged on the input.  ``kept`` joins the other words by a space, ``factors`` are the removed spans with the
    first document that has them.  A null text has no words; rows of equal ids do not remove each other's
    words; a null id counts as larger than any other; texts shorter than ``size`` words stay whole; an empty
    table gives an empty one.  Ids are whole numbers.
    """
    narrow = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.col(text).alias("t"))
    anchors = anchor_rows(narrow, size, anchor)
    shared = anchors.groupBy("a").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last").select("a")
    repeated = written(anchors.join(shared, "a").groupBy("d").agg(F.collect_set("a").alias("repeated")))
    windows = written(window_rows(narrow.join(repeated, "d"), size, anchor))
    index = windows.groupBy("w").agg(F.min("d").alias("source"), F.max("d").alias("last")).filter("source < last").select("w", "source")
    found = written(windows.join(index, "w").filter("d > source").groupBy("d").agg(
        F.collect_set(F.struct("w", "source")).alias("known")))
    parsed = narrow.join(found, "d", "left").select("d", "t", "known").mapInArrow(
        _parsed(size), "d long, n_words long, n_removed long, kept string, factors array<struct<start: long, end: long, source: long>>")
    return parsed.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept", "factors")
