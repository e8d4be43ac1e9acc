"""Runs of words that repeat with a period, by Kruskal over suffix classes in the order of falling LCP.

Suffixes of a text are sorted by doubled ranks.  Neighbours in that order are the edges of a path, weighed by their
longest common prefix; taken from the largest weight down, union-find joins the classes on both sides, each an
ordered set of positions.  Two positions that become neighbours in a set when it is joined at weight ``l`` agree on
``l`` words and, at a distance ``d <= l``, seed a run of period ``d``: words from the left position on for ``d + l``.
For a run of ``e`` or more periods, two or more, the first two positions one period apart are neighbours when
they meet (a position between them would give a smaller period), so each run is seeded once at its own
start; seeds that the word before still continues are dropped.

Texts are coded together with codes of their own, so that one sort serves many short texts and no class spans two.
Only classes that could hold a run are united: those of a common prefix as long as the shortest run asks for, with two
positions closer than their longest common prefix allows.  That bound is exact.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.text import raw, words

WORDS = 1 << 18  # words that are sorted together; a longer text is alone

NAMES = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed"]
FOUND = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
         "runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string")


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, different texts sharing none, and where each text starts (and the last one ends)."""
    codes, base = [], 0
    for parts in texts:
        seen: dict[bytes, int] = {}
        codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in parts), np.int64, len(parts)) + base)
        base += len(seen)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return (np.concatenate(codes) if codes else np.zeros(0, np.int64)), starts


def _heads(keys: np.ndarray) -> np.ndarray:
    """For sorted keys the place of the first of each equal stretch."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def repeated_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, lcp)``: suffixes that share ``least`` or more words with a neighbour, sorted, and the LCP with the one before.

    A suffix that starts a class of such suffixes has ``lcp`` 0.  Ranks are doubled for suffixes that are not told
    apart yet; those of each length stay, and the LCP of neighbours is put together from them.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = _heads(codes[order])
    ranks, width = [rank], 1
    ends = np.append(np.flatnonzero(np.diff(rank[order])) + 1, n)
    sizes = np.diff(np.concatenate(([0], ends)))
    active = order[np.repeat(sizes > 1, sizes)]
    first = None
    while len(active):
        if first is None and 2 * width > least:
            first = active  # they share ``width <= least`` words with another one
        nxt = rank[np.minimum(active + width, n)].astype(np.int64)
        key = rank[active].astype(np.int64) * (n + 2) + nxt + 1
        turn = np.argsort(key, kind="stable")
        active, key = active[turn], key[turn]
        group = rank[active]
        place = group + (np.arange(len(active)) - _heads(group))  # place among all suffixes
        head = _heads(key)
        rank = rank.copy()
        rank[active] = place[head]
        width *= 2
        ranks.append(rank)
        count = np.bincount(head, minlength=len(active))
        active = active[count[head] > 1]
    if first is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ordered = first[np.argsort(rank[first], kind="stable")]
    a, b = ordered[:-1].copy(), ordered[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = (ranks[level][np.minimum(a, n)] == ranks[level][np.minimum(b, n)]) & (a < n) & (b < n)
        step = np.where(same, 1 << level, 0)
        a, b, lcp = a + step, b + step, lcp + step
    lcp = np.concatenate(([0], np.where(lcp >= least, lcp, 0)))
    near = np.concatenate((lcp[1:] > 0, [False])) | (lcp > 0)
    return ordered[near], lcp[near]


def _seeds(at: list[int], weights: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(position, distance, lcp)`` of the positions that become neighbours; ``weights[i]`` lies between ``at[i]`` and ``at[i+1]``."""
    root, sets = list(range(len(at))), [[p] for p in at]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for edge in sorted(range(len(weights)), key=weights.__getitem__, reverse=True):
        x, y, weight = find(edge), find(edge + 1), weights[edge]
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small = sets[x], sets[y]
        root[y], sets[y] = x, None
        hi = len(small)
        while hi:  # from the right: those that fall into one gap of the larger set go in together
            gap = bisect_left(large, small[hi - 1])
            lo = bisect_left(small, large[gap - 1], 0, hi) if gap else 0
            if gap < len(large) and large[gap] - small[hi - 1] <= weight:
                yield small[hi - 1], large[gap] - small[hi - 1], weight
            if gap and small[lo] - large[gap - 1] <= weight:
                yield large[gap - 1], small[lo] - large[gap - 1], weight
            large[gap:gap] = small[lo:hi]
            hi = lo


def runs_of(codes: np.ndarray, starts: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``max(min_length, min_exponent * period)`` or more words, sorted."""
    least = min(max(min_length - d, (min_exponent - 1) * d) for d in range(1, min_length + 1))
    order, lcp = repeated_suffixes(codes, least)
    if not len(order):
        return []
    edge = np.flatnonzero(lcp == 0)
    group = np.cumsum(lcp == 0) - 1
    apart = np.lexsort((order, group))
    gaps = np.diff(order[apart])
    inside = np.diff(group[apart]) == 0
    closest = np.full(len(edge), np.iinfo(np.int64).max)
    np.minimum.at(closest, group[apart][1:][inside], gaps[inside])
    longest = np.maximum.reduceat(lcp, edge)
    first = set(starts.tolist())
    out = []
    for g in np.flatnonzero(closest * (min_exponent - 1) <= longest).tolist():
        lo, hi = edge[g], edge[g + 1] if g + 1 < len(edge) else len(order)
        for p, d, same in _seeds(order[lo:hi].tolist(), lcp[lo + 1:hi].tolist()):
            if d + same >= max(min_length, min_exponent * d) and (p in first or codes[p - 1] != codes[p + d - 1]):
                out.append((p, d + same, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _result(parts: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = b"".join(b"%d,%d,%d\n" % r for r in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    if runs:
        keep = np.ones(len(parts), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        parts = [w for w, k in zip(parts, keep.tolist()) if k]
    exponent = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, exponent, [dict(zip(("start", "length", "period"), r)) for r in runs], hashlib.sha256(listed).hexdigest(), b" ".join(parts).decode())


def _rows(found) -> pa.StructArray:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 6 + [pa.list_(run), pa.string(), pa.string()]
    columns = list(zip(*found)) or [[] for _ in NAMES]
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], NAMES)


def _found(texts: list[list[bytes]], min_length: int, min_exponent: int) -> Iterator[tuple]:
    codes, starts = coded(texts)
    per: list[list] = [[] for _ in texts]
    found = runs_of(codes, starts, min_length, min_exponent)
    for (p, length, period), k in zip(found, (np.searchsorted(starts, [r[0] for r in found], "right") - 1).tolist() if found else ()):
        per[k].append((p - int(starts[k]), length, period))
    for parts, runs in zip(texts, per):
        yield (len(parts), *_result(parts, runs))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``doc_id`` and the columns of ``FOUND`` for each row of ``docs``.

    Words are what lies between spaces and 0x09-0x0D.  A run is a stretch of words of smallest period ``q`` that no word beside
    it continues, of ``max(min_length, min_exponent * q)`` words or more; ``start``, ``length`` and ``period`` are those of the longest
    (ties: smallest start, then period; null without runs), ``collapsed`` is the text without what follows the
    first period of a run.  Null and wordless texts have no words and no runs; null ids stay; repeated rows are judged
    alike; an empty table gives an empty one; other columns are not read.  A row stays in its partition, nothing is shuffled.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods or more")

    @F.arrow_udf(FOUND)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            done, held, size = [_rows([])], [], 0
            for at in range(0, len(column), 128):
                for value in raw(column.slice(at, 128)):
                    parts = words(value)
                    if held and size + len(parts) > WORDS:
                        done.append(_rows(_found(held, min_length, min_exponent)))
                        held, size = [], 0
                    held.append(parts)
                    size += len(parts)
            done.append(_rows(_found(held, min_length, min_exponent)))
            yield pa.concat_arrays(done)

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("found")).select("doc_id", "found.*")
