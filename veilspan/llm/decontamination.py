"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the copies.

The test items are taken in blocks of bounded size; each block is broadcast and meets every
document once, so the work grows with documents times blocks and no document text is shuffled.
A seed is an n-gram of an item that chance should not bring about: the product of its words'
frequencies, counted over the whole corpus, is at most ``rare``; the ``least`` rarest n-grams
of an item are seeds in any case, so no item is without.  (Frequencies of single words, not
of the n-gram: a passage leaked into a third of the corpus must not hide itself.)  Around every
seed hit the passage is aligned with the item; the score is the share of the best score the item
can have, so that edits, insertions and omissions cost in proportion.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilspan.llm.text import raw

WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1


def normal_words(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def smith_waterman(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local score and the passage words ``[start, end)`` it covers; word ids, linear gaps.

    One vector of the item's length per passage word; a gap along the item is a running maximum.
    """
    ramp = np.arange(1, len(item) + 1) * -GAP
    before, since = np.zeros(len(item) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    best, span = 0, (0, 0)
    for k, word in enumerate(passage):
        hit = before[:-1] + np.where(item == word, MATCH, MISMATCH)
        up = before[1:] + GAP
        score, origin = np.maximum(hit, up), np.where(hit >= up, np.where(before[:-1] > 0, since[:-1], k), since[1:])
        score = np.maximum(score, 0)
        lifted = score + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(item)), 0))
        score, origin = np.maximum(top - ramp, 0), origin[source]
        before, since = np.concatenate(([0], score)), np.concatenate(([0], origin))
        at = int(score.argmax())
        if score[at] > best:
            best, span = int(score[at]), (int(origin[at]), k + 1)
    return best, *span


@dataclass
class ItemBlock:
    """A bounded block of test items: word ids, seeds and where in which item they stand."""

    names: list
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    size: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted
    places: list = field(default_factory=list)  # for each key [(item, position)]

    def key_of(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram of known words; exact while the block has fewer than 2**(63/size) words."""
        key = np.zeros(max(0, len(ids) - self.size + 1), np.int64)
        for k in range(self.size):
            key = key * (len(self.vocabulary) + 1) + ids[k:len(key) + k]
        return key

    def seed(self, counts: dict[int, int], total: int, rare: float, least: int) -> None:
        chance = {i: math.log(max(counts.get(i, 0), 1) / max(total, 1)) for i in self.vocabulary.values()}
        found: dict[int, list] = {}
        for k, ids in enumerate(self.items):
            odds = [sum(chance[i] for i in ids[j:j + self.size].tolist()) for j in range(len(ids) - self.size + 1)]
            bar = max(math.log(rare), sorted(odds)[min(least, len(odds)) - 1]) if odds else 0
            for j, key in enumerate(self.key_of(ids).tolist()):
                if odds[j] <= bar:
                    found.setdefault(key, []).append((k, j))
        self.keys = np.array(sorted(found), np.int64)
        self.places = [found[key] for key in self.keys.tolist()]

    def ids_of(self, text: bytes) -> np.ndarray:
        """0 for a word of no item."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in normal_words(text)], np.int64)

    def matches(self, text: bytes, threshold: float) -> list[tuple[int, float, int, int]]:
        """``(item, score, first word, word after)`` of the best passage for each item scored at ``threshold`` or more."""
        ids = self.ids_of(text)
        known = ids > 0
        runs = np.flatnonzero(np.logical_and.reduce([known[k:len(ids) - self.size + 1 + k] for k in range(self.size)])) \
            if len(ids) >= self.size else np.zeros(0, np.int64)
        if not len(runs) or not len(self.keys):
            return []
        keys = np.zeros(len(runs), np.int64)
        for k in range(self.size):
            keys = keys * (len(self.vocabulary) + 1) + ids[runs + k]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hits: dict[int, list[tuple[int, int]]] = {}
        for run, k in zip(*(x[self.keys[at] == keys].tolist() for x in (runs, at))):
            for item, position in self.places[k]:
                m = len(self.items[item])
                pad = m // 4 + 4
                hits.setdefault(item, []).append((max(0, run - position - pad), run - position + m + pad))
        out = []
        for item, windows in sorted(hits.items()):
            best = (0, 0, 0)
            joined: list[list[int]] = []
            for a, b in sorted(windows):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for start, end in joined:
                score, x, y = smith_waterman(ids[start:end], self.items[item])
                if score > best[0]:
                    best = (score, start + x, start + y)
            share = best[0] / (MATCH * len(self.items[item]))
            if share >= threshold:
                out.append((item, share, best[1], best[2]))
        return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int, size: int):
    """The items in blocks of about ``block_words`` words by hash of id and text; items under ``size`` words have no seed and are left out."""
    content = F.coalesce(F.col(text), F.lit(""))
    numbered = items.select(F.col(item_id).alias("i"), content.alias("t")).distinct()
    total = numbered.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 6 / block_words))
    for k in range(blocks):
        rows = numbered.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        split = sorted(((r.i, normal_words(r.t.encode())) for r in rows), key=lambda x: (str(x[0]), x[1]))
        split = [x for x in split if len(x[1]) >= size]
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in own], np.int64) for _, own in split]
        if ids:
            yield ItemBlock([name for name, _ in split], vocabulary, ids, size)


def _word_counts(docs: DataFrame, held) -> dict[int, int]:
    """Corpus counts of the block's words, and of all words under 0; one row per task and word reaches the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in raw(batch.column(0)):
                ids = held.value.ids_of(text)
                own = np.bincount(ids)
                counts[0] += len(ids)
                for i in np.flatnonzero(own[1:]) + 1:
                    counts[int(i)] += int(own[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])

    rows = docs.select("t").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()
    return {r.w: r.c for r in rows}


def contaminated_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                          item_text: str = "text", size: int = 3, rare: float = 1e-8, least: int = 8, threshold: float = 0.5,
                          block_words: int = 200_000) -> DataFrame:
    """``(doc_id, item_id, score, first_word, end_word)``: the best passage of each row and item scored at ``threshold`` or more.

    Words are runs of letters and digits in lower case.  A null or empty text and an item under ``size`` words
    match nothing; equal items are equal matches; repeated rows repeat their matches; empty tables give
    an empty one.  A row with a null id is matched like any other.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[doc_id].dataType, items.schema[item_id].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double, first_word long, end_word long"
    narrow, item_kind, found = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")), to_arrow_type(kinds[1]), None
    for block in item_blocks(items, item_id, item_text, block_words, size):
        held = spark.sparkContext.broadcast(block)
        counts = _word_counts(narrow, held)
        block.seed(counts, counts.get(0, 0), rare, least)
        seeded = spark.sparkContext.broadcast(block)

        def run(batches, seeded=seeded):
            for batch in batches:
                own, rows = seeded.value, []
                for k, body in enumerate(raw(batch.column(1))):
                    rows += [(k, *match) for match in own.matches(body, threshold)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([own.names[i] for i in columns[1]], item_kind),
                     pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                    ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found
