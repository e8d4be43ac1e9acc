"""Word-piece counts by a longest-match automaton that never builds a piece.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces
that continue it.  Every node has a failure link and the precomputed number of pieces that
greedy longest match takes off before it goes on there, so a word is read once, character by
character, and no part of it is read again.  A word that greedy match cannot cover counts as
one unknown piece.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.pieces import NORMAL, SPACE, parse_model, read_model
from veilspan.llm.text import raw, words

CACHE = 250_000
START, GO_ON, NONE = 0, 1, -1
SHIFT = 21  # bits of a code point


@dataclass
class Automaton:
    step: dict[int, int]  # (node, code point) in one number -> node
    link: list[int]
    popped: list[int]
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def count(self, word: str) -> int:
        """Pieces of one word; 0 if greedy match cannot cover it."""
        step, link, popped, node, total = self.step, self.link, self.popped, START, 0
        for char in map(ord, word):
            while (after := step.get(node << SHIFT | char)) is None:
                if link[node] == NONE:
                    return 0
                total += popped[node]
                node = link[node]
            node = after
        while node != GO_ON:
            if link[node] == NONE:
                return 0
            total += popped[node]
            node = link[node]
        return total

    def count_text(self, text: bytes) -> tuple[int, int, int]:
        """Words, pieces (an uncovered word is one) and uncovered words."""
        found, known = words(text), self._known
        if len(known) > CACHE:
            known.clear()
        sizes = []
        for word in found:
            size = known.get(word)
            if size is None:
                size = known[word] = self.count(word.decode("utf-8", "replace"))
            sizes.append(size)
        lost = sizes.count(0)
        return len(sizes), sum(sizes) + lost, lost


def build(begin: set[str], go_on: set[str]) -> Automaton:
    """Automaton of the pieces that begin a word and of those that continue it; links are set by breadth."""
    step: dict[int, int] = {}
    parent, via, final = [NONE, NONE], [0, 0], [False, False]
    for root, pieces in ((START, begin), (GO_ON, go_on)):
        for piece in sorted(pieces - {""}):
            node = root
            for char in map(ord, piece):
                key = node << SHIFT | char
                if key not in step:
                    step[key] = len(parent)
                    parent.append(node), via.append(char), final.append(False)
                node = step[key]
            final[node] = True
    link, popped = [NONE] * len(parent), [0] * len(parent)
    depth = [0] * len(parent)
    for node in range(2, len(parent)):
        depth[node] = depth[parent[node]] + 1  # a parent always has the smaller number
    for node in sorted(range(2, len(parent)), key=depth.__getitem__):
        if final[node]:
            link[node], popped[node] = GO_ON, 1
            continue
        at, taken = link[parent[node]], popped[parent[node]]
        while at != NONE and (at << SHIFT | via[node]) not in step:
            taken += popped[at]
            at = link[at]
        if at != NONE:
            link[node], popped[node] = step[at << SHIFT | via[node]], taken
    return Automaton(step, link, popped)


def from_piece_model(path: str) -> Automaton:
    """Pieces with a space marker begin a word (without it), the others continue one; only ordinary pieces count."""
    pieces = [text for text, _, kind in parse_model(read_model(path)).pieces if kind == NORMAL]
    begin = {p[1:] for p in pieces if p.startswith(SPACE) and SPACE not in p[1:]}
    return build(begin, {p for p in pieces if SPACE not in p})


def count_column(spark: SparkSession, automaton: Automaton, text: Column) -> Column:
    """Struct ``(n_words, n_tokens, n_unknown)`` of every whole text; the broadcast is as large as the vocabulary."""
    held = spark.sparkContext.broadcast(automaton)

    @F.arrow_udf("n_words long, n_tokens long, n_unknown long")
    def run(column: pa.Array) -> pa.Array:
        found = [held.value.count_text(x) for x in raw(column)]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)],
                                          ["n_words", "n_tokens", "n_unknown"])

    return run(text)


def count_tokens(docs: DataFrame, automaton: Automaton, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_tokens`` and ``n_unknown``; columns of these names are replaced.

    A null, empty or blank text has zeros.  Every row is kept as it is; an empty table stays empty.
    """
    counted = docs.withColumn("__n", count_column(docs.sparkSession, automaton, F.col(text)))
    return counted.withColumns({k: F.col(f"__n.{k}") for k in ("n_words", "n_tokens", "n_unknown")}).drop("__n")
