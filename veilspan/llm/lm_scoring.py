"""Language-model scoring: causal self-attention over subword ids, corpus counts for the rest of each word.

A word's id is its leading piece (longest match in a public piece vocabulary); words without a piece, or with one that training
does not hold, share an id.  The attention model gives
each id, and the end, given the ids before it; a word given its id has its discounted corpus count plus
the discounted mass spread by a byte model of spelling.  Both factors sum to at most one, so a
score is a log probability of the whole text.

Counts of all words grow with the corpus and stay in Spark: the ``head`` most frequent words are
broadcast (a fixed number), all others meet their counts in a join.  The head takes the hot keys
out of that join; what is left of a document is its rare words, each once.

Attention learns from every training row.  The rows are dealt into rounds, each as large as all before it, and a round into
blocks of about ``BLOCK_TOKENS`` ids.  Each block descends by itself from where the last round ended, over all of
its ids, and the weighted mean of what the blocks reached is where the next round starts.  Only those few arrays go
through the driver.  What a row is dealt to, and its place there, come from its content alone.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilspan.llm import attention
from veilspan.llm.pieces import NORMAL, SPACE, parse_model, read_model
from veilspan.llm.text import raw, words
from veilspan.llm.storage import written

END = b"\n"  # cannot be a word
DISCOUNT = 0.75
CONTEXTS, SYMBOLS = 1 << 14, 257  # spelling: hashed contexts of three bytes; 256 ends a word
CACHE = 200_000
BLOCK_TOKENS = 1_500_000  # ids that descend one after the other
TOGETHER = 200_000  # ids whose windows are mixed
ROUNDS = 1 << 12  # shares of the smallest possible round
MOST_TASKS = 4096  # of a round


def pieces_that_begin(path: str) -> dict[bytes, int]:
    """Word-leading pieces in UTF-8 with their ids."""
    return {t[1:].encode(): k for k, (t, _, kind) in enumerate(parse_model(read_model(path)).pieces)
            if kind == NORMAL and t.startswith(SPACE) and len(t) > 1 and SPACE not in t[1:]}


def piece_reach(pieces: dict[bytes, int]) -> dict[bytes, int]:
    """Bytes of the longest piece that begins with these two bytes."""
    reach: dict[bytes, int] = {}
    for piece in pieces:
        reach[piece[:2]] = max(reach.get(piece[:2], 0), len(piece))
    return reach


def leading_piece(word: bytes, pieces: dict[bytes, int], reach: dict[bytes, int]) -> tuple[int, int]:
    """Id and bytes of the longest piece that the word begins with; ``(-1, 0)`` if none does."""
    for n in range(min(reach.get(word[:2], 1), len(word)), 0, -1):
        found = pieces.get(word[:n])
        if found is not None:
            return found, n
    return -1, 0


def spelling_cells(found: list[bytes], from_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (hashed context, next byte) that spell each word on from its leading piece, the end included; where each word's begin."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    symbols = np.frombuffer(b"".join([b"\0\0\0" + w + b"\0" for w in found]), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes + 4) - 1
    context = np.zeros(len(symbols), np.int64)
    for back, factor in ((3, 7919), (2, 104729), (1, 1299709)):
        context[back:] += symbols[:-back] * factor
    symbols[ends] = 256
    cells = context % CONTEXTS * SYMBOLS + symbols
    begin = ends - sizes + from_byte
    marks = np.zeros(len(cells) + 1, np.int64)
    marks[begin] += 1
    marks[ends + 1] -= 1
    spelled = sizes + 1 - from_byte
    return cells[np.cumsum(marks)[:-1] > 0], np.concatenate(([0], np.cumsum(spelled)[:-1]))


def id_type(classes: int) -> type:
    return np.int16 if classes < 1 << 15 else np.int32


class Slots(dict):
    """Word -> number; a word asked for the first time gets the next number and is listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


@dataclass
class WordModel:
    """Everything a task needs to score a text but the counts of rare words; bounded by parameters."""

    pieces: dict[bytes, int]
    class_of: dict[int, int]  # piece id -> class; class 0 is the end, 1 words without a piece that training holds
    mass: np.ndarray  # training tokens of each class
    types: np.ndarray  # different words of each class
    spelling: np.ndarray  # log10 probabilities of cells
    total: int
    distinct: int
    model: attention.AttentionModel | None = None
    head: dict[bytes, int] = field(default_factory=dict)
    _slots: Slots = field(default_factory=Slots, repr=False)
    _facts: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_slots": Slots(), "_facts": None}

    def __post_init__(self):
        self.reach = piece_reach(self.pieces)

    def place(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and log10 of the share of the class that its unseen mass gives the word."""
        leads = [leading_piece(w, self.pieces, self.reach) for w in found]
        own = np.array([self.class_of.get(p, 1) for p, _ in leads])
        cells, begin = spelling_cells(found, np.where(own > 1, [n for _, n in leads], 0))
        spelled = np.add.reduceat(self.spelling[cells].astype(np.float64), begin)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(self.mass > 0, DISCOUNT * self.types / self.mass, 1.0)
        return own, np.log10(share[own]) + spelled

    def word_score(self, count: np.ndarray, own: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """log10 probability of words with these training counts given their classes."""
        return np.log10(np.maximum(count - DISCOUNT, 0.0) / np.maximum(self.mass[own], 1) + 10.0 ** unseen)

    def base_score(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def facts(self, found: list[bytes]) -> np.ndarray:
        """A row for each word: class, unseen share, head count (0: not in the head), word score and base score by that count."""
        slots = self._slots
        if self._facts is None or len(slots) + len(found) > len(self._facts):
            slots = self._slots = Slots()
            self._facts = np.zeros((CACHE + len(found), 5))
        at = list(map(slots.__getitem__, found))
        if slots.new:
            new, slots.new = slots.new, []
            own, unseen = self.place(new)
            count = np.array([self.head.get(w, 0) for w in new])
            self._facts[len(slots) - len(new):len(slots)] = np.stack([own, unseen, count, self.word_score(count, own, unseen), self.base_score(count)], 1)
        return self._facts[at] if at else np.zeros((0, 5))


def lower_words(text: bytes) -> list[bytes]:
    return words(text.lower())


def training_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of the column ``t``, the end of each text under ``END``; summed in each task before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in raw(batch.column(0)):
                counts.update(lower_words(text))
                counts[END] += 1
                if len(counts) > 300_000:
                    yield flush()
                    counts.clear()
        yield flush()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_words(counts: DataFrame, pieces: dict[bytes, int], head: int) -> WordModel:
    """Classes (every leading piece that occurs, frequent ones first), class counts, spelling and head words from the corpus counts (a written table)."""
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast((pieces, piece_reach(pieces)))

    @F.arrow_udf("int")
    def piece(column: pa.Array) -> pa.Array:
        return pa.array([leading_piece(w, *held.value)[0] for w in raw(column)], pa.int32())

    by_piece = (counts.filter(F.col("word") != F.lit(END)).groupBy(piece("word").alias("p"))
                .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect())  # at most the vocabulary
    ends = sum(r.c for r in counts.filter(F.col("word") == F.lit(END)).collect())
    top = sorted((r for r in by_piece if r.p >= 0), key=lambda r: (-r.c, r.p))
    class_of = {r.p: k + 2 for k, r in enumerate(top)}
    mass, types = np.zeros(len(top) + 2), np.zeros(len(top) + 2)
    for r in by_piece:
        mass[class_of.get(r.p, 1)] += r.c
        types[class_of.get(r.p, 1)] += r.n
    mass[0] = ends
    begin = spark.sparkContext.broadcast((pieces, class_of, piece_reach(pieces)))

    def cells(batches):
        seen = np.zeros(CONTEXTS * SYMBOLS, np.int64)
        own, of, reach = begin.value
        for batch in batches:
            found = raw(batch.column(0))
            leads = [leading_piece(w, own, reach) for w in found]
            if found:
                np.add.at(seen, spelling_cells(found, np.array([n if p in of else 0 for p, n in leads]))[0], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["cell", "n"])

    spelled = (counts.filter(F.col("word") != F.lit(END)).select("word").mapInArrow(cells, "cell long, n long")
               .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())  # at most CONTEXTS * SYMBOLS rows, as columns
    table = np.zeros(CONTEXTS * SYMBOLS)
    table[spelled.column("cell").to_numpy()] = spelled.column("n").to_numpy()
    table = table.reshape(CONTEXTS, SYMBOLS)
    overall = table.sum(0) + 0.5
    overall /= overall.sum()
    table = (table + 2.0 * overall) / (table.sum(1, keepdims=True) + 2.0)
    frequent = counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(head).collect()
    return WordModel(pieces, class_of, mass, types, np.log10(table).ravel().astype(np.float32), int(mass.sum()),
                     int(types.sum()) + (ends > 0), head={bytes(r.word): r.c for r in frequent})


def _mean_state(reached: pa.Table) -> pa.Table:
    """One row for rows ``(block, n, step, state)``: the least block, all ids, and the means of steps and states by ids."""
    reached = reached.sort_by("block")
    n = reached.column("n").to_numpy()
    states = np.stack([s.values.to_numpy(zero_copy_only=False) for s in reached.column("state")])
    step = round(float(np.average(reached.column("step").to_numpy(), weights=n)))
    return pa.table([reached.column("block")[:1], pa.array([n.sum()], pa.int64()), pa.array([step], pa.int64()),
                     pa.array([np.average(states, axis=0, weights=n)], pa.list_(pa.float64()))], ["block", "n", "step", "state"])


def learn_attention(rows: DataFrame, tokens: int, odds: np.ndarray, steps: int, rate: float = 0.01) -> attention.AttentionModel:
    """The attention model after every row of ``(h, ids)``; ``odds`` counts the ids, ``tokens`` of them in all.

    Rows are told by the hash ``h``.  Where one pass over all ids takes less than ``steps`` steps, each task goes over
    its ids several times.  Without rows the model stays at even odds.
    """
    model = attention.fresh(len(odds))
    if not tokens:
        return model
    attention.start_odds(model, odds)
    adam = attention.Adam(model)
    spark, passes = rows.sparkSession, max(1, round(steps * 64 * 2 * model.half / tokens))
    halvings = min(max(int(np.log2(tokens / BLOCK_TOKENS)), 0), int(np.log2(ROUNDS))) if tokens > BLOCK_TOKENS else 0
    ends = [0] + [ROUNDS >> k for k in range(halvings, -1, -1)]
    deal = F.pmod("h", F.lit(ROUNDS))
    for low, high in zip(ends, ends[1:]):
        blocks = max(1, round(tokens * (high - low) / ROUNDS / BLOCK_TOKENS))
        size = tokens * (high - low) / ROUNDS / blocks
        rates = rate * (1 - 0.9 * np.array([low, high]) / ROUNDS)
        held = spark.sparkContext.broadcast((adam, rates))

        def run(batches, held=held, size=size):
            def learn(own, block, sequences):
                more, rng = sum(map(len, sequences)), np.random.default_rng((block, own[1]))
                for turn in range(passes):
                    done = np.array([own[1], own[1] + more]) / size if passes == 1 else np.array([turn, turn + 1]) / passes
                    attention.pass_over(own[0], sequences, rates[0] + (rates[1] - rates[0]) * np.minimum(done, 1.0), rng)
                own[1] += more

            def out(own, block):
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([own[1]], pa.int64()), pa.array([own[0].step], pa.int64()),
                                                   pa.array([own[0].state()], pa.list_(pa.float64()))], ["block", "n", "step", "state"])

            (first, rates), own, block, sequences, waiting = held.value, None, None, [], 0
            for batch in batches:
                for of, ids in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                    if of != block:
                        if own is not None:
                            learn(own, block, sequences)
                            yield out(own, block)
                        own, block, sequences, waiting = [pickle.loads(pickle.dumps(first)), 0], of, [], 0
                    sequences.append(np.frombuffer(ids, id_type(len(odds))))
                    waiting += len(sequences[-1])
                    if waiting >= TOGETHER and passes == 1:
                        learn(own, block, sequences)
                        sequences, waiting = [], 0
            if own is not None:
                learn(own, block, sequences)
                yield out(own, block)

        part = rows.filter((deal >= low) & (deal < high)).select(F.pmod(F.shiftright("h", 12), F.lit(blocks)).alias("block"), "h", "ids")
        part = part.repartition(min(4 * blocks, MOST_TASKS), "block").sortWithinPartitions("block", "h").select("block", "ids")
        reached = part.mapInArrow(run, "block long, n long, step long, state array<double>")
        some = F.pmod("block", F.lit(max(1, int(blocks ** 0.5))))  # the driver sees the root of their number
        reached = reached.groupBy(some.alias("some")).applyInArrow(_mean_state, "block long, n long, step long, state array<double>").toArrow()
        if len(reached):
            mean = _mean_state(reached)
            adam.become(mean.column("state").combine_chunks().flatten().to_numpy(), mean.column("step")[0].as_py())
        held.destroy()
    return model


def score_texts(docs: DataFrame, learn_from: Column, model_path: str, doc_id: str = "doc_id", text: str = "text",
                head: int = 100_000, steps: int = 1500) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Words are runs of bytes other than ASCII blanks, A-Z in lower case; each text has one end token.
    ``base_score`` is the add-0.1 unigram score, ``score`` the model's, both log10.  Counts and attention learn from all rows of
    ``learn_from``, attention in ``steps`` steps at least.  A null text is an empty one (its end
    only); repeated rows stay; a row may have a null id; with nothing to learn from, all words are unknown.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(learn_from, F.lit(False)).alias("l"))
    training = rows.filter("l").select("t")
    counts = written(training_counts(training))
    model = fit_words(counts, pieces_that_begin(model_path), head)
    held, id_kind = docs.sparkSession.sparkContext.broadcast(model), to_arrow_type(kind)
    tail_kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32()), ("mass", pa.float64()), ("unseen", pa.float64())]))

    def run(batches):
        own, at = held.value, TaskContext.get().partitionId() << 40
        most = np.maximum(own.mass, 1).tolist()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sizes, known, base, score, tails, ids = [], [], [], [], [], []
                split = [lower_words(body) for body in raw(part.column(1))]
                all_facts, to = own.facts(list(chain.from_iterable(split))), 0
                for found in split:
                    facts, to = all_facts[to:to + len(found)], to + len(found)
                    in_head = facts[:, 2] > 0
                    ids.append(np.append(facts[:, 0], 0).astype(id_type(len(own.mass))).tobytes())
                    sizes.append(len(found) + 1)
                    known.append(int(in_head.sum()) + (own.mass[0] > 0))
                    base.append(facts[in_head, 4].sum() + float(own.base_score(own.mass[0])))
                    score.append(facts[in_head, 3].sum())
                    rare: dict[bytes, list] = {}
                    for at_word in np.flatnonzero(~in_head).tolist():
                        entry = rare.setdefault(found[at_word], [0, at_word])
                        entry[0] += 1
                    places = facts[[x[1] for x in rare.values()], :2].tolist() if rare else []
                    tails.append([(w, k, most[int(c)], u) for (w, (k, _)), (c, u) in zip(rare.items(), places)])
                flat = [x for tail in tails for x in tail]
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in tails]))).astype(np.int32)
                entries = pa.StructArray.from_arrays(
                    [pa.array([x[0] for x in flat], pa.binary()), pa.array([x[1] for x in flat], pa.int32()),
                     pa.array([x[2] for x in flat], pa.float64()), pa.array([x[3] for x in flat], pa.float64())], fields=list(tail_kind.value_type))
                number = pa.array(np.arange(at, at + part.num_rows), pa.int64())
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [number, part.column(0).cast(id_kind), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), entries), part.column(2), part.column(3),
                     pa.array(ids, pa.binary())],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail", "l", "h", "ids"])

    told = rows.select("i", "t", "l", F.xxhash64("i", "t").alias("h"))
    parts = written(told.mapInArrow(
        run, f"row long, doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double, "
             "tail array<struct<word: binary, k: int, mass: double, unseen: double>>, l boolean, h long, ids binary"))
    learned = learn_attention(parts.filter("l").select("h", "ids"), model.total, model.mass, steps)
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def attend(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                more = sent.value.log10_scores([np.frombuffer(x, id_type(sent.value.classes)) for x in raw(part.column(6))])
                whole = pa.array(part.column(5).to_numpy() + more, pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], whole], part.schema.names[:6])

    scored = parts.select("row", "doc_id", "n_tokens", "n_known", "base_score", "score", "ids").mapInArrow(
        attend, f"row long, doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    tail = parts.select("row", F.inline("tail")).join(counts, "word", "left")
    count = F.coalesce("c", F.lit(0))
    share = F.greatest(count - DISCOUNT, F.lit(0.0)) / F.col("mass") + F.pow(F.lit(10.0), F.col("unseen"))
    rest = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("n"), F.sum(F.col("k") * F.log10(share)).alias("s"),
        F.sum(F.col("k") * F.log10((count + 0.1) / F.lit(model.total + 0.1 * (model.distinct + 1)))).alias("b"))
    add = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return scored.join(rest, "row", "left").select(
        "doc_id", "n_tokens", add("n_known", "n"), F.lit(model.total).cast("long").alias("train_tokens"), add("base_score", "b"), add("score", "s"))
