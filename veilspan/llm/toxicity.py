"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean embedding of its hashed character n-grams and of itself; a passage of
``width`` words is the mean of its words; a linear softmax over the passage gives the two
classes.  An unseen misspelling keeps most n-grams of the word it comes from.  Labels are
given for whole texts while the offending words may be few, so a text counts as toxic when
any of its overlapping passages does: training maximises the noisy-or over passages, and a
text's score is its worst passage, put on the scale of a probability by a logistic fit on
labelled texts that the embeddings did not see.

The two-class softmax depends on the difference of its rows only, so at scoring time a word
is one number; texts are scored where they are, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.text import hash_sample, raw

BUCKETS = 1 << 17
PRIME = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20  # characters handled at once


def word_features(text: str, low: int = 3, high: int = 5, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the character n-grams of every word and of the word itself; the word each belongs to; how many words.

    Words are runs of letters and digits in lower case, bounded by a mark on both sides; any other
    ASCII character only separates.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = (code >= 128) | ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57))
    keep = letter | np.concatenate((letter[1:], [False]))  # of each run of separators, the last
    code = np.concatenate(([0], np.where(letter, code, 0)[keep], [0])).astype(np.uint64)
    inner = code > 0
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    number = np.cumsum(inner & np.concatenate(([False], ~inner[:-1]))) - 1
    found, owner = [], []
    rolled = code.copy()
    for n in range(2, high + 1):
        rolled = (rolled[:-1] * PRIME) ^ code[n - 1:]
        if n < low:
            continue
        first, last = slice(1, len(rolled) + 1), slice(n - 2, len(rolled) + n - 2)
        good = np.flatnonzero(inner[first] & inner[last] & (number[first] == number[last]))
        found.append(rolled[good] + np.uint64(n)), owner.append(number[good + 1])
    at = np.arange(len(code)) - starts[np.maximum(number, 0)]
    mixed = np.where(inner, (code + PRIME) * (np.uint64(2) * at.astype(np.uint64) + np.uint64(1)) * PRIME, np.uint64(0))
    mixed ^= mixed >> np.uint64(29)
    found.append(np.add.reduceat(np.where(inner, mixed, np.uint64(0)), starts)), owner.append(np.arange(len(starts)))
    hashed = np.concatenate(found)
    hashed = (hashed ^ (hashed >> np.uint64(31))) * PRIME
    return ((hashed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), np.concatenate(owner), len(starts)


def pieces(text: bytes):
    """The text in parts of about ``CHUNK`` characters, cut at a space, so that a very long text needs no more memory."""
    whole = text.decode("utf-8", "replace")
    at = 0
    while at < len(whole):
        to = at + CHUNK
        if to < len(whole):
            to = max(whole.rfind(" ", at, to), whole.rfind("\n", at, to), at) + 1 if " " in whole[at:to] or "\n" in whole[at:to] else to
        yield whole[at:to]
        at = to


@dataclass
class ToxicityModel:
    """``weight``: each bucket's embedding times the softmax difference; ``slope``, ``shift``: the logistic fit."""

    weight: np.ndarray
    bias: float
    width: int
    slope: float
    shift: float

    def margin(self, text: bytes) -> float:
        """Largest passage margin of the whole text; the bias alone for a text without words."""
        values = []
        for part in pieces(text):
            flat, owner, n = word_features(part)
            if n:
                values.append(np.bincount(owner, self.weight[flat], n) / np.bincount(owner, minlength=n))
        return (float(passage_sums(np.concatenate(values), self.width).max()) if values else 0.0) + self.bias

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -40, 40))))


def passage_starts(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping passages of ``width`` words, half a width apart; a short text is padded with nothing."""
    starts = np.arange(0, max(1, n - width // 2), max(1, width // 2))
    return starts, np.minimum(starts + width, n)


def passage_sums(values: np.ndarray, width: int) -> np.ndarray:
    starts, ends = passage_starts(len(values), width)
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[ends] - sums[starts]


def train(texts: list[bytes], labels: list[int], width: int = 8, dim: int = 8, steps: int = 600, rate: float = 0.1,
          seed: int = 7, batch: int = 32, min_texts: int = 3) -> ToxicityModel:
    """Fits embeddings and softmax together by Adagrad on four fifths of the texts, the logistic scale on the rest.

    The averages are scaled by the passage width before the softmax, which only changes its unit.  N-grams of
    fewer than ``min_texts`` texts stay at zero: a single text's own words tell nothing of others.  No text,
    or one class only: a constant model whose score is the smoothed share of label 1.
    """
    y = np.array(labels, float)
    prior = (y.sum() + 0.02) / (len(y) + 0.2)
    blank = ToxicityModel(np.zeros(BUCKETS), 0.0, width, 0.0, float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return blank
    spread = np.zeros(BUCKETS, np.int64)
    for text in texts:
        seen = np.zeros(BUCKETS, bool)
        for part in pieces(text):
            seen[word_features(part)[0]] = True
        spread += seen
    live = spread >= min_texts
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, dim)) * live[:, None]
    soft = rng.normal(0, 0.5, (dim, 2))
    bias = np.array([2.5, -2.5])
    seen_t, seen_s, seen_b = np.full((BUCKETS, dim), 1e-4), np.full((dim, 2), 1e-2), 1e-2
    order = rng.permutation(len(texts))
    inside, held = order[len(texts) // 5:], order[: len(texts) // 5]
    share = min(max(y[inside].mean(), 1e-3), 1 - 1e-3)
    weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    done = 0
    while done < steps:
        rng.shuffle(inside)
        for k in range(0, min(len(inside), (steps - done) * batch), batch):
            done += 1
            flat, owner, starts, ends, of, kept, total = [], [], [], [], [], [], 0
            for i in inside[k:k + batch]:
                words_before = total
                for part in pieces(texts[i]):
                    f, o, n = word_features(part)
                    flat.append(f), owner.append(o + total)
                    total += n
                if total > words_before:
                    a, b = passage_starts(total - words_before, width)
                    starts.append(a + words_before), ends.append(b + words_before), of.append(np.full(len(a), len(kept)))
                    kept.append(i)
            if not kept:
                continue
            flat, owner, starts, ends, of = map(np.concatenate, (flat, owner, starts, ends, of))
            delta = soft[:, 1] - soft[:, 0]
            count = np.bincount(owner, minlength=total)
            value = np.bincount(owner, (table @ delta)[flat], total) / count
            sums = np.concatenate(([0.0], np.cumsum(value)))
            p = 1 / (1 + np.exp(-np.clip(sums[ends] - sums[starts] + bias[1] - bias[0], -30, 30)))
            p = np.minimum(p, 1 - 1e-7)
            none = np.exp(np.bincount(of, np.log1p(-p), len(kept)))
            # slope of -log likelihood by a passage's margin, under the noisy-or
            pull = np.where(y[kept] > 0, -none / np.maximum(1 - none, 1e-6), 1.0) * weights[kept]
            g = p * pull[of] / len(kept)
            jumps = np.bincount(starts, g, total + 1) - np.bincount(ends, g, total + 1)
            by_word = np.cumsum(jumps)[:-1] / count
            by_bucket = np.bincount(flat, by_word[owner], BUCKETS) * live
            g_delta = table.T @ by_bucket
            g_soft = np.stack([-g_delta, g_delta], 1)
            rows = np.flatnonzero(by_bucket)
            g_rows = by_bucket[rows, None] * delta
            seen_t[rows] += g_rows ** 2
            table[rows] -= rate * g_rows / np.sqrt(seen_t[rows])
            seen_s += g_soft ** 2
            soft -= rate * g_soft / np.sqrt(seen_s)
            seen_b += g.sum() ** 2
            bias += 0.5 * rate * g.sum() / np.sqrt(seen_b) * np.array([1.0, -1.0])
    model = ToxicityModel(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]), width, 1.0, 0.0)
    fit_on = held if 0 < y[held].sum() < len(held) else order
    model.slope, model.shift = logistic(np.array([model.margin(texts[i]) for i in fit_on]), y[fit_on])
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a ridge-damped logistic fit by Newton steps."""
    centre, scale = x.mean(), x.std() + 1e-9
    z, beta = np.stack([(x - centre) / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 0.05, z.T @ (p - y) + 0.05 * beta)
        beta -= np.clip(step, -2, 2)
    slope = max(0.0, beta[0] / scale)
    return float(slope), float(beta[1] - slope * centre)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label",
        per_class: int = 3000, sample_chars: int = 30_000_000) -> ToxicityModel:
    """Trains on a bounded sample: of each label, the ``per_class`` different texts of least hashed id, whole texts only.

    A text that does not fit into what is left of ``sample_chars / 2`` characters of its class is passed over; if
    none fits, the shortest is taken.  Null labels are not read; an id
    with several labels takes the largest; a null text is empty.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    size = docs.select(F.col(doc_id).alias("i"), F.length(content).alias("n"), F.xxhash64(content).alias("c")).distinct()
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg((F.max(label) > 0).cast("int").alias("y"))
    first = Window.partitionBy("y").orderBy(F.xxhash64(F.col("i").cast("string"), F.lit("sample")), "i", "c")
    few = hash_sample(size.join(marks, "i"), "y", "i", per_class)
    picked = few.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_class).collect()
    chosen = []
    for y in (0, 1):
        left, own = sample_chars // 2, []
        rows = sorted((r for r in picked if r.y == y), key=lambda r: r.k)
        for row in rows:
            if row.n <= left:
                left -= row.n
                own.append((row.i, row.c, y))
        if rows and not own:
            row = min(rows, key=lambda r: (r.n, r.k))
            own.append((row.i, row.c, y))
        chosen += own
    if not chosen:
        return train([], [])
    keys = spark.createDataFrame(chosen, f"i {docs.schema[doc_id].dataType.simpleString()}, c long, y int")
    rows = (docs.select(F.col(doc_id).alias("i"), F.xxhash64(content).alias("c"), content.alias("t"))
            .join(F.broadcast(keys), ["i", "c"]).dropDuplicates(["i", "c"]).select("c", "y", "t").collect())
    rows.sort(key=lambda r: (r.c, r.y))
    return train([r.t.encode() for r in rows], [r.y for r in rows])


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """The score of every whole text; a null or wordless text has the score of the bias alone."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = (raw(column.slice(at, 128)) for at in range(0, len(column), 128))
        return pa.array([held.value.score(x) for part in parts for x in part], pa.float64())

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, doc_id: str = "doc_id", text: str = "text",
             label: str = "label", threshold: float = 0.3, **bounds) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); the model learns from rows with ``labels``.

    ``learn_from`` restricts the rows of ``docs`` that are learned from.  Every row gets a score, whatever
    its id; repeated rows get equal scores; an empty table stays empty.  With no labelled rows, or one
    class only, the score is a constant.  Columns named ``score`` or ``predicted`` are replaced.
    """
    model = fit(docs if learn_from is None else docs.filter(learn_from), labels, doc_id, text, label, **bounds)
    scored = docs.withColumn("score", score_column(docs.sparkSession, model, F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
