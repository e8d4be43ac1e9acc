"""Language identification by word-first backoff.

A word seen in training is scored by its log relative frequency in each language.  An unseen
word falls back to its character n-grams, the longest length first: the first length of which
any n-gram is known gives the score, the mean over that word's known n-grams.  A text's score
is the mean over its words.  The counts are made by Spark over a bounded, documented sample of
labelled documents; what is broadcast is the most frequent entries of each language, so its
size is bounded by parameters and not by the input.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.storage import written
from veilspan.llm.text import hash_sample, raw

#: Characters that ``\\w`` takes though they are no letters, such as fractions and Roman numerals.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
LETTERS = re.compile(rf"[^\W\d_{NUMBERS}]+")
RUNS = re.compile(r"[^\W\d_]+")  # a small class; thirty times faster than that of LETTERS
CACHE = 200_000
UNKNOWN = "und"


def letter_words(text: str) -> list[str]:
    """What ``LETTERS`` finds; only runs that hold a number go through it."""
    found = RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else LETTERS.findall(run))]


@dataclass
class LanguageModel:
    """``tables[n]`` maps an n-gram (``n = 0``: a word) to a row of log10 frequencies, one for each language."""

    languages: list[str]
    tables: dict[int, dict[str, np.ndarray]]
    floor: float
    _rows: list = field(default_factory=list, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_rows": [], "_known": {}}

    def word_scores(self, word: str) -> np.ndarray:
        row = self.tables[0].get(word)
        if row is not None:
            return row
        bounded = f" {word} "
        for n in sorted((k for k in self.tables if k), reverse=True):
            grams = [self.tables[n][g] for g in (bounded[i:i + n] for i in range(len(bounded) - n + 1)) if g in self.tables[n]]
            if grams:
                return np.mean(grams, axis=0)
        return np.full(len(self.languages), self.floor)

    def predict(self, text: bytes) -> tuple[str, float]:
        found = letter_words(text.decode("utf-8", "replace").lower())
        if not found or not self.languages:
            return UNKNOWN, 0.0
        if len(self._known) > CACHE:
            self._known.clear(), self._rows.clear()
        known, rows, at = self._known, self._rows, []
        for word in found:
            k = known.get(word)
            if k is None:
                k = known[word] = len(rows)
                rows.append(self.word_scores(word))
            at.append(k)
        number, times = np.unique(np.array(at), return_counts=True)
        means = times @ np.array([rows[k] for k in number]) / len(at)
        best = int(means.argmax())  # of equal languages, the first in order
        odds = 10.0 ** np.clip((means - means[best]) * min(len(at), 20), -30, 0)
        return self.languages[best], float(1 / odds.sum())


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000,
        top_words: int = 40_000, top_grams: int = 8_000, longest: int = 5, max_languages: int = 256) -> LanguageModel:
    """Counts words and n-grams in the ``per_language`` texts of least hashed id of each language.

    At most ``top_words`` words and ``top_grams`` n-grams of each length are kept for each language, most
    frequent first, and at most ``max_languages`` languages (more is an error, nothing is dropped).
    """
    content = F.coalesce(F.col(text), F.lit(""))
    sample = Window.partitionBy("l").orderBy(F.xxhash64(F.col("i").cast("string"), F.lit("sample")), "i", "c")
    named = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(doc_id).alias("i"), F.xxhash64(content).alias("c"))
    picked = (hash_sample(named.distinct(), "l", "i", per_language)
              .withColumn("k", F.row_number().over(sample)).filter(F.col("k") <= per_language).drop("k").collect())
    names = sorted({r.l for r in picked})
    if len(names) > max_languages:
        raise ValueError(f"{len(names)} languages; max_languages is {max_languages}")
    if not names:
        return LanguageModel([], {0: {}}, -8.0)
    spark = labelled.sparkSession
    keys = spark.createDataFrame(picked, f"l string, i {labelled.schema[doc_id].dataType.simpleString()}, c long")
    texts = (labelled.select(F.col(lang).alias("l"), F.col(doc_id).alias("i"), F.xxhash64(content).alias("c"), content.alias("t"))
             .join(F.broadcast(keys), ["l", "i", "c"], "left_semi"))

    def count_words(batches):
        for batch in batches:
            counts: dict[tuple, int] = {}
            for name, body in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                for word in letter_words(body.decode("utf-8", "replace").lower()):
                    counts[name, word] = counts.get((name, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["l", "g", "c"])

    words_of = texts.select("l", "t").mapInArrow(count_words, "l string, g string, c long").groupBy("l", "g").agg(F.sum("c").alias("c"))
    bounded = F.concat(F.lit(" "), F.col("g"), F.lit(" "))
    every = F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, longest + 1)]), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(bounded) - n + 1)), lambda i: i + n - 1 <= F.length(bounded)),
        lambda i: F.struct(n.alias("n"), F.substr(bounded, i, n).alias("g")))))
    words_of = written(words_of)
    grams = words_of.select("l", "c", F.explode(every).alias("e")).groupBy("l", "e.n", "e.g").agg(F.sum("c").alias("c"))
    counted = words_of.select("l", F.lit(0).alias("n"), "g", "c").union(grams.select("l", "n", "g", "c"))
    totals = counted.groupBy("l", "n").agg(F.sum("c").alias("total"))
    order = Window.partitionBy("l", "n").orderBy(F.desc("c"), "g")
    top = (counted.withColumn("k", F.row_number().over(order))
           .filter(F.col("k") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams)).drop("k"))
    whole = {(r.l, r.n): r.total for r in totals.collect()}
    floor = -np.log10(max(whole.values(), default=1)) - 1.0
    at = {name: k for k, name in enumerate(names)}
    tables: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(longest + 1)}
    for l, n, g, c in top.toLocalIterator():
        row = tables[n].get(g)
        if row is None:
            row = tables[n][g] = np.full(len(names), floor)
        row[at[l]] = np.log10(c / whole[l, n])
    return LanguageModel(names, tables, float(floor))


def language_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Struct ``(lang_pred, score)`` of every whole text."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(column: pa.Array) -> pa.Array:
        found = [held.value.predict(x) for x in raw(column)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                          ["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, learn_from: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             **bounds) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: the share of the best language among the odds).

    Learns from rows with a language (and ``learn_from``).  ``und`` with score 0 where the text is null or has
    no letter (numbers that are no letters do not count), or nothing was learned.  Every row is kept, whatever its id; ties go to the first language
    in order; an empty table stays empty.  Columns named ``lang_pred`` or ``score`` are replaced.
    """
    model = fit(docs if learn_from is None else docs.filter(learn_from), doc_id, text, lang, **bounds)
    found = docs.withColumn("__lang", language_column(docs.sparkSession, model, F.col(text)))
    return found.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
