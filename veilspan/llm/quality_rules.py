"""Quality rules of texts, and verdicts on whole hosts from their rates of failure.

Only DataFrame functions are used.  A text's statistics are arrays on its own row; nothing of the
text is shuffled.  The narrow results are written once, summed by host, and each host's failure
rate is drawn towards the rate of all hosts by a beta prior whose strength comes from how much the
hosts differ beyond chance (moments weighted by size, so that many tiny hosts do not blur it).  Host verdicts are joined back to the documents;
adaptive execution broadcasts the hosts while they are few and splits a hot host otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.storage import written

BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; empty for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{BLANK}+"))


def text_rules(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``.

    Windows of ``size`` words are compared by their 64-bit hashes within one text.  Only texts in which
    some hash comes twice sort their windows; that is linear but for the sort, also for a very long text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(size)])
    first = docs.withColumns({"__w": word_array(F.col(text)), "__l": lines})
    counted = first.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.when(F.size("__w") >= size, F.transform(F.sequence(F.lit(0), F.size("__w") - size), window))
                .otherwise(F.array().cast("array<bigint>")),
    }).drop("__w", "__l", text)
    ordered = counted.withColumn("__s", F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda j: F.get(F.col("__s"), j)["h"]
    twice = F.filter("__s", lambda p, j: p["h"].eqNullSafe(near(j + 1)) | p["h"].eqNullSafe(near(j - 1)))
    placed = ordered.withColumn("__p", F.sort_array(F.transform(twice, lambda p: p["i"]))).drop("__s", "__h")
    steps = F.zip_with("__p", F.slice("__p", F.lit(2), F.greatest(F.size("__p"), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
    total = F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda x, y: x + y))
    return placed.withColumn("n_repeat_words", total.cast("long")).drop("__p")


def host_verdicts(failures: DataFrame, host: str, failed: str, max_rate: float = 0.5) -> DataFrame:
    """``(host, n, failures, rate, host_kept)``: shrunken rate of failure of each host, null host included."""
    by_host = written(failures.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")))
    m = by_host.agg(F.sum("failures").alias("f"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
                    F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
                    F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("spread")).first()
    mean = (m.f or 0) / m.n if m.n else 0.0
    chance = mean * (1 - mean)
    beyond = (m.spread or 0.0) - m.n * mean * mean - (m.hosts - 1) * chance if m.n else 0.0
    most = chance * (m.n - m.squares / m.n - (m.hosts - 1)) if m.n else 0.0
    if beyond > 0 and most > 0:
        strength = max(most / beyond - 1, 0.0)
        rate = (F.col("failures") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    else:
        rate = F.lit(float(mean))  # the hosts differ no more than chance has it
    return by_host.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= max_rate)


def quality_rules(docs: DataFrame, host: str, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
                  max_rate: float = 0.5) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept)`` for each row.

    A text fails with fewer than ``min_words`` words or more than ``max_repeat_percent`` of them in repeated
    windows; it is kept if it does not fail and its host's shrunken rate is at most ``max_rate``.  A null text
    is an empty one and fails; rows with a null host form a host of their own; repeated rows and null ids
    stay; an empty table gives an empty one.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = written(text_rules(narrow).withColumn("base_failed", failed))
    verdicts = host_verdicts(rows, "host", "base_failed", max_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_kept")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
                         (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
