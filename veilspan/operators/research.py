"""Search, finance, extraction and robustness measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import explode_rows, tokenize
from ..plans.scaled import first_k
from ..session import cut_lineage
from .metrics import ratio

K1, B = 1.2, 0.75


# --- search -------------------------------------------------------------------------------------
SCORED_ROWS = 1 << 17  # postings in one task of the scoring


class Postings(NamedTuple):
    """``rows``: doc_id, term, w (written, each document and term once); ``terms``: query_id, term."""

    rows: DataFrame
    terms: DataFrame


def postings(docs: DataFrame, queries: DataFrame, boosts: Mapping[str, float]) -> Postings:
    """BM25 weights of the queries' terms in every document.

    ``docs``: doc_id and one text column per boosted field; ``queries``: query_id, text.
    The corpus is tokenised once: a field's query terms with their counts, and one marked row for its
    length, are written and serve lengths, document frequencies and scores.  Which join strategy
    serves the query terms is left to the size statistics.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokenize(F.lower(F.coalesce(f, F.lit("")))).alias("ts")) for f in boosts])
    per_field = explode_rows(docs.select("doc_id", fields.alias("fs")), F.col("fs"), "f").select("doc_id", "f.field", "f.ts")
    terms = explode_rows(queries.select("query_id", F.array_distinct(tokenize(F.lower("text"))).alias("qs")), F.col("qs"), "term").select("query_id", "term")
    wanted = terms.select("term").distinct().withColumn("used", F.lit(True))
    words = per_field.select("doc_id", "field", F.size("ts").alias("len"), F.posexplode_outer("ts").alias("at", "term"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    seen = words.join(wanted, "term", "left").filter(first | F.col("used"))
    seen = cut_lineage(seen.groupBy("doc_id", "field", "len", "term").agg(F.count("used").alias("tf"), F.max(first).alias("first")))
    stats = seen.filter("first").groupBy("field").agg(F.avg("len").alias("avg_len"), F.count(F.lit(1)).alias("n_docs"))
    tf = seen.filter("tf > 0").drop("first")
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.element_at(F.create_map(*[x for f, w in boosts.items() for x in (F.lit(f), F.lit(float(w)))]), F.col("field"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = tf.join(df, ["field", "term"]).join(F.broadcast(stats), "field").select(
        "doc_id", "term", (weight * idf * F.col("tf") * (K1 + 1) / norm).alias("w"))
    # Fields of one document and term add up before queries multiply the rows.
    return Postings(cut_lineage(part.groupBy("doc_id", "term").agg(F.sum("w").alias("w"))), terms)


def scores(index: Postings) -> DataFrame:
    """``query_id, doc_id, score`` of every document sharing a term with a query.

    Postings are dealt by document before queries multiply them, so that the pairs are added up where they are made and
    only what a caller keeps of them travels on.
    """
    parts = max(int(index.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.rows.count() // SCORED_ROWS)
    return index.rows.repartition(parts, "doc_id").join(index.terms, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, boosts: Mapping[str, float]) -> DataFrame:
    """:func:`scores` of :func:`postings`."""
    return scores(postings(docs, queries, boosts))


def judged_rows(index: Postings, labels: DataFrame, hits: Sequence[DataFrame], k: int = 10) -> DataFrame:
    """``query_id, doc_id, rel`` of all judged documents that nDCG at ``k`` reads, of those that share a term with the query.

    That is the judged among ``hits``, and the query's ``k`` best by ``rel`` and ``doc_id``: these are among the ``k`` best of each
    of its terms, so pairs of queries and documents need not be made.  ``labels``: doc_id, rel; a document may have several.
    """
    lab = labels.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("rel")))
    out = first_k(index.rows.join(lab, "doc_id").select("term", "doc_id", "rel", "__nth"), ["term"], [F.desc("rel"), F.col("doc_id")], k).join(
        index.terms, "term").select("query_id", "doc_id", "rel", "__nth")
    for found in hits:
        met = found.select("query_id", "doc_id").join(index.terms, "query_id").join(index.rows, ["doc_id", "term"], "left_semi")
        out = out.unionByName(met.select("query_id", "doc_id").distinct().join(lab, "doc_id").select("query_id", "doc_id", "rel", "__nth"))
    return out.distinct().drop("__nth")


def top_hits(scored: DataFrame, k: int = 10) -> DataFrame:
    return first_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], k, "rank")


def ndcg(hits: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per query; ``hits``: query_id, doc_id, rank; ``judged``: query_id, doc_id, rel."""
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)
    got = hits.filter(F.col("rank") <= k).join(judged, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    best = first_k(judged, ["query_id"], [F.desc("rel"), F.col("doc_id")], k, "rank").groupBy("query_id").agg(F.sum(gain).alias("ideal"))
    return best.join(got, "query_id", "left").select(
        "query_id", F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")), F.lit(0.0)).alias("ndcg"))


# --- finance --------------------------------------------------------------------------------------
def sma_crossover(prices: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """``prices``: symbol, day, price (one row per day, so a symbol's series is short).

    Long on the day after the fast mean is above the slow mean.
    """
    w = Window.partitionBy("symbol").orderBy("day")
    mean = lambda n: F.avg("price").over(w.rowsBetween(-(n - 1), 0))
    df = prices.withColumn("sma_fast", mean(fast)).withColumn("sma_slow", mean(slow))
    df = df.withColumn("position", F.when(F.col("sma_fast") > F.col("sma_slow"), 1).otherwise(0))
    ret = F.col("price") / F.lag("price").over(w) - 1
    return df.withColumn("strategy_return", F.coalesce(F.lag("position").over(w), F.lit(0)) * ret)


def sharpe(returns: DataFrame, days: int = 252, capital: float = 100_000.0) -> DataFrame:
    """Annualised mean over deviation (risk-free 0) and the final capital."""
    r = F.col("strategy_return")
    return returns.filter(r.isNotNull()).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), (F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(days)))).alias("sharpe"),
        (capital * F.exp(F.sum(F.log(1 + r)))).alias("final_capital"))


def momentum(prices: DataFrame, short: int = 12, long: int = 26, rsi: int = 14) -> DataFrame:
    """EMA, MACD and RSI on the last day of each symbol's (short) daily series."""
    ema = lambda n: (
        f"aggregate(slice(s, 2, size(s)), s[0].price, (a, x) -> a + (x.price - a) * {2.0 / (n + 1)!r}D)")
    moves = f"transform(sequence(greatest(1, size(s) - {rsi}), size(s) - 1), i -> s[i].price - s[i - 1].price)"
    side = lambda sign: f"aggregate(m, 0D, (a, x) -> a + greatest({sign}x, 0D))"
    df = prices.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "price"))).alias("s")).filter("size(s) > 1")
    df = df.select("symbol", F.expr(ema(short)).alias("ema_short"), F.expr(ema(long)).alias("ema_long"), F.expr(moves).alias("m"))
    up, down = F.expr(side("")), F.expr(side("-"))
    return df.select("symbol", "ema_short", "ema_long", (F.col("ema_short") - F.col("ema_long")).alias("macd"),
                     (100 * F.coalesce(F.try_divide(up, up + down), F.lit(0.5))).alias("rsi"))


# --- extraction and robustness -------------------------------------------------------------------
def triple_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro P/R/F1 per kind and overall over distinct ``kind, a, b, c`` triples."""
    side = lambda d, s: d.select("kind", "a", "b", "c").distinct().withColumn(s, F.lit(1))
    both = side(gold, "g").join(side(pred, "p"), ["kind", "a", "b", "c"], "full")
    cells = both.groupBy("kind").agg(F.count("g").alias("gold"), F.count("p").alias("pred"),
                                     F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    total = cells.agg(F.lit("overall").alias("kind"), *[F.sum(c).alias(c) for c in ("gold", "pred", "tp")])
    out = cells.unionByName(total)
    return out.select("kind", "gold", "pred", ratio(F.col("tp"), F.col("pred"), 0).alias("precision"),
                      ratio(F.col("tp"), F.col("gold"), 0).alias("recall"),
                      ratio(2 * F.col("tp"), F.col("gold") + F.col("pred"), 0).alias("f1"))


def robustness(df: DataFrame, group: str, variants: Mapping[str, Column], detect, truth: Column) -> DataFrame:
    """Recall of a detector on perturbed copies, per variant and group, with the widest gap.

    Copies are made inside the scan stage and reduced there.
    """
    copies = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("copy")) for n, c in variants.items()])
    rows = explode_rows(df.filter(truth).select(F.col(group).alias("group"), copies.alias("cs")), F.col("cs"), "v")
    out = rows.groupBy("v.variant", "group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(detect(F.col("v.copy"))).alias("hit"))
    per = out.select("variant", "group", "n", ratio(F.col("hit"), F.col("n"), 0).alias("recall"))
    gap = per.groupBy("variant").agg((F.max("recall") - F.min("recall")).alias("group_gap"))
    return per.join(gap, "variant")


def utility_drop(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean score on raw text, on redacted text, and the difference."""
    a = before.agg(F.avg("ndcg").alias("raw"))
    b = after.agg(F.avg("ndcg").alias("x")).scalar()
    return a.select("raw", b.alias("redacted"), (F.col("raw") - b).alias("utility_drop"))
