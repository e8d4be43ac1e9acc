"""BM25 over an inverted index with block maxima: exact top-k hits that leave most posting blocks unread.

The index is parted by documents: texts travel once, to the other texts of their block, and a block's postings are made and written
where it lies, so no posting is shuffled.  An index row holds the postings of one term in one block: how many documents of each
field have it, the largest weights among them and the entries.  Weights are those of a document alone; how rare a term is
comes from the counts, for the terms that are asked.

A query first meets the maxima alone (narrow columns): their sum bounds the score of every document of a block.  The blocks
of the highest bounds are scored; what is then the k-th best score of a query tells which other blocks can still hold
a hit.  It also tells which terms matter: the weakest, whose largest weights together stay below it, cannot make a hit alone.
So the others' postings name the documents, and postings of weak terms are read only in blocks where
such a document could still come up to the mark.  No bound is an estimate, so the hits are those of the full sum.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import explode_rows, tokenize
from ..plans.scaled import first_k
from ..session import written
from .research import B, K1

BLOCK_DOCS = 64
SLACK = 1e-8  # sums of doubles in another order, and ranks by nine digits
TASK_DOCS = 1 << 14  # documents in one task of the build
TASK_LISTS = 1 << 19  # rows of the index in one task of a search
PAIRS = 1 << 14  # queries' terms that are added up at a time


class Index(NamedTuple):
    """``postings``: term, block, n0.., most0.., entries array<struct<doc_id,w0..>>, a number for each field; ``n_docs`` documents in all.

    ``n`` documents of the block have the term in that field; their weights ``w``, at most ``most``, are without the term's rarity.
    """

    postings: DataFrame
    n_docs: int
    fields: int


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term`` of ``query_id, text``: each different token once."""
    return explode_rows(queries.select("query_id", F.array_distinct(tokenize(F.lower("text"))).alias("qs")), F.col("qs"), "term").select("query_id", "term")


def _summed(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``at``, ascending, and the sum of ``value`` at each."""
    found, place = np.unique(at, return_inverse=True)
    return found, np.bincount(place, value, len(found))


def _inverted(weights: list[float], means: list[float]):
    """From the rows ``(doc_id, block, t0..)`` of one block, a token array for each field, to its index rows."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").combine_chunks().dictionary_encode("encode")
        doc, n_docs = ids.indices.to_numpy().astype(np.int64), len(ids.dictionary)
        tokens = [rows.column(f"t{k}").combine_chunks() for k in range(len(weights))]
        flat = [t.flatten() for t in tokens]
        words = pa.concat_arrays(flat).dictionary_encode()
        codes = np.split(words.indices.to_numpy().astype(np.int64), np.cumsum([len(f) for f in flat])[:-1])
        size, counts, parts = len(words.dictionary), [], []
        for own, lists, weight, mean in zip(codes, tokens, weights, means):
            length = pc.list_value_length(lists).to_numpy().astype(np.int64)
            texts, of = np.unique(doc << 32 | length, return_inverse=True)  # rows of one id and length are one text
            at, tf = np.unique(own * len(texts) + np.repeat(of, length), return_counts=True)
            term, text = at // len(texts), texts[at % len(texts)]
            counts.append(np.bincount(term, minlength=size))
            norm = tf + K1 * (1 - B + B * (text & 0xFFFFFFFF) / mean)
            parts.append(_summed(term * n_docs + (text >> 32), weight * tf * (K1 + 1) / norm))
        every = np.unique(np.concatenate([at for at, _ in parts]))
        starts = np.searchsorted(every, np.arange(size + 1) * n_docs)
        most, columns = [], [ids.dictionary.take(pa.array(every % n_docs))]
        for at, value in parts:
            held = np.full(len(every), np.nan)
            held[np.searchsorted(every, at)] = value
            most.append(np.fmax.reduceat(held, starts[:-1]) if size else held)
            columns.append(pa.array(held, from_pandas=True))
        entries = pa.StructArray.from_arrays(columns, ["doc_id", *[f"w{k}" for k in range(len(weights))]])
        return pa.table([
            words.dictionary, pa.repeat(rows.column("block")[0], size), *[pa.array(n, pa.int32()) for n in counts],
            *[pa.array(m, from_pandas=True) for m in most], pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries)],
            ["term", "block", *[f"n{k}" for k in range(len(weights))], *[f"most{k}" for k in range(len(weights))], "entries"])

    return run


def build_index(docs: DataFrame, boosts: Mapping[str, float], cluster: Column | None = None, block_docs: int = BLOCK_DOCS) -> Index:
    """Index of ``docs``: doc_id and one text column per boosted field; fields of a document and term add up to one weight.

    Blocks hold about ``block_docs`` documents; those of one ``cluster`` (a language, a site) share blocks, which makes the maxima
    tighter and changes no hit.  Entries of a row are at most one for each document of its block.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_docs))
    home = (F.lit("") if cluster is None else F.coalesce(cluster.cast("string"), F.lit(""))).alias("home")
    rows = docs.select("doc_id", home, *[F.coalesce(f, F.lit("")).alias(f"t{k}") for k, f in enumerate(boosts)])
    columns = [f"t{k}" for k in range(len(boosts))]
    tokens = [tokenize(F.lower(c)).alias(c) for c in columns]
    facts = rows.select(*[F.size(t).alias(c) for t, c in zip(tokens, columns)]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    sizes = rows.groupBy("home").agg(n_blocks.alias("n"))
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("home", "n")))).scalar()
    block = F.concat_ws("#", "home", F.pmod(F.xxhash64("doc_id"), F.try_element_at(F.col("n"), F.col("home"))).cast("string"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), facts["n"] // TASK_DOCS)
    dealt = rows.withColumn("n", table).select("doc_id", block.alias("block"), *columns).repartition(parts, "block").sortWithinPartitions("block")
    kind, numbers = docs.schema["doc_id"].dataType.simpleString(), range(len(boosts))
    schema = ", ".join(["term string", "block string", *[f"n{k} int" for k in numbers], *[f"most{k} double" for k in numbers],
                        f"entries array<struct<doc_id: {kind}, {', '.join(f'w{k}: double' for k in numbers)}>>"])
    lists = dealt.select("doc_id", "block", *tokens).groupBy("block").applyInArrow(
        _inverted([float(w) for w in boosts.values()], [facts[c] for c in columns]), schema)
    return Index(written(lists, compression="zstd"), facts["n"], len(boosts))


def rarity(index: Index, terms: DataFrame) -> DataFrame:
    """``term, idf0..`` of those of ``terms`` that the index holds."""
    asked = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    counted = asked.groupBy("term").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(index.fields)])
    return counted.select("term", *[F.log(1 + (index.n_docs - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)).alias(f"idf{k}") for k in range(index.fields)])


def _weight(index: Index, name: str) -> Column:
    return sum((F.col(f"idf{k}") * F.coalesce(f"{name}{k}", F.lit(0.0)) for k in range(index.fields)), F.lit(0.0))


def _maxima(index: Index, terms: DataFrame, idf: DataFrame) -> DataFrame:
    """``query_id, term, block, most``: no document of the block owes more than ``most`` to the term."""
    lists = index.postings.select("term", "block", *[f"most{k}" for k in range(index.fields)]).join(idf, "term")
    return lists.select("term", "block", _weight(index, "most").alias("most")).join(terms, "term")


def candidate_blocks(index: Index, terms: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """``query_id, block, bound``: no document of the block scores more than ``bound``."""
    return _maxima(index, terms, rarity(index, terms) if idf is None else idf).groupBy("query_id", "block").agg(F.sum("most").alias("bound"))


def term_roles(index: Index, terms: DataFrame, idf: DataFrame, floor: DataFrame) -> DataFrame:
    """``query_id, term, strong``: weak terms of a query together weigh less than its ``floor``; without one all are strong."""
    most = _maxima(index, terms.select("term").distinct(), idf).groupBy("term").agg(F.max("most").alias("most"))
    below = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)  # a query's own terms
    held = terms.join(most, "term").join(floor, "query_id", "left").withColumn("sum", F.sum("most").over(below))
    return held.select("query_id", "term", (F.col("sum") + SLACK >= F.coalesce("floor", F.lit(0.0))).alias("strong"))


class _Asked:
    """The queries in every task of a search: their terms with role and rarity, their floors, and the blocks that were scored before."""

    def __init__(self, roles: pa.Table, floors: pa.Table, first: pa.Table, fields: int):
        self.queries = roles.column("query_id").combine_chunks().unique()
        self.terms = roles.column("term").combine_chunks().unique()
        number = lambda column, among: pc.index_in(column.combine_chunks(), value_set=among).to_numpy()
        query, term = number(roles.column("query_id"), self.queries), number(roles.column("term"), self.terms)
        order = np.argsort(query, kind="stable")
        self.query, self.term, self.strong = query[order], term[order], np.array(roles.column("strong"), bool)[order]
        self.idf = np.zeros((fields, len(self.terms)))
        for k in range(fields):
            self.idf[k, term] = roles.column(f"idf{k}").to_numpy()
        self.floor = np.zeros(len(self.queries))
        self.floor[number(floors.column("query_id"), self.queries)] = floors.column("floor").to_numpy()
        self.first: dict[str, list[int]] = {}
        for block, q in zip(first.column("block").to_pylist(), number(first.column("query_id"), self.queries).tolist()):
            self.first.setdefault(block, []).append(q)
        edges = np.append(np.flatnonzero(np.diff(self.query, prepend=-1)), len(query))  # where each query's terms begin
        cuts = np.unique(np.searchsorted(edges, np.arange(0, len(query) + PAIRS, PAIRS), side="right") - 1)
        self.shares = list(zip(edges[cuts].tolist(), edges[cuts[1:]].tolist()))


def _rows_added(own: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``own`` that have one number in ``of``, which ascends; ``n`` rows."""
    out = np.zeros((n, own.shape[1]))
    if len(of):
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[starts]] = np.add.reduceat(own, starts, axis=0)
    return out


def _hits_of_block(sent, fields: int):
    """From a block's index rows to its documents that come up to a query's floor, and what was read for which query."""

    def run(rows: pa.Table) -> pa.Table:
        asked = sent.value
        at = pc.index_in(rows.column("term").combine_chunks(), value_set=asked.terms).to_numpy()
        lists = rows.column("entries").combine_chunks()
        entries, of = lists.flatten(), np.repeat(np.arange(len(at)), pc.list_value_length(lists).to_numpy())
        ids = entries.field("doc_id").dictionary_encode("encode")
        held, most = np.zeros((len(at), len(ids.dictionary))), np.zeros(len(at))
        for k in range(fields):
            idf = asked.idf[k, at]
            held[of, ids.indices.to_numpy()] += idf[of] * np.nan_to_num(entries.field(f"w{k}").to_numpy(zero_copy_only=False))
            most += idf * np.nan_to_num(rows.column(f"most{k}").to_numpy())
        where = np.full(len(asked.terms), -1)
        where[at] = np.arange(len(at))
        done = np.zeros(len(asked.queries), bool)
        block = rows.column("block")[0]
        done[asked.first.get(block.as_py(), [])] = True
        out = []
        for low, high in asked.shares:
            row, query, strong = where[asked.term[low:high]], asked.query[low:high], asked.strong[low:high]
            base, n = query[0], int(query[-1] - query[0]) + 1
            here = row >= 0
            row, query, strong = row[here], query[here] - base, strong[here]
            floor = asked.floor[base:base + n]
            weakest = np.bincount(query[~strong], most[row[~strong]], n)
            more = (np.bincount(query, most[row], n) + SLACK >= floor) & ~done[base:base + n]
            first = strong & more[query]
            own = _rows_added(held[row[first]], query[first], n)
            able = (own > 0) & (own + weakest[:, None] + SLACK >= floor[:, None])
            again = able.any(1)
            second = ~strong & again[query]
            own += _rows_added(held[row[second]], query[second], n)
            q, doc = np.nonzero(able & (own + SLACK >= floor[:, None]))
            read = [np.unique(query[first]), np.flatnonzero(again)]
            told = np.concatenate((q, *read)) + base
            rest = sum(map(len, read))
            what = pa.array([None] * len(q) + ["strong"] * len(read[0]) + ["weak"] * len(read[1]), pa.string())
            out.append(pa.table([
                asked.queries.take(pa.array(told)), pa.repeat(block, len(told)),
                pa.chunked_array([ids.dictionary.take(pa.array(doc)), pa.nulls(rest, ids.dictionary.type)]),
                pa.array(np.concatenate((own[q, doc], np.zeros(rest)))), what], ["query_id", "block", "doc_id", "score", "terms"]))
        return pa.concat_tables(out)

    return run


class Search(NamedTuple):
    hits: DataFrame  # query_id, doc_id, score, rank
    read: DataFrame  # query_id, block, terms: blocks whose entries were read, and for which of the query's terms (all, strong, weak)


def search(index: Index, queries: DataFrame, k: int = 10, first_blocks: int = 8) -> Search:
    """The ``k`` best documents of every query, by score (nine digits) and then ``doc_id``.

    ``first_blocks`` blocks a query are scored to learn how good its k-th hit is at least.  The queries' terms are held in every task; a block's
    entries are added up where the block lies, so that only documents that come up to the mark leave it.
    """
    spark, n = queries.sparkSession, range(index.fields)
    terms = written(query_terms(queries))
    index = index._replace(postings=written(index.postings.join(terms.select("term").distinct(), "term", "left_semi"), compression="zstd"))
    idf = written(rarity(index, terms))
    first = written(first_k(candidate_blocks(index, terms, idf), ["query_id"], [F.desc("bound"), F.col("block")], first_blocks).select("query_id", "block"))
    order = [F.round("score", 9).desc(), F.col("doc_id")]
    lists = index.postings.select("term", "block", "entries").join(first.join(terms, "query_id").join(idf, "term"), ["term", "block"])
    entries = lists.select("query_id", *[f"idf{k}" for k in n], F.inline("entries"))
    early = written(first_k(entries.groupBy("query_id", "doc_id").agg(F.sum(_weight(index, "w")).alias("score")), ["query_id"], order, k))
    floor = early.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "floor")
    roles = term_roles(index, terms, idf, floor).join(idf, "term")
    kinds = {name: df.schema[name].dataType for df, name in ((terms, "query_id"), (early, "doc_id"))}
    asked = spark.sparkContext.broadcast(_Asked(roles.toArrow(), floor.toArrow(), first.toArrow(), index.fields))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.postings.count() // TASK_LISTS)
    found = written(index.postings.repartition(parts, "block").groupBy("block").applyInArrow(
        _hits_of_block(asked, index.fields),
        f"query_id {kinds['query_id'].simpleString()}, block string, doc_id {kinds['doc_id'].simpleString()}, score double, terms string"))
    late = found.filter("terms is null").select("query_id", "doc_id", "score")
    hits = first_k(early.unionByName(first_k(late, ["query_id"], order, k)), ["query_id"], order, k, "rank")
    return Search(hits, first.select("query_id", "block", F.lit("all").alias("terms")).unionByName(found.filter("terms is not null").select("query_id", "block", "terms")))
