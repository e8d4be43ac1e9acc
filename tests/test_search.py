"""Block-max search against the full sum."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspan.operators import research as Z
from veilspan.operators import search as W

BOOSTS = {"title": 2.0, "body": 1.0}


def corpus(spark, seed, n):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(k))
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([text(5), "", None]), text(rng.randrange(60))) for i in range(n)]
    rows += [(n + i, "en", "same title", "same body c1 r7") for i in range(40)]  # ties
    queries = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(100, "unknownword"), (101, ""), (102, None), (103, "same body"), (104, "c1 c1 C1")]
    return spark.createDataFrame(rows, "doc_id long, lang string, title string, body string"), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("cluster,block,first", [(None, 64, 8), ("lang", 4, 1), ("lang", 16, 3)])
def test_hits_are_those_of_the_full_sum(spark, cluster, block, first):
    docs, queries = corpus(spark, block, 600)
    index = W.build_index(docs, BOOSTS, F.col(cluster) if cluster else None, block)
    found = W.search(index, queries, 10, first)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in df.select("query_id", "rank", "doc_id", "score").collect())
    assert rows(found.hits) == rows(Z.top_hits(Z.bm25(docs, queries, BOOSTS)))
    assert found.read.count() == found.read.distinct().count()


def test_common_words_and_other_topics_are_left_unread(spark):
    """Five topics with words of their own and twenty words that all share: a question about one topic reads little else."""
    rng, rows = random.Random(2), []
    for i in range(1000):
        own = [f"t{i % 5}w{rng.randrange(200)}" for _ in range(10)]
        rows.append((i, f"t{i % 5}", "", " ".join(own + [f"c{rng.randrange(20)}" for _ in range(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, topic string, title string, body string")
    queries = spark.createDataFrame([(q, " ".join(rows[q][3].split()[:16])) for q in range(20)], "query_id long, text string")
    index = W.build_index(docs, BOOSTS, F.col("topic"), 16)
    found = W.search(index, queries, 5, 4)
    full = sorted((r.query_id, r.rank, r.doc_id) for r in Z.top_hits(Z.bm25(docs, queries, BOOSTS), 5).collect())
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found.hits.collect()) == full
    size = index.postings.select("term", "block", F.size("entries").alias("n"))
    every = W.query_terms(queries).join(size, "term").agg(F.sum("n")).first()[0]
    weak = W.query_terms(queries).join(found.read.filter("terms <> 'strong'"), "query_id").join(size, ["term", "block"]).agg(F.sum("n")).first()[0]
    assert weak < every / 2


def test_bounds_hold_and_an_index_serves_many_searches(spark):
    docs, queries = corpus(spark, 3, 200)
    index = W.build_index(docs, BOOSTS, F.col("lang"), 8)
    terms = W.query_terms(queries)
    bounds = {(r.query_id, r.block): r.bound for r in W.candidate_blocks(index, terms).collect()}
    home = {e.doc_id: r.block for r in index.postings.collect() for e in r.entries}
    for r in Z.bm25(docs, queries, BOOSTS).collect():
        assert r.score <= bounds[r.query_id, home[r.doc_id]] + 1e-9
    assert W.search(index, queries.limit(0)).hits.count() == 0
    one = W.search(index, queries.filter("query_id = 103"), k=3).hits.collect()
    assert len(one) == 3
    assert W.search(W.build_index(docs.limit(0), BOOSTS), queries).hits.count() == 0


def test_judged_rows_give_the_ndcg_of_all_pairs_without_making_them(spark):
    """F12, F14, F17"""
    rng = random.Random(12)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60))}"
    docs = spark.createDataFrame([(d, " ".join(word() for _ in range(rng.randrange(9)))) for d in range(300)], "doc_id long, body string")
    queries = spark.createDataFrame([(q, " ".join(word() for _ in range(rng.randrange(5)))) for q in range(25)], "query_id long, text string")
    labels = spark.createDataFrame([(rng.randrange(320), rng.choice((0, 1, 1, 2, None))) for _ in range(260)], "doc_id long, rel int")
    index = Z.postings(docs, queries, {"body": 1.0})
    scored = Z.scores(index)
    hits, other = Z.top_hits(scored), docs.select("doc_id").filter("doc_id < 15").crossJoin(queries.select("query_id")).withColumn("rank", F.lit(3))
    every, few = scored.join(labels, "doc_id").select("query_id", "doc_id", "rel"), Z.judged_rows(index, labels, [hits, other])
    for found in (hits, other):
        a, b = (sorted((r.query_id, round(r.ndcg, 9)) for r in Z.ndcg(found, judged).collect()) for judged in (every, few))
        assert a == b and len(a) > 10
    assert few.count() < every.count()


def test_no_posting_is_shuffled_to_build_the_index(spark, monkeypatch):
    """texts travel to their block once; what is made of them is written there."""
    plans = []
    for name in ("written", "cut_lineage"):
        of = getattr(W, name, None)
        if of:
            monkeypatch.setattr(W, name, lambda df, of=of, **kind: plans.append(df) or of(df, **kind))
    docs, _ = corpus(spark, 5, 100)
    index = W.build_index(docs, BOOSTS, F.col("lang"), 16)
    assert len(plans) == 1
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.split("FlatMapGroupsInArrow")[1].split("Subquery")[0].count("Exchange hashpartitioning") == 1
    assert {"term", "block", "entries"} <= set(index.postings.columns)


def test_repeated_rows_of_an_id_add_up(spark):
    """as in the SQL, rows of one id and length are counted together; empty fields and a null id do no harm."""
    rows = [(1, "en", "a b", "c c d"), (1, "en", "a b", "c c d"), (2, "en", None, ""), (3, "de", "", "c"), (None, "en", "d", "e a")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, title string, body string")
    queries = spark.createDataFrame([(1, "a c"), (2, "d e"), (3, "z")], "query_id long, text string")
    expected = {}
    for q, text in ((1, "a c"), (2, "d e")):
        for at, boost in ((2, 2.0), (3, 1.0)):
            tf = Counter((r[0], len((r[at] or "").split()), t) for r in rows for t in (r[at] or "").split())
            mean = sum(len((r[at] or "").split()) for r in rows) / len(rows)
            for (d, n, t), c in tf.items():
                if t in text.split():
                    df = sum(x[2] == t for x in tf)
                    w = boost * math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean))
                    expected[q, str(d)] = expected.get((q, str(d)), 0.0) + w
    found = W.search(W.build_index(docs, BOOSTS, F.col("lang")), queries).hits.collect()
    assert {(r.query_id, str(r.doc_id)): round(r.score, 7) for r in found} == {k: round(w, 7) for k, w in expected.items()}
