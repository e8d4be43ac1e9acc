"""Runs, ranking, points, search, finance, streaming and sources."""

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import boards as B
from ..operators import policy as Y
from ..operators import research as Z
from ..operators import search as W
from ..sources import keyed_files, readers, sinks
from ..session import cut_lineage, work_folder
from ..streaming import live
from . import inputs as I
from . import transcripts as TX
from .decisions import rounded
from .registry import query


def runs(spark, root):
    e = I.load(spark, root, "events")
    return e.select(F.lit("events").alias("project"), F.col("user_id").alias("agent"), F.col("event_id").alias("run_id"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("metric"), F.col("event_type").alias("kind"),
                    F.get_json_object("props", "$.k").cast("int").alias("k"))


RUNS = "runs AS (SELECT 'events' AS project, user_id AS agent, event_id AS run_id, ts, value AS metric, event_type AS kind, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"
def _board_sql(sign=""):
    return f"""{RUNS}, best AS (SELECT agent, arg_min((metric, kind, run_id), ({sign} metric, run_id)) AS b, count(*) AS runs, max(ts) AS updated FROM runs GROUP BY agent),
board AS (SELECT agent, b[1] AS metric, b[2] AS kind, b[3] AS run_id, runs, updated, row_number() OVER (ORDER BY {sign} b[1], agent) AS rank FROM best)"""


_BOARD = _board_sql()


@query("l1_leaderboard", f"WITH {_BOARD} SELECT agent, metric, kind, run_id, runs, CAST(epoch_us(updated) AS BIGINT) AS updated_us, rank FROM board")
def leaderboard(spark, root):
    return B.leaderboard(runs(spark, root)).select("agent", "metric", "kind", "run_id", "runs", F.unix_micros("updated").alias("updated_us"), "rank")


@query("l1_leaderboard_high", f"WITH {_board_sql('-')} SELECT agent, metric, kind, run_id, runs, CAST(epoch_us(updated) AS BIGINT) AS updated_us, rank FROM board")
def leaderboard_high(spark, root):
    board = B.leaderboard(runs(spark, root), ascending=False)
    return board.select("agent", "metric", "kind", "run_id", "runs", F.unix_micros("updated").alias("updated_us"), "rank")


@query("l2_board_header", f"WITH {RUNS} SELECT project, count(DISTINCT agent) AS agents, count(*) AS experiments FROM runs GROUP BY project")
def board_header(spark, root):
    return B.header(runs(spark, root))


@query("l3_new_best", f"WITH {RUNS} SELECT run_id, p IS NULL OR metric < p AS is_new_best, round(CASE WHEN p IS NULL OR metric < p THEN p - metric END, 6) AS improvement FROM (SELECT *, min(metric) OVER (PARTITION BY agent ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM runs)")
def new_best(spark, root):
    return rounded(B.improvements(runs(spark, root)).select("run_id", "is_new_best", "improvement"))


@query("l3_new_best_high", f"WITH {RUNS} SELECT run_id, p IS NULL OR metric > p AS is_new_best, round(CASE WHEN p IS NULL OR metric > p THEN metric - p END, 6) AS improvement FROM (SELECT *, max(metric) OVER (PARTITION BY agent ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM runs)")
def new_best_high(spark, root):
    return rounded(B.improvements(runs(spark, root), ascending=False).select("run_id", "is_new_best", "improvement"))


@query("l4_network_snapshot_high", f"WITH {_board_sql('-')} SELECT 'events' AS project, string_agg(agent, ',' ORDER BY rank) FILTER (rank <= 10) AS top_agents, max(metric) AS global_best, count(*) AS agents, (SELECT count(*) FROM runs) AS experiments FROM board")
def network_snapshot_high(spark, root):
    r = runs(spark, root)
    return B.snapshot(B.leaderboard(r, ascending=False), r).select(
        "project", F.array_join(F.transform("top", lambda t: t["agent"].cast("string")), ",").alias("top_agents"), "global_best", "agents", "experiments")


@query("l4_network_snapshot", f"WITH {_BOARD} SELECT 'events' AS project, string_agg(agent, ',' ORDER BY rank) FILTER (rank <= 10) AS top_agents, min(metric) AS global_best, count(*) AS agents, (SELECT count(*) FROM runs) AS experiments FROM board")
def network_snapshot(spark, root):
    r = runs(spark, root)
    return B.snapshot(B.leaderboard(r), r).select(
        "project", F.array_join(F.transform("top", lambda t: t["agent"].cast("string")), ",").alias("top_agents"), "global_best", "agents", "experiments")


@query("l5_mutation_frequency", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def mutation_frequency(spark, root):
    rows = runs(spark, root).withColumn("hypothesis", F.concat("kind", F.lit(": k="), F.col("k").cast("string")))
    return B.mutation_frequency(rows).select("kind", "n")


@query("l6_loss_curves", f"WITH {RUNS} SELECT i, count(*) AS n, sum(step) AS steps, round(sum(loss), 4) AS loss FROM (SELECT 0 AS i, 0e0 AS step, metric AS loss FROM runs UNION ALL SELECT 1, k, metric / 2 FROM runs WHERE k IS NOT NULL) GROUP BY i")
def loss_curves(spark, root):
    curve = F.when(F.col("k").isNull(), F.array(F.array(F.lit(0.0), "metric"))).otherwise(
        F.array(F.array(F.lit(0.0), F.col("metric")), F.array(F.col("k").cast("double"), F.col("metric") / 2)))
    rows = B.loss_curves(runs(spark, root).withColumn("loss_curve", curve))
    return rows.groupBy(F.col("i").cast("long").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"), F.round(F.sum("loss"), 4).alias("loss"))


@query("l7_adoption", f"WITH {RUNS}, f AS (SELECT kind, min((ts, run_id, agent)) AS f FROM runs GROUP BY kind) SELECT kind, count(DISTINCT agent) AS adopters FROM runs JOIN f USING (kind) WHERE ts > f[1] AND agent <> f[3] GROUP BY kind")
def adoption(spark, root):
    return B.adoption(runs(spark, root))


def _stream(spark, root):
    raw = I.load(spark, root, "events")
    s = spark.readStream.schema(raw.schema).parquet(f"{root}/event[s].parquet")
    return s.select(F.lit("events").alias("project"), F.col("user_id").alias("agent"), F.col("event_id").alias("run_id"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("metric"), F.col("event_type").alias("kind"))


def _live_sql(sign):
    return f"WITH {RUNS}, b AS (SELECT agent, min(({sign} metric, run_id, kind)) AS b, count(*) AS runs, max(ts) AS u FROM runs GROUP BY agent) SELECT agent, {sign} b[1] AS metric, b[2] AS run_id, b[3] AS kind, runs, CAST(epoch_us(u) AS BIGINT) AS updated_us FROM b"


def _live_best(spark, root, ascending):
    out = live.drain(live.best_per_peer(_stream(spark, root), ascending), "complete", work_folder(spark, "live-best"))
    return out.select("agent", "best.metric", "best.run_id", "best.kind", "runs", F.unix_micros("updated").alias("updated_us"))


@query("l8_live_best_per_peer", _live_sql(""))
def live_best_per_peer(spark, root):
    return _live_best(spark, root, True)


@query("l8_live_best_per_peer_high", _live_sql("-"))
def live_best_per_peer_high(spark, root):
    return _live_best(spark, root, False)


def _hourly_sql(best):
    return f"WITH {RUNS} SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour_us, count(*) AS runs, {best}(metric) AS best FROM runs GROUP BY 1"


def _hourly(spark, root, ascending):
    closed = live.drain(live.hourly_snapshots(_stream(spark, root), ascending=ascending), "append", work_folder(spark, "hourly"))
    out = live.with_open_hours(closed, runs(spark, root).select("project", "ts", "metric"), ascending)
    return out.select(F.unix_micros("window.start").alias("hour_us"), "runs", "best")


@query("l9_hourly_snapshots", _hourly_sql("min"))
def hourly_snapshots(spark, root):
    """Closed hours from the stream, then the open ones in a last batch read."""
    return _hourly(spark, root, True)


@query("l9_hourly_snapshots_high", _hourly_sql("max"))
def hourly_snapshots_high(spark, root):
    return _hourly(spark, root, False)


@query("l10_presence_points", f"""WITH {RUNS}, s AS (SELECT agent, (epoch_us(ts) // 1000000) // 90 * 90 AS sec, max(CASE kind WHEN 'error' THEN 5e-1 ELSE 1e0 END) AS w FROM runs GROUP BY ALL),
h AS (SELECT *, (sec - min(sec) OVER (PARTITION BY agent)) / 36e2 AS t FROM s) SELECT agent, count(*) AS epochs, round(sum(10 * (1 + 2e-1 * ln(1 + t / 12)) * w), 4) AS points FROM h GROUP BY agent""")
def presence_points(spark, root):
    beats = runs(spark, root).select("agent", F.unix_seconds("ts").alias("seconds"), F.when(F.col("kind") == "error", 0.5).otherwise(1.0).alias("weight"))
    return rounded(B.presence_points(beats), 4)


@query("l11_work_points", f"""WITH {RUNS}, h AS (SELECT *, (epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER (PARTITION BY agent)) / 36e2 AS t FROM runs) SELECT agent, round(sum(coalesce(k, 0) * metric * CASE kind WHEN 'purchase' THEN 2e0 ELSE 1e0 END * (1 + 2e-1 * ln(1 + t / 12))), 3) AS points FROM h GROUP BY agent""")
def work_points(spark, root):
    work = runs(spark, root).select("agent", F.unix_seconds("ts").alias("seconds"), F.coalesce("k", F.lit(0)).alias("tokens"), F.col("metric").alias("unit_cost"),
                                    F.when(F.col("kind") == "purchase", 2.0).otherwise(1.0).alias("multiplier"))
    return rounded(B.work_points(work), 3)


# --- search ---------------------------------------------------------------------------------------
BOOSTS = {"title": 2.0, "body": 1.0}


def _corpus(spark, root, text=None, *more):
    t = F.col("text") if text is None else text
    docs = I.load_text(spark, root, "documents", "doc_id", "text", *more).withColumn("text", t)
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", *more).select(
        "doc_id", "title", F.expr("substring(text, length(title) + 2)").alias("body"), *more)


def _queries(spark, root):
    return I.load(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TK = f"regexp_extract_all(lower({{x}}), '{I.TOKEN_PATTERN.replace('{', '{{').replace('}', '}}')}')"


def _bm25_sql(docs="documents", p=""):
    """Common tables whose names begin with ``p``."""
    return f"""
{p}fld AS (SELECT doc_id, 'title' AS field, 2e0 AS boost, {_TK.format(x="string_split(text, chr(10))[1]")} AS ts FROM {docs} UNION ALL
  SELECT doc_id, 'body', 1e0, {_TK.format(x="substring(text, length(string_split(text, chr(10))[1]) + 2)")} FROM {docs}),
{p}st AS (SELECT field, avg(len(ts)) AS al, count(*) AS n FROM {p}fld GROUP BY field),
{p}qt AS (SELECT item_id AS query_id, unnest(list_distinct({_TK.format(x='text')})) AS term FROM benchmark),
{p}tf AS (SELECT doc_id, field, boost, len, term, count(*) AS tf FROM (SELECT doc_id, field, boost, len(ts) AS len, unnest(ts) AS term FROM {p}fld) WHERE term IN (SELECT term FROM {p}qt) GROUP BY ALL),
{p}df AS (SELECT field, term, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}pt AS (SELECT doc_id, term, sum(boost * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * len / al))) AS w FROM {p}tf JOIN {p}df USING (field, term) JOIN {p}st USING (field) GROUP BY ALL),
{p}sc AS (SELECT query_id, doc_id, sum(w) AS score FROM {p}pt JOIN {p}qt USING (term) GROUP BY ALL),
{p}hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}sc) WHERE rank <= 50)"""


@query("l12_bm25_search", f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, round(score, 5) AS score FROM hits WHERE rank <= 10")
def bm25_search(spark, root):
    hits = Z.top_hits(Z.bm25(_corpus(spark, root), _queries(spark, root), BOOSTS))
    return hits.select("query_id", "rank", "doc_id", F.round("score", 5).alias("score"))


@query("l12_index_search", f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, round(score, 5) AS score FROM hits WHERE rank <= 10")
def index_search(spark, root):
    """The same hits from the block-max index; languages share blocks."""
    hits = W.search(W.build_index(_corpus(spark, root, None, "lang"), BOOSTS, cluster=F.col("lang")), _queries(spark, root)).hits
    return hits.select("query_id", "rank", "doc_id", F.round("score", 5).alias("score"))


def _judged(spark, root, index, *hits):
    """Every labelled document that shares a term with the query, wherever it ranks, as far as nDCG reads it."""
    lab = I.load(spark, root, "labels").select("doc_id", (1 + F.col("quality") - F.col("toxic")).alias("rel"))
    return Z.judged_rows(index, lab, hits)


def _ndcg_sql(p="", judged="sc"):
    return f"""{p}jd AS (SELECT query_id, doc_id, 1 + quality - toxic AS rel FROM {judged} JOIN labels USING (doc_id)),
{p}idl AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM {p}jd) WHERE r <= 10 GROUP BY query_id),
{p}dcg AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM {p}hits JOIN {p}jd USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id),
{p}nd AS (SELECT query_id, coalesce(coalesce(dcg, 0) / nullif(ideal, 0), 0) AS ndcg FROM {p}idl LEFT JOIN {p}dcg USING (query_id))"""


@query("l13_ndcg", f"WITH {_bm25_sql()}, {_ndcg_sql()} SELECT query_id, round(ndcg, 6) AS ndcg FROM nd")
def ndcg(spark, root):
    index = Z.postings(_corpus(spark, root), _queries(spark, root), BOOSTS)
    hits = cut_lineage(Z.top_hits(Z.scores(index)))
    return rounded(Z.ndcg(hits, _judged(spark, root, index, hits)))


_HIDDEN = "hidden AS (SELECT doc_id, regexp_replace(text, '\\p{Lu}\\p{L}{4,}', '[NAME]', 'g') AS text FROM documents)"


@query("l20_utility_drop", f"WITH {_bm25_sql()}, {_ndcg_sql()}, {_HIDDEN}, {_bm25_sql('hidden', 'h')}, {_ndcg_sql('h', 'sc')}, a AS (SELECT (SELECT avg(ndcg) FROM nd) AS raw, (SELECT avg(ndcg) FROM hnd) AS redacted) SELECT round(raw, 6) AS raw, round(redacted, 6) AS redacted, round(raw - redacted, 6) AS utility_drop FROM a")
def utility_drop(spark, root):
    """Search quality on raw text against text with long capitalised words masked; the judgements are those of the raw text."""
    index = Z.postings(_corpus(spark, root), _queries(spark, root), BOOSTS)
    hits = cut_lineage(Z.top_hits(Z.scores(index)))
    masked = _corpus(spark, root, F.regexp_replace("text", r"\p{Lu}\p{L}{4,}", "[NAME]"))
    hidden = cut_lineage(Z.top_hits(Z.bm25(masked, _queries(spark, root), BOOSTS)))
    judged = cut_lineage(_judged(spark, root, index, hits, hidden))
    return rounded(Z.utility_drop(Z.ndcg(hits, judged), Z.ndcg(hidden, judged)))


# --- finance ----------------------------------------------------------------------------------------
def prices(spark, root):
    o = I.load(spark, root, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))


_PRICE = "pr AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL)"
_SMA = f"""{_PRICE}, sm AS (SELECT *, avg(price) OVER (PARTITION BY symbol ORDER BY day ROWS 9 PRECEDING) AS f, avg(price) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS s, price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM pr),
po AS (SELECT *, CASE WHEN f > s THEN 1 ELSE 0 END AS position FROM sm), sr AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY day), 0) * r AS sret FROM po)"""


@query("l14_sma_crossover", f"WITH {_SMA} SELECT symbol, count(*) AS days, sum(position) AS long_days, round(sum(sret), 4) AS total_return FROM sr GROUP BY symbol")
def sma_crossover(spark, root):
    out = Z.sma_crossover(prices(spark, root))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.sum("position").alias("long_days"), F.round(F.sum("strategy_return"), 4).alias("total_return"))


@query("l15_sharpe", f"WITH {_SMA} SELECT symbol, count(*) AS days, round(avg(sret) / stddev_samp(sret) * sqrt(252), 5) AS sharpe FROM sr WHERE sret IS NOT NULL GROUP BY symbol")
def sharpe(spark, root):
    return rounded(Z.sharpe(Z.sma_crossover(prices(spark, root))).select("symbol", "days", "sharpe"), 5)


@query("l16_momentum", f"""WITH {_PRICE}, d AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY day) AS m, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM pr),
x AS (SELECT symbol, 100 * sum(greatest(m, 0)) FILTER (r <= 14) / nullif(sum(abs(m)) FILTER (r <= 14), 0) AS rsi, list_reduce(list(price ORDER BY day), lambda a, b: a + (b - a) * CAST(2 AS DOUBLE) / 13) AS es, list_reduce(list(price ORDER BY day), lambda a, b: a + (b - a) * CAST(2 AS DOUBLE) / 27) AS el FROM d GROUP BY symbol)
SELECT symbol, round(es, 3) AS ema_short, round(el, 3) AS ema_long, round(es - el, 3) AS macd, round(rsi, 3) AS rsi FROM x""")
def momentum(spark, root):
    return rounded(Z.momentum(prices(spark, root)), 3)


@query("l17_extraction_f1", """WITH g AS (SELECT DISTINCT p_brand AS kind, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', 2) AS b, CAST(p_size AS VARCHAR) AS c FROM part WHERE p_retailprice > 950), p AS (SELECT DISTINCT p_brand AS kind, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', 2) AS b, CAST(p_size AS VARCHAR) AS c FROM part WHERE p_retailprice < 1700),
j AS (SELECT coalesce(g.kind, p.kind) AS kind, g.kind IS NOT NULL AS ig, p.kind IS NOT NULL AS ip FROM g FULL JOIN p ON g.kind = p.kind AND g.a = p.a AND g.b = p.b AND g.c = p.c), u AS (SELECT * FROM j UNION ALL SELECT 'overall', ig, ip FROM j)
SELECT kind, count(*) FILTER (ig) AS gold, count(*) FILTER (ip) AS pred, round(CAST(count(*) FILTER (ig AND ip) AS DOUBLE) / count(*) FILTER (ip), 6) AS precision, round(CAST(count(*) FILTER (ig AND ip) AS DOUBLE) / count(*) FILTER (ig), 6) AS recall, round(2e0 * count(*) FILTER (ig AND ip) / (count(*) FILTER (ig) + count(*) FILTER (ip)), 6) AS f1 FROM u GROUP BY kind""")
def extraction_f1(spark, root):
    t = F.split("p_type", " ")
    part = I.load(spark, root, "part").select(F.col("p_brand").alias("kind"), t[0].alias("a"), F.coalesce(F.get(t, F.lit(1)), F.lit("")).alias("b"), F.col("p_size").cast("string").alias("c"), "p_retailprice")
    return rounded(Z.triple_f1(part.filter("p_retailprice > 950"), part.filter("p_retailprice < 1700")))


@query("l18_test_pass_rate", "SELECT source AS skill, count(*) AS tests, round(avg(quality), 6) AS pass_rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def test_pass_rate(spark, root):
    rows = I.load(spark, root, "labels").join(I.load(spark, root, "documents").select("doc_id", F.col("source").alias("skill")), "doc_id")
    return rounded(B.pass_rate(rows.withColumn("passed", F.col("quality") == 1)))


_EM, _IP = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


@query("l19_robustness", f"""WITH t AS (SELECT lang AS grp, text FROM documents WHERE regexp_matches(text, '{_EM}|{_IP}')),
v AS (SELECT 'plain' AS variant, grp, text AS x FROM t UNION ALL SELECT 'upper', grp, upper(text) FROM t UNION ALL SELECT 'spaced', grp, replace(text, '@', ' @ ') FROM t UNION ALL SELECT 'masked_digits', grp, regexp_replace(text, '[0-9]', '#', 'g') FROM t),
p AS (SELECT variant, grp AS "group", count(*) AS n, CAST(count(*) FILTER (regexp_matches(x, '{_EM}|{_IP}')) AS DOUBLE) / count(*) AS recall FROM v GROUP BY ALL)
SELECT variant, "group", n, round(recall, 6) AS recall, round(max(recall) OVER (PARTITION BY variant) - min(recall) OVER (PARTITION BY variant), 6) AS group_gap FROM p""")
def robustness(spark, root):
    t = F.col("text")
    variants = {"plain": t, "upper": F.upper(t), "spaced": F.replace(t, F.lit("@"), F.lit(" @ ")), "masked_digits": F.regexp_replace(t, "[0-9]", "#")}
    detect = lambda c: c.rlike(f"{_EM}|{_IP}")
    return rounded(Z.robustness(I.documents(spark, root), "subject", variants, detect, detect(t)))


# --- runs with several measures --------------------------------------------------------------------
def measured(spark, root):
    e = I.load(spark, root, "events")
    share = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds)) / F.count(F.lit(1))
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("label")).agg(
        F.min(F.substring(F.col("user_id").cast("string"), 1, 1)).alias("project"), F.count_if(F.col("value") > 10).alias("step"),
        (F.count_if(F.col("value") > 15) / 4.0).alias("dev_volume"), share("view", "click", "error").alias("math_recall"), share("view", "click").alias("dev_recall"),
        share("view", "purchase", "signup").alias("test_recall"), share("click", "purchase", "error").alias("second_recall"), share("signup").alias("rare_recall"),
        share("error", "click").alias("test_f1"), share("purchase", "view").alias("dev_f1"), share("purchase").alias("protected_recall"), share("view").alias("seed_coverage"),
        share("click", "signup").alias("macro_f1"), share("error").alias("cost_share"))


def _sh(*kinds):
    return f"CAST(count(*) FILTER (event_type IN ({', '.join(repr(k) for k in kinds)})) AS DOUBLE) / count(*)"


MEASURED = f"""ms AS MATERIALIZED (SELECT 'u' || user_id AS label, min(substring(CAST(user_id AS VARCHAR), 1, 1)) AS project, count(*) FILTER (value > 10) AS step, count(*) FILTER (value > 15) / 4e0 AS dev_volume,
  {_sh('view', 'click', 'error')} AS math_recall, {_sh('view', 'click')} AS dev_recall, {_sh('view', 'purchase', 'signup')} AS test_recall, {_sh('click', 'purchase', 'error')} AS second_recall, {_sh('signup')} AS rare_recall,
  {_sh('error', 'click')} AS test_f1, {_sh('purchase', 'view')} AS dev_f1, {_sh('purchase')} AS protected_recall, {_sh('view')} AS seed_coverage, {_sh('click', 'signup')} AS macro_f1, {_sh('error')} AS cost_share FROM events GROUP BY user_id)"""
_INC = "'u7'"
_GUARD = f"""WITH {MEASURED}, gd AS (SELECT *, dev_volume <= 3 AS vg, (SELECT math_recall FROM ms WHERE label = {_INC}) - math_recall <= 1e-2 AS mg, least(test_recall, second_recall) AS fm FROM ms)"""


@query("p15_run_ranking", f"{_GUARD}, pool AS (SELECT * FROM gd WHERE (vg AND mg) OR NOT (SELECT bool_or(vg AND mg) FROM gd)) SELECT label, round(fm, 6) AS final_min_recall, label <> {_INC} AND fm - (SELECT fm FROM gd WHERE label = {_INC}) >= 2e-2 AS promoted FROM pool ORDER BY fm DESC, rare_recall DESC, dev_volume, test_f1 DESC, label LIMIT 1")
def run_ranking(spark, root):
    return rounded(Y.winner(Y.guard_runs(measured(spark, root), "u7"), "u7").select("label", "final_min_recall", "promoted"))


@query("p16_top_entries", f"{_GUARD} SELECT label, vg AND mg AS eligible FROM gd ORDER BY CAST(vg AND mg AS INT) DESC, dev_recall DESC, dev_volume, dev_f1 DESC, label LIMIT 5")
def top_entries(spark, root):
    return Y.top_by_dev(Y.guard_runs(measured(spark, root), "u7"), 5).select("label", "eligible")


@query("p17_best_checkpoint", f"WITH {MEASURED} SELECT project, step, round(macro_f1, 6) AS score FROM ms ORDER BY macro_f1 DESC, step DESC, label LIMIT 1")
def best_checkpoint(spark, root):
    return rounded(Y.best_checkpoint(measured(spark, root).withColumn("score", F.col("macro_f1"))).select("project", "step", "score"))


@query("p17_best_checkpoint_by_policy", f"WITH {MEASURED} SELECT label, round(protected_recall, 6) AS protected_redact_rate FROM ms ORDER BY protected_recall DESC, second_recall DESC, macro_f1 DESC, cost_share, step LIMIT 1")
def best_checkpoint_by_policy(spark, root):
    rows = measured(spark, root).select("label", "step", "macro_f1", F.col("protected_recall").alias("protected_redact_rate"),
                                        F.col("second_recall").alias("worst_context_redact_recall"), F.col("cost_share").alias("review_rate_error"))
    return rounded(Y.best_checkpoint_by_policy(rows).select("label", "protected_redact_rate"))


@query("p18_operating_point", f"WITH {MEASURED} SELECT label, round(second_recall, 6) AS worst_context_recall FROM ms ORDER BY second_recall DESC, test_f1 DESC, label LIMIT 1")
def operating_point(spark, root):
    rows = measured(spark, root).select("label", F.col("second_recall").alias("worst_context_recall"), F.col("test_f1").alias("f1"))
    return rounded(Y.operating_point(rows).select("label", "worst_context_recall"))


def _threshold_rows(spark, root):
    """Detector scores are event values over 100; a hit is a click or view."""
    from ..constants import DETECTOR_THRESHOLDS

    grid = F.explode(F.array(*[F.lit(t) for t in DETECTOR_THRESHOLDS]))
    e = I.load(spark, root, "events").select((F.col("value") / 100).alias("s"), F.col("event_type").isin("click", "view").alias("gold"))
    rows = e.select("s", "gold", grid.alias("threshold"))
    above = F.col("s") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if("gold").alias("g"), F.count_if(above).alias("p"), F.count_if(above & F.col("gold")).alias("tp"))
    return out.select("threshold", (F.col("p") / F.col("g")).alias("candidate_volume_multiplier"), (F.col("tp") / F.col("g")).alias("recall"),
                      F.try_divide(2 * F.col("tp"), F.col("g") + F.col("p")).alias("f1"))


_THR = "t AS (SELECT threshold, count(*) FILTER (g) AS g, count(*) FILTER (s >= threshold) AS p, count(*) FILTER (g AND s >= threshold) AS tp FROM (SELECT value / 100 AS s, event_type IN ('click', 'view') AS g FROM events), (VALUES (5e-2), (1e-1), (15e-2), (2e-1), (25e-2), (3e-1), (4e-1), (5e-1)) x(threshold) GROUP BY threshold), m AS (SELECT threshold, CAST(p AS DOUBLE) / g AS vol, CAST(tp AS DOUBLE) / g AS recall, 2e0 * tp / (g + p) AS f1 FROM t)"


@query("p19_threshold_sweep", f"WITH {_THR} SELECT threshold, round(vol, 6) AS candidate_volume_multiplier, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def threshold_sweep(spark, root):
    return rounded(_threshold_rows(spark, root))


@query("p19_threshold_choice", f"WITH {_THR} SELECT threshold, round(recall, 6) AS recall, vol <= 5e-1 AS eligible FROM m ORDER BY CAST(vol <= 5e-1 AS INT) DESC, recall DESC, vol, f1 DESC, threshold LIMIT 1")
def threshold_choice(spark, root):
    return rounded(Y.detector_sweep_choice(_threshold_rows(spark, root), 0.5).select("threshold", "recall", "eligible"))


@query("p20_run_comparison", f"WITH {MEASURED} SELECT label, round(macro_f1 - 3e-1, 6) AS gap, label = (SELECT label FROM ms ORDER BY macro_f1 DESC, label DESC LIMIT 1) AS is_best, (SELECT max(macro_f1) FROM ms) - 3e-1 >= 1e-1 AS recommended FROM ms")
def run_comparison(spark, root):
    return rounded(Y.compare_runs(measured(spark, root), 0.3).select("label", "gap", "is_best", "recommended"))


@query("p21_seed_confirmation", f"{_GUARD} SELECT project AS config, bool_and(vg AND mg) AS all_guards, round(avg(fm), 6) AS mean_min_recall, bool_and(vg AND mg) AND avg(fm) >= 42e-2 AS confirmed FROM gd GROUP BY project")
def seed_confirmation(spark, root):
    rows = Y.guard_runs(measured(spark, root), "u7").withColumn("config", F.col("project"))
    return rounded(Y.confirm_over_seeds(rows, 0.4))


@query("p22_adaptation_gate", f"WITH {MEASURED}, b AS (SELECT * FROM ms WHERE label = {_INC}), w AS (SELECT * FROM ms WHERE label <> {_INC} ORDER BY protected_recall DESC, math_recall DESC, dev_recall DESC, label LIMIT 1) SELECT w.label, round(w.protected_recall - b.protected_recall, 6) AS protected_gain, round(w.seed_coverage - b.seed_coverage, 6) AS seed_gain, round(b.math_recall - w.math_recall, 6) AS math_drop, w.protected_recall - b.protected_recall >= 5e-2 AND w.seed_coverage > b.seed_coverage AND b.math_recall - w.math_recall <= 1e-2 AS accepted FROM w, b")
def adaptation_gate(spark, root):
    return rounded(Y.adaptation_gate(measured(spark, root), "u7"))


@query("p23_dev_objective", f"WITH {MEASURED} SELECT label, round(second_recall - 5e-1 * rare_recall - 1e-1 * dev_volume / (SELECT max(dev_volume) FROM ms), 6) AS objective FROM ms")
def dev_objective(spark, root):
    rows = measured(spark, root).select("label", F.col("second_recall").alias("worst_context_redact_recall"), F.col("rare_recall").alias("orr"),
                                        F.col("dev_volume").alias("avg_cost"), F.lit(None).cast("double").alias("utility_drop"))
    return rounded(Y.dev_objective(rows, 0.5, 0.1).select("label", "objective"))


@query("p24_pareto_front", f"WITH {MEASURED} SELECT project, label FROM ms a WHERE NOT EXISTS (SELECT 1 FROM ms b WHERE b.project = a.project AND b.protected_recall >= a.protected_recall AND b.macro_f1 >= a.macro_f1 AND b.cost_share <= a.cost_share AND (b.protected_recall > a.protected_recall OR b.macro_f1 > a.macro_f1 OR b.cost_share < a.cost_share))")
def pareto_front(spark, root):
    rows = measured(spark, root).select("project", "label", "protected_recall", "macro_f1", "cost_share")
    return Y.pareto_front(rows, "project", ["protected_recall", "macro_f1"], ["cost_share"]).select("project", "label")


@query("a24_usage_stats", f"WITH {RUNS} SELECT kind, count(*) AS prediction_count, count(*) FILTER (metric > 20) AS repair_count, sum(CASE WHEN metric > 20 THEN 2 ELSE 1 END) AS attempt_count, coalesce(sum(k), 0) AS total_tokens, round(avg(metric), 6) AS latency_avg, round(quantile_cont(metric, 0.5), 6) AS latency_median, min(metric) AS latency_min, max(metric) AS latency_max FROM runs GROUP BY kind")
def usage_stats(spark, root):
    k = F.col("k").cast("long")
    rows = runs(spark, root).select("kind", (F.col("metric") > 20).alias("repair_used"), F.when(F.col("metric") > 20, 2).alias("attempt_count"), k.alias("prompt_tokens"),
                                    k.alias("completion_tokens"), k.alias("total_tokens"), k.alias("reasoning_tokens"), F.col("metric").alias("latency_ms"))
    return rounded(A.usage_stats(rows, ["kind"]).drop("prompt_tokens", "completion_tokens", "reasoning_tokens"))


def _suite(spark, root):
    m = measured(spark, root)
    return m.select("project", "label", F.when(F.col("rare_recall") > 0.2, "no_rules").otherwise("direct_id").alias("variant"), F.lit(0.10).alias("target_review_rate"),
                    F.when(F.col("dev_volume") > 2, "entropy").otherwise("margin").alias("strategy"), F.col("cost_share").alias("review_rate"), "macro_f1",
                    F.when(F.col("dev_recall") < 0.5, 1.0).otherwise(0.9).alias("legacy_redact_recall"))


_SUITE = f"{MEASURED}, su AS (SELECT project, CASE WHEN rare_recall > 2e-1 THEN 'no_rules' ELSE 'direct_id' END AS variant, CASE WHEN dev_volume > 2 THEN 'entropy' ELSE 'margin' END AS strategy, cost_share AS review_rate, macro_f1, dev_recall < 5e-1 AS ok FROM ms)"


@query("a25_seed_aggregate", f"WITH {_SUITE} SELECT variant, count(*) AS seeds, round(avg(macro_f1), 6) AS macro_f1_mean, round(coalesce(stddev_samp(macro_f1), 0), 6) AS macro_f1_stdev, round(avg(review_rate), 6) AS review_rate_mean, round(coalesce(stddev_samp(review_rate), 0), 6) AS review_rate_stdev FROM su GROUP BY variant")
def seed_aggregate(spark, root):
    return rounded(A.seed_aggregate(_suite(spark, root), ["variant"], ["macro_f1", "review_rate"]))


_STAB = "SELECT project, count(*) AS seed_count, count(DISTINCT strategy) AS strategy_count, avg(review_rate) AS review_rate_mean, coalesce(stddev_samp(review_rate), 0) AS review_rate_stdev, avg(macro_f1) AS macro_f1_mean, coalesce(stddev_samp(macro_f1), 0) AS macro_f1_stdev, bool_and(ok) AS all_recall_one FROM su WHERE variant = '{v}' GROUP BY project"


@query("a26_policy_stability", f"WITH {_SUITE}, st AS ({_STAB.format(v='no_rules')}) SELECT project, seed_count, strategy_count, round(review_rate_mean, 6) AS review_rate_mean, round(review_rate_stdev, 6) AS review_rate_stdev, round(macro_f1_mean, 6) AS macro_f1_mean, round(macro_f1_stdev, 6) AS macro_f1_stdev, all_recall_one FROM st")
def policy_stability(spark, root):
    return rounded(A.policy_stability(_suite(spark, root), ["project"]))


@query("a27_carry_forward_gate", f"WITH {_SUITE}, c AS ({_STAB.format(v='no_rules')}), b AS ({_STAB.format(v='direct_id')}), j AS (SELECT c.project, c.macro_f1_mean - b.macro_f1_mean AS d, c.strategy_count < b.strategy_count AS f, c.review_rate_stdev <= b.review_rate_stdev * 75e-2 OR c.review_rate_stdev <= 315e-4 AS s, c.all_recall_one AS a FROM c JOIN b USING (project)) SELECT project, round(d, 6) AS delta_macro_f1, f AS strategy_collapsed, s AS review_stdev_improved, d > 0 OR ((f OR s) AND d >= -5e-3 AND a) AS carry_forward FROM j")
def carry_forward_gate(spark, root):
    suite = _suite(spark, root)
    return rounded(A.carry_forward_gate(A.policy_stability(suite, ["project"]), A.policy_stability(suite, ["project"], "direct_id"), ["project"]))


# --- sources and sinks: tables written in the file shapes and read back --------------------------
@query("s1_jsonl_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def jsonl_round_trip(spark, root):
    path = f"{work_folder(spark, 'jsonl')}/rows"
    sinks.write_jsonl(I.load(spark, root, "conversations"), path)
    return readers.read_jsonl(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("s2_validated_candidates", f"SELECT CAST(doc_id AS VARCHAR) AS id, len(regexp_extract_all(text, '{I.TOKEN_PATTERN}')) AS n_tokens FROM documents")
def validated_candidates(spark, root):
    """The strict scan: a single faulty row would fail it."""
    path = f"{work_folder(spark, 'candidate')}/rows"
    df = I.tokenized(spark, root).select("id", "subject", "tokens", F.transform("tokens", lambda t: F.lit("O")).alias("labels"))
    sinks.write_jsonl(df, path)
    return readers.read_candidate(spark, path).select("id", F.size("tokens").cast("long").alias("n_tokens"))


@query("s9_jsonl_lines", "SELECT count(*) AS lines, 0 AS not_ascii, count(DISTINCT conv_id) AS conversations FROM conversations")
def jsonl_lines(spark, root):
    """Every row is one line of ASCII text."""
    path = f"{work_folder(spark, 'lines')}/rows"
    sinks.write_jsonl(I.load(spark, root, "conversations"), path)
    lines = spark.read.text(path)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").rlike(r"[^\x00-\x7F]")).alias("not_ascii"),
                     F.count_distinct(F.get_json_object("value", "$.conv_id")).alias("conversations"))


@query("s12_run_folders", """SELECT event_id, b || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS folder FROM (SELECT event_id, b, row_number() OVER (PARTITION BY b ORDER BY event_id) AS n FROM (
  SELECT event_id, strftime(date_trunc('hour', ts), '%Y%m%d_%H%M%S') || '_' || trim(regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM events))""")
def run_folders(spark, root):
    """A folder name for every run; runs that start together and have one name are numbered."""
    runs = I.load(spark, root, "events").select("event_id", "event_type", F.date_trunc("hour", "ts").alias("started"))
    return sinks.run_folder_names(runs, "event_id", "event_type").select("event_id", "folder")


@query("s4_ground_truth_scan", f"""WITH {TX.GROUND_TRUTH} SELECT id AS dialogue_id, id || '.ground_truth.json' AS source_file, length(t) AS chars, md5(t) AS digest, coalesce(n, 0) AS spans, coalesce(x, 0) AS span_chars
FROM tr LEFT JOIN (SELECT id, count(*) AS n, sum(length(txt)) AS x FROM mv GROUP BY id) USING (id)""")
def ground_truth_scan(spark, root):
    """One file for each conversation, written by the keyed sink and read as a folder of ground truth."""
    folder = work_folder(spark, "truth")
    base = TX.transcripts(spark, root, TX.WORD, speakers=False)
    body = F.to_json(F.struct(F.col("dialogue_id").alias("id"), "transcript", F.col("spans").alias("pii_occurrences")))
    keyed_files.write_keyed(base.select(F.concat("dialogue_id", F.lit(".ground_truth.json")).alias("name"), body.alias("content")), folder)
    return readers.read_ground_truth(spark, folder).select(
        "dialogue_id", "source_file", F.length("transcript").cast("long").alias("chars"), F.md5("transcript").alias("digest"),
        F.greatest(F.lit(0), F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("spans"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"])), F.lit(0)).alias("span_chars"))


@query("s15_run_summaries", """WITH f AS (SELECT event_type, value, event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_id AS folder, CASE WHEN user_id % 2 = 0 THEN 'sweep' ELSE 'single' END AS kind FROM events WHERE event_id % 20 = 0),
n AS (SELECT event_type, kind, max((folder, value)) AS m, count(*) AS runs FROM f GROUP BY ALL) SELECT event_type AS run_name, kind AS run_kind, m[1] AS folder, round(m[2] / 100, 6) AS macro_f1, runs FROM n""")
def run_summaries(spark, root):
    """Summaries of one event in twenty as run folders: the newest of each name and kind, its entry for one target, and the number of runs."""
    base = work_folder(spark, "summaries")
    ev = I.load(spark, root, "events").filter("event_id % 20 = 0")
    folder = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("event_id").cast("string"))
    entry = lambda rate, share: F.struct(F.lit(rate).alias("target_review_rate"), F.lit("composite").alias("strategy"), (F.col("value") / share).alias("macro_f1"))
    body = F.to_json(F.struct(F.col("event_type").alias("run_name"), F.when(F.col("user_id") % 2 == 0, "sweep").otherwise("single").alias("run_kind"),
                              F.array(entry(0.05, 200), entry(0.1, 100)).alias("selected_targets")))
    keyed_files.write_keyed(ev.select(F.concat(folder, F.lit("/summary.json")).alias("name"), body.alias("content")), base)
    found = cut_lineage(readers.read_summaries(spark, base))
    runs_of = found.groupBy("run_name", "run_kind").agg(F.count(F.lit(1)).alias("runs"))
    return readers.target_entry(readers.latest_summaries(found), 0.1).join(runs_of, ["run_name", "run_kind"]).select(
        "run_name", "run_kind", F.element_at(F.split("path", "/"), -2).alias("folder"), F.round("macro_f1", 6).alias("macro_f1"), "runs")


@query("j7_full_outer_counts", "WITH o AS (SELECT lang || ':' || source AS label, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1), w AS (SELECT lang || ':' || source AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) SELECT label, coalesce(o.n, 0) AS old, coalesce(w.n, 0) AS new, coalesce(w.n, 0) - coalesce(o.n, 0) AS delta, CASE WHEN w.n IS NULL THEN 'removed' WHEN o.n IS NULL THEN 'added' ELSE 'both' END AS status FROM o FULL JOIN w USING (label)")
def full_outer_counts(spark, root):
    """Groups of unlabelled documents against groups of toxic ones; each side has groups that the other lacks."""
    from ..operators import quality as Q

    docs = I.load(spark, root, "documents").select("doc_id", F.concat("lang", F.lit(":"), "source").alias("label"))
    labels = I.load(spark, root, "labels").select("doc_id", "toxic")
    count = lambda df: df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return Q.count_drift(count(docs.join(labels, "doc_id", "left_anti")), count(docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi")))


def _sessions(spark, root, turn):
    rows = I.load(spark, root, "conversations").select("conv_id", "turn", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts"))


@query("s5_annotated_sessions", "SELECT 's' || conv_id AS session_id, CAST(turn AS BIGINT) AS turn_index, role AS speaker_role, length(text) AS chars FROM conversations")
def annotated_sessions(spark, root):
    """Turns are stored unordered; the reader sorts them by sequence id."""
    turn = F.struct(F.lit("x").alias("_id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").cast("int").alias("sequence_id"))
    path = f"{work_folder(spark, 'sessions')}/rows"
    sinks.write_jsonl(_sessions(spark, root, turn).select(F.lit("volunteer").alias("leadRole"), F.reverse("ts").alias("transcript")), path)
    return readers.read_sessions(spark, path).select("session_id", F.col("turn_index").cast("long").alias("turn_index"), "speaker_role", F.length("text").cast("long").alias("chars"))


@query("s6_anonymized_sessions", "SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN bool_or(role = 'system') THEN 'english' WHEN count(*) > 4 THEN 'social_studies' END AS subject, count(*) AS turns FROM conversations GROUP BY conv_id) WHERE subject IS NOT NULL")
def anonymized_sessions(spark, root):
    """Short sessions get a topic outside the two known ones and are skipped by the reader."""
    turn = F.struct("turn", F.col("text").alias("message"), F.lit("text").alias("message_type"), F.col("role").alias("user_role"), F.lit(1.0).alias("timestamp_seconds"))
    topic = F.when(F.exists("ts", lambda t: t["user_role"] == "system"), "readingWriting").when(F.size("ts") > 4, "socialStudies").otherwise("math")
    path = f"{work_folder(spark, 'anon')}/rows"
    sinks.write_jsonl(_sessions(spark, root, turn).select(F.col("conv_id").cast("string").alias("session_id"), topic.alias("topic_name"), F.lit("x").alias("subject_name"), F.array_sort("ts").alias("anonymized_transcript")), path)
    return readers.read_anonymized_sessions(spark, path).groupBy("session_id", "subject").agg(F.count(F.lit(1)).alias("turns"))


@query("s7_lesson_turns", "SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index, CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'teacher' ELSE 'observer' END AS speaker_role, " + I.collapse_sql("text") + " AS text FROM conversations")
def lesson_turns(spark, root):
    """Conversations as lesson files with form noise between the lines."""
    tag = F.when(F.col("role") == "user", "SN").when(F.col("role") == "assistant", "T").otherwise("O")
    line = F.concat(F.lit("00:00:01\t"), tag, F.lit("\t "), F.regexp_replace("text", "\n", " "), F.lit("﻿\r\nTop of Form"))
    rows = _sessions(spark, root, F.struct("turn", line.alias("l")))
    files = rows.select(F.col("conv_id").cast("string").alias("dialogue_id"), F.array_join(F.transform(F.array_sort("ts"), lambda x: x["l"]), "\n").alias("text"))
    return readers.lesson_turns(files).select("dialogue_id", F.col("turn_index").cast("long").alias("turn_index"), "speaker_role", "text")


@query("s8_content_hash_copies", "SELECT text_hash, copies, first_id FROM (SELECT sha1(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE copies > 1")
def content_hash_copies(spark, root):
    docs = I.load(spark, root, "documents").select("doc_id", F.sha1("text").alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("s10_json_summary", "SELECT '{\"lang\":\"' || lang || '\",\"rows\":' || count(*) || '}' AS summary FROM documents GROUP BY lang")
def json_summary(spark, root):
    return sinks.summary_json(I.load(spark, root, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))


@query("s11_run_ledger", "SELECT 'c' || c_mktsegment AS commit, 'action' AS stage, CAST(count(*) AS VARCHAR) AS primary_metric, 'keep' AS status, 'rows of ' || c_mktsegment AS description FROM customer GROUP BY c_mktsegment")
def run_ledger(spark, root):
    path = f"{work_folder(spark, 'ledger')}/results"
    seg = F.col("c_mktsegment")
    counts = I.load(spark, root, "customer").groupBy(seg).agg(F.count(F.lit(1)).cast("string").alias("primary_metric"))
    sinks.append_ledger(counts.select(F.concat(F.lit("c"), seg).alias("commit"), F.lit("action").alias("stage"), "primary_metric", F.lit("keep").alias("status"), F.concat(F.lit("rows of "), seg).alias("description")), path)
    return sinks.read_ledger(spark, path)


@query("s12_run_slugs", "SELECT doc_id, CASE WHEN s = '' THEN 'experiment' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)")
def run_slugs(spark, root):
    return I.load_text(spark, root, "documents", "doc_id", "text").select("doc_id", sinks.slug(F.col("text")).alias("slug"))


@query("s13_markdown_rows", "SELECT 0 AS part, '| lang | rows |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 2, '| ' || lang || ' | ' || count(*) || ' |' FROM documents GROUP BY lang")
def markdown_rows(spark, root):
    return sinks.markdown_rows(I.load(spark, root, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), ["lang", "rows"])


