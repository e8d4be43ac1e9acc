"""Splits, quotas, selections and redaction (N1-N18, R9-R17, X1-X8, U1-U3) over whole tables."""

import regex
from pyspark.sql import functions as F

from ..constants import CHALLENGE_MINIMUMS, FAKE_VALUES, SURROGATE_FORMATS
from ..functions import rules as R
from ..functions import tokens as T
from ..operators import cascade as K
from ..operators import quality as Q
from ..operators import redaction as X
from ..operators import sampling as N
from ..operators import scoring as U
from ..operators import spans as S
from ..session import cut_lineage
from . import decisions as D
from . import inputs as I
from .decisions import _with_span
from .quality_checks import responses
from .registry import query
from .transcripts import action_rows, baseline_turns


def _customers(spark, root):
    return I.load(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("dialogue_id"), F.col("c_mktsegment").alias("subject"))


_C = "c AS (SELECT CAST(c_custkey AS VARCHAR) AS dialogue_id, c_mktsegment AS subject, sha1('17:' || c_custkey) AS h FROM customer)"


@query("n1_ratio_split", f"WITH {_C} SELECT dialogue_id, CASE WHEN r <= floor(n * 7e-1) THEN 'train' WHEN r <= floor(n * 7e-1) + floor(n * 15e-2) THEN 'dev' ELSE 'test' END AS split FROM (SELECT dialogue_id, row_number() OVER (ORDER BY h, dialogue_id) AS r, count(*) OVER () AS n FROM c)")
def ratio_split(spark, root):
    return N.ratio_split(_customers(spark, root), "dialogue_id", 17, 0.7, 0.15)


@query("n2_halves_by_hash", f"WITH {_C} SELECT subject, dialogue_id, CASE WHEN r <= n // 2 THEN 'dev' ELSE 'test' END AS split FROM (SELECT subject, dialogue_id, row_number() OVER (PARTITION BY subject ORDER BY h, dialogue_id) AS r, count(*) OVER (PARTITION BY subject) AS n FROM c)")
def halves_by_hash(spark, root):
    return N.halves(_customers(spark, root), "dialogue_id", "subject", 17)


@query("n3_negative_downsampling", "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'P' AS pos FROM orders), lim AS (SELECT CAST(floor(count(*) FILTER (pos) * 5e-1) AS BIGINT) AS k FROM o) SELECT id, pos AS positive FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY sha1('17:' || id), id) AS r FROM o), lim WHERE pos OR r <= k")
def negative_downsampling(spark, root):
    rows = I.load(spark, root, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") == "P").alias("positive"))
    return N.downsample_negatives(rows, "id", F.col("positive"), 0.5, 17)


_CNT = "n AS (SELECT o_orderstatus AS g, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY ALL)"


@query("n4_largest_remainder_quotas", f"WITH {_CNT}, r AS (SELECT *, n / sum(n) OVER (PARTITION BY g) * 33 AS raw FROM n), b AS (SELECT *, floor(raw) AS base, row_number() OVER (PARTITION BY g ORDER BY raw - floor(raw) DESC, name) AS k, 33 - sum(floor(raw)) OVER (PARTITION BY g) AS extra FROM r) SELECT g, name, n, CAST(base + CASE WHEN k <= extra THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b")
def largest_remainder_quotas(spark, root):
    counts = I.load(spark, root, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return N.largest_remainder(counts, ["g"], "name", 33)


@query("n5_even_quotas", "SELECT name, CAST(103 // k + CASE WHEN i <= 103 % k THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT name, row_number() OVER (ORDER BY name) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT c_mktsegment AS name FROM customer))")
def even_quotas(spark, root):
    return N.even_quotas(I.load(spark, root, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), "name", 103)


@query("n6_weighted_quotas", "WITH t AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1), s(split, w, pos) AS (VALUES ('train', 690, 0), ('dev', 160, 1), ('test', 150, 2)), f AS (SELECT label, split, pos, n * w // 1000 AS base, n - sum(n * w // 1000) OVER (PARTITION BY label) AS extra FROM t, s) SELECT label, split, CAST(base + CASE WHEN pos < extra THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def weighted_quotas(spark, root):
    totals = I.load(spark, root, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return N.weighted_quotas(totals, "label", {"train": 690, "dev": 160, "test": 150})


@query("n7_session_capped_top", "SELECT id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, o_totalprice AS p, o_orderkey AS k FROM orders) WHERE r <= 2 ORDER BY p DESC, k LIMIT 500")
def session_capped_top(spark, root):
    orders = I.load(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return N.capped_top(orders, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 500).select(F.col("o_orderkey").cast("string").alias("id"))


@query("n13_source_caps", "WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS source FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2') UNION ALL SELECT id, source FROM (SELECT CAST(doc_id AS VARCHAR) AS id, source, row_number() OVER (PARTITION BY source ORDER BY sha1(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS r FROM documents WHERE source IN ('src1', 'src2')) WHERE r <= CASE source WHEN 'src1' THEN 10 ELSE 5 END")
def source_caps(spark, root):
    """Every eleventh source is unknown: such rows have no cap."""
    docs = I.load(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("source"))
    return N.source_caps(docs, "source", {"src1": 10, "src2": 5, "src3": -1})


@query("n17_output_order", "SELECT row_number() OVER (ORDER BY c_mktsegment, sha1('17:' || c_custkey), CAST(c_custkey AS VARCHAR)) AS position, CAST(c_custkey AS VARCHAR) AS dialogue_id FROM customer")
def output_order(spark, root):
    from ..functions.text import stable_hash
    from ..plans.scaled import hash_block, ranked

    rows = _customers(spark, root).withColumn("h", stable_hash(F.col("dialogue_id"), 17))
    chunk = F.concat(F.rpad("subject", 20, " "), hash_block(F.col("h")))
    return ranked(rows, [], [F.col("subject"), F.col("h"), F.col("dialogue_id")], chunk, "position").select("position", "dialogue_id")


@query("n18_mix_composition", "SELECT source, count(*) AS n FROM (SELECT 'base' AS source, 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'added', 's' || s_suppkey FROM supplier) GROUP BY source")
def mix_composition(spark, root):
    base = I.load(spark, root, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("base").alias("source"))
    added = I.load(spark, root, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("added").alias("source"))
    return Q.union_unique(base, added).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- items -----------------------------------------------------------------------------------
def items(spark, root):
    rows = action_rows(spark, root)
    per_turn = rows.groupBy("dialogue_id", "turn_index").agg(F.count(F.lit(1)).alias("tag_count"))
    return rows.join(per_turn, ["dialogue_id", "turn_index"]).select(
        "id", F.col("dialogue_id").alias("session_id"), "subject", "speaker_role", "turn_index", "turn_text", "context_text",
        F.coalesce("anchor_text", F.lit("")).alias("anchor_text"), F.substring("context_text", F.col("tag_start") + 1, F.col("tag_end")).alias("span_text"),
        "entity_type", "tag_count")


_ITEMS = f"""WITH {I.TAGGED_SQL}, keyed AS (SELECT dialogue_id || '-turn-' || turn_index AS k, * FROM tagged), {I._matches('tg', '<[A-Z_]+>', 'keyed', 'k')},
it AS MATERIALIZED (SELECT k || '-tag-' || s AS id, dialogue_id AS session_id, subject, speaker_role, turn_index, text AS turn_text, substring(text, 1, e) AS context_text, txt AS span_text, substring(txt, 2, length(txt) - 2) AS entity_type,
  count(*) OVER (PARTITION BY k) AS tag_count FROM tg_chars JOIN keyed ON k = tg_chars.id WHERE txt IN ({', '.join(f"'<{t}>'" for t in S.SUPPORTED_TAGS)}))"""
_CHAL = "CASE WHEN entity_type IN ('PERSON', 'LOCATION', 'NRP') THEN 3 ELSE 0 END + CASE WHEN tag_count >= 2 THEN 1 ELSE 0 END + CASE WHEN speaker_role = 'student' THEN 1 ELSE 0 END"


@query("r9_challenge_scores", f"{_ITEMS} SELECT id, CAST({_CHAL} AS BIGINT) AS challenge FROM it")
def challenge_scores(spark, root):
    return N.score_items(items(spark, root)).select("id", F.col("challenge").cast("long").alias("challenge"))


_CUE = "regexp_matches(turn_text, '(?i)\\b(text|email|call)\\b')"


@query("r10_private_prior_v1", f"{_ITEMS} SELECT id, CAST(CASE WHEN {_CUE} THEN 1 ELSE 0 END + CASE WHEN entity_type = 'PHONE_NUMBER' THEN 1 ELSE 0 END AS BIGINT) AS private_prior FROM it")
def private_prior_v1(spark, root):
    return N.score_items(items(spark, root), 1).select("id", F.col("private_prior").cast("long").alias("private_prior"))


# A tag is its own span text, so what stands around a quoted span can be said without looking around.
_W = r"[\p{L}\p{N}_]"
_SCORED = f"""{_ITEMS}, cu AS (SELECT *, concat_ws(' ', turn_text, context_text, turn_text) AS txt, subject = 'english' AND entity_type = 'PERSON' AS pe FROM it),
cv AS (SELECT *, regexp_matches(txt, '(?i)\\b(hi|hello|hey)\\s+<PERSON>{_W}') AS g, regexp_matches(txt, '(?i)\\b(my name is|i am|i''m|im)\\s+<PERSON>{_W}') AS sf,
  regexp_matches(turn_text, ',\\s*<PERSON>{_W}') OR regexp_matches(turn_text, '{_W}<PERSON>\\s*[,!?:]') AS ad,
  CASE WHEN entity_type IN ('SCHOOL', 'LOCATION') AND regexp_matches(txt, '(?i)\\b(my school|i go to|i live in|i''m from|im from|i am from)\\b') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(txt, '(?i)\\b(text|email|call)\\b') THEN 1 ELSE 0 END + CASE WHEN entity_type = 'PHONE_NUMBER' THEN 1 ELSE 0 END AS cue FROM cu),
cw AS (SELECT *, CASE WHEN pe AND (g OR sf OR ad) THEN CASE WHEN g THEN 5 ELSE 0 END + CASE WHEN sf THEN 5 ELSE 0 END + CASE WHEN ad THEN 2 ELSE 0 END + CASE WHEN turn_index < 5 THEN 1 ELSE 0 END ELSE 0 END AS person_private FROM cv),
sc AS MATERIALIZED (SELECT *, CAST(person_private + cue AS BIGINT) AS private_prior, {_CHAL} AS challenge, sha1('17:' || id) AS h FROM cw)"""


@query("r11_private_prior_v2", f"{_SCORED} SELECT id, private_prior, CAST(person_private AS BIGINT) AS person_private FROM sc")
def private_prior_v2(spark, root):
    return N.score_items(items(spark, root)).select("id", F.col("private_prior").cast("long").alias("private_prior"),
                                                    F.col("person_private").cast("long").alias("person_private"))


# Cues as whole words by the Unicode reading of a word; "world war" and "civil war" count once, by their "war".
_UNICODE_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]+"
_WORDS = f"regexp_extract_all(concat_ws(' ', turn_text, context_text, '', turn_text), '{_UNICODE_WORD}')"
_ENGLISH_CUES = "essay|author|character|novel|story|poem|book|passage|article|quote|speaker|paragraph|chapter|text"
_SOCIAL_CUES = "war|treaty|empire|colony|president|king|queen|nation|state|history|revolution|conference|government|foreign"


@query("r12_curricular_bonus", f"""{_ITEMS}, wd AS (SELECT id, subject, unnest({_WORDS}) AS w FROM it),
cn AS (SELECT id, count(*) AS n FROM wd WHERE CASE subject WHEN 'english' THEN regexp_full_match(w, '{_ENGLISH_CUES}', 'i') WHEN 'social_studies' THEN regexp_full_match(w, '{_SOCIAL_CUES}', 'i') ELSE false END GROUP BY id)
SELECT it.id, CAST(least(2, coalesce(n, 0)) AS INT) AS bonus FROM it LEFT JOIN cn ON cn.id = it.id""")
def curricular_bonus(spark, root):
    return N.score_items(items(spark, root)).select("id", F.col("bonus").cast("int").alias("bonus"))


@query("r14_pilot_suggestions", f"{_ITEMS} SELECT subject, entity_type, CASE WHEN entity_type = 'PHONE_NUMBER' THEN 'REDACT' WHEN subject = 'social_studies' AND entity_type IN ('PERSON', 'LOCATION', 'NRP') THEN 'KEEP' WHEN subject = 'english' AND entity_type = 'COURSE' THEN 'KEEP' ELSE 'REVIEW' END AS suggested, count(*) AS n FROM it GROUP BY ALL")
def pilot_suggestions(spark, root):
    df = items(spark, root)
    return df.groupBy("subject", "entity_type", R.pilot_suggestion(F.col("subject"), F.col("entity_type")).alias("suggested")).agg(F.count(F.lit(1)).alias("n"))


@query("r15_oversize_reasons", f"""{_ITEMS}, tc AS (SELECT k, subject, text, coalesce(c, 0) AS c FROM keyed LEFT JOIN (SELECT id, count(*) AS c FROM tg_chars WHERE txt IN ({', '.join(f"'<{t}>'" for t in S.SUPPORTED_TAGS)}) GROUP BY id) x ON x.id = k)
SELECT subject, reason, count(*) AS n FROM (SELECT subject, 'qualifying_tag_count' AS reason FROM tc WHERE c > 20 UNION ALL SELECT subject, 'turn_word_count' FROM tc WHERE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) > 350) GROUP BY ALL""")
def oversize_reasons(spark, root):
    return N.oversize_report(I.tagged_turns(spark, root).withColumn("tag_count", F.size(S.tag_spans("text"))))


_MARK = "die|und|les"


@query("r16_session_exclusion", f"{_ITEMS} SELECT subject, count(*) AS n FROM it WHERE NOT (subject = 'english' AND session_id IN (SELECT session_id FROM it WHERE subject = 'english' AND len(list_filter(regexp_extract_all(turn_text, '{_UNICODE_WORD}'), lambda w: regexp_full_match(w, '{_MARK}', 'i'))) > 0)) GROUP BY subject")
def session_exclusion(spark, root):
    out = N.exclude_languages(items(spark, root), R.any_word(("die", "und", "les")), None)
    return out.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("r17_script_exclusion", f"{_ITEMS} SELECT subject, count(*) AS n FROM it WHERE NOT (subject = 'english' AND regexp_matches(turn_text, '[éè]')) GROUP BY subject")
def script_exclusion(spark, root):
    out = N.exclude_languages(items(spark, root), r"(?!)", "[éè]")
    return out.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def _selected(spark, root, kind, version):
    scored = N.score_items(items(spark, root), 1 if version == "v1" else 2)
    if kind == "natural":
        return N.select_natural(scored, 60, 2, 17, version, reserve=10, person_reserve=4)
    return N.select_challenge(scored, 60, 2, 17, version=version)


_FREE = "NOT list_contains(st.used, q.id) AND len(list_filter(st.sess, lambda x: x = q.session_id)) < 2"


def _challenge_sql(minimums):
    """One pick a step: the first free row of the first phase whose quota is open (1-3 minimums, 8 hardest first, 9 by hash)."""
    quota = {s: [*q.values(), 0, 0, 0][:3] for s, q in minimums.items()}
    phases = [f"SELECT *, {i + 1} AS ph FROM ho WHERE subject = '{s}' AND entity_type = '{k}'" for s, q in minimums.items() for i, k in enumerate(q)]
    grow = ", ".join(f"got[{i}] + CAST(ph = {i} AS INT)" for i in (1, 2, 3))
    quotas = "CASE subject " + " ".join(f"WHEN '{s}' THEN {q}" for s, q in quota.items()) + " ELSE [0, 0, 0] END" if quota else "[0, 0, 0]"
    return f"""{_SCORED.replace('WITH', 'WITH RECURSIVE', 1)},
ho AS MATERIALIZED (SELECT subject, id, session_id, entity_type, row_number() OVER (PARTITION BY subject ORDER BY challenge DESC, CASE WHEN entity_type IN ('PERSON', 'LOCATION', 'NRP') THEN 0 ELSE 1 END, h, id) AS rk,
  row_number() OVER (PARTITION BY subject ORDER BY h, id) AS hk FROM sc WHERE entity_type IN ('PERSON', 'LOCATION', 'NRP', 'SCHOOL', 'COURSE')),
q AS MATERIALIZED (SELECT subject, id, session_id, ph, rk FROM ({' UNION ALL '.join([*phases, 'SELECT *, 8 AS ph FROM ho'])}) UNION ALL SELECT subject, id, session_id, 9, hk FROM ho),
st(subject, n, got, used, sess, id, qu) AS (SELECT DISTINCT subject, 0, [0, 0, 0], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '', {quotas} FROM ho
  UNION ALL SELECT subject, n + 1, [{grow}], list_append(used, pid), list_append(sess, ps), pid, qu FROM (
    SELECT st.subject, st.n, st.got, st.used, st.sess, st.qu, q.id AS pid, q.session_id AS ps, q.ph, row_number() OVER (PARTITION BY st.subject ORDER BY q.ph, q.rk) AS r
    FROM st JOIN q ON q.subject = st.subject WHERE st.n < 60 AND {_FREE} AND (q.ph > 3 OR st.got[q.ph] < st.qu[q.ph])
      AND (q.ph <> 8 OR (st.got[1] >= st.qu[1] AND st.got[2] >= st.qu[2] AND st.got[3] >= st.qu[3]))) WHERE r = 1)
SELECT subject, id, CAST(n AS BIGINT) AS pick FROM st WHERE n > 0"""


def _natural_sql(version):
    """First the reserves, then rounds by type with the fill behind them, each a pick a step."""
    above = {"pilot": None, "v1": 1, "v2": 0}[version]
    prior = "CAST(CASE WHEN txt_cue THEN 1 ELSE 0 END + CASE WHEN entity_type = 'PHONE_NUMBER' THEN 1 ELSE 0 END AS BIGINT)" if version == "v1" else "private_prior"
    phases = []
    if version == "v2":
        phases.append("SELECT subject, id, session_id, 1 AS ph, row_number() OVER (PARTITION BY subject ORDER BY person_private DESC, h, id) AS rk FROM ba WHERE subject = 'english' AND person_private > 0")
    if above is not None:
        phases.append(f"SELECT subject, id, session_id, 2 AS ph, row_number() OVER (PARTITION BY subject ORDER BY prior DESC, h, id) AS rk FROM ba WHERE prior > {above}")
        phases.append("SELECT subject, id, session_id, 3 AS ph, row_number() OVER (PARTITION BY subject ORDER BY h, id) AS rk FROM ba WHERE entity_type = 'PHONE_NUMBER'")
    reserve = " UNION ALL ".join(phases) or "SELECT subject, id, session_id, 1 AS ph, 0 AS rk FROM ba WHERE false"
    control = "kind = 'PHONE_NUMBER'" if version == "pilot" else "false"
    step = lambda old, v: f"list_transform({old}, lambda x, i: CASE WHEN i = j THEN {v} ELSE x END)"
    return f"""{_SCORED.replace('WITH', 'WITH RECURSIVE', 1)}, ba AS MATERIALIZED (SELECT *, {prior} AS prior FROM (SELECT *, {_CUE} AS txt_cue FROM sc)),
q AS MATERIALIZED ({reserve}),
st(subject, n, g, used, sess, id) AS (SELECT DISTINCT subject, 0, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '' FROM ba
  UNION ALL SELECT subject, n + 1, g + CAST(ph = 1 AS INT), list_append(used, pid), list_append(sess, ps), pid FROM (
    SELECT st.subject, st.n, st.g, st.used, st.sess, q.id AS pid, q.session_id AS ps, q.ph, row_number() OVER (PARTITION BY st.subject ORDER BY q.ph, q.rk) AS r
    FROM st JOIN q ON q.subject = st.subject WHERE {_FREE} AND CASE WHEN q.ph = 1 THEN st.g < 4 ELSE st.n < 10 END) WHERE r = 1),
fin AS MATERIALIZED (SELECT subject, n, used, sess FROM st QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC) = 1),
sup AS (SELECT ba.subject, entity_type AS kind, count(*) FILTER (NOT list_contains(used, ba.id)) AS s, any_value(60 - n) AS free FROM ba JOIN fin ON fin.subject = ba.subject GROUP BY ba.subject, entity_type),
sup2 AS (SELECT *, {control} AS one FROM sup WHERE s > 0),
shr AS (SELECT subject, kind, s, (CAST(s AS DOUBLE) / sum(s) OVER w) * left_ AS raw, left_ FROM (SELECT *, free - count(*) FILTER (one) OVER (PARTITION BY subject) AS left_ FROM sup2) WHERE NOT one WINDOW w AS (PARTITION BY subject)),
tgt AS (SELECT subject, kind, s, CAST(floor(raw) AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY subject ORDER BY floor(raw) - raw, kind) <= left_ - sum(CAST(floor(raw) AS BIGINT)) OVER (PARTITION BY subject) THEN 1 ELSE 0 END AS t FROM shr
  UNION ALL SELECT subject, kind, s, 1 FROM sup2 WHERE one),
tl AS MATERIALIZED (SELECT subject, list(kind ORDER BY kind) AS kl, list(t ORDER BY kind) AS tt, list(s ORDER BY kind) AS ss, list(CAST(0 AS BIGINT) ORDER BY kind) AS zero FROM tgt GROUP BY subject),
q2 AS MATERIALIZED (SELECT ba.subject, ba.id, ba.session_id, list_position(kl, entity_type) AS j, row_number() OVER (PARTITION BY ba.subject ORDER BY h, ba.id) AS hk FROM ba JOIN tl ON tl.subject = ba.subject),
s2(subject, n, used, sess, have, started, vis, id) AS (SELECT fin.subject, n, used, sess, zero, zero, zero, '' FROM fin JOIN tl ON tl.subject = fin.subject
  UNION ALL SELECT subject, n + 1, list_append(used, pid), list_append(sess, ps), CASE WHEN grp < 2 THEN {step('have', 'x + 1')} ELSE have END, CASE WHEN grp = 1 THEN have ELSE started END,
    CASE WHEN grp = 1 THEN {step('zero', '1')} WHEN grp = 0 THEN {step('vis', '1')} ELSE vis END, pid FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY grp, CASE grp WHEN 0 THEN started[j] - tt[j] WHEN 1 THEN have[j] - tt[j] ELSE 0 END, CASE WHEN grp < 2 THEN -ss[j] ELSE 0 END, CASE WHEN grp < 2 THEN j ELSE 0 END, hk) AS r FROM (
      SELECT st.subject, st.n, st.used, st.sess, st.have, st.started, st.vis, tl.tt, tl.ss, tl.zero, q.id AS pid, q.session_id AS ps, q.j, q.hk,
        CASE WHEN q.j IS NULL OR st.have[q.j] >= tl.tt[q.j] THEN 2 ELSE st.vis[q.j] END AS grp
      FROM s2 st JOIN tl ON tl.subject = st.subject JOIN q2 q ON q.subject = st.subject WHERE st.n < 60 AND {_FREE})) WHERE r = 1)
SELECT subject, id, CAST(n AS BIGINT) AS pick FROM st WHERE id <> '' UNION ALL SELECT subject, id, CAST(n AS BIGINT) FROM s2 WHERE id <> ''"""


@query("n9_natural_selection_pilot", _natural_sql("pilot"))
def natural_selection_pilot(spark, root):
    return _selected(spark, root, "natural", "pilot")


@query("n10_natural_selection_v1", _natural_sql("v1"))
def natural_selection_v1(spark, root):
    return _selected(spark, root, "natural", "v1")


@query("n11_natural_selection_v2", _natural_sql("v2"))
def natural_selection_v2(spark, root):
    return _selected(spark, root, "natural", "v2")


@query("n8_challenge_selection_v1", _challenge_sql({}))
def challenge_selection_v1(spark, root):
    return _selected(spark, root, "challenge", "v1")


@query("n8_challenge_selection_v2", _challenge_sql(CHALLENGE_MINIMUMS))
def challenge_selection_v2(spark, root):
    return _selected(spark, root, "challenge", "v2")


@query("n7_challenge_selection_pilot", f"{_ITEMS}, o AS (SELECT *, {_CHAL} AS c, CASE WHEN entity_type IN ('PERSON', 'LOCATION', 'NRP') THEN 0 ELSE 1 END AS a, sha1('17:' || id) AS h FROM it WHERE entity_type IN ('PERSON', 'LOCATION', 'NRP', 'SCHOOL', 'COURSE')), k AS (SELECT *, row_number() OVER (PARTITION BY subject, session_id ORDER BY c DESC, a, h, id) AS r FROM o), p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY c DESC, a, h, id) AS pick FROM k WHERE r <= 2) SELECT subject, id, pick FROM p WHERE pick <= 60")
def challenge_selection_pilot(spark, root):
    return _selected(spark, root, "challenge", "pilot")


@query("n14_span_pool")
def span_pool(spark, root):
    cand = I.candidates(spark, root).select("id", "subject", "tokens", "gold_labels", "pred_labels")
    legacy = I.documents(spark, root).select(F.col("id").alias("source_row_id"), F.regexp_extract("text", r"\p{Lu}\p{L}+", 0).alias("span_text"), F.lit(1).alias("ord"))
    return N.span_pool(cand, legacy).groupBy("pool_source", "suggested_action").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))


def _n15_sql():
    """The walk as a recursive query, one dialogue a step; lists hold a number for dev, test and train."""
    def place(i):
        gap = lambda k: f"greatest(goal.g[{k + 1}][{i}] - st.s[{k + 1}][{i}], 0)"
        rare = " + ".join(f"CASE WHEN rk.b & {1 << k} > 0 THEN {gap(k + 1)} ELSE 0 END" for k in range(3))
        return f"{{'f': st.c[{i}] / CAST(tg.t[{i}] AS DOUBLE), 'r': -({rare}), 'p': CASE WHEN rk.p THEN -{gap(0)} ELSE 0 END, 'c': st.c[{i}], 'i': {i}, 'o': st.c[{i}] < tg.t[{i}]}}"

    add = lambda old, cond: f"[{', '.join(f'{old}[{i}] + CAST(x = {i} AND {cond} AS INT)' for i in (1, 2, 3))}]"
    states = ", ".join([add("s[1]", "p"), *[add(f"s[{k + 2}]", f"b & {1 << k} > 0") for k in range(3)]])
    return f"""{_ITEMS.replace('WITH', 'WITH RECURSIVE', 1)}, d AS (SELECT dialogue_id, coalesce(w, 0) AS w, coalesce(b, 0) AS b, p IS NOT NULL AS p FROM (SELECT DISTINCT dialogue_id FROM tagged) LEFT JOIN
  (SELECT session_id AS dialogue_id, count(DISTINCT r) AS w, CAST(sum(DISTINCT r) AS BIGINT) AS b, 1 AS p FROM (SELECT session_id, CASE entity_type WHEN 'PHONE_NUMBER' THEN 1 WHEN 'PERSON' THEN 2 WHEN 'NRP' THEN 4 END AS r FROM it) GROUP BY ALL) USING (dialogue_id)),
rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w DESC, p DESC, sha1('17:' || dialogue_id), dialogue_id) AS slot FROM d),
tot AS (SELECT count(*) AS n, CAST(floor(count(*) * 7e-1) AS BIGINT) AS a, CAST(floor(count(*) * 15e-2) AS BIGINT) AS b FROM d),
tg AS MATERIALIZED (SELECT [b, n - a - b, a] AS t, n FROM tot),
kt AS (SELECT 0 AS k, count(*) FILTER (p) AS m FROM d UNION ALL SELECT 1, count(*) FILTER (b & 1 > 0) FROM d UNION ALL SELECT 2, count(*) FILTER (b & 2 > 0) FROM d UNION ALL SELECT 3, count(*) FILTER (b & 4 > 0) FROM d),
al AS (SELECT k, i, m * t[i] // n AS g, row_number() OVER (PARTITION BY k ORDER BY t[i] DESC, i) AS o, m - sum(m * t[i] // n) OVER (PARTITION BY k) AS rest FROM kt, tg, (VALUES (1), (2), (3)) v(i)),
goal AS MATERIALIZED (SELECT list(g ORDER BY k) AS g FROM (SELECT k, list(g + CASE WHEN o <= rest THEN 1 ELSE 0 END ORDER BY i) AS g FROM al GROUP BY k)),
st(slot, c, s, x, dialogue_id) AS (SELECT CAST(0 AS BIGINT), [0, 0, 0], [[0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]], 0, ''
  UNION ALL SELECT slot, {add("c", "true")}, [{states}], x, dialogue_id FROM (SELECT rk.slot, rk.dialogue_id, rk.p, rk.b, st.c, st.s,
    list_sort(list_filter([{place(1)}, {place(2)}, {place(3)}], lambda z: z.o))[1].i AS x FROM st JOIN rk ON rk.slot = st.slot + 1, goal, tg))
SELECT dialogue_id, ['dev', 'test', 'train'][x] AS split FROM st WHERE slot > 0"""


@query("n15_stratified_split", _n15_sql())
def stratified_split(spark, root):
    """Dialogues are conversations; tag kinds play types."""
    spans = F.explode_outer(S.tag_spans("text"))
    rows = I.tagged_turns(spark, root).select("dialogue_id", spans.alias("t")).select("dialogue_id", F.col("t.entity_type").alias("kind"))
    per = cut_lineage(rows.groupBy("dialogue_id").agg(F.collect_set("kind").alias("types"), F.count("kind").alias("k"))
                      .select("dialogue_id", "types", (F.col("k") > 0).alias("has_positive")))
    n = per.count()
    targets = {"train": int(n * 0.7), "dev": int(n * 0.15)}
    targets["test"] = n - sum(targets.values())
    return N.stratified_split(per, targets, 17, rare=("PHONE_NUMBER", "PERSON", "NRP"))


_BAL = f"""{_ITEMS}, f AS (SELECT session_id || '-turn-' || turn_index AS id, subject, bool_or(entity_type <> 'PERSON' AND NOT contains(entity_type, '_')) AS miss, count(*) >= 2 AS multi, bool_or(entity_type = 'PERSON') AS red FROM it GROUP BY ALL),
low AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM f GROUP BY subject)),
rk AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY miss DESC, multi DESC, red DESC, sha1('17:' || id), id) AS slot FROM f),
sl AS (SELECT subject, split, q, unnest(range(q)) AS k FROM (SELECT subject, split, tot // 2 + CASE WHEN subject = 'english' AND tot % 2 = 1 THEN 1 ELSE 0 END AS q FROM (VALUES ('english'), ('social_studies')) s(subject), (SELECT 'train' AS split, m AS tot FROM low UNION ALL SELECT 'dev', m // 4 FROM low UNION ALL SELECT 'test', m // 4 FROM low) t)),
so AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CAST(k AS DOUBLE) / q, q DESC, split) AS slot FROM sl) SELECT subject, id, split FROM rk JOIN so USING (subject, slot)"""


@query("n16_balanced_split", _BAL)
def balanced_split(spark, root):
    """Split sizes follow the smaller subject."""
    rows = cut_lineage(baseline_turns(spark, root).withColumnRenamed("turn_id", "id"))
    low = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    return N.balanced_split(rows, {"train": low, "dev": low // 4, "test": low // 4}, 17)


# --- redaction ----------------------------------------------------------------------------------
NAMES = r"\p{Lu}\p{L}{4,}"


def redactable(spark, root):
    spans = f"transform({T.regex_spans_sql('text', NAMES)}, h -> named_struct('start', h.start, 'end', h.`end`, 'text', h.text, 'entity_type', if(length(h.text) > 7, 'location', 'PERSON')))"
    return I.turns(spark, root).select(F.col("dialogue_id").alias("session_id"), "turn_index", "text", F.expr(spans).alias("spans"))


_RED = f"""WITH {I.TURNS_SQL}, keyed AS (SELECT dialogue_id || '#' || turn_index AS k, * FROM turns), {I._matches('rd', NAMES, 'keyed', 'k')},
sp AS MATERIALIZED (SELECT k, dialogue_id AS sid, turn_index AS t, s, e, CASE WHEN length(txt) > 7 THEN 'LOCATION' ELSE 'NAME' END AS ty, replace(lower(txt), 'ß', 'ss') AS key FROM rd_chars JOIN keyed ON k = rd_chars.id),
num AS (SELECT sid, ty, key, row_number() OVER (PARTITION BY sid, ty ORDER BY m) AS n FROM (SELECT sid, ty, key, min((t, -s)) AS m FROM sp GROUP BY ALL))"""


def _spliced(value, table="sp JOIN num USING (sid, ty, key)"):
    return f""", v AS (SELECT k, s, e, {value} AS v FROM {table}), g AS (SELECT v.k, v.s, v.e, v, substring(text, coalesce(lag(e) OVER (PARTITION BY v.k ORDER BY s), 0) + 1, s - coalesce(lag(e) OVER (PARTITION BY v.k ORDER BY s), 0)) AS gap FROM v JOIN keyed ON keyed.k = v.k)
SELECT dialogue_id AS session_id, turn_index, md5(coalesce(x || substring(text, last + 1), text)) AS redacted FROM keyed LEFT JOIN (SELECT k, string_agg(gap || v, '' ORDER BY s) AS x, max(e) AS last FROM g GROUP BY k) y USING (k)"""


@query("x1_mask_redaction", _RED + _spliced("'[REDACTED]'", "sp"))
def mask_redaction(spark, root):
    return redactable(spark, root).select("session_id", "turn_index", F.md5(X.render_fixed("text", "spans")).alias("redacted"))


@query("x1_delete_redaction", _RED + _spliced("''", "sp"))
def delete_redaction(spark, root):
    return redactable(spark, root).select("session_id", "turn_index", F.md5(X.render_fixed("text", "spans", "delete")).alias("redacted"))


@query("x2_typed_placeholders", _RED + _spliced("'[' || ty || '_' || n || ']'"))
def typed_placeholders(spark, root):
    return X.render_stable(redactable(spark, root)).select("session_id", "turn_index", F.md5("redacted").alias("redacted"))


@query("x2_entity_numbers", _RED + " SELECT sid AS session_id, ty AS type, key, n FROM num")
def entity_numbers(spark, root):
    spans = T.explode_rows(redactable(spark, root), F.col("spans"), "s").select("session_id", "turn_index", "s.*")
    return X.entity_numbers(spans)


def _pool_sql(kind):
    names = ", ".join(f"'{v}'" for v in FAKE_VALUES[kind])
    return f"coalesce([{names}][n], '{FAKE_VALUES[kind][-1]}-' || n)"


@query("x3_fake_surrogates", _RED + _spliced(f"CASE ty WHEN 'NAME' THEN {_pool_sql('NAME')} ELSE {_pool_sql('LOCATION')} END"))
def fake_surrogates(spark, root):
    return X.render_stable(redactable(spark, root), "fake_surrogate").select("session_id", "turn_index", F.md5("redacted").alias("redacted"))


@query("x4_redaction_types", "SELECT kind, CASE kind WHEN 'PERSON' THEN 'NAME' WHEN 'IP_ADDRESS' THEN 'IP' WHEN '' THEN 'ENTITY' WHEN 'custom' THEN 'CUSTOM' END AS type, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'PERSON' WHEN 'O' THEN 'IP_ADDRESS' ELSE CASE WHEN o_totalprice > 100000 THEN 'custom' ELSE '' END END AS kind FROM orders) GROUP BY ALL")
def redaction_types(spark, root):
    kind = F.when(F.col("o_orderstatus") == "F", "PERSON").when(F.col("o_orderstatus") == "O", "IP_ADDRESS").when(F.col("o_totalprice") > 100000, "custom").otherwise("")
    return I.load(spark, root, "orders").select(kind.alias("kind")).groupBy("kind", X.redaction_type(F.col("kind")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


PAIRS = r"\p{L}+ \p{L}+"


@query("x1_overlapping_spans", f"""{_RED}, {I._matches('rx', PAIRS, 'keyed', 'k')} SELECT dialogue_id AS session_id, turn_index FROM keyed WHERE k IN (
  SELECT a.id FROM rd_chars a JOIN rx_chars b ON a.id = b.id AND a.s < b.e AND b.s < a.e)""")
def overlapping_spans(spark, root):
    """Names beside pairs of words: the turns where a name is part of a pair."""
    pairs = f"transform({T.regex_spans_sql('text', PAIRS)}, h -> named_struct('start', h.start, 'end', h.`end`, 'text', h.text, 'entity_type', 'PAIR'))"
    both = redactable(spark, root).withColumn("spans", F.expr(f"concat(spans, {pairs})"))
    return X.overlapping_spans(both).select("session_id", "turn_index")


def _tagged_sessions(spark, root):
    return I.tagged_turns(spark, root).withColumnRenamed("dialogue_id", "session_id")


@query("x5_surrogate_view")
def surrogate_view(spark, root):
    """Pool order needs the seeded shuffle of the standard library; tests check it against a plain twin."""
    return X.surrogate_view(_tagged_sessions(spark, root)).select("session_id", "turn_index", "surrogate_text")


def _hashed_value_sql():
    """The value of the n-th tag of a type: pools are walked from a hash offset, other known types have a format."""
    parts = []
    for kind, pool in X.default_pools().items():
        listed = "[" + ", ".join(f"'{w}'" for w in pool) + "]"
        parts.append(f"WHEN '{kind}' THEN ({listed})[(n - 1 + CAST('0x' || substring(sha1('17:' || sid), 1, 6) AS BIGINT)) % {len(pool)} + 1]")
    parts += [f"WHEN '{kind}' THEN printf('{form}', n)" for kind, form in SURROGATE_FORMATS.items()]
    return f"CASE ty {' '.join(parts)} ELSE txt END"


_X5 = f"""WITH {I.TAGGED_SQL}, keyed AS (SELECT dialogue_id || '#' || turn_index AS k, * FROM tagged), {I._matches('tg', '<[A-Z_]+>', 'keyed', 'k')},
sp AS MATERIALIZED (SELECT k, dialogue_id AS sid, s, e, txt, substring(txt, 2, length(txt) - 2) AS ty, row_number() OVER (PARTITION BY dialogue_id, txt ORDER BY turn_index, s) AS n FROM tg_chars JOIN keyed ON k = tg_chars.id)"""


@query("x5_surrogate_view_hashed", _X5 + _spliced(_hashed_value_sql(), "sp"))
def surrogate_view_hashed(spark, root):
    """Pools walked from a hash offset, without Python."""
    view = X.surrogate_view(_tagged_sessions(spark, root), exact_shuffle=False)
    return view.select("session_id", "turn_index", F.md5("surrogate_text").alias("redacted"))


@query("x5_surrogate_occurrences", f"""WITH {I.TAGGED_SQL}, keyed AS (SELECT dialogue_id || '#' || turn_index AS k, * FROM tagged), {I._matches('tg', '<[A-Z_]+>', 'keyed', 'k')}
SELECT dialogue_id AS session_id, turn_index, substring(txt, 2, length(txt) - 2) AS entity_type, min(n) AS first_n, max(n) AS last_n FROM (
  SELECT dialogue_id, turn_index, txt, row_number() OVER (PARTITION BY dialogue_id, txt ORDER BY turn_index, s) AS n FROM tg_chars JOIN keyed ON k = tg_chars.id) GROUP BY ALL""")
def surrogate_occurrences(spark, root):
    view = X.surrogate_view(_tagged_sessions(spark, root), exact_shuffle=False)
    tags = T.explode_rows(view.select("session_id", "turn_index", "tags"), F.col("tags"), "t")
    return tags.groupBy("session_id", "turn_index", "t.entity_type").agg(F.min("t.occurrence").alias("first_n"), F.max("t.occurrence").alias("last_n"))


@query("x6_pilot_turns")
def pilot_turns(spark, root):
    return X.pilot_turns(I.tagged_turns(spark, root)).select("dialogue_id", "turn_index", "tag_count", "anchor_text", F.md5("context_text").alias("context_md5"))


@query("x6_pilot_items")
def pilot_items(spark, root):
    return X.pilot_items(X.pilot_turns(I.tagged_turns(spark, root))).groupBy("subject", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("x7_labelled_export", f"WITH {I.decisions_sql('dec')} SELECT id, gold_action AS action_label, coalesce(semantic_role, 'AMBIGUOUS') AS semantic_role, subject AS annotator, eval_slice AS label_origin, predicted_action = gold_action AS agrees_with_suggestion FROM dec")
def labelled_export(spark, root):
    d = I.decisions(spark, root)
    pool = d.select("id", F.col("session_id").alias("source_row_id"), "subject", F.col("id").alias("span_text"), F.col("id").alias("context_text"),
                    F.struct(F.col("gold_action").alias("action_label"), "semantic_role", F.col("subject").alias("annotator")).alias("annotation"),
                    F.col("eval_slice").alias("pool_source"), F.col("predicted_action").alias("suggested_action"), F.lit(0).alias("token_start"), F.lit(1).alias("token_end"))
    return X.export_labelled(pool).select("id", "action_label", "semantic_role", "annotator", "label_origin", "agrees_with_suggestion")


CANDIDATE = r"\p{Lu}\p{L}{9,}"


def length_scorer():
    """A stand-in for a model: integer arithmetic on lengths and digits, so that SQL can say the same."""

    def score(batch):
        out = []
        for span, context in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n, digits, around = len(span), sum("0" <= c <= "9" for c in span), len(context)
            three = 1 + (7 * n + 3 * digits) % 11, 1 + 5 * around % 13, 1 + (n + around) % 7
            out.append(tuple(x / sum(three) for x in three))
        return out

    return score


def _cascade(spark, root):
    docs = I.documents(spark, root).select(F.col("subject").alias("session_id"), F.col("id").cast("long").alias("turn_index"), "text")
    return K.run(docs, K.fit_policy(I.decisions(spark, root), 0.15), scorer=length_scorer, candidate_pattern=CANDIDATE)


_KIND = r"""CASE WHEN contains(txt, '@') THEN 'EMAIL_ADDRESS' WHEN regexp_matches(txt, '^(https?://|www[.])') THEN 'URL'
  WHEN regexp_matches(txt, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 'IP_ADDRESS' WHEN regexp_matches(txt, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') THEN 'US_SSN' ELSE 'PHONE_NUMBER' END"""
_CASCADE = f"""{D.FULL}, {I.tokens_sql()}, {I._matches('di', U.IDENTIFIER_PATTERN)}, {I._matches('ca', CANDIDATE)}, {I._painted('ca')},
dsp AS MATERIALIZED (SELECT id, s, e, txt, {_KIND} AS kind FROM di_chars),
csp AS (SELECT c.id, a.s, b.e FROM ca_spans c JOIN tok a ON a.id = c.id AND a.i = c.s JOIN tok b ON b.id = c.id AND b.i = c.e - 1),
sp AS MATERIALIZED (SELECT * FROM dsp UNION ALL SELECT c.id, c.s, c.e, substring(d.text, c.s + 1, c.e - c.s), 'SUSPECT' FROM csp c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.id
  WHERE NOT EXISTS (SELECT 1 FROM dsp x WHERE x.id = c.id AND x.s < c.e AND c.s < x.e)),
sc AS (SELECT *, 1 + (7 * n + 3 * g) % 11 AS r, 1 + 5 * c % 13 AS k, 1 + (n + c) % 7 AS v FROM (SELECT sp.*, d.lang, length(txt) AS n, length(regexp_replace(txt, '[^0-9]', '', 'g')) AS g,
  least(e + 64, length(d.text)) - greatest(0, s - 64) AS c FROM sp JOIN documents d ON CAST(d.doc_id AS VARCHAR) = sp.id)),
oc AS (SELECT *, kind IN ('EMAIL_ADDRESS', 'URL', 'IP_ADDRESS', 'US_SSN') OR regexp_matches(txt, '(?i)^DLN?[A-Z0-9-]{{6,}}$') AS sure FROM sc),
pc AS (SELECT id, lang, s, e, txt, kind, sure, CASE WHEN sure THEN 1e0 ELSE r / CAST(r + k + v AS DOUBLE) END AS pr, CASE WHEN sure THEN 0e0 ELSE k / CAST(r + k + v AS DOUBLE) END AS pk,
  CASE WHEN sure THEN 0e0 ELSE v / CAST(r + k + v AS DOUBLE) END AS pv FROM oc),
bc AS (SELECT *, CASE WHEN pr >= pk AND pr >= pv THEN 'REDACT' WHEN pk >= pv THEN 'KEEP' ELSE 'REVIEW' END AS predicted_action FROM pc),
cf AS (SELECT *, greatest(qr, qk, qv) AS confidence, abs(qr - qk) AS margin, qv AS review_probability,
  -(qr * ln(greatest(qr, 1e-12)) + qk * ln(greatest(qk, 1e-12)) + qv * ln(greatest(qv, 1e-12))) AS entropy FROM ({D._SCALED.format(src='(SELECT * FROM bc, temp)')})),
ch AS ({D._CHOSEN.format(t='15e-2')}),
cd AS MATERIALIZED (SELECT id, lang, s, e, txt, kind, sure, base_action, strategy, deferred, CASE WHEN deferred THEN 'REVIEW' ELSE base_action END AS action FROM (
  SELECT f.*, f.predicted_action AS base_action, g.strategy, NOT sure AND {D.DEFER} AS deferred FROM cf f, (SELECT * FROM grid WHERE ord IN (SELECT ord FROM ch)) g))"""


@query("x8_cascade_job", f"""{_CASCADE}, rd AS MATERIALIZED (SELECT id, lang, CAST(id AS BIGINT) AS t, s, e, CASE kind WHEN 'IP_ADDRESS' THEN 'IP' WHEN 'PHONE_NUMBER' THEN 'PHONE' ELSE kind END AS ty,
  replace(lower(txt), 'ß', 'ss') AS key FROM cd WHERE action = 'REDACT'),
num AS (SELECT lang, ty, key, row_number() OVER (PARTITION BY lang, ty ORDER BY m) AS n FROM (SELECT lang, ty, key, min((t, -s)) AS m FROM rd GROUP BY ALL)),
va AS (SELECT rd.id, s, e, '[' || ty || '_' || n || ']' AS v FROM rd JOIN num USING (lang, ty, key)),
ga AS (SELECT va.id, s, e, v, substring(text, coalesce(lag(e) OVER (PARTITION BY va.id ORDER BY s), 0) + 1, s - coalesce(lag(e) OVER (PARTITION BY va.id ORDER BY s), 0)) AS gap FROM va JOIN documents ON CAST(doc_id AS VARCHAR) = va.id)
SELECT doc_id AS turn_index, coalesce(n, 0) AS n_redacted, md5(coalesce(x || substring(text, last + 1), text)) AS redacted
FROM documents LEFT JOIN (SELECT id, count(*) AS n, string_agg(gap || v, '' ORDER BY s) AS x, max(e) AS last FROM ga GROUP BY id) y ON y.id = CAST(doc_id AS VARCHAR)""")
def cascade_job(spark, root):
    """A policy fitted on one table, carried through detection, scoring, deferral and rendering of another."""
    return _cascade(spark, root).rendered.select("turn_index", F.size("spans").cast("long").alias("n_redacted"), F.md5("redacted").alias("redacted"))


@query("x8_review_queue", f"{_CASCADE} SELECT CAST(id AS BIGINT) AS turn_index, s AS start, kind AS entity_type, base_action, strategy, deferred FROM cd WHERE action = 'REVIEW'")
def review_queue(spark, root):
    """What the cascade leaves to review: deferred spans, and those the model itself sends there."""
    return _cascade(spark, root).queue.select("turn_index", F.col("start").cast("long").alias("start"), "entity_type",
                                              F.col("base_predicted_action").alias("base_action"), "strategy", "deferred")


@query("x8_action_counts", f"{_CASCADE} SELECT kind AS entity_type, action, count(*) AS n, count(*) FILTER (deferred) AS deferred, count(*) FILTER (sure) AS direct FROM cd GROUP BY ALL")
def action_counts(spark, root):
    return _cascade(spark, root).decided.groupBy("entity_type", F.col("predicted_action").alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("deferred").alias("deferred"), F.count_if(F.col("override").isNotNull()).alias("direct"))


# --- seams -----------------------------------------------------------------------------------------
@query("u1_candidate_scoring", f"WITH {I.tokens_sql()}, {I._matches('gold', I.GOLD_PATTERN)}, {I._painted('gold')} SELECT d.id, coalesce(n, 0) AS n_positive FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d LEFT JOIN (SELECT id, count(*) AS n FROM gold_lab GROUP BY id) USING (id)")
def candidate_scoring(spark, root):
    out = U.score_candidates(I.documents(spark, root), pattern=I.GOLD_PATTERN)
    return out.select("id", F.expr("size(filter(predicted_labels, x -> x <> 'O'))").cast("long").alias("n_positive"))


@query("u2_action_scoring", f"WITH {I.decisions_sql('dec')} SELECT id, CASE WHEN entity_type = 'EMAIL_ADDRESS' OR latency_ms > 300 OR length(regexp_replace(id, '[^0-9]', '', 'g')) >= 7 THEN 'REDACT' WHEN eval_slice = 'natural' THEN 'KEEP' ELSE 'REVIEW' END AS predicted_action FROM dec")
def action_scoring(spark, root):
    context = F.when(F.col("eval_slice") == "natural", F.concat(F.lit("the lesson on "), "span_text")).otherwise(F.concat(F.lit("about "), "span_text"))
    rows = _with_span(I.decisions(spark, root)).withColumn("context_text", context)
    return U.score_actions(rows).select("id", "predicted_action")


def regex_detector():
    """The built-in candidate search as a plugged scorer: compiled once per task, spans by code points."""
    pattern = regex.compile(I.GOLD_PATTERN)  # nothing in it that engines read differently

    def score(batch):
        return [[m.span() for m in pattern.finditer(text)] for text in batch.column("text").to_pylist()]

    return score


@query("u1_plugged_scorer", f"WITH {I.tokens_sql()}, {I._matches('gold', I.GOLD_PATTERN)}, {I._painted('gold')} SELECT d.id, coalesce(n, 0) AS n_positive FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d LEFT JOIN (SELECT id, count(*) AS n FROM gold_lab GROUP BY id) USING (id)")
def plugged_candidates(spark, root):
    """The same rows as u1_candidate_scoring by way of a scorer in the tasks."""
    out = U.score_candidates(I.documents(spark, root), regex_detector)
    return out.select("id", F.expr("size(filter(predicted_labels, x -> x <> 'O'))").cast("long").alias("n_positive"))


@query("u2_plugged_scorer", f"WITH {I.decisions_sql('dec')} SELECT id, CASE WHEN entity_type = 'EMAIL_ADDRESS' OR latency_ms > 300 THEN 'REDACT' WHEN eval_slice = 'natural' THEN 'KEEP' ELSE 'REVIEW' END AS predicted_action, 9e-1 AS confidence FROM dec")
def plugged_actions(spark, root):
    """The rows of u2_action_scoring by way of a scorer in the tasks."""
    context = F.when(F.col("eval_slice") == "natural", F.concat(F.lit("the lesson on "), "span_text")).otherwise(F.concat(F.lit("about "), "span_text"))
    rows = _with_span(I.decisions(spark, root)).withColumn("context_text", context)
    return U.score_actions(rows, rule_scorer).select("id", "predicted_action", "confidence")


def rule_scorer():
    """Direct identifiers and lesson words in plain Python, with the scores of the built-in rules."""
    direct = regex.compile(r"(?i)[\w.%+-]+@[\w.-]+\.[a-z]{2,}|www\.\S+")

    def score(batch):
        out = []
        for span, context, kind in zip(*(batch.column(c).to_pylist() for c in ("span_text", "context_text", "entity_type"))):
            place = 0 if kind == "EMAIL_ADDRESS" or direct.search(span) else 1 if "lesson" in context else 2
            out.append(tuple(0.9 if i == place else 0.05 for i in range(3)))
        return out

    return score


@query("u3_response_labelling", f"""WITH {I.decisions_sql('dec')} SELECT CASE WHEN latency_ms < 240 OR latency_ms >= 360 THEN predicted_action WHEN latency_ms >= 300 THEN 'REVIEW' END AS action_label, CASE WHEN latency_ms >= 240 AND latency_ms < 360 THEN 2 ELSE 1 END AS attempt_count, count(*) AS n FROM dec GROUP BY ALL""")
def response_labelling(spark, root):
    """Rows that fail are asked again; the second answer repairs one kind of failure."""
    first = responses(spark, root).select("id", F.lit(1).alias("attempt"), "raw_text", "latency_ms", F.lit(5).cast("long").alias("total_tokens"))
    again = F.when(F.col("latency_ms") >= 300, F.lit('{"action_label": REVIEW, "semantic_role": "AMBIGUOUS"}')).otherwise(F.lit("no"))
    out = U.label_responses(first.unionByName(first.withColumn("attempt", F.lit(2)).withColumn("raw_text", again)))
    return out.groupBy("action_label", F.col("attempt_count").cast("long").alias("attempt_count")).agg(F.count(F.lit(1)).alias("n"))
