"""Tags, transcripts, turns and segments (T14-T25, J5, J9, R16-R18) over whole conversations."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import tokens as T
from ..operators import quality as Q
from ..operators import spans as S
from . import inputs as I
from .registry import query

WORD = r"\p{Lu}\p{L}{5,}"
CROSSING = r"[.]\n\p{Lu}\p{L}+"


def transcripts(spark, root, pattern=None, moved=False, faulty=False, speakers=True):
    """One transcript per conversation; annotations are pattern matches, optionally misplaced.

    Without ``speakers`` what stands before a colon is no annotation: a speaker label lies in no turn.  In a ``faulty`` input
    one match in eleven each has a text that is not there and is moved to the blank before it.
    """
    line = F.when(F.col("role") == "user", F.concat(F.lit("Student: "), "text")).when(
        F.col("role") == "assistant", F.concat(F.lit("VOLUNTEER: "), "text")).otherwise(F.col("text"))
    rows = I.load_text(spark, root, "conversations").select("conv_id", "turn", line.alias("line"))
    df = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("ls")).select(
        F.col("conv_id").cast("string").alias("dialogue_id"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("transcript"))
    if pattern is None:
        return df
    m = "(h.start % 5)" if moved else "0"
    hits = T.regex_spans_sql("transcript", pattern)
    if faulty:
        fault = lambda a, b, c: f"case h.start % 11 when 0 then {a} when 1 then {b} else {c} end"
        return df.withColumn("spans", F.expr(
            f"transform({hits}, h -> named_struct('start', {fault('h.start', 'h.start - 1', 'h.start')}, 'end', {fault('h.`end`', 'h.start', 'h.`end`')}, "
            f"""'text', {fault("concat('zz', h.text)", "' '", 'h.text')}, 'pii_type', 'person-name'))"""))
    if not speakers:
        hits = T.bind("transcript", lambda t: f"filter({T.regex_spans_sql(t, pattern)}, h -> substring({t}, h.`end` + 1, 2) <> ': ')")
    spans = (
        f"transform({hits}, h -> named_struct("
        f"'start', case {m} when 2 then h.start - 1 when 3 then h.start - 1 when 4 then h.start + 7 else h.start end, "
        f"'end', case {m} when 1 then h.`end` - 1 when 2 then h.`end` + 1 when 3 then h.`end` - 1 when 4 then h.`end` + 7 else h.`end` end, "
        f"'text', h.text, 'pii_type', if(length(h.text) > 8, 'person-name', 'social handle')))")
    return df.withColumn("spans", F.expr(spans))


TR = """tr AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS id, string_agg(CASE role WHEN 'user' THEN 'Student: ' || text WHEN 'assistant' THEN 'VOLUNTEER: ' || text ELSE text END, chr(10) ORDER BY turn) AS t
  FROM conversations GROUP BY conv_id)"""


def _ann(pattern, moved, speakers=True):
    m = "CASE s % 5 WHEN {} THEN {} ELSE {} END"
    sql = f"{TR}, {I._matches('ann', pattern, 'tr', 'id', 't')}" if speakers else f"{TR}, {I._matches('hit', pattern, 'tr', 'id', 't')}, ann_chars AS (SELECT c.* FROM hit_chars c JOIN tr USING (id) WHERE substring(t, e + 1, 2) <> ': ')"
    if not moved:
        return sql + ", mv AS (SELECT id, pos, s, e, txt FROM ann_chars)"
    return sql + """, mv AS (SELECT id, pos, CASE s % 5 WHEN 2 THEN s - 1 WHEN 3 THEN s - 1 WHEN 4 THEN s + 7 ELSE s END AS s,
  CASE s % 5 WHEN 1 THEN e - 1 WHEN 2 THEN e + 1 WHEN 3 THEN e - 1 WHEN 4 THEN e + 7 ELSE e END AS e, txt FROM ann_chars)"""


GROUND_TRUTH = _ann(WORD, False, False)
RESOLVED = """,
x AS (SELECT mv.*, t, substring(t, s + 1, e - s) AS f1, substring(t, s + 1, least(e + 1, length(t)) - s) AS f2,
  substring(t, s + 2, least(e + 1, length(t)) - s - 1) AS f3 FROM mv JOIN tr USING (id)),
near AS (SELECT id, pos, min_by(p, (abs(p - s), p)) AS p FROM (
  SELECT id, pos, s, txt, t, unnest(range(greatest(0, s - 128), least(length(t), greatest(e, s) + 128 + length(txt)) - length(txt) + 1)) AS p FROM x)
  WHERE substring(t, p + 1, length(txt)) = txt GROUP BY id, pos),
res AS MATERIALIZED (SELECT x.id, x.pos, txt, CASE WHEN f1 = txt THEN s WHEN f2 = txt THEN s WHEN trim(f1, E' \\n') = txt THEN s + length(f1) - length(ltrim(f1, E' \\n'))
  WHEN trim(f2, E' \\n') = txt THEN s + length(f2) - length(ltrim(f2, E' \\n')) WHEN f3 = txt THEN s + 1 ELSE p END AS rs,
  CASE WHEN f1 = txt THEN 'exact' WHEN f2 = txt THEN 'inclusive_end' WHEN trim(f1, E' \\n') = txt THEN 'trimmed' WHEN trim(f2, E' \\n') = txt THEN 'trimmed_inclusive_end'
  WHEN f3 = txt THEN 'shift_right' WHEN p IS NOT NULL THEN 'local_search' END AS resolution FROM x LEFT JOIN near USING (id, pos))"""

LINES = """,
ln AS MATERIALIZED (SELECT id, pos - 1 AS line, txt, e - length(txt) - CASE WHEN pos < n THEN 1 ELSE 0 END AS s FROM (
  SELECT id, pos, n, txt, CAST(sum(length(txt) + CASE WHEN pos < n THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS e FROM (
    SELECT id, unnest(ls) AS txt, generate_subscripts(ls, 1) AS pos, len(ls) AS n FROM (SELECT id, string_split(t, chr(10)) AS ls FROM tr)))),
tl AS (SELECT *, regexp_matches(txt, '(?i)^(student|volunteer):') AS op, length(regexp_extract(txt, '(?i)^(student|volunteer): *')) AS cut,
  sum(CASE WHEN line = 0 OR regexp_matches(txt, '(?i)^(student|volunteer):') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) - 1 AS turn FROM ln),
trn AS MATERIALIZED (SELECT id, turn, coalesce(lower(max(CASE WHEN op THEN regexp_extract(txt, '(?i)^(student|volunteer)', 1) END)), 'unknown') AS role,
  min(s + CASE WHEN op THEN cut ELSE 0 END) AS s, max(s + length(txt)) AS e, string_agg(CASE WHEN op THEN substring(txt, cut + 1) ELSE txt END, chr(10) ORDER BY line) AS txt FROM tl GROUP BY id, turn)"""


@query("t14_tag_extraction", f"""WITH {I.TAGGED_SQL}, {I._matches('tg', '<[A-Z_]+>', '(SELECT dialogue_id || chr(45) || turn_index AS k, text FROM tagged)', 'k')}
SELECT id, s AS tag_start, e AS tag_end, substring(txt, 2, length(txt) - 2) AS entity_type, row_number() OVER (PARTITION BY id, txt ORDER BY pos) AS occurrence
FROM tg_chars WHERE txt IN ({', '.join(f"'<{t}>'" for t in S.SUPPORTED_TAGS)})""")
def tag_extraction(spark, root):
    df = I.tagged_turns(spark, root).withColumn("id", F.concat_ws("-", "dialogue_id", F.col("turn_index").cast("string")))
    rows = T.explode_rows(df, S.tag_spans("text"), "h")
    return rows.select("id", F.col("h.start").cast("long").alias("tag_start"), F.col("h.end").cast("long").alias("tag_end"),
                       "h.entity_type", F.col("h.occurrence").cast("long").alias("occurrence"))


@query("t15_offset_repair", f"WITH {_ann(WORD, True)}{RESOLVED} SELECT id AS dialogue_id, resolution, count(*) AS n, sum(rs) AS sum_start, sum(rs + length(txt)) AS sum_end FROM res GROUP BY ALL")
def offset_repair(spark, root):
    rows = S.resolve_spans(transcripts(spark, root, WORD, moved=True))
    return rows.groupBy("dialogue_id", "resolution").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("resolved_start").cast("long")).alias("sum_start"),
        F.sum(F.col("resolved_end").cast("long")).alias("sum_end"))


_CANON = "CASE k WHEN 'PERSON' THEN 'NAME' WHEN 'LOCATION' THEN 'ADDRESS' WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' ELSE k END"


@query("t16_canonical_types", f"""WITH {I.TAGGED_SQL}, {I._matches('tg', '<[A-Z_]+>', 'tagged', 'dialogue_id')}
SELECT raw_type, {_CANON} AS canonical, n FROM (SELECT lower(replace(substring(txt, 2, length(txt) - 2), '_', '-')) AS raw_type, substring(txt, 2, length(txt) - 2) AS k, count(*) AS n FROM tg_chars GROUP BY ALL)""")
def canonical_types(spark, root):
    rows = T.explode_rows(I.tagged_turns(spark, root), S.tag_spans("text", supported_only=False), "h")
    raw = F.lower(F.translate("h.entity_type", "_", "-"))
    return rows.groupBy(raw.alias("raw_type")).agg(F.count(F.lit(1)).alias("n")).select(
        "raw_type", R.canonical_type(F.col("raw_type")).alias("canonical"), "n")


@query("q10_label_renames", f"""WITH {I.TAGGED_SQL}, {I._matches('tg', '<[A-Z_]+>', 'tagged', 'dialogue_id')}
SELECT k AS label, {_CANON} AS canonical, n FROM (SELECT substring(txt, 2, length(txt) - 2) AS k, count(*) AS n FROM tg_chars GROUP BY ALL) WHERE k IN ('PERSON', 'LOCATION', 'EMAIL_ADDRESS')""")
def label_renames(spark, root):
    rows = T.explode_rows(I.tagged_turns(spark, root), S.tag_spans("text", supported_only=False), "h")
    return Q.label_renames(rows.select(F.col("h.entity_type").alias("kind")), "kind")


@query("t17_transcript_turns", f"WITH {TR}{LINES} SELECT id AS dialogue_id, turn AS turn_index, role AS speaker_role, s AS turn_start, e AS turn_end, txt AS text FROM trn")
def transcript_turns(spark, root):
    rows = T.explode_rows(transcripts(spark, root), S.transcript_turns("transcript"), "t")
    return rows.select("dialogue_id", F.col("t.turn_index").cast("long").alias("turn_index"), "t.speaker_role",
                       F.col("t.start").cast("long").alias("turn_start"), F.col("t.end").cast("long").alias("turn_end"), "t.text")


@query("t18_transcript_lines", f"WITH {TR}{LINES} SELECT id AS dialogue_id, line, s AS line_start, txt AS text FROM ln")
def transcript_lines(spark, root):
    rows = T.explode_rows(transcripts(spark, root), S.transcript_lines("transcript"), "t")
    return rows.select("dialogue_id", F.col("t.line").cast("long").alias("line"), F.col("t.start").cast("long").alias("line_start"), "t.text")


_IN_TURN = f"WITH {_ann(WORD, True, False)}{RESOLVED}{LINES}, it AS (SELECT r.id, r.rs, r.rs + length(r.txt) AS re, min(turn) AS turn FROM res r JOIN trn ON r.id = trn.id AND trn.s <= r.rs AND r.rs + length(r.txt) <= trn.e WHERE resolution IS NOT NULL GROUP BY ALL)"


@query("t19_span_to_turn", f"{_IN_TURN} SELECT id AS dialogue_id, turn AS turn_index, count(*) AS n, sum(rs) AS sum_start FROM it GROUP BY ALL")
def span_to_turn(spark, root):
    base = transcripts(spark, root, WORD, moved=True, speakers=False)
    spans = S.resolve_spans(base).filter("resolution is not null").select(
        "dialogue_id", F.col("resolved_start").alias("start"), F.col("resolved_end").alias("end"))
    turns = T.explode_rows(base, S.transcript_turns("transcript"), "t").select("dialogue_id", "t.turn_index", "t.start", "t.end")
    return S.turns_of_spans(spans, turns).groupBy("dialogue_id", F.col("turn_index").cast("long").alias("turn_index")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("sum_start"))


_SEG = f"""WITH {_ann(CROSSING, False)}{LINES},
touch AS (SELECT mv.id, mv.pos, min(line) AS a, max(line) AS b FROM mv JOIN ln ON ln.id = mv.id AND ln.s <= mv.e - 1 AND mv.s <= ln.s + length(ln.txt) GROUP BY mv.id, mv.pos),
isl AS (SELECT id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, b, pos) AS g FROM (
  SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM touch)) GROUP BY id, g),
seg AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY start_line) - 1 AS segment, start_line, end_line, s, e FROM (
  SELECT ln.id, coalesce(a, line) AS start_line, coalesce(b, line) AS end_line, min(ln.s) AS s, max(ln.s + length(ln.txt)) AS e
  FROM ln LEFT JOIN isl ON isl.id = ln.id AND line BETWEEN a AND b GROUP BY ALL))"""


@query("t20_transcript_segments", f"{_SEG} SELECT id AS dialogue_id, segment, start_line, end_line, s AS seg_start, e AS seg_end FROM seg")
def transcript_segments(spark, root):
    rows = T.explode_rows(transcripts(spark, root, CROSSING), S.transcript_segments("transcript", "spans"), "g")
    return rows.select("dialogue_id", *[F.col(f"g.{a}").cast("long").alias(b) for a, b in (
        ("segment", "segment"), ("start_line", "start_line"), ("end_line", "end_line"), ("start", "seg_start"), ("end", "seg_end"))])


def _row_digest(df):
    return df.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.size("token_spans").cast("long").alias("n_spans"),
                     F.expr("size(filter(labels, x -> x <> 'O'))").cast("long").alias("n_positive"), "types")


_DIGEST = """tk AS MATERIALIZED (SELECT id AS uid, i, s, e FROM tok),
hit AS (SELECT uid, k, min(i) AS a, max(i) AS b FROM tk JOIN lsp ON lsp.id = tk.uid AND tk.s < lsp.e AND tk.e > lsp.s GROUP BY ALL),
pos AS (SELECT uid, count(DISTINCT i) AS n FROM (SELECT uid, unnest(range(a, b + 1)) AS i FROM hit) GROUP BY uid)
SELECT n.uid AS id, n.n AS n_tokens, coalesce(h.n, 0) AS n_spans, coalesce(p.n, 0) AS n_positive, coalesce(ty, '') AS types
FROM (SELECT uid, count(*) AS n FROM tk GROUP BY uid) n LEFT JOIN (SELECT uid, count(*) AS n FROM hit GROUP BY uid) h ON h.uid = n.uid LEFT JOIN pos p ON p.uid = n.uid
LEFT JOIN (SELECT id, string_agg(DISTINCT type, ',' ORDER BY type) AS ty FROM lsp GROUP BY id) y ON y.id = n.uid"""


# Each annotation is a span of its own, also where two are repaired to the same place.
_EACH_IN_TURN = f"WITH {_ann(WORD, True, False)}{RESOLVED}{LINES}, it AS (SELECT r.id, r.pos, r.rs, r.rs + length(r.txt) AS re, min(turn) AS turn FROM res r JOIN trn ON r.id = trn.id AND trn.s <= r.rs AND r.rs + length(r.txt) <= trn.e WHERE resolution IS NOT NULL GROUP BY ALL)"


@query("t21_turn_rows", f"""{_EACH_IN_TURN}, u AS (SELECT id || '-turn-' || turn AS k, txt AS text FROM trn), {I.tokens_sql('u', 'k')},
lsp AS (SELECT it.id || '-turn-' || it.turn AS id, it.pos AS k, rs - trn.s AS s, re - trn.s AS e, CASE WHEN re - rs > 8 THEN 'NAME' ELSE 'IDENTIFYING_NUMBER' END AS type FROM it JOIN trn ON trn.id = it.id AND trn.turn = it.turn), {_DIGEST}""")
def turn_rows(spark, root):
    return _row_digest(S.project_turns(transcripts(spark, root, WORD, moved=True, speakers=False)))


@query("t22_segment_rows", f"""{_SEG}, u AS (SELECT seg.id || '-segment-' || segment AS k, substring(t, s + 1, e - s) AS text FROM seg JOIN tr USING (id)), {I.tokens_sql('u', 'k')},
lsp AS (SELECT mv.id || '-segment-' || segment AS id, mv.pos AS k, mv.s - seg.s AS s, mv.e - seg.s AS e, CASE WHEN mv.e - mv.s > 8 THEN 'NAME' ELSE 'IDENTIFYING_NUMBER' END AS type
  FROM mv JOIN seg ON seg.id = mv.id AND seg.s <= mv.s AND mv.e <= seg.e), {_DIGEST}""")
def segment_rows(spark, root):
    return _row_digest(S.project_segments(transcripts(spark, root, CROSSING)))


_FAULTY = f"""WITH {TR}, {I._matches('hit', WORD, 'tr', 'id', 't')}, mv AS (SELECT id, pos, CASE s % 11 WHEN 1 THEN s - 1 ELSE s END AS s,
  CASE s % 11 WHEN 1 THEN s ELSE e END AS e, CASE s % 11 WHEN 0 THEN 'zz' || txt WHEN 1 THEN ' ' ELSE txt END AS txt FROM hit_chars){RESOLVED}{LINES},
lo AS MATERIALIZED (SELECT r.id, mv.s, mv.e, mv.txt, r.rs, CASE WHEN resolution IS NULL THEN 'text not nearby' WHEN NOT EXISTS (
    SELECT 1 FROM trn WHERE trn.id = r.id AND trn.s <= r.rs AND r.rs + length(r.txt) <= trn.e) THEN 'in no single turn' WHEN r.txt = ' ' THEN 'no token' END AS reason
  FROM res r JOIN mv ON mv.id = r.id AND mv.pos = r.pos)"""


@query("t21_lost_spans", f"{_FAULTY} SELECT id AS dialogue_id, s AS start, e AS \"end\", txt AS text, reason FROM lo WHERE reason IS NOT NULL")
def lost_spans(spark, root):
    """What the quarantine holds of an input with planted faults."""
    found = S.project_with_quarantine(transcripts(spark, root, WORD, faulty=True), "turn").lost
    return found.select("dialogue_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "reason")


@query("t21_quarantine_counts", f"""{_FAULTY} SELECT (SELECT count(*) FROM tr) AS dialogues, count(*) FILTER (reason IS NULL) AS placed, count(*) FILTER (reason IS NOT NULL) AS lost,
  (SELECT count(DISTINCT (l.id, turn)) FROM lo l JOIN trn ON trn.id = l.id AND trn.s <= l.rs AND l.rs + length(l.txt) <= trn.e WHERE reason IS NULL) AS positive_rows FROM lo""")
def quarantine_counts(spark, root):
    """Counts that the one job took, beside the rows that still have a span."""
    done = S.project_with_quarantine(transcripts(spark, root, WORD, faulty=True), "turn")
    positive = done.rows.agg(F.count_if(F.size("token_spans") > 0).alias("positive_rows"))
    return positive.select(*[F.lit(done.counts[c]).cast("long").alias(c) for c in ("dialogues", "placed", "lost")], "positive_rows")


def broken_crossings(spark, root):
    """Crossing spans, of which one in three is cut down to its line break."""
    cut = "s.start % 3 = 0"
    return transcripts(spark, root, CROSSING, speakers=False).withColumn("spans", F.expr(
        f"transform(spans, s -> named_struct('start', if({cut}, s.start + 1, s.start), 'end', if({cut}, s.start + 2, s.`end`), "
        f"'text', if({cut}, '\\n', s.text), 'pii_type', s.pii_type))"))


@query("t22_unprojected_spans", f"""WITH {_ann(CROSSING, False, False)} SELECT id AS dialogue_id, count(*) AS want, count(*) FILTER (s % 3 <> 0) AS got FROM mv GROUP BY id HAVING count(*) FILTER (s % 3 = 0) > 0""")
def unprojected_spans(spark, root):
    base = broken_crossings(spark, root)
    return S.unprojected(base, S.project_with_quarantine(base, "segment").rows)


@query("t23_supported_annotations", f"""WITH {_ann(WORD, False)} SELECT id AS dialogue_id, count(*) AS n, sum(length(txt)) AS chars FROM mv WHERE length(txt) > 8 GROUP BY id""")
def supported_annotations(spark, root):
    df = transcripts(spark, root, WORD)
    lower = "transform(spans, s -> named_struct('start', s.start, 'end', s.`end`, 'pii_type', if(length(s.text) > 8, 'person', 'unlisted')))"
    rows = T.explode_rows(df.withColumn("anns", F.expr(lower)), S.supported_annotations("transcript", "anns"), "a")
    return rows.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("a.text")).alias("chars"))


def action_rows(spark, root):
    """Tag occurrences as labelled action rows, in file order."""
    df = I.tagged_turns(spark, root)
    rows = T.explode_rows(df, S.tag_spans("text"), "h")
    label = F.when(F.col("h.entity_type") == "PERSON", "REDACT").when(F.col("h.entity_type") == "LOCATION", "KEEP").otherwise("REVIEW")
    return rows.select(
        F.concat_ws("-", "dialogue_id", F.lit("turn"), F.col("turn_index").cast("string"), F.lit("tag"), F.col("h.start").cast("string")).alias("id"),
        "dialogue_id", "turn_index", "subject", "speaker_role", F.col("text").alias("turn_text"), "h.entity_type", label.alias("action_label"),
        F.substring("text", F.lit(1), F.col("h.end")).alias("context_text"), F.lit(None).cast("string").alias("anchor_text"),
        F.col("h.start").alias("tag_start"), F.col("h.end").alias("tag_end"), (F.col("turn_index") * 100000 + F.col("h.start")).alias("ord"))


_ACT = f"""WITH {I.TAGGED_SQL}, keyed AS (SELECT dialogue_id || '-turn-' || turn_index AS k, * FROM tagged), {I._matches('tg', '<[A-Z_]+>', 'keyed', 'k')},
ac AS MATERIALIZED (SELECT id, s, e, substring(txt, 2, length(txt) - 2) AS entity_type FROM tg_chars WHERE txt IN ({', '.join(f"'<{t}>'" for t in S.SUPPORTED_TAGS)})),
per AS (SELECT id AS turn_id, count(*) AS action_row_count, max(e) AS longest, count(*) FILTER (entity_type = 'PERSON') AS redact FROM ac GROUP BY id)"""


@query("t24_turns_from_actions", f"""{_ACT} SELECT turn_id, action_row_count, action_row_count AS seed_count, redact AS redact_seed_count, action_row_count >= 2 AS has_multispan_seed, redact > 0 AS has_redact_seed,
  longest AS context_length, subject, speaker_role FROM per JOIN keyed ON k = turn_id""")
def turns_from_actions(spark, root):
    out = S.turns_from_actions(action_rows(spark, root))
    return out.select("turn_id", "action_row_count", F.col("seed_count").cast("long").alias("seed_count"), F.col("redact_seed_count").cast("long").alias("redact_seed_count"),
                      "has_multispan_seed", "has_redact_seed", F.length("context_text").cast("long").alias("context_length"), "subject", "speaker_role")


def baseline_turns(spark, root):
    """Seeds against a baseline that proposes every token PERSON or an underscore word."""
    turns = S.turns_from_actions(action_rows(spark, root))
    pred = turns.select("turn_id", F.transform("tokens", lambda t: F.when(t.rlike("^(PERSON|[A-Z]+_[A-Z]+)$"), "B-SUSPECT").otherwise("O")).alias("predicted_labels"))
    return S.baseline_coverage(turns, pred)


@query("t25_baseline_coverage", f"""{_ACT} SELECT id AS turn_id, count(*) FILTER (hit) AS covered, count(*) FILTER (NOT hit) AS missed, count(*) FILTER (hit AND entity_type = 'PERSON') AS covered_redact,
  count(*) FILTER (NOT hit AND entity_type = 'PERSON') AS missed_redact, count(*) FILTER (NOT hit) > 0 AS missed_any FROM (SELECT *, entity_type = 'PERSON' OR contains(entity_type, '_') AS hit FROM ac) GROUP BY id""")
def baseline_coverage(spark, root):
    out = baseline_turns(spark, root)
    return out.select("turn_id", *[F.col(c).cast("long").alias(c) for c in ("covered", "missed", "covered_redact", "missed_redact")], "missed_any")


@query("a18_proxy_summary", f"""{_ACT}, h AS (SELECT id, count(*) AS n, count(*) FILTER (entity_type = 'PERSON') AS r, bool_or(entity_type <> 'PERSON' AND NOT contains(entity_type, '_')) AS miss FROM ac GROUP BY id)
SELECT subject, speaker_role, count(*) AS rows, sum(n) AS total_seed_spans, count(*) FILTER (r > 0) AS redact_turns, count(*) FILTER (n >= 2) AS multispan_turns, count(*) FILTER (miss) AS baseline_miss_turns
FROM h JOIN keyed ON k = id GROUP BY ALL""")
def proxy_summary(spark, root):
    return S.proxy_summary(baseline_turns(spark, root), ["subject", "speaker_role"])


@query("j9_raw_text_lookup", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(coalesce(html, text)) AS digest FROM documents LEFT JOIN pages ON page_id = doc_id")
def raw_text_lookup(spark, root):
    """Raw text by row id where there is one, else the row's own text."""
    raw = I.load(spark, root, "pages").select(F.col("page_id").alias("doc_id"), "html")
    docs = I.load(spark, root, "documents").select("doc_id", "text")
    return docs.join(raw, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.md5(F.coalesce("html", "text")).alias("digest"))


@query("j5_interval_containment", f"{_IN_TURN} SELECT role AS speaker_role, count(*) AS n FROM it JOIN trn ON trn.id = it.id AND trn.turn = it.turn GROUP BY role")
def interval_containment(spark, root):
    base = transcripts(spark, root, WORD, moved=True, speakers=False)
    spans = S.resolve_spans(base).filter("resolution is not null").select("dialogue_id", F.col("resolved_start").alias("start"), F.col("resolved_end").alias("end"))
    turns = T.explode_rows(base, S.transcript_turns("transcript"), "t").select("dialogue_id", "t.turn_index", "t.speaker_role", "t.start", "t.end")
    placed = S.turns_of_spans(spans, turns)
    return placed.join(turns.select("dialogue_id", "turn_index", "speaker_role"), ["dialogue_id", "turn_index"]).groupBy("speaker_role").agg(F.count(F.lit(1)).alias("n"))
