"""Neighbour context, anchors, prompts and excerpts (W1-W13) over whole conversations."""

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.text import collapse_space
from ..operators import context as C
from . import inputs as I
from .registry import query

_W = "OVER (PARTITION BY dialogue_id ORDER BY turn_index)"
_SNIP = "speaker_role || ': ' || {t}"


def _context(t):
    s = _SNIP.format(t=t)
    return f"concat_ws(chr(10), lag({s}) {_W}, {s}, lead({s}) {_W})"


@query("w1_neighbour_context", f"WITH {I.TURNS_SQL} SELECT dialogue_id, turn_index, {_context('text')} AS context_text FROM turns")
def neighbour_context(spark, root):
    """Small chunks here, so long dialogues also pass through the edge join."""
    return C.neighbour_context(I.turns(spark, root), chunk=3).select("dialogue_id", "turn_index", "context_text")


@query("w2_neighbour_context_normalised", f"WITH {I.TURNS_SQL} SELECT dialogue_id, turn_index, {_context(I.collapse_sql('text'))} AS context_text FROM turns")
def neighbour_context_normalised(spark, root):
    return C.neighbour_context_normalised(I.turns(spark, root)).select("dialogue_id", "turn_index", "context_text")


@query("w3_radius_context", f"""WITH {I.TURNS_SQL} SELECT dialogue_id, turn_index, array_to_string(list({_SNIP.format(t='text')}) OVER (PARTITION BY dialogue_id ORDER BY turn_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context_text FROM turns""")
def radius_context(spark, root):
    return C.radius_context(I.turns(spark, root), 2).select("dialogue_id", "turn_index", "context_text")


# Turns of one speaker are blanked so that there is something to skip.
_BLANK = f"""b AS (SELECT * EXCLUDE (text), CASE WHEN length(text) < 150 THEN ' ' ELSE text END AS text FROM turns),
nb AS (SELECT *, CASE WHEN trim(text) <> '' THEN text END AS x, CASE WHEN trim(text) <> '' THEN speaker_role END AS xr FROM b)"""
_P = "OVER (PARTITION BY dialogue_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_N = "OVER (PARTITION BY dialogue_id ORDER BY turn_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query("w4_nonblank_neighbours", f"""WITH {I.TURNS_SQL}, {_BLANK} SELECT dialogue_id, turn_index, last_value(x IGNORE NULLS) {_P} AS prev_text, last_value(xr IGNORE NULLS) {_P} AS prev_role,
  first_value(x IGNORE NULLS) {_N} AS next_text, first_value(xr IGNORE NULLS) {_N} AS next_role FROM nb""")
def nonblank_neighbours(spark, root):
    df = I.turns(spark, root).withColumn("text", F.when(F.length("text") < 150, " ").otherwise(F.col("text")))
    return C.nonblank_neighbours(df, chunk=2).select("dialogue_id", "turn_index", "prev_text", "prev_role", "next_text", "next_role")


@query("w5_session_anchor", f"""WITH {I.TURNS_SQL}, f AS (SELECT dialogue_id, string_agg(speaker_role || ': ' || t, ' | ' ORDER BY turn_index) AS a FROM (
  SELECT *, {I.collapse_sql('text')} AS t, row_number() OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS k FROM turns WHERE {I.collapse_sql('text')} <> '') WHERE k <= 3 GROUP BY dialogue_id)
SELECT dialogue_id, CASE WHEN length(a) <= 180 THEN a ELSE rtrim(substring(a, 1, 177)) || '...' END AS anchor_text FROM f""")
def session_anchor(spark, root):
    return C.session_anchor(I.turns(spark, root))


def _windowed(spark, root):
    from ..functions.tokens import with_tokens

    df = C.nonblank_neighbours(I.turns(spark, root))
    return with_tokens(df).withColumn("labels", F.transform("tokens", lambda t: F.when(t.rlike(r"^\p{Lu}"), "B-SUSPECT").otherwise("O")))


def _toks(text):
    return f"regexp_extract_all({text}, '{I.TOKEN_PATTERN}')"


_WIN = f"""WITH {I.TURNS_SQL}, wn AS (SELECT *, lag(text) {_W} AS pt, lag(speaker_role) {_W} AS pr, lead(text) {_W} AS nt, lead(speaker_role) {_W} AS nr FROM turns)"""
_SPK = f"""list_concat(list_concat(list_concat(CASE WHEN pt IS NULL THEN [] ELSE list_concat([pr || ':'], {_toks('pt')}) END, ['<CUR>', speaker_role || ':']), {_toks('text')}),
  list_concat(['</CUR>'], CASE WHEN nt IS NULL THEN [] ELSE list_concat([nr || ':'], {_toks('nt')}) END))"""


@query("w6_marked_window_tokens", f"{_WIN} SELECT dialogue_id, turn_index, array_to_string({_SPK}, ' ') AS model_tokens, CAST(len({_toks('text')}) AS BIGINT) AS n_decoded, CASE WHEN pt IS NULL THEN 0 ELSE 1 + len({_toks('pt')}) END + 2 AS first_at FROM wn")
def marked_window_tokens(spark, root):
    out = C.model_inputs(_windowed(spark, root), "speaker_marked_window_v1")
    return out.select("dialogue_id", "turn_index", F.array_join("model_tokens", " ").alias("model_tokens"),
                      F.expr("size(filter(decode_map, d -> d >= 0))").cast("long").alias("n_decoded"),
                      (F.array_position("decode_map", 0) - 1).alias("first_at"))


@query("w7_input_formats", f"""{_WIN} SELECT input_format, sum(n) AS model_tokens, sum(p) AS pair_tokens FROM (
  SELECT 'turn_only_v1' AS input_format, len({_toks('text')}) AS n, 0 AS p FROM wn UNION ALL
  SELECT 'pair_context_v1', len({_toks('text')}), coalesce(len({_toks('pt')}), 0) FROM wn UNION ALL
  SELECT 'marked_window_v1', len({_SPK}) - 1 - CASE WHEN pt IS NULL THEN 0 ELSE 1 END - CASE WHEN nt IS NULL THEN 0 ELSE 1 END, 0 FROM wn UNION ALL
  SELECT 'speaker_marked_window_v1', len({_SPK}), 0 FROM wn) GROUP BY input_format""")
def input_formats(spark, root):
    base = _windowed(spark, root).withColumn("context_text", F.col("prev_text"))
    out = None
    for name, mode in (("turn_only_v1", None), (None, "pair"), ("marked_window_v1", None), ("speaker_marked_window_v1", None)):
        part = C.model_inputs(base, name, mode).groupBy("input_format").agg(
            F.sum(F.size("model_tokens")).alias("model_tokens"), F.sum(F.size("pair_tokens")).alias("pair_tokens"))
        out = part if out is None else out.unionByName(part)
    return out


@query("w8_word_decode", f"{_WIN}, k AS (SELECT dialogue_id || '-' || turn_index AS id, unnest({_toks('text')}) AS token FROM wn) SELECT id, count(*) AS n_tokens, count(*) FILTER (regexp_matches(token, '^\\p{{Lu}}')) AS n_positive FROM k GROUP BY id")
def word_decode(spark, root):
    """Every word becomes two pieces with different labels; the first piece must win."""
    df = C.model_inputs(_windowed(spark, root), "marked_window_v1")
    df = df.withColumn("word_ids", F.expr("flatten(transform(sequence(0, size(model_tokens) - 1), i -> array(i, i)))"))
    df = df.withColumn("predicted", F.expr("flatten(transform(word_labels, l -> array(l, 'I-SUSPECT')))"))
    df = df.withColumn("decoded", C.decode_words("size(tokens)", "decode_map", "word_ids", "predicted")).filter("size(tokens) > 0")
    return df.select(F.concat_ws("-", "dialogue_id", F.col("turn_index").cast("string")).alias("id"), F.size("decoded").cast("long").alias("n_tokens"),
                     F.expr("size(filter(decoded, x -> x <> 'O'))").cast("long").alias("n_positive"))


_TAGROWS = f"""WITH {I.TAGGED_SQL}, keyed AS (SELECT dialogue_id || '-' || turn_index AS k, * FROM tagged), {I._matches('tg', '<[A-Z_]+>', 'keyed', 'k')},
it AS (SELECT k AS id, subject, speaker_role, text, txt AS span, substring(txt, 2, length(txt) - 2) AS et, s, e FROM tg_chars JOIN keyed ON k = tg_chars.id)"""


def _items(spark, root, **per_turn):
    """``per_turn``: more columns, worked out once for each turn and not for each of its tags."""
    from ..functions.tokens import explode_rows
    from ..operators.spans import tag_spans

    df = I.tagged_turns(spark, root).withColumn("id", F.concat_ws("-", "dialogue_id", F.col("turn_index").cast("string")))
    for name, column in per_turn.items():
        df = df.withColumn(name, column)
    rows = explode_rows(df, tag_spans("text", supported_only=False), "h")
    return rows.select("id", "subject", "speaker_role", "text", F.col("h.text").alias("span"), F.col("h.entity_type").alias("et"), F.col("h.start").alias("s"), F.col("h.end").alias("e"), *per_turn)


@query("w9_flat_prompt", f"{_TAGROWS} SELECT id, s AS tag_start, md5(concat_ws(chr(10), 'subject: ' || subject, 'context: ' || text, 'span: ' || span, 'speaker_role: ' || speaker_role, 'entity_type: ' || et)) AS prompt FROM it")
def flat_prompt(spark, root):
    c = F.col
    return _items(spark, root).select("id", c("s").cast("long").alias("tag_start"), F.md5(P.flat_prompt(
        c("subject"), c("text"), c("span"), F.lit(None).cast("string"), c("speaker_role"), c("et"))).alias("prompt"))


@query("w10_marked_prompt", f"""{_TAGROWS} SELECT id, s AS tag_start, md5(CASE WHEN e - 1 <= length(text) AND s - 1 >= 0 THEN concat_ws(chr(10), 'subject: ' || subject, 'speaker_role: ' || speaker_role, 'entity_type: ' || et,
  'target_turn: ' || substring(text, 1, s - 1) || '[TGT]' || substring(text, s, e - s) || '[/TGT]' || substring(text, e), 'span_text: ' || span, 'local_context: ' || text)
  ELSE concat_ws(chr(10), 'subject: ' || subject, 'context: ' || text, 'span: ' || span, 'speaker_role: ' || speaker_role, 'entity_type: ' || et) END) AS prompt FROM it""")
def marked_prompt(spark, root):
    """Offsets one to the left, so a tag at position 0 falls back to the flat form."""
    c = F.col
    return _items(spark, root).select("id", c("s").cast("long").alias("tag_start"), F.md5(P.marked_prompt(
        c("subject"), c("text"), c("span"), c("text"), c("s") - 1, c("e") - 1, role=c("speaker_role"), entity=c("et"))).alias("prompt"))


@query("w11_labelling_prompt", f"{_TAGROWS} SELECT id, s AS tag_start, md5(concat_ws(chr(10), 'subject: ' || subject, 'context_text: ' || text, 'span_text: ' || span, 'speaker_role: ' || speaker_role)) AS prompt FROM it")
def labelling_prompt(spark, root):
    c = F.col
    return _items(spark, root).select("id", c("s").cast("long").alias("tag_start"), F.md5(P.labelling_prompt(
        c("subject"), c("text"), c("span"), {"anchor_text": F.lit("  "), "speaker_role": c("speaker_role")})).alias("prompt"))


_EX = f"""{_TAGROWS}, cx AS (SELECT *, {I.collapse_sql('text')} AS c FROM it), hit_at AS (SELECT *, instr(lower(c), lower(span)) - 1 AS a FROM cx)"""


@query("w12_span_excerpt", f"""{_EX} SELECT id, s AS tag_start, CASE WHEN a - 72 > 0 THEN '...' ELSE '' END || substring(c, greatest(a - 72, 0) + 1, least(length(c), a + length(span) + 72) - greatest(a - 72, 0))
  || CASE WHEN a + length(span) + 72 < length(c) THEN '...' ELSE '' END AS excerpt FROM hit_at""")
def span_excerpt(spark, root):
    rows = _items(spark, root, flat=collapse_space(F.col("text")), low=F.lower("flat"))
    return rows.select("id", F.col("s").cast("long").alias("tag_start"), P.excerpt_of(F.col("flat"), F.col("low"), F.col("span")).alias("excerpt"))


@query("w13_offset_excerpt", f"""{_TAGROWS} SELECT id, s AS tag_start, CASE WHEN s > 120 THEN '...' ELSE '' END || substring(text, greatest(0, s - 120) + 1, s - greatest(0, s - 120)) || '[[' || span || ']]' ||
  substring(text, e + 1, 120) || CASE WHEN e + 120 < length(text) THEN '...' ELSE '' END AS excerpt FROM it""")
def offset_excerpt(spark, root):
    return _items(spark, root).select("id", F.col("s").cast("long").alias("tag_start"), P.offset_excerpt(F.col("text"), F.col("s"), F.col("e")).alias("excerpt"))
