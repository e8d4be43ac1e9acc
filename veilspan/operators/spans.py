"""Transcripts, annotations and tags turned into turn, segment and span rows.

A transcript is one cell, so everything that only looks at one transcript (lines,
turns, segments, offset repair, containment) is done on arrays of that row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import SUPPORTED_ANNOTATION_TYPES, SUPPORTED_TAGS, TAG_PATTERN
from ..functions import labels as L
from ..functions import rules as R
from ..functions.text import SPACE_CLASS
from ..functions.tokens import bind, explode_rows, prefix_ends_sql, regex_spans_sql, sql_text, token_span_sql, with_tokens
from ..session import cut_lineage

# Line breaks as Python splits them, CRLF counting once.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Fixed speaker prefixes that open a turn.
SPEAKER_PATTERN = r"(?i)\A(student|volunteer):[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*"
SEARCH_RADIUS = 128


# --- tags ----------------------------------------------------------------------------------
def tag_spans(text: str, supported_only: bool = True) -> Column:
    """``array<struct<start,end,text,entity_type,occurrence>>`` of ``<TAG>`` placeholders.

    ``occurrence`` numbers equal tags within the text.
    """
    hits = regex_spans_sql(text, TAG_PATTERN.replace("(", "").replace(")", ""))
    kinds = ", ".join(f"'<{t}>'" for t in SUPPORTED_TAGS)
    kept = f"filter({hits}, h -> h.text in ({kinds}))" if supported_only else hits
    return F.expr(bind(kept, lambda hs: (
        f"transform({hs}, (h, i) -> named_struct('start', h.start, 'end', h.`end`, 'text', h.text, "
        f"'entity_type', substring(h.text, 2, length(h.text) - 2), "
        f"'occurrence', size(filter(slice({hs}, 1, i + 1), x -> x.text = h.text))))"
    )))


# --- offset repair -------------------------------------------------------------------------
def repair_offsets(df: DataFrame, text: str = "transcript", start: str = "start", end: str = "end",
                   target: str = "text") -> DataFrame:
    """Add ``resolved_start, resolved_end, resolution`` (null resolution: not found).

    Tried in order: exact, inclusive end, trimmed, trimmed inclusive, shifted right,
    nearest exact match within 128 characters (leftmost on ties).
    """
    n = F.length(text)
    s, e, want = F.col(start), F.col(end), F.col(target)
    part = lambda a, b: F.substring(F.col(text), a + 1, F.greatest(F.lit(0), b - a))
    inc = F.least(e + 1, n)
    lead = lambda x: F.length(F.regexp_extract(x, rf"\A[{SPACE_CLASS}]*", 0))
    bare = lambda x: F.regexp_replace(x, rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")
    out = lambda a, b, name: F.struct(a.cast("int").alias("s"), b.cast("int").alias("e"), F.lit(name).alias("r"))
    size = F.length(want)
    # The window is cut once; positions are then tried inside about 256 characters.
    near = F.expr(bind(
        f"named_struct('lo', int(greatest(0, {start} - {SEARCH_RADIUS})), 'hi', int(least(length({text}), "
        f"greatest({end}, {start}) + {SEARCH_RADIUS} + length({target}))), 's', int({start}), 'w', {target})",
        lambda v: bind(f"substring({text}, {v}.lo + 1, {v}.hi - {v}.lo)", lambda win: bind(
            f"array_min(transform(filter(sequence(0, greatest(0, length({win}) - length({v}.w))), "
            f"i -> substring({win}, i + 1, length({v}.w)) = {v}.w), i -> named_struct('d', abs({v}.lo + i - {v}.s), 'p', {v}.lo + i)))",
            lambda best: f"if({best} is null, null, named_struct('s', {best}.p, 'e', {best}.p + length({v}.w), 'r', 'local_search'))",
        )),
    ))
    found = F.coalesce(
        F.when(part(s, e) == want, out(s, e, "exact")),
        F.when(part(s, inc) == want, out(s, inc, "inclusive_end")),
        F.when(bare(part(s, e)) == want, out(s + lead(part(s, e)), s + lead(part(s, e)) + size, "trimmed")),
        F.when(bare(part(s, inc)) == want, out(s + lead(part(s, inc)), s + lead(part(s, inc)) + size, "trimmed_inclusive_end")),
        F.when((s + 1 <= n) & (part(s + 1, inc) == want), out(s + 1, inc, "shift_right")),
        F.when(size > 0, near),
    )
    held = df.select("*", F.inline_outer(F.array(F.struct(F.when(e >= s, found).alias("__o")))))
    return held.select(*df.columns, F.col("__o.s").alias("resolved_start"), F.col("__o.e").alias("resolved_end"),
                       F.col("__o.r").alias("resolution"))


def supported_annotations(content: str, annotations: str) -> Column:
    """Upper-cased supported types, their text re-read from the content."""
    kinds = ", ".join(f"'{t}'" for t in SUPPORTED_ANNOTATION_TYPES)
    return F.expr(
        f"transform(filter({annotations}, a -> upper(a.pii_type) in ({kinds})), a -> named_struct('start', a.start, "
        f"'end', a.`end`, 'text', substring({content}, a.start + 1, a.`end` - a.start), 'pii_type', upper(a.pii_type)))")


# --- lines, turns, segments ------------------------------------------------------------------
def lines_sql(text: str) -> str:
    """``array<struct<line,start,text>>``; breaks are not part of the text except VT, FF and kin."""
    keep = sql_text(rf"[^\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]*(?:{LINE_BREAK})|[^\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+")
    raw = f"if({text} = '', array(''), regexp_extract_all({text}, {keep}, 0))"

    def placed(rs):
        return bind(prefix_ends_sql(f"transform({rs}, r -> length(r))"), lambda es: (
            f"transform({rs}, (r, i) -> named_struct('line', i, 'start', get({es}, i) - length(r), "
            f"'text', regexp_replace(r, r'[\\r\\n]+\\z', '')))"
        ))

    return bind(raw, placed)


def transcript_lines(text: str) -> Column:
    return F.expr(lines_sql(text))


def transcript_turns(text: str) -> Column:
    return F.expr(transcript_turns_sql(text))


def transcript_turns_sql(text: str) -> str:
    """``array<struct<turn_index,speaker_role,start,end,text>>``.

    A speaker prefix opens a turn; other lines continue it; leading text is ``unknown``.
    """
    speaker = sql_text(SPEAKER_PATTERN)
    kind = "array<struct<speaker_role:string,start:int,end:int,text:string>>"

    def step(ls):
        opened = (
            f"named_struct('speaker_role', lower(regexp_extract(l.text, {speaker}, 1)), "
            f"'start', int(l.start + length(regexp_extract(l.text, {speaker}, 0))), 'end', int(l.start + length(l.text)), "
            f"'text', regexp_replace(l.text, {speaker}, ''))"
        )
        fresh = "named_struct('speaker_role', 'unknown', 'start', int(l.start), 'end', int(l.start + length(l.text)), 'text', l.text)"
        grown = (
            "concat(slice(a, 1, size(a) - 1), array(named_struct('speaker_role', element_at(a, -1).speaker_role, "
            "'start', element_at(a, -1).start, 'end', int(l.start + length(l.text)), "
            "'text', concat(element_at(a, -1).text, '\\n', l.text))))"
        )
        body = f"case when l.text rlike {speaker} then concat(a, array({opened})) when size(a) = 0 then array({fresh}) else {grown} end"
        return f"aggregate({ls}, cast(array() as {kind}), (a, l) -> cast({body} as {kind}))"

    return bind(bind(lines_sql(text), step), lambda ts: (
        f"transform({ts}, (t, i) -> named_struct('turn_index', i, 'speaker_role', t.speaker_role, 'start', t.start, "
        f"'end', t.`end`, 'text', t.text))"
    ))


def transcript_segments(text: str, spans: str) -> Column:
    return F.expr(transcript_segments_sql(text, spans))


def transcript_segments_sql(text: str, spans: str) -> str:
    """Lines merged where spans touch them: ``array<struct<segment,start_line,end_line,start,end>>``.

    ``spans`` is ``array<struct<start,end>>``.  Line ranges join when the next starts
    at most one line after the previous ends.
    """
    kind = L.SPANS

    def with_lines(ls):
        line_of = lambda p: f"(size(filter({ls}, l -> l.start <= {p})) - 1)"
        ranges = (
            f"array_sort(transform(filter({spans}, s -> s.`end` > s.start), s -> named_struct("
            f"'start', int({line_of('s.start')}), 'end', int({line_of('(s.`end` - 1)')}))))"
        )
        step = bind("try_element_at(a, -1)", lambda t: (
            f"if({t} is null or r.start > {t}.`end` + 1, concat(a, array(r)), concat(slice(a, 1, size(a) - 1), "
            f"array(named_struct('start', {t}.start, 'end', greatest({t}.`end`, r.`end`)))))"
        ))
        merged = f"aggregate({ranges}, cast(array() as {kind}), (a, r) -> cast({step} as {kind}))"

        def assemble(ms):
            heads = f"filter({ls}, l -> not exists({ms}, m -> l.line > m.start and l.line <= m.`end`))"
            end_line = f"coalesce(get(filter({ms}, m -> m.start = h.line), 0).`end`, h.line)"
            return bind(heads, lambda hs: (
                f"transform({hs}, (h, i) -> {bind(end_line, lambda e: f'''named_struct('segment', i, 'start_line', h.line, 'end_line', {e},
                 'start', h.start, 'end', get({ls}, {e}).start + length(get({ls}, {e}).text))''')})"
            ))

        return bind(merged, assemble)

    return bind(lines_sql(text), with_lines)


# --- projection -------------------------------------------------------------------------------
def resolve_spans(df: DataFrame) -> DataFrame:
    """Explode ``spans`` of a transcript, repair offsets, canonicalise types.

    ``df``: dialogue_id, transcript, spans array<struct<start,end,text,pii_type>>.
    """
    lo = f"int(greatest(0, s.start - {SEARCH_RADIUS}))"
    hi = f"int(greatest(s.`end`, s.start) + {SEARCH_RADIUS} + length(s.text))"
    # Each span travels with the part of the transcript a repair may look at, not the whole.
    cut = bind("transcript", lambda t: (
        f"transform(spans, s -> named_struct('base', {lo}, 'window', substring({t}, {lo} + 1, {hi} - {lo}), "
        f"'start', s.start - {lo}, 'end', s.`end` - {lo}, 'text', s.text, 'pii_type', s.pii_type))"))
    rows = explode_rows(df.select("dialogue_id", F.expr(cut).alias("__c")), F.col("__c"), "s").select(
        "dialogue_id", "s.base", "s.window", "s.start", "s.end", "s.text", F.coalesce("s.pii_type", F.lit("SUSPECT")).alias("raw_type"))
    back = {c: F.col(c) + F.col("base") for c in ("start", "end", "resolved_start", "resolved_end")}
    return repair_offsets(rows, "window").withColumns(back).drop("base", "window").withColumn("type", R.canonical_type(F.col("raw_type")))


def resolved_arrays(df: DataFrame) -> DataFrame:
    """``annotated``: all spans of a dialogue (bounded by one transcript), repaired where that is possible."""
    packed = F.struct(
        F.col("resolved_start").alias("start"), F.col("resolved_end").alias("end"), "type", "raw_type", "resolution",
        F.col("start").alias("source_start"), F.col("end").alias("source_end"), "text")
    return resolve_spans(df).groupBy("dialogue_id").agg(F.array_sort(F.collect_list(packed)).alias("annotated"))


ANNOTATED = ("array<struct<start:int,end:int,type:string,raw_type:string,resolution:string,source_start:int,source_end:int,"
             "text:string>>")


def place_spans(df: DataFrame, unit: str) -> DataFrame:
    """``dialogue_id, units, resolved, lost``: units of text with the spans that lie in one, and the spans that lie in none.

    ``unit`` is ``turn`` or ``segment``.  ``lost`` says why: the text is not near the offsets, no single unit holds the
    span, or it covers no token.  A span is in ``resolved`` or in ``lost``, never in both and never in neither.
    """
    held = df.join(resolved_arrays(df), "dialogue_id", "left").withColumn(
        "annotated", F.coalesce("annotated", F.expr(f"cast(array() as {ANNOTATED})")))
    if unit == "turn":
        units = bind("transcript", lambda t: transcript_turns_sql(t))
        units = (f"transform({units}, u -> named_struct('unit_index', u.turn_index, 'speaker_role', u.speaker_role, "
                 f"'start', u.start, 'end', u.`end`, 'text', u.text))")
    elif unit == "segment":
        found = "filter(annotated, s -> s.resolution is not null)"
        units = bind("transcript", lambda t: (
            f"transform({transcript_segments_sql(t, found)}, g -> named_struct('unit_index', g.segment, "
            f"'speaker_role', cast(null as string), 'start', g.start, 'end', g.`end`, "
            f"'text', substring({t}, g.start + 1, g.`end` - g.start)))"))
    else:
        raise ValueError(unit)

    def judged(us):
        inside = f"exists({us}, u -> s.start >= u.start and s.`end` <= u.`end`)"
        reason = (f"case when s.resolution is null then 'text not nearby' when not {inside} then 'in no single {unit}' "
                  f"when not s.text rlike {sql_text(f'[^{SPACE_CLASS}]')} then 'no token' end")
        marked = f"transform(annotated, s -> named_struct('s', s, 'reason', {reason}))"
        return bind(marked, lambda ms: (
            f"named_struct('units', {us}, "
            f"'resolved', transform(filter({ms}, m -> m.reason is null), m -> m.s), "
            f"'lost', transform(filter({ms}, m -> m.reason is not null), m -> named_struct('start', m.s.source_start, "
            f"'end', m.s.source_end, 'text', m.s.text, 'raw_type', m.s.raw_type, 'reason', m.reason)))"))

    # Generated, not projected: the optimiser would copy the units into every use of them.
    return held.select("dialogue_id", F.inline_outer(F.array(F.expr(bind(units, judged)))))


def unit_rows(placed: DataFrame, unit: str) -> DataFrame:
    """Tokens, labels and local spans of each unit that is not blank."""
    rows = explode_rows(placed.select("dialogue_id", "units", "resolved"), F.col("units"), "u").select(
        "dialogue_id", "u.unit_index", "u.speaker_role", F.col("u.start").alias("unit_start"), F.col("u.end").alias("unit_end"),
        "u.text", "resolved")
    local = (
        "transform(filter(resolved, s -> s.start >= unit_start and s.`end` <= unit_end), s -> named_struct("
        "'start', int(s.start - unit_start), 'end', int(s.`end` - unit_start), 'type', s.type, 'raw_type', s.raw_type))"
    )
    held = with_tokens(rows.filter(F.col("text").rlike(f"[^{SPACE_CLASS}]"))).withColumn("local", F.expr(local))
    spans = L.project_spans_sql("starts", "ends", "local")
    out = held.withColumn("token_spans", F.expr(spans)).withColumn(
        "labels", L.labels_from_token_spans("size(tokens)", "token_spans"))
    names = lambda f: F.expr(f"array_join(array_sort(array_distinct(transform(local, s -> s.{f}))), ',')")
    out = out.withColumn("id", F.concat_ws("-", "dialogue_id", F.lit(unit), F.col("unit_index").cast("string"))).withColumn(
        "types", names("type")).withColumn("raw_types", names("raw_type"))
    return out if unit == "turn" else out.drop("speaker_role")


def lost_spans(placed: DataFrame) -> DataFrame:
    """``dialogue_id, start, end, text, raw_type, reason`` of the spans that lie in no unit; offsets are those of the annotation."""
    return explode_rows(placed.select("dialogue_id", "lost"), F.col("lost"), "s").select("dialogue_id", "s.*")


def _project(df: DataFrame, unit: str) -> DataFrame:
    """``unit_rows`` whose job fails at the first dialogue with a lost span; nothing runs before that job."""
    placed = place_spans(df, unit)
    told = F.concat(F.lit("spans that lie in no "), F.lit(unit), F.lit(" of dialogue "), F.col("dialogue_id"), F.lit(": "),
                    F.to_json(F.slice("lost", 1, 5)))
    sound = F.when(F.size("lost") == 0, F.col("units")).otherwise(F.raise_error(told))
    return unit_rows(placed.withColumn("units", sound), unit)


def project_turns(df: DataFrame) -> DataFrame:
    """Candidate rows per turn; a span belongs to the turn that contains it, and one that no turn contains fails the job."""
    return _project(df, "turn")


def project_segments(df: DataFrame) -> DataFrame:
    """Candidate rows per segment; every span lands in exactly one, or the job fails."""
    return _project(df, "segment")


class Quarantined(NamedTuple):
    rows: DataFrame  # unit rows, without the lost spans
    lost: DataFrame
    counts: dict[str, int]  # dialogues, placed and lost spans


def project_with_quarantine(df: DataFrame, unit: str) -> Quarantined:
    """One job that writes what ``place_spans`` gives; rows and lost spans are both read from it, counts come from the job."""
    seen = Observation()
    placed = place_spans(df, unit)
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    table = cut_lineage(placed.observe(seen, F.count(F.lit(1)).alias("dialogues"), count("resolved"), count("lost")))
    found = seen.get
    return Quarantined(unit_rows(table, unit), lost_spans(table),
                       {"dialogues": found["dialogues"], "placed": found["resolved"], "lost": found["lost"]})


def unprojected(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Dialogues whose spans were not all projected exactly once."""
    want = resolve_spans(df).groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("want"))
    got = rows.groupBy("dialogue_id").agg(F.sum(F.size("token_spans")).alias("got"))
    both = want.join(got, "dialogue_id", "left").select("dialogue_id", "want", F.coalesce("got", F.lit(0)).alias("got"))
    return both.filter("want <> got")


def turns_of_spans(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Span-in-turn containment as a join: the dialogue is the equi key, first turn wins."""
    s, t = spans.alias("s"), turns.alias("t")
    inside = (F.col("s.dialogue_id") == F.col("t.dialogue_id")) & (F.col("t.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("t.end"))
    return s.join(t, inside).groupBy("s.dialogue_id", "s.start", "s.end").agg(F.min("t.turn_index").alias("turn_index"))


# --- action rows as candidate turns --------------------------------------------------------------
def turns_from_actions(actions: DataFrame, order: str = "ord") -> DataFrame:
    """Action rows regrouped into candidate turns.

    ``actions``: id, dialogue_id, turn_index, subject, speaker_role, turn_text, context_text,
    anchor_text, tag_start, tag_end, action_label, entity_type, plus the file order.
    Distinct spans are found before the turn is grouped, so what is collected per
    turn is bounded by the turn's own text.
    """
    key = F.when(F.col("dialogue_id").isNotNull() & F.col("turn_index").isNotNull(),
                 F.concat(F.col("dialogue_id"), F.lit("-turn-"), F.col("turn_index").cast("string"))
                 ).otherwise(F.element_at(F.split("id", "-tag-", 2), 1))
    rows = actions.filter("turn_text <> ''").withColumn("turn_id", key)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))).alias(c)
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(order))).alias(c)
    turns = rows.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("action_row_count"), first("dialogue_id"), first("speaker_role"),
        F.min_by("subject", order).alias("subject"), F.min_by("turn_text", order).alias("text"),
        longest("anchor_text"), longest("context_text"))
    spans = rows.filter("tag_end > tag_start").groupBy("turn_id", "tag_start", "tag_end").agg(
        F.min_by(F.struct("action_label", "entity_type"), order).alias("a"))
    seeds = spans.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("tag_start").cast("int").alias("start"), F.col("tag_end").cast("int").alias("end"),
        F.col("a.action_label").alias("action_label"), F.col("a.entity_type").alias("entity_type")))).alias("chars"))
    both = with_tokens(turns.join(seeds, "turn_id", "left")).filter("size(tokens) > 0")
    token = bind("named_struct('a', starts, 'b', ends)", lambda p: (
        f"transform(chars, c -> named_struct('t', {token_span_sql(f'{p}.a', f'{p}.b', 'c.start', 'c.`end`')}, 'c', c))"))
    held = both.withColumn("__t", F.expr(token)).withColumn("seeds", F.expr(
        "coalesce(transform(filter(__t, x -> x.t is not null), x -> named_struct('start', x.t.start, 'end', x.t.`end`, "
        "'span_text', substring(text, x.c.start + 1, x.c.`end` - x.c.start), 'action_label', x.c.action_label, "
        "'entity_type', x.c.entity_type)), array())"))
    out = held.drop("__t", "chars").withColumn("labels", L.labels_from_token_spans("size(tokens)", "seeds"))
    redact = F.expr("size(filter(seeds, s -> s.action_label = 'REDACT'))")
    return out.withColumns({
        "seed_count": F.size("seeds"), "redact_seed_count": redact,
        "has_multispan_seed": F.size("seeds") >= 2, "has_redact_seed": redact > 0})


def baseline_coverage(turns: DataFrame, predictions: DataFrame) -> DataFrame:
    """Covered and missed seeds per turn under a baseline's labels; turns without prediction stay null."""
    both = turns.join(predictions.select("turn_id", "predicted_labels"), "turn_id", "left").withColumn(
        "__p", L.spans_lenient("predicted_labels"))
    hit = f"exists(__p, p -> {L.overlap_sql('s', 'p')})"
    covered = F.expr(f"filter(seeds, s -> {hit})")
    out = both.withColumn("__c", covered)
    red = lambda arr: f"size(filter({arr}, s -> s.action_label = 'REDACT'))"
    known = F.col("predicted_labels").isNotNull()
    return out.withColumns({
        "baseline_positive": F.when(known, F.expr("size(__p) > 0")),
        "covered": F.when(known, F.expr("size(__c)")), "missed": F.when(known, F.expr("size(seeds) - size(__c)")),
        "covered_redact": F.when(known, F.expr(red("__c"))),
        "missed_redact": F.when(known, F.expr(f"{red('seeds')} - {red('__c')}")),
        "missed_any": F.when(known, F.expr("size(seeds) > size(__c)")),
    }).drop("__p", "__c", "predicted_labels")


def proxy_summary(turns: DataFrame, keys: list[str]) -> DataFrame:
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("seed_count").alias("total_seed_spans"),
        F.count_if("has_redact_seed").alias("redact_turns"), F.count_if("has_multispan_seed").alias("multispan_turns"),
        F.count_if(F.coalesce("missed_any", F.lit(False))).alias("baseline_miss_turns"))
