"""Label arrays <-> spans, all within a row.

Names ending in ``_sql`` map SQL text to SQL text; the others wrap them as columns.
Spans are ``struct<start,end>`` over tokens unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BEGIN, INSIDE, OUTSIDE
from .tokens import bind, regex_spans_sql, token_span_sql, token_spans_in_text_sql

SPANS = "array<struct<start:int,end:int>>"


def _bounds(spans: str) -> str:
    return f"transform({spans}, s -> named_struct('start', int(s.start), 'end', int(s.`end`)))"


# --- readers -----------------------------------------------------------------------------
def label_codes_sql(labels: str) -> str:
    """One letter per label, so span readers become one regex pass."""
    return (
        f"array_join(transform({labels}, x -> case x when '{BEGIN}' then 'B' when '{INSIDE}' then 'I' else 'O' end), '')"
    )


def _any_label(labels: str, spans: str) -> str:
    """Most rows hold no span; they skip the reader."""
    present = f"(array_contains({labels}, '{BEGIN}') or array_contains({labels}, '{INSIDE}'))"
    return f"if({labels} is null, null, if({present}, {spans}, cast(array() as {SPANS})))"


def spans_lenient_sql(labels: str) -> str:
    return _any_label(labels, _bounds(regex_spans_sql(label_codes_sql(labels), "BI*")))


def spans_scoring_sql(labels: str) -> str:
    return _any_label(labels, _bounds(regex_spans_sql(label_codes_sql(labels), "BI*|I+")))


def spans_lenient(labels: str) -> Column:
    """A span opens only at B; an orphan I is ignored."""
    return F.expr(spans_lenient_sql(labels))


def spans_scoring(labels: str) -> Column:
    """The chunk reading used for P/R/F1: an orphan I opens a span."""
    return F.expr(spans_scoring_sql(labels))


def has_positive(labels: str) -> Column:
    return F.expr(f"size(array_remove({labels}, '{OUTSIDE}')) > 0")


def positive_count(labels: str) -> Column:
    return F.expr(f"size(array_remove({labels}, '{OUTSIDE}'))")


# --- writers -----------------------------------------------------------------------------
def _paint(count: str, ordered: str) -> str:
    """Labels from spans in painting order: the last span covering a token wins."""
    def painted(spans):
        cover = f"filter({spans}, s -> s.start <= i and i < s.`end`)"
        label = bind(
            f"try_element_at({cover}, -1)",
            lambda t: f"case when {t} is null then '{OUTSIDE}' when {t}.start = i then '{BEGIN}' else '{INSIDE}' end",
        )
        # Disjoint spans (the usual case) are laid end to end; only overlaps need a look per token.
        before = f"if(i = 0, 0, get({spans}, i - 1).`end`)"
        laid = (
            f"concat(flatten(transform({spans}, (s, i) -> concat(array_repeat('{OUTSIDE}', s.start - {before}), array('{BEGIN}'), "
            f"array_repeat('{INSIDE}', s.`end` - s.start - 1)))), "
            f"array_repeat('{OUTSIDE}', {count} - element_at({spans}, -1).`end`))"
        )
        crossing = f"exists(sequence(0, size({spans}) - 1), i -> i > 0 and get({spans}, i).start < get({spans}, i - 1).`end`)"
        return (
            f"case when size({spans}) = 0 or {count} = 0 then array_repeat('{OUTSIDE}', {count}) "
            f"when {crossing} then transform(sequence(0, greatest({count}, 1) - 1), i -> {label}) else {laid} end"
        )

    return bind(ordered, painted)


def labels_from_token_spans(count: str, spans: str) -> Column:
    """Token spans painted in (start, end) order; spans out of range are skipped."""
    return F.expr(bind(count, lambda n: _paint(n, (
        f"filter(array_sort({_bounds(spans)}), s -> s.start >= 0 and s.`end` <= {n} and s.`end` > s.start)"
    ))))


def project_spans_sql(starts: str, ends: str, spans: str) -> str:
    """Character spans (in order) to token spans; those touching no token vanish."""
    return bind(f"named_struct('a', {starts}, 'b', {ends})", lambda p: (
        f"filter(transform({spans}, s -> {token_span_sql(f'{p}.a', f'{p}.b', 's.start', 's.`end`')}), t -> t is not null)"
    ))


def labels_from_char_spans(starts: str, ends: str, spans: str) -> Column:
    """Annotations painted in (start, end) order, each overwriting the earlier."""
    return F.expr(_paint(f"size({starts})", project_spans_sql(starts, ends, f"array_sort({_bounds(spans)})")))


def merge_intervals_sql(spans: str) -> str:
    """Union of character intervals; touching intervals join."""
    step = bind("try_element_at(acc, -1)", lambda t: (
        f"if({t} is null or s.start > {t}.`end`, concat(acc, array(s)), "
        f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {t}.start, 'end', greatest({t}.`end`, s.`end`)))))"
    ))
    return f"aggregate(array_sort({_bounds(spans)}), cast(array() as {SPANS}), (acc, s) -> cast({step} as {SPANS}))"


def merge_intervals(spans: str) -> Column:
    return F.expr(merge_intervals_sql(spans))


def labels_from_merged_spans(starts: str, ends: str, spans: str) -> Column:
    return F.expr(_paint(f"size({starts})", project_spans_sql(starts, ends, merge_intervals_sql(spans))))


def labels_to_mask(labels: str) -> Column:
    return F.expr(f"transform({labels}, x -> x <> '{OUTSIDE}')")


def mask_to_labels(mask: str) -> Column:
    """Runs of true become B I I ...; adjacent spans fuse."""
    return F.expr(bind(mask, lambda ms: (
        f"transform({ms}, (m, i) -> case when not m then '{OUTSIDE}' "
        f"when coalesce(get({ms}, i - 1), false) then '{INSIDE}' else '{BEGIN}' end)"
    )))


def labels_of_text(text: str, tokens: str, spans: str) -> Column:
    """Merged character spans as labels, for rows whose token offsets nobody else needs.

    Tokens are counted up to the spans, only where the row holds one; no offsets are worked out.
    """
    painted = bind(f"size({tokens})", lambda n: _paint(n, token_spans_in_text_sql(text, merge_intervals_sql(spans))))
    return F.expr(f"if(size({spans}) = 0, array_repeat('{OUTSIDE}', size({tokens})), {painted})")


# --- span predicates and views -------------------------------------------------------------
def overlap_sql(a: str, b: str) -> str:
    return f"({a}.start < {b}.`end` and {b}.start < {a}.`end`)"


def overlaps_any(span: str, others: str) -> Column:
    return F.expr(bind(span, lambda s: f"exists({others}, o -> {overlap_sql(s, 'o')})"))


def overlap_count(span: str, others: str) -> Column:
    return F.expr(bind(span, lambda s: f"size(filter({others}, o -> {overlap_sql(s, 'o')}))"))


def span_text_sql(tokens: str, span: str) -> str:
    return f"array_join(slice({tokens}, {span}.start + 1, {span}.`end` - {span}.start), ' ')"


def span_text(tokens: str, span: str) -> Column:
    return F.expr(span_text_sql(tokens, span))


def _part(tokens: str, a: str, b: str) -> str:
    return f"slice({tokens}, {a} + 1, greatest(0, {b} - ({a})))"


def preview(tokens: str, span: str, window: int = 8) -> Column:
    """Tokens around a span with ``[[`` and ``]]`` around it."""
    s, e = f"{span}.start", f"{span}.`end`"
    lo, hi = f"greatest(0, {s} - {window})", f"least(size({tokens}), {e} + {window})"
    return F.expr(
        f"array_join(concat({_part(tokens, lo, s)}, array('[['), {_part(tokens, s, e)}, array(']]'), "
        f"{_part(tokens, e, hi)}), ' ')"
    )


def masked_preview(tokens: str, target: str, gold: str, pred: str, window: int = 6) -> Column:
    """Preview with spans replaced by markers; the first marker at a position wins.

    Walks the markers (few) rather than the tokens: a marker only counts when its
    start is not already hidden behind an earlier marker.
    """
    def walk(t):
        def marks(spans, rank, name):
            return (
                f"transform(filter({spans}, s -> not (s.start = {t}.s and s.`end` = {t}.e) "
                f"and s.`end` > {t}.lo and s.start < {t}.hi and s.start >= {t}.lo), "
                f"s -> named_struct('start', s.start, 'end', s.`end`, 'rank', {rank}, 'mark', '{name}'))"
            )

        own = f"array(named_struct('start', {t}.s, 'end', {t}.e, 'rank', 0, 'mark', '[TARGET_SPAN]'))"
        ordered = f"array_sort(concat({own}, {marks(gold, 1, '[GOLD_SPAN]')}, {marks(pred, 2, '[PRED_SPAN]')}))"
        step = (
            f"if(m.start < a.at, a, named_struct('at', m.`end`, 'out', "
            f"concat(a.out, {_part(f'{t}.w', 'a.at', 'm.start')}, array(m.mark))))"
        )
        done = f"aggregate({ordered}, named_struct('at', {t}.lo, 'out', cast(array() as array<string>)), (a, m) -> {step})"
        return bind(done, lambda d: f"array_join(concat({d}.out, {_part(f'{t}.w', f'{d}.at', f'{t}.hi')}), ' ')")

    s, e = f"{target}.start", f"{target}.`end`"
    return F.expr(bind(
        f"named_struct('s', {s}, 'e', {e}, 'lo', greatest(0, {s} - {window}), "
        f"'hi', least(size({tokens}), {e} + {window}), 'w', {tokens})",
        walk,
    ))


def find_subsequence(tokens: str, target: str) -> Column:
    """First case-folded occurrence of ``target`` in ``tokens``; null when empty or absent."""
    from .text import SPACE_CLASS
    from .tokens import sql_text

    key = lambda arr: (
        f"transform({arr}, t -> replace(lower(trim(regexp_replace(t, {sql_text(f'[{SPACE_CLASS}]+')}, ' '))), 'ß', 'ss'))"
    )

    def search(p):
        m = f"size({p}.w)"
        starts = (
            f"if({m} > 0 and size({p}.h) >= {m}, filter(sequence(0, greatest(size({p}.h) - {m}, 0)), "
            f"i -> get({p}.h, i) = get({p}.w, 0) and slice({p}.h, i + 1, {m}) = {p}.w), null)"
        )
        return bind(f"get({starts}, 0)", lambda at: (
            f"if({at} is null, null, named_struct('start', {at}, 'end', {at} + {m}))"))

    return F.expr(bind(
        f"named_struct('h', {key(tokens)}, 'w', filter({key(target)}, t -> t <> ''))", search))
