"""Prompt and excerpt columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space, is_blank, rstrip_space, strip_space


def _line(name: str, value: Column) -> Column:
    """``name: value`` or null when the value is null or empty (``concat_ws`` skips nulls)."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))


def flat_prompt(subject, context, span, anchor=None, role=None, entity=None, intent=None) -> Column:
    always = lambda n, v: F.concat(F.lit(f"{n}: "), F.coalesce(v, F.lit("")))
    parts = [always("subject", subject), always("context", context), always("span", span)]
    for name, value in (("anchor", anchor), ("speaker_role", role), ("entity_type", entity), ("intent", intent)):
        if value is not None:
            parts.append(_line(name, value))
    return F.concat_ws("\n", *parts)


def mark_target(turn: Column, start: Column, end: Column) -> Column:
    """Turn text with ``[TGT]`` around valid offsets, else null."""
    ok = (turn != "") & (start >= 0) & (end > start) & (end <= F.length(turn))
    return F.when(ok, F.concat(
        F.substring(turn, F.lit(1), start), F.lit("[TGT]"), F.substring(turn, start + 1, end - start),
        F.lit("[/TGT]"), F.substring(turn, end + 1, F.length(turn)),
    ))


def marked_prompt(subject, context, span, turn, start, end, occurrence=None,
                  anchor=None, role=None, entity=None, intent=None) -> Column:
    """Prompt around the marked turn; falls back to the flat prompt."""
    marked = mark_target(turn, start, end)
    known = lambda v: F.when(v.isNull() | (v == ""), "unknown").otherwise(v) if v is not None else F.lit("unknown")
    parts = [
        F.concat(F.lit("subject: "), subject),
        F.concat(F.lit("speaker_role: "), known(role)),
        F.concat(F.lit("entity_type: "), known(entity)),
        F.concat(F.lit("target_turn: "), marked),
        F.concat(F.lit("span_text: "), span),
        F.concat(F.lit("local_context: "), context),
    ]
    if anchor is not None:
        parts.append(_line("anchor_text", anchor))
    if occurrence is not None:
        parts.append(F.concat(F.lit("tag_occurrence: "), occurrence.cast("string")))
    flat = flat_prompt(subject, context, span, anchor, role, entity, intent)
    return F.when(marked.isNotNull(), F.concat_ws("\n", *parts)).otherwise(flat)


def labelling_prompt(subject, context, span, optional: dict[str, Column] | None = None) -> Column:
    """Null when a required part is blank, so the row can be reported."""
    lines = [F.concat(F.lit(f"{n}: "), v) for n, v in (("subject", subject), ("context_text", context), ("span_text", span))]
    lines += [F.when(~is_blank(v), F.concat(F.lit(f"{n}: "), v)) for n, v in (optional or {}).items()]
    return F.when(~is_blank(subject) & ~is_blank(context) & ~is_blank(span), F.concat_ws("\n", *lines))


def span_excerpt(context: Column, span: Column, radius: int = 72) -> Column:
    """About ``radius`` characters either side of the first hit, with ellipses."""
    text = collapse_space(context)
    return excerpt_of(text, F.lower(text), span, radius)


def excerpt_of(text: Column, low: Column, span: Column, radius: int = 72) -> Column:
    """:func:`span_excerpt` where ``text`` is collapsed and ``low`` its lower case, made once for all spans of a text."""
    needle = strip_space(span)
    at = F.when(needle != "", F.position(F.lower(needle), low)).otherwise(F.lit(0))
    lo = F.greatest(F.lit(0), at - 1 - radius)
    hi = F.least(F.length(text), at - 1 + F.length(needle) + radius)
    cut = F.concat(
        F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo),
        F.when(hi < F.length(text), "...").otherwise(""),
    )
    head = F.concat(rstrip_space(F.substring(text, 1, radius * 2 - 3)), F.lit("..."))
    return F.when(text == "", "").when(at > 0, cut).when(F.length(text) <= radius * 2, text).otherwise(head)


def highlight(text: Column, start: Column, end: Column) -> Column:
    a = F.greatest(F.lit(0), F.least(start, F.length(text)))
    b = F.greatest(a, F.least(end, F.length(text)))
    marked = F.concat(
        F.substring(text, F.lit(1), a), F.lit("[["), F.substring(text, a + 1, b - a), F.lit("]]"),
        F.substring(text, b + 1, F.length(text)),
    )
    return F.when(start.isNull() | end.isNull(), text).otherwise(marked)


def offset_excerpt(text: Column, start: Column, end: Column, radius: int = 120) -> Column:
    n = F.length(text)
    a = F.greatest(F.lit(0), F.least(start, n))
    b = F.greatest(a, F.least(end, n))
    lo, hi = F.greatest(F.lit(0), a - radius), F.least(n, b + radius)
    cut = F.concat(
        F.when(lo > 0, "...").otherwise(""),
        highlight(F.substring(text, lo + 1, hi - lo), a - lo, b - lo),
        F.when(hi < n, "...").otherwise(""),
    )
    head = F.when(n <= radius * 2, text).otherwise(F.concat(F.substring(text, 1, radius * 2), F.lit("...")))
    return F.when(start.isNull() | end.isNull(), head).otherwise(cut)


def highlight_context(context: Column, role: Column, turn: Column, start: Column, end: Column) -> Column:
    """Replace the first occurrence of the target line by its highlighted form."""
    target = F.concat(role, F.lit(": "), turn)
    marked = F.concat(role, F.lit(": "), highlight(turn, start, end), F.lit("  <-- target"))
    at = F.position(target, context)
    swapped = F.concat(
        F.substring(context, F.lit(1), at - 1), marked,
        F.substring(context, at + F.length(target), F.length(context)),
    )
    usable = (context != "") & (turn != "") & (at > 0)
    return F.when(usable, swapped).otherwise(context)
