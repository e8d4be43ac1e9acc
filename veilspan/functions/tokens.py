"""Tokens with code-point offsets, and regex matches with code-point offsets.

Both are computed inside one row with built-in array functions, so no operator
that needs offsets has to shuffle.  Offsets are sums of ``length()`` values (code
points), never positions from the regex engine (UTF-16 units).

Helpers here and in :mod:`labels` take and return SQL text and are wrapped by
``F.expr`` at the edge: one parse instead of hundreds of calls into the JVM.  An
argument is a column name or any SQL expression.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE_CLASS, TOKEN_PATTERN, WORD_CLASS

_BLOCK = 32
_fresh = itertools.count()


def sql_text(value: str) -> str:
    """A raw string literal."""
    quote = '"' if '"' not in value else "'"
    return f"r{quote}{value}{quote}"


def bind(value: str, body) -> str:
    """Bind ``value`` once: a column named inside a lambda is evaluated per element.

    (The optimiser may even inline a whole regex there; a lambda variable it cannot.)
    """
    name = f"v{next(_fresh)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def let(value: Column, body) -> Column:
    """:func:`bind` for columns."""
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_rows(df: DataFrame, array: Column | str, name: str) -> DataFrame:
    """One row per element; rows with an empty array vanish.

    A plain ``explode`` makes the optimiser push ``size(array) > 0`` below every
    projection, which evaluates the whole token pipeline a second time.
    """
    return df.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())


def _running(arr: str, base: str) -> str:
    return (
        f"aggregate({arr}, named_struct('at', {base}, 'out', cast(array() as array<int>)), "
        "(a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at + x))), a -> a.out)"
    )


def prefix_ends_sql(lengths: str) -> str:
    """Inclusive prefix sums of an int array.

    Appending to an array inside ``aggregate`` is quadratic, so sums run over
    blocks of 32 and then within each block: a 20,000-word text costs about 600
    appends for the blocks plus at most 32 per block.
    """
    def shifted(bs):
        totals = f"transform({bs}, k -> aggregate(k, 0, (a, x) -> a + x))"
        return bind(
            f"concat(array(0), {_running(totals, '0')})",
            lambda bases: f"flatten(transform({bs}, (k, i) -> {_running('k', f'get({bases}, i)')}))",
        )

    return bind(lengths, lambda ls: bind(
        f"transform(sequence(0, int((size({ls}) - 1) div {_BLOCK})), b -> slice({ls}, b * {_BLOCK} + 1, {_BLOCK}))",
        shifted,
    ))


def tokenize_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {sql_text(TOKEN_PATTERN)}, 0)"


def token_ends_sql(text: str) -> str:
    """End offset of every token: prefix sums over (white space + token) chunks."""
    chunk = sql_text(f"[{SPACE_CLASS}]*(?:{TOKEN_PATTERN})")
    return prefix_ends_sql(f"transform(regexp_extract_all({text}, {chunk}, 0), c -> length(c))")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def with_tokens(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add parallel arrays ``tokens``, ``starts`` and ``ends``."""
    tok, ends, starts = f"{prefix}tokens", f"{prefix}ends", f"{prefix}starts"
    return df.select("*", F.expr(tokenize_sql(text)).alias(tok), F.expr(token_ends_sql(text)).alias(ends)).select(
        "*", F.expr(f"zip_with({ends}, {tok}, (e, t) -> e - length(t))").alias(starts))


def regex_spans_sql(text: str, pattern: str) -> str:
    """Every match of ``pattern`` as ``array<struct<start,end,text>>``.

    ``pattern`` must not match the empty string.
    """
    def located(t):
        hits = f"regexp_extract_all({t}, {sql_text('(?:' + pattern + ')')}, 0)"

        def zipped(h):
            lengths = (
                f"zip_with(slice(split({t}, {sql_text(pattern)}, -1), 1, size({h})), {h}, "
                "(g, m) -> length(g) + length(m))"
            )
            return (
                f"zip_with({prefix_ends_sql(lengths)}, {h}, "
                "(e, m) -> named_struct('start', e - length(m), 'end', e, 'text', m))"
            )

        return bind(hits, lambda h: f"if(size({h}) > 0, {zipped(h)}, {none})")

    none = "cast(array() as array<struct<start:int,end:int,text:string>>)"
    return bind(text, located)


def regex_spans(text: str, pattern: str) -> Column:
    return F.expr(regex_spans_sql(text, pattern))


def token_span_sql(starts: str, ends: str, start: str, end: str) -> str:
    """``[first, last+1)`` of the tokens that overlap ``[start, end)``; null if none.

    Token offsets ascend, so the bounds are two counts.
    """
    first = bind(start, lambda p: f"size(filter({ends}, e -> e <= {p}))")
    last = bind(end, lambda p: f"size(filter({starts}, s -> s < {p}))")
    return bind(
        f"named_struct('start', {first}, 'end', {last})",
        lambda t: f"if({t}.`end` > {t}.start, {t}, null)",
    )


def token_spans_in_text_sql(text: str, spans: str) -> str:
    """Disjoint character spans (in order) as token spans, from the text alone; those touching no token vanish.

    Tokens are counted between the bounds of the spans.  A word that a bound cuts counts on both of its sides,
    so one of the two is taken off.
    """
    def counted(t, m, b, cut):
        piece = bind("if(i = 0, 0, get({b}, i - 1))".format(b=b), lambda lo: f"substring({t}, {lo} + 1, x - {lo})")
        sizes = f"transform({b}, (x, i) -> size({tokenize_sql(piece)}) - get({cut}, i))"
        return bind(prefix_ends_sql(sizes), lambda n: (
            f"filter(transform({m}, (s, i) -> named_struct('start', get({n}, 2 * i), 'end', get({n}, 2 * i + 1) + get({cut}, 2 * i + 1))), "
            "s -> s.`end` > s.start)"))

    cuts = lambda t, b: f"transform({b}, x -> int(x > 0 and substring({t}, x, 2) rlike {sql_text(f'[{WORD_CLASS}]' + '{2}')}))"
    return bind(text, lambda t: bind(spans, lambda m: bind(
        f"flatten(transform({m}, s -> array(greatest(s.start, 0), greatest(s.`end`, 0))))",
        lambda b: bind(cuts(t, b), lambda cut: counted(t, m, b, cut)))))


def token_span(starts: str, ends: str, start: str, end: str) -> Column:
    return F.expr(token_span_sql(starts, ends, start, end))
