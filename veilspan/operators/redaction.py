"""Redaction rendering, stable placeholders and surrogate views."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FAKE_VALUES, REDACTION_ALIAS, SUPPORTED_TAGS, SURROGATE_FORMATS
from ..functions import rules as R
from ..functions.text import fold_case, mapped
from ..functions.tokens import bind, explode_rows
from ..plans.scaled import block, ranked
from . import context as C
from .spans import tag_spans

SPAN_KEYS = ("session_id", "turn_index")


def redaction_type(entity_type: Column) -> Column:
    up = F.upper(entity_type)
    return F.when(entity_type.isNull() | (entity_type == ""), "ENTITY").otherwise(F.coalesce(mapped(up, REDACTION_ALIAS), up))


def splice_sql(text: str, parts: str) -> str:
    """Text with ``array<struct<start,end,value>>`` (sorted, disjoint) spliced in."""
    return bind(parts, lambda ps: (
        f"concat(array_join(transform({ps}, (p, i) -> concat(substring({text}, if(i = 0, 0, get({ps}, i - 1).`end`) + 1, "
        f"p.start - if(i = 0, 0, get({ps}, i - 1).`end`)), p.value)), ''), "
        f"substring({text}, coalesce(get({ps}, size({ps}) - 1).`end`, 0) + 1, length({text})))"
    ))


def overlapping_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Rows whose spans overlap; they cannot be spliced."""
    pair = bind(f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.`end`)))", lambda ss: (
        f"exists(sequence(0, size({ss}) - 1), i -> i > 0 and coalesce(get({ss}, i).start < get({ss}, i - 1).`end`, false))"))
    return df.filter(F.expr(f"size({spans}) > 1")).filter(F.expr(pair))


def render_fixed(text: str, spans: str, strategy: str = "mask") -> Column:
    """Mask or delete spans: no state, no shuffle."""
    value = {"mask": "'[REDACTED]'", "delete": "''"}[strategy]
    parts = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.`end`, 'value', {value})))"
    return F.expr(splice_sql(text, parts))


def entity_numbers(spans: DataFrame) -> DataFrame:
    """``session_id, type, key, n``: entities numbered per session and type.

    ``spans``: session_id, turn_index, start, text, entity_type.  Numbering follows the
    first mention, turns ascending and, within a turn, from the last span to the first.
    Mentions are reduced to one row per entity before anything is ranked, and a long
    session is ranked in blocks of turns.
    """
    typed = spans.select("session_id", redaction_type(F.col("entity_type")).alias("type"), fold_case(F.col("text")).alias("key"),
                         F.struct(F.col("turn_index").alias("turn"), (-F.col("start")).alias("back")).alias("at"))
    first = typed.groupBy("session_id", "type", "key").agg(F.min("at").alias("at"))
    out = ranked(first, ["session_id", "type"], [F.col("at.turn"), F.col("at.back")], block(F.col("at.turn")), "n")
    return out.select("session_id", "type", "key", "n")


def placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), n.cast("string"), F.lit("]"))


def fake_value(kind: Column, n: Column) -> Column:
    names = {k: F.array(*[F.lit(v) for v in vs]) for k, vs in FAKE_VALUES.items()}
    pool = F.create_map(*[x for k, vs in names.items() for x in (F.lit(k), vs)])
    values = F.coalesce(F.try_element_at(pool, kind), names["ENTITY"])
    last = F.element_at(values, -1)
    return F.coalesce(F.get(values, (n - 1).cast("int")), F.concat(last, F.lit("-"), n.cast("string")))


def render_stable(turns: DataFrame, strategy: str = "typed_placeholder") -> DataFrame:
    """Add ``redacted``; ``turns``: session_id, turn_index, text, spans array<struct<start,end,text,entity_type>>."""
    value = {"typed_placeholder": placeholder, "fake_surrogate": fake_value}[strategy]
    spans = explode_rows(turns.select(*SPAN_KEYS, "spans"), F.col("spans"), "s").select(*SPAN_KEYS, "s.*")
    numbers = entity_numbers(spans)
    keyed = spans.withColumn("type", redaction_type(F.col("entity_type"))).withColumn("key", fold_case(F.col("text")))
    named = keyed.join(numbers, ["session_id", "type", "key"]).withColumn("value", value(F.col("type"), F.col("n")))
    packed = named.groupBy(*SPAN_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("__p"))
    out = turns.join(packed, list(SPAN_KEYS), "left")
    return out.withColumn("redacted", F.when(F.col("__p").isNull(), F.col("text")).otherwise(F.expr(splice_sql("text", "__p")))).drop("__p")


# --- surrogates -----------------------------------------------------------------------------
def default_pools() -> dict[str, list[str]]:
    """Invented stand-ins, built from parts; pass your own pools to keep another set."""
    cross = lambda a, b, sep="": [x + sep + y for x in a for y in b]
    return {
        "PERSON": cross(("Ale", "Bri", "Cor", "Dal", "Eve", "Fin", "Gre", "Hol", "Isa", "Jor", "Kel", "Lan", "Mar", "Nel", "Ore", "Pat"),
                        ("na", "rin", "den", "ly", "son")),
        "LOCATION": cross(("Alder", "Birch", "Clover", "Dune", "Elder", "Fern", "Glen", "Haven", "Ivy", "Juniper", "Kettle", "Linden"),
                          ("brook", "field", "ton", "vale", "ridge")),
        "SCHOOL": cross(("Alder", "Birch", "Clover", "Dune", "Elder"), ("High School", "Middle School", "Elementary", "Academy", "Prep"), " "),
        "NRP": cross(("North", "South", "East", "West", "Inland"), ("lander", "shore resident", "hill resident")),
        "COURSE": cross(("Reading", "Civics", "Algebra", "Biology", "Music"), ("101", "110", "201", "210"), " "),
        "GRADE_LEVEL": [f"{n}th grade" for n in range(4, 13)] + ["first-year student"],
    }


def _surrogate_udf(pools: Mapping[str, Sequence[str]], seed: int):
    pools = {k: list(v) for k, v in pools.items()}

    @F.pandas_udf("string")
    def pick(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=4096)  # lives as long as the task, so a session is shuffled once in it
        def order(sid: str) -> dict:
            rng = random.Random(hashlib.sha256(f"{seed}:{sid}".encode()).hexdigest())
            out = {}
            for name, pool in pools.items():
                out[name] = list(pool)
                rng.shuffle(out[name])
            return out

        for session, kind, n in parts:
            yield pd.Series([
                order(s)[k][(int(i) - 1) % len(pools[k])] if k in pools else None for s, k, i in zip(session, kind, n)], dtype=object)

    return pick


def surrogate_view(turns: DataFrame, seed: int = 17, pools: Mapping[str, Sequence[str]] | None = None, exact_shuffle: bool = True) -> DataFrame:
    """Add ``surrogate_text`` and ``tags array<struct<start,end,span_text,original_tag,entity_type,occurrence>>``.

    The n-th tag of a type in a session takes the n-th value of that session's shuffled
    pool, or a reserved-format value.  Unknown types keep their tag and still count.
    ``exact_shuffle=False`` walks the pool from a hash offset instead and stays in the JVM.
    """
    pools = dict(pools or default_pools())
    marked = turns.withColumn("__t", tag_spans("text", supported_only=False))
    tags = explode_rows(marked.select(*SPAN_KEYS, "__t"), F.col("__t"), "t").select(*SPAN_KEYS, "t.start", "t.end", F.col("t.text").alias("tag"), "t.entity_type")
    tags = ranked(tags, ["session_id", "entity_type"], [F.col("turn_index"), F.col("start")], block(F.col("turn_index")), "n")
    if exact_shuffle:
        pooled = _surrogate_udf(pools, seed)(F.col("session_id"), F.col("entity_type"), F.col("n"))
    else:
        arrays = F.create_map(*[x for k, v in pools.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
        values = F.try_element_at(arrays, F.col("entity_type"))
        shift = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col("session_id"))), 1, 6), 16, 10).cast("long")
        pooled = F.get(values, ((F.col("n") - 1 + shift) % F.size(values)).cast("int"))
    formatted = None
    for kind, form in SURROGATE_FORMATS.items():
        cond = F.col("entity_type") == kind
        formatted = F.when(cond, F.format_string(form, "n")) if formatted is None else formatted.when(cond, F.format_string(form, "n"))
    tags = tags.withColumn("value", F.coalesce(pooled, formatted, F.col("tag")))
    packed = tags.groupBy(*SPAN_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "tag", "entity_type", "n"))).alias("__p"))
    moved = bind("__p", lambda ps: (
        f"transform({ps}, (p, i) -> {bind(f'aggregate(slice({ps}, 1, i), 0, (a, q) -> a + length(q.value) - length(q.tag))', lambda d: f'''named_struct('start', p.start + {d}, 'end',
         p.start + {d} + length(p.value), 'span_text', p.value, 'original_tag', p.tag, 'entity_type', p.entity_type, 'occurrence', p.n)''')})"))
    out = turns.join(packed, list(SPAN_KEYS), "left")
    return out.withColumn("surrogate_text", F.when(F.col("__p").isNull(), F.col("text")).otherwise(F.expr(splice_sql("text", "__p")))).withColumn(
        "tags", F.expr(f"if(__p is null, null, {moved})")).drop("__p")


def pilot_turns(turns: DataFrame, seed: int = 17) -> DataFrame:
    """Turns with supported tags: surrogate text, context, session anchor and challenge scores."""
    base = turns.withColumnRenamed("dialogue_id", "session_id") if "dialogue_id" in turns.columns else turns
    view = surrogate_view(base, seed).withColumn("text", F.col("surrogate_text")).withColumnRenamed("session_id", "dialogue_id")
    ctx = C.neighbour_context_normalised(view.drop("surrogate_text"))
    kept = F.expr("filter(tags, t -> t.entity_type in ({}))".format(", ".join(f"'{t}'" for t in SUPPORTED_TAGS)))
    anchors = C.session_anchor(view.select("dialogue_id", "turn_index", "speaker_role", "text"))
    rows = ctx.withColumn("tags", kept).filter("size(tags) > 0").join(anchors, "dialogue_id")
    return rows.withColumn("tag_count", F.size("tags"))


def pilot_items(pilot: DataFrame, max_words: int = 350, max_tags: int = 20) -> DataFrame:
    """Tag items of turns that are not oversize (the filter runs before the unnest)."""
    ok = pilot.filter(F.size(R.oversize_reasons(F.col("text"), F.col("tag_count"), max_words, max_tags)) == 0)
    rows = explode_rows(ok, F.col("tags"), "t")
    return rows.select(
        F.concat_ws("-", "dialogue_id", F.lit("turn"), F.col("turn_index").cast("string"), F.lit("tag"), F.col("t.start").cast("string"), F.col("t.end").cast("string")).alias("id"),
        F.col("dialogue_id").alias("session_id"), "subject", "turn_index", "speaker_role", F.col("text").alias("turn_text"), "context_text", "anchor_text",
        F.col("t.span_text").alias("span_text"), "t.original_tag", "t.entity_type", F.col("t.start").alias("tag_start"), F.col("t.end").alias("tag_end"),
        F.col("t.occurrence").alias("tag_occurrence"), "tag_count")


def export_labelled(pool: DataFrame) -> DataFrame:
    """Flatten annotated pool rows into action rows."""
    return pool.select(
        "id", "source_row_id", "subject", "span_text", "context_text", F.col("annotation.action_label").alias("action_label"),
        R.semantic_role(F.col("annotation.semantic_role"), F.col("annotation.action_label")).alias("semantic_role"),
        F.col("annotation.annotator").alias("annotator"), F.col("pool_source").alias("label_origin"), "token_start", "token_end",
        (F.col("suggested_action") == F.col("annotation.action_label")).alias("agrees_with_suggestion"))
