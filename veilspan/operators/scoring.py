"""Scoring seams: a scorer is plugged in per task, rules are the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import labels as L
from ..functions import rules as R
from ..functions.probability import CLASSES, argmax
from ..functions.text import any_word
from ..functions.tokens import regex_spans_sql, tokenize_sql

# Surface forms of direct identifiers inside running text.
IDENTIFIER_PATTERN = (
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|https?://[^\x09-\x0d\x20]+|www\.[^\x09-\x0d\x20]+"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\+?[0-9][0-9() \-]{7,}[0-9]"
)


CandidateScorer = Callable[[pa.RecordBatch], Sequence[Sequence[tuple[int, int]]]]
ActionScorer = Callable[[pa.RecordBatch], Sequence[tuple[float, float, float]]]


def _scored(df: DataFrame, factory: Callable[[], Callable], needs: Sequence[str], added: StructType, cells, batch_rows: int,
            profile: ResourceProfile | None) -> DataFrame:
    """``df`` with the columns ``added``, which ``cells`` makes of a scorer's answers; other columns pass through as they are.

    The scorer is made once per task, so a model is loaded once and not for each batch; it sees the columns ``needs`` of at
    most ``batch_rows`` rows, null texts as empty ones.  ``profile`` asks the cluster for executors that suit it (memory, accelerators).
    """
    names, places = df.columns, [df.columns.index(c) for c in needs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                seen = [c.fill_null("") if pa.types.is_string(c.type) else c for c in (part.column(i) for i in places)]
                answers = score(pa.RecordBatch.from_arrays(seen, list(needs)))
                if len(answers) != part.num_rows:
                    raise ValueError(f"{len(answers)} answers to {part.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*part.columns, *cells(answers)], [*names, *added.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]), profile=profile)


def with_candidate_labels(df: DataFrame, factory: Callable[[], CandidateScorer] | None = None, pattern: str = IDENTIFIER_PATTERN,
                          batch_rows: int = 256, profile: ResourceProfile | None = None) -> DataFrame:
    """``df`` (``id, text, ...``) with ``tokens`` and ``predicted_labels``.

    A scorer maps a batch ``id, text, tokens`` to one list of ``(start, end)`` character spans per row; a row without an
    answer or a span outside its text fails the job.  Without a factory, built-in patterns are used and nothing leaves the JVM.
    """
    base = df.withColumn("tokens", F.expr(tokenize_sql("text")))
    if factory is None:
        held = base.withColumn("__s", F.expr(regex_spans_sql("text", pattern)))
    else:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        spans = StructType().add("__s", ArrayType(StructType().add("start", "integer").add("end", "integer")))
        cells = lambda answers: [pa.array([[{"start": int(a), "end": int(b)} for a, b in row] for row in answers], kind)]
        told = F.concat(F.lit("a span outside the text of "), F.col("id").cast("string"))
        wrong = F.expr("exists(__s, s -> s.start < 0 or s.`end` < s.start or s.`end` > length(text))")
        held = _scored(base, factory, ("id", "text", "tokens"), spans, cells, batch_rows, profile).withColumn(
            "__s", F.when(~wrong, F.col("__s")).otherwise(F.raise_error(told)))
    return held.withColumn("predicted_labels", L.labels_of_text("text", "tokens", "__s")).drop("__s")


def score_candidates(df: DataFrame, factory: Callable[[], CandidateScorer] | None = None, pattern: str = IDENTIFIER_PATTERN, **how) -> DataFrame:
    """``id, predicted_labels`` for ``id, text``; see :func:`with_candidate_labels`."""
    return with_candidate_labels(df.select("id", "text"), factory, pattern, **how).select("id", "predicted_labels")


def rule_action(span: Column, context: Column, entity_type: Column) -> Column:
    """Own rule cascade: direct contact, self-introduction, own place, lesson content, else REVIEW."""
    lesson = any_word(("homework", "lesson", "chapter", "essay", "problem", "equation", "history", "book"))
    direct = R.detect_direct_id(span, entity_type).isNotNull() | R.is_probable_phone(span)
    private = R.greets(context, span) | R.self_identifies(context, span) | context.rlike(R.PLACE_CUE)
    return F.when(direct | private, "REDACT").when(context.rlike(lesson), "KEEP").otherwise("REVIEW")


def with_action_scores(df: DataFrame, factory: Callable[[], ActionScorer] | None = None, batch_rows: int = 256,
                       profile: ResourceProfile | None = None) -> DataFrame:
    """``df`` (``id, span_text, context_text, entity_type, ...``) with ``predicted_action, confidence, p_redact, p_keep, p_review``.

    A scorer maps a batch of those four columns to one ``(redact, keep, review)`` triple per row.
    """
    names = [f"p_{n}" for n in CLASSES]
    if factory is None:
        action = rule_action(F.col("span_text"), F.col("context_text"), F.col("entity_type"))
        scored = df.select("*", F.inline_outer(F.array(F.struct(action.alias("predicted_action")))))
        return scored.withColumns({"confidence": F.lit(0.9), **{
            f"p_{n}": F.when(F.col("predicted_action") == n.upper(), 0.9).otherwise(0.05) for n in CLASSES}})
    added = StructType()
    for name in names:
        added = added.add(name, "double")
    cells = lambda answers: [pa.array([float(row[i]) for row in answers], pa.float64()) for i in range(3)]
    scored = _scored(df, factory, ("id", "span_text", "context_text", "entity_type"), added, cells, batch_rows, profile)
    return scored.withColumns({"predicted_action": argmax(), "confidence": F.greatest(*names)})


def score_actions(df: DataFrame, factory: Callable[[], ActionScorer] | None = None, **how) -> DataFrame:
    """``id, predicted_action, confidence, p_redact, p_keep, p_review``; see :func:`with_action_scores`."""
    scored = with_action_scores(df.select("id", "span_text", "context_text", "entity_type"), factory, **how)
    return scored.select("id", "predicted_action", "confidence", *[f"p_{n}" for n in CLASSES])


def label_responses(responses: DataFrame, tolerant: bool = True, attempts: int = 2) -> DataFrame:
    """One labelled row per id from raw responses ``id, attempt, raw_text, latency_ms, *_tokens``.

    The first attempt that parses wins; usage adds up over the attempts made until then.
    """
    parse = R.parse_response_tolerant if tolerant else R.parse_response
    rows = responses.filter(F.col("attempt") <= attempts).withColumn("v", parse(F.col("raw_text")))
    ok = F.col("v.error").isNull()
    first = F.min(F.when(ok, F.col("attempt")))
    best = rows.groupBy("id").agg(
        first.alias("__first"), F.min_by("v", F.struct((~ok).cast("int"), F.col("attempt"))).alias("v"),
        F.array_sort(F.collect_list(F.struct("attempt", "latency_ms", "total_tokens"))).alias("__u"))
    used = F.expr("filter(__u, u -> __first is null or u.attempt <= __first)")
    return best.withColumn("__u", used).select(
        "id", "v.action_label", "v.semantic_role", "v.error", F.size("__u").alias("attempt_count"),
        (F.size("__u") > 1).alias("repair_used"),
        F.expr("aggregate(__u, 0D, (a, u) -> a + u.latency_ms)").alias("latency_ms"),
        F.expr("aggregate(__u, 0L, (a, u) -> a + u.total_tokens)").alias("total_tokens"))
