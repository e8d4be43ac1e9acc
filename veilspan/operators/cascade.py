"""The cascade: direct identifiers, candidate spans, actions, deferral to review, replacement.

One job carries a fitted policy through the stages.  Detection stays on the text's own row; from there on only spans
travel (with an excerpt of their context), and they are decided and written once.  What is rendered and what waits for review are
both read from that table, so no span can be in both.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.tokens import bind, explode_rows, regex_spans_sql, with_tokens
from ..session import cut_lineage
from . import policy as Y
from . import redaction as X
from . import scoring as U

# Kinds of IDENTIFIER_PATTERN by form; what is left is a telephone number.
KIND = r"""case when h.text like '%@%' then 'EMAIL_ADDRESS' when h.text rlike r'^(https?://|www[.])' then 'URL'
  when h.text rlike r'^[0-9]{1,3}([.][0-9]{1,3}){3}$' then 'IP_ADDRESS' when h.text rlike r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then 'US_SSN' else 'PHONE_NUMBER' end"""
SUSPECT = "SUSPECT"


class FittedPolicy(NamedTuple):
    """What calibration leaves behind: one temperature, the policies of the grid, and which of them was chosen."""

    temperature: DataFrame
    grid: DataFrame
    chosen: DataFrame


class Cascade(NamedTuple):
    rendered: DataFrame  # session_id, turn_index, text, spans (those replaced), redacted
    queue: DataFrame  # spans that wait for review, with the action the model would have taken
    decided: DataFrame  # every span with its scores and its action


def fit_policy(calibration: DataFrame, target: float, subject: str = "subject") -> FittedPolicy:
    """``calibration``: subject, gold_action, predicted_action, p_redact, p_keep, p_review; ``target`` is the review rate wanted."""
    temperature, rows, grid = Y.calibrate(calibration, subject)
    return FittedPolicy(temperature, grid, cut_lineage(Y.choose_policy(cut_lineage(Y.sweep(rows, grid, subject)), target)))


def detected_spans(turns: DataFrame, detector: Callable | None = None, candidate_pattern: str | None = None) -> DataFrame:
    """``session_id, turn_index, found``: direct identifiers, and candidate spans that overlap none of them, by offset.

    ``detector`` is a factory for :func:`scoring.with_candidate_labels`; without one ``candidate_pattern`` (or nothing) is searched.
    """
    direct = (f"transform({regex_spans_sql('text', U.IDENTIFIER_PATTERN)}, h -> named_struct('start', h.start, 'end', h.`end`, "
              f"'text', h.text, 'entity_type', {KIND}))")
    base = turns.select("session_id", "turn_index", "text")
    if detector is None and candidate_pattern is None:
        return base.select("*", F.expr(direct).alias("found"))
    keyed = base.withColumn("id", F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn_index").cast("string")))
    how = {} if candidate_pattern is None else {"pattern": candidate_pattern}
    held = with_tokens(U.with_candidate_labels(keyed, detector, **how).drop("tokens"))
    spans = bind("named_struct('a', starts, 'b', ends, 't', text)", lambda p: (
        f"transform({L.spans_lenient_sql('predicted_labels')}, s -> named_struct('start', get({p}.a, s.start), 'end', get({p}.b, s.`end` - 1), "
        f"'text', substring({p}.t, get({p}.a, s.start) + 1, get({p}.b, s.`end` - 1) - get({p}.a, s.start)), 'entity_type', '{SUSPECT}'))"))
    both = bind(direct, lambda ds: (
        f"array_sort(concat({ds}, filter({spans}, c -> not exists({ds}, d -> d.start < c.`end` and c.start < d.`end`))))"))
    return held.select("session_id", "turn_index", "text", F.expr(both).alias("found"))


def decide(spans: DataFrame, policy: FittedPolicy, scorer: Callable | None = None) -> DataFrame:
    """Spans ``id, span_text, context_text, entity_type, ...`` with scores, the base action, ``deferred`` and ``predicted_action``.

    A direct identifier is redacted whatever the scores say and is never deferred.
    """
    scored = Y.override_direct_ids(U.with_action_scores(spans, scorer)).drop("confidence")  # the calibrated one follows
    out = Y.apply_policy(Y.with_features(scored, policy.temperature), policy.grid, policy.chosen)
    sure = F.col("override").isNotNull()
    return out.withColumns({"deferred": F.col("deferred") & ~sure,
                            "predicted_action": F.when(sure, F.col("base_predicted_action")).otherwise(F.col("predicted_action"))})


def run(turns: DataFrame, policy: FittedPolicy, detector: Callable | None = None, scorer: Callable | None = None,
        candidate_pattern: str | None = None, radius: int = 64, strategy: str = "typed_placeholder") -> Cascade:
    """The whole cascade over ``turns`` ``session_id, turn_index, text``; a turn is told by the first two.

    A span is replaced only when its action is settled as REDACT: what is deferred, or what the model itself sends to
    review, stays in the text and is in ``queue``.
    """
    found = detected_spans(turns, detector, candidate_pattern)
    context = f"substring(text, greatest(0, s.start - {radius}) + 1, s.`end` + {radius} - greatest(0, s.start - {radius}))"
    cut = bind("text", lambda t: f"transform(found, s -> named_struct('start', s.start, 'end', s.`end`, 'span_text', s.text, "
                                 f"'entity_type', s.entity_type, 'context_text', {context.replace('(text', f'({t}')}))")
    rows = explode_rows(found.select("session_id", "turn_index", F.expr(cut).alias("cut")), F.col("cut"), "s")
    spans = rows.select("session_id", "turn_index", "s.*").withColumn(
        "id", F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn_index").cast("string"), F.col("start").cast("string")))
    decided = cut_lineage(decide(spans, policy, scorer))
    settled = decided.filter("predicted_action = 'REDACT'").groupBy("session_id", "turn_index").agg(F.array_sort(F.collect_list(
        F.struct("start", "end", F.col("span_text").alias("text"), "entity_type"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string,entity_type:string>>)")
    both = turns.select("session_id", "turn_index", "text").join(settled, ["session_id", "turn_index"], "left").withColumn("spans", F.coalesce("spans", none))
    return Cascade(X.render_stable(both, strategy), decided.filter("predicted_action = 'REVIEW'"), decided)
