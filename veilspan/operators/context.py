"""Neighbour context, anchors and marked model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OUTSIDE
from ..functions.text import collapse_space, is_blank, rstrip_space
from ..functions.tokens import bind, tokenize_sql
from ..plans.scaled import CHUNK_ROWS, block, first_k, neighbours, ranked

KEYS = ("dialogue_id",)
IGNORE = "__IGNORE__"
INPUT_FORMATS = ("turn_only_v1", "pair_context_v1", "marked_window_v1", "speaker_marked_window_v1")
_LEGACY = {"none": "turn_only_v1", "pair": "pair_context_v1"}


def _snippet(struct: str) -> Column:
    s = F.col(struct)
    return F.when(s.isNotNull(), F.concat(s["speaker_role"], F.lit(": "), s["text"]))


def neighbour_context(df: DataFrame, order: str = "turn_index", chunk: int = CHUNK_ROWS) -> DataFrame:
    """``role: text`` of previous, current and next turn, one per line."""
    out = neighbours(df, KEYS, order, ["speaker_role", "text"], chunk)
    here = F.concat(F.col("speaker_role"), F.lit(": "), F.col("text"))
    return out.withColumn("context_text", F.concat_ws("\n", _snippet("prev"), here, _snippet("next"))).drop("prev", "next")


def neighbour_context_normalised(df: DataFrame, order: str = "turn_index") -> DataFrame:
    """The same on white-space-normalised text; the turn text itself is kept."""
    held = df.withColumn("__raw", F.col("text")).withColumn("text", collapse_space(F.col("text")))
    return neighbour_context(held, order).drop("text").withColumnRenamed("__raw", "text")


def radius_context(df: DataFrame, radius: int, order: str = "turn_index") -> DataFrame:
    """The ``radius`` rows before and after each row, by place in the dialogue; ``order`` may have gaps.

    Places are ranks counted in chunks; each row is sent to its neighbours' places and re-joined, so
    no dialogue is gathered: the group is one place.
    """
    placed = ranked(df, ["dialogue_id"], [F.col(order)], block(F.col(order)), "__at")
    snippet = F.concat(F.col("speaker_role"), F.lit(": "), F.col("text"))
    offsets = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1)])).alias("d")
    sent = placed.select("dialogue_id", F.col("__at").alias("__from"), snippet.alias("s"), offsets).select(
        "dialogue_id", (F.col("__from") + F.col("d")).alias("__at"), "__from", "s")
    packed = sent.groupBy("dialogue_id", "__at").agg(F.array_sort(F.collect_list(F.struct("__from", "s"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["s"]), "\n")
    return placed.join(packed, ["dialogue_id", "__at"]).withColumn("context_text", text).drop("w", "__at")


def nonblank_neighbours(df: DataFrame, order: str = "turn_index", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Text and role of the nearest non-blank turn on either side."""
    out = neighbours(df, KEYS, order, ["speaker_role", "text"], chunk, keep=~is_blank(F.col("text")))
    return out.select(
        *df.columns, F.col("prev.text").alias("prev_text"), F.col("prev.speaker_role").alias("prev_role"),
        F.col("next.text").alias("next_text"), F.col("next.speaker_role").alias("next_role"))


def session_anchor(df: DataFrame, order: str = "turn_index", segments: int = 3, chars: int = 180) -> DataFrame:
    """First three non-empty ``role: text`` joined by `` | `` and cut to 180 characters."""
    text = collapse_space(F.col("text"))
    rows = first_k(df.withColumn("__t", text).filter("__t <> ''"), KEYS, [F.col(order)], segments, "__k")
    joined = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "__k", F.concat(F.col("speaker_role"), F.lit(": "), F.col("__t")).alias("s")))).alias("w"))
    full = F.array_join(F.transform("w", lambda x: x["s"]), " | ")
    cut = F.concat(rstrip_space(F.substring(full, 1, chars - 3)), F.lit("..."))
    return joined.select(*KEYS, F.when(F.length(full) <= chars, full).otherwise(cut).alias("anchor_text"))


# --- model inputs ----------------------------------------------------------------------------
def input_format(name: str | None, context_mode: str | None = None) -> str:
    if name is not None:
        if name not in INPUT_FORMATS:
            raise ValueError(f"unsupported input format: {name}")
        return name
    try:
        return _LEGACY[context_mode or "none"]
    except KeyError as exc:
        raise ValueError(f"unsupported context mode: {context_mode}") from exc


def model_inputs(df: DataFrame, name: str | None = None, context_mode: str | None = None) -> DataFrame:
    """Add ``model_tokens, pair_tokens, word_labels, decode_map, input_format``.

    ``df``: tokens, labels, speaker_role, context_text and, for windows, prev/next text and role.
    """
    fmt = input_format(name, context_mode)
    empty = F.expr("cast(array() as array<string>)")
    n = "size(tokens)"
    identity = F.expr(f"if({n} = 0, cast(array() as array<int>), sequence(0, greatest({n}, 1) - 1))")
    if fmt in INPUT_FORMATS[:2]:
        pair = F.expr(tokenize_sql("coalesce(context_text, '')")) if fmt == INPUT_FORMATS[1] else empty
        cols = {"model_tokens": F.col("tokens"), "pair_tokens": pair, "word_labels": F.col("labels"), "decode_map": identity}
    else:
        prefix = fmt == INPUT_FORMATS[3]
        role = lambda c: f"array(concat(coalesce({c}, 'unknown'), ':'))" if prefix else "cast(array() as array<string>)"
        side = lambda t, r: (
            f"if(trim(coalesce({t}, '')) = '', cast(array() as array<string>), concat({role(r)}, {tokenize_sql(t)}))")
        own = role("speaker_role")
        before = f"concat({side('prev_text', 'prev_role')}, array('<CUR>'), {own})"
        after = f"concat(array('</CUR>'), {side('next_text', 'next_role')})"
        pad = lambda arr, v: f"transform({arr}, x -> {v})"
        around = lambda mid, v: F.expr(f"concat({pad(before, v)}, {mid}, {pad(after, v)})")
        cols = {
            "model_tokens": F.expr(f"concat({before}, tokens, {after})"), "pair_tokens": empty,
            "word_labels": around("labels", f"'{IGNORE}'"),
            "decode_map": around(f"if({n} = 0, cast(array() as array<int>), sequence(0, greatest({n}, 1) - 1))", "-1"),
        }
    return df.withColumns({**cols, "input_format": F.lit(fmt)})


def decode_words(token_count: str, decode_map: str, word_ids: str, predicted: str) -> Column:
    """Labels of the original tokens from labels at model positions.

    ``word_ids`` maps model pieces to words (null outside); the first piece of a word
    wins, unmapped tokens stay O.
    """
    pieces = (
        f"filter(transform({word_ids}, (w, i) -> named_struct('o', if(w is null or (i > 0 and get({word_ids}, i - 1) <=> w), null, "
        f"get({decode_map}, w)), 'l', get({predicted}, i))), x -> x.o is not null and x.o >= 0)"
    )
    return F.expr(bind(pieces, lambda ps: (
        f"if({token_count} = 0, cast(array() as array<string>), transform(sequence(0, greatest({token_count}, 1) - 1), "
        f"k -> coalesce(try_element_at(filter({ps}, x -> x.o = k), -1).l, '{OUTSIDE}')))"
    )))
