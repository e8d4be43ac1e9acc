"""Deterministic splits, quotas and capped selections.

Every order is a seeded hash order, so nothing depends on arrival.  Ranks over all
rows are chunked by hash prefix; caps use per-group limits that apply before the
shuffle; only bounded candidate lists reach the one step that is truly sequential.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AMBIGUOUS_TAGS, CHALLENGE_MINIMUMS, CHALLENGE_TAGS, CONTROL_TAGS, RARE_TYPES
from ..functions import labels as L
from ..functions import rules as R
from ..functions.text import fold_case, stable_hash
from ..functions.tokens import bind, explode_rows, tokenize
from ..plans.scaled import first_k, hash_block, ranked
from ..session import cut_lineage
from .quality import require_none


def _hashed(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    return df.withColumn("__h", stable_hash(F.col(key), seed))


# --- splits ------------------------------------------------------------------------------
def ratio_split(ids: DataFrame, key: str, seed: int, train: float, dev: float) -> DataFrame:
    """``key, split`` with floor cut-offs in hash order; the rest is test."""
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = ranked(_hashed(ids.select(key), key, seed), [], [F.col("__h"), F.col(key)], hash_block(F.col("__h")))
    a = F.floor(n * F.lit(train))
    b = a + F.floor(n * F.lit(dev))
    return out.select(key, F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "dev").otherwise("test").alias("split"))


def halves(ids: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """Per group: the first half (rounded down) in hash order is dev, the rest test."""
    sizes = ids.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    out = ranked(_hashed(ids.select(group, key), key, seed), [group], [F.col("__h"), F.col(key)], hash_block(F.col("__h")))
    dev = F.col("rank") <= F.floor(F.col("__n") / 2)
    return out.join(sizes, group).select(group, key, F.when(dev, "dev").otherwise("test").alias("split"))


def downsample_negatives(df: DataFrame, key: str, positive: Column, keep: float, seed: int) -> DataFrame:
    """All positives and at most ``int(positives * keep)`` negatives; no cut when that is 0 or roomy."""
    if keep < 0:
        return df
    held = _hashed(df.withColumn("__pos", positive), key, seed)
    limit = held.agg(F.floor(F.count_if("__pos") * F.lit(keep)).alias("n")).scalar()
    neg = ranked(held.filter("not __pos"), [], [F.col("__h"), F.col(key)], hash_block(F.col("__h")))
    kept = neg.filter((limit <= 0) | (F.col("rank") <= limit)).drop("rank")
    return held.filter("__pos").unionByName(kept).drop("__pos", "__h")


# --- quotas --------------------------------------------------------------------------------
def largest_remainder(counts: DataFrame, groups: Sequence[str], name: str, total: int) -> DataFrame:
    """``counts``: groups, name, n.  Floor of each share, leftovers by remainder then name."""
    g = Window.partitionBy(*groups)
    raw = (F.col("n") / F.sum("n").over(g)) * total
    df = counts.withColumn("__raw", raw).withColumn("__base", F.floor("__raw"))
    order = Window.partitionBy(*groups).orderBy((F.col("__raw") - F.col("__base")).desc(), F.col(name))
    extra = F.row_number().over(order) <= total - F.sum("__base").over(g)
    return df.withColumn("quota", F.col("__base") + F.when(extra, 1).otherwise(0)).drop("__raw", "__base")


def even_quotas(names: DataFrame, name: str, total: int) -> DataFrame:
    """``total // k`` each, one more for the first ``total % k`` names."""
    w = Window.partitionBy(F.lit(0))
    k, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(name))
    return names.select(name, (F.floor(F.lit(total) / k) + F.when(i <= F.lit(total) % k, 1).otherwise(0)).alias("quota"))


def weighted_quotas(totals: DataFrame, label: str, weights: Mapping[str, int]) -> DataFrame:
    """``totals``: label, n.  Integer shares by weight; leftovers to the heaviest, then by name."""
    whole = sum(weights.values())
    order = sorted(weights, key=lambda s: (-weights[s], s))
    splits = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(w).alias("w"), F.lit(order.index(s)).alias("pos")) for s, w in weights.items()])
    floors = sum(F.floor(F.col("n") * w / whole) for w in weights.values())
    df = totals.withColumn("__left", F.col("n") - floors).withColumn("s", F.explode(splits))
    quota = F.floor(F.col("n") * F.col("s.w") / whole) + F.when(F.col("s.pos") < F.col("__left"), 1).otherwise(0)
    return df.select(label, F.col("s.split").alias("split"), quota.alias("quota"))


# --- capped selections ------------------------------------------------------------------------
def capped_top(df: DataFrame, session: str, order: Sequence[Column], cap: int, total: int) -> DataFrame:
    """First ``total`` rows in order with at most ``cap`` per session."""
    return first_k(df, [session], order, cap).orderBy(*order).limit(total)


def source_caps(df: DataFrame, source: str, caps: Mapping[str, int], key: str = "id") -> DataFrame:
    """At most ``caps[source]`` rows per source in hash order; -1 or no entry means all, a null source too.

    Sources without a cap pass as they are; all capped ones are ranked together.
    """
    capped = {s: k for s, k in caps.items() if k >= 0}
    if not capped:
        return df
    within = F.coalesce(F.col(source).isin(*capped), F.lit(False))
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in capped.items() for x in pair]), F.col(source))
    hashed = _hashed(df.filter(within), key, None)
    first = first_k(hashed, [source], [F.col("__h"), F.col(key)], max(capped.values()), "__k").filter(F.col("__k") <= cap)
    return df.filter(~within).unionByName(first.drop("__h", "__k"))


# --- item filters and scores -------------------------------------------------------------------
def session_exclusions(items: DataFrame, pattern: str = R.LANGUAGE_MARKERS_V2, subject: str = "english") -> DataFrame:
    """Sessions of one subject with any item that mentions another language."""
    text = F.concat_ws(" ", "anchor_text", "context_text", "turn_text")
    return items.filter((F.col("subject") == subject) & text.rlike(pattern)).select("session_id").distinct()


def exclude_languages(items: DataFrame, pattern: str = R.LANGUAGE_MARKERS_V2, script: str | None = R.ARABIC_SCRIPT,
                      subject: str = "english") -> DataFrame:
    """Drop marked sessions of the subject, then its items whose text holds the script."""
    out_of = session_exclusions(items, pattern, subject).withColumn("__s", F.lit(subject)).withColumnRenamed("session_id", "__id")
    kept = items.join(out_of, (F.col("session_id") == F.col("__id")) & (F.col("subject") == F.col("__s")), "left_anti")
    if script:
        kept = kept.filter(~((F.col("subject") == subject) & F.col("turn_text").rlike(script)))
    return kept


def score_items(items: DataFrame, version: int = 2) -> DataFrame:
    """Add ``challenge, private_prior, person_private, bonus, h`` once, for every later order."""
    text = F.concat_ws(" ", "turn_text", "context_text", "anchor_text", "turn_text")
    c = {k: F.col(k) for k in ("turn_text", "span_text", "entity_type", "subject", "turn_index")}
    person = R.person_private_score(text, c["turn_text"], c["span_text"], c["entity_type"], c["subject"], c["turn_index"])
    prior = R.private_prior_v1(text, c["span_text"], c["entity_type"]) if version == 1 else R.private_prior_v2(
        text, c["turn_text"], c["span_text"], c["entity_type"], c["subject"], c["turn_index"])
    scored = F.struct(
        R.challenge_score(c["entity_type"], F.col("tag_count"), F.col("speaker_role")).alias("challenge"),
        prior.alias("private_prior"), person.alias("person_private"), R.curricular_bonus(text, c["subject"]).alias("bonus"),
        F.col("id").alias("__id"))
    return items.select("*", F.inline_outer(F.array(scored))).drop("__id")


# --- bounded greedy selection --------------------------------------------------------------------
def _shares(counts: Mapping[str, int], total: int) -> dict[str, int]:
    whole = sum(counts.values())
    if total <= 0 or not whole:
        return {}
    raw = {k: n / whole * total for k, n in counts.items()}
    out = {k: int(v) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: (out[k] - raw[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


class _Picker:
    """Session caps and used ids shared by the phases of one selection."""

    def __init__(self, cap: int, total: int):
        self.cap, self.total = cap, total
        self.sessions: Counter = Counter()
        self.order: list[int] = []
        self.used: set[int] = set()

    def free(self, row) -> bool:
        return row.Index not in self.used and self.sessions[row.session_id] < self.cap

    def take(self, row) -> None:
        self.used.add(row.Index)
        self.sessions[row.session_id] += 1
        self.order.append(row.Index)

    def drain(self, rows, quota: int) -> int:
        """Take free rows in order until ``quota`` is reached or the selection is full."""
        got = 0
        for row in rows:
            if got >= quota or len(self.order) >= self.total:
                break
            if self.free(row):
                self.take(row)
                got += 1
        return got

    def rounds(self, by_type: Mapping[str, list], targets: Mapping[str, int], supply: Mapping[str, int]) -> None:
        """One item per type and round, neediest type first, until nothing moves."""
        have: Counter = Counter()
        moved = True
        while moved and len(self.order) < self.total:
            moved = False
            for kind in sorted(targets, key=lambda k: (have[k] - targets[k], -supply[k], k)):
                if have[kind] < targets[kind] and self.drain(by_type.get(kind, ()), 1):
                    have[kind] += 1
                    moved = True


def _natural(rows, counts: dict[str, int], spec: Mapping) -> list[int]:
    pick = _Picker(spec["cap"], spec["total"])
    by_hash = sorted(rows, key=lambda r: (r.h, r.id))
    reserve = spec.get("reserve", 0)
    if spec.get("person_reserve") and rows and rows[0].subject == "english":
        pick.drain(sorted((r for r in rows if r.person_private > 0), key=lambda r: (-r.person_private, r.h, r.id)), spec["person_reserve"])
    if reserve:
        likely = sorted((r for r in rows if r.private_prior > spec["prior_above"]), key=lambda r: (-r.private_prior, r.h, r.id))
        pick.drain(likely, reserve - len(pick.order))
        pick.drain((r for r in by_hash if r.entity_type in CONTROL_TAGS), reserve - len(pick.order))
    taken = [r for r in rows if r.Index in pick.used]
    supply = Counter(counts)
    supply.subtract(Counter(r.entity_type for r in taken))
    supply = {k: n for k, n in supply.items() if n > 0}
    left = spec["total"] - len(pick.order)
    if spec.get("control_first"):
        targets = {k: 1 for k in [k for k in sorted(CONTROL_TAGS) if supply.get(k)][:left]}
        for k, n in _shares({k: n for k, n in supply.items() if k not in targets}, left - len(targets)).items():
            targets[k] = n
    else:
        targets = _shares(supply, left)
    by_type: dict[str, list] = {}
    for r in by_hash:
        by_type.setdefault(r.entity_type, []).append(r)
    pick.rounds(by_type, targets, supply)
    pick.drain(by_hash, spec["total"])
    return pick.order


def _challenge(rows, counts: dict[str, int], spec: Mapping) -> list[int]:
    pick = _Picker(spec["cap"], spec["total"])
    ordered = sorted(rows, key=lambda r: (-(r.challenge + r.bonus), r.entity_type not in AMBIGUOUS_TAGS, r.h, r.id))
    by_hash = sorted(rows, key=lambda r: (r.h, r.id))
    minimums = spec.get("minimums", {}).get(rows[0].subject, {}) if rows else {}
    short = False
    for kind, quota in minimums.items():
        short |= pick.drain((r for r in ordered if r.entity_type == kind), quota) < quota
    pick.drain(by_hash if short else ordered, spec["total"])
    pick.drain(by_hash, spec["total"])
    return pick.order


def _prune(items: DataFrame, name: str, groups: Sequence[str], order: Sequence[Column], cap: int, total: int) -> DataFrame:
    """All rows of one ordering that a capped selection of ``total`` rows could ever reach."""
    per_session = first_k(items, [*groups, "session_id"], order, cap)
    return first_k(per_session, groups, order, total).select("subject", "id").withColumn("__list", F.lit(name))


def _select(items: DataFrame, chooser, spec: Mapping, lists: Sequence[tuple[str, Sequence[str], Sequence[Column], Column | None]]) -> DataFrame:
    cap, total = spec["cap"], spec["total"]
    columns = ["subject", "id", "session_id", "entity_type", "h", "challenge", "private_prior", "person_private", "bonus"]
    items = cut_lineage(items.select(*columns))  # every list reads the scores; texts and cues are gone through once
    ids = None
    for name, groups, order, where in lists:
        part = _prune(items if where is None else items.filter(where), name, groups, order, cap, total)
        ids = part if ids is None else ids.unionByName(part)
    wanted = ids.select("subject", "id").distinct()
    reach = items.join(wanted, ["subject", "id"], "left_semi").select(*columns)
    counts = items.groupBy("subject", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*[F.col(c).alias(c) for c in counts.columns])  # fresh columns for the cogroup

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.reset_index(drop=True)
        rows = list(left.itertuples())
        order = chooser(rows, dict(zip(right.entity_type, right.n)), spec)
        return pd.DataFrame({
            "subject": left.subject.iloc[order].to_list(), "id": left.id.iloc[order].to_list(),
            "pick": range(1, len(order) + 1)})

    return reach.groupBy("subject").cogroup(counts.groupBy("subject")).applyInPandas(run, "subject string, id string, pick long")


def _by_hash() -> list[Column]:
    return [F.col("h"), F.col("id")]


def select_natural(items: DataFrame, total: int, cap: int, seed: int, version: str = "pilot", reserve: int = 40,
                   person_reserve: int = 15) -> DataFrame:
    """``subject, id, pick`` of the natural slice; ``items`` come from :func:`score_items`.

    Lists are cut to what a selection of ``total`` can reach (at most ``total`` rows
    each) before one task per subject walks them.
    """
    held = items.withColumn("h", stable_hash(F.col("id"), seed))
    spec: dict = {"cap": cap, "total": total}
    lists: list = [("type", ["subject", "entity_type"], _by_hash(), None), ("fill", ["subject"], _by_hash(), None)]
    if version == "pilot":
        spec["control_first"] = True
    else:
        above = 1 if version == "v1" else 0
        spec |= {"reserve": reserve, "prior_above": above}
        lists.append(("prior", ["subject"], [F.desc("private_prior"), *_by_hash()], F.col("private_prior") > above))
        lists.append(("control", ["subject"], _by_hash(), F.col("entity_type").isin(*CONTROL_TAGS)))
        if version == "v2":
            spec["person_reserve"] = person_reserve
            lists.append(("person", ["subject"], [F.desc("person_private"), *_by_hash()], F.col("person_private") > 0))
    return _select(held, _natural, spec, lists)


def select_challenge(items: DataFrame, total: int, cap: int, seed: int, excluded: DataFrame | None = None,
                     version: str = "v2") -> DataFrame:
    """``subject, id, pick`` of the challenge slice, hardest first."""
    held = items.filter(F.col("entity_type").isin(*CHALLENGE_TAGS)).withColumn("h", stable_hash(F.col("id"), seed))
    if excluded is not None:
        held = held.join(excluded.select("id"), "id", "left_anti")
    if version == "pilot":
        held = held.withColumn("bonus", F.lit(0))
    hard = [(F.col("challenge") + F.col("bonus")).desc(), F.col("entity_type").isin(*AMBIGUOUS_TAGS).cast("int").desc(), *_by_hash()]
    spec: dict = {"cap": cap, "total": total}
    lists: list = [("hard", ["subject"], hard, None), ("fill", ["subject"], _by_hash(), None)]
    if version == "v2":
        spec["minimums"] = CHALLENGE_MINIMUMS
        lists.append(("type", ["subject", "entity_type"], hard, None))
    return _select(held, _challenge, spec, lists)


# --- span pool --------------------------------------------------------------------------------------
POOL_SOURCES = ("legacy_positive", "candidate_gold", "candidate_prediction", "titlecase_probe", "math_probe")


def span_pool(candidates: DataFrame, legacy: DataFrame | None = None, pred_per_row: int = 2, title_per_row: int = 1,
              math_per_row: int = 1) -> DataFrame:
    """Annotation pool rows ``source_row_id, pool_source, start, end, span_text, ...``.

    Gold spans all enter; then probes that overlap neither gold nor an earlier probe of
    the row, within a budget per source.  That state is local to the row.  ``legacy``
    (source_row_id, span_text, ord) enters first and wins duplicates.
    """
    t = "array<struct<src:int,start:int,end:int>>"
    held = candidates.withColumn("__gold", L.spans_lenient("gold_labels")).withColumn("__pred", L.spans_lenient("pred_labels"))
    held = held.withColumn("__title", R.titlecase_probes(F.col("tokens"))).withColumn("__math", R.math_like_spans(F.col("tokens")))
    tag = lambda c, i: f"transform({c}, s -> named_struct('src', {i}, 'start', int(s.start), 'end', int(s.`end`)))"
    budget = f"case s.src when 2 then {pred_per_row} when 3 then {title_per_row} else {math_per_row} end"
    step = (
        f"if(size(filter(a, x -> x.src = s.src)) >= {budget} or exists(a, x -> {L.overlap_sql('x', 's')}), a, concat(a, array(s)))"
    )
    pool = (
        f"aggregate(concat({tag('__pred', 2)}, {tag('__title', 3)}, {tag('__math', 4)}), cast({tag('__gold', 1)} as {t}), "
        f"(a, s) -> cast({step} as {t}))")
    # A span travels with its own tokens, not with those of its row.
    rows = explode_rows(held.withColumn("__pool", F.expr(bind("tokens", lambda ts: (
        f"transform({pool}, s -> named_struct('src', s.src, 'start', s.start, 'end', s.`end`, "
        f"'words', slice({ts}, s.start + 1, s.`end` - s.start)))")))).select("id", "subject", "__pool"), F.col("__pool"), "s").select(
        F.col("id").alias("source_row_id"), "subject", "s.src", "s.start", "s.end", F.lit(0).cast("long").alias("ord"),
        F.array_join("s.words", " ").alias("span_text"), "s.words")
    if legacy is not None:
        own = candidates.select(F.col("id").alias("source_row_id"), "subject", "tokens")
        found = legacy.withColumn("__w", tokenize(F.col("span_text"))).join(own, "source_row_id").withColumn(
            "__f", L.find_subsequence("tokens", "__w"))
        rows = rows.unionByName(found.select(
            "source_row_id", "subject", F.lit(0).alias("src"), F.col("__f.start").alias("start"), F.col("__f.end").alias("end"),
            F.col("ord").cast("long").alias("ord"), "span_text", F.lit(None).cast("array<string>").alias("words")))
    key = F.when(F.col("start").isNotNull(), F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"))).otherwise(
        F.concat_ws("|", F.col("src").cast("string"), fold_case(F.col("span_text"))))
    once = first_k(rows.withColumn("__k", key), ["source_row_id", "__k"], [F.col("src"), F.col("ord")], 1).drop("__k", "ord")
    names = F.array(*[F.lit(s) for s in POOL_SOURCES])
    return once.withColumn("pool_source", F.get(names, F.col("src"))).withColumn(
        "suggested_action", F.when(F.col("src") == 0, "REDACT").when(F.col("src") == 3, "REVIEW").when(
            F.col("src") == 4, "KEEP").otherwise(R.pool_suggestion(F.col("span_text"), F.col("words")))).drop("src", "words")


# --- stratified and balanced splits ------------------------------------------------------------------
def allocate(total: int, weights: Mapping[str, int]) -> dict[str, int]:
    """``total`` shared out by weight: floors, then one each to the largest weights (ties by name)."""
    whole = sum(weights.values())
    if whole <= 0:
        raise ValueError("weights must add up to more than nothing")
    out = {s: total * w // whole for s, w in weights.items()}
    order = sorted(weights, key=lambda s: (-weights[s], s))
    for i in range(total - sum(out.values())):
        out[order[i % len(order)]] += 1
    return out


FOLD_CHUNK = 1 << 16  # dialogues whose codes travel in one row


def _deal(state: list[np.ndarray], goals: list[np.ndarray], codes: list[int], splits: list[int], counts: list[int]) -> list[int]:
    """Splits of the dialogues of one block, in order, by the largest deficits of the splits still open in it.

    ``codes`` are rare types as bits above the bit for positive; ``state`` and ``goals`` hold, for positives and then for each
    rare type, a number per split.  ``state`` is brought forward.
    """
    left, out = list(range(len(splits))), []
    for code in codes:
        kinds = [i + 1 for i in range(len(goals) - 1) if code >> (i + 1) & 1]
        gap = lambda kind, s: max(int(goals[kind][s] - state[kind][s]), 0)
        best = min(left, key=lambda j: (-sum(gap(kind, splits[j]) for kind in kinds), -gap(0, splits[j]) if code & 1 else 0, counts[j], splits[j]))
        left.remove(best)
        out.append(splits[best])
        for kind in ([0] if code & 1 else []) + kinds:
            state[kind][splits[best]] += 1
    return out


def _fold(goals: list[np.ndarray]):
    """Walks the chunks ``(chunk, items)`` in order; an item packs a dialogue's code, its place's split and count, and whether a block opens.

    What passes from block to block is a count per split and type.  Chunks are read one after the other, so this is the one
    sequential part; a block is at most one dialogue per split and may reach over the end of a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [np.zeros(len(g), np.int64) for g in goals]
        block: list[tuple[int, int, int]] = []
        done: list[int] = []
        due: list[tuple[int, int]] = []  # chunks not yet given out, with their sizes

        def close():
            if block:
                codes, splits, counts = (list(x) for x in zip(*block))
                done.extend(_deal(state, goals, codes, splits, counts))
                block.clear()

        def ready():
            while due and len(done) >= due[0][1]:
                chunk, size = due.pop(0)
                out = pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([done[:size]], pa.list_(pa.int32()))], ["chunk", "splits"])
                del done[:size]
                yield out

        for batch in batches:
            for chunk, items in zip(batch.column(0).to_pylist(), batch.column(1)):
                due.append((chunk, len(items.values)))
                for item in items.values.to_pylist():
                    if item["opens"]:
                        close()
                    block.append((item["code"], item["split"], item["count"]))
                yield from ready()
        close()
        yield from ready()

    return run


def stratified_split(dialogues: DataFrame, targets: Mapping[str, int], seed: int, rare: Sequence[str] = RARE_TYPES) -> DataFrame:
    """``dialogue_id, split``; ``dialogues``: dialogue_id, types array<string>, has_positive.

    Dialogues come in the order of their number of rare types, positive first, then by hash.  Each goes to the split with
    the least fill that is still open; of equally full ones to the one that lacks most of the dialogue's rare types, then to the one
    that lacks most positives, then to the one of fewer dialogues, then by name.

    How full the splits are does not depend on what they hold, so the places can be laid out beforehand: places of equal fill form
    a block of one dialogue for each of its splits, and deficits only decide who goes where inside it.  Dialogues without rare types and
    positives take the places as they lie.  The others are a prefix of the order; a fold with a
    count per split and type walks their blocks, a chunk of packed codes at a time.  Targets that do not add up to the number of
    dialogues are an error.
    """
    names = sorted(targets)
    code = F.coalesce(F.col("has_positive"), F.lit(False)).cast("long")
    for i, kind in enumerate(rare):
        code = code + F.when(F.array_contains("types", kind), F.lit(2 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    held = dialogues.select("dialogue_id", code.alias("code"), stable_hash(F.col("dialogue_id"), seed).alias("h"))
    held = held.withColumn("pos", F.col("code").bitwiseAND(1)).withColumn("width", F.bit_count("code") - F.col("pos"))
    held = cut_lineage(held)  # narrow rows, read several times below
    with_type = [F.count_if(F.col("code").bitwiseAND(1 << i) > 0).alias(f"t{i}") for i in range(len(rare) + 1)]
    totals = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code") > 0).alias("open"), *with_type).first()
    if totals.n != sum(targets.values()):
        raise ValueError(f"targets add up to {sum(targets.values())}, dialogues are {totals.n}")
    lead = F.concat(F.lpad((99 - F.col("width")).cast("string"), 2, "0"), (1 - F.col("pos")).cast("string"), hash_block(F.col("h")))
    order = ranked(held, [], [F.desc("width"), F.desc("pos"), F.col("h"), F.col("dialogue_id")], lead, "slot").select("slot", "dialogue_id", "code")
    places = None
    for at, name in enumerate(names):
        part = dialogues.sparkSession.range(targets[name]).select(
            (F.col("id") / targets[name]).alias("fill"), F.col("id").alias("count"), F.lit(at).alias("split"))
        places = part if places is None else places.unionByName(part)
    slots = ranked(places, [], [F.col("fill"), F.col("count"), F.col("split")], F.floor(F.col("fill") * 4096), "slot")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("split") + 1).alias("split")
    met = order.join(slots, "slot")
    if not totals.open:
        return met.select("dialogue_id", named)
    met = cut_lineage(met)
    # Blocks up to the last one that holds a dialogue with a code; the rest stays as it lies.
    last = met.filter(F.col("slot") <= totals.open).agg(F.max("fill")).first()[0]
    goals = [allocate(totals[f"t{i}"], targets) for i in range(len(rare) + 1)]
    ordered = [np.array([g[n] for n in names], np.int64) for g in goals]
    ahead = met.filter(F.col("fill") <= last)
    chunk = F.floor((F.col("slot") - 1) / FOLD_CHUNK)
    first = F.min("slot").over(Window.partitionBy("fill"))
    item = F.struct("slot", "code", "split", "count", (F.col("slot") == F.col("first")).alias("opens"))
    chunks = ahead.withColumn("first", first).groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    dealt = cut_lineage(chunks.repartition(1).sortWithinPartitions("chunk").mapInArrow(_fold(ordered), "chunk long, splits array<int>"))
    found = dealt.select("chunk", F.posexplode("splits").alias("at", "split")).select(
        (F.col("chunk") * FOLD_CHUNK + F.col("at") + 1).alias("slot"), "split")
    head = ahead.select("slot", "dialogue_id").join(found, "slot").select("dialogue_id", "split")
    return head.unionByName(met.filter(F.col("fill") > last).select("dialogue_id", "split")).select("dialogue_id", named)


def balanced_split(rows: DataFrame, counts_by_split: Mapping[str, int], seed: int, key: str = "id") -> DataFrame:
    """``subject, id, split``: per subject, hardest rows first, dealt to the emptiest split.

    ``rows``: subject, id, missed_any, has_multispan_seed, has_redact_seed.  Dealing is a
    slot table ranked by fill; rows and slots meet on their rank.  A subject with fewer rows
    than its quota is an error.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    held = rows.select("subject", key, flag("missed_any").alias("a"), flag("has_multispan_seed").alias("b"),
                       flag("has_redact_seed").alias("c"), stable_hash(F.col(key), seed).alias("h"))
    held = cut_lineage(held)  # narrow rows, read three times below
    lead = F.concat(*[(1 - F.col(x)).cast("string") for x in "abc"], hash_block(F.col("h")))
    order = ranked(held, ["subject"], [F.desc("a"), F.desc("b"), F.desc("c"), F.col("h"), F.col(key)], lead, "slot")
    subjects = held.select("subject").distinct()
    quotas = None
    for split, total in counts_by_split.items():
        part = even_quotas(subjects, "subject", total).withColumn("split", F.lit(split))
        quotas = part if quotas is None else quotas.unionByName(part)
    quotas = quotas.filter("quota > 0")
    short = quotas.groupBy("subject").agg(F.sum("quota").alias("wanted")).join(held.groupBy("subject").agg(F.count(F.lit(1)).alias("rows")), "subject")
    require_none(short.filter("rows < wanted"), "subjects with too few rows")
    slots = explode_rows(quotas, F.expr("sequence(0, int(quota) - 1)"), "k").withColumn("fill", F.col("k") / F.col("quota"))
    slots = ranked(slots, ["subject"], [F.col("fill"), F.desc("quota"), F.col("split")], F.floor(F.col("fill") * 1024), "slot")
    return order.join(slots, ["subject", "slot"]).select("subject", key, "split")


def oversize_report(turns: DataFrame) -> DataFrame:
    """Turns dropped as oversize, counted per reason (both reasons count) and subject."""
    rows = explode_rows(turns, R.oversize_reasons(F.col("text"), F.col("tag_count")), "reason")
    return rows.groupBy("subject", "reason").agg(F.count(F.lit(1)).alias("n"))
