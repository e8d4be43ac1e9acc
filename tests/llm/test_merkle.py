"""Merkle manifest: against a sequential tree, tampered rows, edge rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilspan.llm.merkle import as_hex, folded, manifest, proof_digest

SCHEMA = "doc_id long, lang string, text string, grp string, idx int, n int, digest string"


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def frame(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows, arity):
    """{(id, leaf): (subroot, root, proof digest)} by plain lists; equal rows give equal leaves."""
    def up(level):
        trace = []
        while len(level) > 1:
            runs = [level[i:i + arity] for i in range(0, len(level), arity)]
            trace.append(runs)
            level = [H("".join(r)) for r in runs]
        return trace, level[0]

    def siblings(trace, i):
        out = []
        for runs in trace:
            run = runs[i // arity]
            out += run[:i % arity] + run[i % arity + 1:]
            i //= arity
        return out

    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append((r[0] is not None, r[0] or 0, H("".join(map(frame, r[:3])))))
    trees = {}
    for g in sorted(groups):
        leaves = [x[2] for x in sorted(groups[g])]
        trees[g] = (leaves, *up(leaves))
    top_trace, root = up([t[2] for t in trees.values()])
    out = []
    for at, (g, (leaves, trace, sub)) in enumerate(trees.items()):
        ids = [x[1] if x[0] else None for x in sorted(groups[g])]
        for i, leaf in enumerate(leaves):
            out.append((ids[i], leaf, sub, root, H("".join(siblings(trace, i) + siblings(top_trace, at)))))
    return sorted(out, key=repr)


def found(spark, rows, arity):
    full = [(*r, "g", 1, 2, "x") for r in rows]  # extra columns that clash with inner names
    df = spark.createDataFrame(full, SCHEMA)
    got = manifest(df, [F.col("doc_id"), F.col("lang"), F.col("text")], F.col("lang"), F.col("doc_id"), arity=arity)
    got = got.select("id", *[as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], as_hex(proof_digest(F.col("path"))).alias("p"),
                     (folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    return sorted([tuple(r)[:5] for r in got], key=repr)


@pytest.mark.parametrize("arity", [2, 8])
def test_equals_a_sequential_tree(spark, arity):
    rng = random.Random(arity)
    langs = ["en"] * 6 + ["de", "zz", None, "", "é"]
    rows = [(rng.randrange(-40, 400), rng.choice(langs), rng.choice(["", None, "Ab", "ü x " * rng.randrange(9)])) for _ in range(150)]
    rows += rows[:3] + [(None, "en", "x"), (None, None, None), (5, "solo", "y")]
    assert found(spark, rows, arity) == brute(rows, arity)


def test_many_groups_one_row_and_none(spark):
    assert found(spark, [(i, f"g{i}", "t") for i in range(20)], 8) == brute([(i, f"g{i}", "t") for i in range(20)], 8)
    assert found(spark, [(1, None, "t")], 8) == brute([(1, None, "t")], 8)
    assert found(spark, [], 8) == []


def test_changed_rows_do_not_verify(spark):
    rows = [(i, "en", t) for i, t in enumerate(["Ab", "ab", "", None, "C" * 200_000] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    from veilspan.llm.merkle import leaf_digest

    cols = [F.col("doc_id"), F.col("lang")]
    got = manifest(df, [*cols, F.col("text")], F.col("lang"), F.col("doc_id"), carry=leaf_digest([*cols, F.lower("text")]))
    kept = {r.id: r.ok for r in got.select("id", (folded(F.col("kept"), F.col("path")) == F.col("root")).alias("ok")).collect()}
    assert kept == {i: t is None or t == t.lower() for i, _, t in rows}


def test_arity_is_checked(spark):
    with pytest.raises(ValueError):
        manifest(spark.range(1), [F.col("id")], F.col("id"), F.col("id"), arity=1)
