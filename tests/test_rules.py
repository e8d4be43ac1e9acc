"""Row rules against literal expectations and plain twins."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import prompts as P
from veilspan.functions import rules as R


def rows(spark, schema, data):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("text,kind,want", [
    ("mail a.b@c.org now", None, ("pattern", "EMAIL_ADDRESS")), ("www.x.y", None, ("pattern", "URL")), ("10.0.0.255", None, ("pattern", "IP_ADDRESS")),
    ("999.1.1.1x", None, None), ("123-45-6789", None, ("pattern", "US_SSN")), ("Born in", None, ("pattern", "DATE_OF_BIRTH")),
    ("DL1234567", None, ("pattern", "US_DRIVER_LICENSE")), ("anything", " url ", ("entity_type", "URL")), ("plain", "PERSON", None), (None, None, None)])
def test_direct_ids(spark, text, kind, want):
    row = rows(spark, "t string, k string", [(text, kind)]).select(R.detect_direct_id(F.col("t"), F.col("k")).alias("d")).first()
    assert (tuple(row.d) if row.d else None) == want


MATH = {"add", "angle", "circle", "coefficient", "diameter", "equation", "expression", "fraction", "graph", "intercept", "line", "multiply",
        "radius", "slope", "solve", "subtract", "triangle", "variable"}
SIGNS = set("xyz+-*/=().,%^<>")
TITLES = {"mr", "mrs", "ms", "dr", "prof", "teacher", "tutor"}
STOP = {"hi", "hello", "hey", "thanks", "thank", "ok", "okay", "yes", "no", "i"}


def plain_math(tokens):
    words = [t.strip() for t in tokens if t.strip()]
    joined = "".join(words)
    if not words or (len(words) == 1 and words[0].lower() in "xyz") or not any(c.isalnum() for c in joined):
        return False
    digit = any(c.isdigit() for c in joined)
    if all(w.isdigit() or w.lower() in SIGNS for w in words):
        return digit
    if any(w.lower() in MATH for w in words):
        return True
    return len(words) > 1 and digit and any(c in "+-*/=^<>" for c in joined)


def plain_probes(tokens):
    out, i = [], 0
    up = lambda k: k < len(tokens) and tokens[k][:1].isupper()
    while i < len(tokens):
        word = tokens[i].strip(".,!?()[]{}:;\"'").lower()
        size = 0
        if word in STOP:
            size = 0
        elif word in TITLES and up(i + 1):
            size = 2
        elif up(i):
            size = 3 if up(i + 1) and up(i + 2) else 2 if up(i + 1) else 1
        if size:
            out.append((i, i + size))
        i += size or 1
    return out


def test_math_and_title_spans_match_twins(spark):
    rng = random.Random(4)
    words = ["Mr", "Anna", "hi", "Hi", "x", "3", "+", "slope", "Bo", "the", "=", "12", ",", "Dr", "y", "Élan"]
    data = [([rng.choice(words) for _ in range(rng.randint(0, 14))],) for _ in range(200)]
    df = rows(spark, "t array<string>", data).select("t", R.math_like_spans(F.col("t")).alias("m"), R.titlecase_probes(F.col("t")).alias("p"))
    for r in df.collect():
        want = []
        for a in range(len(r.t)):
            hit = next((b for b in range(a + 1, min(len(r.t), a + 4) + 1) if plain_math(r.t[a:b])), None)
            if hit:
                want.append((a, hit))
        assert [tuple(x) for x in r.m] == want, r.t
        assert [tuple(x) for x in r.p] == plain_probes(r.t), r.t


def test_name_like(spark):
    data = [(["Anna", "Lee"], True), (["anna"], False), (["dr.", "who"], True), (["12"], False), (["(", "Bo", ")"], True), ([" "], False)]
    for r in rows(spark, "t array<string>, w boolean", data).select("*", R.is_name_like(F.col("t")).alias("g")).collect():
        assert r.g == r.w, r.t


def test_private_prior(spark):
    data = [
        ("hi Ana, my name is (Bo)", "hi Ana, my name is (Bo)", "(Bo)", "PERSON", "english", 7),
        ("Hello Ana!", "Hello Ana!", "Ana", "PERSON", "english", 2),
        ("I live in Ost, call me", "x", "Ost", "LOCATION", "english", 9),
        ("nothing", "nothing", "Ana", "PERSON", "english", 0),
    ]
    c = [F.col(x) for x in ("t", "tt", "s", "e", "sub", "i")]
    got = rows(spark, "t string, tt string, s string, e string, sub string, i int", data).select(
        R.private_prior_v1(c[0], c[2], c[3]).alias("v1"), R.private_prior_v2(*c).alias("v2"), R.person_private_score(*c).alias("p")).collect()
    # A span that ends in a bracket has no word boundary after it, as in the original template.
    assert [tuple(r) for r in got] == [(0, 0, 0), (3, 8, 8), (3, 3, 0), (0, 0, 0)]


def test_responses(spark):
    good = '{"action_label": "KEEP", "semantic_role": "PRIVATE"}'
    data = [(good,), (f"```json\n{good}\n```",), ('{"action_label": KEEP, "semantic_role": "PRIVATE"}',), (f"<think>{{}}</think> {good}",),
            ('{"action_label": "KEEPS", "semantic_role": "private"}',), ('{"action_label": "KEEP"}',), ("[1]",), ('{"action_label": "KEEP", "semantic_role": "X"}',)]
    got = rows(spark, "t string", data).select(R.parse_response(F.col("t")).alias("a"), R.parse_response_tolerant(F.col("t")).alias("b")).collect()
    assert [r.a.action_label for r in got] == ["KEEP", "KEEP"] + [None] * 6
    assert [r.b.action_label for r in got] == ["KEEP"] * 5 + [None] * 3
    assert got[5].a.error == "unexpected keys" and got[7].a.error == "bad semantic_role" and got[6].a.error == "invalid JSON object"


def test_canonical_types(spark):
    data = [("person-name", "NAME"), (" e mail ", "EMAIL"), ("odd", "ODD"), ("", "SUSPECT"), (None, "SUSPECT")]
    for r in rows(spark, "t string, w string", data).select("w", R.canonical_type(F.col("t")).alias("g")).collect():
        assert r.g == r.w


def test_prompts(spark):
    df = rows(spark, "turn string, a int, b int", [("hello Bo!", 6, 8), ("hello Bo!", -1, 3), ("hello Bo!", 6, 99)])
    got = [r[0] for r in df.select(P.mark_target(F.col("turn"), F.col("a"), F.col("b"))).collect()]
    assert got == ["hello [TGT]Bo[/TGT]!", None, None]
    one = rows(spark, "c string, s string", [("a " * 100 + "Needle" + " b" * 100, "needle"), ("x" * 200, "zz"), ("short", ""), ("", "q")])
    ex = [r[0] for r in one.select(P.span_excerpt(F.col("c"), F.col("s"))).collect()]
    assert ex[0].startswith("...") and ex[0].endswith("...") and len(ex[0]) == 72 + 6 + 72 + 6
    assert ex[1] == "x" * 141 + "..." and ex[2] == "short" and ex[3] == ""
    ctx = rows(spark, "c string", [("u: a\nu: a",)]).select(P.highlight_context(F.col("c"), F.lit("u"), F.lit("a"), F.lit(0), F.lit(1))).first()[0]
    assert ctx == "u: [[a]]  <-- target\nu: a"
