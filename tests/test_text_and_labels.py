"""Tokens, offsets and label arrays against plain Python."""

import random
import re

from pyspark.sql import functions as F

from veilspan.functions import labels as L
from veilspan.functions import tokens as T
from veilspan.functions.text import collapse_space, fold_case, quote_literal

ODD_TEXTS = ["x² + y", "café ñ", "a😀b  c", "Straße", "a\x1cb\x1dc", "a\xa0b", "", "  ", "tab\tnew\nline", "a_b-c", "１２３ ٣"]


def test_tokens_and_offsets_match_python(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("ab ,.\né😀_1") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    df = T.with_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))
    for row in df.collect():
        want = [(m.group(0), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", row.text)]
        if "́" in row.text:  # combining marks are not word characters in Python either
            want = [(m.group(0), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", row.text)]
        assert list(zip(row.tokens, row.starts, row.ends)) == want, row.text


def test_space_and_case(spark):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    for row in df.select("t", collapse_space(F.col("t")).alias("c"), fold_case(F.col("t")).alias("f")).collect():
        assert row.c == " ".join(row.t.split())
        if "́" not in row.t:
            assert row.f == row.t.casefold()


def test_quote_literal_survives_end_marker(spark):
    df = spark.createDataFrame([("a\\Eb", "xa\\Eby"), ("[", "a[b")], "n string, h string")
    assert all(r[0] for r in df.select(F.rlike("h", quote_literal(F.col("n")))).collect())


def test_regex_spans_are_code_points(spark):
    df = spark.createDataFrame([("😀 12 é 345",)], "t string")
    spans = df.select(T.regex_spans("t", "[0-9]+").alias("s")).first().s
    assert [(s.start, s.end, s.text) for s in spans] == [(2, 4, "12"), (7, 10, "345")]


def plain_lenient(labels):
    spans, start = [], None
    for i, x in enumerate(labels + ["O"]):
        if start is not None and x != "I-SUSPECT":
            spans.append((start, i))
            start = None
        if x == "B-SUSPECT":
            start = i
    return spans


def plain_scoring(labels):
    spans, start, last = [], None, "O"
    for i, x in enumerate(labels + ["O"]):
        if start is not None and x != "I-SUSPECT":
            spans.append((start, i))
            start = None
        if x == "B-SUSPECT" or (x == "I-SUSPECT" and last == "O"):
            start = i
        last = x
    return spans


def test_span_readers(spark):
    rng = random.Random(1)
    rows = [[rng.choice(["O", "O", "B-SUSPECT", "I-SUSPECT"]) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "l array<string>")
    for r in df.select("l", L.spans_lenient("l").alias("a"), L.spans_scoring("l").alias("b")).collect():
        assert [tuple(s) for s in r.a] == plain_lenient(r.l)
        assert [tuple(s) for s in r.b] == plain_scoring(r.l)


def test_painting_orders(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        n = rng.randint(0, 9)
        rows.append((n, [(a, a + rng.randint(0, 4)) for a in (rng.randint(-1, n) for _ in range(rng.randint(0, 4)))]))
    df = spark.createDataFrame(rows, "n int, s array<struct<start:int,end:int>>")
    for r in df.select("n", "s", L.labels_from_token_spans("n", "s").alias("l")).collect():
        want = ["O"] * r.n
        for a, b in sorted(tuple(x) for x in r.s):
            if 0 <= a < b <= r.n:
                want[a:b] = ["B-SUSPECT"] + ["I-SUSPECT"] * (b - a - 1)
        assert r.l == want


def test_touching_intervals_merge_but_annotations_do_not(spark):
    df = T.with_tokens(spark.createDataFrame([("ab cd ef",)], "text string")).withColumn(
        "s", F.expr("array(named_struct('start', 0, 'end', 3), named_struct('start', 3, 'end', 5))"))
    row = df.select(L.labels_from_merged_spans("starts", "ends", "s").alias("m"), L.labels_from_char_spans("starts", "ends", "s").alias("a"),
                    L.labels_of_text("text", "tokens", "s").alias("t")).first()
    assert row.m == row.t == ["B-SUSPECT", "I-SUSPECT", "O"]
    assert row.a == ["B-SUSPECT", "B-SUSPECT", "O"]


def test_labels_of_text_count_tokens_and_place_none(spark):
    rng, rows = random.Random(7), []
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bc", "9", "_", " ", "\t", ".", "@", "é", "\U0001d11e", "x1"]) for _ in range(rng.randrange(30)))
        n = len(text)
        rows.append((text, [(a, min(n, a + rng.randint(1, 5))) for a in (rng.randrange(n) for _ in range(rng.randrange(5)))] if n else []))
    df = T.with_tokens(spark.createDataFrame(rows, "text string, s array<struct<start:int,end:int>>"))
    found = df.select(L.labels_of_text("text", "tokens", "s").alias("t"), L.labels_from_merged_spans("starts", "ends", "s").alias("m")).collect()
    assert all(r.t == r.m for r in found) and sum("B-SUSPECT" in r.t for r in found) > 200
    bare = spark.createDataFrame([], "text string, tokens array<string>, s array<struct<start:int,end:int>>")
    plan = bare.select(L.labels_of_text("text", "tokens", "s"))._jdf.queryExecution().analyzed().toString()
    assert f"[{T.SPACE_CLASS}]*" not in plan  # no second pass that finds where each token ends


def test_searched_patterns_find_what_the_stated_ones_find(spark):
    from veilspan.queries import inputs as I

    rng = random.Random(8)
    parts = ["ab.c", "@", "x-y", ".", "com", "1234567", "10.0.0.7", "+49 (30) ", "-", " ", "99", "Abcdefghijklmn", "Ünicodewörtern", "%", "_", "("]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(12))).replace("@", "@" if k % 2 else ""),) for k in range(600)]
    df = spark.createDataFrame(rows, "text string")
    for side, pattern in (("gold", I.GOLD_PATTERN), ("pred", I.PRED_PATTERN)):
        full, plain = I._SEARCHED[side]
        use = F.when(F.contains("text", F.lit("@")), T.regex_spans("text", full)).otherwise(T.regex_spans("text", plain))
        found = df.select(use.alias("a"), T.regex_spans("text", pattern).alias("b")).collect()
        assert all(r.a == r.b for r in found) and sum(len(r.a) > 0 for r in found) > 100


def test_mask_fuses_adjacent_spans(spark):
    df = spark.createDataFrame([(["B-SUSPECT", "B-SUSPECT", "O", "I-SUSPECT"],)], "l array<string>")
    assert df.select(L.mask_to_labels("transform(l, x -> x <> 'O')").alias("m")).first().m == [
        "B-SUSPECT", "I-SUSPECT", "O", "B-SUSPECT"]


def plain_masked(tokens, target, gold, pred, window=6):
    lo, hi = max(0, target[0] - window), min(len(tokens), target[1] + window)
    marks = [(target[0], target[1], "[TARGET_SPAN]")]
    for name, spans in (("[GOLD_SPAN]", gold), ("[PRED_SPAN]", pred)):
        marks += [(a, b, name) for a, b in spans if (a, b) != target and b > lo and a < hi]
    marks.sort(key=lambda m: m[:2])
    out, i = [], lo
    while i < hi:
        hit = next((m for m in marks if m[0] == i), None)
        out.append(hit[2] if hit else tokens[i])
        i = hit[1] if hit else i + 1
    return " ".join(out)


def test_masked_preview(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        n = rng.randint(3, 25)
        some = lambda k: [(a, min(n, a + rng.randint(1, 3))) for a in (rng.randint(0, n - 1) for _ in range(rng.randint(0, k)))]  # noqa: B023, E731
        gold = some(4)
        pred = some(3) + [(1, 2)]
        rows.append(([f"t{i}" for i in range(n)], pred[0], gold, pred))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"w array<string>, t struct<start:int,end:int>, g {kind}, p {kind}")
    for r in df.select("*", L.masked_preview("w", "t", "g", "p").alias("v")).collect():
        assert r.v == plain_masked(r.w, tuple(r.t), [tuple(x) for x in r.g], [tuple(x) for x in r.p])


def test_find_subsequence(spark):
    df = spark.createDataFrame([(["A", "b", "Straße", "C"], ["STRASSE", "c"]), (["a"], [" "]), ([], ["a"])], "t array<string>, w array<string>")
    got = [r.s for r in df.select(L.find_subsequence("t", "w").alias("s")).collect()]
    assert tuple(got[0]) == (2, 4) and got[1] is None and got[2] is None
