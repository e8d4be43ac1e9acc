"""Periodic runs against brute force: every start and period."""

import hashlib
import random
import zlib

import pytest

from veilspan.llm.periodic_runs import coded, periodic_runs, runs_of
from veilspan.llm.queries import with_planted_periods


def brute(w, min_length=6, e=4):
    """Longest stretch of each period from each start; its smallest period must be that one."""
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, e * q) and not any(
                    all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (9, 3)])
def test_equals_brute_force(seed, limits):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        w = [rng.choice([b"a", b"b", b"c"][:rng.randrange(1, 4)]) for _ in range(rng.randrange(30))]
        w += [rng.choice([b"a", b"b", b"x"]) for _ in range(rng.randrange(1, 9))] * rng.randrange(6)
        texts.append(w + [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(12))])
    codes, starts = coded(texts)
    got = {k: [] for k in range(len(texts))}
    for p, length, d in runs_of(codes, starts, *limits):
        k = max(i for i in range(len(texts)) if starts[i] <= p and texts[i])
        got[k].append((p - starts[k], length, d))
    assert got == {k: brute(w, *limits) for k, w in enumerate(texts)}


def expected(text, doc_id=None, plant=False):
    w = (text or "").encode().split()
    n = len(w)
    if plant:
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop).decode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_rows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["x", "y", "z\x0b", " ", "né", "\x85"])
    texts = [None, "", " \t\n ", "one", "a " * 6, "a " * 5, "a b " * 40 + "c", "x\ta b\n a b\ra b a b", "q r s t " * 4]
    texts += [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(3, "a " * 9, "r", 1)] * 2 + [(None, "b " * 8, "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, length int")
    import pyspark.sql.functions as F

    for plant in (False, True):
        given = with_planted_periods(docs.select("doc_id", "text")) if plant else docs
        got = periodic_runs(given).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                          F.sha2(F.col("collapsed").cast("binary"), 256)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((expected(t, i, plant) for i, t, *_ in rows), key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_long_texts(spark):
    """Longer than one batch of words, each all one run, and one long text without a run."""
    one, two = "w " * 300_000, " ".join(f"v{i % 50_000}" for i in range(270_000))
    three = " ".join(f"u{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, one), (2, two), (3, three), (4, "s " * 7)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic_runs(docs).collect()}
    assert got == {1: (300_000, 1, 0, 300_000, 1, 300_000_000), 2: (270_000, 1, 0, 270_000, 50_000, 5_400), 3: (300_000, 0, None, None, None, None),
                   4: (7, 1, 0, 7, 1, 7_000)}
