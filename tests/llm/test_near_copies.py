import random

import numpy as np
import pytest
import xxhash

from veilspan.llm import simhash, substring_dedup
from veilspan.llm.components import connected_components

DOC = "doc_id long, text string, fp string, component_id long"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_fingerprint(text, size=4):
    w = [x for x in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if x]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def documents():
    rows, rng = [], random.Random(1)
    for k in range(60):
        base = words(80, k)
        rows.append((3 * k, " ".join(base)))
        for c in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(80)] = f"x{c}"
            rows.append((3 * k + c + 1000, " ".join(copy)))
    long = " ".join(words(30_000, 99))
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, long), (5004, long), (5003, long), (None, long), (5005, "one two"),
                   (5006, "One TWO"), (5007, "Äb Äb")]


def plain_components(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, f, least.get(g)) for (d, _), f, g in zip(rows, fps, group)]


def test_fingerprints_and_components_are_those_of_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "clash", 7) for d, t in rows], DOC).repartition(5)
    found = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted(plain_components(rows), key=str)


def test_every_pair_within_the_radius_shares_a_mask():
    rng = random.Random(3)
    for free in (simhash.ALL, 0x00FF00FF0F0F3333):
        masks, bits = simhash.covering_masks(free), [i for i in range(64) if free >> i & 1]
        assert len(masks) == 31
        for _ in range(3000):
            difference = sum(1 << b for b in rng.sample(bits, 4))
            assert any(m & difference == 0 for m in masks)


def test_buckets_too_large_to_hold_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12))) for _ in range(260)}
    rows = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long").coalesce(1)

    def groups(bucket):
        from veilspan.llm import simhash as module
        monkeypatch.setattr(module, "BUCKET", bucket)
        roots = {r.node: r.root for r in connected_components(module.near_links(rows)).collect()}
        return {simhash.signed(x): roots.get(simhash.signed(x), simhash.signed(x)) for x in fps}

    expected = {simhash.signed(x): simhash.signed(x) for x in fps}
    values = sorted(expected)
    for _ in values:
        now = {a: min(expected[b] for b in values if ((a ^ b) % (1 << 64)).bit_count() <= 4) for a in values}
        if now == expected:
            break
        expected = now
    assert groups(1024) == expected
    # a run function that splits every bucket of more than 20 gives the same links
    split = simhash._bucket_links(4)
    monkeypatch.setattr(simhash, "BUCKET", 20)
    import pyarrow as pa
    level = [(m, simhash.signed(x) & m, simhash.signed(x)) for m in map(simhash.signed, simhash.covering_masks()) for x in fps]
    pairs = set()
    while level:
        level.sort()
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in level], pa.int64()) for k in range(3)], ["mask", "key", "fp"])
        level = []
        for out in split(iter([batch.slice(0, 7), batch.slice(7)])):
            for m, k, a, b, hot in zip(*(c.to_pylist() for c in out.columns)):
                level.append((m, k, a)) if hot else pairs.add((a, b))
    label = {x: x for x in values}
    for _ in range(len(values)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert label == expected


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_one_row_of_a_group_and_all_columns(spark):
    docs = spark.createDataFrame([(d, t, "clash", 7) for d, t in documents()], DOC)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None not in ids and len(ids) == len(set(ids))
    assert set(ids) == {c for _, _, c in plain_components(documents())}
    assert simhash.one_of_each(docs.limit(0)).count() == simhash.near_duplicates(docs.limit(0)).count() == 0


def plain_repeats(rows, size):
    first, out = {}, []
    for d, t in rows:
        w = (t or "").split()
        for j in range(len(w) - size + 1):
            key = tuple(w[j:j + size])
            first[key] = min(first.get(key, d), d)
    for d, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < d:
                gone[j:j + size] = [True] * size
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("size,anchor", [(13, 5), (6, 3)])
def test_removed_words_are_those_of_brute_force(spark, size, anchor):
    rng, rows = random.Random(size), []
    passages = [words(rng.randrange(size - 1, 40), 500 + k, 30) for k in range(12)]
    for d in range(80):
        w = []
        for _ in range(rng.randrange(5)):
            w += words(rng.randrange(12), rng.random(), 30) + (rng.choice(passages) if rng.random() < 0.7 else [])
        rows.append((d * 2, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, " ".join(words(20_000, 4, 3))), (1004, " ".join(words(20_000, 4, 3))),
             (1004, " ".join(passages[0])), (1004, " ".join(passages[0]))]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, kept string").repartition(6)
    found = substring_dedup.without_repeats(docs, size=size, anchor=anchor)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == sorted(plain_repeats(rows, size))
    for r in found.filter("n_removed > 0").collect():
        covered = set()
        for f in r.factors:
            assert f.end - f.start >= size and f.source < r.doc_id
            covered |= set(range(f.start, f.end))
        assert len(covered) == r.n_removed


def test_repeats_without_ids_and_without_rows(spark):
    text = " ".join(words(30, 8))
    docs = spark.createDataFrame([(None, text), (4, text)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.without_repeats(docs).collect()} == {(None, 30), (4, 0)}
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_greedy_factors_break_where_the_source_changes():
    windows = np.array([5, 6, 7, 8, 9], np.uint64)
    known, source = np.array([5, 6, 7, 9], np.uint64), np.array([1, 1, 2, 3])
    assert substring_dedup.factors(windows, known, source, 3) == [(0, 4, 1), (2, 5, 2), (4, 7, 3)]
