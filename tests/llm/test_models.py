import math
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import attention, language_id, lm_scoring, toxicity
from veilspan.llm.text import fold

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_folds_are_crc32_of_the_id_as_text(spark):
    found = spark.range(50).select("id", fold("id", 10).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 10 for r in found)


def mild_and_rude(n, seed=2):
    rng = random.Random(seed)
    plain, rude = [f"plain{k}" for k in range(200)], ["grobian", "schurke", "tropfkopf"]
    texts = []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        bad = k % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(rude)
        texts.append((k, " ".join(w), int(bad)))
    return texts


def test_toxicity_finds_held_out_texts_and_misspellings(spark):
    rows = mild_and_rude(400)
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(3, None), (9999, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels, F.col("doc_id") % 4 != 2, label="toxic").collect()
    held = [(r.predicted, rows[r.doc_id][2]) for r in found if r.doc_id % 4 == 2]
    assert np.mean([p == y for p, y in held]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    model = toxicity.train([t.encode() for _, t, _ in rows], [y for *_, y in rows], steps=300)
    assert model.score(b"plain1 plain2 schurkke plain3") > model.score(b"plain1 plain2 plain7 plain3") + 0.2


def test_toxicity_edge_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "wort " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, none, label="toxic").collect()
    assert len(found) == 5 and len({r.score for r in found}) == 1
    assert toxicity.toxicity(docs.limit(0), none, label="toxic").count() == 0


def test_word_features_split_a_long_text_alike():
    text = "ab cde fghij " * 50
    flat, owner, n = toxicity.word_features(text)
    assert n == 150 and owner.max() == 149 and len(flat) == len(owner)
    one, _, _ = toxicity.word_features("cde")
    assert sorted(flat[owner == 1]) == sorted(one)
    assert len(one) == 3 + 2 + 1 + 1  # three, four and five characters of <cde>, and the word
    assert "".join(toxicity.pieces(("x" * 10 + " ").encode() * 200_000)) == ("x" * 10 + " ") * 200_000


def test_languages_are_told_apart_and_unseen_words_back_off(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "rei", "ung", "ber"]}
    rows = []
    for k in range(300):
        lang = rng.choice(sorted(parts))
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 5))) for _ in range(12)), lang))
    rows += [(900, None, "aa"), (901, "1234 !?", "bb"), (902, "kalo", None), (902, "kalo", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    found = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") % 4 != 2).collect()}
    assert np.mean([found[d].lang_pred == lang for d, _, lang in rows[:300] if d % 4 == 2]) > 0.97
    assert (found[900].lang_pred, found[901].lang_pred, found[902].lang_pred) == ("und", "und", "aa")
    assert all(0 <= r.score <= 1 for r in found.values())
    model = language_id.fit(docs)
    assert model.predict("reischungberreischung".encode())[0] == "bb"  # no such word: n-grams decide
    assert language_id.identify(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        language_id.fit(docs, max_languages=1)


def documents():
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(["the", "of", "Green", "tree\tsits", "on", f"rare{k}", "ÄÖ"], k=rng.randrange(40)))) for k in range(120)]
    return rows + [(500, None), (501, ""), (502, "the " * 20_000), (3, "the of"), (3, "the of"), (None, "green unseen")]


def test_scores_base_counts_and_total_probability(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, word string").repartition(3)
    found = lm_scoring.score_texts(docs, fold("doc_id", 10) != 0, MODEL, head=3, steps=60).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    train = Counter(w for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    expected = sorted((str(d), len(tokens(t)), sum(w in train for w in tokens(t)), n,
                       round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    empty = docs.limit(0)
    assert lm_scoring.score_texts(empty, fold("doc_id", 10) != 0, MODEL, steps=1).count() == 0


def test_head_and_join_give_one_score(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    scores = [sorted((str(r.doc_id), round(r.score, 6)) for r in lm_scoring.score_texts(docs, F.lit(True), MODEL, head=h, steps=40).collect())
              for h in (0, 1000)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("block", (1_500_000, 4_000))
def test_attention_learns_from_every_training_row(spark, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", block, raising=False)
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 63 == 1
    plain = [t for t in (f"tree w{k}" for k in range(5000)) if low(t)][:2100]  # more texts than a sample of the least hashes would take
    cycles = [t for t in (" ".join(["the", "of", "on"] * 20 + [f"w{k}"]) for k in range(900)) if not low(t)][:300]
    asked = [" ".join(["the", "of", "on"] * 10), " ".join(["the", "on", "of"] * 10)]
    rows = [(k, t, True) for k, t in enumerate(plain + cycles)] + [(10_000 + k, t, False) for k, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, l boolean")
    found = lm_scoring.score_texts(docs, F.col("l"), MODEL, steps=150)
    right, turned = (r.score for r in found.filter("doc_id >= 10000").orderBy("doc_id").collect())
    assert right > turned + 5


def test_words_of_a_class_have_at_most_all_its_probability():
    pieces = {b"th": 1, b"a": 2}
    counts = Counter({b"the": 5, b"tha": 2, b"ab": 3})
    cells = np.zeros(lm_scoring.CONTEXTS * lm_scoring.SYMBOLS)
    np.add.at(cells, lm_scoring.spelling_cells(list(counts), np.ones(3, int))[0], 1)
    table = cells.reshape(lm_scoring.CONTEXTS, lm_scoring.SYMBOLS) + 0.01
    spelling = np.log10(table / table.sum(1, keepdims=True)).ravel()
    by_hand = [((0 * 7919 + 116 * 104729 + 104 * 1299709) % lm_scoring.CONTEXTS) * 257 + 101, ((116 * 7919 + 104 * 104729 + 101 * 1299709) % lm_scoring.CONTEXTS) * 257 + 256]
    found, begin = lm_scoring.spelling_cells([b"a", b"the"], np.array([1, 2]))
    assert found[1:].tolist() == by_hand and begin.tolist() == [0, 1]
    model = lm_scoring.WordModel(pieces, {1: 2, 2: 3}, np.array([1, 0, 7, 3]), np.array([0, 0, 2, 1]), spelling, 11, 4)
    words = [bytes([97, *rest]) for k in range(3) for rest in __import__("itertools").product(range(97, 123), repeat=k)]
    own, unseen = model.place(words)
    assert (own == 3).all()
    total = (10 ** model.word_score(np.array([counts.get(w, 0) for w in words]), own, unseen)).sum()
    assert 0.7 < total <= 1 + 1e-9


def test_attention_scores_each_token_once_and_is_causal():
    rng = np.random.default_rng(0)
    sequences = [np.tile([1, 2, 3], 40)[: rng.integers(1, 110)] for _ in range(30)]
    model = attention.train(sequences, 5, half=8, dim=8, steps=200, batch=16)
    together = model.log10_scores(sequences, chunk=7)
    assert np.allclose(together, [model.log10_scores([s])[0] for s in sequences], atol=1e-3)
    for s in sequences[:5]:
        flat = np.concatenate(([5], s))
        by_hand = 0.0
        for t in range(len(s)):
            start = 0 if t < 16 else 8 * ((t - 16) // 8 + 1)
            hidden = model._forward(flat[None, start:t + 1])[-1][0, -1]
            logits = hidden @ model.params["out"] + model.params["out_bias"]
            by_hand += (logits[s[t]] - np.log(np.exp(logits).sum())) / np.log(10)
        assert abs(by_hand - model.log10_scores([s])[0]) < 1e-2
    assert -model.log10_scores([np.tile([1, 2, 3], 30)])[0] / 90 < 0.15  # learned the cycle


def test_attention_gradient_against_differences():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 4, 25) for _ in range(8)]
    before = attention.train(sequences, 4, half=8, dim=4, steps=1, rate=0.0)
    after = attention.train(sequences, 4, half=8, dim=4, steps=150, rate=0.02)
    assert after.log10_scores(sequences).sum() > before.log10_scores(sequences).sum() + 1


def word_first(counts, text):
    """Plain word-first backoff over ``counts[lang]``, a list of training words: mean log10 frequency, ties to the first language."""
    names, longest = sorted(counts), 5
    grams = {(l, n): [] for l in names for n in range(longest + 1)}
    for l in names:
        for w in counts[l]:
            grams[l, 0].append(w)
            for n in range(1, longest + 1):
                grams[l, n] += [f" {w} "[i:i + n] for i in range(len(w) + 3 - n)]
    floor = -np.log10(max(len(g) for g in grams.values())) - 1
    value = lambda l, n, g: np.log10(grams[l, n].count(g) / len(grams[l, n])) if g in grams[l, n] else floor
    known = lambda n, g: any(g in grams[l, n] for l in names)

    def scores(w):
        if known(0, w):
            return [value(l, 0, w) for l in names]
        for n in range(longest, 0, -1):
            found = [g for g in (f" {w} "[i:i + n] for i in range(len(w) + 3 - n)) if known(n, g)]
            if found:
                return [np.mean([value(l, n, g) for g in found]) for l in names]
        return [floor] * len(names)

    words = ["".join(c) for is_letter, c in itertools.groupby(text.lower(), str.isalpha) if is_letter]
    if not words:
        return "und", 0.0
    means = np.mean([scores(w) for w in words], axis=0)
    odds = 10.0 ** np.clip((means - means.max()) * min(len(words), 20), -30, 0)
    return names[int(means.argmax())], 1 / odds.sum()


def test_languages_equal_plain_word_first_backoff(spark):
    rng = random.Random(8)
    alphabet = {"aa": "abcde ", "bb": "bcdef ", "cc": "defgé "}
    made = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(5, 60)))
    taught = [(k, made(alphabet[l]), l) for k in range(60) for l in alphabet]
    asked = [made("abcdefgéx ½²Ⅷ7_") for _ in range(80)] + ["½", "²", "Ⅷ", "7 _ -", "", "½a²b", "一", "A½B"]
    rows = [(i, t, l) for i, (_, t, l) in enumerate(taught)] + [(1000 + i, t, None) for i, t in enumerate(asked)] + [(2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    words = {l: [w for _, t, name in taught if name == l for w in t.split()] for l in alphabet}
    for i, t in enumerate(asked):
        lang, score = word_first(words, t)
        assert found[1000 + i][0] == lang and abs(found[1000 + i][1] - score) < 1e-9, t
    assert [found[1000 + len(asked) - 8 + k][0] for k in range(5)] == ["und"] * 5 and found[2000] == ("und", 0.0)


def test_words_of_letters_come_by_the_fast_way():
    import sys
    from time import process_time

    every = "".join(f"a{chr(c)}b " for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF).lower()
    assert language_id.letter_words(every) == language_id.LETTERS.findall(every)
    text = "una frase cualquiera con acentos y eñes más allá " * 4000
    took = []
    for words in (language_id.letter_words, language_id.LETTERS.findall):
        start = process_time()
        words(text)
        took.append(process_time() - start)
    assert took[0] * 3 < took[1]


def test_rare_leading_pieces_are_ids_of_their_own(spark):
    """pieces beyond the 126 most frequent ones are told apart, so the order of two of them matters."""
    rng = random.Random(11)
    known = sorted(p.decode() for p in lm_scoring.pieces_that_begin(MODEL) if p.isalpha() and p.isascii() and p.islower() and len(p) > 3)
    chosen = known[::len(known) // 180][:180]
    often, a, b = chosen[:140], chosen[140:160], chosen[160:]
    pair = lambda: " ".join(sum(([a[i], b[i]] for i in rng.choices(range(20), k=3)), []))
    rows = [(k, " ".join(rng.choices(often, k=30)) + " " + pair(), True) for k in range(600)]
    rows += [(1000, " ".join(f"{x} {y}" for x, y in zip(a, b)), False), (1001, " ".join(f"{x} {y}" for x, y in zip(a, b[1:] + b[:1])), False)]
    found = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string, l boolean"), F.col("l"), MODEL, steps=300)
    right, turned = (r.score for r in found.filter("doc_id >= 1000").orderBy("doc_id").collect())
    assert right > turned + 5


@pytest.mark.parametrize("classes", (3, 128, 129, 255, 256, 700))
def test_levels_of_the_softmax_add_up_to_one(classes):
    """at the start each id has its share; after training the shares still add up to one."""
    rng = np.random.default_rng(classes)
    counts = np.sort(rng.integers(1, 1000, classes))[::-1]
    model = attention.fresh(classes, half=4, dim=4)
    attention.start_odds(model, counts)
    ids = [np.array([k], np.int64) for k in range(classes)]
    assert np.allclose(10 ** model.log10_scores(ids), (counts + 1) / (counts + 1).sum(), rtol=1e-3)
    attention.pass_over(attention.Adam(model), [rng.integers(0, classes, 50) for _ in range(40)], np.array([0.05, 0.05]), rng, batch=8)
    assert abs((10 ** model.log10_scores(ids)).sum() - 1) < 1e-4


def test_the_gradient_through_levels_is_that_of_differences():
    """F2"""
    rng = np.random.default_rng(7)
    sequences = [rng.integers(0, 300, 8) for _ in range(6)]
    for name in ("out", "out_bias", "id", "mix"):
        model = attention.fresh(300, half=4, dim=4)
        model.params["out"] += rng.normal(0, 0.3, model.params["out"].shape).astype(np.float32)
        held = {k: v.copy() for k, v in model.params.items()}
        flat, begin, lengths = attention.laid_out(sequences, 300, 4)
        where = begin[:, None] + np.arange(8)
        adam = attention.Adam(model)
        adam.descend(flat[where], flat[where + 1], np.ones(where.shape, bool), 0.0)
        grad = adam.one[name] / 0.1
        loss = lambda: -np.log(10) * model.log10_scores(sequences).sum() / where.size
        for at in [tuple(x) for x in np.argwhere(np.abs(grad) > 0.3 * np.abs(grad).max())[:5]]:
            sides = []
            for step in (0.02, -0.02):
                model.params[name] = held[name].copy()
                model.params[name][at] += step
                sides.append(loss())
            model.params[name] = held[name].copy()
            assert abs((sides[0] - sides[1]) / 0.04 - grad[at]) < 0.05 * np.abs(grad).max() + 1e-3
