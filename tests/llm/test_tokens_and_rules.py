import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import decontamination, pieces, quality_rules, secrets, sentencepiece_codec, token_counts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = [None, "", " ", "  two  spaces ", "a\n\nb\tc", "日本語 ▁x ñ", "<s> </s> <unk> <0x0A>", "a" * 40, "x y", "....----....", "x\x00y", " lead",
       "The quick brown fox " * 3000]


def test_codec_agrees_with_the_other_library_on_whole_texts(spark):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD + ODD)], "doc_id long, text string, ids string")
    for r in sentencepiece_codec.encode(docs, MODEL).collect():
        text = ODD[r.doc_id % len(ODD)] or ""
        assert r.ids == judge.encode(text) and r.n_tokens == len(r.ids) and r.parity
        assert r.round_trip == ("▁" not in text)
    coded = sentencepiece_codec.encode(docs.filter("round_trip" if False else "text not like '%▁%'"), MODEL)
    back = coded.select("text", sentencepiece_codec.decode_column(spark, MODEL, F.col("ids")).alias("again")).collect()
    assert all(r.again == r.text for r in back)
    assert sentencepiece_codec.encode(docs.limit(0), MODEL).count() == 0


def test_codec_keeps_no_more_than_two_generations(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 50)
    codec, rng = sentencepiece_codec.Codec(pieces.read_model(MODEL)), random.Random(1)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(10)) for _ in range(5)]
        flat, sizes, same, back = codec.encode(texts)
        assert list(flat) == [i for t in codec.judge.encode(texts) for i in t] and all(same) and all(back)
        assert len(codec.known) <= 110 and len(codec.older) <= 110


def unigram_model():
    """The bytes of a small unigram model: the parts of a piece file that the reader needs."""
    import struct

    def message(number, body):
        return bytes([number << 3 | 2, len(body)]) + body

    listed = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁a", -2.0, 1), ("ab", -2.5, 1), ("▁ab", -2.2, 1), ("ba", -5.0, 1)]
    body = b"".join(message(1, message(1, t.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for t, s, k in listed)
    return body + message(2, bytes([3 << 3, 1])) + message(3, bytes([3 << 3, 1, 4 << 3, 0]))


def test_unigram_models_are_rebuilt_too():
    import sentencepiece

    data = unigram_model()
    model = pieces.parse_model(data)
    assert model.kind == pieces.UNIGRAM and [p for p, *_ in model.pieces][4] == "▁a" and not model.remove_extra_whitespaces
    judge = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokenizer = sentencepiece_codec.build_tokenizer(model)
    for text in ("ab", "abba", "a b ab", "aab  ba"):
        assert tokenizer.encode(text, add_special_tokens=False).ids == judge.encode(text)


def greedy(word, begin, go_on):
    n = at = 0
    while at < len(word):
        known = go_on if at else begin
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in known), 0)
        if not size:
            return 0
        n, at = n + 1, at + size
    return n


def test_automaton_counts_like_greedy_search():
    rng = random.Random(7)
    for _ in range(60):
        draw = lambda k: {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(k)}
        begin, go_on = draw(12), draw(12)
        automaton = token_counts.build(begin, go_on)
        for _ in range(150):
            word = "".join(rng.choices("abcd" if rng.random() < 0.1 else "abc", k=rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, begin, go_on), (word, begin, go_on)


def test_token_counts_of_odd_texts(spark):
    automaton = token_counts.from_piece_model(MODEL)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD)], "doc_id long, text string, n_words string")
    ordinary = {t for t, _, kind in pieces.parse_model(pieces.read_model(MODEL)).pieces if kind == pieces.NORMAL}
    begin, go_on = {t[1:] for t in ordinary if t[0] == "▁" and "▁" not in t[1:]}, {t for t in ordinary if "▁" not in t}
    for r in token_counts.count_tokens(docs, automaton).collect():
        sizes = [greedy(w, begin, go_on) for w in re.findall(r"[^\x20\x09-\x0D]+", ODD[r.doc_id] or "")]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(sizes), sum(max(s, 1) for s in sizes), sizes.count(0))
    assert token_counts.count_tokens(docs.limit(0), automaton).count() == 0


def plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rules_and_host_verdicts_are_those_of_brute_force(spark):
    rng, rows = random.Random(3), []
    for k in range(150):
        host = rng.choice(["good", "bad", "bad", None, f"small{k}"])
        n = rng.randrange(60, 200) if host != "bad" or rng.random() < 0.2 else rng.randrange(10)
        rows.append((k, "\n".join(" ".join(f"w{rng.randrange(40)}" for _ in range(9)) + rng.choice(["", " #$"]) for _ in range(n // 9 + 1)), host))
    rows += [(900 + k, t, "odd") for k, t in enumerate(ODD)] + [(5, "a b c a b c a b c", "good"), (None, "ä|ö " * 40_000, "good"), (7, "x y z x y", "good")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int").repartition(4)
    found = quality_rules.quality_rules(docs, "source").collect()
    assert len(found) == len(rows)
    plain = sorted((str(d), *plain_rules(t)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == plain
    failed = lambda t: plain_rules(t)[0] < 50 or 100 * plain_rules(t)[4] > 50 * plain_rules(t)[0]
    hosts = {h: [failed(t) for _, t, own in rows if own == h] for *_, h in rows}
    n = np.array([len(x) for x in hosts.values()])
    rate = np.array([np.mean(x) for x in hosts.values()])
    mean = (rate * n).sum() / n.sum()
    beyond = (n * (rate - mean) ** 2).sum() - (len(n) - 1) * mean * (1 - mean)
    strength = max(mean * (1 - mean) * (n.sum() - (n ** 2).sum() / n.sum() - len(n) + 1) / beyond - 1, 0)
    shrunk = {h: (r * k + strength * mean) / (k + strength) for (h, r, k) in zip(hosts, rate, n)}
    assert beyond > 0 and shrunk["bad"] > 0.5 > shrunk["good"]
    expected = sorted((str(d), failed(t), round(shrunk[h], 9), not failed(t) and bool(shrunk[h] <= 0.5)) for d, t, h in rows)
    assert sorted((str(r.doc_id), r.base_failed, round(r.host_rate, 9), r.kept) for r in found) == expected
    assert quality_rules.quality_rules(docs.limit(0), "source").count() == 0


def credentials():
    rng, rows = random.Random(9), []
    for k in range(300):
        w = [rng.choice(["river", "stone", "window", "garden", "people", "morning"]) for _ in range(30)]
        at = rng.randrange(1, 28)
        hexes = "".join(rng.choices("0123456789abcdef", k=32))
        planted = [f"password={hexes[:18]}", f"AKIA{''.join(rng.choices('ABCDEFGH234567', k=16))}", f'token = "{hexes}"', f"10.{k % 200}.7.{k % 250}",
                   f"a{k}@mail.example.com", f"+49 555-{1000 + k}-{2000 + k}", f"river{k}stone-window-garden", f"/srv/data/{k}/morning.txt"][k % 8]
        w[at] = planted
        rows.append((k, " ".join(w)))
    return rows


def test_secrets_are_found_and_look_alikes_are_not(spark):
    rows = credentials() + [(1000, None), (1001, ""), (None, "password=0123456789abcdef01 end"), (3, rows_text := "x " * 50_000)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, value string").repartition(3)
    found = secrets.secret_findings(docs, ["doc_id"], common=2).collect()
    ids = {r.doc_id for r in found}
    assert ids == {d for d, t in rows[:300] if d % 8 < 3} | {None}
    assert all(0.5 <= r.score <= 1 for r in found) and rows_text
    clean = secrets.redact(docs, common=2)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "[SECRET]" in texts[0] and "password=" in texts[0] and texts[3 + 8] == dict(rows)[3 + 8] and texts[1000] is None
    assert secrets.secret_findings(docs.limit(0), ["doc_id"]).count() == 0


def test_callers_findings_teach_the_forest(spark):
    docs = spark.createDataFrame(credentials(), "doc_id long, text string")
    marked = secrets.settled(secrets.with_features(secrets.candidates(docs, []), secrets.dictionary(docs, common=2)))
    turned = marked.select("name", "value", "token", "before", "before2", "after", (1 - F.col("label")).alias("label")).filter("label is not null")
    found = {r.doc_id % 8 for r in secrets.secret_findings(docs, ["doc_id"], labelled=turned, common=2).collect()}
    assert found and not found & {0, 1, 2}


def plain_alignment(a, b):
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_alignment_scores_are_those_of_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 25)), rng.integers(1, 5, rng.integers(1, 15))
        score, start, end = decontamination.smith_waterman(a, b)
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a[start:end], b) == score


def test_leaks_are_found_edited_or_not_and_clean_texts_are_left_alone(spark):
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(text(40))) for k in range(12)] + [(50, None), (51, "two words"), (52, "")]
    rows, leaks = [], set()
    for k in range(200):
        w = text(150)
        if k % 5 == 0:
            own = items[k % 12][1].split()
            if k % 2:
                for j in range(4, 40, 9):
                    own[j] = "edited"
                del own[20]
            w[30:30] = own
            leaks.add((k, k % 12))
        rows.append((k, " ".join(w).upper() if k % 3 else ", ".join(w)))
    rows += [(500, None), (501, ""), (None, items[3][1]), (502, items[2][1]), (502, items[2][1]), (503, " ".join(text(30_000)) + " " + items[1][1])]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (200_000, 100):  # one block of items, several blocks
        found = decontamination.contaminated_passages(docs, bench, block_words=words).collect()
        pairs = Counter((r.doc_id, r.item_id) for r in found)
        assert pairs == Counter({**{p: 1 for p in leaks}, (None, 3): 1, (502, 2): 2, (503, 1): 1})
        assert all(r.first_word < r.end_word and r.score <= 1 for r in found)
    assert decontamination.contaminated_passages(docs.limit(0), bench).count() == decontamination.contaminated_passages(docs, bench.limit(0)).count() == 0


def test_block_sizes_do_not_drop_items(spark):
    bench = spark.createDataFrame([(k, f"item number {k} has five words") for k in range(300)], "item_id long, text string")
    blocks = list(decontamination.item_blocks(bench, "item_id", "text", 200, 3))
    assert len(blocks) > 3 and sorted(n for b in blocks for n in b.names) == list(range(300))


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_handle_odd_rows(spark, stage, tmp_path):
    import corpus_pipeline

    bench = [(1, "the seventh passage of the test that nobody may train upon")]
    rows = [(1, "plain words only " * 20, "en", "s", 340), (2, "plain words only " * 20, "en", "s", 340), (2, "plain words only " * 20, "en", "s", 340),
            (3, None, None, None, None), (None, "", "en", None, 0), (4, "before " + bench[0][1] + " after", "en", "s", 70),
            (5, "my password=0a1b2c3d4e5f607182 stays here", "en", "s", 40), (6, "lang " * 60_000, "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, kind)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, folder)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    got = sorted(str(r.doc_id) for r in out.collect())
    expected = {"simhash_near_dedup": ["1", "3", "4", "5", "6"], "decontamination": ["1", "2", "2", "3", "5", "6", "None"]}
    assert got == expected.get(name, ["1", "2", "2", "3", "4", "5", "6", "None"])
    if name == "secret_scan":
        changed = {r.doc_id: r for r in out.collect()}[5]
        assert "[SECRET]" in changed.text and changed.n_chars == len(changed.text)
    assert run(spark, docs.limit(0), folder).count() == 0
