import random

from veilspan.llm import secrets


def told_apart():
    """Texts that teach both labels, with credentials after a name and look-alikes."""
    rng, rows = random.Random(9), []
    for k in range(300):
        w = [rng.choice(["river", "stone", "window", "garden", "people", "morning"]) for _ in range(30)]
        hexes = "".join(rng.choices("0123456789abcdef", k=32))
        w[rng.randrange(1, 28)] = [f"password={hexes[:18]}", f"secret: {hexes[:20]}", f'token = "{hexes}"', f"10.{k % 200}.7.{k % 250}",
                                   f"a{k}@mail.example.com", f"+49 555-{1000 + k}-{2000 + k}", "author: people", f"/srv/data/{k}/morning.txt"][k % 8]
        rows.append((k, " ".join(w)))
    return rows


NAMED = {1000: ("password: correcthorsebattery", "correcthorsebattery"), 1001: ('client_secret = "AbCdEfGhIjKlMnOp"', "AbCdEfGhIjKlMnOp"),
         1002: ("pwd: abc12", "abc12"), 1003: ("pwd=x9z", "x9z"), 1004: ('{"password":"Hunter"}', "Hunter")}


def test_values_after_a_name_are_candidates_whatever_they_look_like(spark):
    docs = spark.createDataFrame([(d, f"river {t} stone") for d, (t, _) in NAMED.items()], "doc_id long, text string")
    found = {(r.doc_id, r.value) for r in secrets.candidates(docs, ["doc_id"]).collect()}
    assert {(d, v) for d, (_, v) in NAMED.items()} <= found


def test_values_after_a_name_are_found_and_redacted_as_words(spark):
    rows = told_apart() + [(d, f"abc123 river {t} stone abc12") for d, (t, _) in NAMED.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in secrets.redact(docs, common=2).collect()}
    for d, (_, value) in NAMED.items():
        assert value not in texts[d].replace("abc123", "").split() and "[SECRET]" in texts[d], texts[d]
    assert texts[1002] == "abc123 river pwd: [SECRET] stone [SECRET]"
    assert all(texts[d] == t for d, t in rows[:300] if d % 8 >= 3)


def test_clean_tables_stay_and_a_lone_credential_goes(spark):
    clean = [(k, f"river stone {t} window garden people") for k, t in enumerate([
        "anna.berg7@mail.example.org", "2024-11-05", "+44-20-7946-0958", "123e4567-e89b-12d3-a456-426614174000", "windows95 machine", "10.12.0.7:8080",
        "https://example.org/a/b2c", "/usr/lib/python3.11/site", "Boeing747-400", "COVID-19 vaccines", "model-T1000 robot", "author: Smith2001", "section12.4b"])]
    docs = spark.createDataFrame(clean, "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == dict(clean)
    lone = spark.createDataFrame([(100, "river password=0a1b2c3d4e5f607182 stone")], "doc_id long, text string")
    assert secrets.redact(lone).first().text == "river password=[SECRET] stone"


def test_words_after_an_assigned_value_are_no_candidates(spark):
    docs = spark.createDataFrame([(1, "password=x9f3a7c1 Boston Keller"), (2, "token = 'abcd' Boston Keller"), (3, "Authorization: Bearer qwertyuiop Boston"),
                                  (4, "password: opensesame Boston Keller"), (5, "the password : opensesame Boston")], "doc_id long, text string")
    found = {(r.doc_id, r.value) for r in secrets.candidates(docs, ["doc_id"]).collect()}
    assert found == {(1, "x9f3a7c1"), (2, "abcd"), (3, "qwertyuiop"), (4, "opensesame"), (5, "opensesame")}


def test_one_word_is_redacted_behind_its_name(spark):
    docs = spark.createDataFrame([*told_apart(), (1000, "password=x9f3a7c15d Boston Keller")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(docs, common=2).collect()}[1000] == "password=[SECRET] Boston Keller"
