"""One thin query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.plans.layout import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, 4 differing bits."""
    from veilspan.llm.simhash import near_duplicates

    found = near_duplicates(load(spark, root, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows of three folds in four."""
    from veilspan.llm.text import fold
    from veilspan.llm.toxicity import toxicity

    docs = load(spark, root, "documents").select("doc_id", "text")
    scored = toxicity(docs, load(spark, root, "labels"), learn_from=fold("doc_id", 4) != 2, label="toxic", threshold=0.3)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op10_language_id(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document, learned from three folds in four."""
    from veilspan.llm.language_id import identify
    from veilspan.llm.text import fold

    docs = load(spark, root, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn_from=fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


PIECE_MODEL = os.environ.get("VEILSPAN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op8_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    """Piece ids of every document, with parity and round trip."""
    from veilspan.llm.sentencepiece_codec import encode

    return encode(load(spark, root, "documents").select("doc_id", "text"), PIECE_MODEL).drop("text")


@query
def op9_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    from veilspan.llm.token_counts import count_tokens, from_piece_model

    return count_tokens(load(spark, root, "documents").select("doc_id", "text"), from_piece_model(PIECE_MODEL)).drop("text")


@query
def op6_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a test item or an edited copy of one, with the passage."""
    from veilspan.llm.decontamination import contaminated_passages

    return contaminated_passages(load(spark, root, "documents"), load(spark, root, "benchmark"))


@query
def op2_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    """log10 probability of every document under unigram counts and under the attention model; nine folds in ten train."""
    from veilspan.llm.lm_scoring import score_texts
    from veilspan.llm.text import fold

    docs = load(spark, root, "documents").select("doc_id", "text")
    scored = score_texts(docs, fold("doc_id", 10) != 0, PIECE_MODEL)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Rule statistics of every document and the verdict of its host, taken from ``source``."""
    from veilspan.llm.quality_rules import quality_rules

    return quality_rules(load(spark, root, "documents"), host="source").drop("host_rate")


ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
v AS (SELECT r, count(DISTINCT i + s) AS n FROM k, (VALUES (0), (1), (2)) x(s) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN u USING (r) LEFT JOIN v USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS x FROM f GROUP BY source),
s AS (SELECT sum(x) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts, sum(CAST(n AS DOUBLE) * n) AS squares, sum(CAST(x AS DOUBLE) * x / n) AS spread FROM h),
q AS (SELECT mean, spread - n * mean * mean - (hosts - 1) * mean * (1 - mean) AS beyond, mean * (1 - mean) * (n - squares / n - (hosts - 1)) AS most FROM s),
y AS (SELECT source, CASE WHEN beyond > 0 AND most > 0 THEN (x + greatest(most / beyond - 1, 0) * mean) / (n + greatest(most / beyond - 1, 0))
        ELSE mean END AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND rate <= 0.5) AS kept
FROM f JOIN y ON f.source IS NOT DISTINCT FROM y.source
"""


@query
def op7_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """What is left of every document without the 13-word windows of documents before it."""
    from veilspan.llm.substring_dedup import without_repeats

    found = without_repeats(load(spark, root, "documents"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """Credentials found in documents, with the forest's score."""
    from veilspan.llm.secrets import secret_findings

    return secret_findings(load(spark, root, "documents").select("doc_id", "text"), ["doc_id"])


@query
def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof still holds for a text put into lower case."""
    from string import ascii_lowercase, ascii_uppercase

    from veilspan.llm.merkle import as_hex, folded, leaf_digest, manifest, proof_digest
    from veilspan.llm.text import fold

    whole = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = leaf_digest([*whole[:-1], F.translate("text", ascii_uppercase, ascii_lowercase)])
    tampered = F.when(fold("doc_id", 3) == 0, lowered)
    found = manifest(load(spark, root, "documents"), whole, group=F.col("lang"), order=F.col("doc_id"), carry=tampered)
    again = folded(F.coalesce("kept", "leaf"), F.col("path")).alias("again")
    return found.select("*", again).select(
        F.col("id").alias("doc_id"), as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        as_hex(proof_digest(F.col("path"))).alias("proof_sha256"), as_hex(F.col("again")).alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"))


#: crc32 of a decimal number, bit by bit: each digit enters with the first of its eight steps.
SQL_CRC32 = """xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split({0}::VARCHAR, ''),
  lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda x, y: xor(xor(x, y) >> 1, 3988292384::UBIGINT * (xor(x, y) & 1))))"""
_FRAME = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_FRAMES = " || ".join(_FRAME.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_BEFORE = "coalesce(string_agg(h, '') OVER (PARTITION BY g, lv, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b"
_AFTER = "coalesce(string_agg(h, '') OVER (PARTITION BY g, lv, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a"
_LEVELS = """SELECT g, lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {0} WHERE n > 1 GROUP BY g, lv, i // 8"""
_FOLD = """SELECT f.doc_id, f.g, f.lv + 1, f.i // 8, (f.n + 7) // 8, sha256(s.b || f.h || s.a), f.p || s.b || s.a, f.leaf
  FROM {0} f JOIN {1} s ON f.g = s.g AND f.lv = s.lv AND f.i = s.i WHERE f.n > 1"""
ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_FRAMES} || {_FRAME.format("text")}) AS leaf,
        sha256({_FRAMES} || {_FRAME.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low,
        {SQL_CRC32.format("doc_id")} % 3 = 0 AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, lv, i, n, h) AS (SELECT g, 0, i, n, leaf FROM p UNION ALL {_LEVELS.format("t")}),
s AS (SELECT g, lv, i, {_BEFORE}, {_AFTER} FROM t),
r AS (SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(g, lv, i, n, h) AS (SELECT '', 0, i, n, h FROM r UNION ALL {_LEVELS.format("u")}),
v AS (SELECT g, lv, i, {_BEFORE}, {_AFTER} FROM u),
f(doc_id, g, lv, i, n, h, p, leaf) AS (
  SELECT doc_id, g, 0, i, n, CASE WHEN tampered THEN low ELSE leaf END, '', leaf FROM p UNION ALL {_FOLD.format("f", "s")}),
e(doc_id, g, lv, i, n, h, p, leaf, subroot) AS (
  SELECT f.doc_id, '', 0, r.i, r.n, f.h, f.p, f.leaf, r.h FROM f JOIN r ON f.g = r.name WHERE f.n = 1
  UNION ALL SELECT f.doc_id, f.g, f.lv + 1, f.i // 8, (f.n + 7) // 8, sha256(s.b || f.h || s.a), f.p || s.b || s.a, f.leaf, f.subroot
  FROM e f JOIN v s ON f.g = s.g AND f.lv = s.lv AND f.i = s.i WHERE f.n > 1)
SELECT e.doc_id, e.leaf, e.subroot, u.h AS root, sha256(e.p) AS proof_sha256, e.h AS folded_root, e.h = u.h AS verified
FROM e, u WHERE e.n = 1 AND u.n = 1
"""


@query
def op11_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every page written as a WARC record, repeated payloads as revisits, and read back from the archives."""
    from veilspan.llm.warc import warc_round_trip

    return warc_round_trip(load(spark, root, "pages")).select(
        F.col("id").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.lower(F.hex("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS o FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN b >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND k > 1 THEN o END AS refers_to
FROM f
"""


BLANK = r"[\x20\x09-\x0D]+"


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` ``(doc_id, text)`` where texts whose id has a crc32 that 10 divides go on periodically from some word on."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(number / 10)
    parts = F.when(number % 10 == 0, F.array_remove(F.split("text", BLANK), ""))
    cut = docs.select("*", parts.alias("w"), g.alias("g")).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    left = F.col("n") - F.col("a")
    period = (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int")
    cycle = F.slice("w", F.col("a") + 1, period)
    going_on = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(left / F.greatest(period, F.lit(1))).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), going_on), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of repeated words in every document, planted periods included."""
    from veilspan.llm.periodic_runs import periodic_runs

    found = periodic_runs(with_planted_periods(load(spark, root, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# Another way than the operator's: a run of period q shows as two neighbouring occurrences, q words apart, of the words of the next power
# of two; every such distance of a text is then tried on all of its words.
ORACLES["op13_periodic_runs"] = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, (@CRC@)::BIGINT AS h FROM documents),
l AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM l),
t AS (SELECT r, i, n, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
k(r, i, n, k, h) AS (SELECT r, i, n, 1, hash(w) FROM t
  UNION ALL SELECT r, i, n, 2 * k, hash(h, lead(h, k) OVER (PARTITION BY r ORDER BY i)) FROM k WHERE 4 * k <= n AND i + k <= n),
s AS (SELECT DISTINCT r, q FROM (SELECT r, k, lead(i) OVER (PARTITION BY r, k, h ORDER BY i) - i AS q FROM k) WHERE q <= k AND 2 * q > k),
e AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM (
  SELECT s.r, s.q, x.i FROM s JOIN t x ON x.r = s.r JOIN t y ON y.r = s.r AND y.i = x.i + s.q WHERE x.w = y.w)),
f AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM e GROUP BY r, q, b HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.r = f.r AND z.q < f.q AND z.s <= f.s AND z.s + z.l >= f.s + f.l)),
o AS (SELECT r, count(*) AS c, arg_min({'s': s, 'l': l, 'q': q}, [-l, s, q]) AS o, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x FROM u GROUP BY r),
z AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
y AS (SELECT t.r, string_agg(t.w, ' ' ORDER BY t.i) AS x FROM t LEFT JOIN z ON z.r = t.r AND z.i = t.i WHERE z.i IS NULL GROUP BY t.r)
SELECT doc_id, coalesce(o.c, 0) AS n_runs, o.o.s AS start, o.o.l AS length, o.o.q AS period, 1000 * o.o.l // o.o.q AS exponent_milli,
  sha256(coalesce(o.x, '')) AS runs_sha256, sha256(coalesce(y.x, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON o.r = d.r LEFT JOIN y ON y.r = d.r
""".replace("@CRC@", SQL_CRC32.format("doc_id"))
