"""Secret scans: candidates by shape, false positives removed by a random forest.

Only DataFrame functions and Spark's own forest are used; nothing runs in Python on the executors.
Candidates are words that could be credentials, with their neighbours.  Each gets its length,
the changes between character classes, the share of its letters that are dictionary words (words of
``common`` or more uses in the whole corpus, met in a join), marks of paths, hosts and addresses, and
marks of the words around it.  The forest learns from labelled findings: those the caller gives, or
else the candidates that a fixed list of formats settles (issuer formats and assigned credentials
against addresses, numbers, dates and plain words), of which a bounded sample is used; where these have
one label only, fixed findings (``TAUGHT``) are added.  The forest itself sees only the features, and decides about all candidates.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.quality_rules import word_array
from veilspan.llm.storage import written
from veilspan.llm.text import hash_sample

# What names a credential (an author or a secretary does not), formats of issuers, and formats that are no credentials.
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret(?!ar)|token|api_?-?key|access_?-?key|private_?-?key|credential|auth(?!ors?(?![a-z]))|bearer)"
ASSIGNED = f"{NAMES}[^=:]*[=:]"
OPEN = r"[=:]+[\"'`({\[]*$"  # an assignment that has no value yet
SCHEMES = r"(?i)^(bearer|basic)$"
ISSUED = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|[sr]k_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_.-]+)$"
HARMLESS = (
    r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",  # e-mail address
    r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$",  # IPv4 address
    r"^[+(]?\d[\d().,:/+-]*$",  # number, telephone, date, time
    r"^[A-Za-z][A-Za-z0-9+.-]*://",  # address
    r"^(?:[\w.-]*/)+[\w.-]*$",  # path
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
)
TAUGHT_WORDS = ("river", "stone", "window", "garden", "people", "morning", "report", "station", "music", "winter", "account", "required")
UNLISTED = ("harbour", "Walter", "lantern", "Boston", "Keller", "chapter")
FORMS_EACH = 16
#: ``(before2, before, token)`` of the fixed findings of each label.
TAUGHT = {
    0: (("{a}", "{b}", "{c}{k}@{d}.com"), ("{a}", "{b}", "10.{day}.7.{byte}"), ("{a}", "on", "2021-03-{day}"), ("call", "tel:", "+49-555-{k}-{byte}"),
        ("{a}", "see", "https://www.{b}.com/{c}/{k}"), ("{a}", "{b}", "/{c}/{d}/{k}.txt"), ("{a}", "id:", "{hex:.8}-{hex:.4}-{hex:.4}-{hex:.4}-{hex:.12}"),
        ("{a}", "{b}", "{c}-{d}-{k}"), ("{a}", "{b}", "{c}{day}{d}"), ("{a}", "{b}", "{c}_{d}.{k}"), ("{a}", "author:", "{b}"), ("password:", "is", "{b}"),
        ("the", "password:", "{b}"), ("{a}", "date:", "2021-03-{day}T10:{day}:00"), ("{a}", "{b}", "{c}={k}"), ("the", "token", "{c}{k}"),
        ("{a}", "{b}", "{letters:.3}{k}-{c}"), ("{a}", "number:", "{letters:.2}-{k}{byte}"),
        ("{a}", "{b}", "{e}{day}"), ("{a}", "author:", "{e}{k}"), ("{a}", "{b}", "{e}{k}-{day}"), ("{a}", "{b}", "{e}-{day}"), ("{a}", "{b}", "{e}{day}.{k}")),
    1: (("{a}", "{b}", "password={hex:.18}"), ("{a}", "{b}", "AKIA{upper:.16}"), ("token", "=", '"{hex:.32}"'), ("{a}", "secret:", "{mixed:.24}"),
        ("{a}", "{b}", "ghp_{mixed:.36}"), ("api_key", "=", "'{hex:.40}'"), ("{a}", "pwd:", "{letters:.3}{byte}"), ("{a}", "password:", "{letters:.16}"),
        ("{a}", "passwd:", "{mixed:.10}"), ("{a}", "{b}", "pwd={mixed:.7}"), ("client_secret", "=", '"{letters:.20}"'), ("{a}", "{b}", "api-key={mixed:.30}")),
}
FEATURES = ("size", "changes", "digits", "uppers", "hexes", "others", "coverage", "slashes", "dots", "at", "colons", "named", "assigned",
            "named_before", "assigned_before", "quoted")


def candidates(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``token, name, value, before, before2, after``: each word that could be a credential.

    These are words of eight characters or more with a digit, and whatever its length and characters the value of an
    assignment to one of ``NAMES``, in the word itself or, where the name's own word has no value yet, in the next one.
    """
    at = lambda i: F.coalesce(F.get(F.col("__w"), i), F.lit(""))
    marked = lambda w: w.contains("=") | w.contains(":")
    # The word before is a name and a sign without a value, a sign alone behind a name, or a scheme behind such a name.
    given = lambda a, b: (marked(b) & (b.rlike(f"{NAMES}[^=:]*{OPEN}") | b.rlike(f"^{OPEN}") & a.rlike(NAMES))
                          | marked(a) & a.rlike(f"{NAMES}[^=:]*{OPEN}") & b.rlike(SCHEMES))
    fits = lambda w, i: (F.length(w) >= 8) & w.rlike("[0-9]") | marked(w) & w.rlike(ASSIGNED) | (given(at(i - 2), at(i - 1)) & ~w.rlike(SCHEMES))
    pick = F.transform("__w", lambda w, i: F.when(fits(w, i), F.struct(w.alias("token"), at(i - 1).alias("before"), at(i - 2).alias("before2"), at(i + 1).alias("after"))))
    rows = docs.select(*keys, word_array(F.col(text)).alias("__w")).select(*keys, F.inline(F.filter(pick, lambda x: x.isNotNull())))
    return with_value(rows).filter("value <> ''")


def with_value(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name`` and ``value`` of ``token``, without quotes and brackets; a quoted name counts if it is one of ``NAMES``."""
    shape = r"""^[("'`\[{<]*(?:([A-Za-z_][A-Za-z0-9_.-]*)[=:]+)?["'`({\[]*([^"'`]*?)[)\]},;.!?>]*(?:["'`].*)?$"""
    quoted = r"""^[("'`\[{<]*([A-Za-z_][A-Za-z0-9_.-]*)["'`][=:]+["'`({\[]*([^"'`]+?)[)\]},;.!?>]*(?:["'`].*)?$"""
    named = F.regexp_extract("token", quoted, 1).rlike(NAMES)
    part = lambda k: F.when(named, F.regexp_extract("token", quoted, k)).otherwise(F.regexp_extract("token", shape, k))
    return rows.withColumns({"name": part(1), "value": part(2)})


def dictionary(docs: DataFrame, text: str = "text", common: int = 5) -> DataFrame:
    """``(word)``: lower-case words of three letters or more that the corpus uses ``common`` times or more."""
    found = docs.select(F.explode(word_array(F.lower(F.col(text)))).alias("w")).filter(F.col("w").rlike(r"^\p{L}{3,}$"))
    return found.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= common).select("word")


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the columns ``FEATURES``; each distinct value meets the dictionary once."""
    value = F.col("value")
    kept = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    runs = F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda x: F.length(x) >= 3)
    parts = found.select("value").distinct().select("value", F.explode(runs).alias("run"))
    covered = parts.join(known, parts.run == known.word).groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    size = F.length(value)
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    one = lambda condition: condition.cast("double")
    return found.join(covered, "value", "left").withColumns({
        "size": F.least(size, F.lit(256)).cast("double"), "changes": F.least(F.length(folded) - 1, F.lit(256)).cast("double"),
        "digits": kept("[^0-9]") / size, "uppers": kept("[^A-Z]") / size, "hexes": kept("[^0-9a-fA-F]") / size,
        "others": kept("[0-9A-Za-z]") / size, "coverage": F.coalesce(F.col("covered") / size, F.lit(0.0)),
        "slashes": F.least(kept("[^/\\\\]"), F.lit(16)).cast("double"), "dots": F.least(kept("[^.]"), F.lit(16)).cast("double"),
        "at": one(value.contains("@")), "colons": F.least(kept("[^:]"), F.lit(16)).cast("double"),
        "named": one(F.col("name").rlike(NAMES)), "assigned": one(F.col("name") != ""),
        "named_before": one(F.col("before").rlike(NAMES) | F.col("before2").rlike(NAMES)),
        "assigned_before": one(F.col("before").rlike("[=:]$")), "quoted": one(F.col("token").rlike("^[\"'`]")),
    }).drop("covered")


def settled(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 for an issuer's format or an assigned credential, 0 for a harmless format or plain words, else null."""
    harmless = F.lit(False)
    for pattern in HARMLESS:
        harmless = harmless | F.col("value").rlike(pattern)
    assigned = (F.col("named") + F.col("assigned") >= 2) | (F.col("named_before") + F.col("assigned_before") >= 2)
    credential = F.col("value").rlike(ISSUED) | (assigned & (F.col("size") >= 12) & F.col("value").rlike("[0-9]") & ~harmless & (F.col("coverage") < 0.5))
    return found.withColumn("label", F.when(credential, 1).when(harmless | (F.col("coverage") >= 0.5), 0))


def taught(spark: SparkSession, label: int) -> DataFrame:
    """Fixed labelled findings with ``FEATURES`` for a table that does not settle both labels: ``TAUGHT`` forms, each ``FORMS_EACH`` times.

    Their words but ``UNLISTED`` are their dictionary, so that they do not depend on the table.
    """
    rows = []
    for k in range(FORMS_EACH):
        hexes = hashlib.sha256(str(k).encode()).hexdigest()
        mixed = base64.b64encode(bytes.fromhex(hexes)).decode().translate(str.maketrans("+/=", "xyz"))
        words = [TAUGHT_WORDS[int(hexes[2 * i:2 * i + 2], 16) % len(TAUGHT_WORDS)] for i in range(4)]
        facts = {"hex": hexes, "mixed": mixed, "upper": mixed.upper(), "letters": "".join(c for c in mixed if c.isalpha()), "k": 1000 + int(hexes[:3], 16),
                 "day": 10 + k % 18, "byte": int(hexes[:2], 16), "a": words[0], "b": words[1], "c": words[2], "d": words[3],
                 "e": UNLISTED[k % len(UNLISTED)]}
        rows += [tuple(part.format(**facts) for part in form) for form in TAUGHT[label]]
    found = with_value(spark.createDataFrame(rows, "before2 string, before string, token string").withColumn("after", F.lit(TAUGHT_WORDS[0])))
    return with_features(found, spark.createDataFrame([(w,) for w in TAUGHT_WORDS], "word string")).withColumn("label", F.lit(label))


def train_forest(labelled: DataFrame, per_label: int = 2000, trees: int = 24, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel:
    """A forest on at most about ``2 * per_label`` findings of each label; unless both labels have some, those of ``taught`` are added.

    The sample is one sorted partition, so that the same findings give the same forest.
    """
    marked = labelled.filter(F.col("label").isNotNull()).select("label", "value", *FEATURES).dropDuplicates(["label", *FEATURES])
    order = Window.partitionBy("label").orderBy(F.xxhash64("value"), "value", *FEATURES)
    few = hash_sample(marked, "label", "value", per_label).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= 2 * per_label)
    few = written(few.drop("k"))
    if few.select("label").distinct().count() < 2:
        for label in TAUGHT:
            few = few.union(taught(few.sparkSession, label).select(few.columns))
    sample = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(few.orderBy("label", "value", *FEATURES).coalesce(1))
    weights = few.groupBy("label").agg((1 / F.count(F.lit(1))).alias("w"))
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", weightCol="w",
                                  cacheNodeIds=False).fit(sample.join(F.broadcast(weights), "label").select("label", "w", "features").coalesce(1))


def scored(found: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """``found`` with ``score``, the forest's share for label 1."""
    judged = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    return judged.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def secret_findings(docs: DataFrame, keys: list[str], text: str = "text", labelled: DataFrame | None = None, common: int = 5,
                    threshold: float = 0.5) -> DataFrame:
    """``keys, token, name, value, before, after, label, score`` of the candidates scored at ``threshold`` or more.

    ``labelled`` has ``name, value, token, before, before2, after, label``; without it the settled
    candidates teach; unless both labels occur, fixed ones are added.  A null or empty text has no candidates; repeated rows and words repeat their findings;
    null keys stay; an empty table gives an empty one; other columns are not read.
    """
    known = written(dictionary(docs, text, common))
    found = written(settled(with_features(written(candidates(docs, keys, text)), known)))
    teaching = found if labelled is None else with_features(labelled, known)
    judged = scored(found, train_forest(teaching)).filter(F.col("score") >= threshold)
    return judged.select(*keys, "token", "name", "value", "before", "after", "label", "score")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every found value in ``text`` replaced by ``mark``; other columns and rows without findings are unchanged.

    A value of under eight characters or without a digit is replaced where it is not part of a longer word.
    Findings depend on the text only, so equal texts share them: they are gathered by the text's hash (a
    text's own findings, no group of rows) and meet the documents in one join.
    """
    key = F.xxhash64(F.col(text))
    found = secret_findings(docs.select(key.alias("__h"), F.col(text)), ["__h"], text, **options)
    values = found.groupBy("__h").agg(F.sort_array(F.collect_set("value"), asc=False).alias("__v"))
    by_length = F.array_sort("__v", lambda a, b: F.length(b) - F.length(a))
    literal = lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    plain = lambda v: (F.length(v) >= 8) & v.rlike("[0-9]")
    swap = lambda t, v: F.when(plain(v), F.replace(t, v, F.lit(mark))).otherwise(F.regexp_replace(t, literal(v), F.lit(mark)))
    clean: Column = F.aggregate(by_length, F.col(text), swap)
    joined = docs.withColumn("__h", key).join(values, "__h", "left")
    return joined.withColumn(text, F.when(F.col("__v").isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
