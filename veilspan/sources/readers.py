"""Scans: JSON lines, ground-truth folders, session files, lesson transcripts, run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TOPIC_TO_SUBJECT
from ..functions import rules as R
from ..functions.text import collapse_space, literal_map, strip_space
from ..functions.tokens import explode_rows

CANDIDATE_SCHEMA = (
    "id string, subject string, tokens array<string>, labels array<string>, anchor_text string, dialogue_id string, "
    "speaker_role string, context_text string, metadata string"
)
ACTION_SCHEMA = (
    "id string, subject string, span_text string, context_text string, action_label string, eval_slice string, anchor_text string, "
    "speaker_role string, entity_type string, semantic_role string, intent_label string, dialogue_id string, cost double, "
    "latency_ms double, metadata string"
)
_SPAN = "array<struct<start:int,end:int,text:string,pii_type:string,label:string>>"
GROUND_TRUTH_SCHEMA = f"id string, filename string, ground_truth_source string, transcript string, pii_occurrences {_SPAN}, spans {_SPAN}"
ANNOTATED_SESSION_SCHEMA = (
    "leadRole string, transcript array<struct<_id:string,session_id:string,role:string,content:string,sequence_id:int,"
    "annotations:array<struct<start:int,end:int,pii_type:string>>>>"
)
ANONYMIZED_SESSION_SCHEMA = (
    "session_id string, topic_name string, subject_name string, anonymized_transcript array<struct<message:string,"
    "message_type:string,user_role:string,timestamp_seconds:double>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped and bad JSON fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _checked(df: DataFrame, faults, strict: bool) -> DataFrame:
    if not strict:
        return df.filter(~faults)
    guard = F.when(faults, F.raise_error(F.concat(F.lit("invalid record id="), F.coalesce("id", F.lit("?")))).cast("boolean"))
    return df.filter(guard.isNull())


def read_candidate(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Validated candidate rows; ``strict=False`` drops faulty rows (see ``candidate_violations``)."""
    need = [F.col(c).isNull() for c in ("id", "subject", "tokens", "labels")]
    fault = F.greatest(*[n.cast("int") for n in need], F.coalesce((F.size("tokens") != F.size("labels")).cast("int"), F.lit(0))) > 0
    return _checked(read_jsonl(spark, path, CANDIDATE_SCHEMA), fault, strict)


def read_action(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    need = [F.col(c).isNull().cast("int") for c in ("id", "subject", "span_text", "context_text", "action_label")]
    return _checked(read_jsonl(spark, path, ACTION_SCHEMA), F.greatest(*need) > 0, strict)


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """``dialogue_id, transcript, spans, source_file`` from ``*.ground_truth.json`` files."""
    raw = spark.read.schema(GROUND_TRUTH_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(
        f"{folder.rstrip('/')}/*.ground_truth.json")
    name = F.col("_metadata.file_name")
    spans = F.when(F.size("pii_occurrences") > 0, F.col("pii_occurrences")).otherwise(F.col("spans"))
    typed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
        F.coalesce(s["pii_type"], s["label"], F.lit("SUSPECT")).alias("pii_type")))
    guard = F.when(F.col("transcript").isNull(), F.raise_error(F.concat(name, F.lit(": transcript must be a string"))))
    return raw.select(
        F.coalesce(F.when(F.col("id") != "", F.col("id")), F.regexp_replace(name, r"\.json$", "")).alias("dialogue_id"),
        F.coalesce(guard.cast("string"), F.col("transcript")).alias("transcript"), typed.alias("spans"),
        "ground_truth_source", F.col("filename").alias("raw_filename"), name.alias("source_file"))


def sessions_to_turns(df: DataFrame) -> DataFrame:
    """Annotated sessions: turns by sequence id, session id from the first turn, empty ones skipped."""
    ordered = F.expr("array_sort(transform(transcript, (t, i) -> named_struct('q', t.sequence_id, 'i', i, 't', t)))")
    rows = df.filter(F.size("transcript") > 0).select("leadRole", ordered.alias("ts"))
    rows = rows.select("leadRole", F.expr("ts[0].t.session_id").alias("session_id"), F.explode("ts").alias("x"))
    return rows.select("session_id", F.col("leadRole").alias("lead_role"), F.col("x.t.sequence_id").alias("turn_index"),
                       F.col("x.t.role").alias("speaker_role"), F.col("x.t.content").alias("text"), F.col("x.t.annotations").alias("annotations"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return sessions_to_turns(read_jsonl(spark, path, ANNOTATED_SESSION_SCHEMA))


def anonymized_to_turns(df: DataFrame) -> DataFrame:
    """Sessions of the two known topics; others are skipped."""
    subject = F.try_element_at(literal_map(TOPIC_TO_SUBJECT), F.col("topic_name"))
    rows = df.filter(F.col("topic_name").isin(*TOPIC_TO_SUBJECT)).select(
        "session_id", "topic_name", "subject_name", subject.alias("subject"), F.posexplode("anonymized_transcript").alias("turn_index", "t"))
    return rows.select("session_id", "topic_name", "subject_name", "subject", "turn_index", F.col("t.user_role").alias("speaker_role"),
                       F.col("t.message").alias("text"), F.col("t.message_type").alias("message_type"), F.col("t.timestamp_seconds").alias("timestamp_seconds"))


def read_anonymized_sessions(spark: SparkSession, path: str) -> DataFrame:
    return anonymized_to_turns(read_jsonl(spark, path, ANONYMIZED_SESSION_SCHEMA))


# --- lesson transcripts ------------------------------------------------------------------------
_NAME = r"Science ([A-Z]{2}[0-9]+) transcript\.txt$"
_LINE = r"\A([0-9]{2}:[0-9]{2}:[0-9]{2})\t([A-Z]+)\t(.*)\z"
_NOISE = ("Top of Form", "Bottom of Form")


def find_transcripts(spark: SparkSession, root: str, countries: Sequence[str]) -> DataFrame:
    """``code, path, content``: one file per code; equal copies keep the first path.

    Same code with different content fails (see :func:`transcript_conflicts`).
    """
    files = _transcript_files(spark, root, countries)
    kept = files.groupBy("code").agg(F.count_distinct("sha").alias("n"), F.min_by(F.struct("path", "content"), "path").alias("f"))
    guard = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting copies of "), "code")).cast("boolean"))
    return kept.filter(guard.isNull()).select("code", "f.path", "f.content")


def _transcript_files(spark: SparkSession, root: str, countries: Sequence[str]) -> DataFrame:
    allowed = [c.strip().upper() for c in countries if c.strip()]
    if not allowed:
        raise ValueError("no countries requested")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    files = files.select(path.alias("path"), "content").withColumn("code", F.regexp_extract("path", rf"/{_NAME}", 1))
    parent = F.upper(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    return files.filter((F.col("code") != "") & parent.isin(*allowed)).withColumn("sha", F.sha1("content"))


def transcript_conflicts(spark: SparkSession, root: str, countries: Sequence[str]) -> DataFrame:
    files = _transcript_files(spark, root, countries)
    return files.groupBy("code").agg(F.count_distinct("sha").alias("versions"), F.min("path").alias("first_path")).filter("versions > 1")


def lesson_turns(df: DataFrame, text: str = "text") -> DataFrame:
    """Timestamped lines of whole-file lesson texts, cleaned and numbered from 1."""
    lines = F.split(F.replace(F.col(text), F.lit("\r"), F.lit("\n")), r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    clean = lambda x: strip_space(F.translate(F.regexp_replace(x, "﻿", ""), "� ", "  "))
    kept = F.filter(F.transform(lines, clean), lambda x: x.rlike(_LINE) & ~strip_space(F.regexp_extract(x, _LINE, 3)).isin("", *_NOISE))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(kept).alias("i", "line"))
    speaker = F.regexp_extract("line", _LINE, 2)
    return rows.select(
        *[c for c in df.columns if c != text], (F.col("i") + 1).alias("turn_index"), F.regexp_extract("line", _LINE, 1).alias("timestamp"),
        speaker.alias("speaker_tag"), R.speaker_role(speaker).alias("speaker_role"), collapse_space(F.regexp_extract("line", _LINE, 3)).alias("text"))


def read_transcripts(spark: SparkSession, root: str, countries: Sequence[str]) -> DataFrame:
    """Lesson turns of every unique transcript file; invalid bytes become spaces."""
    files = find_transcripts(spark, root, countries)
    return lesson_turns(files.select(
        F.concat(F.lit("timss-science-"), F.lower("code")).alias("dialogue_id"), F.substring("code", 1, 2).alias("country"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text")))


# --- run summaries ---------------------------------------------------------------------------------
SUMMARY_SCHEMA = "run_name string, run_kind string, selected_targets array<struct<target_review_rate:double,strategy:string,macro_f1:double>>"


def read_summaries(spark: SparkSession, root: str, schema: str = SUMMARY_SCHEMA) -> DataFrame:
    """All ``*/summary.json`` files with their path; each path once."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/*/summary.json")
    return df.withColumn("path", F.col("_metadata.file_path")).dropDuplicates(["path"])


def latest_summary(summaries: DataFrame, name: str, kind: str) -> DataFrame:
    """The newest run folder (names start with a timestamp) of a given name and kind."""
    mine = summaries.filter((F.col("run_name") == name) & (F.col("run_kind") == kind))
    return mine.orderBy(F.desc("path")).limit(1)


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """:func:`latest_summary` for every name and kind at once."""
    newest = summaries.groupBy("run_name", "run_kind").agg(F.max_by(F.struct(*[c for c in summaries.columns if c not in ("run_name", "run_kind")]), "path").alias("s"))
    return newest.select("run_name", "run_kind", "s.*")


def target_entry(summaries: DataFrame, rate: float) -> DataFrame:
    rows = explode_rows(summaries, F.col("selected_targets"), "t")
    return rows.filter(F.abs(F.col("t.target_review_rate") - rate) <= 1e-9).select("run_name", "run_kind", "path", "t.*")


