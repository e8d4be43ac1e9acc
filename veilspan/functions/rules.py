"""Row-level rules: identifier detection, span heuristics, priors and label maps."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    ACTIONS, AMBIGUOUS_TAGS, CANONICAL_TYPE, CONTACT_HINTS, CONTROL_TAGS, DEFAULT_ROLE_BY_ACTION,
    DIRECT_ID_TYPES, MATH_SYMBOLS, MATH_TERMS, NAME_TITLES, ROLES, TITLE_STOPWORDS,
)
from .text import (
    ANY_CASE, DIGIT_CLASS, SAME_CASE, SPACE_CLASS, any_word, collapse_space, contains_any, fold_case, mapped,
    quote_literal, strip_space,
)
from .tokens import let

# Fixed patterns of the direct-identifier detector, in order of precedence.
DIRECT_ID_PATTERNS = (
    ("EMAIL_ADDRESS", ANY_CASE + r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"),
    ("URL", ANY_CASE + r"(?:(?:https?://|www\.)[^\s]+|\b(?:[A-Z0-9-]+\.)+"
                       r"(?:com|org|net|edu|gov|io|co|us|me|ai|app|dev|gg|tv|ly)\b(?:/[^\s]*)?)"),
    ("IP_ADDRESS", SAME_CASE + r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}"
                               r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"),
    ("US_SSN", SAME_CASE + r"\b\d{3}-\d{2}-\d{4}\b"),
    ("DATE_OF_BIRTH", ANY_CASE + r"\b(?:dob|d\.o\.b\.|date of birth|birthdate|born)\b"),
    ("US_DRIVER_LICENSE", ANY_CASE + r"\bDLN?[A-Z0-9-]{6,}\b"),
)

# Fixed cue words of the private prior and the curricular bonus.
CONTACT_CUE = any_word(("text", "email", "call"))
PLACE_CUE = any_word(("my school", "i go to", "i live in", "i'm from", "im from", "i am from"))
ENGLISH_CUE = any_word((
    "essay", "author", "character", "novel", "story", "poem", "book", "passage", "article",
    "quote", "speaker", "paragraph", "chapter", "text",
))
SOCIAL_CUE = any_word((
    "war", "treaty", "empire", "colony", "president", "king", "queen", "nation", "state", "history",
    "revolution", "conference", "government", "foreign", "world war", "civil war",
))
LANGUAGE_MARKERS_V1 = any_word(("spanish", "espanol", "español"))
LANGUAGE_MARKERS_V2 = any_word(("spanish", "espanol", "español", "arabic", "persian", "farsi", "urdu"))
ARABIC_SCRIPT = r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}]"


# --- direct identifiers -----------------------------------------------------------
def detect_direct_id(span_text: Column, entity_type: Column | None = None) -> Column:
    """``struct(source, reason)`` of the first rule that fires, else null."""
    hit = lambda source, reason: F.struct(source.alias("source"), reason.alias("reason"))
    chain = None
    if entity_type is not None:
        kind = F.upper(strip_space(F.coalesce(entity_type, F.lit(""))))
        chain = F.when(kind.isin(*DIRECT_ID_TYPES), hit(F.lit("entity_type"), kind))
    text = F.coalesce(span_text, F.lit(""))
    for reason, pattern in DIRECT_ID_PATTERNS:
        outcome = hit(F.lit("pattern"), F.lit(reason))
        chain = F.when(text.rlike(pattern), outcome) if chain is None else chain.when(text.rlike(pattern), outcome)
    return chain


# --- span heuristics ----------------------------------------------------------------
def is_contact_like(text: Column) -> Column:
    return contains_any(F.lower(text), CONTACT_HINTS)


def is_grade_level(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("grade") | low.rlike(r"\A\p{Nd}{1,2}(?:st|nd|rd|th)\z")


def is_probable_phone(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{DIGIT_CLASS}]")) >= 7


def _strip_marks(token: Column) -> Column:
    return F.btrim(token, F.lit(".,!?()[]{}:;\"'"))


def is_name_like(tokens: Column) -> Column:
    """Starts with a title, or every word-like token is capitalised."""
    cleaned = F.transform(F.filter(tokens, lambda t: strip_space(t) != ""), _strip_marks)

    def judge(words):
        initials = F.filter(words, lambda t: t.rlike(r"[A-Za-z0-9]") & t.rlike(r"\A\p{L}"))
        return F.coalesce(fold_case(F.get(words, F.lit(0))).isin(*NAME_TITLES), F.lit(False)) | let(
            initials, lambda xs: (F.size(xs) > 0) & F.forall(xs, lambda t: t.rlike(r"\A\p{Lu}")))

    return let(cleaned, judge)


def is_math_like(tokens: Column) -> Column:
    cleaned = F.filter(F.transform(tokens, strip_space), lambda t: t != "")

    def judge(words):
        joined = F.array_join(words, "")
        digit = joined.rlike(f"[{DIGIT_CLASS}]")
        symbolic = F.forall(
            words, lambda t: t.rlike(rf"\A[{DIGIT_CLASS}]+\z") | fold_case(t).isin(*MATH_SYMBOLS))
        single = F.size(words) == 1
        return (
            F.when(F.size(words) == 0, False)
            .when(single & fold_case(F.get(words, F.lit(0))).isin("x", "y", "z"), False)
            .when(~joined.rlike(r"[\p{L}\p{N}]"), False)
            .when(symbolic, digit)
            .when(F.exists(words, lambda t: fold_case(t).isin(*MATH_TERMS)), True)
            .when(single, False)
            .otherwise(digit & joined.rlike(r"[-+*/=^<>]"))
        )

    return let(cleaned, judge)


def math_like_spans(tokens: Column, longest: int = 4) -> Column:
    """For each start, the shortest math-like run of at most ``longest`` tokens.

    A math-like run holds a digit or a math term, so only starts at or shortly before such a token are tried.
    """
    spans_type = "array<struct<start:int,end:int>>"

    def scan(ts):
        n = F.size(ts)

        def ending(i):
            tries = [
                F.when((i + k <= n) & is_math_like(F.slice(ts, i + 1, F.lit(k))),
                       F.struct(i.alias("start"), (i + k).alias("end")))
                for k in range(1, longest + 1)
            ]
            return F.coalesce(*tries)

        marks = F.transform(ts, lambda t, i: F.when(
            t.rlike(f"[{DIGIT_CLASS}]") | fold_case(strip_space(t)).isin(*MATH_TERMS), i))
        near = F.transform(F.array_compact(marks), lambda i: F.sequence(F.greatest(F.lit(0), i - (longest - 1)), i))
        starts = F.array_distinct(F.flatten(near))  # ascends, as the marks do
        return F.when(n > 0, F.filter(F.transform(starts, ending), lambda s: s.isNotNull())).otherwise(F.array().cast(spans_type))

    return let(tokens, scan)


def guess_entity_type(text: Column, tokens: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(is_contact_like(text), F.when(low.contains("http") | low.contains("www"), "URL").otherwise("CONTACT"))
        .when(is_grade_level(text), "GRADE_LEVEL")
        .when(is_probable_phone(text), "PHONE_NUMBER")
        .when(is_name_like(tokens), "PERSON")
    )


def titlecase_probes(tokens: Column) -> Column:
    """Left-to-right title+name pairs and runs of up to three capitalised tokens."""
    spans_type = "array<struct<start:int,end:int>>"

    def scan(ts):
        n = F.size(ts)
        upper = lambda t: F.coalesce(t.rlike(r"\A\p{Lu}"), F.lit(False))
        at = lambda i: F.get(ts, i)

        def step(acc, i):
            token = strip_space(at(i))
            word = fold_case(_strip_marks(token))
            run = F.when(upper(at(i + 1)), F.when(upper(at(i + 2)), 3).otherwise(2)).otherwise(1)
            width = (
                F.when(word.isin(*TITLE_STOPWORDS), 0)
                .when(word.isin(*NAME_TITLES) & upper(at(i + 1)), 2)
                .when(upper(token) & token.rlike(r"\p{L}"), run)
                .otherwise(0)
            )
            return F.when(i < acc["at"], acc).otherwise(let(width, lambda w: F.when(w == 0, acc).otherwise(F.struct(
                (i + w).alias("at"),
                F.concat(acc["out"], F.array(F.struct(i.alias("start"), (i + w).alias("end")))).alias("out"),
            ))))

        # Only a capital or a title opens a probe; all other tokens are passed over before the walk.
        opens = lambda t: F.coalesce(
            t.rlike(rf"\A[{SPACE_CLASS}]*\p{{Lu}}") | fold_case(_strip_marks(strip_space(t))).isin(*NAME_TITLES), F.lit(False))
        starts = F.array_compact(F.transform(ts, lambda t, i: F.when(opens(t), i)))
        return F.when(n > 0, F.aggregate(
            starts,
            F.struct(F.lit(0).alias("at"), F.array().cast(spans_type).alias("out")),
            step,
            lambda a: a["out"],
        )).otherwise(F.array().cast(spans_type))

    return let(tokens, scan)


def error_math_like(tokens: Column) -> Column:
    """The looser math test used when naming false positives."""
    joined = F.array_join(tokens, "")
    symbols = [s for s in MATH_SYMBOLS]
    return let(tokens, lambda ts: (F.size(ts) > 0) & (
        F.forall(ts, lambda t: t.rlike(rf"\A[{DIGIT_CLASS}]+\z") | t.isin(*symbols))
        | F.exists(ts, lambda t: F.lower(t).isin(*MATH_TERMS))
        | (joined.rlike(f"[{DIGIT_CLASS}]") & joined.rlike(r"[-+*/=^<>]"))
    ))


def error_name_like(tokens: Column) -> Column:
    """The looser name test used when naming false positives."""
    def judge(ts):
        first = F.lower(F.btrim(F.get(ts, F.lit(0)), F.lit(".,!?")))
        alpha = F.filter(ts, lambda t: t.rlike(r"\p{L}"))
        return (F.size(ts) > 0) & (first.isin(*NAME_TITLES) | (
            (F.size(alpha) > 0) & F.forall(alpha, lambda t: ~t.rlike(r"\A\p{L}") | t.rlike(r"\A\p{Lu}"))))

    return let(F.filter(tokens, lambda t: strip_space(t) != ""), judge)


# --- types and roles -------------------------------------------------------------------
def canonical_type(raw: Column) -> Column:
    key = F.translate(F.upper(strip_space(F.coalesce(raw, F.lit("SUSPECT")))), "- ", "__")
    return F.when(key == "", "SUSPECT").otherwise(F.coalesce(mapped(key, CANONICAL_TYPE), key))


def speaker_role(tag: Column) -> Column:
    key = F.upper(strip_space(tag))
    return F.when(key == "T", "teacher").when(key == "O", "observer").otherwise("student")


def semantic_role(role: Column, action: Column) -> Column:
    """Normalised role; the action decides when it is missing."""
    clean = F.upper(strip_space(role))
    return F.coalesce(F.when(clean.isin(*ROLES), clean), mapped(action, DEFAULT_ROLE_BY_ACTION))


def binary_label(label: Column, review: str = "redact") -> Column:
    """REVIEW is dropped (null), kept as KEEP, or folded into REDACT."""
    return F.when(label != "REVIEW", label).otherwise(
        F.lit({"drop": None, "keep": "KEEP", "redact": "REDACT"}[review]).cast("string"))


# --- scores ---------------------------------------------------------------------------
def challenge_score(entity_type: Column, tag_count: Column, role: Column) -> Column:
    return (
        F.when(entity_type.isin(*AMBIGUOUS_TAGS), 3).otherwise(0)
        + F.when(tag_count >= 2, 1).otherwise(0)
        + F.when(role == "student", 1).otherwise(0)
    )


def _around(before: str, span: Column, after: str) -> Column:
    return F.concat(F.lit(ANY_CASE + before), quote_literal(strip_space(span)), F.lit(after))


def greets(text: Column, span: Column) -> Column:
    return F.rlike(text, _around(r"\b(?:hi|hello|hey)\s+", span, r"\b"))


def self_identifies(text: Column, span: Column) -> Column:
    return F.rlike(text, _around(r"\b(?:my name is|i am|i'm|im)\s+", span, r"\b"))


def directly_addressed(turn_text: Column, span: Column) -> Column:
    return F.rlike(turn_text, _around(r",\s*", span, r"\b")) | F.rlike(turn_text, _around(r"\b", span, r"\s*[,!?:]"))


def _cue_points(text: Column, entity_type: Column) -> Column:
    return (
        F.when(entity_type.isin("SCHOOL", "LOCATION") & text.rlike(PLACE_CUE), 2).otherwise(0)
        + F.when(text.rlike(CONTACT_CUE), 1).otherwise(0)
        + F.when(entity_type.isin(*CONTROL_TAGS), 1).otherwise(0)
    )


def private_prior_v1(text: Column, span: Column, entity_type: Column) -> Column:
    present = strip_space(span) != ""
    return (
        F.when(present & greets(text, span), 3).otherwise(0)
        + F.when(present & self_identifies(text, span), 3).otherwise(0)
        + _cue_points(text, entity_type)
    )


def person_private_score(text, turn_text, span, entity_type, subject, turn_index) -> Column:
    """Cue score of an English PERSON; zero unless at least one cue fires."""
    flags = F.struct(
        greets(text, span).alias("g"), self_identifies(text, span).alias("s"),
        directly_addressed(turn_text, span).alias("d"),
    )
    scored = let(flags, lambda f: F.when(f["g"] | f["s"] | f["d"], (
        F.when(f["g"], 5).otherwise(0) + F.when(f["s"], 5).otherwise(0)
        + F.when(f["d"], 2).otherwise(0) + F.when(turn_index < 5, 1).otherwise(0)
    )).otherwise(0))
    applies = (subject == "english") & (entity_type == "PERSON") & (strip_space(span) != "")
    return F.when(applies, scored).otherwise(0)


def private_prior_v2(text, turn_text, span, entity_type, subject, turn_index) -> Column:
    return person_private_score(text, turn_text, span, entity_type, subject, turn_index) + _cue_points(text, entity_type)


def curricular_bonus(text: Column, subject: Column) -> Column:
    return (
        F.when(subject == "english", F.least(F.lit(2), F.regexp_count(text, F.lit(ENGLISH_CUE))))
        .when(subject == "social_studies", F.least(F.lit(2), F.regexp_count(text, F.lit(SOCIAL_CUE))))
        .otherwise(0)
    )


# --- suggested actions ----------------------------------------------------------------
def pool_suggestion(text: Column, tokens: Column) -> Column:
    return F.when(is_contact_like(text), "REDACT").when(is_math_like(tokens), "KEEP").otherwise("REVIEW")


def pilot_suggestion(subject: Column, entity_type: Column, private_score: Column | None = None) -> Column:
    """Suggestion for a tagged item; ``private_score`` adds the later rule in front."""
    first = F.when(private_score > 0, "REDACT") if private_score is not None else None
    control = entity_type.isin(*CONTROL_TAGS)
    chain = first.when(control, "REDACT") if first is not None else F.when(control, "REDACT")
    return (
        chain.when((subject == "social_studies") & entity_type.isin(*AMBIGUOUS_TAGS), "KEEP")
        .when((subject == "english") & (entity_type == "COURSE"), "KEEP")
        .otherwise("REVIEW")
    )


# --- model responses ------------------------------------------------------------------
_JSON = {"allowSingleQuotes": "false"}


def _unfence(text: Column) -> Column:
    body = strip_space(text)
    return F.when(
        body.rlike(r"(?s)\A```[^\n]*\n.*\n\s*```\z"),
        strip_space(F.regexp_replace(body, r"(?s)\A```[^\n]*\n|\n\s*```\z", "")),
    ).otherwise(body)


def _verdict(body: Column, clean) -> Column:
    """``struct(action_label, semantic_role, error)``; exactly one side is filled."""
    def checked(fields):
        action, role = clean(fields["action_label"], ACTIONS), clean(fields["semantic_role"], ROLES)
        error = (
            F.when(fields.isNull(), "invalid JSON object")
            .when(~F.array_contains(F.map_keys(fields), "action_label")
                  | ~F.array_contains(F.map_keys(fields), "semantic_role")
                  | (F.size(fields) != 2), "unexpected keys")
            .when(action.isNull() | ~action.isin(*ACTIONS), "bad action_label")
            .when(role.isNull() | ~role.isin(*ROLES), "bad semantic_role")
        )
        return F.struct(
            F.when(error.isNull(), action).alias("action_label"),
            F.when(error.isNull(), role).alias("semantic_role"),
            error.alias("error"),
        )

    return let(F.when(body.rlike(r"(?s)\A\{.*\}\z"), F.from_json(body, "map<string,string>", _JSON)), checked)


def parse_response(raw: Column) -> Column:
    """Strict reading: optional code fence around one two-key JSON object."""
    return _verdict(_unfence(raw), lambda v, allowed: F.try_element_at(F.array(v), F.lit(1)))


def parse_response_tolerant(raw: Column) -> Column:
    """Also drops a reasoning prefix, quotes bare values and forgives one stray character."""
    body = strip_space(F.regexp_replace(strip_space(raw), r"(?s)\A.*</think>", ""))
    body = _unfence(body)
    body = F.when(body.rlike(r"(?s)\{.*\}"), F.regexp_extract(body, r"(?s)\{.*\}", 0)).otherwise(body)
    for key, values in (("action_label", ACTIONS), ("semantic_role", ROLES)):
        body = F.regexp_replace(
            body, rf'("{key}"\s*:\s*)({"|".join(values)})(\s*[,}}])', r'$1"$2"$3')

    def clean(value, allowed):
        def near(v):
            hits = F.filter(
                F.array(*[F.lit(a) for a in allowed]),
                lambda a: v.startswith(a) & (F.length(v) - F.length(a) <= 1),
            )
            return F.coalesce(F.when(v.isin(*allowed), v), F.get(hits, F.lit(0)))

        return let(F.regexp_replace(F.upper(value), "[^A-Z_]", ""), near)

    return _verdict(body, clean)


def oversize_reasons(turn_text: Column, tag_count: Column, max_words: int = 350, max_tags: int = 20) -> Column:
    words = F.size(F.filter(F.split(collapse_space(turn_text), " "), lambda w: w != ""))
    return F.array_compact(F.array(
        F.when(tag_count > max_tags, "qualifying_tag_count"),
        F.when(words > max_words, "turn_word_count"),
    ))
