"""Whitespace, case folding and regex helpers shared by every text operator.

The white-space and word classes are spelled out instead of using ``\\s``/``\\w``
because Java, RE2 and Python disagree on both outside ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space: TAB..CR, FS..US, SPACE, NEL and every separator.
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"
TOKEN_PATTERN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]"

# (?U) gives \b, \d and \s their Unicode reading; (?iu) folds case beyond ASCII.
ANY_CASE = "(?iuU)"
SAME_CASE = "(?U)"
DIGIT_CLASS = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def any_word(words: Iterable[str]) -> str:
    return rf"{ANY_CASE}\b(?:{'|'.join(words)})\b"


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def rstrip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE_CLASS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE_CLASS}]")


def fold_case(text: Column) -> Column:
    """Case-insensitive key: lower case plus the one common multi-letter fold."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def quote_literal(text: Column) -> Column:
    """Text quoted for use inside a Java regex, safe against an embedded ``\\E``."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return text.rlike("|".join(re.escape(n) for n in needles))


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(part) for item in mapping.items() for part in item])


def mapped(key: Column, mapping: dict) -> Column:
    """Look-up in a small fixed table; null when the key is absent."""
    return F.try_element_at(literal_map(mapping), key)


def stable_hash(value: Column, seed: int | None = None) -> Column:
    """Seeded SHA-1 hex used for every order that must not depend on arrival."""
    if seed is None:
        return F.sha1(value.cast("string"))
    return F.sha1(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def fingerprint(value: Column) -> Column:
    return F.sha2(value, 256)
