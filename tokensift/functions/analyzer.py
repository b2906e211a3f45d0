"""The analyzer: lower-cased, white-space delimited terms in order, repeats kept.

Separators are the space and the control characters 0x09 to 0x0D, nothing else; only ASCII documents are defined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokensift.errors import BindError

#: Separators as a character class that Java, Python and RE2 read alike.
SEPARATORS = r"[\x09-\x0D ]+"
NON_ASCII = "the analyzer handles ASCII text only; this text has other characters"


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_ascii(col: str | Column) -> Column:
    """Whether every byte is below 0x80; null for null.  Valid UTF-8 has as many bytes as characters only then."""
    c = as_column(col)
    return F.is_valid_utf8(c) & (F.octet_length(c) == F.char_length(c))


def pieces(col: str | Column) -> Column:
    """The terms of an ASCII text, and perhaps empty strings at its ends: enough to look for a term."""
    return F.split(F.lower(as_column(col)), SEPARATORS)


def term_pattern(term: str) -> str:
    """A regular expression for ``term`` between separators or ends."""
    literal = "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in term)
    return rf"(?:\A|[\x09-\x0D ]){literal}(?:[\x09-\x0D ]|\z)"


def has_term(col: str | Column, term: str) -> Column:
    """Whether an ASCII text has an analyzed term: a plain substring search settles most rows, then its ends are looked at."""
    low = F.lower(as_column(col))
    return low.contains(F.lit(term)) & low.rlike(term_pattern(term))


def terms(col: str | Column) -> Column:
    """The terms of a text that is known to be ASCII."""
    return F.filter(pieces(col), lambda t: t != "")


def guarded(col: str | Column, value: Column, non_ascii: str = "error") -> Column:
    """``value``, but for a non-ASCII text an error when the row is read, or null with ``non_ascii='null'``."""
    if non_ascii == "error":
        return F.when(~is_ascii(col), F.raise_error(F.lit(NON_ASCII)).cast("void")).otherwise(value)
    if non_ascii == "null":
        return F.when(is_ascii(col), value)
    raise BindError(f"non_ascii must be 'error' or 'null', not {non_ascii!r}")


def analyze(col: str | Column, non_ascii: str = "error") -> Column:
    """The terms of a text as an array; null for null, an empty array for a text without terms."""
    return guarded(col, terms(col), non_ascii)


def analyze_literal(text: str) -> list[str]:
    """The terms of a constant, on the driver."""
    if not text.isascii():
        raise BindError(NON_ASCII)
    return [t for t in re.split(SEPARATORS, text.lower()) if t]
