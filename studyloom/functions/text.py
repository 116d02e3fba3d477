"""Text expressions that differ from Spark's defaults: Unicode white space, case folding, ASCII-only folding, UUID values."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """c without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """c with every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def casefold(c: Column | str) -> Column:
    """Case folding: lower case, with the sharp s and the final sigma as their folded forms."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A to Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def tidy_page(c: Column | str) -> Column:
    """Page text with \\n line ends, no white space at line ends and none around the whole."""
    unix = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return strip(F.regexp_replace(unix, r"(?Um)[\s&&[^\n]]+$", ""))


def uuid_key(c: Column | str) -> Column:
    """The value of a UUID however written: 32 hexadecimal digits; other strings stay apart as '!' and the trimmed text.

    Null gives null."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_replace(F.lower(c), r"urn:uuid:|[^0-9a-f]", "")
    return F.when(F.length(digits) == 32, digits).otherwise(F.concat(F.lit("!"), strip(F.lower(c))))
