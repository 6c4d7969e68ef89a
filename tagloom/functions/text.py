"""Scalar functions on strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove_prefix(text: Column, prefix: str) -> Column:
    """Only a literal prefix goes; names with points in them aren't patterns."""
    return F.regexp_replace(text, f"^{re.escape(prefix)}", "")


def xml_escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', ""), ("'", "")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def last_part(text: Column, sep: str = ",") -> Column:
    return F.trim(F.regexp_extract(text, f"([^{re.escape(sep)}]+)$", 1))


def contains(text: Column, word: str) -> Column:
    """Regardless of case."""
    return F.lower(text).contains(word.lower())


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, "[ &-]", "")


def labelled(name: Column, detail: Column) -> Column:
    """Like "name (detail)", a missing part as NA."""
    return F.concat(F.coalesce(name, F.lit("NA")), F.lit(" ("), F.coalesce(detail, F.lit("NA")), F.lit(")"))
