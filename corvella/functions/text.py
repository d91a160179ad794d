"""Word tokens: runs of letters and digits, lower-cased unless asked otherwise, unique, in first-seen order."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def split_words(text: str, case_sensitive: bool = False) -> list[str]:
    return [*dict.fromkeys(_WORD.findall(text if case_sensitive else text.lower()))]


def tokens(text: Column, case_sensitive: bool = False) -> Column:
    """The same as a column; null stays null."""
    return F.array_distinct(F.regexp_extract_all(text if case_sensitive else F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
