"""Text expressions: tokens, words, and the integer logarithm."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower only A-Z, byte for byte; accented capitals stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    """Array of maximal runs without Unicode white space."""
    return F.split(text, r"(?U)\s+")


def words(text: Column) -> Column:
    """Array of the words of a text: the alphabetic characters of each token, A-Z lowered. Other characters are taken out of
    the whole text at once, so there may be an empty word at either end."""
    return tokens(ascii_lower(F.regexp_replace(text, r"(?U)[^\p{IsAlphabetic}\s]+", "")))


def floor_log2(n: Column) -> Column:
    """Whole part of the binary logarithm; 0 for n <= 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n)) - 1)
