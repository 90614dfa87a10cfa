"""Column helpers for operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java regular expressions of the two kinds of words; the second one for lower-cased A-Z.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
LETTERS_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column, gap: str) -> Column:
    """The words of text between matches of gap; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shown(words: Column) -> Column:
    return F.array_join(words, ",")


def free(name: str, taken: list[str]) -> str:
    """name, with as many underscores after it as make it differ from the taken ones (in any case)."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name
