"""Scalar functions on message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two e-mail patterns. The second one's A-z also covers the six signs between Z and a.
HAS_EMAIL = r"[\w-_\.+]*[\w-_\.]\@([\w]+\.)+[\w]+[\w]"
CONTAINS_EMAIL = r"\b[A-z0-9._%+-]+@[A-z0-9.-]+\.[A-z]{2,}\b"


def has_email(text: Column) -> Column:
    return text.rlike(HAS_EMAIL)


def contains_email(text: Column) -> Column:
    return text.rlike(CONTAINS_EMAIL)


def split_words(text: Column) -> Column:
    """Lower-cased words between single spaces: inner empty words stay, trailing ones go, '' gives one empty word.

    A text of spaces alone has no words; null gives null.
    """
    return F.when((text != "") & (F.rtrim(text) == ""), F.array().cast("array<string>")).otherwise(F.split(F.rtrim(F.lower(text)), " "))


def text_of_words(text: Column) -> Column:
    """The text whose parts between single spaces are the words of ``split_words``; null where there are none."""
    return F.when((text != "") & (F.rtrim(text) == ""), None).otherwise(F.rtrim(F.lower(text)))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair as (smaller, larger)."""
    return F.least(a, b), F.greatest(a, b)


def partition_of(key: Column, n: int) -> Column:
    """A partition number from 0 to n - 1, by hash."""
    return F.pmod(F.hash(key), F.lit(n))
