"""Credit ratings on one ordinal scale: rank 0 is the best, both agencies' notations map onto it. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notches from best to worst.
NOTCHES = ["AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D"]


# What may stand after a notch, in brackets or as an outlook.
SUFFIX = r"\s*\((S|BG|CG|FG|LG|P|M|ID)\)\s*$"
OUTLOOK = r"\s+(STABLE|POSITIVE|NEGATIVE|DEVELOPING|WATCH(\s+\w+)?)\s*$"


def normalise(rating: Column) -> Column:
    """The canonical notch of a raw rating; null where it is none: decorations, outlook words, spaces and case go, the
    digits 1, 2, 3 of the other notation become +, nothing, -."""
    text = F.upper(F.trim(rating))
    text = F.regexp_replace(text, SUFFIX, "")
    text = F.regexp_replace(text, OUTLOOK, "")
    text = F.replace(text, F.lit(" "), F.lit(""))
    plain = F.when(text.rlike("^[ABC]+[123]$"), F.regexp_replace(F.translate(text, "123", "+=-"), "=", "")).otherwise(text)
    return F.when(plain.isin(NOTCHES), plain)


def rank(rating: Column) -> Column:
    """Notch index, null where the rating is missing or unknown."""
    place = F.array_position(F.array(*map(F.lit, NOTCHES)), normalise(rating)).cast("int") - 1
    return F.when(place >= 0, place)


def notches_between(rating: Column, threshold: Column) -> Column:
    """Signed distance, positive where rating is worse."""
    return rank(rating) - rank(threshold)


def is_investment_grade(rating: Column) -> Column:
    return rank(rating) <= NOTCHES.index("BBB-")
