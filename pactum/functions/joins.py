"""Joins by key, and on overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be sent to all executors whole. Spark judges a table by the size of its files, and texts
    that repeat themselves, or that a query makes from a number, are hundreds of times as large as those."""
    return df.hint("merge")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int) -> DataFrame:
    """Rows of both sides that are equal in `on` and whose spans (start, end; whole numbers, end excluded) overlap, each pair once.

    A span stands in every bin of `width` that it reaches into, and spans meet in a bin of their key, so only near ones do: work
    follows the overlaps, not the pairs of a key. A pair counts in the first bin that both have. Empty spans and spans with a
    null end overlap nothing; null keys meet nothing. width should be near the length of most spans."""

    def binned(df: DataFrame, name: str, span: tuple[Column, Column]) -> DataFrame:
        own = df.withColumns({f"_{name}_start": span[0].cast("bigint"), f"_{name}_end": span[1].cast("bigint")}).where(F.col(f"_{name}_end") > F.col(f"_{name}_start"))
        first, last = F.floor(F.col(f"_{name}_start") / width), F.floor((F.col(f"_{name}_end") - 1) / width)
        return own.withColumn(f"_{name}_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    met = binned(left, "l", left_span).join(binned(right, "r", right_span), [*on, "_bin"])
    both = (F.col("_l_start") < F.col("_r_end")) & (F.col("_r_start") < F.col("_l_end")) & (F.col("_bin") == F.greatest("_l_first", "_r_first"))
    return met.where(both).drop("_bin", *[f"_{s}_{c}" for s in "lr" for c in ("start", "end", "first")])
