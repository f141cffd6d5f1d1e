"""Quotes against their chunks: exact, then with white space, look-alikes and compatible characters made equal, then by the
best alignment of long quotes. Expressions do the first and, but for compatible characters (ligatures, full-width letters),
the second; only rows that fail both reach a vectorised function, in one pass over the rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.alignment import best_windows

FUZZY, SHORTEST = 0.92, 40
# Look-alike quotes, dashes and the non-breaking space.
ALIKE = dict.fromkeys("‘’‚‛", "'") | dict.fromkeys("“”„‟", '"') | dict.fromkeys("‐‑‒–—―", "-") | {" ": " "}


_ALIKE = str.maketrans(ALIKE)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "".join(ALIKE), "".join(ALIKE.values())), r"\s+", " "))


def _fold(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).translate(_ALIKE).split())


def _folded(text: str) -> tuple[str, list[int]]:
    """A text with compatible characters, look-alikes and white space made equal, and the place of each of its characters in
    the text as it is."""
    out, at = [], []
    for k, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).translate(_ALIKE):
            space = x.isspace()
            if not (space and (not out or out[-1] == " ")):
                out.append(" " if space else x)
                at.append(k)
    return "".join(out), at


def _find_folded(quote: str, text: str) -> tuple[int, int] | None:
    sought, (folded, at) = _fold(quote), _folded(text)
    place = folded.find(sought) if sought else -1
    return None if place < 0 else (at[place], at[place + len(sought) - 1] + 1)


def verify(pairs: DataFrame, legs: tuple[str, ...] = ("exact", "normalised", "fuzzy")) -> DataFrame:
    """pairs(quote, chunk_text) -> adds verified, score, char_start, char_end (in the chunk as it is) and method. A blank or
    null quote and a null chunk are not verified."""
    quote, text = F.col("quote"), F.col("chunk_text")
    at = F.instr(text, quote)
    tokens = F.array_join(F.transform(F.split(normalised(quote), " "), lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("")), F.lit("\\E"))), r"\s+")
    low = F.translate(text, "".join(ALIKE), "".join(ALIKE.values()))
    found = F.when(at == 0, F.regexp_substr(low, tokens)) if "normalised" in legs else F.lit(None).cast("string")
    rows = pairs.withColumns({"_blank": F.coalesce(F.trim(F.regexp_replace(quote, r"\s+", " ")), F.lit("")) == "", "_at": F.coalesce(at, F.lit(0)), "_found": found, "_low": low})
    rows = rows.withColumn("method", F.when(F.col("_blank"), "empty").when(F.col("_at") > 0, "exact").when(F.length("_found") > 0, "normalised").otherwise("not_found"))
    exact, alike = F.col("method") == "exact", F.col("method") == "normalised"
    start = F.when(exact, F.col("_at") - 1).when(alike, F.instr("_low", F.col("_found")) - 1).cast("int")
    length = F.when(exact, F.length(quote)).when(alike, F.length("_found"))
    rows = rows.withColumns({"score": F.when(exact, 1.0).when(alike, 0.99).otherwise(0.0), "char_start": start, "char_end": (start + length).cast("int")}).drop("_blank", "_at", "_found", "_low")
    odd = (F.col("method") == "not_found") & text.isNotNull() & (quote.rlike(r"[^\x00-\x7F]") | text.rlike(r"[^\x00-\x7F]")) if "normalised" in legs else F.lit(False)
    long = (F.col("method") == "not_found") & text.isNotNull() & (F.length(F.trim(quote)) >= SHORTEST) if "fuzzy" in legs else F.lit(False)
    if "normalised" in legs or "fuzzy" in legs:
        # rows that are settled pass through as nulls: what comes before is worked out once
        rows = rows.withColumns({"_odd": F.coalesce(odd, F.lit(False)), "_long": F.coalesce(long, F.lit(False))})
        open_ = F.col("_odd") | F.col("_long")
        rows = rows.withColumn("_f", F.pandas_udf(_rest, "method string, score double, char_start int, char_end int")(F.when(open_, quote), F.when(open_, text), "_odd", "_long"))
        late = lambda c: F.when(F.col("_f.method").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(c))
        rows = rows.withColumns({c: late(c) for c in ("score", "char_start", "char_end", "method")}).drop("_f", "_odd", "_long")
    return rows.withColumn("verified", F.col("method").isin("exact", "normalised", "fuzzy"))


def _rest(quotes: pd.Series, texts: pd.Series, odd: pd.Series, long: pd.Series) -> pd.DataFrame:
    """The second leg for characters that no table of single letters makes equal, then the third, for the rows that need them."""
    out: list[tuple] = [(None, None, None, None)] * len(quotes)
    late = []
    for k, (quote, text, is_odd, is_long) in enumerate(zip(quotes, texts, odd, long, strict=True)):
        found = _find_folded(quote, text) if is_odd else None
        if found:
            out[k] = ("normalised", 0.99, *found)
        elif is_long:
            late.append((k, _fold(quote), *_folded(text)))
    for (k, _, _, at), best in zip(late, best_windows([(quote, folded) for _, quote, folded, _ in late], FUZZY), strict=True):
        if best:
            out[k] = ("fuzzy", best[0], at[best[1]], at[best[2] - 1] + 1)
    return pd.DataFrame(out, columns=["method", "score", "char_start", "char_end"]).astype({"char_start": "Int32", "char_end": "Int32"})
