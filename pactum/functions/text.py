"""Expressions on text: match offsets, money mentions, language votes, garbling, token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currency markers, scale words, function words of the two languages.
CURRENCIES = {"rm": "MYR", "ringgit": "MYR", "myr": "MYR", "usd": "USD", "us$": "USD", "$": "USD", "sgd": "SGD", "eur": "EUR", "jpy": "JPY"}
SCALES = {"k": 3, "thousand": 3, "ribu": 3, "m": 6, "mm": 6, "mn": 6, "mil": 6, "million": 6, "juta": 6, "b": 9, "bn": 9, "billion": 9, "bilion": 9, "bil": 9}
MALAY = "yang dan dengan untuk adalah ini itu pada dalam akan tidak oleh kepada daripada bagi atau hendaklah sekiranya boleh telah juga serta seperti kerana tersebut mana-mana syarikat perjanjian tarikh nilai terbitan pemegang amaun".split()
ENGLISH = "the and of to in for shall is are this that with be by or any such which from not as has have been may will at on under each other all".split()

# How a mark, a number and a scale word stand together.
_MARK = r"(ringgit|myr|usd|us\$|sgd|eur|jpy|rm|\$)"
_SCALE = "(" + "|".join(sorted(SCALES, key=lambda w: (-len(w), w))) + ")"
MONEY = rf"(?i){_MARK}\s*(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*{_SCALE}\b)?"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<raw, start, end>> of all matches of a pattern that never matches nothing; offsets from 0, end excluded.

    The text between matches and the matches alternate, so a match starts after all that came before it."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("raw"), F.slice(between, 1, F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int,end:int>>").alias("out"))

    def step(state, pair):
        begin = state["at"] + F.length(pair["gap"])
        stop = begin + F.length(pair["raw"])
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(F.struct(pair["raw"].alias("raw"), begin.alias("start"), stop.alias("end")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<raw:string,start:int,end:int>>"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions read instead of each working it out again."""
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: for expressions over array items, where there are no columns."""
    return F.transform(F.array(value), use)[0]


def money_amount(raw: Column) -> Column:
    """decimal(20,4) amount of one mention, scaled by its word."""
    number = F.replace(F.regexp_extract(raw, MONEY, 2), F.lit(","), F.lit("")).try_cast("decimal(20,4)")
    scale = F.lower(F.regexp_extract(raw, MONEY, 3))
    factor = F.lit(1)
    for power in (3, 6, 9):
        factor = F.when(scale.isin([w for w, p in SCALES.items() if p == power]), F.lit(10**power)).otherwise(factor)
    return (number * factor).cast("decimal(20,4)")


def money_currency(raw: Column) -> Column:
    mark = F.lower(F.regexp_extract(raw, MONEY, 1))
    return F.coalesce(*[F.when(mark == k, F.lit(v)) for k, v in CURRENCIES.items()])


def money_mentions(text: Column) -> Column:
    """array<struct<raw, start, end, amount, currency>> of the amounts in text, in order."""
    return F.transform(matches(text, MONEY), lambda m: F.struct(m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"), money_amount(m["raw"]).alias("amount"), money_currency(m["raw"]).alias("currency")))


def largest_money(text: Column, currency: str | None = None) -> Column:
    """The mention with the largest amount, the first of equals; only those of one currency if it is named."""
    found = money_mentions(text)
    found = F.filter(found, lambda m: m["currency"] == currency) if currency else found
    best = F.array_max(F.transform(found, lambda m: F.struct(m["amount"].alias("amount"), (-m["start"]).alias("first"), m["currency"].alias("currency"))))
    return F.when(best.isNotNull(), F.struct(best["amount"].alias("amount"), best["currency"].alias("currency")))


def language(text: Column) -> Column:
    """'ms' or 'en' by at least two function words and more than the other's, else 'unknown'. Words are runs of letters and
    apostrophes, so a hyphen parts them and a marker with a hyphen is never met."""
    count = lambda words, known: F.size(F.filter(words, lambda w: w.isin(known)))
    counts = let(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)), lambda words: F.struct(count(words, MALAY).alias("ms"), count(words, ENGLISH).alias("en")))
    return let(counts, lambda n: F.when((n["ms"] >= 2) & (n["ms"] > n["en"]), "ms").when((n["en"] >= 2) & (n["en"] > n["ms"]), "en").otherwise("unknown"))


def text_search_config(lang: Column) -> Column:
    return F.when(lang == "ms", "simple").otherwise("english")


def garbled_ratio(text: Column) -> Column:
    """Share of characters in (cid:n) marks, replacement, control, private or unassigned characters, at most 1; 0 if empty."""
    rest = F.regexp_replace(text, r"\(cid:\d+\)", "")
    odd = F.length(rest) - F.length(F.regexp_replace(rest, r"[�[\p{Cc}\p{Cf}\p{Co}\p{Cn}]&&[^\n\r\t]]", ""))
    return F.when(F.length(text) > 0, F.least(F.lit(1.0), (F.length(text) - F.length(rest) + odd) / F.length(text))).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """max(length / 3, words * 1.35, 1) in whole tokens, 0 for a blank text."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(words > 0, F.greatest(F.floor(F.length(text) / 3), F.floor(words * 1.35), F.lit(1))).otherwise(0).cast("int")
