"""Covenant extraction over chunks: patterns in one pass, terms from each match, quotes widened to sentences, greedy removal
of overlaps, call schedules, candidate spans, and the gate between verified clauses and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions.joins import overlapping
from pactum.functions.ratings import normalise
from pactum.functions.text import largest_money, matches, once

CONTEXT, MIN_QUOTE, CANDIDATES = 400, 60, 200
#: Characters of a bin in which spans of a chunk meet.
SPAN_BIN = 256
_TAIL = r"[^.;]{0,80}?of\s+not\s+(more|less)\s+than\s+(\d+(?:\.\d+)?)\s*(?:times|x\b)"
_NOTCH = r"((?:AAA|AA[+-]?|A[+-]?|BBB[+-]?|BB[+-]?|B[+-]?|CCC[+-]?|CC|C|D)(?:[123])?)"
# What covenants say, as (name, pattern, clause type, covenant type, confidence, what its groups hold).
PATTERNS = [
    ("gearing_ratio_en", r"gearing\s+ratio" + _TAIL, "financial_covenant", "gearing_ratio", 0.90, "ratio"),
    ("gearing_ratio_ms", r"nisbah\s+gearan[^.;]{0,60}?(tidak\s+melebihi|tidak\s+kurang\s+daripada)\s+(\d+(?:\.\d+)?)\s*kali", "financial_covenant", "gearing_ratio", 0.85, "ratio"),
    ("interest_cover_en", r"interest\s+(?:cover|coverage)(?:\s+ratio)?" + _TAIL, "financial_covenant", "interest_cover", 0.90, "ratio"),
    ("finance_service_cover_en", r"(?:finance|debt)\s+service\s+cover(?:age)?(?:\s+ratio)?" + _TAIL, "financial_covenant", "finance_service_cover", 0.90, "ratio"),
    ("minimum_net_worth_en", r"(?:consolidated\s+)?(?:net\s+worth|shareholders'\s+funds)[^.;]{0,60}?of\s+not\s+less\s+than\s+((?:RM|MYR)\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|juta|bilion|m|b))?)", "financial_covenant", "minimum_net_worth", 0.88, "amount"),
    ("cross_default_en", r"(?:cross\s+default|indebtedness[^.;]{0,120}?becomes\s+due\s+and\s+payable\s+prior\s+to\s+its\s+stated\s+maturity)", "cross_default", "cross_default", 0.85, "nearby"),
    ("negative_pledge_en", r"(?:negative\s+pledge|shall\s+not[^.;]{0,120}?create\s+or\s+permit\s+to\s+subsist[^.;]{0,60}?security\s+interest)", "negative_pledge", "negative_pledge", 0.80, ""),
    ("change_of_control_en", r"change\s+(?:in|of)\s+control", "change_of_control", "change_of_control", 0.78, ""),
    ("rating_trigger_en", r"rating[^.;]{0,120}?(?:is\s+)?(downgraded|reduced|lowered|falls?)\s+(?:to\s+)?below\s+" + _NOTCH, "rating_trigger", "rating_trigger", 0.88, "rating"),
    ("shariah_non_compliance", r"(?:shariah\s+non-?\s*compliance|non-?\s*compliance\s+with\s+shariah|ketidakpatuhan\s+shariah)", "shariah_compliance", "shariah_non_compliance", 0.85, ""),
    ("purchase_undertaking", r"(?:purchase\s+undertaking|aku\s+janji\s+pembelian)", "purchase_undertaking", None, 0.80, ""),
    ("dissolution_event", r"(?:dissolution\s+event|kejadian\s+pembubaran)", "dissolution_event", None, 0.80, ""),
    ("call_option_en", r"(?:(?:may\s+)?redeem[^.;]{0,80}?(?:call\s+dates?|in\s+whole\s+or\s+in\s+part)|call\s+(?:date|price|schedule)|redemption\s+and\s+call\s+schedule)", "call_option", None, 0.75, ""),
]
CALL_ROW = r"(?i)(\d{4}-\d{2}-\d{2})\s*\n?\s*(1[0-4]\d\.\d{2}|9\d\.\d{2}|150\.00)(?:\s*\n?\s*(Optional|Mandatory|Make-?whole|Clean-?up|Tax|Regulatory))?"
AGENCIES = {"marc": "MARC", "malaysian rating corporation": "MARC", "ram": "RAM", "rating agency malaysia": "RAM"}


def hits(chunks: DataFrame) -> DataFrame:
    """Every pattern's matches in every chunk, in one scan: the chunk's columns, pattern_id, clause_type, covenant_type,
    confidence, holds, and the match m(raw, start, end)."""
    one = lambda name, pattern, clause, covenant, sure, holds: F.transform(matches(F.col("chunk_text"), "(?i)" + pattern), lambda m: F.struct(F.lit(name).alias("pattern_id"), F.lit(clause).alias("clause_type"), F.lit(covenant).cast("string").alias("covenant_type"), F.lit(sure).alias("confidence"), F.lit(holds).alias("holds"), m.alias("m")))
    some = F.col("chunk_text").rlike("(?i)" + "|".join(f"(?:{p[1]})" for p in PATTERNS))
    return chunks.where(some).withColumn("hit", F.explode(F.concat(*[one(*p) for p in PATTERNS]))).select(*chunks.columns, "hit.*")


def _find(text: Column, what: str, start: Column) -> Column:
    """Place of `what` at or after start, from 0; null if there is none."""
    at = F.instr(F.substring(text, start + 1, F.length(text)), what)
    return F.when(at > 0, start + at - 1)


def _rfind(text: Column, what: str, end: Column) -> Column:
    """Last place of `what` that ends by `end`, from 0; null if there is none."""
    before = F.substring(text, F.lit(1), end)
    at = F.instr(F.reverse(before), what[::-1])
    return F.when(at > 0, F.length(before) - at - len(what) + 1)


def _sentence_end(text: Column, at: Column) -> Column:
    return F.coalesce(F.least(_find(text, ". ", at), _find(text, "\n\n", at), _find(text, ".\n", at)) + 1, F.length(text))


def with_quotes(found: DataFrame) -> DataFrame:
    """Adds char_start, char_end and quote: the match widened to its sentence, and by the next one if that is short."""
    text = F.col("chunk_text")
    left = F.coalesce(F.greatest(_rfind(text, ". ", F.col("m.start")), _rfind(text, "\n\n", F.col("m.start"))) + 2, F.lit(0))
    out = once(once(found, "char_start", left), "_end", _sentence_end(text, F.col("m.end")))
    end = F.when(F.col("_end") - F.col("char_start") < MIN_QUOTE, _sentence_end(text, F.col("_end"))).otherwise(F.col("_end"))
    out = once(out, "char_end", F.least(end, F.length(text))).drop("_end").where("char_end > char_start")
    return out.withColumn("quote", F.substring(text, F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))


def agency_in(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in AGENCIES.items()])


def document_agency(chunks: DataFrame) -> DataFrame:
    """(document_id, agency): the only agency that a document names anywhere, else null."""
    names = sorted(set(AGENCIES.values()))
    named = {a: F.bool_or(F.lower("chunk_text").rlike("|".join(k for k, v in AGENCIES.items() if v == a))) for a in names}
    flags = chunks.groupBy("document_id").agg(*[x.alias(a) for a, x in named.items()])
    count = sum((F.col(a).cast("int") for a in names), F.lit(0))
    return flags.select("document_id", F.when(count == 1, F.coalesce(*[F.when(F.col(a), F.lit(a)) for a in names])).alias("agency"))


def with_terms(found: DataFrame, agencies: DataFrame | None = None) -> DataFrame:
    """Adds operator, threshold_ratio, threshold_amount, threshold_currency, trigger_rating, rating_agency and severity."""
    raw, holds, text = F.col("m.raw"), F.col("holds"), F.col("chunk_text")
    if agencies is not None:
        found = found.join(agencies, "document_id", "left")
    pick = lambda group: F.coalesce(*[F.when(F.col("pattern_id") == p[0], F.regexp_extract(raw, "(?i)" + p[1], group)) for p in PATTERNS if p[5] in ("ratio", "rating")])
    direction = F.regexp_replace(F.lower(pick(1)), r"\s+", " ")
    near = F.substring(text, F.greatest(F.col("m.start") - CONTEXT, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(CONTEXT)) + F.col("m.end") - F.col("m.start") + CONTEXT)
    money = largest_money(F.when(holds == "nearby", near).when(holds == "amount", raw))
    around = F.substring(text, F.greatest(F.col("m.start") - CONTEXT, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(CONTEXT)) + CONTEXT)
    kind = F.col("covenant_type")
    return once(found, "_money", money).withColumns({
        "operator": F.when(direction.isin("more", "tidak melebihi"), "lte").when(direction.isin("less", "tidak kurang daripada"), "gte").when(kind == "minimum_net_worth", "gte"),
        "threshold_ratio": F.when(holds == "ratio", pick(2)).try_cast("decimal(12,6)"),
        "trigger_rating": F.when(holds == "rating", normalise(pick(2))),
        "rating_agency": F.when(holds == "rating", F.coalesce(agency_in(around), *([F.col("agency")] if agencies is not None else []))),
        "severity": F.when(kind == "shariah_non_compliance", "critical").when(kind.isin("cross_default", "rating_trigger", "negative_pledge", "change_of_control"), "high").when(kind.isNotNull(), "medium"),
    }).withColumns({"threshold_amount": F.col("_money.amount"), "threshold_currency": F.col("_money.currency")}).drop("_money", "agency")


def drop_overlaps(found: DataFrame, key: str = "hash") -> DataFrame:
    """Of extractions of one clause and covenant type in a chunk that overlap, the most confident stays, then the first:
    greedy, in that order, so one that only overlaps a dropped one stays too. A fold over each group's spans, beside its rows."""
    rows = found.withColumn("_id", F.struct((-F.col("confidence")).alias("c"), "char_start", "char_end", "pattern_id", F.col("m.start").alias("at")))
    clash = lambda kept, x: F.exists(kept, lambda k: (x["char_start"] < k["char_end"]) & (k["char_start"] < x["char_end"]))
    kind = rows.select("_id").schema["_id"].dataType.simpleString()
    rows = rows.withColumn("_all", F.collect_list("_id").over(Window.partitionBy(key, "clause_type", "covenant_type")))
    kept = F.aggregate(F.array_sort("_all"), F.array().cast(f"array<{kind}>"), lambda a, x: F.when(clash(a, x), a).otherwise(F.concat(a, F.array(x))))
    return rows.where((F.size("_all") == 1) | F.exists(kept, lambda k: k == F.col("_id"))).drop("_id", "_all")


def extract(chunks: DataFrame) -> DataFrame:
    """Covenant extractions of every chunk (document_id, hash, chunk_text, ...)."""
    return drop_overlaps(with_terms(with_quotes(hits(chunks)), document_agency(chunks))).drop("holds", "m")


def call_schedule(chunks: DataFrame) -> DataFrame:
    """(document_id, call_date, call_price decimal, call_type, ...): one row for each document and date."""
    rows = chunks.withColumn("m", F.explode(matches(F.col("chunk_text"), CALL_ROW)))
    group = lambda k: F.regexp_extract("m.raw", CALL_ROW, k)
    kind = F.translate(F.lower(group(3)), "- ", "")
    named = F.when(kind == "makewhole", "make_whole").when(kind == "cleanup", "clean_up").when(kind.isin("mandatory", "tax", "regulatory"), kind).otherwise("optional")
    out = rows.select("document_id", group(1).try_cast("date").alias("call_date"), group(2).try_cast("decimal(12,6)").alias("call_price"), named.alias("call_type"), F.col("m.start").alias("char_start"), F.col("m.end").alias("char_end"), "hash").where("call_date is not null")
    first = Window.partitionBy("document_id", "call_date").orderBy("hash", "char_start")
    return out.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def merge_spans(spans: DataFrame, key: str, context: int = CONTEXT) -> DataFrame:
    """spans(key, length, start, end, hint) -> islands: each widened by the context, clipped, merged where the next begins
    by the running end; (key, start, end, hints)."""
    wide = spans.select(key, F.greatest(F.col("start") - context, F.lit(0)).alias("start"), F.least(F.col("end") + context, F.col("length")).alias("end"), "hint")
    order = Window.partitionBy(key).orderBy("start", "end")
    opened = wide.withColumn("_new", F.when(F.col("start") <= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    island = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("hint")).alias("hints")).drop("_island")


def candidates(chunks: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Candidate spans of every chunk, at most `limit` a document: those of the chunks that come first by hash, numbered in the
    order of pages."""
    spans = hits(chunks).select("hash", F.length("chunk_text").alias("length"), "m.start", "m.end", F.coalesce("covenant_type", "clause_type").alias("hint"))
    found = merge_spans(spans, "hash").join(chunks.select("hash", "document_id", "page_number", "ordinal"), "hash")
    cut = Window.partitionBy("document_id").orderBy("hash", "start")
    order = Window.partitionBy("document_id").orderBy("page_number", "ordinal", "start")
    return found.withColumn("_cut", F.row_number().over(cut)).where(F.col("_cut") <= limit).drop("_cut").withColumn("place", F.row_number().over(order))


def uncovered(semantic: DataFrame, regex: DataFrame) -> DataFrame:
    """Regex candidates, and the semantic ones whose chunk has none."""
    return regex.unionByName(semantic.join(regex.select("hash").distinct(), "hash", "left_anti"), allowMissingColumns=True)


def review_trigger(rows: DataFrame, amount: int = 100_000_000, sure: float = 0.85) -> DataFrame:
    """Adds trigger_reason (the first that holds) and review_status."""
    disagrees = F.coalesce(F.col("disagrees"), F.lit(False)) if "disagrees" in rows.columns else F.lit(False)
    reason = F.when(F.col("threshold_amount") > amount, "high_value").when(F.col("confidence") < sure, "low_confidence").when(disagrees, "rule_llm_disagreement")
    return rows.withColumn("trigger_reason", reason).withColumn("review_status", F.when(reason.isNull(), "not_required").otherwise("pending"))


def persist_gate(extractions: DataFrame) -> dict[str, DataFrame]:
    """Splits extractions with `verified` into clauses, covenants, rating triggers (of a linked instrument) and reviews:
    what is not verified never becomes a clause."""
    marked = review_trigger(extractions.withColumn("clause_id", F.sha2(F.concat_ws("|", "document_id", "hash", "clause_type", F.coalesce("covenant_type", F.lit("")), F.col("char_start").cast("string")), 256)))
    good, bad = marked.where("verified"), marked.where("not coalesce(verified, false)")
    typed = good.where("covenant_type is not null")
    reviews = bad.select(F.lit("clause").alias("entity_type"), F.col("clause_id").alias("entity_id"), F.lit("unverified_quote").alias("trigger_reason")).union(typed.where("trigger_reason is not null").select(F.lit("covenant"), "clause_id", "trigger_reason"))
    return {"clauses": good, "covenants": typed, "rating_triggers": typed.where("covenant_type = 'rating_trigger' and trigger_rating is not null and instrument_id is not null"), "reviews": reviews}


def disagreements(pairs: DataFrame) -> DataFrame:
    """pairs with llm_ and rule_ columns of covenant_type, threshold_amount, threshold_ratio, operator -> adds disagrees:
    the types differ, only one side is quantified, a number differs by over 1 % of the larger, or the operators differ."""
    both = lambda c: (F.col(f"llm_{c}"), F.col(f"rule_{c}"))

    def numbers(c):
        a, b = both(c)
        return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * F.lit("0.01").cast("decimal(4,2)"), F.lit(False))

    kinds, (x, y) = both("covenant_type"), both("operator")
    return pairs.withColumn("disagrees", ~kinds[0].eqNullSafe(kinds[1]) | numbers("threshold_amount") | numbers("threshold_ratio") | F.coalesce(x != y, F.lit(False)))


def match_rules(model: DataFrame, rules: DataFrame) -> DataFrame:
    """For each model record (record_id, hash, char_start, char_end, covenant_type) the rule extraction of its chunk that
    overlaps it: of the same type if there is one, then with the largest overlap. Columns are prefixed llm_ and rule_."""
    named = lambda df, p: df.select(*[F.col(c).alias(c if c == "hash" else f"{p}_{c}") for c in df.columns])
    span = lambda p: (F.col(f"{p}_char_start"), F.col(f"{p}_char_end"))
    joined = overlapping(named(model, "llm"), named(rules, "rule"), ["hash"], span("llm"), span("rule"), SPAN_BIN)
    overlap = F.least("llm_char_end", "rule_char_end") - F.greatest("llm_char_start", "rule_char_start")
    best = Window.partitionBy("llm_record_id").orderBy(F.col("llm_covenant_type").eqNullSafe(F.col("rule_covenant_type")).desc(), F.desc("overlap"), "rule_char_start", "rule_covenant_type")
    return joined.withColumn("overlap", overlap).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def validate_records(records: DataFrame) -> DataFrame:
    """Model output (payload JSON) -> its fields and an array of violations, empty if it may go on."""
    fields = "clause_type string, covenant_type string, source_quote string, confidence double, operator string, threshold_amount string, threshold_currency string, threshold_ratio string, trigger_rating string, rating_agency string, severity string"
    rows = records.withColumn("r", F.from_json("payload", fields, {"mode": "PERMISSIVE"})).select(*records.columns, "r.*")
    rows = rows.withColumns({"threshold_amount": F.col("threshold_amount").try_cast("decimal(20,4)"), "threshold_ratio": F.col("threshold_ratio").try_cast("decimal(12,6)")})
    rules = [(F.coalesce(F.trim("source_quote"), F.lit("")) == "", "no quote"), (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range"), (F.col("threshold_amount").isNotNull() & F.col("threshold_currency").isNull(), "amount without currency"), (F.col("trigger_rating").isNotNull() & F.col("rating_agency").isNull(), "trigger without agency")]
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules])))
