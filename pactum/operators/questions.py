"""A log of questions as one batch: intent, what is asked for, unknown words, entities and documents named, evidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.joins import by_key
from pactum.functions.ratings import NOTCHES, normalise, rank
from pactum.operators.rules import evaluate
from pactum.sources.tables import READABLE, saved

# What questions of each kind say, in the order that they are tried.
INTENTS = [
    ("unsupported", [r"\bshould\s+(?:i|we)\b", r"\brecommend", r"\bwill\b.*\b(?:rally|fall|rise|outperform|default)\b", r"\bforecast", r"\bpredict", r"\bgoing\s+to\s+happen\b", r"\bworth\s+buying\b", r"\bgood\s+investment\b", r"\bfair\s+value\b", r"\bprice\s+target\b"]),
    ("covenant_breach_check", [r"\bbreach", r"\bviolat", r"\bin\s+compliance\b", r"\bcomply\b", r"\bcompliant\b", r"\bheadroom\b", r"\btrip(?:ped|s)?\b", r"\btrigger(?:ed)?\s+(?:by|at)\b", r"\bwould\s+be\s+triggered\b"]),
    ("portfolio_query", [r"\bportfolio", r"\bexposure\b", r"\bholding", r"\bnav\b", r"\bweight", r"\bfund\b", r"\bhow\s+much\s+do\s+we\s+(?:hold|own)\b"]),
    ("covenant_lookup", [r"\bcovenant", r"\bnegative\s+pledge\b", r"\bcross[\s-]?default\b", r"\bgearing\b", r"\bnisbah\s+gearan\b", r"\binterest\s+cover", r"\bfinance\s+service\s+cover", r"\brating\s+trigger\b", r"\bthreshold\b", r"\bcall\s+(?:date|price|schedule)\b", r"\bredeem\b", r"\bredemption\b", r"\bshariah\b", r"\bdissolution\b", r"\bpurchase\s+undertaking\b", r"\bevent\s+of\s+default\b", r"\bchange\s+of\s+control\b"]),
    ("instrument_lookup", [r"\bissuer\b", r"\bmaturity\b", r"\bissue\s+size\b", r"\bisin\b", r"\brated\b", r"\brating\s+of\b", r"\bwhich\s+instruments?\b", r"\bsukuk\s+structure\b", r"\bijarah\b|\bwakalah\b|\bmusharakah\b|\bmudharabah\b|\bmurabahah\b|\bistisna"]),
]
COVENANTS = [("negative pledge", "negative_pledge"), ("cross default", "cross_default"), ("cross-default", "cross_default"), ("gearing", "gearing_ratio"), ("nisbah gearan", "gearing_ratio"), ("interest cover", "interest_cover"), ("finance service cover", "finance_service_cover"), ("net worth", "minimum_net_worth"), ("rating trigger", "rating_trigger"), ("shariah", "shariah_non_compliance"), ("change of control", "change_of_control")]
GRAMMAR = "a an the this that these those there it its i we our you they is are was were be been do does did have has can could will would shall may what which who when where why how and or not no of for to in on at by with from about between any each every all much many more less most give show list tell me please below above under over worse before after next last largest total sum count number current today".split()
SUBJECTS = "exposure rated breach breached compliance comply trip trips triggered hold holds held own owns bond bonds sukuk note notes fund funds portfolios largest smallest outstanding".split()
STRUCTURED = ("instrument_lookup", "portfolio_query", "covenant_breach_check")


def intent(question: Column) -> Column:
    text = F.lower(F.trim(question))
    out = F.when(F.coalesce(text, F.lit("")) == "", "unsupported")
    for name, patterns in INTENTS:
        out = out.when(text.rlike("|".join(patterns)), name)
    return out.otherwise("document_search")


def covenant_type_in(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in COVENANTS])


def rating_threshold_in(question: Column) -> Column:
    """The notch after below, under or worse than; null if there is none."""
    return normalise(F.nullif(F.regexp_extract(question, r"(?i)\b(?:below|under|worse\s+than)\s+((?:AAA|AA|A|BBB|BB|B|CCC|CC|C|D)[+\-123]?)(?![A-Za-z0-9])", 1), F.lit("")))


def asks_about_calls(question: Column) -> Column:
    return F.lower(question).rlike(r"\bcall(?:s|able)?\b|\bredeem|\bredemption")


def known_words(extra: list[str] | None = None) -> list[str]:
    """Words that questions may use without a claim on the data: grammar, and the words of the readable columns."""
    columns = {w for name, own in READABLE.items() for c in [name, *own] for w in c.split("_")}
    return sorted(set(GRAMMAR) | set(SUBJECTS) | columns | {w for _, v in COVENANTS for w in v.split("_")} | {n.lower() for n in ("AAA", "AA", "BBB", "BB", "CCC", "CC")} | set(extra or []))


def unsupported_terms(questions: DataFrame, names: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """questions(query_id, question), names(name) -> adds unsupported, the words of two letters or more, in order and each
    once, that are neither known nor in a name that the data hold."""
    words = questions.select("query_id", F.posexplode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0)))).alias("place", "word"))
    odd = words.where((F.length("word") >= 2) & ~F.col("word").isin(known_words(extra)))
    named = names.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    left = odd.join(by_key(named), "word", "left_anti").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("unsupported"))
    return questions.join(by_key(left), "query_id", "left").withColumn("unsupported", F.coalesce("unsupported", F.array().cast("array<string>")))


def _runs(words: Column, most: int = 12) -> Column:
    """Every run of 2 to `most` neighbouring words, joined by spaces. A longer run begins with one of `most` words, so a name
    that only a longer run tells from others is found by standing whole in the question."""
    n = F.size(words)
    starts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(n - s + 1, F.lit(most)))), lambda k: F.array_join(F.slice(words, s, k), " ")))))


def mentioned_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name): names that stand whole in a question, or of which it has a run of two words or more that no other
    name has; a run that two names share names neither."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    asked = questions.select("query_id", "question", F.explode(_runs(words(F.col("question")))).alias("run"))
    own = names.select("name").distinct().select("name", F.explode(_runs(words(F.col("name")))).alias("run"))
    unique = own.groupBy("run").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").select("run", "name")
    by_run = asked.join(by_key(unique), "run").select("query_id", "name")
    first = names.select("name", F.array_join(F.slice(words(F.col("name")), 1, 2), " ").alias("run")).where("run <> ''").distinct()
    single = questions.select("query_id", "question", F.explode(F.array_distinct(words(F.col("question")))).alias("run"))
    whole = asked.select("query_id", "question", "run").union(single).join(by_key(first), "run").where(F.contains(F.lower("question"), F.lower("name"))).select("query_id", "name")
    return by_run.union(whole).distinct()


def mentioned_documents(questions: DataFrame, files: DataFrame, generic: list[str], reserved: DataFrame | None = None) -> DataFrame:
    """(query_id, filename): files of which a question has a word of three letters or more, no number, no generic or reserved
    word, that no other file has."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word")
    own = files.select("filename", words(F.col("filename"))).where((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(generic or [""]))
    own = own.join(reserved.select("word").distinct(), "word", "left_anti") if reserved is not None else own
    unique = own.groupBy("word").agg(F.count_distinct("filename").alias("n"), F.min("filename").alias("filename")).where("n = 1").select("word", "filename")
    return questions.select("query_id", words(F.col("question"))).join(unique, "word").select("query_id", "filename").distinct()


def narrowed(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows(query_id, key) cut to what each question names; a question that names nothing, or nothing there, keeps all."""
    hit = rows.join(named.select("query_id", key).distinct(), ["query_id", key], "left_semi")
    return hit.unionByName(rows.join(hit.select("query_id").distinct(), "query_id", "left_anti"))


def classify(questions: DataFrame) -> DataFrame:
    q = F.col("question")
    return questions.withColumns({"intent": intent(q), "covenant_type": covenant_type_in(q), "rating_below": rating_threshold_in(q), "about_calls": asks_about_calls(q)})


#: What stands in a scope for everything.
ALL = ""


def _lines(rows: DataFrame, item: Column, line: Column, cited: Column | None = None, confidence: Column | float = 0.95, breach: Column | None = None, open_: Column | None = None) -> DataFrame:
    no = F.lit(False)
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select("scope", item.cast("string").alias("item"), line.alias("line"), (F.lit(None) if cited is None else cited).cast("string").alias("cited"), sure.cast("double").alias("confidence"), (no if breach is None else breach).alias("breach"), (no if open_ is None else open_).alias("open"))


def answer(questions: DataFrame, instruments: DataFrame, portfolios: DataFrame, holdings: DataFrame, covenants: DataFrame, terms: DataFrame, facts: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, scopes, lines) of a log of questions(query_id, question).

    answers(query_id, intent, headline, n_lines, citations, confidence, refused); scopes(query_id, scope) and lines(scope,
    item, line, cited, ...) have the lines of each answer. Questions that ask the same of everything share one scope, so
    that its lines are worked out and kept once; a question that names something has a scope of its own.

    By intent: instruments strictly below the notch asked for, or those named, or all; exposure by portfolio, of those
    named, below the notch; covenants of the type asked for, of the instruments named; the rules' verdicts on the terms of
    the instruments named, or of all, where terms without facts are counted as open and not as compliant; search hits, also
    where no covenant is found. Structured answers are 0.95 sure (verdicts 0.4 if all are open), covenants as sure as the
    least of them, search 0.55; a refusal is 0 sure: advice, words that nothing here has, no rows, or nothing cited
    where citations are due.

    instruments(instrument_id, instrument_name, issuer_name, current_rating), portfolios(portfolio_id, name), holdings(
    portfolio_id, instrument_id, market_value), covenants(clause_id, instrument_id, covenant_type, source_quote, page_number,
    confidence), terms and facts as rules.evaluate takes them, terms with clause_id, hits(query_id, chunk_id, chunk_text)."""
    rated = saved(instruments.select("instrument_id", "instrument_name", "issuer_name", "current_rating", rank(F.col("current_rating")).alias("rank")))
    called = rated.select("instrument_id", F.explode(F.array("instrument_name", "issuer_name")).alias("name")).where("name is not null").distinct()
    names = called.select("name").union(portfolios.select("name")).distinct()
    asked = saved(unsupported_terms(classify(questions), names)).withColumn("_no", (F.col("intent") == "unsupported") | F.col("intent").isin(*STRUCTURED) & (F.size("unsupported") > 0))
    go = asked.where("not _no").select("query_id", "question", "intent", "covenant_type", "rating_below")
    named = saved(mentioned_entities(go, names))
    own_instruments = by_key(named).join(called, "name").select("query_id", "instrument_id").distinct()
    own_portfolios = by_key(named).join(portfolios.select("name", "portfolio_id"), "name").select("query_id", "portfolio_id").distinct()
    kind, below = F.col("intent"), F.col("rating_below")
    by_name = F.when(kind == "portfolio_query", F.col("_p")).when((kind == "document_search") | (kind == "instrument_lookup") & below.isNotNull(), F.lit(False)).otherwise(F.col("_i"))
    marks = own_instruments.select("query_id").distinct().withColumn("_i", F.lit(True)), own_portfolios.select("query_id").distinct().withColumn("_p", F.lit(True))
    scoped = go.join(by_key(marks[0]), "query_id", "left").join(by_key(marks[1]), "query_id", "left").withColumn("own", F.coalesce(by_name, F.lit(False)) | (kind == "document_search"))
    asked_for = F.when(kind == "covenant_lookup", F.col("covenant_type")).when(kind.isin("instrument_lookup", "portfolio_query"), below)
    scoped = saved(scoped.withColumn("scope", F.concat_ws("|", kind, F.coalesce(asked_for, F.lit(ALL)), F.when(F.col("own"), F.col("query_id").cast("string")).otherwise(ALL))))
    # kinds times thresholds, so a few dozen rows; all else is joined by key, since it grows with the book or the log
    shared = scoped.where("not own").select("scope", "intent", "covenant_type", "rating_below").distinct()
    mine = scoped.where("own").select("query_id", "scope", "intent", "covenant_type", "rating_below")
    of = lambda rows, what: rows.where(kind == what)
    everything = lambda rows, what: rows.withColumn("scope", F.lit(f"{what}||"))
    # a threshold becomes the ranks below it, so that joins are on equal ranks
    ranks = lambda rows: rows.where(below.isNotNull()).withColumn("rank", F.explode(F.sequence(rank(below) + 1, F.lit(len(NOTCHES)))))

    picked = by_key(mine).join(own_instruments, "query_id").drop("query_id")
    found = F.broadcast(ranks(of(shared, "instrument_lookup")).select("scope", "rank")).join(rated, "rank").select("scope", *rated.columns).unionByName(everything(rated, "instrument_lookup")).unionByName(of(picked, "instrument_lookup").select("scope", "instrument_id").join(by_key(rated), "instrument_id"))
    lines = _lines(found, F.col("instrument_id"), F.concat_ws(" ", "instrument_name", "current_rating"))

    # dealt by portfolio once: no sum below has to move rows again, over all notches there are many times as many
    held = holdings.join(by_key(rated.select("instrument_id", "rank")), "instrument_id").repartition("portfolio_id").groupBy("portfolio_id", "rank").agg(F.count("*").alias("n"), F.sum("market_value").alias("v"))
    whole = held.groupBy("portfolio_id").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    cut = F.broadcast(ranks(of(shared, "portfolio_query")).select("scope", "rank")).join(held, "rank").select("scope", "portfolio_id", "n", "v")
    mine_p = by_key(of(mine, "portfolio_query")).join(own_portfolios, "query_id").drop("query_id")
    cut = cut.unionByName(by_key(ranks(mine_p).select("scope", "portfolio_id", "rank")).join(held, ["portfolio_id", "rank"]).select("scope", "portfolio_id", "n", "v"))
    cut = cut.groupBy("scope", "portfolio_id").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    cut = cut.unionByName(everything(whole, "portfolio_query")).unionByName(by_key(mine_p.where(below.isNull()).select("scope", "portfolio_id")).join(whole, "portfolio_id"))
    lines = lines.unionByName(_lines(cut, F.col("portfolio_id"), F.concat_ws(" ", F.col("portfolio_id").cast("string"), F.col("n").cast("string"), F.coalesce("v", F.lit(0)).cast("decimal(30,4)").cast("string"))))

    have = covenants.select("clause_id", "instrument_id", "covenant_type", "source_quote", "page_number", "confidence")
    typed = F.broadcast(of(shared, "covenant_lookup").where("covenant_type is not null").select("scope", "covenant_type")).join(have, "covenant_type")
    chosen = of(picked, "covenant_lookup").select("scope", "instrument_id", F.col("covenant_type").alias("_t")).join(by_key(have), "instrument_id").where("_t is null or _t = covenant_type").drop("_t")
    cited = typed.unionByName(everything(have, "covenant_lookup")).unionByName(chosen)
    lines = lines.unionByName(_lines(cited, F.col("clause_id"), F.concat_ws(" p.", "source_quote", F.col("page_number").cast("string")), F.col("clause_id"), F.coalesce("confidence", F.lit(0.5))))

    judged = evaluate(terms.join(by_key(facts), "instrument_id", "left")).select("instrument_id", "clause_id", "covenant_type", "status", "explanation")
    judged = everything(judged, "covenant_breach_check").unionByName(by_key(of(picked, "covenant_breach_check").select("scope", "instrument_id")).join(judged, "instrument_id"))
    open_ = F.col("status") == "insufficient_data"
    lines = lines.unionByName(_lines(judged, F.concat_ws(" ", F.col("instrument_id").cast("string"), "covenant_type", F.coalesce(F.col("clause_id").cast("string"), F.lit(""))), F.col("explanation"), F.when(~open_, F.col("clause_id")), 0.95, F.col("status") == "breach", open_))

    passages = hits.join(by_key(scoped.where(kind.isin("document_search", "covenant_lookup")).select("query_id")), "query_id").withColumn("scope", F.concat_ws("|", F.lit("passages"), F.lit(ALL), F.col("query_id").cast("string")))
    lines = lines.unionByName(_lines(passages, F.col("chunk_id"), F.col("chunk_text"), F.col("chunk_id"), 0.55))

    lines = saved(lines)
    sums = lines.groupBy("scope").agg(F.count_if(~F.col("open")).alias("n_lines"), F.count_if("open").alias("n_open"), F.count_if("breach").alias("breaches"), F.count("cited").alias("citations"), F.min("confidence").alias("confidence"))
    passage = F.concat_ws("|", F.lit("passages"), F.lit(ALL), F.col("query_id").cast("string"))
    known = scoped.select("query_id", "intent", "rating_below", F.when(kind == "document_search", passage).otherwise(F.col("scope")).alias("scope")).join(by_key(sums), "scope", "left")
    # a covenant question that no covenant answers is searched for
    again = known.where((kind == "covenant_lookup") & F.col("n_lines").isNull()).select("query_id", "intent", "rating_below", passage.alias("scope")).join(by_key(sums), "scope", "left")
    known = known.where(~((kind == "covenant_lookup") & F.col("n_lines").isNull())).unionByName(again)
    n = F.coalesce("n_lines", F.lit(0))
    some = F.when(n.isNull(), False).otherwise((n > 0) | (F.coalesce("n_open", F.lit(0)) > 0))
    structured = kind.isin(*STRUCTURED)
    refused = ~some | ~structured & (F.coalesce("citations", F.lit(0)) == 0)
    rest = F.when(below.isNotNull(), F.concat(F.lit(" rated below "), below)).otherwise("")
    words = F.when(kind == "instrument_lookup", F.concat(n.cast("string"), F.lit(" instrument(s)"), F.when(below.isNotNull(), rest).otherwise(" matched"), F.lit("."))).when(kind == "portfolio_query", F.concat(n.cast("string"), F.lit(" portfolio(s)"), rest, F.lit("."))).when(kind == "covenant_breach_check", F.concat(F.when(F.col("breaches") > 0, F.col("breaches").cast("string")).otherwise("No"), F.lit(" covenant breach(es), "), F.coalesce("n_open", F.lit(0)).cast("string"), F.lit(" not evaluated."))).otherwise(F.concat(n.cast("string"), F.lit(" passage(s).")))
    sure = F.when((kind == "covenant_breach_check") & (n == 0), F.lit(0.4)).otherwise(F.col("confidence"))
    given = known.select("query_id", "scope", F.when(~refused, words).alias("headline"), n.alias("n_lines"), F.coalesce("citations", F.lit(0)).alias("citations"), F.when(refused, 0.0).otherwise(sure).alias("confidence"), refused.alias("refused"))
    answers = asked.select("query_id", "intent").join(by_key(given), "query_id", "left").select("query_id", "intent", "headline", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("refused", F.lit(True)).alias("refused"))
    return answers, given.where("not refused").select("query_id", "scope"), lines
