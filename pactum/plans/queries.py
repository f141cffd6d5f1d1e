"""Registered queries over the driver tables, each with SQL that computes the same by other means where SQL can.

Driver tables stand in for the product's by shape: part for instruments, orders and lineitem for holdings by month, documents
for pages, events for the spend ledger and log-ins, part again for covenant prose. Money is cast to decimals on read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import dates, text
from pactum.functions.ratings import NOTCHES, is_investment_grade, notches_between, rank
from pactum.operators import chunks, evaluation, extraction, ledger, portfolio, questions, retrieval, review, rules, verify
from pactum.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _item(values: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), place.cast("int") + 1)


_OTHER = [n if n in ("AAA", "D") else n.replace("+", "1") if "+" in n else n.replace("-", "3") if "-" in n else n + "2" for n in NOTCHES]
SQL_NOTCHES = "[" + ", ".join(f"'{n}'" for n in NOTCHES) + "]"
SQL_INST = f"inst AS (SELECT p_partkey AS instrument_id, p_brand AS issuer_name, p_name, p_size, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 22 AS INTEGER) END AS r, CAST((p_size * 5) % 22 AS INTEGER) AS t, {SQL_NOTCHES} AS ns FROM part)"
SQL_HOLD = "hold AS (SELECT o_custkey AS portfolio_id, l_partkey AS instrument_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of_date, CAST(l_extendedprice AS DECIMAL(20,4)) AS market_value FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """Parts as instruments, rated in either notation, decorated or not; every seventeenth unrated."""
    k = F.col("p_partkey")
    notch, other = _item(NOTCHES, k * 7 % 22), _item(_OTHER, k * 7 % 22)
    rating = F.when(k % 17 == 0, "NR").when(k % 4 == 0, notch).when(k % 4 == 1, other).when(k % 4 == 2, F.concat(notch, F.lit(" (s)"))).otherwise(F.concat(F.lower(notch), F.lit("  stable")))
    return tables.spread(table(spark, d, "part")).select(k.alias("instrument_id"), F.col("p_brand").alias("issuer_name"), F.col("p_name").alias("instrument_name"), rating.alias("current_rating"), F.lit("MARC").alias("rating_agency"), "p_size", F.col("p_retailprice").cast("decimal(20,4)").alias("issue_size"))


def triggers(spark: SparkSession, d: str) -> DataFrame:
    """A rating trigger for each instrument, twice: cited and not."""
    base = tables.spread(table(spark, d, "part")).select(F.col("p_partkey").alias("instrument_id"), _item(NOTCHES, F.col("p_size") * 5 % 22).alias("trigger_rating"), F.lit("MARC").alias("rating_agency"), F.lit("downgrade").alias("trigger_direction"), F.lit("medium").alias("severity"))
    both = base.withColumn("source_clause_id", F.explode(F.array(F.lit(None).cast("string"), F.concat(F.lit("c"), F.col("instrument_id").cast("string")))))
    return both.withColumn("trigger_rank", rank(F.col("trigger_rating")))


def holdings(spark: SparkSession, d: str) -> DataFrame:
    o, line = tables.read(spark, d, "orders", "lineitem")
    rows = o.select("o_orderkey", F.col("o_custkey").alias("portfolio_id"), F.trunc("o_orderdate", "month").alias("as_of_date")).join(line.select("l_orderkey", F.col("l_partkey").alias("instrument_id"), F.col("l_extendedprice").cast("decimal(20,4)").alias("market_value")), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("portfolio_id", "instrument_id", "as_of_date", "market_value")


def prose(spark: SparkSession, d: str) -> DataFrame:
    """A chunk of covenant prose for each part."""
    s, k = F.col("p_size"), F.col("p_partkey")
    words = F.concat(F.lit("The Issuer shall at all times maintain a consolidated gearing ratio of not more than "), F.floor(s / 10).cast("string"), F.lit("."), (s % 10).cast("string"), F.lit(" times. It is a cross default if indebtedness above RM"), s.cast("string"), F.lit(" million is unpaid for 14 days. The rating given by MARC is downgraded below "), _item(NOTCHES, s * 5 % 19), F.lit(" at any time. Redemption on 2028-06-"), F.lpad((s % 28 + 1).cast("string"), 2, "0"), F.lit(" 102.00 Optional ends here."))
    return tables.spread(table(spark, d, "part")).select(k.cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("ordinal"), words.alias("chunk_text"), F.concat(F.lit("h"), k.cast("string")).alias("hash"))


@query(f"""WITH {SQL_INST}, {SQL_HOLD}, held AS (SELECT DISTINCT portfolio_id, instrument_id FROM hold)
SELECT portfolio_id, CAST(count(*) FILTER (WHERE r > t) AS BIGINT) AS breaches, CAST(count(*) FILTER (WHERE r = t) AS BIGINT) AS at_risk, CAST(count(*) FILTER (WHERE r IS NULL) AS BIGINT) AS insufficient
FROM held JOIN inst USING (instrument_id) GROUP BY portfolio_id""")
def rating_trigger_board(spark, d):
    """Flagship: which holdings trip their rating trigger, by portfolio, worst first."""
    clauses = triggers(spark, d).where("source_clause_id is not null").select(F.col("source_clause_id").alias("clause_id"), F.lit("q").alias("source_quote"), F.lit(1).alias("page_number"))
    own = portfolio.triggers_with_clauses(triggers(spark, d), clauses).drop("rating_agency")
    rated = instruments(spark, d).select("instrument_id", "current_rating", "rating_agency")
    held = holdings(spark, d).select("portfolio_id", "instrument_id").distinct()
    terms = held.join(own, "instrument_id").join(rated, "instrument_id").withColumn("covenant_type", F.lit("rating_trigger"))
    return rules.breach_board(rules.evaluate(terms), "portfolio_id")


@query(f"WITH {SQL_INST} SELECT instrument_id, CASE WHEN r IS NULL THEN NULL ELSE ns[r + 1] END AS notch, r AS rating_rank, r <= 9 AS investment_grade FROM inst")
def ratings_normalised(spark, d):
    i = portfolio.enrich(instruments(spark, d))
    return i.select("instrument_id", F.col("current_notch").alias("notch"), F.col("current_rating_rank").alias("rating_rank"), is_investment_grade(F.col("current_rating")).alias("investment_grade"))


@query(f"WITH {SQL_INST} SELECT instrument_id, r - t AS distance, r > t AS is_below, r >= t AS at_or_below FROM inst")
def rating_distance(spark, d):
    i = instruments(spark, d).withColumn("trigger", _item(NOTCHES, F.col("p_size") * 5 % 22))
    a, b = F.col("current_rating"), F.col("trigger")
    return i.select("instrument_id", notches_between(a, b).alias("distance"), (rank(a) > rank(b)).alias("is_below"), (rank(a) >= rank(b)).alias("at_or_below"))


@query(f"WITH {SQL_INST} SELECT instrument_id FROM inst WHERE r IS NULL")
def rating_rejects(spark, d):
    return portfolio.rating_rejects(instruments(spark, d)).select("instrument_id")


@query(f"WITH {SQL_INST} SELECT instrument_id, r AS rating_rank FROM inst WHERE r > 5")
def rated_strictly_below(spark, d):
    return portfolio.rated_below(portfolio.enrich(instruments(spark, d)), "A").select("instrument_id", F.col("current_rating_rank").alias("rating_rank"))


@query(f"WITH {SQL_INST} SELECT instrument_id, r AS rating_rank FROM inst WHERE r >= 5")
def rated_at_or_below(spark, d):
    return portfolio.rated_at_or_below(portfolio.enrich(instruments(spark, d)), "A").select("instrument_id", F.col("current_rating_rank").alias("rating_rank"))


@query(f"WITH {SQL_INST} SELECT instrument_id, t AS trigger_rank FROM inst WHERE t <= 8")
def triggers_at_rank(spark, d):
    return portfolio.triggered_at(triggers(spark, d).where("source_clause_id is null"), "BBB").select("instrument_id", "trigger_rank")


@query("SELECT p_partkey AS instrument_id FROM part WHERE contains(lower(p_name), 'ring')")
def instruments_by_name(spark, d):
    return portfolio.find_instruments(instruments(spark, d), name="RING").select("instrument_id")


@query("""WITH x AS (SELECT o_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS d0, CAST(l_shipdate AS DATE) AS d1, CAST(o_orderkey % 15 AS INTEGER) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, l_linenumber, CASE WHEN k = 0 THEN d0 ELSE CAST([x for x in [d0 + CAST(i AS INTEGER) for i in range(1, 40)] if isodow(x) < 6][k] AS DATE) END AS due,
CAST(CASE WHEN d1 >= d0 THEN len([x for x in [d0 + CAST(i AS INTEGER) for i in range(1, 1 + date_diff('day', d0, d1))] if isodow(x) < 6]) ELSE -len([x for x in [d1 + CAST(i AS INTEGER) for i in range(1, 1 + date_diff('day', d1, d0))] if isodow(x) < 6]) END AS INTEGER) AS business_days,
d1 > CAST(d0 + 30 AS DATE) AS overdue, CAST(d0 + 14 AS DATE) AS grace_end, CAST(date_diff('day', d0, d1) AS INTEGER) AS days FROM x""")
def obligation_clocks(spark, d):
    o, line = tables.read(spark, d, "orders", "lineitem")
    x = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("d0"), F.to_date("l_shipdate").alias("d1"), (F.col("o_orderkey") % 15).cast("int").alias("k"))
    a, b = F.col("d0"), F.col("d1")
    return x.select("o_orderkey", "l_linenumber", dates.add_business_days(a, F.col("k")).alias("due"), dates.business_days_between(a, b).alias("business_days"), dates.is_overdue(dates.grace_period_end(a, F.lit(30)), b).alias("overdue"), dates.grace_period_end(a, F.lit(14)).alias("grace_end"), dates.days_until(b, a).alias("days"))


@query("SELECT l_partkey AS instrument_id, CAST(min(l_shipdate) FILTER (WHERE l_shipdate >= DATE '1999-06-16') AS DATE) AS next_call FROM lineitem GROUP BY 1")
def next_call_dates(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_partkey").alias("instrument_id"), F.to_date("l_shipdate").alias("call_date"))
    return portfolio.next_calls(calls, "1999-06-16")


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS call_date FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'")
def calls_in_range(spark, d):
    calls = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("call_date"))
    return portfolio.calls_between(calls, "1998-01-01", "1998-03-31")


@query("""SELECT p_partkey AS instrument_id, 'MYR' AS currency, CAST(p_size * 1000000 AS DECIMAL(20,4)) AS amount, 12 AS char_start FROM part
UNION ALL SELECT p_partkey, 'USD', CAST(p_partkey + 1000 AS DECIMAL(20,4)), CAST(12 + 2 + length(CAST(p_size AS VARCHAR)) + length(' juta or ') AS INTEGER) FROM part""")
def money_mentions(spark, d):
    words = F.concat(F.lit("Facility of RM"), F.col("p_size").cast("string"), F.lit(" juta or US$"), F.format_number(F.col("p_partkey") + 1000, 0), F.lit(" within 14 days"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(text.money_mentions(words)).alias("m"))
    return rows.select(F.col("p_partkey").alias("instrument_id"), "m.currency", "m.amount", F.col("m.start").alias("char_start"))


@query("SELECT p_partkey AS instrument_id, CAST(greatest(p_size * 1000, p_partkey) AS DECIMAL(20,4)) AS amount, CASE WHEN p_size * 1000 >= p_partkey THEN 'MYR' ELSE 'USD' END AS currency FROM part")
def largest_amount(spark, d):
    words = F.concat(F.lit("of RM "), F.col("p_size").cast("string"), F.lit(" thousand (USD "), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"), text.largest_money(words).alias("m")).select("instrument_id", "m.amount", "m.currency")


PAGES_SQL = "pages_ AS (SELECT doc_id, source, length(text) AS n, doc_id % 13 <> 0 AS layer, (doc_id % 10) / 10.0 AS ratio, doc_id % 15 = 0 AS failed FROM documents), scored AS (SELECT *, (CASE WHEN NOT layer THEN 1.0 ELSE 0 END) + (CASE WHEN n < 120 THEN 0.4 ELSE 0 END) + (CASE WHEN ratio > 0.7 THEN 0.3 ELSE 0 END) + (CASE WHEN failed THEN 0.15 ELSE 0 END) AS cost FROM pages_)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return tables.spread(table(spark, d, "documents")).select(F.col("source").alias("document_id"), k.alias("page_number"), "text", (k % 10 / 10.0).alias("image_area_ratio"), (k % 13 != 0).alias("has_text_layer"), (k % 3 == 0).alias("has_table_hint"), (k % 5 == 0).alias("table_extraction_failed"))


@query(f"WITH {PAGES_SQL} SELECT doc_id AS page_number, round(greatest(0.0, 1 - cost), 6) AS confidence, cost > 0 AS needs_vlm, concat_ws(',', CASE WHEN NOT layer THEN 'no_text_layer' END, CASE WHEN n < 120 THEN 'low_char_count' END, CASE WHEN ratio > 0.7 THEN 'high_image_area' END, CASE WHEN failed THEN 'table_extraction_failed' END) AS reasons FROM scored")
def page_quality(spark, d):
    return chunks.assess_pages(pages(spark, d)).select("page_number", F.round("confidence", 6).alias("confidence"), "needs_vlm", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {PAGES_SQL} SELECT source AS document_id, round(avg(greatest(0.0, 1 - cost)), 6) AS parse_confidence, count(*) FILTER (WHERE cost > 0) AS vision_pages, count(*) FILTER (WHERE cost > 0) > 20 AS over_cap FROM scored GROUP BY source")
def document_quality(spark, d):
    return chunks.document_quality(chunks.assess_pages(pages(spark, d)), 20).withColumn("parse_confidence", F.round("parse_confidence", 6))


_M, _E = ("[" + ", ".join(f"'{w}'" for w in words) + "]" for words in (text.MALAY, text.ENGLISH))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM documents),
v AS (SELECT doc_id, len([x for x in ws if list_contains({_M}, x)]) AS m, len([x for x in ws if list_contains({_E}, x)]) AS e FROM w)
SELECT doc_id, CASE WHEN m >= 2 AND m > e THEN 'ms' WHEN e >= 2 AND e > m THEN 'en' ELSE 'unknown' END AS language FROM v""")
def language_vote(spark, d):
    return tables.spread(table(spark, d, "documents")).select("doc_id", text.language(F.col("text")).alias("language"))


@query("""SELECT doc_id, CAST(CASE WHEN w = 0 THEN 0 ELSE greatest(n // 3, CAST(floor(w * 1.35) AS BIGINT), 1) END AS INTEGER) AS tokens, CAST(CASE WHEN w = 0 THEN 0 ELSE greatest(n // 3, CAST(floor(w * 1.35) AS BIGINT), 1) END * 3.0 / 1000000 AS DECIMAL(12,6)) AS cost_usd
FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents)""")
def token_costs(spark, d):
    calls = tables.spread(table(spark, d, "documents")).select("doc_id", F.lit("m").alias("model_id"), text.token_estimate(F.col("text")).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))
    prices = calls.limit(0).select("model_id").union(calls.select("model_id").distinct()).withColumns({"input_usd": F.lit("3.0").cast("decimal(10,4)"), "output_usd": F.lit("15.0").cast("decimal(10,4)")})
    return ledger.price(calls, prices)[0].select("doc_id", F.col("prompt_tokens").alias("tokens"), "cost_usd")


@query("SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents")
def content_dedup(spark, d):
    return tables.first_of_content(table(spark, d, "documents"), "text", ("doc_id",)).select("doc_id", "sha256", "duplicate")


@query()
def document_chunks(spark, d):
    """Chunks of every document; SQL cannot express the greedy splits, tests hold them against a plain loop."""
    docs = tables.spread(table(spark, d, "documents")).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    return chunks.chunk(docs)


@query("SELECT CAST(0 AS BIGINT) AS violations")
def chunk_span_check(spark, d):
    """Chunks that are no slice of their page: there must be none."""
    docs = tables.spread(table(spark, d, "documents")).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")
    return chunks.span_violations(chunks.chunk(docs), docs).agg(F.count("*").alias("violations"))


@query(f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS document_id, p_size AS s, {SQL_NOTCHES} AS ns FROM part)
SELECT document_id, 'gearing_ratio_en' AS pattern_id, 'lte' AS operator, CAST(s / 10.0 AS DECIMAL(12,6)) AS threshold_ratio, CAST(NULL AS DECIMAL(20,4)) AS threshold_amount, CAST(NULL AS VARCHAR) AS trigger_rating, CAST(NULL AS VARCHAR) AS rating_agency, 'medium' AS severity FROM p
UNION ALL SELECT document_id, 'cross_default_en', NULL, NULL, CAST(s * 1000000 AS DECIMAL(20,4)), NULL, NULL, 'high' FROM p
UNION ALL SELECT document_id, 'rating_trigger_en', NULL, NULL, NULL, ns[CAST((s * 5) % 19 AS INTEGER) + 1], 'MARC', 'high' FROM p""")
def covenant_extraction(spark, d):
    return extraction.extract(prose(spark, d)).select("document_id", "pattern_id", "operator", "threshold_ratio", "threshold_amount", "trigger_rating", "rating_agency", "severity")


@query("SELECT CAST(p_partkey AS VARCHAR) AS document_id, make_date(2028, 6, CAST(p_size % 28 + 1 AS INTEGER)) AS call_date, CAST(102 AS DECIMAL(12,6)) AS call_price, 'optional' AS call_type FROM part")
def call_schedules(spark, d):
    return extraction.call_schedule(prose(spark, d)).select("document_id", "call_date", "call_price", "call_type")


@query("SELECT CAST(p_partkey AS VARCHAR) AS document_id, 'MARC' AS agency FROM part")
def document_agencies(spark, d):
    return extraction.document_agency(prose(spark, d))


@query("""WITH s AS (SELECT l_orderkey AS k, greatest(CAST(l_quantity * 100 AS BIGINT) - 150, 0) AS a, least(CAST(l_quantity * 100 AS BIGINT) + 60 + 150, 5000) AS b, l_returnflag AS h FROM lineitem),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT k AS l_orderkey, min(a) AS span_start, max(b) AS span_end, array_to_string(list_sort(list(DISTINCT h)), ',') AS hints FROM g GROUP BY k, i""")
def merged_spans(spark, d):
    at = (F.col("l_quantity") * 100).cast("long")
    spans = table(spark, d, "lineitem").select("l_orderkey", F.lit(5000).cast("long").alias("length"), at.alias("start"), (at + 60).alias("end"), F.col("l_returnflag").alias("hint"))
    return extraction.merge_spans(spans, "l_orderkey", 150).select("l_orderkey", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.array_join("hints", ",").alias("hints"))


@query(f"WITH {SQL_HOLD} SELECT portfolio_id, count(*) AS positions, CAST(coalesce(sum(market_value), 0) AS DECIMAL(30,4)) AS exposure, CAST(sum(market_value) AS DECIMAL(30,4)) AS total FROM hold GROUP BY portfolio_id")
def portfolio_exposure(spark, d):
    return portfolio.exposure(holdings(spark, d))


@query(f"WITH {SQL_HOLD}, m AS (SELECT *, max(as_of_date) OVER (PARTITION BY portfolio_id) AS last FROM hold) SELECT portfolio_id, count(*) AS positions, CAST(coalesce(sum(market_value), 0) AS DECIMAL(30,4)) AS exposure, CAST(sum(market_value) AS DECIMAL(30,4)) AS total FROM m WHERE as_of_date = last GROUP BY portfolio_id")
def latest_exposure(spark, d):
    return portfolio.exposure(portfolio.as_of_latest(holdings(spark, d)))


@query(f"WITH {SQL_INST}, {SQL_HOLD} SELECT portfolio_id, count(*) AS positions, CAST(coalesce(sum(market_value), 0) AS DECIMAL(30,4)) AS exposure, CAST(sum(market_value) AS DECIMAL(30,4)) AS total FROM hold JOIN inst USING (instrument_id) WHERE as_of_date = DATE '1998-03-01' AND r > 9 GROUP BY portfolio_id")
def exposure_below_notch(spark, d):
    return portfolio.exposure(portfolio.holdings_view(holdings(spark, d), portfolio.enrich(instruments(spark, d)), as_of="1998-03-01", rating_below="BBB-")[0])


@query(f"WITH {SQL_HOLD} SELECT instrument_id, count(*) AS holdings FROM hold WHERE instrument_id % 5 = 0 AND as_of_date = DATE '1998-03-01' GROUP BY instrument_id")
def holdings_without_instrument(spark, d):
    known = instruments(spark, d).where("instrument_id % 5 <> 0")
    return portfolio.holdings_view(holdings(spark, d), known, as_of="1998-03-01")[1].groupBy("instrument_id").agg(F.count("*").alias("holdings"))


@query("SELECT p_partkey AS covenant_id, CAST(p_retailprice AS DECIMAL(20,4)) AS threshold_amount FROM part WHERE p_size % 2 = 0 AND CAST(p_retailprice AS DECIMAL(20,4)) < 1000 ORDER BY 2, 1 LIMIT 100")
def covenants_below_threshold(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("covenant_id"), F.when(F.col("p_size") % 2 == 0, "cross_default").otherwise("other").alias("covenant_type"), F.lit("MYR").alias("threshold_currency"), F.col("p_retailprice").cast("decimal(20,4)").alias("threshold_amount"))
    return portfolio.below_threshold(rows, "cross_default", "1000", "MYR").select("covenant_id", "threshold_amount")


RULES_SQL = """f AS (SELECT l_partkey AS k, CAST(avg(l_quantity) / 10 AS DECIMAL(12,6)) AS ratio, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS DECIMAL(20,4)) AS amount FROM lineitem GROUP BY 1),
x AS (SELECT p_partkey AS k, p_partkey % 5 AS kind, p_size, CAST(p_size / 10.0 AS DECIMAL(12,6)) AS tr, CAST(p_size * 30000 AS DECIMAL(20,4)) AS ta, ratio, amount, p_partkey % 3 AS cur FROM part LEFT JOIN f ON k = p_partkey)"""


@query(f"""WITH {RULES_SQL},
h AS (SELECT *, CASE kind WHEN 0 THEN tr - ratio WHEN 1 THEN ratio - tr WHEN 2 THEN (CASE WHEN cur = 0 THEN NULL ELSE amount - ta END) WHEN 3 THEN ta - amount ELSE ta - amount END AS room, CASE WHEN kind < 2 THEN tr ELSE ta END AS base FROM x)
SELECT k AS instrument_id, CASE WHEN room IS NULL THEN 'insufficient_data' WHEN room < 0 OR (kind = 4 AND room = 0) THEN 'breach' WHEN room <= base * 0.05 THEN 'at_risk' ELSE 'ok' END AS status, CAST(room AS DECIMAL(26,6)) AS headroom FROM h""")
def numeric_covenants(spark, d):
    """Ratios, net worth with its currency, caps and cross default on facts from line items."""
    facts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("instrument_id")).agg((F.avg("l_quantity") / 10).cast("decimal(12,6)").alias("ratio"), F.sum(F.col("l_extendedprice").cast("decimal(20,4)")).cast("decimal(20,4)").alias("amount"))
    k = F.col("p_partkey")
    terms = table(spark, d, "part").select(k.alias("instrument_id"), _item(["gearing_ratio", "interest_cover", "minimum_net_worth", "disposal_restriction", "cross_default"], k % 5).alias("covenant_type"), F.when(k % 5 < 2, (F.col("p_size") / 10).cast("decimal(12,6)")).alias("threshold_ratio"), F.when(k % 5 >= 2, (F.col("p_size") * 30000).cast("decimal(20,4)")).alias("threshold_amount"), F.when(k % 3 == 0, "USD").otherwise("MYR").alias("threshold_currency"), F.lit("medium").alias("severity"))
    own = terms.join(facts, "instrument_id", "left").withColumns({"gearing_ratio": F.col("ratio"), "interest_cover": F.col("ratio"), "net_worth": F.col("amount"), "disposals_value": F.col("amount"), "accelerated_indebtedness": F.col("amount"), "currency": F.lit("MYR")})
    return rules.evaluate(own).select("instrument_id", "status", "headroom")


@query("""SELECT p_partkey AS instrument_id, CASE p_partkey % 4 WHEN 0 THEN (CASE WHEN p_size % 3 = 0 THEN 'insufficient_data' WHEN p_size % 3 = 1 OR p_size % 2 = 0 THEN 'ok' ELSE 'breach' END)
WHEN 1 THEN (CASE WHEN p_size % 3 = 0 THEN 'insufficient_data' WHEN p_size % 3 = 1 THEN 'breach' ELSE 'ok' END) WHEN 2 THEN (CASE WHEN p_size % 3 = 0 THEN 'insufficient_data' WHEN p_size % 3 = 1 THEN 'ok' ELSE 'breach' END) ELSE 'not_applicable' END AS status,
CASE WHEN p_partkey % 4 = 0 AND p_size % 3 = 2 AND p_size % 2 = 1 THEN 'high' WHEN p_partkey % 4 = 1 AND p_size % 3 = 1 THEN 'critical' WHEN p_partkey % 4 = 2 AND p_size % 3 = 2 THEN 'high' ELSE 'medium' END AS severity FROM part""")
def event_covenants(spark, d):
    """Negative pledge, Shariah compliance, change of control and others, on flags that may be missing."""
    k, s = F.col("p_partkey"), F.col("p_size")
    flag = F.when(s % 3 == 1, False).when(s % 3 == 2, True)
    rows = table(spark, d, "part").select(k.alias("instrument_id"), _item(["negative_pledge", "shariah_non_compliance", "change_of_control", "other"], k % 4).alias("covenant_type"), F.lit("medium").alias("severity"), flag.alias("security_created"), (s % 2 == 0).alias("security_is_permitted"), flag.alias("shariah_compliant"), flag.alias("change_of_control"))
    return rules.evaluate(rows).select("instrument_id", "status", "severity")


TOKENS = "regexp_extract_all(lower(text), '[0-9a-z]+')"


@query(f"""WITH d AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), i AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY 1, 2), q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(tf) AS BIGINT) AS hits FROM i JOIN q USING (w) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id AS query_id, doc_id AS chunk_id, CAST(hits / 10.0 AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def keyword_search(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    index = retrieval.postings(tables.spread(table(spark, d, "documents")), "doc_id", "text", retrieval.asked_terms(asked).select("fts_config", "lexeme").distinct())
    return retrieval.keyword_top(index, asked)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def vector_search(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("m").alias("model"))
    asked = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "model")
    return retrieval.vector_top(v, asked).select("query_id", "chunk_id", "rank")


FUSE_SQL = """t AS (SELECT event_type AS q, user_id AS u, count(*) AS n, max(value) AS m FROM events GROUP BY 1, 2), l AS (SELECT q, u, row_number() OVER (PARTITION BY q ORDER BY n DESC, u) AS a, row_number() OVER (PARTITION BY q ORDER BY m DESC, u) AS b FROM t),
s AS (SELECT q, u, (CASE WHEN a <= 40 THEN 1.0 / (60 + a) ELSE 0 END) + (CASE WHEN b <= 40 THEN 1.0 / (60 + b) ELSE 0 END) AS x FROM l WHERE a <= 40 OR b <= 40), f AS (SELECT q, u, CAST(row_number() OVER (PARTITION BY q ORDER BY round(x, 12) DESC, u) AS INTEGER) AS rank FROM s)"""


def _fused(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("chunk_id")).agg(F.count("*").alias("n"), F.max("value").alias("m"))
    legs = [retrieval._top(t.select("query_id", "chunk_id", F.col(c).alias("score")), 40) for c in ("n", "m")]
    return retrieval.fuse(legs, 10)


@query(f"WITH {FUSE_SQL} SELECT q AS query_id, u AS chunk_id, rank FROM f WHERE rank <= 10")
def rank_fusion(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "rank")


@query(f"WITH {FUSE_SQL}, e AS (SELECT DISTINCT event_type AS q, user_id AS u FROM events WHERE user_id % 7 = 0), m AS (SELECT e.q, min(rank) FILTER (WHERE rank <= 10) AS k FROM e LEFT JOIN f ON e.q = f.q AND e.u = f.u GROUP BY 1) SELECT round(avg(coalesce(1.0 / k, 0)), 9) AS mrr, count(*) AS queries FROM m")
def retrieval_mrr(spark, d):
    relevant = table(spark, d, "events").where("user_id % 7 = 0").select(F.col("event_type").alias("query_id"), F.col("user_id").alias("chunk_id")).distinct()
    return retrieval.mean_reciprocal_rank(_fused(spark, d), relevant).withColumn("mrr", F.round("mrr", 9))


def calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("call_id"), "ts", F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.when(k % 4 == 0, F.lit(0)).otherwise(F.col("value")).cast("decimal(12,6)").alias("cost_usd"), (k % 4 == 0).alias("cache_hit"), (k % 7 * 100).cast("int").alias("cache_read_tokens"), F.col("value").cast("decimal(12,6)").alias("estimate"), "props")


CALLS_SQL = "c AS (SELECT event_id AS id, ts, user_id AS doc, event_type AS stage, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS DECIMAL(12,6)) AS cost, CAST(value AS DECIMAL(12,6)) AS est, event_id % 4 = 0 AS hit, event_id % 7 * 100 AS cached, props FROM events)"


@query(f"""WITH {CALLS_SQL} SELECT CAST(NULL AS BIGINT) AS document_id, CAST(NULL AS VARCHAR) AS stage, CAST(sum(cost) AS DECIMAL(20,6)) AS cost FROM c
UNION ALL SELECT doc, NULL, CAST(sum(cost) AS DECIMAL(20,6)) FROM c GROUP BY doc UNION ALL SELECT NULL, stage, CAST(sum(cost) AS DECIMAL(20,6)) FROM c GROUP BY stage""")
def spend_totals(spark, d):
    return ledger.spend(calls(spark, d)).select("document_id", "stage", "cost")


@query(f"""WITH {CALLS_SQL} SELECT doc AS document_id, count(*) AS calls, count(*) FILTER (WHERE hit) AS cache_hits, CAST(sum(cached) AS BIGINT) AS cache_read_tokens, CAST(sum(cost) AS DECIMAL(20,6)) AS cost,
CASE WHEN doc % 3 = 0 THEN '(deleted)' ELSE 'Customer#' || lpad(CAST(doc AS VARCHAR), 9, '0') END AS filename, round(count(*) FILTER (WHERE hit) / count(*), 9) AS hit_rate, sum(cost) > 1000 AS over_cap FROM c GROUP BY doc""")
def spend_by_document(spark, d):
    docs = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    return ledger.spend_report(calls(spark, d), docs, "1000").withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"""WITH {CALLS_SQL}, r AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, coalesce(sum(cost) OVER (PARTITION BY doc ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dd FROM c)
SELECT id AS call_id, CAST(g AS DECIMAL(20,6)) AS spent_before, CAST(dd AS DECIMAL(20,6)) AS document_before, CASE WHEN est > 90 THEN 'call' WHEN g + est > 150000 THEN 'total' WHEN dd + est > 900 THEN 'document' ELSE 'admitted' END AS verdict FROM r""")
def budget_audit(spark, d):
    return ledger.budget_audit(calls(spark, d), "90", "150000", "900").select("call_id", "spent_before", "document_before", "verdict")


@query(f"WITH {CALLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stage, props ORDER BY ts, id) AS k FROM c) SELECT id AS call_id, k > 1 AS replayed, CAST(CASE WHEN k > 1 THEN cost ELSE 0 END AS DECIMAL(20,6)) AS saved FROM r")
def cache_replay(spark, d):
    return ledger.cache_replay(calls(spark, d), ["stage", "props"]).select("call_id", "replayed", "saved")


@query("""WITH e AS (SELECT event_id, ts, user_id, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')),
r AS (SELECT a.event_id, a.user_id, a.ts, count(b.event_id) AS failures FROM e a JOIN e b ON b.user_id = a.user_id AND NOT b.ok AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2880 MINUTE AND NOT EXISTS (SELECT 1 FROM e s WHERE s.user_id = a.user_id AND s.ok AND s.ts > b.ts AND s.ts <= a.ts) WHERE NOT a.ok GROUP BY 1, 2, 3)
SELECT event_id, failures, CASE WHEN failures >= 3 THEN least(300.0, power(2.0, failures - 3)) ELSE 0.0 END AS delay FROM r""")
def failure_streaks(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'purchase')").select("event_id", "ts", "user_id", (F.col("event_type") == "purchase").alias("succeeded"))
    return ledger.failure_streaks(e, "user_id", 2880).select("event_id", "failures", "delay")


@query("SELECT p_brand AS document_id, count(*) AS candidates, CAST(sum(1000 + p_size * 100) AS BIGINT) AS prompt_tokens, CAST((sum(1000 + p_size * 100) * 5.0 + count(*) * 4096 * 25.0) / 1000000 AS DECIMAL(12,6)) AS ceiling, (sum(1000 + p_size * 100) * 5.0 + count(*) * 4096 * 25.0) / 1000000 > 9 AS over_cap FROM part GROUP BY 1")
def extraction_ceilings(spark, d):
    found = table(spark, d, "part").select(F.col("p_brand").alias("document_id"), (F.col("p_size") * 100).alias("tokens"))
    return ledger.extraction_ceiling(found, 1000, 4096, "5.0", "25.0", "9")


@query("""WITH x AS (SELECT d.lang, l.quality AS want, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END AS given FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE want = 1 AND given = 1) AS tp, count(*) FILTER (WHERE want = 0 AND given = 1) AS fp, count(*) FILTER (WHERE want = 1 AND given = 0) AS fn FROM x GROUP BY ROLLUP (lang))
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM c""")
def precision_recall(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("given", F.col("n_chars") > 600)
    counts = x.groupBy("lang").agg(F.count_if(F.expr("quality = 1 and given")).alias("tp"), F.count_if(F.expr("quality = 0 and given")).alias("fp"), F.count_if(F.expr("quality = 1 and not given")).alias("fn"))
    return evaluation.totals(counts, "lang").select("lang", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""WITH p AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(20,4)) END AS w, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice * (1 + (o_orderkey % 3) * 0.004) AS DECIMAL(20,4)) END AS g FROM orders),
m AS (SELECT w, g, w IS NOT NULL AND g IS NOT NULL AND abs(w - g) <= greatest(w, g) * 0.005 AS ok FROM p)
SELECT 'threshold_amount' AS field, count(*) FILTER (WHERE ok) AS tp, count(*) FILTER (WHERE g IS NOT NULL AND NOT ok) AS fp, count(*) FILTER (WHERE w IS NOT NULL AND NOT ok) AS fn FROM m""")
def field_scores(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    pairs = table(spark, d, "orders").select(F.when(k % 9 != 0, price.cast("decimal(20,4)")).alias("label_threshold_amount"), F.when(k % 11 != 0, (price * (1 + k % 3 * F.lit(0.004))).cast("decimal(20,4)")).alias("prediction_threshold_amount"))
    return evaluation.field_scores(pairs, {"threshold_amount": "number"})


@query("SELECT doc_id, 'missing' AS problem FROM labels WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def corpus_completeness(spark, d):
    return evaluation.completeness(table(spark, d, "labels"), table(spark, d, "documents").where("doc_id % 2 = 0"), "doc_id")


@query("SELECT d.lang AS language, count(*) FILTER (WHERE l.quality = 1) AS found, count(*) AS labels, round(count(*) FILTER (WHERE l.quality = 1) / count(*), 9) AS recall FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def recall_by_language(spark, d):
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("language")), "doc_id").withColumnRenamed("doc_id", "label_id")
    return evaluation.recall_by_language(own, own.where("quality = 1")).withColumn("recall", F.round("recall", 9))


@query("""SELECT l_orderkey, l_linenumber, 'discount_range' AS rule FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT l_orderkey, l_linenumber, 'ships_after_1996' FROM lineitem WHERE l_shipdate < DATE '1996-01-01'""")
def row_violations(spark, d):
    rows = table(spark, d, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return review.violations(rows, {"discount_range": "l_discount <= 0.09", "ships_after_1996": "l_shipdate >= date '1996-01-01'"}, "id").select("id.l_orderkey", "id.l_linenumber", "rule")


@query("SELECT l_partkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return review.duplicates(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT DISTINCT event_type AS value, 'undeclared' AS problem FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'refund') UNION ALL SELECT 'refund', 'unused'")
def vocabulary_drift(spark, d):
    return review.vocabulary_drift(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "refund"])


@query("SELECT o_orderkey AS review_id FROM orders WHERE o_custkey % 2 = 1")
def orphan_reviews(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("covenant").alias("entity_type"), F.col("o_custkey").alias("entity_id"))
    return review.orphans(rows, {"covenant": table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"))}).select("review_id")


@query("""WITH d AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END AS decision, l_linestatus || l_linenumber || '-' || l_suppkey AS who, l_shipdate AS at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linestatus || l_linenumber || '-' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END) AS k FROM lineitem)
SELECT o_orderkey AS review_id, CASE WHEN o_orderstatus = 'P' AND d.id IS NOT NULL THEN d.decision WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'approved' END AS status FROM orders LEFT JOIN d ON d.id = o_orderkey AND d.k = 1""")
def review_decisions(spark, d):
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("covenant").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.lit("a").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"))
    made = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("decision"), F.lit(None).cast("string").alias("new_value"), F.concat("l_linestatus", F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("reviewer"), F.col("l_shipdate").alias("decided_at"))
    return review.apply_decisions(reviews, made)[0].select("review_id", "status")


@query("SELECT o_orderkey AS review_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def review_queue(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"), F.col("o_orderdate").alias("created_at"))
    return review.pending(rows, 50, 100).select("review_id")


@query("SELECT o_custkey AS document_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS page FROM orders GROUP BY 1")
def upserted_pages(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return tables.upsert(rows.where("page % 2 = 0"), rows.where("page % 2 = 1"), ["document_id"], "at").select("document_id", "page")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def appended_chunks(spark, d):
    new = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return tables.only_new(new, table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), ["k"])


@query("SELECT c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '5-LOW')")
def work_still_to_do(spark, d):
    rest = {"prompt_version": F.lit("v1"), "model_id": F.lit(None).cast("string"), "extractor_version": F.lit("e1")}
    work = table(spark, d, "customer").select(F.col("c_custkey").alias("document_sha256"), F.lit("5-LOW").alias("job_type")).withColumns(rest)
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("document_sha256"), F.col("o_orderpriority").alias("job_type"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status")).withColumns(rest)
    return tables.still_to_do(work, jobs).select(F.col("document_sha256").alias("id"))


ASKED = ["Should we buy {}?", "Is {} in breach?", "What is our exposure to {}?", "What is the gearing limit of {}?", "When is the maturity of {} rated below BBB+?", "Summarise {}"]
ASKED_SQL = "(CASE p_partkey % 6 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'covenant_breach_check' WHEN 2 THEN 'portfolio_query' WHEN 3 THEN 'covenant_lookup' WHEN 4 THEN 'instrument_lookup' ELSE 'document_search' END)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("query_id"), F.replace(_item(ASKED, k % 6), F.lit("{}"), F.col("p_name")).alias("question"))


@query(f"SELECT p_partkey AS query_id, {ASKED_SQL} AS intent, CASE WHEN p_partkey % 6 = 3 THEN 'gearing_ratio' END AS covenant_type, CASE WHEN p_partkey % 6 = 4 THEN 'BBB+' END AS rating_below FROM part")
def question_intents(spark, d):
    return questions.classify(asked(spark, d)).select("query_id", "intent", "covenant_type", "rating_below")


@query("""WITH w AS (SELECT p_partkey, [x for x in list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) if length(x) >= 2] AS own, CASE p_partkey % 6 WHEN 0 THEN ['should', 'buy'] WHEN 1 THEN [] WHEN 2 THEN [] WHEN 3 THEN ['limit'] WHEN 4 THEN [] ELSE ['summarise'] END AS base FROM part),
n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS x FROM part WHERE p_size > 49), o AS (SELECT p_partkey, unnest(own) AS x FROM w), c AS (SELECT p_partkey, count(*) AS k FROM o WHERE x NOT IN (SELECT x FROM n) GROUP BY 1)
SELECT w.p_partkey AS query_id, CAST(len(base) + coalesce(k, 0) AS INTEGER) AS unknown FROM w LEFT JOIN c ON c.p_partkey = w.p_partkey""")
def unknown_words(spark, d):
    names = table(spark, d, "part").where("p_size > 49").select(F.col("p_name").alias("name"))
    found = questions.unsupported_terms(asked(spark, d), names, ["breach", "exposure", "maturity", "gearing"])
    return found.select("query_id", F.size("unsupported").alias("unknown"))


@query("SELECT n_nationkey AS query_id, c_name AS name FROM customer JOIN nation ON n_nationkey = c_custkey")
def named_entities(spark, d):
    own = table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    rows = own.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id")), F.col("query_id") == F.col("c_custkey"))
    return questions.mentioned_entities(rows.select("query_id", F.concat(F.lit("what does "), F.col("name"), F.lit(" owe")).alias("question")), own.select("name"))


@query("SELECT doc_id AS document_id, doc_id AS instrument_id FROM documents WHERE doc_id % 3 > 0 AND doc_id IN (SELECT p_partkey FROM part)")
def issuer_links(spark, d):
    k = F.col("doc_id")
    inside = F.when(k % 3 == 1, F.lit("aboutNo")).otherwise("Issuer\n  No")
    head = table(spark, d, "documents").select(k.alias("document_id"), F.lit(0).alias("ordinal"), F.concat_ws(" ", "text", F.when(k % 3 > 0, F.concat(inside, k.cast("string"), F.lit("x  BERHAD"), F.when(k % 3 == 1, "s").otherwise(" .")))).alias("chunk_text"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"), F.concat(F.lit("No"), F.col("p_partkey").cast("string"), F.lit("x Berhad")).alias("issuer_name"))
    return portfolio.link_issuers(head, names)


@query("""SELECT item_id, CASE WHEN item_id % 3 = 2 THEN 'not_found' WHEN item_id % 3 = 1 THEN 'normalised' ELSE 'exact' END AS method, CASE WHEN item_id % 3 < 2 THEN 7 END AS char_start FROM benchmark""")
def quote_checks(spark, d):
    k, quote = F.col("item_id"), F.col("text")
    changed = F.when(k % 3 == 1, F.replace(quote, F.lit(" "), F.lit("  "))).when(k % 3 == 2, F.concat(quote, F.lit(" never said"))).otherwise(quote)
    return verify.verify(table(spark, d, "benchmark").select("item_id", changed.alias("quote"), F.concat(F.lit("Before "), quote, F.lit(" after")).alias("chunk_text")), ("exact", "normalised")).select("item_id", "method", "char_start")


@query(f"WITH {SQL_HOLD}, e AS (SELECT portfolio_id, CAST(sum(market_value) AS DECIMAL(30,4)) AS total FROM hold GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, portfolio_id) AS k FROM e) SELECT portfolio_id, total FROM r WHERE k > 50 AND k <= 100")
def exposure_page(spark, d):
    return portfolio.page_of(portfolio.exposure(holdings(spark, d)), [F.desc("total"), F.col("portfolio_id")], 2).select("portfolio_id", "total")


@query("""WITH a AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_size, p_partkey % 3 AS v FROM part) SELECT id AS record_id, v = 1 OR v = 2 AND p_size > 0 AS disagrees, CASE WHEN p_size >= 45 THEN 'high_value' WHEN v = 0 THEN 'low_confidence' ELSE 'rule_llm_disagreement' END AS trigger_reason FROM a""")
def model_reconciliation(spark, d):
    """Model records against the rules' extraction of the same chunk: agreeing, another number, another type; then review routing."""
    k, s = F.col("p_partkey"), F.col("p_size")
    found = extraction.extract(prose(spark, d)).where("pattern_id = 'cross_default_en'").select("hash", "char_start", "char_end", "covenant_type", "threshold_amount", "threshold_ratio", "operator")
    model = table(spark, d, "part").select(k.alias("record_id"), F.concat(F.lit("h"), k.cast("string")).alias("hash"), F.lit(60).alias("char_start"), F.lit(200).alias("char_end"), F.when(k % 3 == 1, "other").otherwise("cross_default").alias("covenant_type"), (s * 1_000_000 + F.when(k % 3 == 2, s * 20_000).otherwise(0)).cast("decimal(20,4)").alias("threshold_amount"), F.lit(None).cast("decimal(12,6)").alias("threshold_ratio"), F.lit(None).cast("string").alias("operator"))
    out = extraction.disagreements(extraction.match_rules(model, found)).withColumns({"threshold_amount": F.when(F.col("llm_record_id") > -1, F.col("rule_threshold_amount") * F.lit(100_000_001) / 45_000_000), "confidence": F.when(F.col("llm_record_id") % 3 == 0, 0.8).otherwise(0.9)})
    return extraction.review_trigger(out.withColumn("threshold_amount", F.col("threshold_amount").cast("decimal(28,4)"))).select(F.col("llm_record_id").alias("record_id"), "disagrees", "trigger_reason")


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN strlen(text) > 20000 THEN 'too large' WHEN left(text, 2) <> 'Th' THEN 'not the right format' ELSE 'accepted' END AS verdict FROM documents")
def admitted_files(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    good, bad = tables.admit(files, 20000, "Th")
    return good.select("doc_id", F.lit("accepted").alias("verdict")).union(bad.select("doc_id", "reason"))


@query("SELECT o_orderkey AS clause_id FROM orders WHERE NOT (o_orderstatus <> 'F' AND o_custkey % 3 = 0) UNION ALL SELECT -o_orderkey FROM orders WHERE o_custkey % 3 = 0")
def rerun_output(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("review_status"))
    again = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"))
    new = rows.join(again, "document_id", "left_semi").select((-F.col("clause_id")).alias("clause_id"), "document_id")
    return tables.replace_machine_output(rows, new, rows.select(F.col("clause_id").alias("entity_id"), F.lit("pending").alias("status")), again)[0].select("clause_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def filtered_page(spark, d):
    return portfolio.where_equal(table(spark, d, "orders"), ["o_orderkey"], 20, 40, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def rows_by_ids(spark, d):
    return portfolio.by_ids(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7 ORDER BY ts DESC, event_id LIMIT 100")
def audit_trail(spark, d):
    audit = table(spark, d, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("audit_id"))
    return review.trail(audit, "click", "7").select(F.col("audit_id").alias("event_id"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_queries(spark, d):
    return review.recent(table(spark, d, "events"), "ts", "event_id").select("event_id")


@query("SELECT l_orderkey, l_linenumber, o_orderkey IS NULL AS orphan FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0) o ON o_orderkey = l_orderkey")
def covenants_with_clauses(spark, d):
    covenants = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clause_id"), "l_linenumber")
    shown, missing = portfolio.with_clauses(covenants, table(spark, d, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("clause_id")))
    return shown.withColumn("orphan", F.lit(False)).union(missing.withColumn("orphan", F.lit(True))).select(F.col("clause_id").alias("l_orderkey"), "l_linenumber", "orphan")


@query("SELECT p_partkey AS instrument_id, coalesce(n, 0) AS calls, first_call, CAST(1 AS INTEGER) AS triggers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS first_call FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def instrument_details(spark, d):
    calls_ = table(spark, d, "lineitem").select(F.col("l_partkey").alias("instrument_id"), F.to_date("l_shipdate").alias("call_date"), F.lit(100).alias("call_price"), F.lit("optional").alias("call_type"))
    own = triggers(spark, d).where("source_clause_id is null")
    covenants = own.select("instrument_id", F.col("instrument_id").alias("covenant_id"), F.lit("rating_trigger").alias("covenant_type"))
    out = portfolio.instrument_detail(instruments(spark, d), calls_, own, covenants)
    return out.select("instrument_id", F.coalesce(F.nullif(F.size("calls"), F.lit(-1)), F.lit(0)).cast("bigint").alias("calls"), F.col("calls")[0]["call_date"].alias("first_call"), F.size("triggers").alias("triggers"))


@query("SELECT item_id AS clause_id, CASE WHEN item_id % 4 > 0 THEN 7 END AS quote_start, CASE WHEN item_id % 4 > 0 THEN CAST(7 + length(text) AS INTEGER) END AS quote_end FROM benchmark")
def clause_provenance(spark, d):
    b = table(spark, d, "benchmark")
    clauses = b.select(F.col("item_id").alias("clause_id"), F.col("item_id").alias("source_chunk_id"), F.col("text").alias("source_quote"))
    chunks_ = b.where("item_id % 4 > 0").select(F.col("item_id").alias("hash"), F.concat(F.lit("Before "), F.col("text")).alias("chunk_text"))
    return portfolio.provenance(clauses, chunks_, b.select(F.col("item_id").alias("clause_id"), F.lit("other").alias("covenant_type"))).select("clause_id", "quote_start", "quote_end")


@query("SELECT 'clause' AS kind, CAST(item_id AS VARCHAR) AS id, left(text, 600) AS quote FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT 'chunk', CAST(doc_id AS VARCHAR), left(text, 600) FROM documents WHERE doc_id % 50 = 1")
def cited_sources(spark, d):
    b, docs = tables.read(spark, d, "benchmark", "documents")
    clauses = b.select(F.col("item_id").cast("string").alias("clause_id"), F.col("text").alias("source_quote"))
    chunks_ = docs.select(F.col("doc_id").cast("string").alias("hash"), F.col("text").alias("chunk_text"))
    return portfolio.cite(clauses, chunks_, clauses.where("clause_id % 5 = 0"), chunks_.where("hash % 50 = 1").select(F.col("hash").alias("chunk_id")))


@query("WITH x AS (SELECT doc_id % 2 = 0 AS llm, doc_id % 10 = 0 AS bad FROM documents) SELECT count(*) FILTER (WHERE llm) AS llm, count(*) FILTER (WHERE llm AND bad) AS disagreements, round((count(*) FILTER (WHERE llm) - count(*) FILTER (WHERE llm AND bad)) / count(*) FILTER (WHERE llm), 9) AS agreement FROM x")
def extractor_agreement(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(k % 2 == 0, "llm").otherwise("rule").alias("method"), (k % 10 == 0).alias("disagrees"))
    return ledger.agreement(rows).withColumn("agreement", F.round("agreement", 9))


@query(f"""WITH w AS (SELECT source, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM documents), v AS (SELECT source, len([x for x in ws if list_contains({_M}, x)]) AS m, len([x for x in ws if list_contains({_E}, x)]) AS e FROM w),
l AS (SELECT source, CASE WHEN m >= 2 AND m > e THEN 'ms' WHEN e >= 2 AND e > m THEN 'en' END AS g FROM v) SELECT source AS document_id, CASE count(DISTINCT g) WHEN 0 THEN 'unknown' WHEN 1 THEN max(g) ELSE 'mixed' END AS language FROM l GROUP BY 1""")
def document_languages(spark, d):
    rows = tables.spread(table(spark, d, "documents")).select(F.col("source").alias("document_id"), text.language(F.col("text")).alias("language"))
    return chunks.document_language(rows)


@query("""WITH p AS (SELECT source, count(*) AS pages, count(*) FILTER (WHERE doc_id % 4 = 0) AS flagged FROM documents GROUP BY 1) SELECT source AS document_id, pages, flagged AS flagged_pages, pages AS chunks, flagged AS embedded, flagged = pages AS searchable FROM p""")
def pipeline_status(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("document_id"), (F.col("doc_id") % 4 == 0).alias("needs_vlm"), F.when(F.col("doc_id") % 4 == 0, F.lit(1.0)).alias("embedding"))
    jobs = docs.select("document_id", F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("created_at"))
    return review.document_status(docs.select("document_id").distinct(), docs, docs, jobs).select("document_id", "pages", "flagged_pages", "chunks", "embedded", "searchable")


@query("SELECT o_custkey AS k, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_totalprice > 300000) AS large FROM orders GROUP BY 1")
def backlog_counts(spark, d):
    return review.coverage(table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", pending=F.col("o_orderstatus") == "P", large=F.col("o_totalprice") > 300000)


@query("SELECT DISTINCT 'm' || CAST(label % 3 AS VARCHAR) AS model FROM embeddings WHERE label % 3 <> 1")
def model_mismatches(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"))
    return retrieval.model_mismatch(rows, "m1")


@query("""WITH h AS (SELECT o_custkey % 50 AS doc, o_orderpriority AS ex, CASE WHEN o_orderstatus = 'F' THEN 'fts' ELSE 'vector' END AS leg, o_orderkey AS c, o_totalprice / 100000 AS s FROM orders), f AS (SELECT * FROM h WHERE (leg = 'fts' AND s >= 1) OR (leg = 'vector' AND s >= 0.4)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, ex, leg ORDER BY s DESC, c) AS n FROM f), o AS (SELECT doc, c, max(s) AS s FROM k WHERE n <= 3 GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY s DESC, c) AS INTEGER) AS place FROM o) SELECT doc AS document_id, c AS chunk_id, place FROM r WHERE place <= 25""")
def semantic_candidates(spark, d):
    hits = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("document_id"), F.col("o_orderpriority").alias("exemplar"), F.when(F.col("o_orderstatus") == "F", "fts").otherwise("vector").alias("leg"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_totalprice") / 100000).alias("score"))
    return retrieval.semantic_candidates(hits).select("document_id", "chunk_id", "place")


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) SELECT doc_id AS chunk_id, count(DISTINCT w) AS lexemes, count(*) AS words FROM t GROUP BY 1")
def posting_sizes(spark, d):
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("chunk_id").agg(F.count("*").alias("lexemes"), F.sum("tf").alias("words"))


@query(f"WITH t AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents)) SELECT doc_id AS chunk_id, 1.0 AS norm FROM t")
def hashed_vectors(spark, d):
    """Hashed bag-of-words vectors have length 1."""
    v = retrieval.hashed_embedding(table(spark, d, "documents"), "doc_id", "text")
    return v.groupBy("chunk_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


@query("SELECT p_partkey AS record_id, CAST((p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT + (p_size % 7 = 0)::INT AS INTEGER) AS violations FROM part")
def model_record_checks(spark, d):
    s = F.col("p_size")
    payload = F.to_json(F.struct(F.when(s % 3 == 0, " ").otherwise("quote").alias("source_quote"), F.when(s % 5 == 0, F.lit(1.5)).otherwise(0.5).alias("confidence"), F.lit("10").alias("threshold_amount"), F.when(s % 7 != 0, "MYR").alias("threshold_currency")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), payload.alias("payload"))
    return extraction.validate_records(rows).select("record_id", F.size("violations").alias("violations"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 'clause' ELSE (CASE WHEN p_size % 4 = 1 THEN 'trigger' ELSE 'covenant' END) END AS kind FROM part WHERE p_size % 4 < 3")
def persisted_rows(spark, d):
    """What the gate lets through, by its last table: clauses without a covenant, covenants, triggers of linked instruments."""
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    rows = table(spark, d, "part").select(k.cast("string").alias("document_id"), F.lit("h").alias("hash"), F.lit("x").alias("clause_type"), F.when(s == 1, "rating_trigger").when(s == 2, "cross_default").alias("covenant_type"), F.lit(0).alias("char_start"), F.lit(0.9).alias("confidence"), F.lit(1).cast("decimal(20,4)").alias("threshold_amount"), (s < 3).alias("verified"), k.alias("instrument_id"), F.when(s == 1, "A").alias("trigger_rating"))
    out = extraction.persist_gate(rows)
    kinds = [out["clauses"].where("covenant_type is null").withColumn("kind", F.lit("clause")), out["covenants"].where("covenant_type <> 'rating_trigger'").withColumn("kind", F.lit("covenant")), out["rating_triggers"].withColumn("kind", F.lit("trigger"))]
    return kinds[0].union(kinds[1]).union(kinds[2]).select(F.col("instrument_id").alias("k"), "kind")


@query("SELECT count(*) FILTER (WHERE doc_id % 6 IN (1, 2, 5)) AS passed, count(*) AS questions, round(count(*) FILTER (WHERE doc_id % 6 = 2) / count(*) FILTER (WHERE doc_id % 6 IN (2, 3)), 9) AS refusal_precision, round(count(*) FILTER (WHERE doc_id % 6 = 2) / count(*) FILTER (WHERE doc_id % 2 = 0), 9) AS refusal_recall, round(count(*) FILTER (WHERE doc_id % 6 IN (0, 1, 4, 5) AND doc_id % 5 > 0) / count(*) FILTER (WHERE doc_id % 6 IN (0, 1, 4, 5)), 9) AS faithfulness FROM documents")
def answer_scores(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents")
    golden = rows.select(k.alias("question_id"), F.array(F.lit("yes")).alias("must_contain"), F.lit(1).alias("min_citations"), (k % 2 == 0).alias("expect_refusal"))
    given = rows.select(k.alias("question_id"), F.when(k % 3 == 0, "no").otherwise("oh Yes").alias("answer"), F.lit(2).alias("citations"), (k % 6).isin(2, 3).alias("refused"), (k % 5 > 0).alias("faithful"))
    return evaluation.answer_report(evaluation.score_answers(given, golden)).select("passed", "questions", *[F.round(c, 9).alias(c) for c in ("refusal_precision", "refusal_recall", "faithfulness")])


@query("SELECT p_partkey AS query_id, p_brand || '-' || p_partkey || 'qqq.pdf' AS filename FROM part WHERE p_partkey % 2 = 0")
def named_documents(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_brand", F.lit("-"), k.cast("string"), F.lit("qqq.pdf"))
    rows = table(spark, d, "part").select(k.alias("query_id"), name.alias("filename"), F.concat(F.lit("in the brand pdf "), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("qqq"))).otherwise("12")).alias("question"))
    return questions.mentioned_documents(rows, rows, ["brand", "pdf"])


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_custkey % 2 = 0 OR c_custkey % 3 = 2")
def narrowed_rows(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 3).alias("query_id"), F.col("c_custkey").alias("k"))
    return questions.narrowed(rows, rows.where("query_id = 1 and k % 2 = 0"), "k").select("k")


@query("SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS label_id, l_linenumber AS prediction_id FROM lineitem WHERE l_linenumber % 3 <> 0")
def matched_labels(spark, d):
    """Each order's lines are labels, two thirds of them predictions too: a line's own prediction has its page and number."""
    k = F.col("l_linenumber")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit("cross_default").alias("covenant_type"), k.alias("id"), k.alias("page_number"), *[(F.lit(None) if c != "threshold_amount" else F.lit(1000) * k).cast(kind).alias(c) for c, kind in rules.TERMS.items() if c != "severity"], F.lit(None).cast("string").alias("rating_agency"))
    found = evaluation.match_covenants(line.withColumnRenamed("id", "label_id"), line.where(k % 3 != 0).withColumnRenamed("id", "prediction_id").withColumnRenamed("l_linenumber", "x"))
    return found.where("score >= 5").select("document_id", "label_id", "prediction_id")
