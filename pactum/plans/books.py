"""More registered queries: answers to a log of questions, chunk layouts, every covenant pattern with its quote, evaluation of
whole books, streams driven to their end, lookups and sinks. As in queries.py, parts stand in for instruments and their
documents, customers for portfolios, events for uploads and log-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import text
from pactum.functions.ratings import NOTCHES
from pactum.operators import chunks, evaluation, extraction, ledger, portfolio, questions, retrieval, review, rules, verify
from pactum.plans.queries import CALLS_SQL, SQL_HOLD, SQL_INST, SQL_NOTCHES, _item, calls, holdings, instruments, pages, query, table, triggers
from pactum.sources import tables
from pactum.streaming import streams

ASKED = ["Should we buy Bond zz{k}?", "Is Bond zz{k} in breach?", "What is our exposure?", "What is our exposure to bonds rated below {n}?", "Which instruments are rated below {n}?", "What is the gearing of Bond zz{k}?", "What is the maturity of the frobnicator?", "What is each rating trigger?", "What is the exposure of Fund yy{k}?", "Summarise it", "Which are in breach?"]


@query(f"""WITH {SQL_INST}, {SQL_HOLD}, q AS (SELECT p_partkey AS k, p_partkey % 11 AS m, (p_partkey // 11) % 2 AS e, (p_partkey * 3) % 22 AS b, {SQL_NOTCHES} AS ns FROM part),
cov AS (SELECT p_partkey AS k, CASE WHEN (p_partkey // 11) % 2 = 0 THEN 'gearing_ratio' ELSE 'rating_trigger' END AS t, 0.5 + (p_partkey % 5) / 10.0 AS sure FROM part),
h AS (SELECT portfolio_id AS p, r, count(*) AS n FROM hold JOIN inst USING (instrument_id) GROUP BY 1, 2),
under AS (SELECT q.k, count(DISTINCT h.p) AS n FROM q JOIN h ON h.r > q.b WHERE q.m = 3 GROUP BY 1), rated AS (SELECT q.k, count(*) AS n FROM q JOIN inst ON inst.r > q.b WHERE q.m = 4 GROUP BY 1),
book AS (SELECT count(*) FILTER (WHERE r IS NOT NULL) AS judged, count(*) FILTER (WHERE r IS NULL) AS open, count(*) FILTER (WHERE r > t) AS bad FROM inst),
x AS (SELECT q.k, q.m, ns[b + 1] AS notch, CASE m WHEN 0 THEN 'unsupported' WHEN 1 THEN 'covenant_breach_check' WHEN 2 THEN 'portfolio_query' WHEN 3 THEN 'portfolio_query' WHEN 4 THEN 'instrument_lookup' WHEN 5 THEN 'covenant_lookup' WHEN 6 THEN 'instrument_lookup' WHEN 7 THEN 'covenant_lookup' WHEN 8 THEN 'portfolio_query' WHEN 9 THEN 'document_search' ELSE 'covenant_breach_check' END AS intent,
CASE m WHEN 1 THEN (SELECT count(r) FROM inst WHERE instrument_id = q.k) WHEN 2 THEN (SELECT count(DISTINCT p) FROM h) WHEN 3 THEN coalesce(under.n, 0) WHEN 4 THEN coalesce(rated.n, 0) WHEN 5 THEN 1 - e WHEN 7 THEN (SELECT count(*) FROM cov WHERE t = 'rating_trigger') WHEN 8 THEN (CASE WHEN q.k IN (SELECT c_custkey FROM customer) THEN (SELECT count(DISTINCT p) FROM h WHERE h.p = q.k) ELSE (SELECT count(DISTINCT p) FROM h) END) WHEN 9 THEN 3 * (1 - e) WHEN 10 THEN (SELECT judged FROM book) ELSE 0 END AS n,
CASE m WHEN 1 THEN (SELECT count(*) FILTER (WHERE r IS NULL) FROM inst WHERE instrument_id = q.k) WHEN 10 THEN (SELECT open FROM book) ELSE 0 END AS open, CASE m WHEN 1 THEN (SELECT count(*) FILTER (WHERE r > t) FROM inst WHERE instrument_id = q.k) WHEN 10 THEN (SELECT bad FROM book) ELSE 0 END AS bad,
CASE m WHEN 5 THEN (SELECT sure FROM cov WHERE cov.k = q.k) WHEN 7 THEN (SELECT min(sure) FROM cov WHERE t = 'rating_trigger') WHEN 9 THEN 0.55 ELSE 0.95 END AS sure FROM q LEFT JOIN under ON under.k = q.k LEFT JOIN rated ON rated.k = q.k)
SELECT k AS query_id, intent, CASE WHEN n + open = 0 THEN NULL WHEN m IN (1, 10) THEN (CASE WHEN bad > 0 THEN CAST(bad AS VARCHAR) ELSE 'No' END) || ' covenant breach(es), ' || open || ' not evaluated.' WHEN m IN (2, 8) THEN n || ' portfolio(s).' WHEN m = 3 THEN n || ' portfolio(s) rated below ' || notch || '.' WHEN m = 4 THEN n || ' instrument(s) rated below ' || notch || '.' ELSE n || ' passage(s).' END AS headline,
CAST(n AS BIGINT) AS n_lines, CAST(CASE WHEN m IN (1, 5, 7, 9, 10) THEN n ELSE 0 END AS BIGINT) AS citations, round(CAST(CASE WHEN n + open = 0 THEN 0 WHEN n = 0 THEN 0.4 ELSE sure END AS DOUBLE), 6) AS confidence, n + open = 0 AS refused FROM x""")
def question_answers(spark, d):
    """Every intent of the question log: notch asked for, names, verdicts, fall-back to search, refusals."""
    k = F.col("p_partkey")
    part = tables.spread(table(spark, d, "part"))
    asked = part.select(k.alias("query_id"), F.replace(F.replace(_item(ASKED, k % 11), F.lit("{k}"), k.cast("string")), F.lit("{n}"), _item(NOTCHES, k * 3 % 22)).alias("question"))
    book = instruments(spark, d).withColumns({"instrument_name": F.concat(F.lit("Bond zz"), F.col("instrument_id").cast("string")), "issuer_name": F.lit(None).cast("string")})
    funds = table(spark, d, "customer").select(F.col("c_custkey").alias("portfolio_id"), F.concat(F.lit("Fund yy"), F.col("c_custkey").cast("string")).alias("name"))
    clause = F.concat(F.lit("c"), k.cast("string"))
    even = F.floor(k / 11) % 2 == 0
    covenants = part.select(clause.alias("clause_id"), k.alias("instrument_id"), F.when(even, "gearing_ratio").otherwise("rating_trigger").alias("covenant_type"), F.lit("q").alias("source_quote"), F.lit(1).alias("page_number"), (0.5 + k % 5 / 10.0).alias("confidence"))
    terms = triggers(spark, d).where("source_clause_id is not null").select("instrument_id", F.col("source_clause_id").alias("clause_id"), F.lit("rating_trigger").alias("covenant_type"), "trigger_rating", "severity")
    facts = book.select("instrument_id", "current_rating")
    hits = part.where(even).select(k.alias("query_id"), F.explode(F.array(*map(F.lit, "abc"))).alias("chunk_id")).withColumn("chunk_text", F.lit("passage"))
    found = questions.answer(asked, book, funds, holdings(spark, d), covenants, terms, facts, hits)[0]
    return found.withColumn("confidence", F.round("confidence", 6))


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part: a heading, a line, a table, and a paragraph that is short, of forty sentences, or of one."""
    k = F.col("p_partkey")
    rows = tables.spread(table(spark, d, "part")).select(k, F.col("p_brand").alias("document_id"), F.concat(F.lit("TERMS OF ISSUE "), k.cast("string"), F.lit("\n\nGearing stays low in year "), k.cast("string"), F.lit(". The issuer reports it.\n\n")).alias("head"), F.concat(F.lit("a | b\n1 | "), k.cast("string")).alias("grid"), F.when(k % 3 == 0, F.repeat(F.lit("Sentence of the thing number it is here. "), F.lit(40))).when(k % 3 == 1, F.repeat(F.lit("x"), F.lit(2500))).otherwise("Short end.").alias("tail"))
    at = F.length("head")
    return rows.select("document_id", k.alias("page_number"), F.concat("head", "grid", F.lit("\n\n \t\n"), "tail").alias("ocr_text"), F.array(F.struct(at.alias("start"), (at + F.length("grid")).alias("end"))).alias("tables"))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS document_id, 'TERMS OF ISSUE ' || p_partkey AS title, 'TERMS OF ISSUE ' || p_partkey || chr(10) || chr(10) || 'Gearing stays low in year ' || p_partkey || '. The issuer reports it.' AS head, 'a | b' || chr(10) || '1 | ' || p_partkey AS grid, p_partkey % 3 AS m FROM part),
c AS (SELECT *, length(head) + 2 AS g, length(head) + 2 + length(grid) + 5 AS t FROM p),
x AS (SELECT k, document_id, title, 0 AS place, 0 AS s, length(head) AS e, head AS chunk_text, 'paragraph' AS chunk_type FROM c UNION ALL SELECT k, document_id, title, 1, g, g + length(grid), grid, 'table' FROM c
UNION ALL SELECT k, document_id, title, 2, t, t + 10, 'Short end.', 'paragraph' FROM c WHERE m = 2 UNION ALL SELECT k, document_id, title, 2 + i, t + 29 * 41 * i, t + 29 * 41 * i + (29 - 18 * i) * 41 - 1, rtrim(repeat('Sentence of the thing number it is here. ', CAST(29 - 18 * i AS BIGINT))), 'paragraph' FROM c, (VALUES (0), (1)) AS v(i) WHERE m = 0
UNION ALL SELECT k, document_id, title, 2 + i, t + 1200 * i, t + least(2500, 1200 * (i + 1)), repeat('x', CAST(least(1200, 2500 - 1200 * i) AS BIGINT)), 'paragraph' FROM c, (VALUES (0), (1), (2)) AS v(i) WHERE m = 1)
SELECT document_id, k AS page_number, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k, place) + CASE WHEN document_id < 'Brand#2' THEN 9 ELSE -1 END AS INTEGER) AS ordinal, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, chunk_type, title AS section_title, sha256(k || '|' || s || '|' || e || '|' || chunk_text) AS hash FROM x""")
def page_layouts(spark, d):
    """Chunks of pages with headings, tables and long paragraphs, numbered on after those that some documents have."""
    own = laid_out(spark, d)
    after = own.select("document_id").distinct().where("document_id < 'Brand#2'").withColumn("ordinal", F.lit(9))
    return chunks.chunk(own, "ocr_text", after=after).select("document_id", "page_number", "ordinal", "char_start", "char_end", "chunk_type", "section_title", "hash")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), b AS (SELECT doc_id, len([x for x in regexp_split_to_array(text, '\n[ \t]*\n+') if regexp_matches(x, '[^\s\x1C-\x1F\x85]')]) AS blocks FROM documents),
h AS (SELECT doc_id, count(*) FILTER (WHERE length(regexp_replace(l, '[^\p{Lu}]', '', 'g')) >= 0.7 * length(regexp_replace(l, '[^\p{L}]', '', 'g')) AND length(regexp_replace(l, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(l, '^\s+|\s+$', '', 'g')) <= 120 AND NOT regexp_matches(l, '[.,;]\s*$')) AS headings FROM l GROUP BY 1),
n AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS ink FROM documents) SELECT doc_id, CAST(blocks AS INTEGER) AS blocks, headings, CAST(ink AS BIGINT) AS ink, true AS short, true AS in_order FROM b JOIN h USING (doc_id) JOIN n USING (doc_id)""")
def chunk_coverage(spark, d):
    """Of each document its blocks and heading lines, and of its chunks: all ink is in one, none is too long, none overlap."""
    docs = tables.spread(table(spark, d, "documents")).select("doc_id", "text")
    found = chunks.chunk(docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text"))
    per = found.groupBy("document_id").agg(F.sum(F.length(F.regexp_replace("chunk_text", r"\s", ""))).alias("ink"), F.bool_and(F.length("chunk_text") <= 1200).alias("short"), F.sort_array(F.collect_list(F.struct("ordinal", "char_start", "char_end"))).alias("c"))
    order = F.forall(F.sequence(F.lit(0), F.size("c") - 1), lambda i: (F.col("c")[i]["ordinal"] == i) & ((i == 0) | (F.col("c")[i]["char_start"] >= F.col("c")[F.greatest(i - 1, F.lit(0))]["char_end"])))
    lines = F.size(F.filter(F.split("text", "\n"), chunks.is_heading))
    # a blank text has no chunks, and nothing that they could lack
    return docs.select(F.col("doc_id"), F.size(chunks.blocks(F.col("text"))).alias("blocks"), lines.cast("bigint").alias("headings"), "text").where("text is not null").join(per.select(F.col("document_id").alias("doc_id"), "ink", "short", order.alias("in_order")), "doc_id", "left").fillna({"ink": 0, "short": True, "in_order": True}).drop("text")


#: A sentence for each pattern, and one for none; {s} is a number. The first has two matches that overlap once widened.
SAID = [
    ("gearing_ratio_en", "Its gearing ratio of not more than {s}.5 times, or gearing ratio of not more than 9 times, is tested twice a year"), ("gearing_ratio_ms", "Penerbit akan memastikan nisbah gearan tidak melebihi {s}.25 kali pada setiap masa"), ("interest_cover_en", "The Issuer keeps an interest coverage ratio of not less than {s}.75 times at all times"), ("finance_service_cover_en", "A debt service cover ratio of not less than {s} times is to be kept by the Obligor always"), ("minimum_net_worth_en", "There is a consolidated net worth of not less than RM {s},500 million to be maintained"),
    ("cross_default_en", "Any indebtedness of the Issuer becomes due and payable prior to its stated maturity above USD {s} million"), ("negative_pledge_en", "The Issuer shall not and shall procure that none will create or permit to subsist any security interest"), ("change_of_control_en", "There is an event if a change of control of the Issuer happens without consent of holders"), ("rating_trigger_en", "The rating assigned by RAM is downgraded to below BBB2 in any year of the whole programme"), ("shariah_non_compliance", "Ketidakpatuhan Shariah oleh pihak Penerbit hendaklah dianggap sebagai satu kejadian mungkir"), ("purchase_undertaking", "The Obligor grants a purchase undertaking in favour of the Trustee on the date of issue"), ("dissolution_event", "Upon a dissolution event the Trustee shall declare all amounts to be immediately payable"), ("call_option_en", "The Issuer may redeem the Sukuk in whole or in part on the dates that are set out below"), (None, "Nothing of note is said in this sentence which fills the page of the document as it must"),
]
_SAID_SQL = "said AS (SELECT p_partkey AS k, p_size AS s, p_brand AS document_id, p_partkey % 14 AS m, replace([" + ", ".join("'" + t.replace("'", "''") + "'" for _, t in SAID) + "][p_partkey % 14 + 1], '{s}', CAST(p_size AS VARCHAR)) || '.' AS quote, [" + ", ".join(f"'{p}'" if p else "NULL" for p, _ in SAID) + "][p_partkey % 14 + 1] AS pattern_id FROM part)"


def said(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    sentence = F.replace(_item([t for _, t in SAID], k % 14), F.lit("{s}"), F.col("p_size").cast("string"))
    return tables.spread(table(spark, d, "part")).select(F.col("p_brand").alias("document_id"), k.alias("page_number"), F.lit(0).alias("ordinal"), F.concat(F.lit("The first words say little. "), sentence, F.lit(". Then the text goes on.")).alias("chunk_text"), F.concat(F.lit("h"), k.cast("string")).alias("hash"))


@query(f"""WITH {_SAID_SQL} SELECT 'h' || k AS hash, pattern_id, quote, 28 AS char_start, CAST(28 + length(quote) AS INTEGER) AS char_end,
CASE m WHEN 0 THEN 'lte' WHEN 1 THEN 'lte' WHEN 2 THEN 'gte' WHEN 3 THEN 'gte' WHEN 4 THEN 'gte' END AS operator, CAST(CASE m WHEN 0 THEN s + 0.5 WHEN 1 THEN s + 0.25 WHEN 2 THEN s + 0.75 WHEN 3 THEN s END AS DECIMAL(12,6)) AS threshold_ratio,
CAST(CASE m WHEN 4 THEN CAST(s AS BIGINT) * 1000000000 + 500000000 WHEN 5 THEN CAST(s AS BIGINT) * 1000000 END AS DECIMAL(20,4)) AS threshold_amount, CASE m WHEN 4 THEN 'MYR' WHEN 5 THEN 'USD' END AS threshold_currency, CASE WHEN m = 8 THEN 'BBB' END AS trigger_rating, CASE WHEN m = 8 THEN 'RAM' END AS rating_agency,
CASE WHEN m = 9 THEN 'critical' WHEN m IN (5, 6, 7, 8) THEN 'high' WHEN m < 5 THEN 'medium' END AS severity FROM said WHERE m < 13""")
def pattern_quotes(spark, d):
    """All thirteen patterns, with their terms and their quotes widened to the sentence; overlapping ones once."""
    return extraction.extract(said(spark, d)).select("hash", "pattern_id", "quote", "char_start", "char_end", "operator", "threshold_ratio", "threshold_amount", "threshold_currency", "trigger_rating", "rating_agency", "severity")


@query(f"""WITH {_SAID_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY 'h' || k) AS place FROM said WHERE m < 13) SELECT document_id, 'h' || k AS hash, 'regex' AS leg, 0 AS span_start, CAST(28 + length(quote) + 23 AS INTEGER) AS span_end FROM c WHERE place <= 20
UNION ALL SELECT document_id, 'h' || k, 'semantic', 5, 9 FROM said WHERE 'h' || k NOT IN (SELECT 'h' || k FROM c WHERE place <= 20)""")
def candidate_spans(spark, d):
    """Regex candidates, at most twenty a document in the order of chunk ids, and semantic ones of chunks that have none."""
    own = said(spark, d)
    found = extraction.candidates(own, 20).select("document_id", "hash", F.lit("regex").alias("leg"), F.col("start").cast("int").alias("span_start"), F.col("end").cast("int").alias("span_end"))
    semantic = own.select("document_id", "hash", F.lit("semantic").alias("leg"), F.lit(5).alias("span_start"), F.lit(9).alias("span_end"))
    return extraction.uncovered(semantic, found)


@query(f"""WITH {SQL_INST}, {SQL_HOLD}, held AS (SELECT DISTINCT instrument_id AS k FROM hold), c AS (SELECT instrument_id AS k, p_size, r, t, ns, instrument_id % 7 = 0 AS bad, instrument_id % 7 > 0 AND instrument_id % 5 = 0 AS loose FROM inst)
SELECT c.k AS instrument_id, 'gearing_ratio' AS covenant_type, CASE WHEN p_size > 30 THEN 'breach' WHEN CAST(p_size / 10.0 AS DECIMAL(12,6)) >= 2.85 THEN 'at_risk' ELSE 'ok' END AS status, 'gearing_ratio ' || CASE WHEN p_size > 30 THEN 'breach' WHEN CAST(p_size / 10.0 AS DECIMAL(12,6)) >= 2.85 THEN 'at_risk' ELSE 'ok' END || ' observed ' || CAST(CAST(p_size / 10.0 AS DECIMAL(26,6)) AS VARCHAR) || ' against 3.000000' AS detail FROM c JOIN held USING (k) WHERE NOT bad AND NOT loose
UNION ALL SELECT c.k, 'rating_trigger', CASE WHEN r IS NULL THEN 'insufficient_data' WHEN r > t THEN 'breach' WHEN r = t THEN 'at_risk' ELSE 'ok' END, 'rating_trigger ' || CASE WHEN r IS NULL THEN 'insufficient_data' WHEN r > t THEN 'breach ' WHEN r = t THEN 'at_risk ' ELSE 'ok ' END || coalesce(abs(r - t) || ' notches from ' || ns[t + 1], '') FROM c JOIN held USING (k)
UNION ALL SELECT k, 'gearing_ratio', 'rejected', CASE WHEN bad THEN 'ratio is no number' ELSE 'amount without currency' END FROM c WHERE bad OR loose""")
def book_verdicts(spark, d):
    """Stored terms, checked, and rating triggers of all held instruments against their facts; rejects with their reason."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    stored = part.select(k.alias("instrument_id"), F.lit("gearing_ratio").alias("covenant_type"), F.when(k % 7 == 0, "about three").otherwise("3").alias("threshold_ratio"), F.when(k % 5 == 0, "100").alias("threshold_amount"), F.lit(None).cast("string").alias("threshold_currency"), F.lit("medium").alias("severity"))
    usable, rejects = rules.checked_terms(stored)
    own = triggers(spark, d).where("source_clause_id is null").select("instrument_id", "trigger_rating", "severity")
    facts = instruments(spark, d).select("instrument_id", "current_rating", (F.col("p_size") / 10).cast("decimal(12,6)").alias("gearing_ratio"))
    found = rules.evaluate_book(holdings(spark, d), usable, own, facts)
    return found.select("instrument_id", "covenant_type", "status", F.col("explanation").alias("detail")).union(rejects.select("instrument_id", "covenant_type", F.lit("rejected"), "reason"))


@query("""WITH l AS (SELECT o_orderkey AS doc, l_linenumber AS n, CAST(l_shipdate AS DATE) AS want FROM orders JOIN lineitem ON o_orderkey = l_orderkey), one AS (SELECT doc, min(n) AS n, arg_min(want, n) AS want FROM l GROUP BY 1)
SELECT doc AS label_id, doc % 7 AS days FROM one WHERE doc % 7 <= 3 AND doc % 10 > 0""")
def matched_calls(spark, d):
    """A call label for each order and a predicted call some days later: those within three days, none that a person made."""
    k = F.col("l_orderkey")
    # lines may share a number: the earliest of them, since both sides below must get the same one
    first = table(spark, d, "lineitem").groupBy(k).agg(F.min(F.struct("l_linenumber", F.to_date("l_shipdate").alias("day")))["day"].alias("call_date"))
    labels = first.select(k.alias("document_id"), k.alias("label_id"), "call_date")
    found = first.select(k.alias("document_id"), (k + 1).alias("prediction_id"), F.date_add("call_date", (k % 7).cast("int")).alias("call_date"), F.when(k % 10 == 0, "human").otherwise("rule").alias("method"))
    return evaluation.match_calls(found, labels).select("label_id", F.col("days").cast("bigint").alias("days"))


@query("SELECT count(*) AS predicted, count(*) FILTER (WHERE l_returnflag <> 'R') AS reverified, count(*) FILTER (WHERE l_returnflag = 'A') AS matched, (SELECT count(*) FROM orders) AS labels, round(count(*) FILTER (WHERE l_returnflag <> 'R') / count(*), 9) AS verification_rate, round(count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 9) AS precision, round(count(*) FILTER (WHERE l_returnflag = 'A') / (SELECT count(*) FROM orders), 9) AS recall FROM lineitem")
def citation_tallies(spark, d):
    checked = table(spark, d, "lineitem").select((F.col("l_returnflag") != "R").alias("reverified"), (F.col("l_returnflag") == "A").alias("evidence_matched"))
    out = evaluation.citation_tally(checked, table(spark, d, "orders"))
    return out.select("predicted", "reverified", "matched", "labels", *[F.round(c, 9).alias(c) for c in ("verification_rate", "precision", "recall")])


@query("SELECT c_custkey AS document_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')")
def documents_without_covenants(spark, d):
    clauses = table(spark, d, "orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_custkey").alias("document_id"))
    covenants = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("clause_id"))
    return portfolio.without_covenants(table(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), clauses, covenants)


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'not_found' ELSE 'normalised' END AS method, CASE WHEN item_id % 5 <> 3 THEN 7 END AS char_start, item_id % 5 <> 3 AS verified FROM benchmark""")
def quotes_by_every_leg(spark, d):
    """Quotes as they are, with other spaces, with three letters changed, made up, and in full-width letters."""
    k, quote = F.col("item_id"), F.col("text")
    wide = F.translate(quote, "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
    changed = F.when(k % 5 == 1, F.replace(quote, F.lit(" "), F.lit("  "))).when(k % 5 == 2, F.concat(F.substring(quote, 1, 30), F.lit("#"), F.substring(quote, 32, 20), F.lit("##"), F.expr("substring(text, 54)"))).when(k % 5 == 3, F.reverse(quote)).when(k % 5 == 4, wide).otherwise(quote)
    pairs = table(spark, d, "benchmark").select("item_id", changed.alias("quote"), F.concat(F.lit("Before "), quote, F.lit(" after")).alias("chunk_text"))
    return verify.verify(pairs).select("item_id", "method", "char_start", "verified")


@query(f"WITH {SQL_INST}, {SQL_HOLD} SELECT portfolio_id, count(*) AS positions, CAST(coalesce(sum(market_value), 0) AS DECIMAL(30,4)) AS exposure, CAST(sum(market_value) AS DECIMAL(30,4)) AS total FROM hold JOIN inst USING (instrument_id) WHERE as_of_date = DATE '1998-03-01' AND r >= 9 GROUP BY portfolio_id")
def exposure_at_or_below(spark, d):
    return portfolio.exposure(portfolio.holdings_view(holdings(spark, d), portfolio.enrich(instruments(spark, d)), as_of="1998-03-01", rated_at_most="BBB-")[0])


@query(f"WITH {CALLS_SQL}, b AS (SELECT doc, sum(cost) AS cost FROM c GROUP BY doc) SELECT count(*) AS documents, count(*) FILTER (WHERE cost > 0) AS with_spend, round(CAST(avg(cost) FILTER (WHERE cost > 0) AS DOUBLE), 6) AS mean_cost, count(*) FILTER (WHERE cost > 1000) AS over_cap FROM b")
def spend_summary(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    out = ledger.spend_summary(ledger.spend_report(calls(spark, d), docs, "1000"))
    return out.withColumn("mean_cost", F.round(F.col("mean_cost").cast("double"), 6))


@query("""SELECT doc_id, round(least(1.0, (CASE WHEN length(text) = 0 THEN 0 ELSE (7.0 * (doc_id % 4) + 2 * (doc_id % 3)) / (length(text) + 7 * (doc_id % 4) + 2 * (doc_id % 3)) END)), 9) AS garbled FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '[\\p{Cc}\\p{Cf}\\p{Co}\\x{FFFD}]', '', 'g') = regexp_replace(text, '[\\n\\r\\t]', '', 'g') UNION ALL
SELECT doc_id, NULL FROM documents WHERE text IS NULL OR regexp_replace(text, '[\\p{Cc}\\p{Cf}\\p{Co}\\x{FFFD}]', '', 'g') <> regexp_replace(text, '[\\n\\r\\t]', '', 'g')""")
def garbling(spark, d):
    """Texts to which marks of unreadable glyphs and private characters were added; texts that had some before are null."""
    k = F.col("doc_id")
    clean = F.regexp_replace("text", r"[\p{Cc}\p{Cf}\p{Co}�]", "") == F.regexp_replace("text", r"[\n\r\t]", "")
    odd = F.concat(F.col("text"), F.repeat(F.lit("(cid:7)"), (k % 4).cast("int")), F.repeat(F.lit("�"), (k % 3).cast("int")))
    ratio = F.when(F.length("text") == 0, 0.0).otherwise(text.garbled_ratio(odd))
    return tables.spread(table(spark, d, "documents")).select("doc_id", F.when(clean, F.round(ratio, 9)).alias("garbled"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def documents_by_status(spark, d):
    return portfolio.where_equal(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 100, o_orderstatus="O").select("o_orderkey")


@query("SELECT doc_id AS page_number FROM documents WHERE doc_id % 10 < 5 AND doc_id % 4 <> 0")
def vision_backlog(spark, d):
    rows = pages(spark, d).withColumns({"confidence": F.col("page_number") % 10 / 10.0, "vlm_used": F.col("page_number") % 4 == 0})
    return chunks.pages_needing_vision(rows, 0.5).select("page_number")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 6 = 1 UNION ALL SELECT -1 - doc_id FROM documents WHERE doc_id % 9 = 2 AND doc_id % 6 <> 1")
def embedding_backlog(spark, d):
    """Chunks without a vector, and (below zero) those whose vector has the wrong number of dimensions."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(k.alias("chunk_id"), F.when(k % 6 != 1, F.array_repeat(F.lit(0.5), F.when(k % 9 == 2, F.lit(3)).otherwise(4))).alias("embedding"))
    wrong = retrieval.wrong_dimensions(rows, 4)
    return retrieval.unembedded(rows).select("chunk_id").union(wrong.select(-1 - F.col("chunk_id")))


@query("SELECT o_orderkey AS clause_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def unverified_clauses(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("clause_id"), (F.col("o_orderstatus") != "F").alias("citation_verified"))
    return review.unverified(rows).select("clause_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 0 AND o_custkey % 2 = 0 AND l_returnflag = 'R'")
def covenants_by_filters(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clause_id"), "l_linenumber", F.col("l_partkey").alias("instrument_id"), F.when(F.col("l_returnflag") == "R", "rating_trigger").otherwise("other").alias("covenant_type"))
    clauses = table(spark, d, "orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_custkey").alias("document_id"), F.lit(1).alias("page_number"))
    picked = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("instrument_id"))
    docs = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"))
    return portfolio.covenants_of(rows, clauses, picked, docs, "rating_trigger").select(F.col("clause_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT DISTINCT source AS document_id FROM documents WHERE doc_id % 50 = 3")
def rechunk_backlog(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.when(F.col("doc_id") % 50 == 3, F.col("text")).alias("ocr_text"))
    return chunks.awaiting_rechunk(rows)


@query("SELECT 'audit' AS log, event_type AS kind, 2 * count(*) AS rows FROM events GROUP BY 2 UNION ALL SELECT 'report', event_type, count(*) FROM events GROUP BY 2")
def appended_logs(spark, d):
    """Audit rows appended twice as Parquet and a report once as JSON, read back."""
    rows, folder = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind")), tables.work_folder(spark)
    for _ in range(2):
        tables.append(rows, f"{folder}/audit")
    tables.append(rows, f"{folder}/report", "json")
    logs = [("audit", spark.read.parquet(f"{folder}/audit")), ("report", spark.read.schema("event_id long, kind string").json(f"{folder}/report"))]
    counts = [log.groupBy("kind").agg(F.count("*").alias("rows")).select(F.lit(name).alias("log"), "kind", "rows") for name, log in logs]
    return counts[0].union(counts[1])


@query("SELECT count(*) AS rows, 6 AS columns FROM part UNION ALL SELECT count(*), 4 FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def readable_views(spark, d):
    """The views that analysts may read: readable columns only, all rows."""
    book = instruments(spark, d)
    tables.publish_views({"instruments": book.withColumn("secret", F.lit(1)), "portfolio_holdings": holdings(spark, d), "llm_calls": calls(spark, d)})
    names = ("instruments", "portfolio_holdings")
    out = [spark.table(n).agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(spark.table(n).columns))) for n in names]
    return out[0].union(out[1])


@query(f"WITH {SQL_HOLD} SELECT portfolio_id, instrument_id, count(*) AS positions, CAST(sum(market_value) AS DECIMAL(30,4)) AS total FROM hold GROUP BY 1, 2 ORDER BY portfolio_id, instrument_id LIMIT 1000")
def analyst_results(spark, d):
    """An analyst's totals over all holdings, of which the first thousand rows come back."""
    tables.publish_views({"portfolio_holdings": holdings(spark, d)})
    return tables.analyst_result(spark, "select portfolio_id, instrument_id, count(*) as positions, cast(sum(market_value) as decimal(30,4)) as total from portfolio_holdings group by 1, 2 order by portfolio_id, instrument_id")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 OR c_custkey IN (SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def set_operations(spark, d):
    """Union, then difference, as analysts may write them."""
    for name in ("customer", "orders", "supplier"):
        table(spark, d, name).createOrReplaceTempView(f"book_{name}")
    return spark.sql("select k from (select c_custkey as k from book_customer where c_custkey % 2 = 0 union select c_custkey from book_customer left semi join book_orders on c_custkey = o_custkey) except select s_suppkey from book_supplier")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream. The path is a pattern, which may stand for a file as well as for a folder of files."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _to_end(df: DataFrame) -> DataFrame:
    """Runs a stream over what there is now and reads its result back from the shared folder."""
    folder = tables.work_folder(df.sparkSession)
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@query("SELECT DISTINCT sha256(event_type || '-' || user_id) AS sha256 FROM events")
def streamed_uploads(spark, d):
    """Uploads whose bytes came before are dropped as they arrive."""
    rows = _stream(spark, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("content"), F.col("ts").cast("timestamp").alias("arrived_at"))
    return _to_end(streams.first_uploads(rows, "20000 days")).select("sha256")


@query("""WITH e AS (SELECT event_id, ts, user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase')), g AS (SELECT *, coalesce(max(CASE WHEN ok THEN n END) OVER (PARTITION BY user_id ORDER BY n), 0) AS last FROM e)
SELECT CAST(a.user_id AS VARCHAR) AS key, a.ts, CAST(count(*) AS INTEGER) AS failures FROM g a JOIN g b ON b.user_id = a.user_id AND b.last = a.last AND NOT b.ok AND b.n <= a.n AND b.ts >= a.ts - INTERVAL 2880 MINUTE WHERE NOT a.ok GROUP BY a.user_id, a.ts, a.n""")
def streamed_failures(spark, d):
    """Events that arrive up to a day late, in four batches and an end, counted in the order in which they happened."""
    spark.conf.set(*streams.STATE_STORE)
    late = F.make_dt_interval(hours=F.col("event_id") % 5 * 6)
    rows = table(spark, d, "events").where("event_type in ('error', 'purchase')").select(F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "purchase").alias("succeeded"))
    span = rows.agg(F.unix_seconds(F.min("ts")).alias("low"), F.unix_seconds(F.max("ts")).alias("high")).first()
    quarter = F.least(F.floor((F.unix_seconds(F.col("ts") + late) - span.low) * 4 / max(1, span.high - span.low + 1)), F.lit(3))
    arrivals = [rows.where(quarter == k) for k in range(4)]
    arrivals.append(rows.limit(1).select(F.lit(None).cast("string").alias("user"), F.timestamp_seconds(F.lit(span.high + 90_000 * 2)).alias("ts"), F.lit(0).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit(True).alias("succeeded")))
    folder = tables.work_folder(spark)
    for k, batch in enumerate(arrivals):
        batch.write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
        found = streams.failure_monitor(stream, "user", 2880 * 60, 400 * 86_400, "25 hours")
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(round(CAST(value AS DECIMAL(12,6)) * 1000000) AS BIGINT) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, micros <= 300000000 AS admitted, CASE WHEN micros <= 300000000 THEN micros ELSE 0 END AS spent FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, r.spent + e.micros <= 300000000, CASE WHEN r.spent + e.micros <= 300000000 THEN r.spent + e.micros ELSE r.spent END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS document_id, admitted, CAST(spent AS BIGINT) AS spent_micros FROM r""")
def streamed_admission(spark, d):
    spark.conf.set(*streams.STATE_STORE)
    rows = _stream(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(12,6)").alias("estimate"))
    return _to_end(streams.spend_admission(rows, "300"))


@query("SELECT 'page' AS kind, doc_id AS page_number, CAST(length(text) AS BIGINT) AS n FROM documents UNION ALL SELECT 'ink', doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) FROM documents")
def streamed_pages(spark, d):
    """The queue drained into assessed pages and chunks: characters of each page, and ink of its chunks."""
    k = F.col("doc_id")
    rows = _stream(spark, d, "documents").select(F.col("source").alias("document_id"), k.alias("page_number"), "text", (k % 10 / 10.0).alias("image_area_ratio"), (k % 13 != 0).alias("has_text_layer"), (k % 3 == 0).alias("has_table_hint"), (k % 5 == 0).alias("table_extraction_failed"))
    folder = tables.work_folder(spark)
    streams.drain(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    read = spark.read.parquet(f"{folder}/out/pages").select(F.lit("page").alias("kind"), "page_number", F.col("char_count").cast("bigint").alias("n"))
    ink = spark.read.parquet(f"{folder}/out/chunks").groupBy("page_number").agg(F.sum(F.length(F.regexp_replace("chunk_text", r"\s", ""))).alias("n"))
    return read.union(ink.select(F.lit("ink"), "page_number", "n"))


@query("""SELECT p_brand AS document_id, CASE WHEN bool_or(p_size % 10 = 1) AND NOT bool_or(p_size % 10 = 2) THEN 'MARC' WHEN bool_or(p_size % 10 = 2) AND NOT bool_or(p_size % 10 = 1) THEN 'RAM' END AS agency FROM part WHERE p_size > 40 GROUP BY 1
UNION ALL SELECT 'all ' || p_type, CASE WHEN bool_or(p_size % 10 = 1) AND NOT bool_or(p_size % 10 = 2) THEN 'MARC' WHEN bool_or(p_size % 10 = 2) AND NOT bool_or(p_size % 10 = 1) THEN 'RAM' END FROM part GROUP BY p_type""")
def agencies_named(spark, d):
    """Documents that name one agency, both, or none."""
    said = F.when(F.col("p_size") % 10 == 1, "as Malaysian Rating Corporation says").when(F.col("p_size") % 10 == 2, "rated by RAM").otherwise("no one")
    rows = table(spark, d, "part").select("p_brand", "p_type", "p_size", said.alias("chunk_text"))
    chunks_ = rows.where("p_size > 40").select(F.col("p_brand").alias("document_id"), "chunk_text").union(rows.select(F.concat(F.lit("all "), "p_type"), "chunk_text"))
    return extraction.document_agency(chunks_)


@query("""WITH x AS (SELECT p_partkey AS k, p_brand AS document_id, make_date(2026 + CAST(p_partkey % 5 AS INTEGER), CAST(p_size % 12 + 1 AS INTEGER), 15) AS call_date, CAST(101 + p_partkey % 9 AS DECIMAL(12,6)) AS call_price, ['optional', 'mandatory', 'make_whole', 'clean_up', 'tax', 'regulatory', 'optional'][p_partkey % 7 + 1] AS call_type, 'h' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS hash FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, call_date ORDER BY hash) AS n FROM x) SELECT document_id, call_date, call_price, call_type, 8 AS char_start FROM r WHERE n = 1""")
def call_rows(spark, d):
    """Call tables with dates, prices and types of every kind; one row a document and date."""
    k = F.col("p_partkey")
    said = F.concat(F.lit("Redeem: "), F.date_format(F.make_date(2026 + k % 5, F.col("p_size") % 12 + 1, F.lit(15)), "yyyy-MM-dd"), F.lit(" "), (101 + k % 9).cast("string"), F.lit(".00"), _item([" Optional", " Mandatory", "\nMake-whole", " Clean-up", " Tax", "\n Regulatory", ", then"], k % 7))
    rows = tables.spread(table(spark, d, "part")).select(F.col("p_brand").alias("document_id"), said.alias("chunk_text"), F.concat(F.lit("h"), F.lpad(k.cast("string"), 9, "0")).alias("hash"))
    return extraction.call_schedule(rows).select("document_id", "call_date", "call_price", "call_type", "char_start")


@query("""WITH j AS (SELECT o_custkey AS d, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'e' || o_orderkey END AS e, o_orderdate AS made, o_orderstatus <> 'P' AS done FROM orders)
SELECT c_custkey AS document_id, (SELECT arg_min(e, (made, id)) FROM j WHERE d = c_custkey AND e IS NOT NULL) AS first_error, (SELECT bool_and(done) FROM j WHERE d = c_custkey) AS terminal FROM customer""")
def job_errors(spark, d):
    """The first error of each document's jobs, and whether all have ended."""
    k = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("e"), k.cast("string"))).alias("error"), F.struct("o_orderdate", k).alias("created_at"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    none = docs.limit(0).withColumns({"needs_vlm": F.lit(True), "embedding": F.lit(1.0)})
    return review.document_status(docs, none, none, jobs).select("document_id", "first_error", "terminal")


@query("""WITH c AS (SELECT event_id AS id, CAST(CASE WHEN event_id % 50 = 0 THEN -value ELSE value END AS DECIMAL(12,6)) AS cost, event_id % 4 = 0 AS hit FROM events) SELECT 'llm_calls' AS source, id, 'cost_not_negative' AS rule FROM c WHERE cost < 0 UNION ALL SELECT 'llm_calls', id, 'cache_hit_is_free' FROM c WHERE hit AND cost <> 0
UNION ALL SELECT 'document_chunks', doc_id, 'ordered_span' FROM documents WHERE doc_id % 20 = 7 UNION ALL SELECT 'document_chunks', doc_id, 'start_not_negative' FROM documents WHERE doc_id % 30 = 4
UNION ALL SELECT 'covenants', p_partkey, 'amount_has_currency' FROM part WHERE p_partkey % 6 = 1 UNION ALL SELECT 'covenants', p_partkey, 'confidence_range' FROM part WHERE p_size > 45""")
def constraint_violations(spark, d):
    """The shipped row constraints of three tables."""
    k, e, p = F.col("doc_id"), F.col("event_id"), F.col("p_partkey")
    costs = table(spark, d, "events").select(e.alias("id"), F.when(e % 50 == 0, -F.col("value")).otherwise(F.col("value")).cast("decimal(12,6)").alias("cost_usd"), (e % 4 == 0).alias("cache_hit"))
    spans = table(spark, d, "documents").select(k.alias("id"), F.when(k % 30 == 4, -1).otherwise(5).alias("char_start"), F.when(k % 20 == 7, -2).otherwise(9).alias("char_end"))
    terms = table(spark, d, "part").select(p.alias("id"), (F.col("p_size") / 45).alias("confidence"), F.lit(1).alias("threshold_amount"), F.when(p % 6 != 1, "MYR").alias("threshold_currency"))
    found = [review.violations(rows, review.CONSTRAINTS[name], "id").select(F.lit(name).alias("source"), "id", "rule") for name, rows in (("llm_calls", costs), ("document_chunks", spans), ("covenants", terms))]
    return found[0].union(found[1]).union(found[2])


_DECIDED = """d AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_returnflag = 'A' THEN 'corrected' ELSE 'approved' END AS decision, l_linenumber || '-' || l_suppkey || '-' || l_partkey AS who, l_shipdate AS made FROM lineitem),
r AS (SELECT d.*, row_number() OVER (PARTITION BY id ORDER BY made, who, decision) AS k, o_orderstatus = 'P' AS open FROM d JOIN orders ON o_orderkey = id)"""


@query(f"WITH {_DECIDED} SELECT 'conflict' AS kind, id AS review_id, decision, who AS reviewer FROM r WHERE NOT (open AND k = 1) UNION ALL SELECT 'audit', o_custkey, 'review_' || decision, who FROM r JOIN orders ON o_orderkey = id WHERE open AND k = 1 UNION ALL SELECT 'value', id, CASE WHEN decision = 'corrected' THEN 'new' END, who FROM r WHERE open AND k = 1")
def decision_records(spark, d):
    """What decisions leave: conflicts, audit rows, and the values that corrections put in."""
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("covenant").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.lit("old").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"))
    made = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "corrected").otherwise("approved").alias("decision"), F.lit("new").alias("new_value"), F.concat_ws("-", "l_linenumber", "l_suppkey", "l_partkey").alias("reviewer"), F.col("l_shipdate").alias("decided_at"))
    after, conflicts, audit = review.apply_decisions(reviews, made)
    values = after.where("reviewer is not null").select(F.lit("value").alias("kind"), "review_id", F.col("new_value").alias("decision"), "reviewer")
    return conflicts.select(F.lit("conflict").alias("kind"), "review_id", "decision", "reviewer").union(audit.select(F.lit("audit"), "entity_id", "action", "actor")).union(values)


@query("SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS status FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderstatus <> 'F' AND o_custkey % 3 = 0)")
def rerun_reviews(spark, d):
    """Reviews after documents were run again: pending ones of machine output that went are gone."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("review_status"))
    again = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"))
    reviews = rows.select(F.col("clause_id").alias("entity_id"), F.when(F.col("clause_id") % 2 == 0, "pending").otherwise("approved").alias("status"))
    return tables.replace_machine_output(rows, rows.limit(0), reviews, again)[1].select("entity_id", "status")
