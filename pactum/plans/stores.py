"""Registered queries of what is kept between runs and of joins that must not pair all with all: stored tables, chunk numbers
over batches, stems by language, indexed vectors, interval joins, contested matches, lines of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.functions.joins import by_key, overlapping
from pactum.functions.ratings import NOTCHES, notches_between
from pactum.operators import chunks, evaluation, portfolio, questions, retrieval, rules
from pactum.plans.books import laid_out
from pactum.plans.queries import _OTHER, SQL_INST, SQL_NOTCHES, TOKENS, _item, asked, holdings, instruments, query, table, triggers
from pactum.sources import stored, tables
from pactum.streaming import streams


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS document_id, 'TERMS OF ISSUE ' || p_partkey AS title, 'TERMS OF ISSUE ' || p_partkey || chr(10) || chr(10) || 'Gearing stays low in year ' || p_partkey || '. The issuer reports it.' AS head, 'a | b' || chr(10) || '1 | ' || p_partkey AS grid, p_partkey % 3 AS m FROM part),
c AS (SELECT *, length(head) + 2 AS g, length(head) + 2 + length(grid) + 5 AS t FROM p), x AS (SELECT k, document_id, 0 AS place, 0 AS s FROM c UNION ALL SELECT k, document_id, 1, g FROM c UNION ALL SELECT k, document_id, 2, t FROM c WHERE m = 2
UNION ALL SELECT k, document_id, 2 + i, t + 29 * 41 * i FROM c, (VALUES (0), (1)) AS v(i) WHERE m = 0 UNION ALL SELECT k, document_id, 2 + i, t + 1200 * i FROM c, (VALUES (0), (1), (2)) AS v(i) WHERE m = 1)
SELECT document_id, k AS page_number, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k, place) - 1 AS INTEGER) AS ordinal, CAST(s AS INTEGER) AS char_start FROM x""")
def streamed_layouts(spark, d):
    """Pages that come in three parts, each in several batches of a file: chunk numbers run on as if all had come at once."""
    pages = laid_out(spark, d).select("document_id", "page_number", F.col("ocr_text").alias("text"), "tables", F.lit(0.1).alias("image_area_ratio"), F.lit(True).alias("has_text_layer"), F.lit(True).alias("has_table_hint"), F.lit(False).alias("table_extraction_failed"))
    most = pages.agg(F.max("page_number")).first()[0]
    folder = tables.work_folder(spark)
    for k in range(3):
        # a document's pages of a part are in one file, so files may be taken in any order
        pages.where(F.floor(F.col("page_number") * 3 / (most + 1)) == k).repartition(2, "document_id").write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        streams.drain(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/chunks").select("document_id", "page_number", "ordinal", "char_start")


def _runs(runs: list[tuple[str, int]], spark):
    """(what, n) of each run of a query, as a table beside its rows."""
    return spark.createDataFrame(runs, "what string, n bigint")


@query("SELECT 'page' AS what, o_orderkey AS page_number, CAST(o_totalprice AS DECIMAL(20,4)) AS price FROM orders WHERE o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 'page', max(o_orderkey), CAST(0 AS DECIMAL(20,4)) FROM orders UNION ALL SELECT 'rewritten by one changed page', 1, NULL UNION ALL SELECT 'rewritten by none', 0, NULL")
def stored_pages(spark, d):
    """Page telemetry stored in two overlapping runs, then with one page changed, then once more: buckets rewritten, and rows."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("page_number"), F.col("o_totalprice").cast("decimal(20,4)").alias("price"), F.lit(1).alias("at"))
    path, last = f"{tables.work_folder(spark)}/pages", rows.agg(F.max("page_number")).first()[0]
    stored.store_pages(path, rows.where("page_number % 3 < 2"), "at")
    stored.store_pages(path, rows.where("page_number % 3 > 0").unionByName(rows.where("page_number % 3 = 2").withColumns({"price": F.lit(-1).cast("decimal(20,4)"), "at": F.lit(0)})), "at")
    changed = rows.withColumn("price", F.when(F.col("page_number") == last, 0).otherwise(F.col("price")).cast("decimal(20,4)"))
    runs = [(name, len(stored.store_pages(path, changed, "at"))) for name in ("rewritten by one changed page", "rewritten by none")]
    kept = stored.read_stored(spark, path, "document_id string, page_number bigint, price decimal(20,4), at int")
    return kept.select(F.lit("page").alias("what"), "page_number", "price").union(_runs(runs, spark).select("what", "n", F.lit(None).cast("decimal(20,4)")))


@query("SELECT DISTINCT 'chunk' AS what, l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM lineitem UNION ALL SELECT 'rewritten by none', NULL, 0, NULL")
def stored_chunks(spark, d):
    """Chunks stored in two runs of which the second repeats the first: what is there stays; a third run writes nothing."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hash"), F.col("l_linenumber").cast("bigint").alias("n"))
    path = f"{tables.work_folder(spark)}/chunks"
    stored.store_chunks(path, rows.where("n % 2 = 0").withColumn("run", F.lit("first")))
    stored.store_chunks(path, rows.withColumn("run", F.lit("second")))
    runs = [("rewritten by none", len(stored.store_chunks(path, rows.withColumn("run", F.lit("third")))))]
    kept = stored.read_stored(spark, path, "document_id bigint, hash string, n bigint, run string")
    return kept.select(F.lit("chunk").alias("what"), F.col("document_id").alias("l_orderkey"), "n", "run").union(_runs(runs, spark).select("what", F.lit(None).cast("bigint"), "n", F.lit(None).cast("string")))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'changed words changed' ELSE text END AS text FROM documents), t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM d), p AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT 'chunk' AS what, d.doc_id AS chunk_id, count(w) AS lexemes, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n, CASE WHEN d.doc_id = (SELECT min(doc_id) FROM documents) THEN 'm2' ELSE 'm1' END AS model FROM d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id
UNION ALL SELECT 'rewritten by one changed chunk', NULL, NULL, 1, NULL UNION ALL SELECT 'rewritten by none', NULL, NULL, 0, NULL""")
def stored_index(spark, d):
    """The index of all documents, then with one of them changed under another model, then once more."""
    rows = tables.spread(table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    path, first = f"{tables.work_folder(spark)}/index", rows.agg(F.min("chunk_id")).first()[0]
    stored.store_index(path, rows, "m1", buckets=16)
    changed = rows.where(F.col("chunk_id") == first).withColumn("chunk_text", F.lit("changed words changed"))
    runs = [("rewritten by one changed chunk", len(stored.store_index(path, changed, "m2", buckets=16))), ("rewritten by none", len(stored.store_index(path, rows.where(F.col("chunk_id") != first), "m1", buckets=16)))]
    words = stored.read_stored(spark, f"{path}/postings", "chunk_id bigint, fts_config string, lexeme string, tf bigint").groupBy("chunk_id").agg(F.count("*").alias("lexemes"), F.sum("tf").alias("n"))
    vectors = stored.read_stored(spark, f"{path}/vectors", "chunk_id bigint, sha256 string, model string, tokens int, places array<int>, weights array<double>")
    kept = vectors.join(words, "chunk_id", "left").select(F.lit("chunk").alias("what"), "chunk_id", F.coalesce("lexemes", F.lit(0)).alias("lexemes"), F.coalesce("n", F.lit(0)).alias("n"), "model")
    return kept.union(_runs(runs, spark).select("what", F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "n", F.lit(None).cast("string")))


#: Forms of three words, and the stems that they share under English rules.
FORMS = [("downgrade", "downgrad"), ("downgraded", "downgrad"), ("downgrades", "downgrad"), ("ratings", "rate"), ("rating", "rate"), ("rate", "rate"), ("obligations", "oblig"), ("obligation", "oblig")]
STEMS = [("downgrading", "downgrad"), ("rating", "rate"), ("obligated", "oblig")]


@query(f"""WITH c AS (SELECT p_partkey AS k, [{", ".join(f"'{f}'" for f, _ in FORMS)}][p_partkey % 8 + 1] AS form, [{", ".join(f"'{t}'" for _, t in FORMS)}][p_partkey % 8 + 1] AS stem, 1 + p_size % 3 AS tf, p_partkey % 3 = 0 AS malay FROM part),
q AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}', '{t}')" for i, (w, t) in enumerate(STEMS))}) AS v(id, word, stem)), s AS (SELECT id, k, CASE WHEN malay THEN (CASE WHEN form = word THEN tf ELSE 0 END) + 1 WHEN c.stem = q.stem THEN tf ELSE 0 END AS hits FROM q, c),
r AS (SELECT id AS query_id, k AS chunk_id, hits / 10.0 AS score, row_number() OVER (PARTITION BY id ORDER BY hits DESC, k) AS rank FROM s WHERE hits > 0) SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200""")
def stemmed_search(spark, d):
    """Each chunk is searched as it was indexed: English ones by stems, without the stop word, Malay ones by the words."""
    k = F.col("p_partkey")
    words = F.concat(F.lit("The "), F.repeat(F.concat(_item([f for f, _ in FORMS], k % 8), F.lit(" ")), (1 + F.col("p_size") % 3).cast("int")))
    own = table(spark, d, "part").select(k.alias("chunk_id"), words.alias("chunk_text"), F.when(k % 3 == 0, "simple").otherwise("english").alias("fts_config"))
    asked = table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("int").alias("query_id"), F.concat(F.lit("the "), _item([w for w, _ in STEMS], F.col("n_nationkey"))).alias("question"))
    return retrieval.search_blocks(*retrieval.posting_blocks(retrieval.postings(own), 16), asked, 200, 16)


@query(f"""WITH d AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), i AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY 1, 2), q AS (SELECT DISTINCT item_id, unnest(list_slice({TOKENS}, 1, 2)) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(tf) AS BIGINT) AS hits FROM i JOIN q USING (w) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id AS query_id, doc_id AS chunk_id, CAST(hits / 10.0 AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def blocked_search(spark, d):
    """Questions of two words on an index of blocks that is written first and then read only as far as each floor."""
    words = F.array_join(F.slice(retrieval.terms(F.col("text")), 1, 2), " ")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("question"))
    index = tables.saved(retrieval.postings(tables.spread(table(spark, d, "documents")), "doc_id", "text"))
    blocks, directory = (tables.saved(df) for df in retrieval.posting_blocks(index))
    tables.discard(index)
    return retrieval.search_blocks(blocks, directory, asked)


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS queries, true AS enough")
def vector_index(spark, d):
    """Similar vectors by buckets of random projections, held against the exact leg over all queries."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("m").alias("model"))
    asked = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "model")
    found, _ = retrieval.vector_top_indexed(v, asked)
    return retrieval.recall(found, retrieval.vector_top(v, asked)).select((F.col("wanted") / 10).cast("bigint").alias("queries"), (F.col("recall") >= 0.9).alias("enough"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), b AS (SELECT doc_id AS chunk_id, CAST(CAST('0x' || left(sha256(w), 7) AS BIGINT) % 1024 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT *, 1 + ln(n) AS x FROM b) SELECT chunk_id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)), 9) AS weight FROM s")
def hashed_weights(spark, d):
    """Every weight of hashed vectors, with buckets by a hash that others have too."""
    number = lambda c: F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 7), 16, 10).cast("bigint")
    v = retrieval.hashed_embedding(table(spark, d, "documents"), "doc_id", "text", number=number)
    return v.withColumn("weight", F.round("weight", 9))


@query("SELECT p_brand AS document_id, p_partkey AS page_number FROM part WHERE p_partkey % 7 = 0")
def planted_span_faults(spark, d):
    """Chunks of which some are moved by a letter: those, and no others, are not what they say."""
    pages = laid_out(spark, d)
    found = chunks.chunk(pages, "ocr_text")
    moved = found.withColumn("char_start", F.col("char_start") + F.when((F.col("page_number") % 7 == 0) & (F.col("chunk_type") == "table"), 1).otherwise(0))
    return chunks.span_violations(moved, pages, "ocr_text").select("document_id", "page_number")


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity * 10 AS BIGINT) AS a, CAST(l_quantity * 10 + l_linenumber * 20 AS BIGINT) AS b, l_returnflag = 'R' AS r FROM lineitem)
SELECT x.k AS l_orderkey, x.n AS left_line, y.n AS right_line FROM s x JOIN s y ON x.k = y.k AND NOT x.r AND y.r AND x.a < y.b AND y.a < x.b""")
def overlapping_spans(spark, d):
    start = (F.col("l_quantity") * 10).cast("bigint")
    spans = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", start.alias("a"), (start + F.col("l_linenumber") * 20).alias("b"), (F.col("l_returnflag") == "R").alias("r"))
    left, right = spans.where("not r").withColumnRenamed("l_linenumber", "left_line"), spans.where("r").select("l_orderkey", F.col("l_linenumber").alias("right_line"), F.col("a").alias("c"), F.col("b").alias("e"))
    return overlapping(left, right, ["l_orderkey"], (F.col("a"), F.col("b")), (F.col("c"), F.col("e")), 100).select("l_orderkey", "left_line", "right_line")


@query("SELECT l_orderkey * 8 + l_linenumber AS document_id, 2 AS label_id, 1 AS prediction_id, 5 AS score FROM lineitem UNION SELECT l_orderkey * 8 + l_linenumber, 1, 2, 0 FROM lineitem")
def contested_labels(spark, d):
    """Both labels of a line would have the first prediction: the second has more in common with it, and takes it."""
    lines = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("document_id")).agg(F.max("l_extendedprice").alias("price"))
    amount = F.col("price").cast("decimal(20,4)")
    row = lambda id_, page, given: F.struct(F.lit(id_).alias("id"), F.lit(page).alias("page_number"), (amount if given else F.lit(None)).cast("decimal(20,4)").alias("threshold_amount"))
    none = {"threshold_ratio": "decimal(12,6)", "threshold_currency": "string", "operator": "string", "trigger_rating": "string", "rating_agency": "string"}

    def side(name, *rows):
        own = lines.select("document_id", F.lit("cross_default").alias("covenant_type"), F.explode(F.array(*rows)).alias("r")).select("document_id", "covenant_type", F.col("r.id").alias(name), "r.page_number", "r.threshold_amount")
        return own.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})

    found = evaluation.match_covenants(side("label_id", row(1, 1, False), row(2, 1, True)), side("prediction_id", row(1, 1, True), row(2, 2, True)))
    return found.select("document_id", "label_id", "prediction_id", "score")


@query("""WITH l AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS k, l_linenumber % 3 AS m FROM lineitem) SELECT k AS document_id, 1 AS label_id, CASE WHEN m = 1 THEN 1 ELSE 2 END AS prediction_id, CASE m WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS days FROM l UNION ALL SELECT k, 2, 1, 1 FROM l WHERE m = 2""")
def contested_calls(spark, d):
    """Two call labels and two predictions of each line. The first label takes the first prediction in reach, also where that
    leaves the second label without one; a row that a person entered is no prediction."""
    lines = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("document_id"), (F.col("l_linenumber") % 3).alias("m")).agg(F.to_date(F.min("l_shipdate")).alias("day"))
    label = lambda id_, after: F.struct(F.lit(id_).alias("label_id"), F.date_add("day", F.lit(after)).alias("call_date"))
    given = lambda id_, after, method: F.struct(F.lit(id_).alias("prediction_id"), F.date_add("day", after).alias("call_date"), method.alias("method"))
    m = F.col("m")
    labels = lines.select("document_id", F.explode(F.array(label(1, 0), label(2, 5))).alias("r")).select("document_id", "r.*")
    first = given(1, F.when(m == 1, 2).when(m == 2, 6).otherwise(1), F.when(m == 0, "human").otherwise("rule"))
    found = lines.select("document_id", F.explode(F.array(first, given(2, F.when(m == 2, 1).otherwise(0), F.lit("rule")))).alias("r")).select("document_id", "r.*")
    return evaluation.match_calls(found, labels)


@query("""WITH p AS (SELECT o_orderkey % 7 AS k, o_orderkey % 5 AS j, o_orderkey % 3 AS i FROM orders), m AS (SELECT 'call_date' AS field, k < 6 AS wanted, j < 4 AS given, k < 6 AND j < 4 AND i * 2 <= 3 AS ok FROM p UNION ALL SELECT 'rating_agency', true, j > 0, j > 0 AND i < 2 FROM p UNION ALL SELECT 'operator', k > 0, true, k > 0 AND i = 0 FROM p)
SELECT field, count(*) FILTER (WHERE ok) AS tp, count(*) FILTER (WHERE given AND NOT ok) AS fp, count(*) FILTER (WHERE wanted AND NOT ok) AS fn FROM m GROUP BY 1""")
def field_scores_by_kind(spark, d):
    """Dates three days apart at most, texts without case and outer spaces, vocabulary words as they are."""
    o, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    k, j, i = o % 7, o % 5, o % 3
    pairs = table(spark, d, "orders").select(
        F.when(k < 6, day).alias("label_call_date"), F.when(j < 4, F.date_add(day, (i * 2).cast("int"))).alias("prediction_call_date"),
        F.lit("Marc").alias("label_rating_agency"), F.when(j > 0, F.when(i == 0, " MARC ").when(i == 1, "marc").otherwise("RAM")).alias("prediction_rating_agency"),
        F.when(k > 0, "lte").alias("label_operator"), F.when(i == 0, "lte").when(i == 1, "LTE").otherwise("gte").alias("prediction_operator"))
    return evaluation.field_scores(pairs, {"call_date": "date", "rating_agency": "text", "operator": "enum"})


LINES = ["Is Bond zz{k} in breach?", "Which instruments are rated below {n}?", "What is the gearing of Bond zz{k}?", "Summarise it"]
_RATED = f"CASE WHEN instrument_id % 17 = 0 THEN 'NR' WHEN instrument_id % 4 = 0 THEN ns[r + 1] WHEN instrument_id % 4 = 1 THEN [{', '.join(repr(n) for n in _OTHER)}][r + 1] WHEN instrument_id % 4 = 2 THEN ns[r + 1] || ' (s)' ELSE lower(ns[r + 1]) || '  stable' END"


@query(f"""WITH {SQL_INST}, q AS (SELECT p_partkey AS k, p_partkey % 4 AS m, (p_partkey // 4) % 2 = 0 AS e, (p_partkey * 3) % 22 AS b, {SQL_NOTCHES} AS ns FROM part)
SELECT 'covenant_breach_check||' || k AS scope, k || ' rating_trigger c' || k AS item, 'rating_trigger ' || CASE WHEN r IS NULL THEN 'insufficient_data' WHEN r > t THEN 'breach ' WHEN r = t THEN 'at_risk ' ELSE 'ok ' END || coalesce(abs(r - t) || ' notches from ' || inst.ns[t + 1], '') AS line, CASE WHEN r IS NOT NULL THEN 'c' || k END AS cited FROM q JOIN inst ON instrument_id = k WHERE m = 0
UNION ALL SELECT DISTINCT 'instrument_lookup|' || q.ns[b + 1] || '|', CAST(instrument_id AS VARCHAR), 'Bond zz' || instrument_id || ' ' || {_RATED.replace("ns[", "inst.ns[")}, NULL FROM q JOIN inst ON r > b WHERE m = 1
UNION ALL SELECT 'covenant_lookup|gearing_ratio|' || k, 'c' || k, 'q p.1', 'c' || k FROM q WHERE m = 2 AND e UNION ALL SELECT 'passages||' || k, c, 'passage ' || c, c FROM q, (VALUES ('a'), ('b')) AS v(c) WHERE m = 3 OR m = 2 AND NOT e""")
def answer_lines(spark, d):
    """What answers are made of: the scope of each question that is answered, and every line of it with what it cites."""
    k = F.col("p_partkey")
    part = tables.spread(table(spark, d, "part"))
    asked = part.select(k.alias("query_id"), F.replace(F.replace(_item(LINES, k % 4), F.lit("{k}"), k.cast("string")), F.lit("{n}"), _item(NOTCHES, k * 3 % 22)).alias("question"))
    book = instruments(spark, d).withColumns({"instrument_name": F.concat(F.lit("Bond zz"), F.col("instrument_id").cast("string")), "issuer_name": F.lit(None).cast("string")})
    clause = F.concat(F.lit("c"), k.cast("string"))
    covenants = part.where(F.floor(k / 4) % 2 == 0).select(clause.alias("clause_id"), k.alias("instrument_id"), F.lit("gearing_ratio").alias("covenant_type"), F.lit("q").alias("source_quote"), F.lit(1).alias("page_number"), F.lit(0.9).alias("confidence"))
    terms = triggers(spark, d).where("source_clause_id is not null").select("instrument_id", F.col("source_clause_id").alias("clause_id"), F.lit("rating_trigger").alias("covenant_type"), "trigger_rating", "severity")
    hits = part.select(k.alias("query_id"), F.explode(F.array(*map(F.lit, "ab"))).alias("chunk_id")).withColumn("chunk_text", F.concat(F.lit("passage "), "chunk_id"))
    funds = table(spark, d, "customer").select(F.col("c_custkey").alias("portfolio_id"), F.col("c_name").alias("name"))
    _, scopes, lines = questions.answer(asked, book, funds, holdings(spark, d), covenants, terms, book.select("instrument_id", "current_rating"), hits)
    return lines.join(by_key(scopes.select("scope").distinct()), "scope").select("scope", "item", "line", "cited")


@query("SELECT 'id' AS asked, p_partkey AS instrument_id FROM part WHERE p_partkey = 7 UNION ALL SELECT 'isin', p_partkey FROM part WHERE p_size * 1000 + p_partkey % 1000 = 7007 UNION ALL SELECT 'isin and name', p_partkey FROM part WHERE p_size % 5 = 2 AND contains(lower(p_name), 'ring')")
def instruments_asked_for(spark, d):
    """Instruments by id, by ISIN, and by ISIN and a part of the name."""
    book, size = instruments(spark, d), F.col("p_size")
    isin = lambda number: book.withColumn("isin", F.concat(F.lit("MY"), number.cast("string")))
    found = [("id", portfolio.find_instruments(book, instrument_id=7)), ("isin", portfolio.find_instruments(isin(size * 1000 + F.col("instrument_id") % 1000), isin="MY7007")), ("isin and name", portfolio.find_instruments(isin(size % 5), isin="MY2", name="Ring"))]
    rows = [df.select(F.lit(name).alias("asked"), "instrument_id") for name, df in found]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"WITH {SQL_INST} SELECT instrument_id, 'rating_trigger' AS covenant_type, ns[t + 1] AS trigger_rating, CAST(r - t AS INTEGER) AS below FROM inst WHERE r > t")
def breach_rows(spark, d):
    """Only what is in breach: not what is at risk, nor what cannot be judged."""
    terms = triggers(spark, d).where("source_clause_id is null").select("instrument_id", "trigger_rating", "severity").withColumn("covenant_type", F.lit("rating_trigger"))
    judged = rules.evaluate(terms.join(instruments(spark, d).select("instrument_id", "current_rating"), "instrument_id"))
    return rules.breaches(judged).select("instrument_id", "covenant_type", "trigger_rating", notches_between(F.col("current_rating"), F.col("trigger_rating")).alias("below"))


@query("""WITH w AS (SELECT p_partkey, unnest([x for x in list_distinct(list_concat(regexp_extract_all(lower(p_name), '[a-z]+'), CASE p_partkey % 6 WHEN 0 THEN ['should', 'buy'] WHEN 3 THEN ['limit'] WHEN 5 THEN ['summarise'] ELSE [] END)) if length(x) >= 2]) AS word FROM part), n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS x FROM part WHERE p_size > 49)
SELECT p_partkey AS query_id, word FROM w WHERE word NOT IN (SELECT x FROM n) OR word IN ('should', 'buy', 'limit', 'summarise')""")
def unknown_word_list(spark, d):
    """The words themselves that no name and no vocabulary of a question has."""
    names = table(spark, d, "part").where("p_size > 49").select(F.col("p_name").alias("name"))
    found = questions.unsupported_terms(asked(spark, d), names, ["breach", "exposure", "maturity", "gearing"])
    return found.select("query_id", F.explode("unsupported").alias("word"))


@query(f"""WITH d AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), i AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY 1, 2), q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS w FROM benchmark), s AS (SELECT item_id AS q, doc_id AS c, sum(tf) AS x FROM i JOIN q USING (w) GROUP BY 1, 2),
k AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY x DESC, c) AS n FROM s), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.e, b.e) AS x FROM e a JOIN benchmark ON item_id = a.vec_id, e b),
v AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(x, 9) DESC, c) AS n FROM t), f AS (SELECT q, c, sum(1.0 / (60 + n)) AS x FROM (SELECT * FROM k WHERE n <= 40 UNION ALL SELECT * FROM v WHERE n <= 40) GROUP BY 1, 2), r AS (SELECT q AS query_id, c AS chunk_id, CAST(row_number() OVER (PARTITION BY q ORDER BY round(x, 12) DESC, c) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""")
def hybrid_search(spark, d):
    """Both legs over whole tables, words of the documents and vectors of the same ids, fused by rank."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("m").alias("model"))
    queries = items.join(v.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    index = retrieval.postings(tables.spread(table(spark, d, "documents")), "doc_id", "text", retrieval.asked_terms(items).select("fts_config", "lexeme").distinct())
    return retrieval.hybrid(index, v, queries).select("query_id", "chunk_id", "rank")
