"""Literal cases and invariants of the covenant operators."""

import datetime as dt
import random
import re
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.functions import alignment, dates, joins, ratings, stemming, text
from pactum.operators import chunks, evaluation, extraction, ledger, portfolio, questions, retrieval, review, rules, verify
from pactum.plans import books
from pactum.sources import stored, tables


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


def test_ratings(spark):
    raw = ["AA1", "AA3", "A2", "BBB3", "AA1(s)", "AA-  stable", "aaa (cg)", "AAA1", "D2", "NR", "", None, "A+ watch negative", "bb "]
    assert column(spark, raw, ratings.normalise) == ["AA+", "AA-", "A", "BBB-", "AA+", "AA-", "AAA", None, None, None, None, None, "A+", "BB"]
    assert column(spark, ["AAA", "AA1", "D", "x"], ratings.rank) == [0, 1, 21, None]


def test_dates(spark):
    day = lambda s: dt.date.fromisoformat(s)
    add = lambda d, n: column(spark, [day(d)], lambda c: dates.add_business_days(c, F.lit(n)), "date")[0]
    assert add("2026-08-05", 5) == day("2026-08-12") and add("2026-08-07", 1) == day("2026-08-10") and add("2026-08-08", 1) == day("2026-08-10") and add("2026-08-05", -1) is None
    between = lambda a, b: column(spark, [day(a)], lambda c: dates.business_days_between(c, F.lit(b).cast("date")), "date")[0]
    assert between("2026-08-05", "2026-08-12") == 5 and between("2026-08-12", "2026-08-05") == -5
    rng = random.Random(4)
    for _ in range(60):
        a = day("2026-01-01") + dt.timedelta(rng.randrange(400))
        n, at = rng.randrange(0, 20), None
        at, left = a, n
        while left:
            at += dt.timedelta(1)
            left -= at.weekday() < 5
        assert add(a.isoformat(), n) == at
    assert column(spark, [day("2026-08-21")], lambda c: dates.is_overdue(c, F.lit("2026-08-21").cast("date")), "date") == [False]
    assert column(spark, [day("2026-08-07")], lambda c: dates.grace_period_end(c, F.lit(14)), "date") == [day("2026-08-21")]
    calls = spark.createDataFrame([("a", day(f"{y}-06-15")) for y in (2028, 2029, 2030)], "instrument_id string, call_date date")
    assert portfolio.next_calls(calls, "2028-06-16").first()[1] == day("2029-06-15") and portfolio.next_calls(calls, "2031-01-01").first()[1] is None


def test_money(spark):
    cases = {"RM30,000,000": (30000000, "MYR"), "RM30 million": (30000000, "MYR"), "RM30m": (30000000, "MYR"), "RM30 juta": (30000000, "MYR"), "ringgit 30 million": (30000000, "MYR"), "RM1.2 bilion": (1200000000, "MYR"), "USD10 million": (10000000, "USD"), "within 14 days": None, "": None}
    got = column(spark, list(cases), text.largest_money)
    assert [None if r is None else (int(r["amount"]), r["currency"]) for r in got] == list(cases.values())
    both = "RM30 million or USD40 million"
    assert column(spark, [both], lambda c: text.largest_money(c, "MYR"))[0]["amount"] == 30000000
    mention = column(spark, [both], text.money_mentions)[0][1]
    assert both[mention["start"] : mention["end"]] == mention["raw"] == "USD40 million"


def test_language_and_quality(spark):
    assert column(spark, ["the issuer shall not", "yang dan untuk syarikat", "the yang", "Issuer", None], text.language) == ["en", "ms", "unknown", "unknown", "unknown"]
    assert column(spark, ["ab(cid:12)", "", "ab\n", "a​b�"], text.garbled_ratio) == [0.8, 0.0, 0.0, 0.5]
    assert column(spark, ["", "a b c", "x" * 300], text.token_estimate) == [0, 4, 100]
    page = spark.createDataFrame([("d", 1, "x" * 200, 0.1, True, False, False), ("d", 2, "", 0.95, False, True, True)], "document_id string, page_number int, text string, image_area_ratio double, has_text_layer boolean, has_table_hint boolean, table_extraction_failed boolean")
    got = {r.page_number: r for r in chunks.assess_pages(page).collect()}
    assert got[1].confidence == 1.0 and not got[1].needs_vlm and got[2].confidence == 0.0 and got[2].reasons == ["no_text_layer", "low_char_count", "high_image_area", "table_extraction_failed"]
    assert chunks.document_quality(chunks.assess_pages(page)).first().parse_confidence == 0.5


def loop_split(body, most):
    """From each start the last sentence end within reach, or as far as it goes if there is none."""
    ends, out, at = [m.end() for m in re.finditer(r"[.!?;]\s+|$", body)], [], 0
    while at < len(body):
        stop = max([e for e in ends if at < e <= at + most], default=at + most)
        piece = body[at:stop]
        out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
        at = stop
    return out


def test_chunking(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "covenant", "of"]) for _ in range(n))
    body = " ".join(words(rng.randrange(3, 60)) + rng.choice([".", ";", "!"]) for _ in range(40)) + " " + "z" * 3000
    page = f"1. FINANCIAL COVENANTS\n\n{words(30)}.\n \n{words(20)}.\n\n{body}\n\nNEGATIVE PLEDGE\n\n{words(10)}."
    rows = [("d", 1, page, []), ("d", 2, page, [(0, 22)]), ("e", 1, None, []), ("e", 2, " \n\n ", []), ("f", 1, "same words", []), ("f", 2, "same words", [])]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string, tables array<struct<start:int,end:int>>")
    got = chunks.chunk(pages)
    assert chunks.span_violations(got, pages).count() == 0
    own = got.where("document_id = 'd' and page_number = 1").orderBy("ordinal").collect()
    assert all(page[r.char_start : r.char_end] == r.chunk_text and len(r.chunk_text) <= 1200 for r in own)
    assert own[0].chunk_text.startswith("1. FINANCIAL") and own[0].section_title == "1. FINANCIAL COVENANTS" and own[-1].section_title == "NEGATIVE PLEDGE" and own[-1].chunk_text.startswith("NEGATIVE")
    start = page.index(body)
    pieces = [(a + start, b + start) for a, b in loop_split(body, 1200)]
    ends = {r.char_end for r in own}
    assert all(b in ends for _, b in pieces[1:])
    assert [r.chunk_type for r in got.where("document_id = 'd' and page_number = 2").orderBy("ordinal").collect()][0] == "table"
    assert got.where("document_id = 'e'").count() == 0 and got.where("document_id = 'f'").select("hash").distinct().count() == 2
    assert [r.ordinal for r in got.where("document_id = 'd'").orderBy("ordinal").collect()] == list(range(got.where("document_id = 'd'").count()))
    later = chunks.chunk(pages.where("document_id = 'f'"), after=got)
    assert sorted(r.ordinal for r in later.collect()) == [2, 3]


FACTS = "instrument_id string, covenant_type string, operator string, threshold_ratio decimal(12,6), threshold_amount decimal(20,4), threshold_currency string, trigger_rating string, severity string, gearing_ratio decimal(12,6), interest_cover decimal(12,6), finance_service_cover decimal(12,6), net_worth decimal(20,4), current_rating string, accelerated_indebtedness decimal(20,4), disposals_value decimal(20,4), distributions_value decimal(20,4), security_created boolean, security_is_permitted boolean, change_of_control boolean, shariah_compliant boolean, currency string"
NAMES = [f.split()[0] for f in FACTS.split(", ")]


def judged(spark, *cases):
    rows = [tuple({"instrument_id": str(k), "severity": "medium", "currency": "MYR", **c}.get(n) for n in NAMES) for k, c in enumerate(cases)]
    return sorted(rules.evaluate(spark.createDataFrame(rows, FACTS)).collect(), key=lambda r: int(r.instrument_id))


def test_rules(spark):
    gear = lambda x, **kw: {"covenant_type": "gearing_ratio", "threshold_ratio": D("1.75"), "gearing_ratio": D(x), **kw}
    got = judged(
        spark, gear("1.20"), gear("1.90"), gear("1.75"), gear("1.70"), gear("1.75", operator="lt"), gear("1.90", operator="gte"),
        {"covenant_type": "interest_cover", "threshold_ratio": D("3"), "interest_cover": D("2.9")},
        {"covenant_type": "minimum_net_worth", "threshold_amount": D(500), "threshold_currency": "USD", "net_worth": D(900)},
        {"covenant_type": "minimum_net_worth", "threshold_amount": D(500), "threshold_currency": "MYR", "net_worth": D(900)},
        {"covenant_type": "disposal_restriction", "threshold_amount": D(100), "threshold_currency": "USD", "disposals_value": D(50)},
        {"covenant_type": "cross_default", "threshold_amount": D(100), "accelerated_indebtedness": D(100)},
        {"covenant_type": "rating_trigger", "trigger_rating": "BBB", "current_rating": "BBB2"},
        {"covenant_type": "rating_trigger", "trigger_rating": "A", "current_rating": "A-"},
        {"covenant_type": "rating_trigger", "trigger_rating": "BBB", "current_rating": "BBB1"},
        {"covenant_type": "rating_trigger", "trigger_rating": "BBB", "current_rating": "??"},
        {"covenant_type": "negative_pledge", "security_created": True, "security_is_permitted": True},
        {"covenant_type": "negative_pledge", "security_created": True},
        {"covenant_type": "shariah_non_compliance", "shariah_compliant": False},
        {"covenant_type": "change_of_control", "change_of_control": True},
        {"covenant_type": "other"},
    )
    assert [r.status for r in got] == ["ok", "breach", "at_risk", "at_risk", "breach", "ok", "breach", "insufficient_data", "ok", "ok", "breach", "at_risk", "breach", "ok", "insufficient_data", "ok", "breach", "breach", "breach", "not_applicable"]
    assert [got[k].headroom for k in (0, 1)] == [D("0.55"), D("-0.15")] and got[12].headroom == -1
    assert [got[k].severity for k in (12, 16, 17, 18)] == ["high", "high", "critical", "high"]
    board = [(r[0], r[1]) for r in rules.breach_board(rules.evaluate(spark.createDataFrame([("x", "other"), ("y", "other")], "instrument_id string, covenant_type string"))).collect()]
    assert board == [("x", 0), ("y", 0)]


def test_no_type_is_ok_on_missing_facts(spark):
    kinds = [*rules.RATIOS, *rules.CAPS, "minimum_net_worth", "cross_default", "rating_trigger", "negative_pledge", "shariah_non_compliance", "change_of_control", "other"]
    got = judged(spark, *[{"covenant_type": k, "threshold_ratio": D(1), "threshold_amount": D(1), "trigger_rating": "A"} for k in kinds])
    assert all(r.status in ("insufficient_data", "not_applicable") for r in got)


def test_terms_from_strings(spark):
    rows = spark.createDataFrame([("a", "1.5", None, None), ("b", "x", None, None), ("c", None, "10", None), ("d", None, "10", "MYR")], "id string, threshold_ratio string, threshold_amount string, threshold_currency string")
    good, bad = rules.checked_terms(rows)
    assert sorted(r.id for r in good.collect()) == ["a", "d"] and {r.id: r.reason for r in bad.collect()} == {"b": "ratio is no number", "c": "amount without currency"}


PROSE = [
    "FINANCIAL COVENANTS\n\nThe Issuer shall maintain a gearing ratio of not more than 1.75 times, and a finance service cover ratio of not less than 1.50 times. More text follows here.",
    "CROSS DEFAULT\n\nAny indebtedness exceeding RM30,000,000 (or its equivalent) becomes due and payable prior to its stated maturity within 14 days.",
    "If the rating assigned by MARC is downgraded below BBB+ the profit rate steps up.",
    "Penerbit hendaklah mengekalkan nisbah gearan yang tidak melebihi 1.75 kali pada setiap masa. Ketidakpatuhan Shariah adalah kejadian pembubaran.",
    "If the rating is lowered below BBB- then it is bad. 2028-06-15 102.00 Optional\n2029-06-15 101.00\n2028-06-15 102.00",
    "Nothing to see.",
]


def prose(spark):
    return spark.createDataFrame([("d", 1, k, t, f"h{k}") for k, t in enumerate(PROSE)], "document_id string, page_number int, ordinal int, chunk_text string, hash string")


def test_extraction(spark):
    got = {(r.hash, r.pattern_id): r for r in extraction.extract(prose(spark)).collect()}
    for r in got.values():
        assert PROSE[int(r.hash[1:])][r.char_start : r.char_end] == r.quote
    assert got["h0", "gearing_ratio_en"].threshold_ratio == D("1.75") and got["h0", "gearing_ratio_en"].operator == "lte"
    assert got["h0", "finance_service_cover_en"].operator == "gte"
    assert got["h1", "cross_default_en"].threshold_amount == 30000000 and sum(k[0] == "h1" for k in got) == 1
    assert got["h2", "rating_trigger_en"].trigger_rating == "BBB+" and got["h2", "rating_trigger_en"].rating_agency == "MARC"
    assert got["h4", "rating_trigger_en"].rating_agency == "MARC"  # the only agency of the document
    assert got["h3", "gearing_ratio_ms"].operator == "lte" and got["h3", "shariah_non_compliance"].severity == "critical" and ("h3", "dissolution_event") in got
    assert not any(k[0] == "h5" for k in got)
    calls = sorted((str(r.call_date), r.call_price, r.call_type) for r in extraction.call_schedule(prose(spark)).collect())
    assert calls == [("2028-06-15", D(102), "optional"), ("2029-06-15", D(101), "optional")]
    spans = extraction.candidates(prose(spark)).collect()
    assert {r.hash for r in spans} == {"h0", "h1", "h2", "h3", "h4"} and all(r.start == 0 for r in spans)


def test_greedy_overlaps(spark):
    rows = [("h", "c", "t", 0.9, 0, 10, "a", 0), ("h", "c", "t", 0.8, 5, 20, "b", 5), ("h", "c", "t", 0.7, 15, 30, "c", 15), ("h", "c", None, 0.5, 0, 10, "d", 0)]
    table = spark.createDataFrame(rows, "hash string, clause_type string, covenant_type string, confidence double, char_start int, char_end int, pattern_id string, at int").withColumn("m", F.struct(F.col("at").alias("start"), F.lit(0).alias("end"))).drop("at")
    assert sorted(r.pattern_id for r in extraction.drop_overlaps(table).collect()) == ["a", "c", "d"]


def test_gate_and_review(spark):
    rows = spark.createDataFrame([("d", "h", "cross_default", "cross_default", 0, 0.9, D(200000000), True, "i", None), ("d", "h", "other", "other", 9, 0.9, None, False, "i", None), ("d", "h", "rating_trigger", "rating_trigger", 20, 0.8, None, True, "i", "A")], "document_id string, hash string, clause_type string, covenant_type string, char_start int, confidence double, threshold_amount decimal(20,4), verified boolean, instrument_id string, trigger_rating string")
    out = extraction.persist_gate(rows)
    assert out["clauses"].count() == 2 and out["covenants"].count() == 2 and out["rating_triggers"].count() == 1
    assert sorted(r.trigger_reason for r in out["reviews"].collect()) == ["high_value", "low_confidence", "unverified_quote"]
    records = spark.createDataFrame([("a", '{"source_quote": "q", "confidence": 0.5}'), ("b", '{"source_quote": " ", "confidence": 2, "threshold_amount": "5", "trigger_rating": "A"}'), ("c", "no json")], "record_id string, payload string")
    got = {r.record_id: len(r.violations) for r in extraction.validate_records(records).collect()}
    assert got == {"a": 0, "b": 4, "c": 2}


def test_quotes(spark):
    chunk = "The Issuer shall not create or permit to subsist any security interest over the whole of its “present” assets – ever."
    quotes = ["shall not create", 'its "present" assets - ever', "the  whole\nof its", "shall not create or permit to subsist any security interest[1] over the whole of", "shall gladly create or promise to insist on every security blanket over nothing", "", None, "absent"]
    rows = spark.createDataFrame([(k, q, chunk) for k, q in enumerate(quotes)], "k int, quote string, chunk_text string")
    got = sorted(verify.verify(rows).collect(), key=lambda r: r.k)
    assert [r.method for r in got] == ["exact", "normalised", "normalised", "fuzzy", "not_found", "empty", "empty", "not_found"]
    assert chunk[got[1].char_start : got[1].char_end] == "its “present” assets – ever" and 0.92 <= got[3].score < 1
    assert [r.method for r in sorted(verify.verify(rows, ("exact", "normalised")).collect(), key=lambda r: r.k)][3] == "not_found"


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "gearing ratio covenant"), (2, "covenant covenant"), (3, "nothing"), (4, "")], "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(1, "covenant gearing?"), (2, "?!"), (3, "zzz")], "query_id long, question string")
    found = retrieval.keyword_top(retrieval.postings(docs), asked).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in found] == [(1, 1, 0.2), (1, 2, 0.2)]
    legs = [spark.createDataFrame(r, "query_id long, chunk_id long, rank int") for r in ([(1, 1, 1), (1, 2, 2)], [(1, 2, 2), (1, 3, 1)])]
    assert [r.chunk_id for r in retrieval.fuse(legs).orderBy("rank").collect()] == [2, 1, 3]
    v = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.0, 1.0], "m"), (3, [1.0, 0.0], "old"), (4, [0.0, 0.0], "m")], "chunk_id long, embedding array<double>, model string")
    top = retrieval.vector_top(v, spark.createDataFrame([(9, [2.0, 0.1], "m")], "query_id long, embedding array<double>, model string")).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == [1, 2]
    weights = retrieval.hashed_embedding(docs).groupBy("chunk_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(weights) == 3 and all(abs(r.n - 1) < 1e-9 for r in weights)
    assert retrieval.model_mismatch(v, "m").count() == 1 and retrieval.wrong_dimensions(v, 2).count() == 0


def test_evaluation(spark):
    scored = spark.createDataFrame([("d", 1, 1, 5), ("d", 1, 2, 5), ("d", 2, 1, 4), ("d", 2, 2, 1)], "document_id string, label_id int, prediction_id int, score int")
    for most in (20_000, 0):
        assert sorted((r.label_id, r.prediction_id) for r in evaluation.greedy_matches(scored, ["document_id"], most).collect()) == [(1, 1), (2, 2)]
    pairs = spark.createDataFrame([(D("100"), D("100.4")), (D("100"), D("102")), (None, D("1")), (D("1"), None), (None, None), (D("0"), D("0"))], "label_x decimal(20,4), prediction_x decimal(20,4)")
    got = evaluation.with_rates(evaluation.field_scores(pairs, {"x": "number"})).first()
    assert (got.tp, got.fp, got.fn) == (2, 2, 2) and got.f1 == 0.5
    calls = spark.createDataFrame([("d", dt.date(2028, 6, 17), "rule", 1), ("d", dt.date(2028, 6, 15), "human", 2)], "document_id string, call_date date, method string, prediction_id int")
    labels = spark.createDataFrame([("d", dt.date(2028, 6, 15), 7)], "document_id string, call_date date, label_id int")
    assert [(r.label_id, r.prediction_id) for r in evaluation.match_calls(calls, labels).collect()] == [(7, 1)]
    golden = spark.createDataFrame([(1, ["1.75"], 1, False), (2, [], 0, True), (3, ["x"], 1, False)], "question_id int, must_contain array<string>, min_citations int, expect_refusal boolean")
    answers = spark.createDataFrame([(1, "not more than 1.75 times", 2, False, True), (2, None, 0, True, None)], "question_id int, answer string, citations int, refused boolean, faithful boolean")
    report = evaluation.answer_report(evaluation.score_answers(answers, golden)).first()
    assert (report.passed, report.questions, report.refusal_precision, report.refusal_recall) == (2, 3, 1.0, 1.0)
    tally = evaluation.citation_tally(spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "reverified boolean, evidence_matched boolean"), spark.range(2)).first()
    assert tally.recall == 0.5
    assert (tally.verification_rate, tally.precision) == (0.5, 0.25)


def test_ledger(spark):
    rows = spark.createDataFrame([("llm", False), ("llm", True), ("rule", None)], "method string, disagrees boolean")
    assert ledger.agreement(rows).first().agreement == 0.5 and ledger.agreement(rows.limit(0)).first().agreement is None
    calls = spark.createDataFrame([(1, "m", 1000000, 0), (2, "??", 5, 5)], "call_id int, model_id string, prompt_tokens int, completion_tokens int")
    prices = spark.createDataFrame([("m", D("5"), D("25"))], "model_id string, input_usd decimal(10,4), output_usd decimal(10,4)")
    priced, unpriced = ledger.price(calls, prices)
    assert priced.first().cost_usd == 5 and [r.call_id for r in unpriced.collect()] == [2]


def test_review(spark):
    reviews = spark.createDataFrame([("r1", "covenant", "e1", "1", None, "pending"), ("r2", "covenant", "e2", "1", None, "approved")], "review_id string, entity_type string, entity_id string, old_value string, new_value string, status string")
    when = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    made = spark.createDataFrame([("r1", "corrected", "2", "ann", when(2)), ("r1", "approved", None, "bob", when(5)), ("r2", "rejected", None, "cat", when(1)), ("r9", "approved", None, "dan", when(1))], "review_id string, decision string, new_value string, reviewer string, decided_at timestamp")
    after, conflicts, audit = review.apply_decisions(reviews, made)
    got = {r.review_id: r for r in after.collect()}
    assert (got["r1"].status, got["r1"].new_value, got["r1"].old_value, got["r1"].reviewer) == ("corrected", "2", "1", "ann") and got["r2"].status == "approved"
    assert sorted((r.review_id, r.reviewer) for r in conflicts.collect()) == [("r1", "bob"), ("r2", "cat"), ("r9", "dan")]
    assert [(r.action, r.actor) for r in audit.collect()] == [("review_corrected", "ann")]
    rows = spark.createDataFrame([(1, 0.5, None, True, None), (2, 2.0, 1.0, False, None)], "id int, confidence double, citation_match_score double, citation_verified boolean, char_end int").withColumn("char_start", F.lit(0))
    assert sorted((r.id, r.rule) for r in review.violations(rows, review.CONSTRAINTS["clauses"], "id").collect()) == [(1, "verified_has_score"), (2, "confidence_range")]
    docs, pages = spark.createDataFrame([("d",), ("e",)], "document_id string"), spark.createDataFrame([("d", True), ("d", False)], "document_id string, needs_vlm boolean")
    own = spark.createDataFrame([("d", [1.0])], "document_id string, embedding array<double>")
    jobs = spark.createDataFrame([("d", "failed", "late", when(3)), ("d", "failed", "first", when(1)), ("d", "succeeded", None, when(0))], "document_id string, status string, error string, created_at timestamp")
    status = {r.document_id: r for r in review.document_status(docs, pages, own, jobs).collect()}
    assert (status["d"].pages, status["d"].flagged_pages, status["d"].first_error, status["d"].searchable, status["d"].terminal) == (2, 1, "first", True, True) and not status["e"].searchable


def test_loading(spark):
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.7 x")), ("b", bytearray(b"zip")), ("c", bytearray(b"")), ("d", None)], "path string, content binary")
    good, bad = tables.admit(files)
    assert [r.path for r in good.collect()] == ["a"] and {r.path: r.reason for r in bad.collect()} == {"b": "not the right format", "c": "empty", "d": "empty"}
    clauses = spark.createDataFrame([("c1", "d", "pending"), ("c2", "d", "approved"), ("c3", "e", None)], "clause_id string, document_id string, review_status string")
    reviews = spark.createDataFrame([("c1", "pending"), ("c1", "approved"), ("c2", "pending")], "entity_id string, status string")
    kept, left = tables.replace_machine_output(clauses, spark.createDataFrame([("n1", "d")], "clause_id string, document_id string"), reviews, spark.createDataFrame([("d",)], "document_id string"))
    assert sorted(r.clause_id for r in kept.collect()) == ["c2", "c3", "n1"] and sorted(map(tuple, left.collect())) == [("c1", "approved"), ("c2", "pending")]
    assert tables.publish_views({"covenants": spark.createDataFrame([("c", "secret")], "covenant_id string, notes string"), "llm_calls": reviews}) == ["covenants"]
    assert spark.table("covenants").columns == ["covenant_id"]


def test_portfolio(spark):
    chunks_ = spark.createDataFrame([("d", 0, "issued by  Acme\nHoldings BERHAD"), ("e", 0, "Acme Holdings Berhad and Beta Sdn Bhd"), ("f", 0, "nobody")], "document_id string, ordinal int, chunk_text string")
    names = spark.createDataFrame([("i1", "Acme Holdings Berhad"), ("i2", "Beta Sdn Bhd")], "instrument_id string, issuer_name string")
    assert [(r.document_id, r.instrument_id) for r in portfolio.link_issuers(chunks_, names).collect()] == [("d", "i1")]
    clauses = spark.createDataFrame([("c1", "h", "gearing")], "clause_id string, source_chunk_id string, source_quote string")
    own = portfolio.provenance(clauses, spark.createDataFrame([("h", "the gearing ratio")], "hash string, chunk_text string"), spark.createDataFrame([("c1", "gearing_ratio")], "clause_id string, covenant_type string")).first()
    assert (own.quote_start, own.quote_end, own.covenants) == (4, 11, ["gearing_ratio"])


def test_quotes_with_compatible_characters(spark):
    """Ligatures and full-width letters in quotes too short to align, and where they stand in the chunk as it is."""
    rows = [(1, "\ufb01nal amount", "The final  amount is due"), (2, "final amount", "The \ufb01nal amount is due"), (3, "\uff32\uff2d 5", "of RM 5 million"), (4, "\uff32\uff2d 6", "of RM 5 million"), (5, "caf\u00e9", None)]
    got = {r.id: r for r in verify.verify(spark.createDataFrame(rows, "id int, quote string, chunk_text string")).collect()}
    assert [got[k].method for k in (1, 2, 3, 4, 5)] == ["normalised", "normalised", "normalised", "not_found", "not_found"]
    assert [rows[k - 1][2][got[k].char_start : got[k].char_end] for k in (1, 2, 3)] == ["final  amount", "\ufb01nal amount", "RM 5"]


def test_questions(spark):
    asked = ["Which holdings trip their rating trigger?", "Should we buy it?", "How much NAV is below A?", "What is the gearing covenant?", "Which instruments are rated below AA3?", "Green Ijarah", ""]
    assert column(spark, asked, questions.intent) == ["covenant_breach_check", "unsupported", "portfolio_query", "covenant_lookup", "instrument_lookup", "instrument_lookup", "unsupported"]
    assert column(spark, asked, questions.rating_threshold_in) == [None, None, "A", None, "AA-", None, None]
    names = spark.createDataFrame([("RM300m Green Ijarah Sukuk",), ("RM500m Blue Ijarah Sukuk",), ("Acme Berhad",)], "name string")
    rows = spark.createDataFrame([(1, "what about the Green Ijarah Sukuk"), (2, "the Ijarah Sukuk"), (3, "is acme berhad fine")], "query_id int, question string")
    got = sorted(map(tuple, questions.mentioned_entities(rows, names).collect()))
    assert got == [(1, "RM300m Green Ijarah Sukuk"), (3, "Acme Berhad")]
    files = spark.createDataFrame([("Dubai_12B_Base_Prospectus_1.pdf",), ("Selangor_Trust_Deed.pdf",)], "filename string")
    said = spark.createDataFrame([(1, "the Dubai prospectus"), (2, "a trust deed"), (3, "12b 1")], "query_id int, question string")
    assert sorted(map(tuple, questions.mentioned_documents(said, files, ["prospectus", "base", "trust", "deed", "pdf"]).collect())) == [(1, "Dubai_12B_Base_Prospectus_1.pdf"), (3, "Dubai_12B_Base_Prospectus_1.pdf")]


@pytest.mark.parametrize("name", ["instruments", "portfolio_holdings"])
def test_readable_columns_exist(name):
    assert len(set(tables.READABLE[name])) == len(tables.READABLE[name])


def test_answers_by_intent(spark):
    said = ["what is our exposure by portfolio", "which instruments are rated below AA", "what is the gearing covenant", "find the weather of kuala lumpur", "should we buy", "what is our exposure to weather", "which instruments are rated below BBB", "is Blue Sukuk in breach", "which are in breach", "what is the exposure of Growth Fund rated below AA", "what is the negative pledge of Green Sukuk", "what is the cross default"]
    asked = spark.createDataFrame(list(enumerate(said, 1)), "query_id int, question string")
    instruments = spark.createDataFrame([("i", "Green Sukuk", None, "A1"), ("j", "Blue Sukuk", None, "AAA"), ("k", "Red Bond", None, "NR")], "instrument_id string, instrument_name string, issuer_name string, current_rating string")
    funds = spark.createDataFrame([("p", "Growth Fund"), ("q", "Other Fund")], "portfolio_id string, name string")
    held = spark.createDataFrame([("p", "i", D(5)), ("p", "i", None), ("q", "i", D(7)), ("q", "j", D(1))], "portfolio_id string, instrument_id string, market_value decimal(20,4)")
    covenants = spark.createDataFrame([("c1", "i", "gearing_ratio", "not more than 1.75 times", 3, 0.9), ("c2", "j", "gearing_ratio", "not more than 2 times", 4, 0.8)], "clause_id string, instrument_id string, covenant_type string, source_quote string, page_number int, confidence double")
    terms = spark.createDataFrame([("i", "c1", "rating_trigger", "AA", "high"), ("j", "c2", "rating_trigger", "AAA", "high"), ("k", "c3", "rating_trigger", "A", "high")], "instrument_id string, clause_id string, covenant_type string, trigger_rating string, severity string")
    hits = spark.createDataFrame([(4, "h", "rain in kuala lumpur"), (11, "h", "a pledge")], "query_id int, chunk_id string, chunk_text string")
    answers, scopes, lines = questions.answer(asked, instruments, funds, held, covenants, terms, instruments.select("instrument_id", "current_rating"), hits)
    got = {r.query_id: r for r in answers.collect()}
    text = {}
    for r in scopes.join(lines, "scope").collect():
        text.setdefault(r.query_id, set()).add(r.line)
    assert text[1] == {"p 2 5.0000", "q 2 8.0000"} and got[1].confidence == 0.95 and not got[1].refused
    assert text[2] == {"Green Sukuk A1"} and got[2].headline == "1 instrument(s) rated below AA." and 7 not in text and got[7].refused
    assert text[3] == {"not more than 1.75 times p.3", "not more than 2 times p.4"} and got[3].citations == 2 and got[3].confidence == 0.8
    assert text[4] == {"rain in kuala lumpur"} and got[4].confidence == 0.55 and not got[4].refused
    assert all(got[k].refused and got[k].confidence == 0 and got[k].headline is None for k in (5, 6, 12))
    assert got[8].headline == "No covenant breach(es), 0 not evaluated." and got[8].n_lines == 1 and got[8].citations == 1
    assert got[9].headline == "1 covenant breach(es), 1 not evaluated." and got[9].n_lines == 2
    assert text[10] == {"p 2 5.0000"} and got[11].confidence == 0.55 and text[11] == {"a pledge"}


def test_book_and_backlogs(spark):
    held = spark.createDataFrame([("p", "i"), ("q", "i"), ("p", "j")], "portfolio_id string, instrument_id string")
    covenants = spark.createDataFrame([("i", "gearing_ratio", D("1.75"), "medium"), ("z", "gearing_ratio", D("1"), "medium")], "instrument_id string, covenant_type string, threshold_ratio decimal(12,6), severity string")
    triggers = spark.createDataFrame([("i", "BBB", "high"), ("j", "A", "high")], "instrument_id string, trigger_rating string, severity string")
    facts = spark.createDataFrame([("i", D("1.9"), "BBB+")], "instrument_id string, gearing_ratio decimal(12,6), current_rating string")
    got = sorted((r.instrument_id, r.covenant_type, r.status) for r in rules.evaluate_book(held, covenants, triggers, facts).collect())
    assert got == [("i", "gearing_ratio", "breach"), ("i", "rating_trigger", "ok"), ("j", "rating_trigger", "insufficient_data")]
    clauses = spark.createDataFrame([("c1", "d", True), ("c2", "e", False)], "clause_id string, document_id string, citation_verified boolean")
    docs = spark.createDataFrame([("d",), ("e",), ("f",)], "document_id string")
    assert sorted(r[0] for r in portfolio.without_covenants(docs, clauses, clauses.where("clause_id = 'c1'").select("clause_id")).collect()) == ["e", "f"]
    assert [r.clause_id for r in review.unverified(clauses).collect()] == ["c2"]


def test_greedy_matches_as_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(g, a, b, rng.randrange(4)) for g in range(6) for a in range(5) for b in range(6) if rng.random() < 0.7]
    expected = []
    for g in range(6):
        left, right = set(), set()
        for _, a, b, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if a not in left and b not in right:
                expected.append((g, a, b))
                left.add(a)
                right.add(b)
    scored = spark.createDataFrame(rows, "document_id int, label_id int, prediction_id int, score int")
    for most in (20_000, 0):
        assert sorted(tuple(r)[:3] for r in evaluation.greedy_matches(scored, ["document_id"], most).collect()) == sorted(expected)
    assert evaluation.greedy_matches(scored.limit(0), ["document_id"]).count() == 0


def test_language_words_are_parted_by_hyphens(spark):
    texts = ["a state-of-the-art plant and so", "mana-mana yang lain", "yang dan state-of-the-art", "the issuer's and the trustee's"]
    assert column(spark, texts, text.language) == ["en", "unknown", "unknown", "en"]


def plain_stem(word):
    """The public rules once more, letter by letter."""
    vowels = "aeiouy"
    own = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if len(word) <= 2:
        return word
    if word in own:
        return own[word]
    if word in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
        return word
    w = list(word)
    for k, c in enumerate(w):
        if c == "y" and (k == 0 or w[k - 1] in vowels):
            w[k] = "Y"
    w = "".join(w)

    def region(start):
        for k in range(start + 1, len(w)):
            if w[k - 1] in vowels and w[k] not in vowels:
                return k + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    r2 = region(r1)

    def short_end(x):
        if len(x) == 2:
            return x[0] in vowels and x[1] not in vowels
        return len(x) > 2 and x[-3] not in vowels and x[-2] in vowels and x[-1] not in vowels + "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    end = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), None)
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and any(c in vowels for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif len(w) <= r1 and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"

    def swapped(table, valid):
        end = max((s for s in table if w.endswith(s)), key=len, default=None)
        return w[: -len(end)] + table[end] if end and valid(end, w[: -len(end)]) else w

    w = swapped({"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}, lambda s, x: len(x) >= r1 and (s != "ogi" or x.endswith("l")) and (s != "li" or x[-1:] in tuple("cdeghkmnrt")))
    w = swapped({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}, lambda s, x: len(x) >= r1 and (s != "ative" or len(x) >= r2))
    w = swapped(dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), ""), lambda s, x: len(x) >= r2 and (s != "ion" or x[-1:] in ("s", "t")))
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def test_english_stems(spark):
    known = {"consigned": "consign", "consistency": "consist", "consolatory": "consolatori", "knackeries": "knackeri", "kneeling": "kneel", "hopping": "hop", "hoping": "hope", "generic": "generic", "generate": "generat", "ties": "tie", "cries": "cri", "agreed": "agre", "feed": "feed", "rationalization": "ration", "geology": "geolog", "ratings": "rate", "proceeds": "proceed", "electricity": "electr", "skies": "sky", "news": "news", "gas": "gas", "yes": "yes", "enjoyed": "enjoy", "redemption": "redempt", "roll": "roll", "controlling": "control", "by": "by", "3rd": "3rd", "rm30": "rm30"}
    rng = random.Random(8)
    starts, ends = ["rat", "oblig", "hop", "gener", "yield", "matur", "contr", "iss", "arsen", "trustee", "b", "sky", "fall", "emplo", "x", "bowl", "apolog", "stra"], ["", "s", "es", "ed", "eed", "ing", "ingly", "ational", "ation", "izer", "fulness", "ousli", "biliti", "ogi", "li", "icate", "ative", "ement", "ion", "sion", "ll", "e", "y", "ies", "ied", "us", "ss", "edly", "tional", "ization"]
    words = sorted({rng.choice(starts) + rng.choice(ends) + rng.choice(ends) for _ in range(900)} | set(known))
    got = dict(zip(words, column(spark, words, stemming.english_stem), strict=True))
    assert {w: got[w] for w in known} == known and {w: plain_stem(w) for w in known} == known
    assert {w: s for w, s in got.items() if s != plain_stem(w)} == {}


def test_search_by_the_language_of_each_row(spark):
    rows = spark.createDataFrame([(1, "The ratings were downgraded, downgraded.", "english"), (2, "the downgrade", "simple"), (3, "downgrades of the issuer", "english"), (4, None, "english"), (5, "of the", "english")], "chunk_id long, chunk_text string, fts_config string")
    asked = spark.createDataFrame([(1, "downgrading"), (2, "the downgrade"), (3, "of"), (4, "?!")], "query_id long, question string")
    got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 3)) for r in retrieval.keyword_top(retrieval.postings(rows), asked).collect())
    assert got == [(1, 1, 1, 0.2), (1, 2, 3, 0.1), (2, 1, 1, 0.2), (2, 2, 2, 0.2), (2, 3, 3, 0.1)]


def test_blocks_are_read_as_far_as_the_floor(spark):
    """A frequent lexeme is many blocks, and few of them are read for its top; the result is that of reading everything."""
    rng = random.Random(3)
    texts = [" ".join(["common"] * (30 if k < 8 else 1 + k % 2) + rng.choices("abcdefgh", k=4) + ["rare"] * (k % 400 == 0)) for k in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(1, "common"), (2, "common rare"), (3, "a b c common"), (4, "absent"), (5, "rare a")], "query_id long, question string")
    index = retrieval.postings(rows).cache()
    blocks, directory = retrieval.posting_blocks(index, 16)
    got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 3)) for r in retrieval.search_blocks(blocks, directory, asked, 5, 16).collect())
    expected = []
    for q, words in ((1, ["common"]), (2, ["common", "rare"]), (3, ["a", "b", "c", "common"]), (5, ["rare", "a"])):
        scores = sorted(((-sum(t.split().count(w) for w in words), k) for k, t in enumerate(texts)))[:5]
        expected += [(q, n + 1, k, round(-s / 10, 3)) for n, (s, k) in enumerate(scores)]
    assert got == sorted(expected)
    need = retrieval.needed_bands(blocks, directory, asked, 5, 16).where("query_id = 1").agg(F.sum("parts")).first()[0]
    assert blocks.where("lexeme = 'common'").count() > 200 and need <= 2
    assert max(r.n for r in blocks.select(F.size("postings").alias("n")).collect()) < 64


def test_vectors_by_buckets(spark):
    """Enough of the exact leg's rows are found, in few of the buckets; with all of them probed, every row."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.3 * rng.standard_normal(24)], "m" if k % 50 else "other") for k in range(1500)] + [(9000, [0.0] * 24, "m"), (9001, None, "m"), (9002, [1.0, 2.0], "m")]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, model string")
    asked = v.where("chunk_id % 40 = 1 or chunk_id = 9000").select(F.col("chunk_id").alias("query_id"), "embedding", "model")
    exact = retrieval.vector_top(v, asked, 10)
    found, probes = retrieval.vector_top_indexed(v, asked, 10)
    assert probes < 64 and retrieval.recall(found, exact).first().recall >= 0.9
    whole = retrieval.bucket_top(retrieval.projection_buckets(v), asked, 10, probes=64)
    assert sorted(map(str, whole.collect())) == sorted(map(str, exact.collect()))
    m = {k: np.array(e) for k, e, model in rows if model == "m" and e and len(e) == 24 and any(e)}
    for q in (1, 41, 81):
        scores = sorted(m, key=lambda k: (-round(float(m[k] @ m[q] / np.linalg.norm(m[k]) / np.linalg.norm(m[q])), 9), k))[:10]
        assert [r.chunk_id for r in exact.where(f"query_id = {q}").orderBy("rank").collect()] == scores


def test_issuers_anywhere_in_the_text(spark):
    names = ["Retail REIT Berhad", "Bank", "Bank Nasional", "  ", None, "BANK", "Ümlaut AG", "Zeta Holdings"]
    instruments = spark.createDataFrame([(f"i{k}", n) for k, n in enumerate(names)], "instrument_id string, issuer_name string")
    docs = [("d1", 0, "the retail\nreit   BERHAD is"), ("d2", 0, "a Bank is two instruments"), ("d3", 0, "pseudoretail reit berhadx"), ("d4", 0, "zeta"), ("d4", 1, "holdings and more"), ("d5", 0, "nothing"), ("d6", 25, "Zeta Holdings too late"), ("d7", 0, None), ("d8", 0, "ümlaut ag, zeta holdings"), ("d9", 3, "an ÜMLAUT AG")]
    chunks_ = spark.createDataFrame(docs, "document_id string, ordinal int, chunk_text string")
    expected = [("d1", "i0"), ("d3", "i0"), ("d4", "i7"), ("d9", "i6")]
    for most in (1 << 20, 100):  # one automaton, and names dealt into several
        assert sorted(map(tuple, portfolio.link_issuers(chunks_, instruments, name_bytes=most).collect())) == expected
    assert portfolio.link_issuers(chunks_, instruments.limit(0)).count() == 0


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_best_windows_as_all_windows():
    """The score, and the first of the best windows, as comparing the quote with every window gives them."""
    rng = random.Random(1)
    pairs = [("", "abc"), ("x" * 50, ""), ("ab" * 40, "ab" * 80), ("a quote that is longer than its text by far", "a quote that is longer than its text")]
    for _ in range(60):
        letters = rng.choice(["abcd ", "abcdefghijklmnopqrstuvwxyz     ", "ab", "日本é😀 "])
        line = "".join(rng.choice(letters) for _ in range(rng.randint(30, 200)))
        m, at = rng.randint(40, 130), rng.randint(-12, 150)
        quote = ["#"] * rng.randint(0, 6) * (at < 0) + list(line[max(at, 0) : at + m] or "none")
        for _ in range(rng.randint(0, len(quote) // 9)):
            k, kind = rng.randrange(len(quote)), rng.random()
            if kind < 0.35:
                quote[k] = "Z"
            elif kind < 0.7 or len(quote) < 6:
                quote.insert(k, rng.choice(letters))
            else:
                del quote[k]
        pairs.append(("".join(quote), line))

    def all_windows(quote, line):
        if len(quote) > len(line):
            best = all_windows(line, quote)
            return best and (best[0], 0, len(line))
        best = None
        for at in range(-len(quote) + 1, len(line) if quote else 0):
            a, b = max(at, 0), min(at + len(quote), len(line))
            score = 2 * common(quote, line[a:b]) / (len(quote) + b - a)
            best = (score, a, b) if score >= 0.92 and (best is None or score > best[0]) else best
        return best

    found = alignment.best_windows(pairs, 0.92)
    assert found == [all_windows(*p) for p in pairs] and sum(f is not None for f in found) > 35


def test_fuzzy_quotes_in_one_pass(spark):
    prose = "The Issuer shall not create or permit to subsist any security interest over its assets."
    quote = "The Issuer shall not create or permit to subsist any security interest[1] over its assets."
    rows = spark.createDataFrame([(1, quote, "Before. " + prose + " After."), (2, quote, "Something else entirely is written here, at some length, and more."), (3, "short quote[1]", "a short quote"), (4, prose.replace("fi", "ﬁ"), prose), (5, None, prose), (6, quote, None), (7, quote, prose)], "k int, quote string, chunk_text string")
    out = verify.verify(rows)
    got = {r.k: r for r in out.collect()}
    assert [got[k].method for k in (1, 2, 3, 4, 5, 6, 7)] == ["fuzzy", "not_found", "not_found", "exact", "empty", "not_found", "fuzzy"]
    line = "Before. " + prose + " After."
    assert 0.95 < got[1].score < 1 and prose[:-1] in line[got[1].char_start : got[1].char_end] and got[7].char_end == len(prose)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan") == 1


def test_overlaps_of_many_spans_in_one_chunk(spark):
    """10,000 spans of one chunk: the pairs that meet in a bin are no more than a few for each overlap."""
    n = 10_000
    left = spark.range(n).select(F.lit("h").alias("hash"), F.col("id").alias("a"), (F.col("id") * 40).alias("s"), (F.col("id") * 40 + 30).alias("e"))
    right = spark.range(n).select(F.lit("h").alias("hash"), F.col("id").alias("b"), (F.col("id") * 40 + 20).alias("t"), (F.col("id") * 40 + 60).alias("u"))
    met = joins.overlapping(left, right, ["hash"], (F.col("s"), F.col("e")), (F.col("t"), F.col("u")), 64)
    assert met.count() == 2 * n - 1 and met.select("a", "b").distinct().count() == 2 * n - 1
    # without the test of each pair: what the bins bring together
    wide = joins.overlapping(left.withColumns({"s": F.floor(F.col("s") / 64) * 64, "e": F.floor(F.col("e") / 64) * 64 + 64}), right, ["hash"], (F.col("s"), F.col("e")), (F.col("t"), F.col("u")), 64)
    assert wide.count() < 6 * n


def test_overlaps_as_all_pairs(spark):
    rng = random.Random(6)
    span = lambda: (rng.choice("ab"), *sorted((rng.randrange(-50, 400), rng.randrange(-50, 400))))
    x, y = [span() for _ in range(60)] + [("a", None, 5), (None, 1, 9)], [span() for _ in range(60)] + [("a", 3, None)]
    left = spark.createDataFrame([(k, *r) for k, r in enumerate(x)], "i int, key string, s int, e int")
    right = spark.createDataFrame([(k, *r) for k, r in enumerate(y)], "j int, key string, t int, u int")
    expected = sorted((i, j) for i, (k, s, e) in enumerate(x) for j, (m, t, u) in enumerate(y) if k == m and None not in (k, s, e, t, u) and s < e and t < u and s < u and t < e)
    for width in (7, 100, 5000):
        met = joins.overlapping(left, right, ["key"], (F.col("s"), F.col("e")), (F.col("t"), F.col("u")), width)
        assert sorted((r.i, r.j) for r in met.collect()) == expected


def test_stored_tables_rewrite_what_changes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    read = lambda: sorted((r.k, r.v) for r in stored.read_stored(spark, path, "k long, v string").collect())
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert stored.upsert_stored(path, frame([]), ["k"], 8) == [] and read() == []
    stored.upsert_stored(path, frame([(k, f"v{k}") for k in range(200)]), ["k"], 8)
    before = files()
    assert stored.upsert_stored(path, frame([(k, f"v{k}") for k in range(50)]), ["k"], 8) == [] and files() == before
    touched = stored.upsert_stored(path, frame([(7, None), (8, "v8")]), ["k"], 8)
    assert len(touched) == 1 and read() == sorted([(k, f"v{k}") for k in range(200) if k != 7] + [(7, None)], key=lambda r: r[0])
    kept = {p for p, at in files().items() if before.get(p) == at}
    assert len({p.split("bucket=")[1].split("/")[0] for p in kept}) == 7
    assert stored.upsert_stored(path, frame([(7, None)]), ["k"], 8) == []
    assert stored.append_new(path, frame([(7, "new"), (500, "a"), (500, "a")]), ["k"], 8) and (500, "a") in read() and (7, "new") not in read()
    stored.replace_rows(path, spark.range(501).select(F.col("id").alias("k")), frame([(k, "w") for k in range(400)]), ["k"], 8, 10)
    assert read() == [(k, "w") for k in range(400)] and len(list(tmp_path.rglob("bucket=3/*.parquet"))) > 2
    # rows of a key may go, and the last of a bucket with them
    stored.replace_rows(path, spark.range(501).select(F.col("id").alias("k")), frame([]), ["k"], 8)
    assert read() == []


def test_stored_index_replaces_changed_chunks_only(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    rows = spark.createDataFrame([(k, f"word{k} gearing gearing", "english") for k in range(60)] + [(60, None, "english")], "chunk_id long, chunk_text string, fts_config string")
    assert len(stored.store_index(path, rows, "m", buckets=8)) == 8 and stored.store_index(path, rows, "m", buckets=8) == []
    one = rows.where("chunk_id = 3").withColumn("chunk_text", F.lit("ratings"))
    assert len(stored.store_index(path, one, "m", buckets=8)) == 1
    words = stored.read_stored(spark, f"{path}/postings", "chunk_id long, fts_config string, lexeme string, tf long")
    assert sorted((r.lexeme, r.tf) for r in words.where("chunk_id = 3").collect()) == [("rate", 1)] and words.count() == 59 * 2 + 1
    assert {r.model for r in stored.read_stored(spark, f"{path}/vectors", "chunk_id long, sha256 string, model string, tokens int, places array<int>, weights array<double>").collect()} == {"m"}
    assert len(stored.store_index(path, one, "n", buckets=8)) == 1
    with pytest.raises(Exception, match="number of dimensions"):
        stored.store_index(path, one, "p", dimensions=1, buckets=8)


def test_numbers_of_a_document_with_most_pages(spark):
    """Ordinals over ranges of pages, some pages blank, one number twice, null numbers first."""
    rng = random.Random(2)
    pages = [("a", k, rng.choice([0, 1, 3])) for k in range(40)] + [("a", 7, 2), ("a", None, 2), ("b", 5, 1), (None, 1, 4)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "row long, document_id string, page_number int, n int")
    after = spark.createDataFrame([("b", 4), ("a", 1), ("a", 9)], "document_id string, ordinal int")
    for width in (3, 1000):
        got = {r.row: r.base for r in chunks.first_ordinals(rows, after, width).collect()}
        for name, first in (("a", 10), ("b", 5), (None, 0)):
            at = first
            for i in sorted((i for i, p in enumerate(pages) if p[0] == name), key=lambda i: (pages[i][1] is not None, pages[i][1] or 0, i)):
                assert got[i] == at
                at += pages[i][2]
        assert len(got) == len(pages)


def test_analysts_read_all_and_get_a_thousand(spark):
    tables.publish_views({"covenants": spark.range(3000).select(F.col("id").alias("covenant_id"), F.lit("x").alias("covenant_type"))})
    assert tables.analyst_result(spark, "select count(*) as n from covenants").first().n == 3000
    assert tables.analyst_result(spark, "select covenant_id from covenants").count() == 1000
    assert tables.analyst_result(spark, "select covenant_id from covenants limit 7").count() == 7


def test_work_tables_are_deleted(spark):
    a, b = tables.saved(spark.range(3)), tables.saved(spark.range(4))
    tables.discard(a)
    with pytest.raises(Exception):  # noqa: B017
        a.count()
    assert b.count() == 4
    tables.clear_saved(spark)
    with pytest.raises(Exception):  # noqa: B017
        b.collect()
    c = tables.saved(spark.range(5))
    with tables.scratch(spark):
        d = tables.saved(spark.range(6))
        assert d.count() == 6
    with pytest.raises(Exception):  # noqa: B017
        d.collect()
    assert c.count() == 5


@pytest.mark.parametrize("most", [1, 20, 20_000])
def test_matches_of_large_groups_of_ties(spark, most):
    """One group of equal scores, where a round settles a single pair, beside groups that rounds settle."""
    rng = random.Random(9)
    rows = [("ties", a, b, 0) for a in range(25) for b in range(25) if (a + b) % 9] + [(f"g{g}", a, b, rng.randrange(4)) for g in range(8) for a in range(6) for b in range(7)] + [(None, 1, 1, 2), (None, 1, 2, 3)]
    got = evaluation.greedy_matches(spark.createDataFrame(rows, "document_id string, label_id int, prediction_id int, score int"), ["document_id"], most)
    expected = set()
    for g, a, b, score in sorted(rows, key=lambda r: (str(r[0]), -r[3], r[1], r[2])):
        if not any(x[0] == g and (x[1] == a or x[2] == b) for x in expected):
            expected.add((g, a, b, score))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_pages_are_not_sent_to_all_executors(spark):
    """Pages that a query makes are far larger than the files that they are made from, by which Spark would judge them."""
    pages = spark.range(50).select(F.col("id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.repeat(F.lit("Words that say little. "), F.lit(100)).alias("text"))
    found = chunks.span_violations(chunks.chunk(pages), pages)
    joined = re.findall(r"\w+Join", found._jdf.queryExecution().executedPlan().toString())
    assert joined[:2] == ["SortMergeJoin", "SortMergeJoin"] and found.count() == 0


def test_calls_of_lines_that_share_a_number(spark, tmp_path, monkeypatch):
    """Which of such lines gives the date does not depend on the order in which rows come."""
    lines = [(k, 1, dt.datetime(2026, 1, 1 + (k + n) % 9)) for k in range(1, 9) for n in range(4)]
    monkeypatch.setattr(evaluation, "match_calls", lambda found, labels: labels.withColumn("days", F.datediff("call_date", F.lit("2026-01-01"))))
    got = []
    for k, rows in enumerate((lines, lines[::-1])):
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/{k}/lineitem.parquet")
        got.append(sorted(map(tuple, books.matched_calls(spark, f"file://{tmp_path}/{k}").collect())))
    assert got[0] == got[1] and len(got[0]) == 8


def test_answers_are_joined_by_key(spark, monkeypatch):
    """What grows with the book or the log is sent to no executor whole, however small Spark takes it to be."""
    asked = spark.createDataFrame([(1, "which instruments are rated below AA"), (2, "is Blue Sukuk in breach"), (3, "what is the gearing of Blue Sukuk"), (4, "what is the exposure of Growth Fund")], "query_id int, question string")
    instruments = spark.createDataFrame([("i", "Green Sukuk", None, "A1"), ("j", "Blue Sukuk", None, "AAA")], "instrument_id string, instrument_name string, issuer_name string, current_rating string")
    funds = spark.createDataFrame([("p", "Growth Fund")], "portfolio_id string, name string")
    held = spark.createDataFrame([("p", "i", D(5))], "portfolio_id string, instrument_id string, market_value decimal(20,4)")
    covenants = spark.createDataFrame([("c2", "j", "gearing_ratio", "2 times", 4, 0.8)], "clause_id string, instrument_id string, covenant_type string, source_quote string, page_number int, confidence double")
    terms = spark.createDataFrame([("j", "c2", "rating_trigger", "AAA", "high")], "instrument_id string, clause_id string, covenant_type string, trigger_rating string, severity string")
    hits = spark.createDataFrame([(4, "h", "rain")], "query_id int, chunk_id string, chunk_text string")
    plans, keep = [], questions.saved

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(questions, "saved", seen)
    answers, _, _ = questions.answer(asked, instruments, funds, held, covenants, terms, instruments.select("instrument_id", "current_rating"), hits)
    seen(answers)
    # the only ones are the scopes that many questions share: instruments, portfolios, covenants by what is asked for
    assert [p.count("BroadcastHashJoin") for p in plans] == [0] * (len(plans) - 2) + [3, 0]


def test_coverage_of_blank_texts(spark, tmp_path):
    """A blank text has a row, as in the query's SQL, and a null one has none."""
    spark.createDataFrame([(1, "TERMS\n\nText."), (2, ""), (3, " \n\n "), (4, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(map(tuple, books.chunk_coverage(spark, f"file://{tmp_path}").collect()))
    assert got == [(1, 2, 1, 10, True, True), (2, 0, 0, 0, True, True), (3, 0, 0, 0, True, True)]
