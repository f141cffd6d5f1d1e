"""Extraction and answer scoring: field comparison, greedy matching, precision and recall, citation tallies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions.joins import overlapping
from pactum.sources.tables import saved

#: Pairs of labels and predictions of a group that need no more rounds.
GROUP_PAIRS = 20_000
FIELDS = {"threshold_ratio": "number", "threshold_amount": "number", "threshold_currency": "text", "operator": "enum", "trigger_rating": "text", "rating_agency": "text"}


def same(kind: str, expected: Column, actual: Column) -> Column:
    """Numbers within 0.5 % of the larger (zero only equals zero), dates within three days, texts trimmed and without case,
    the rest exactly."""
    if kind == "number":
        return F.when((expected == 0) | (actual == 0), expected == actual).otherwise(F.abs(expected - actual) <= F.greatest(F.abs(expected), F.abs(actual)) * F.lit("0.005").cast("decimal(4,3)"))
    if kind == "date":
        return F.abs(F.datediff(expected, actual)) <= 3
    if kind == "text":
        return F.lower(F.trim(expected)) == F.lower(F.trim(actual))
    return expected == actual


def greedy_matches(scored: DataFrame, group: list[str], most: int = GROUP_PAIRS) -> DataFrame:
    """scored(group, label_id, prediction_id, score) -> one-to-one pairs, best score first, ties by label then prediction.

    Groups are the labels and predictions of one document and type. In a round the pairs go that are the best of both their
    sides, and all pairs of what they take with them, which gives the same pairs without a task that holds a group. A first
    round settles most groups. Of the others those of at most `most` pairs are passed through in order; larger ones go on in
    rounds while a round settles a tenth of their pairs, and what resists, such as long chains of ties, is passed through
    too: sorted on disk, pair by pair, with only the ids of one group's matches in memory."""
    names, order = scored.columns, (F.desc("score"), "label_id", "prediction_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    by = lambda side: Window.partitionBy(*group, side)

    def rounded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs that are settled, pairs of which both sides are still open)."""
        best = rows.withColumns({"_l": F.row_number().over(by("label_id").orderBy(*order)), "_p": F.row_number().over(by("prediction_id").orderBy(*order))})
        marked = best.withColumn("_t", (F.col("_l") == 1) & (F.col("_p") == 1))
        gone = saved(marked.withColumn("_gone", F.bool_or("_t").over(by("label_id")) | F.bool_or("_t").over(by("prediction_id"))).select(*names, "_t", "_gone"))
        return gone.where("_t").select(*names), gone.where("not _gone").select(*names)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of pairs in order, group by group, those of which both sides are open when they are met."""
        now, left, right = None, set(), set()
        for rows in batches:
            kept = []
            for key, label, prediction in zip(zip(*(rows[c].tolist() for c in group), strict=True), rows["label_id"].tolist(), rows["prediction_id"].tolist(), strict=True):
                if key != now:
                    now, left, right = key, set(), set()
                kept.append(label not in left and prediction not in right)
                if kept[-1]:
                    left.add(label)
                    right.add(prediction)
            yield rows[kept]

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(passed, kinds)

    out, rest = rounded(scored)
    sizes = rest.groupBy(*group).agg(F.count("*").alias("_n"))
    large = rest.join(sizes.where(F.col("_n") > most).drop("_n"), group, "left_semi").select(*names)
    out = out.unionByName(in_order(rest.join(sizes.where(F.col("_n") <= most).drop("_n"), group, "left_semi").select(*names)))
    n = large.count()
    while n:
        taken, large = rounded(large)
        out, before, n = out.unionByName(taken), n, large.count()
        if n > 0.9 * before:
            return out.unionByName(in_order(large))
    return out


def match_covenants(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels and predictions of one document and covenant type, matched by agreement: the page counts 4, a field 1."""
    named = lambda df, p: df.select("document_id", "covenant_type", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("document_id", "covenant_type")])
    joined = named(labels.withColumnRenamed("label_id", "id"), "label").join(named(predictions.withColumnRenamed("prediction_id", "id"), "prediction"), ["document_id", "covenant_type"])
    score = F.coalesce((F.col("label_page_number") == F.col("prediction_page_number")).cast("int") * 4, F.lit(0))
    for c, kind in FIELDS.items():
        score = score + F.coalesce(same(kind, F.col(f"label_{c}"), F.col(f"prediction_{c}")).cast("int"), F.lit(0))
    return greedy_matches(joined.select("document_id", "covenant_type", "label_id", "prediction_id", score.alias("score")), ["document_id", "covenant_type"])


def match_calls(calls: DataFrame, labels: DataFrame, days: int = 3) -> DataFrame:
    """Call labels with predicted calls of their document within three days: each label in the order of labels takes the first
    prediction that is left, (document_id, label_id, prediction_id, days). Rows a person entered are no predictions."""
    found = calls.where("method <> 'human'").select("document_id", F.col("call_date").alias("found"), "prediction_id")
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    near = overlapping(labels.select("document_id", "label_id", "call_date"), found, ["document_id"], (day("call_date") - days, day("call_date") + days + 1), (day("found"), day("found") + 1), 2 * days + 1)
    pairs = near.select("document_id", "label_id", "prediction_id", F.lit(0).alias("score"), F.abs(F.datediff("call_date", "found")).alias("days"))
    return greedy_matches(pairs, ["document_id"]).drop("score")


def field_scores(pairs: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """Matched pairs with label_ and prediction_ columns, either side all null where there was no partner -> (field, tp, fp,
    fn): both null counts nothing, a wrong value is a false positive and a missed one."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"label_{c}").isNotNull().alias("wanted"), F.col(f"prediction_{c}").isNotNull().alias("given"), F.coalesce(same(kind, F.col(f"label_{c}"), F.col(f"prediction_{c}")), F.lit(False)).alias("right")) for c, kind in fields.items()]))
    rows = pairs.select(long.alias("f")).select("f.*")
    return rows.groupBy("field").agg(F.count_if("right").alias("tp"), F.count_if(F.expr("given and not right")).alias("fp"), F.count_if(F.expr("wanted and not right")).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; undefined ones are null."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def totals(counts: DataFrame, *keys: str) -> DataFrame:
    """Micro-averages by every prefix of the keys, and over all."""
    return with_rates(counts.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def recall_by_language(labels: DataFrame, matched: DataFrame) -> DataFrame:
    hit = labels.join(matched.select("label_id").distinct().withColumn("_hit", F.lit(1)), "label_id", "left")
    return hit.groupBy("language").agg(F.count("_hit").alias("found"), F.count("*").alias("labels"), F.try_divide(F.count("_hit"), F.count("*")).alias("recall"))


def citation_tally(checked: DataFrame, labels: DataFrame) -> DataFrame:
    """checked(reverified, evidence_matched), one row a prediction, and one row a label -> counts, verification rate,
    precision over the predictions and recall over the labels; a rate of nothing is null."""
    n = labels.agg(F.count("*").alias("labels"))
    counts = checked.agg(F.count("*").alias("predicted"), F.count_if("reverified").alias("reverified"), F.count_if("evidence_matched").alias("matched"))
    both = counts.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return both.withColumns({"verification_rate": F.try_divide("reverified", "predicted"), "precision": F.try_divide("matched", "predicted"), "recall": F.try_divide("matched", "labels")})


def completeness(labelled: DataFrame, present: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that are labelled but missing, or present but unlabelled."""
    a, b = labelled.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("problem", F.lit("unlabelled")))


def score_answers(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """answers(question_id, answer, citations, refused, faithful), golden(question_id, must_contain, min_citations,
    expect_refusal) -> adds passed and the parts it is made of."""
    rows = golden.join(answers, "question_id", "left")
    holds = F.forall("must_contain", lambda w: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(w)))
    refused = F.coalesce("refused", F.lit(False))
    rows = rows.withColumns({"contains": holds, "cited": F.coalesce("citations", F.lit(0)) >= F.col("min_citations"), "refusal_right": refused == F.col("expect_refusal")})
    return rows.withColumn("passed", F.col("refusal_right") & (F.col("expect_refusal") | (F.col("contains") & F.col("cited"))))


def answer_report(scored: DataFrame) -> DataFrame:
    tp, fp, fn = (F.count_if(F.expr(x)) for x in ("refused and expect_refusal", "refused and not expect_refusal", "expect_refusal and not coalesce(refused, false)"))
    return scored.agg(F.count_if("passed").alias("passed"), F.count("*").alias("questions"), F.try_divide(tp, tp + fp).alias("refusal_precision"), F.try_divide(tp, tp + fn).alias("refusal_recall"), F.try_divide(F.count_if(F.expr("faithful and not refused")), F.count_if(F.expr("not refused"))).alias("faithfulness"))
