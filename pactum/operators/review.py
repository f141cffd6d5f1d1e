"""Data-quality rules, vocabularies, orphans and review decisions, status of documents, backlog counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Row constraints by table, as conditions that must not be false.
CONSTRAINTS = {
    "document_pages": {"ratio_range": "image_area_ratio between 0 and 1", "garbled_range": "garbled_unicode_ratio between 0 and 1", "confidence_range": "confidence between 0 and 1", "vision_has_reason_and_text": "not vlm_used or (vlm_reason is not null and ocr_text is not null)"},
    "document_chunks": {"ordered_span": "char_end > char_start", "start_not_negative": "char_start >= 0"},
    "clauses": {"confidence_range": "confidence between 0 and 1", "ordered_span": "char_end is null or char_end > char_start", "verified_has_score": "not citation_verified or citation_match_score is not null"},
    "covenants": {"confidence_range": "confidence between 0 and 1", "amount_has_currency": "threshold_amount is null or threshold_currency is not null"},
    "portfolio_holdings": {"weight_range": "nav_weight between 0 and 1", "quantity_not_negative": "quantity >= 0"},
    "llm_calls": {"cost_not_negative": "cost_usd >= 0", "cache_hit_is_free": "not cache_hit or cost_usd = 0"},
    "human_reviews": {"resolved_has_reviewer": "status = 'pending' or reviewer is not null"},
    "query_logs": {"refused_has_no_confidence": "not refused or confidence = 0"},
}


def violations(rows: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """(key, rule) of every row that breaks a rule; a rule that is null holds, as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(test), F.lit(name)) for name, test in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("rows"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def vocabulary_drift(rows: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Stored values that are not declared, and declared ones that never occur."""
    stored = rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    known = rows.sparkSession.createDataFrame([(v,) for v in declared], "value string")
    return stored.join(known, "value", "left_anti").withColumn("problem", F.lit("undeclared")).union(known.join(stored, "value", "left_anti").withColumn("problem", F.lit("unused")))


def orphans(reviews: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """Reviews whose entity is gone; entities maps a type to a table with entity_id."""
    out = reviews.where(~F.col("entity_type").isin(list(entities)))
    for kind, table in entities.items():
        out = out.unionByName(reviews.where(F.col("entity_type") == kind).join(table.select("entity_id").distinct(), "entity_id", "left_anti").select(*reviews.columns))
    return out


def pending(reviews: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The queue, oldest first, paged."""
    return reviews.where("status = 'pending'").orderBy("created_at", "review_id").offset(offset).limit(limit)


def unverified(clauses: DataFrame, limit: int = 100) -> DataFrame:
    """Clauses whose quote was not found in its source."""
    return clauses.where("not coalesce(citation_verified, false)").orderBy("clause_id").limit(limit)


def trail(audit: DataFrame, entity_type: str, entity_id: str, limit: int = 100) -> DataFrame:
    """What happened to one entity, newest first."""
    return audit.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).orderBy(F.desc("created_at"), "audit_id").limit(limit)


def recent(log: DataFrame, order: str = "created_at", key: str = "query_id", limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc(order), key).limit(limit)


def apply_decisions(reviews: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews after the decisions, conflicts, audit rows): only a pending review can be decided, the first decision by time
    counts, every other one is a conflict; a correction keeps the old value beside the new."""
    order = Window.partitionBy("review_id").orderBy("decided_at", "reviewer", "decision")
    ranked = decisions.withColumn("_k", F.row_number().over(order)).join(reviews.select("review_id", F.col("status").alias("_was")), "review_id", "left")
    counts = (F.col("_k") == 1) & (F.coalesce(F.col("_was"), F.lit("")) == "pending")
    made = ranked.where(counts).select("review_id", "decision", F.col("new_value").alias("_value"), F.col("reviewer").alias("_by"), F.col("decided_at").alias("_at"))
    after = reviews.drop("reviewer", "decided_at").join(made, "review_id", "left").withColumns({
        "status": F.coalesce("decision", "status"), "new_value": F.when(F.col("decision") == "corrected", F.col("_value")).otherwise(F.col("new_value")), "reviewer": F.col("_by"), "decided_at": F.col("_at"),
    }).drop("decision", "_value", "_by", "_at")
    conflicts = ranked.where(~counts).drop("_k").withColumnRenamed("_was", "status")
    audit = made.join(reviews.select("review_id", "entity_type", "entity_id", "old_value"), "review_id").select(F.concat(F.lit("review_"), "decision").alias("action"), "entity_type", "entity_id", "old_value", F.col("_value").alias("new_value"), F.col("_by").alias("actor"), F.col("_at").alias("created_at"))
    return after, conflicts, audit


def document_status(documents: DataFrame, pages: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each document's pages, flagged pages, chunks, embedded chunks, first error, and whether it is searchable and done."""
    p = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if("needs_vlm").alias("flagged_pages"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    j = jobs.groupBy("document_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("created_at"))).alias("first_error"), F.bool_and(F.col("status").isin("succeeded", "failed")).alias("terminal"))
    out = documents
    for part in (p, c, j):
        out = out.join(part, "document_id", "left")
    zero = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("pages", "flagged_pages", "chunks", "embedded")}
    return out.withColumns(zero).withColumn("searchable", (F.col("chunks") > 0) & (F.col("embedded") == F.col("chunks")))


def coverage(rows: DataFrame, key: str, **tests: Column) -> DataFrame:
    """Counts by key of all rows and of those for which each named condition holds."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), *[F.count_if(t).alias(n) for n, t in tests.items()])
