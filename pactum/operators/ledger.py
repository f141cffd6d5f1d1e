"""Spend ledgers, budgets, caches and failure streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spend(calls: DataFrame) -> DataFrame:
    """(document_id, stage, cost) in one pass: the total has both null, documents and stages one of them."""
    return calls.groupingSets([(), ("document_id",), ("stage",)], "document_id", "stage").agg(F.sum("cost_usd").cast("decimal(20,6)").alias("cost"), F.grouping_id().alias("level"))


def spend_report(calls: DataFrame, documents: DataFrame, cap: str = "5.00") -> DataFrame:
    """Each document's calls, cache hits, hit rate, cached tokens, cost and whether it is over the cap; a deleted document
    shows a placeholder name, a document without spend a null rate."""
    by = calls.groupBy("document_id").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.sum("cost_usd").cast("decimal(20,6)").alias("cost"))
    return by.join(documents.select("document_id", "filename"), "document_id", "left").withColumns({"filename": F.coalesce("filename", F.lit("(deleted)")), "hit_rate": F.try_divide("cache_hits", "calls"), "over_cap": F.col("cost") > F.lit(cap).cast("decimal(20,6)")})


def spend_summary(report: DataFrame) -> DataFrame:
    """Over all documents of a spend report: how many there are, how many cost something, the mean of those, and how many
    are over the cap."""
    paid = F.when(F.col("cost") > 0, F.col("cost"))
    return report.agg(F.count("*").alias("documents"), F.count(paid).alias("with_spend"), F.avg(paid).alias("mean_cost"), F.count_if("over_cap").alias("over_cap"))


def agreement(covenants: DataFrame) -> DataFrame:
    """Share of model covenants that no rule disagrees with, null without model rows."""
    llm, bad = F.count_if(F.expr("method = 'llm'")), F.count_if(F.expr("method = 'llm' and disagrees"))
    return covenants.agg(llm.alias("llm"), bad.alias("disagreements"), F.when(llm > 0, F.greatest((llm - bad) / llm, F.lit(0.0))).alias("agreement"))


def price(calls: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls(model_id, prompt_tokens, completion_tokens), prices(model_id, input_usd, output_usd by million tokens) ->
    (priced calls with cost_usd, calls of unpriced models): an unknown price is an error row, not a free call."""
    cost = ((F.col("prompt_tokens") * F.col("input_usd") + F.col("completion_tokens") * F.col("output_usd")) / 1_000_000).cast("decimal(12,6)")
    rows = calls.join(prices, "model_id", "left").withColumn("cost_usd", cost)
    return rows.where("input_usd is not null").drop("input_usd", "output_usd"), rows.where("input_usd is null").select(*calls.columns)


def extraction_ceiling(candidates: DataFrame, prefix_tokens: int, output_tokens: int, input_usd: str, output_usd: str, cap: str) -> DataFrame:
    """candidates(document_id, tokens) -> worst-case cost of each document; one over the cap is refused whole."""
    million = F.lit(1_000_000)
    cost = (F.sum(F.lit(prefix_tokens) + F.col("tokens")) * F.lit(input_usd).cast("decimal(10,4)") + F.count("*") * output_tokens * F.lit(output_usd).cast("decimal(10,4)")) / million
    return candidates.groupBy("document_id").agg(F.count("*").alias("candidates"), F.sum(F.lit(prefix_tokens) + F.col("tokens")).alias("prompt_tokens"), cost.cast("decimal(12,6)").alias("ceiling")).withColumn("over_cap", F.col("ceiling") > F.lit(cap).cast("decimal(12,6)"))


def budget_audit(calls: DataFrame, per_call: str, total: str, per_document: str, buckets: int | None = None) -> DataFrame:
    """calls(call_id, ts, document_id, estimate, cost_usd) -> adds spent_before, document_before and the first limit that
    fails: call, total, document, else admitted. Spend before a call plus its estimate may reach a limit.

    Sums over all calls go by time buckets: totals of earlier buckets plus the sum within the call's own, so no window
    holds all rows; spend with one time stamp is in order of call_id."""
    money, buckets = "decimal(20,6)", buckets or 4 * int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = calls.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"))
    rows = calls.withColumn("_one", F.lit(1)).join(F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one")
    width = F.greatest((F.col("hi") - F.col("lo") + buckets) / buckets, F.lit(1.0))
    rows = rows.withColumn("_bucket", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("lo")) / width)).drop("_one", "lo", "hi")
    sums = rows.groupBy("_bucket").agg(F.sum("cost_usd").alias("own"))
    before = sums.withColumn("_before", F.coalesce(F.sum("own").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_before")
    earlier = lambda *keys: F.coalesce(F.sum("cost_usd").over(Window.partitionBy(*keys).orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(before), "_bucket").withColumns({"spent_before": (F.col("_before") + earlier("_bucket")).cast(money), "document_before": earlier("document_id").cast(money)}).drop("_bucket", "_before")
    limit = lambda x: F.lit(x).cast(money)
    verdict = F.when(F.col("estimate") > limit(per_call), "call").when(F.col("spent_before") + F.col("estimate") > limit(total), "total").when(F.col("document_before") + F.col("estimate") > limit(per_document), "document").otherwise("admitted")
    return rows.withColumn("verdict", verdict)


def cache_replay(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cache_key, whether a call would have been answered from the cache, and what that saves: the first call of a key
    costs, later ones are free."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    rows = calls.withColumn("cache_key", key)
    place = F.row_number().over(Window.partitionBy("cache_key").orderBy("ts", "call_id"))
    return rows.withColumn("replayed", place > 1).withColumn("saved", F.when(F.col("replayed"), F.col("cost_usd")).otherwise(F.lit(0)).cast("decimal(20,6)"))


def failure_streaks(events: DataFrame, key: str, minutes: int = 15, threshold: int = 3, base: float = 1.0, cap: float = 300.0) -> DataFrame:
    """events(key, ts, succeeded, event_id) -> for each failure the failures of its key since the last success within the
    last minutes, itself included, and the delay that doubles from the threshold on."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_run", F.coalesce(F.sum(F.col("succeeded").cast("int")).over(order), F.lit(0))).withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    near = Window.partitionBy(key, "_run").orderBy("_s").rangeBetween(-minutes * 60 * 1_000_000, 0)
    counted = rows.withColumn("failures", F.count_if(~F.col("succeeded")).over(near)).where(~F.col("succeeded"))
    delay = F.when(F.col("failures") >= threshold, F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.col("failures") - threshold))).otherwise(0.0)
    return counted.withColumn("delay", delay).drop("_run", "_s")
