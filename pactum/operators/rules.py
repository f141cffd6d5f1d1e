"""Covenant evaluation: terms joined with facts, then one ordered condition for each covenant type. A missing fact is
insufficient data, never compliance; amounts and ratios stay decimals; ratings compare by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.ratings import rank

MARGIN = "0.05"
RATIOS = {"gearing_ratio": "gearing_ratio", "interest_cover": "interest_cover", "finance_service_cover": "finance_service_cover"}
CAPS = {"disposal_restriction": "disposals_value", "distribution_restriction": "distributions_value"}
MINIMA = ["interest_cover", "finance_service_cover", "minimum_net_worth"]
TERMS = {"threshold_ratio": "decimal(12,6)", "threshold_amount": "decimal(20,4)", "threshold_currency": "string", "operator": "string", "trigger_rating": "string", "severity": "string"}
FACTS = {"gearing_ratio": "decimal(12,6)", "interest_cover": "decimal(12,6)", "finance_service_cover": "decimal(12,6)", "net_worth": "decimal(20,4)", "current_rating": "string", "accelerated_indebtedness": "decimal(20,4)", "disposals_value": "decimal(20,4)", "distributions_value": "decimal(20,4)", "security_created": "boolean", "security_is_permitted": "boolean", "change_of_control": "boolean", "shariah_compliant": "boolean", "currency": "string"}
STATUSES = ("ok", "at_risk", "breach", "insufficient_data", "not_applicable")


def _among(kind: Column, fields: dict[str, str], cast: str) -> Column:
    return F.coalesce(*[F.when(kind == k, F.col(v).cast(cast)) for k, v in fields.items()], F.lit(None).cast(cast))


def evaluate(rows: DataFrame, margin: str = MARGIN) -> DataFrame:
    """rows(covenant_type, terms, facts; absent columns count as null) -> the same with status, severity, observed,
    threshold, headroom and explanation. headroom is positive where there is room; a compliant value within margin of
    the threshold is at risk (a margin of 0 or less: never)."""
    have = set(rows.columns)
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in (TERMS | FACTS).items() if c not in have})
    kind, wide = F.col("covenant_type"), "decimal(26,6)"
    ratio, cap = kind.isin(list(RATIOS)), kind.isin(list(CAPS))
    measured = ratio | cap | kind.isin("minimum_net_worth", "cross_default")
    observed = F.coalesce(_among(kind, RATIOS, wide), _among(kind, CAPS | {"minimum_net_worth": "net_worth", "cross_default": "accelerated_indebtedness"}, wide))
    threshold = F.when(ratio, F.col("threshold_ratio").cast(wide)).when(measured, F.col("threshold_amount").cast(wide))
    default = F.when(kind.isin(MINIMA), "gte").otherwise("lte")
    operator = F.when(cap, "lte").when(kind == "cross_default", "lt").otherwise(F.coalesce("operator", default))
    rows = rows.withColumns({"_observed": observed, "_threshold": threshold, "_operator": operator, "_distance": F.when(kind == "rating_trigger", rank(F.col("current_rating")) - rank(F.col("trigger_rating")))})
    o, t, op, distance = F.col("_observed"), F.col("_threshold"), F.col("_operator"), F.col("_distance")
    upper = op.isin("lte", "lt")
    room = F.when(upper, t - o).otherwise(o - t)
    fine = (room > 0) | (room == 0) & op.isin("lte", "gte")
    foreign = (kind == "minimum_net_worth") & F.col("threshold_currency").isNotNull() & ~F.col("threshold_currency").eqNullSafe(F.col("currency"))
    base = F.abs(F.coalesce(F.col("threshold_ratio").cast(wide), F.col("threshold_amount").cast(wide)))
    limit = (base * F.lit(margin).cast("decimal(6,4)")).cast("decimal(32,8)")
    none = F.lit("insufficient_data")
    number = F.when(t.isNull() | o.isNull() | foreign, none).when(~fine, "breach").when((F.lit(margin).cast("decimal(6,4)") > 0) & (room <= limit), "at_risk").otherwise("ok")
    rating = F.when(distance.isNull(), none).when(distance > 0, "breach").when(distance == 0, "at_risk").otherwise("ok")
    pledge = F.when(F.col("security_created").isNull(), none).when(~F.col("security_created") | F.coalesce("security_is_permitted", F.lit(False)), "ok").otherwise("breach")
    flag = lambda c, bad: F.when(F.col(c).isNull(), none).when(F.col(c) == bad, "breach").otherwise("ok")
    status = F.when(measured, number).when(kind == "rating_trigger", rating).when(kind == "negative_pledge", pledge).when(kind == "shariah_non_compliance", flag("shariah_compliant", False)).when(kind == "change_of_control", flag("change_of_control", True)).otherwise("not_applicable")
    severe = F.when(F.col("status") != "breach", F.col("severity")).when(kind == "shariah_non_compliance", "critical").when(kind.isin("rating_trigger", "negative_pledge", "change_of_control"), "high").otherwise(F.col("severity"))
    known = measured & (F.col("status") != "insufficient_data")
    words = F.concat_ws(" ", F.col("covenant_type"), F.col("status"), F.when(known, F.concat(F.lit("observed "), o.cast("string"), F.lit(" against "), t.cast("string"))), F.when(distance.isNotNull(), F.concat(F.abs(distance).cast("string"), F.lit(" notches from "), F.col("trigger_rating"))))
    out = rows.withColumn("status", status).withColumns({
        "severity": severe,
        "observed": F.when(known, o).when(distance.isNotNull(), rank(F.col("current_rating")).cast(wide)),
        "threshold": t,
        "headroom": F.when(known, room.cast(wide)).when(distance.isNotNull(), (-distance).cast(wide)),
        "explanation": words,
    })
    return out.drop("_observed", "_threshold", "_operator", "_distance")


def breaches(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("status = 'breach'")


def verdict_counts(evaluated: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Breaches, at-risk and undecided verdicts of each instrument."""
    return evaluated.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("breach", "breaches"), ("at_risk", "at_risk"), ("insufficient_data", "insufficient"))])


def breach_board(evaluated: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Instruments, worst first: breaches, then at-risk, then the key."""
    return verdict_counts(evaluated, key).orderBy(F.desc("breaches"), F.desc("at_risk"), key)


def evaluate_book(holdings: DataFrame, covenants: DataFrame, triggers: DataFrame, facts: DataFrame) -> DataFrame:
    """Every term of every held instrument in one pass: covenants and rating triggers together, joined with the facts."""
    held = holdings.select("instrument_id").distinct()
    own = triggers.select("instrument_id", F.lit("rating_trigger").alias("covenant_type"), "trigger_rating", "severity")
    terms = covenants.unionByName(own, allowMissingColumns=True).join(held, "instrument_id", "left_semi")
    return evaluate(terms.join(facts, "instrument_id", "left"))


def checked_terms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored terms whose decimals are strings -> (usable terms, rejects with their reason)."""
    cast = rows.withColumns({"threshold_ratio": F.col("threshold_ratio").try_cast("decimal(12,6)"), "threshold_amount": F.col("threshold_amount").try_cast("decimal(20,4)"), "_r": F.col("threshold_ratio"), "_a": F.col("threshold_amount")})
    reason = F.when(F.col("_r").isNotNull() & F.col("threshold_ratio").isNull(), "ratio is no number").when(F.col("_a").isNotNull() & F.col("threshold_amount").isNull(), "amount is no number").when(F.col("threshold_amount").isNotNull() & F.col("threshold_currency").isNull(), "amount without currency")
    marked = cast.withColumn("reason", reason).drop("_r", "_a")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
