"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Of all rates r between 0 and 2 with sum(r * size) = target in each source, entropy balancing takes those nearest to one
copy each in Kullback-Leibler terms. Its dual is convex, with one variable t for each source, and gives the rates
min(2, exp(t * size / mean size)). Newton's method solves it on counts by (source, size), which hold all the dual needs;
a step that leaves the bracket is replaced by bisection. Rates are whole multiples of 2**-24 and sums are exact
decimals, so that reruns agree to the last bit whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.shared import discard, materialize

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
SHIFT, SALTS, STARTS = 24, 64, 32
UNIT = 1 << SHIFT
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, docs) -> the same with target. Sources take the weights in code-point order, null last, repeating.
    Together they get share times all words; none gets more than most times its own, and what is over is shared by
    weight among the others. A full source stays full when more is shared out, so those with the least size for their
    weight fill first and one pass in that order ends the sharing. The table has one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    everything, fill = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    room = F.least(F.lit(share), F.lit(most)) * F.sum("source_size").over(everything)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (room - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = ranked.withColumns({"level": level, "k": F.row_number().over(fill)})
    first = F.min(F.when(most * F.col("source_size") > F.col("level") * F.col("w"), F.col("k"))).over(everything)
    rest = F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everything)
    shared = filled.withColumn("first", first).withColumn("rest", rest)
    full = F.col("first").isNull() | (F.col("k") < F.col("first"))
    return shared.select("source", "source_size", "docs", F.when(full, most * F.col("source_size")).otherwise(F.col("rest") * F.col("w")).cast("double").alias("target"))


def _rate(t, size, mean):
    """The rate in units of 2**-24."""
    return F.least(F.lit(2 * UNIT), F.round(F.exp(F.least(t * size / mean, F.lit(1.0))) * UNIT)).cast("long")


def solve_rates(counts: DataFrame, targets: DataFrame, tolerance: float = 1e-6, max_rounds: int = 60) -> DataFrame:
    """counts(source, size, n), targets(source, source_size, docs, target) -> (source, size, n, rate in units of 2**-24).

    Only the largest miss, one number, comes to the driver. A source whose target is twice its size gets rate 2
    throughout; sizes of 0 get rate 1. A source whose sizes are all equal and large has a single rate."""
    goal = F.col("target")
    state = materialize(targets.withColumns({"mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)), "t": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0), "miss": F.lit(1.0)}))
    for _ in range(max_rounds):
        rate = _rate(F.col("t"), F.col("size"), F.col("mean"))
        words = F.col("n").cast("decimal(38,0)") * F.col("size") * rate
        steep = F.when(rate < 2 * UNIT, words * F.col("size"))
        sums = counts.join(state, F.col("s") == F.col("source_key")).groupBy("source_key").agg(
            F.sum(words.cast("decimal(38,0)")).cast("double").alias("got"), F.coalesce(F.sum(steep.cast("decimal(38,0)")).cast("double"), F.lit(0.0)).alias("slope")
        )
        got, slope = F.coalesce(F.col("got"), F.lit(0.0)) / UNIT, F.col("slope") / UNIT / F.col("mean")
        low, high = F.when(got < goal, F.col("t")).otherwise(F.col("low")), F.when(got >= goal, F.col("t")).otherwise(F.col("high"))
        step = F.col("t") - F.try_divide(got - goal, slope)
        moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.abs(got - goal) <= tolerance * F.greatest(goal, F.lit(1.0))
        full = goal >= MOST * F.col("source_size")
        old, state = state, materialize(state.drop("miss").join(sums, "source_key", "left").withColumns({
            "t": F.when(full, F.lit(1e12)).when(done, F.col("t")).otherwise(moved), "low": low, "high": high,
            "miss": F.when(full | done | (high - low < 1e-12), F.lit(0.0)).otherwise(F.abs(got - goal)),
        }).select(*state.columns))
        discard(old)
        if not (state.agg(F.max("miss")).first()[0] or 0.0):
            break
    return state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, carried columns as _name) of every row: copies is 0, 1 or 2 and taken is copies * size.

    A document's size is its number of words [^\\x20\\x09-\\x0D]+ (null: 0); null is a source of its own. Rates become
    copies by systematic rounding in order of size: document i of a source gets the whole numbers passed between the
    rates' running sums before and after it, so a source misses its target by less than its largest document; of 32
    places to begin at, each source takes the one that misses least. The running sum is taken over (source, size) counts and then over hash slices of a size, so that neither a large
    source nor thousands of equal documents meet in one task. Repeated rows are documents of their own; an empty table
    gives an empty result."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"),
        F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name")).alias("source_key"), F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col))), F.lit(SALTS)).alias("salt"), F.xxhash64(F.col(text_col)).alias("hash"), *[F.col(c).alias(f"_{c}") for c in carry]))
    slices = materialize(sized.groupBy("source_key", "size", "salt").agg(F.count("*").alias("n")))
    counts = slices.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    sources = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")).withColumn("source", F.when(~F.col("source_key.none"), F.col("source_key.name")))
    targets = source_targets(sources).withColumn("source_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).drop("source")
    state = solve_rates(counts.withColumnRenamed("source_key", "s"), targets)
    by_size = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = counts.join(state, "source_key").select("source_key", "size", "n", "source_size", "target", _rate(F.col("t"), F.col("size"), F.col("mean")).alias("rate"))
    summed = rated.withColumn("base", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(by_size), F.lit(0)))
    tried = summed.withColumn("begin", F.explode(F.array(*[F.lit((2 * k + 1) * UNIT // (2 * STARTS)).cast("long") for k in range(STARTS)])))
    passed = F.shiftright(F.col("base") + F.col("begin") + F.col("rate") * F.col("n"), SHIFT) - F.shiftright(F.col("base") + F.col("begin"), SHIFT)
    missed = tried.groupBy("source_key", "begin").agg(F.abs(F.sum(F.col("size") * passed) - F.max("target")).alias("miss"))
    begin = missed.groupBy("source_key").agg(F.min(F.struct("miss", "begin")).getField("begin").alias("begin"))
    begun = summed.join(begin, "source_key").withColumn("base", F.col("base") + F.col("begin")).drop("n", "begin")
    by_salt = Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("before", F.coalesce(F.sum("n").over(by_salt), F.lit(0))).drop("n").join(begun, ["source_key", "size"])
    own = Window.partitionBy("source_key", "size", "salt").orderBy("doc_id", "hash")
    placed = sized.withColumn("place", F.row_number().over(own)).join(offsets, ["source_key", "size", "salt"])
    after = F.col("base") + F.col("rate") * (F.col("before") + F.col("place"))
    copies = F.shiftright(after, SHIFT) - F.shiftright(after - F.col("rate"), SHIFT)
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[f"_{c}" for c in carry])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
