"""Tables that are kept between runs: Parquet folders hashed into buckets by key. A change reads and rewrites the buckets that
it touches, by dynamic partition overwrite; a run that changes nothing writes nothing.

A changed bucket is written aside in full before it takes the old one's place. Changes are stated by key, so a run that
failed is simply run again with the same rows. One writer at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.text import token_estimate
from pactum.operators.retrieval import hashed_embedding, postings
from pactum.sources.tables import discard, saved

BUCKETS, FILE_ROWS = 64, 1_000_000


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path with its column `bucket`; empty if nothing was ever written."""
    kinds = f"{schema}, bucket int"
    return spark.read.schema(kinds).option("mergeSchema", "false").parquet(path) if exists(spark, path) else spark.createDataFrame([], kinds)


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _touched(df: DataFrame) -> list[int]:
    """The buckets that occur, of which there are never more than the table has."""
    return sorted(r.bucket for r in df.select("bucket").distinct().collect())


def replace_rows(path: str, groups: DataFrame, new: DataFrame, keys: list[str], buckets: int = BUCKETS, file_rows: int = FILE_ROWS) -> list[int]:
    """Rows of the table whose keys are in `groups` (each once) give way to `new`, which has any number of rows for each key, or
    none. -> the buckets rewritten, in files of some file_rows rows. Keys are not null. The number of buckets is the table's
    for good: a change costs its buckets, so large tables want many."""
    spark, own = groups.sparkSession, groups.withColumn("bucket", _bucket(keys, buckets))
    touched = _touched(own)
    if not touched:
        return []
    kept = read_stored(spark, path, _kinds(new)).where(F.col("bucket").isin(touched)).join(own.select(*keys), keys, "left_anti")
    rows = saved(kept.unionByName(new.withColumn("bucket", _bucket(keys, buckets))))
    # a bucket is as many tasks' as it has files
    files = max(1, -(-rows.count() // (len(touched) * file_rows)))
    rows.repartition("bucket", F.pmod(F.hash(*keys), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows).partitionBy("bucket").parquet(path)
    # a bucket that nothing is left of is not overwritten by anything
    for bucket in set(touched) - set(_touched(rows)):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    discard(rows)
    return touched


def changed(path: str, new: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of `new` (each key once) that the table lacks or has with another value; only the buckets of new rows are read."""
    rows = new.withColumn("bucket", _bucket(keys, buckets))
    old = read_stored(new.sparkSession, path, _kinds(new)).where(F.col("bucket").isin(_touched(rows)))
    values = [c for c in new.columns if c not in keys]
    known = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_known"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in values], F.lit(True))
    return rows.drop("bucket").join(known, keys, "left").where(F.col("_known").isNull() | ~same).select(*new.columns)


def upsert_stored(path: str, new: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """Puts rows of `new` (each key once) into the table, in place of those with their key. -> the buckets rewritten: none if
    nothing changes."""
    rows = saved(changed(path, new, keys, buckets))
    out = replace_rows(path, rows.select(*keys), rows, keys, buckets)
    discard(rows)
    return out


def store_pages(path: str, pages: DataFrame, order: str, buckets: int = BUCKETS) -> list[int]:
    """Page telemetry by (document_id, page_number); of several rows for a page in `pages` the last by `order` counts."""
    last = pages.groupBy("document_id", "page_number").agg(F.max_by(F.struct(*pages.columns), order).alias("r")).select("r.*")
    return upsert_stored(path, last, ["document_id", "page_number"], buckets)


def append_new(path: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """Adds the rows whose key is not there yet, each key once; what is there stays as it is."""
    fresh = rows.dropDuplicates(keys).withColumn("bucket", _bucket(keys, buckets))
    there = read_stored(rows.sparkSession, path, _kinds(rows)).where(F.col("bucket").isin(_touched(fresh)))
    own = saved(fresh.join(there.select(*keys), keys, "left_anti").drop("bucket"))
    out = replace_rows(path, own.select(*keys), own, keys, buckets)
    discard(own)
    return out


def store_chunks(path: str, chunks: DataFrame, buckets: int = BUCKETS) -> list[int]:
    return append_new(path, chunks, ["document_id", "hash"], buckets)


def store_index(path: str, chunks: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame] | None = None, dimensions: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """chunks(chunk_id, chunk_text[, fts_config]) -> `{path}/postings` (chunk_id, fts_config, lexeme, tf) and `{path}/vectors`
    (chunk_id, sha256, model, tokens, places, weights), both by chunk. Chunks whose text and model are there already are not
    worked out again; a chunk whose text or model changed is replaced in both. -> the buckets rewritten.

    embed takes (chunk_id, chunk_text) and gives (chunk_id, places array<int>, weights array<double>); the default is the hashed bag of words.
    A chunk without words has an empty vector. With `dimensions` a place at or beyond it is an error."""
    config = F.col("fts_config") if "fts_config" in chunks.columns else F.lit("simple")
    own = chunks.select("chunk_id", "chunk_text", config.alias("fts_config"))
    state = own.select("chunk_id", F.sha2(F.concat_ws("|", "fts_config", F.coalesce("chunk_text", F.lit(""))).cast("binary"), 256).alias("sha256"), F.lit(model).alias("model"), token_estimate(F.coalesce("chunk_text", F.lit(""))).alias("tokens"))
    vectors = f"{path}/vectors"
    known = read_stored(own.sparkSession, vectors, f"{_kinds(state)}, places array<int>, weights array<double>")
    todo = saved(state.join(known.select("chunk_id", "sha256", "model"), ["chunk_id", "sha256", "model"], "left_anti").dropDuplicates(["chunk_id"]))
    work = own.join(todo.select("chunk_id"), "chunk_id", "left_semi")
    made = embed(work.select("chunk_id", "chunk_text")) if embed else hashed_embedding(work).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("v")).select("chunk_id", F.col("v.bucket").alias("places"), F.col("v.weight").alias("weights"))
    if dimensions is not None:
        made = made.where(F.assert_true(F.coalesce(F.array_max("places"), F.lit(-1)) < dimensions, "a vector has another number of dimensions").isNull())
    rows = todo.join(made, "chunk_id", "left").withColumns({"places": F.coalesce("places", F.array().cast("array<int>")), "weights": F.coalesce("weights", F.array().cast("array<double>"))})
    # postings first: until a chunk's vector says that it is done, a run that failed does it again
    replace_rows(f"{path}/postings", todo.select("chunk_id"), postings(work), ["chunk_id"], buckets)
    out = replace_rows(vectors, todo.select("chunk_id"), rows, ["chunk_id"], buckets)
    discard(todo)
    return out
