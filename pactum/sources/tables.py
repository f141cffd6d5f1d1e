"""Reading and loading tables: driver tables with exact money, content dedup, admission, upserts, idempotent runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_UPLOAD = 100 << 20
MAGIC = "%PDF-"


def read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; without that setting a session that runs in one
    process gets a temporary one, and a cluster an error."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not base and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='pactum-')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written once to a work folder and read back, where several later steps start from it. Whoever is done with it
    discards it; what a returned DataFrame still reads goes with clear_saved()."""
    path = f"{work_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    _saved().append(path)
    return out


_SAVED: list[str] = []
_INNER: ContextVar[list[str] | None] = ContextVar("saved", default=None)


def _saved() -> list[str]:
    inner = _INNER.get()
    return _SAVED if inner is None else inner


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What saved() writes inside is deleted at the end: for a job that stores its results inside."""
    token = _INNER.set([])
    try:
        yield
    finally:
        clear_saved(spark)
        _INNER.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once nothing is going to read them again."""
    for df in tables:
        _delete(df.sparkSession, df.folder)
        _saved().remove(df.folder)


def clear_saved(spark: SparkSession) -> None:
    """Deletes all that saved() has written and nobody has discarded: at the end of a job, when its results are stored."""
    while _saved():
        _delete(spark, _saved().pop())


def spread(df: DataFrame) -> DataFrame:
    """A table of few files in as many partitions as there are cores, for work that is heavy by row; one that already has as
    many partitions is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_of_content(uploads: DataFrame, content: str = "content", order: tuple[str, ...] = ("arrived_at", "upload_id")) -> DataFrame:
    """Adds sha256 and duplicate: of uploads with the same bytes the first is the document."""
    rows = uploads.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("sha256").orderBy(*order)) > 1)


def admit(files: DataFrame, most: int = MAX_UPLOAD, magic: str = MAGIC) -> tuple[DataFrame, DataFrame]:
    """Files (content binary, as the binaryFile source reads them) -> (accepted, rejected with the reason)."""
    reason = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").when(F.length("content") > most, "too large").when(F.substring("content", 1, len(magic)) != F.lit(magic).cast("binary"), "not the right format")
    rows = files.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def upsert(kept: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with the latest row of each key, new rows winning ties."""
    rows = kept.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_new")


def only_new(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, each key once."""
    return rows.dropDuplicates(keys).join(kept, keys, "left_anti")


IDENTITY = ["document_sha256", "job_type", "prompt_version", "model_id", "extractor_version"]


def still_to_do(work: DataFrame, jobs: DataFrame) -> DataFrame:
    """Work whose whole identity has not succeeded; missing parts of an identity are equal."""
    a, b = work.alias("a"), jobs.where("status = 'succeeded'").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY[1:]]
    on = F.col("a.document_sha256") == F.col("b.document_sha256")
    for test in same:
        on = on & test
    return a.join(b, on, "left_anti")


HUMAN = ("approved", "corrected", "rejected")


def replace_machine_output(clauses: DataFrame, new: DataFrame, reviews: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rerun of documents: their machine-made clauses give way to the new ones, what a person decided on stays, and pending
    reviews of the rows that go, go with them. -> (clauses, reviews)."""
    doomed = clauses.where(~F.coalesce(F.col("review_status"), F.lit("")).isin(*HUMAN)).join(documents, "document_id", "left_semi")
    kept = clauses.join(doomed.select("clause_id"), "clause_id", "left_anti")
    gone = doomed.select(F.col("clause_id").alias("entity_id"), F.lit("pending").alias("status"))
    return kept.unionByName(new, allowMissingColumns=True), reviews.join(gone, ["entity_id", "status"], "left_anti")


# The columns of each table that analysts may read.
READABLE = {
    "instruments": ["instrument_id", "issuer_name", "instrument_name", "instrument_type", "currency", "isin", "issue_size", "maturity_date", "current_rating", "current_rating_rank", "rating_agency"],
    "portfolio_holdings": ["portfolio_id", "instrument_id", "as_of_date", "quantity", "market_value", "nav_weight"],
    "covenants": ["covenant_id", "clause_id", "instrument_id", "covenant_type", "threshold_amount", "threshold_currency", "severity", "method", "confidence"],
    "clauses": ["clause_id", "document_id", "clause_type", "source_quote", "page_number", "citation_verified"],
    "call_schedules": ["instrument_id", "call_date", "call_price", "call_type"],
    "rating_triggers": ["instrument_id", "source_clause_id", "rating_agency", "trigger_rating", "trigger_rank", "trigger_direction", "severity"],
}


def publish_views(tables: dict[str, DataFrame]) -> list[str]:
    """Temporary views of the readable tables with their readable columns, whole; other tables stay hidden."""
    names = []
    for name, columns in READABLE.items():
        if name in tables:
            tables[name].select(*[c for c in columns if c in tables[name].columns]).createOrReplaceTempView(name)
            names.append(name)
    return names


def analyst_result(spark: SparkSession, statement: str, most: int = 1000) -> DataFrame:
    """An analyst's statement over the views: it reads all rows, and at most `most` rows of its result come back."""
    return spark.sql(statement).limit(most)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only sinks: audit and query logs, evaluation results (json)."""
    df.write.mode("append").format(fmt).save(path)
