"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and calls one operator of the llm subpackage on all that the stage before it kept.
All but the last return the columns of documents: doc_id, text, lang, source, n_chars. Only those columns are read, so others
may have any name. An empty table stays empty through every stage; rows with a null or shared doc_id are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.byte_bpe import encode_decode_digests
from pactum.llm.mixing import mix
from pactum.llm.shared import discard, materialize
from pactum.llm.simhash import without_near_duplicates
from pactum.llm.substrings import repeats
from pactum.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject. Labels of the held-out quarter are not read here either. A null,
    empty or wordless text has no evidence against it and is judged by the curve alone; without labels of both classes all
    scores are equal and below the threshold, so nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 == 2, carry=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id (null last), of equal ids that with the least
    hash of its text. Different texts stay, whatever their ids; null and wordless texts are copies of each other."""
    return without_near_duplicates(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that also stand elsewhere; a text without such words is left as it is, a
    null one stays null. Words that are left stand one space apart."""
    found = repeats(docs, carry=("text", "lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_text"))
    return found.withColumn("text", text).select("doc_id", "text", F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Null is a source of its own; a text without
    words has no size and is taken once."""
    mixed = mix(docs, carry=tuple(COLUMNS[1:])).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *[F.col(f"_{c}").alias(c) for c in COLUMNS[1:]])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document; a null text is empty and has no ids."""
    import public_tokenizers

    return encode_decode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substrings", cut_repeats), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL cannot express language models, meet-in-the-middle hashing, Newton's method or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written as Parquet to the shared folder and read again, and
    deleted once the stage after it is written."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if kept is not None:
            discard(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
