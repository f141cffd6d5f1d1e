"""Search over chunks: postings, keyword top-k, vector top-k, reciprocal rank fusion, evaluation by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions.stemming import english_stem, is_stop_word
from pactum.sources.tables import discard, saved

OFFSET, OVERSAMPLE, DIMENSIONS = 60, 4, 1024
#: Postings of a block; deals of a lexeme's postings; queries that meet a part's vectors in one product.
BLOCK, SALTS, QUERIES_AT_ONCE = 128, 8, 256


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def _stemmed(words: DataFrame) -> DataFrame:
    """Adds lexeme to (fts_config, word, ...): under `english` the stem, and no row for a stop word; elsewhere the word. Stems are
    worked out once for each distinct word."""
    english = words.where("fts_config = 'english'").select("word").distinct().where(~is_stop_word(F.col("word")))
    stems = english.select(F.lit("english").alias("fts_config"), "word", english_stem(F.col("word")).alias("_stem"))
    joined = words.join(stems, ["fts_config", "word"], "left")
    return joined.withColumn("lexeme", F.when(F.col("fts_config") == "english", F.col("_stem")).otherwise(F.col("word"))).where("lexeme is not null").drop("_stem")


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", wanted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, fts_config, lexeme, tf); of the lexemes in wanted(fts_config, lexeme) only, if it is given, so that other words are
    not shuffled. Each row is indexed under its own configuration: `english` has stems and no stop words, any other has the words
    as they are, and so have chunks without the column fts_config."""
    config = F.coalesce("fts_config", F.lit("simple")) if "fts_config" in chunks.columns else F.lit("simple")
    words = chunks.select(F.col(id_col).alias("chunk_id"), config.alias("fts_config"), F.explode(terms(F.col(text_col))).alias("word"))
    words = _stemmed(words) if "fts_config" in chunks.columns else words.withColumnRenamed("word", "lexeme")
    words = words if wanted is None else words.join(wanted, ["fts_config", "lexeme"], "left_semi")
    return words.groupBy("chunk_id", "fts_config", "lexeme").agg(F.count("*").alias("tf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, fts_config, lexeme) of queries(query_id, question), each once: a row is asked for the words as its own
    configuration has them."""
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("word"))
    return _stemmed(words.withColumn("fts_config", F.explode(F.array(F.lit("english"), F.lit("simple"))))).select("query_id", "fts_config", "lexeme").distinct()


LEXEME = ["fts_config", "lexeme"]


def posting_blocks(index: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """postings -> (blocks, directory). A lexeme's postings are banded by impact (powers of two of tf) and a band is dealt into
    blocks of some `block` postings by chunk, so a frequent lexeme is many rows: (fts_config, lexeme, band, part, top,
    postings), top being the block's largest tf. The directory has a row for each lexeme: its bands, highest first, with their
    parts, postings and largest tf."""
    rows = index.withColumn("band", F.floor(F.log2("tf")).cast("int"))
    bands = rows.groupBy(*LEXEME, "band").agg(F.count("*").alias("n"), F.max("tf").alias("top")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    wide = bands.where("parts > 1").select(*LEXEME, "band", "parts")
    dealt = rows.join(wide, [*LEXEME, "band"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("chunk_id"), "parts"), F.lit(0)).cast("int"))
    blocks = dealt.groupBy(*LEXEME, "band", "part").agg(F.max("tf").alias("top"), F.collect_list(F.struct("chunk_id", "tf")).alias("postings"))
    directory = bands.groupBy(*LEXEME).agg(F.sort_array(F.collect_list(F.struct("band", "parts", "n", "top")), asc=False).alias("bands"))
    return blocks, directory


def _asked_bands(directory: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, fts_config, lexeme, bands, others): others is the most that a query's other lexemes can add to a chunk."""
    asked = asked_terms(queries).join(directory, LEXEME).withColumn("most", F.array_max(F.transform("bands", lambda b: b["top"])))
    return asked.withColumn("others", F.sum("most").over(Window.partitionBy("query_id", "fts_config")) - F.col("most"))


def _hits(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """wanted(query_id, fts_config, lexeme, band, parts[, others, floor]): the postings of those blocks; with a floor, of those
    that can still reach it."""
    met = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(blocks, [*LEXEME, "band", "part"])
    met = met.where(F.col("top") + F.col("others") >= F.col("floor")) if "floor" in wanted.columns else met
    return met.select("query_id", F.explode("postings").alias("p")).select("query_id", "p.chunk_id", "p.tf")


def needed_bands(blocks: DataFrame, directory: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, fts_config, lexeme, band, parts, others, floor): what has to be read for the top k. A first look at the
    highest bands of each lexeme, k postings or so, gives each query a floor that its k-th score cannot be below; a band is
    needed if its largest tf and all that the query's other lexemes can add reach the floor. A chunk of the top k has all its
    postings in needed bands, since its score is no more than that of its band and those others."""
    asked = _asked_bands(directory, queries)
    higher = lambda bands, b: F.aggregate(F.filter(bands, lambda x: x["band"] > b["band"]), F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
    first = asked.select("query_id", *LEXEME, F.explode(F.filter("bands", lambda b: higher(F.col("bands"), b) < k)).alias("b"))
    some = first.select("query_id", *LEXEME, "b.band", F.least(F.col("b.parts"), F.lit(-(-2 * k // block))).alias("parts"))
    seen = _hits(some, blocks).groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("tf"))
    best = Window.partitionBy("query_id").orderBy(F.desc("tf"))
    floors = seen.withColumn("_k", F.row_number().over(best)).where(F.col("_k") == k).select("query_id", F.col("tf").alias("floor"))
    wanted = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    return wanted.select("query_id", *LEXEME, "others", "floor", F.explode(F.filter("bands", lambda b: b["top"] + F.col("others") >= F.col("floor"))).alias("b")).select("query_id", *LEXEME, "b.band", "b.parts", "others", "floor")


def search_blocks(blocks: DataFrame, directory: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """queries(query_id, question) -> (query_id, chunk_id, score, rank): any term may match, the score is a tenth of the
    matched occurrences, ties to the smaller chunk_id; a question without terms finds nothing. Exact: blocks that cannot reach
    a query's floor are not read for it."""
    found = _hits(needed_bands(blocks, directory, queries, k, block), blocks)
    return _top(found.groupBy("query_id", "chunk_id").agg((F.sum("tf") / 10).alias("score")), k)


def keyword_top(index: DataFrame, queries: DataFrame, k: int = 10, salts: int = SALTS) -> DataFrame:
    """What search_blocks() finds, from postings() that no one has blocked yet: every posting asked for is read, once. A lexeme's
    postings are dealt by chunk, and its questions sent to each deal, so a frequent one is no task's alone."""
    left = index.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    right = asked_terms(queries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _top(left.join(right, [*LEXEME, "salt"]).groupBy("query_id", "chunk_id").agg((F.sum("tf") / 10).alias("score")), k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)


def unit(e: Column) -> Column:
    """A vector of length 1 in double precision, null for one without a direction."""
    x = e.cast("array<double>")
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm))


_SCORED = "query_id {q}, chunk_id {c}, score double"


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    vectors = column.combine_chunks()
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each column of scores the places of its k largest, ties to the smaller id."""
    for j in range(scores.shape[1]):
        own = scores[:, j]
        some = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
        yield j, some[np.lexsort((ids[some], -own[some]))][:k]


def _scores(k: int):
    """Cosines of a part's vectors and the queries sent there, as one product of matrices; k rows for each query go on."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            v, ids = _rows(left.column("v")), np.asarray(left.column("chunk_id").to_pylist())
            asked = right.column("query_id").to_pylist()
            for at in range(0, len(asked), QUERIES_AT_ONCE):
                own = right.slice(at, QUERIES_AT_ONCE)
                # equal vectors have equal scores, however the product is cut
                scores = np.round(v @ _rows(own.column("q")).T, 9)
                out += [(asked[at + j], ids[i].item(), float(scores[i, j])) for j, best in _best_of(scores, ids, k) for i in best]
        return pa.table({"query_id": pa.array([x[0] for x in out], right.schema.field("query_id").type), "chunk_id": pa.array([x[1] for x in out], left.schema.field("chunk_id").type), "score": pa.array([x[2] for x in out], pa.float64())})

    return score


def _scored_ddl(vectors: DataFrame, queries: DataFrame) -> str:
    return _SCORED.format(q=queries.schema["query_id"].dataType.simpleString(), c=vectors.schema["chunk_id"].dataType.simpleString())


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None) -> DataFrame:
    """vectors(chunk_id, embedding, model), queries(query_id, embedding, model) -> the k most similar of the same model and
    length, by cosine to nine places, ties to the smaller chunk_id. Vectors are dealt into parts, the stated queries are sent to
    each part, and k rows for each query and part go on. Vectors without a direction are found by nothing and find nothing."""
    parts = parts or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = vectors.select("chunk_id", "model", unit(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part")).where("v is not null").withColumn("size", F.size("v"))
    right = queries.select("query_id", F.col("model").alias("_model"), unit(F.col("embedding")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")).where("q is not null").withColumn("_size", F.size("q"))
    # keys of other names: both sides may come from one table
    return _top(left.groupBy("model", "size", "part").cogroup(right.groupBy("_model", "_size", "_part")).applyInArrow(_scores(k), _scored_ddl(vectors, queries)), k)


def _codes(tables: int, bits: int, probes: int, seed: int = 7):
    """(.., v) -> a row for each table: on which side of `bits` random planes a vector lies, and, of `probes` codes in all,
    those that it would have if the planes nearest to it were on its other side."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = sorted(range(1 << bits), key=lambda x: (x.bit_count(), x))
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                v = _rows(pa.chunked_array([own.column("v")]))
                planes = np.random.default_rng(seed).standard_normal((tables, size, bits))
                for t in range(tables):
                    far = v @ planes[t]
                    near, side = np.argsort(np.abs(far), axis=1), (far > 0).astype(np.int64)
                    base = (side << np.arange(bits)).sum(1)
                    # the cheapest flips first: by the sum of the distances that they cross
                    cost = np.stack([np.sort(np.abs(far), axis=1)[:, [b for b in range(bits) if x >> b & 1]].sum(1) for x in flips], axis=1)
                    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                    for p in range(order.shape[1]):
                        flip = np.asarray(flips)[order[:, p]]
                        mask = sum(((flip >> b & 1) << near[:, b] for b in range(bits)), np.zeros(len(v), np.int64))
                        yield pa.RecordBatch.from_arrays([*[own.column(c) for c in own.schema.names], pa.array(np.full(len(v), t), pa.int32()), pa.array(base ^ mask, pa.int64())], names=[*own.schema.names, "hash_table", "code"])

    return code


def projection_buckets(vectors: DataFrame, tables: int = 8, bits: int = 6) -> DataFrame:
    """vectors(chunk_id, embedding, model) -> the index (chunk_id, model, v, size, hash_table, code): a row for each of `tables`
    random projections, each with 2**bits buckets."""
    own = vectors.select("chunk_id", "model", unit(F.col("embedding")).alias("v")).where("v is not null").withColumn("size", F.size("v"))
    return own.mapInArrow(_codes(tables, bits, 1), f"{_ddl(own)}, hash_table int, code bigint")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def bucket_top(index: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, bits: int = 6, probes: int = 4, parts: int | None = None) -> DataFrame:
    """The k most similar of the chunks that share one of a query's `probes` buckets in one of the tables, compared exactly. Buckets
    are dealt into a part for every 65,536 vectors of the index, so that a crowded one is no task's alone."""
    parts = parts or max(1, -(-index.count() // (tables << 16)))
    asked = queries.select("query_id", "model", unit(F.col("embedding")).alias("v")).where("v is not null").withColumn("size", F.size("v"))
    probed = asked.mapInArrow(_codes(tables, bits, probes), f"{_ddl(asked)}, hash_table int, code bigint").withColumnRenamed("v", "q")
    right = probed.select("query_id", "q", *[F.col(c).alias(f"_{c}") for c in ("model", "size", "hash_table", "code")], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    left = index.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    keys = ["model", "size", "hash_table", "code", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInArrow(_scores(k), _scored_ddl(index, queries))
    return _top(found.distinct(), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: rows of `exact` (query_id, chunk_id), how many of them were found, and their share (1 of none)."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("_hit").alias("found")).withColumn("recall", F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0)))


def vector_top_indexed(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.9, audited: int = 64, tables: int = 8, bits: int = 6) -> tuple[DataFrame, int]:
    """bucket_top() with as few probes as a sample of the queries needs: (result, probes). The sample (at most `audited`
    queries, by a hash of their id) is answered by the exact leg too, and probes are doubled until its recall is `least`; with all
    buckets probed the index is exact."""
    index, probes = saved(projection_buckets(vectors, tables, bits)), 2
    sample = saved(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(audited))
    exact = saved(vector_top(vectors, sample, k))
    while probes < 1 << bits and recall(bucket_top(index, sample, k, tables, bits, probes), exact).first().recall < least:
        probes *= 2
    discard(sample, exact)
    return bucket_top(index, queries, k, tables, bits, min(probes, 1 << bits)), probes


def fuse(legs: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, chunk_id, rank): sum of 1 / (60 + rank)."""
    every = legs[0].select("query_id", "chunk_id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "chunk_id", "rank"))
    return _top(every.groupBy("query_id", "chunk_id").agg(F.sum(1 / (OFFSET + F.col("rank"))).alias("score")), k)


def hybrid(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return fuse([keyword_top(index, queries, k * OVERSAMPLE), vector_top(vectors, queries, k * OVERSAMPLE)], k)


def semantic_candidates(hits: DataFrame, per_exemplar: int = 3, cap: int = 25) -> DataFrame:
    """hits(document_id, exemplar, leg, chunk_id, score) -> the best of each leg above its floor, one row a chunk with its
    best score and legs, at most cap a document."""
    floored = hits.where(((F.col("leg") == "fts") & (F.col("score") >= 1.0)) | ((F.col("leg") == "vector") & (F.col("score") >= 0.40)))
    near = Window.partitionBy("document_id", "exemplar", "leg").orderBy(F.desc("score"), "chunk_id")
    best = floored.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= per_exemplar)
    one = best.groupBy("document_id", "chunk_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("leg")).alias("legs"), F.sort_array(F.collect_set("exemplar")).alias("exemplars"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("place") <= cap)


def hashed_embedding(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", width: int = DIMENSIONS, number: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(chunk_id, bucket, weight): bag-of-words vectors, 1 + ln(tf) by bucket, of length 1; a text without words has no rows. A
    word's bucket is its `number` modulo the width. Words are as they stand, whatever a chunk's configuration."""
    bucket = F.pmod(number(F.col("lexeme")), F.lit(width)).cast("int").alias("bucket")
    raw = postings(chunks.select(id_col, text_col), id_col, text_col).select("chunk_id", bucket, "tf").groupBy("chunk_id", "bucket").agg((1 + F.log(F.sum("tf"))).alias("w"))
    norms = raw.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "chunk_id").select("chunk_id", "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def wrong_dimensions(vectors: DataFrame, width: int = DIMENSIONS) -> DataFrame:
    return vectors.where(F.size("embedding") != width)


def model_mismatch(vectors: DataFrame, query_model: str) -> DataFrame:
    """Embedding models in the index other than the query's."""
    return vectors.select("model").distinct().where(F.col("model") != query_model)


def unembedded(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding is null")


def mean_reciprocal_rank(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """relevant(query_id, chunk_id): the mean over its queries of one over the first relevant rank, 0 if none is found."""
    first = relevant.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return first.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))
