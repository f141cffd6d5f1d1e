"""Token ids in a content-addressed store.

Texts become ids; a rolling hash over the ids cuts each document into chunks wherever its low bits are zero, so equal
passages give equal chunks. A chunk is kept once, under the SHA-256 of its ids as bytes; a document is a recipe, the list
of its chunks; a manifest is a Merkle tree over the recipes in ascending order of doc_id. Documents are read back only if
the recipes still have the manifest's digests, and a chunk only if it has its own. A task sends each chunk on once, so a
passage that all documents share is as many short rows as there are tasks. Three Parquet tables below one folder:

chunks   digest, n, payload (the ids as little-endian 16 or 32-bit unsigned integers, compressed with zstd)
recipes  doc_id, start, n_tokens, digests, lengths, shard, place; sorted by doc_id within shards, shards in order
manifest level, shard, block, digest: blocks of 1,024 recipes (level 0), shards (1) and the whole (2)
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.shared import mix, shared_folder, slices

#: Ids that decide a cut; mean distance of cuts; least and greatest length of a chunk.
SPAN, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Words whose ids a worker keeps, twice: when as many are new, those not met since the last time are let go.
KEPT_WORDS = 600_000
BLOCK = 1024

_tokenizers: dict[tuple[str, str], _Words] = {}
#: What the byte-level step makes of each byte: printable Latin-1 stays, the rest follows from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_SHOWN = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


_ID = attrgetter("id")
#: Signs that end words; the apostrophe, which the tokenizer treats by what follows, is none of them.
_SIGNS = b".,;:!?*%&$#\")]}-"


class _Words(dict):
    """Packed ids of words, encoded by the tokenizers library when they are first met; one for each Python worker.

    The rules of this tokenizer (lower case, runs of letters, of other signs, single digits) never join what white space
    parts, nor a run of letters and the sign after it, so a word's ids are those of its runs. Plain runs of letters go to
    the library's model directly, everything else through all of its steps."""

    def __init__(self, path: str, code: str = "I"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.code = Tokenizer.from_file(path), code
        self.runs, self.old, self.old_runs, self.signs = {}, {}, {}, {}
        self.tokenize = self.library.model.tokenize
        self.plain = _splits_runs(self.library)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, run: bytes) -> bytes:
        """Ids of a lower-case run of letters."""
        got = self.old_runs.get(run)
        if got is None:
            if run.isascii():
                got = array(self.code, map(_ID, self.tokenize(run.decode()))).tobytes()
            else:
                got = array(self.code, map(_ID, self.tokenize(run.decode("latin-1").translate(_SHOWN)))).tobytes()
        self.runs[run] = got
        return got

    def signed(self, tail: bytes) -> bytes:
        """Ids of a run of signs at the end of a word."""
        got = self.signs.get(tail)
        if got is None:
            if len(self.signs) > KEPT_WORDS:
                self.signs.clear()
            got = self.signs[tail] = self.whole(tail.decode())
        return got

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            if len(self) > KEPT_WORDS:
                self.old = dict(self)
                self.clear()
                self.runs, self.old_runs = {}, self.runs
            stem = word if word.isalpha() else word.rstrip(_SIGNS)  # of bytes: ASCII letters
            if stem.isalpha():
                low = stem.lower()
            else:
                text = stem.decode()
                low = text.lower()
                low = low.encode() if low.isalpha() and max(text) < "\u0250" else b""
            if low and self.plain:
                got = self.runs.get(low) or self.letters(low)
                if len(stem) < len(word):
                    got += self.signed(word[len(stem) :])
            else:
                got = self.whole(word.decode())
        self[word] = got
        return got


def _splits_runs(library) -> bool:
    """Whether the library's own rules treat letters, signs and case as _Words does: told by examples, so that another
    tokenizer's words go through all of its steps."""
    of = lambda x: library.encode(x, add_special_tokens=False).ids
    direct = lambda x: [t.id for t in library.model.tokenize(x.encode().decode("latin-1").translate(_SHOWN))]
    return all(of(x + s) == direct(x.lower()) + of(s) == of(x.lower()) + of(s) for x in ("Word", "\xc9t\xe9", "stra\xdfenbahnen", "a") for s in (".", ",", "***", ".&&", ")-", "]:"))


def encode_texts(texts: list[str], path: str, end_id: int, code: str = "I") -> list[np.ndarray]:
    """Ids of whole texts, end_id after each; code is the array type of the ids, I or H."""
    if (path, code) not in _tokenizers:
        _tokenizers[path, code] = _Words(path, code)
    get, end = _tokenizers[path, code].__getitem__, array(code, [end_id]).tobytes()
    return [np.frombuffer(b"".join([*map(get, text.encode().split()), end]), np.dtype(code)) for text in texts]


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places in ids, ascending, where the rolling sum of the last SPAN ids' hashes asks for a cut."""
    if len(ids) < SPAN:
        return np.zeros(0, int)
    total = np.cumsum(_HASHES[ids] if ids.dtype == np.uint16 else mix(ids.astype(np.uint64)), dtype=np.uint64)
    rolled = total[SPAN - 1 :].copy()
    rolled[1:] -= total[:-SPAN]
    return np.flatnonzero(rolled < np.uint64((1 << 64) // MEAN)) + SPAN


def cut(n: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of a document of n ids, given the marks within it."""
    ends, start = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - start > MOST:
            start += MOST
            ends.append(start)
        if mark - start >= LEAST or mark == n and mark > start:
            start = mark
            ends.append(start)
    return ends


_HASHES = mix(np.arange(1 << 16, dtype=np.uint64))


def _chunked(docs: DataFrame, path: str, end_id: int, wide: bool) -> DataFrame:
    """(kind, k, n, payload, recipe): a chunk row for each chunk that its task meets first, a recipe row for each document,
    under a digest of its id and chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[bytes] = set()  # digests of a task's chunks: some 32 bytes for each 500 ids of its part of the texts
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                keys, ns, payloads, recipes, kinds = [], [], [], [], []
                press = zstandard.ZstdCompressor(level=1)
                encoded = encode_texts([x or "" for x in part.column(1).to_pylist()], path, end_id, "I" if wide else "H")
                marks, at = cut_marks(np.concatenate(encoded)), 0
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    digests, lengths, start = [], [], 0
                    own_marks = marks[np.searchsorted(marks, at + SPAN) : np.searchsorted(marks, at + len(ids))] - at
                    at += len(ids)
                    for end in cut(len(ids), own_marks):
                        own = ids[start:end]
                        digest = hashlib.sha256(own.tobytes()).digest()
                        digests.append(digest)
                        lengths.append(end - start)
                        if digest not in seen:
                            seen.add(digest)
                            keys.append(digest)
                            ns.append(end - start)
                            payloads.append(press.compress(own.tobytes()))
                            recipes.append(None)
                            kinds.append("chunk")
                        start = end
                    keys.append(hashlib.sha256(f"{doc_id}|".encode() + b"".join(digests)).digest())
                    ns.append(len(ids))
                    payloads.append(None)
                    recipes.append({"doc_id": doc_id, "digests": digests, "lengths": lengths})
                    kinds.append("recipe")
                recipe = pa.struct([("doc_id", part.schema.field(0).type), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(payloads, pa.binary()), pa.array(recipes, recipe)], ["kind", "k", "n", "payload", "recipe"])

    return docs.mapInArrow(run, f"kind string, k binary, n bigint, payload binary, recipe struct<doc_id:{kind},digests:array<binary>,lengths:array<int>>")


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty, so only end_id) and writes the three tables below folder.

    Repeated rows are documents of their own, in a row; a null doc_id comes first. An empty table gives empty tables."""
    spark = docs.sparkSession
    wide = _Words(tokenizer).library.get_vocab_size() > 65535 or end_id > 65535
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _chunked(own, tokenizer, end_id, wide).repartition(parts, "k")
    once = rows.groupBy("kind", "k", "recipe").agg(F.first("payload").alias("payload"), F.first("n").alias("n"), F.count("*").alias("copies"))
    once.write.partitionBy("kind").parquet(f"{folder}/parts")
    written = spark.read.schema(once.schema).parquet(f"{folder}/parts")
    recipes = written.where("kind = 'recipe'").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("recipe.*", F.col("n").alias("n_tokens"), "copy")
    order = ["doc_id", "tie", "digests", "copy"]  # the rows of one id, and copies, may fill many shards
    recipes = recipes.withColumn("tie", F.xxhash64("digests"))
    recipes.repartitionByRange(parts, "doc_id", "tie", "copy").sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id()).write.parquet(f"{folder}/sorted")
    ordered = spark.read.schema(recipes.withColumn("shard", F.lit(0)).schema).parquet(f"{folder}/sorted")
    shards = ordered.groupBy("shard").agg(F.sum("n_tokens").alias("own")).withColumn("base", F.coalesce(F.sum("own").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = Window.partitionBy("shard").orderBy(*order)
    placed = ordered.join(F.broadcast(shards.select("shard", "base")), "shard").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(row) - 1)
    placed.select("doc_id", "start", "n_tokens", "digests", "lengths", "shard", "place").write.parquet(f"{folder}/recipes")
    manifest(read_recipes(spark, folder)).write.parquet(f"{folder}/manifest")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("kind string, k binary, n bigint, payload binary").parquet(f"{folder}/parts").where("kind = 'chunk'").select(F.col("k").alias("digest"), "n", "payload")


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/recipes")


def _digest_of(items: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(items), lambda x: x["digest"]), "").cast("binary"), 256)


def manifest(recipes: DataFrame) -> DataFrame:
    """(level, shard, block, digest): the Merkle tree over recipes. A node's digest is the SHA-256 of its children's, in order;
    no node has more than 1,024 leaves below it at once, or more children than there are blocks in a shard or shards."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string"), F.col("n_tokens").cast("string"), F.array_join(F.transform("digests", F.hex), ",")).cast("binary"), 256)
    blocks = recipes.groupBy("shard", (F.col("place") / BLOCK).cast("long").alias("block")).agg(_digest_of(F.collect_list(F.struct("place", leaf.alias("digest")))).alias("digest"))
    shards = blocks.groupBy("shard").agg(_digest_of(F.collect_list(F.struct("block", "digest"))).alias("digest"))
    whole = shards.agg(_digest_of(F.collect_list(F.struct("shard", "digest"))).alias("digest"))
    none = F.lit(None).cast("long")
    return blocks.select(F.lit(0).alias("level"), "shard", "block", "digest").union(shards.select(F.lit(1), "shard", none, "digest")).union(whole.select(F.lit(2), none.cast("int"), none, "digest"))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the manifest that differ from the tree over the recipes as they now are; empty if all is well."""
    kept, now = spark.read.parquet(f"{folder}/manifest"), manifest(read_recipes(spark, folder))
    return kept.exceptAll(now).union(now.exceptAll(kept))


def checked(spark: SparkSession, folder: str) -> None:
    """An error if the recipes are not those that the manifest was made of."""
    if not verify(spark, folder).isEmpty():
        raise ValueError(f"the recipes in {folder} do not match their manifest")


def _ids(digest: bytes, n: int, payload: bytes) -> np.ndarray:
    """A chunk's ids; an error if they are not what the digest names."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    if hashlib.sha256(data).digest() != digest:
        raise ValueError(f"chunk {digest.hex()} does not match its digest")
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, put together from its chunks once the manifest is found right."""
    checked(spark, folder)

    def run(batches):
        for batch in batches:
            ids = [_ids(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["digest", "ids"])

    pieces = read_recipes(spark, folder).select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("seq", "digest"))
    joined = pieces.join(read_chunks(spark, folder).mapInArrow(run, "digest binary, ids array<bigint>"), "digest")
    return joined.groupBy("doc_id", "start", "n_tokens").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"))


def _shift_tables(bits: int) -> list[np.ndarray]:
    """For each k, four tables of 256 that give a CRC-32 after 2**k zero bytes more."""

    def of(columns):
        tables = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                tables[byte][[v for v in range(256) if v >> bit & 1]] ^= columns[8 * byte + bit]
        return tables

    def apply(tables, x):
        return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]

    poly, one = np.uint32(0xEDB88320), []
    for bit in range(32):
        x = np.uint32(1 << bit)
        for _ in range(8):
            x = (x >> np.uint32(1)) ^ (poly if x & np.uint32(1) else np.uint32(0))
        one.append(x)
    out = [of(one)]
    for _ in range(bits - 1):
        columns = np.array([1 << b for b in range(32)], np.uint32)
        out.append(of(apply(out[-1], apply(out[-1], columns))))
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values carried past so many zero bytes, without the final inversions: the CRC of joined parts is the
    exclusive or of each part's CRC shifted past the bytes after it."""
    crc = crc.copy()
    for k, tables in enumerate(_shift_tables(max(1, int(zeros.max(initial=0)).bit_length()))):
        on = (zeros >> k & 1).astype(bool)
        x = crc[on]
        crc[on] = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]
    return crc


def _pieces(batches):
    """Recipes (doc_id, start, n_tokens, digests, lengths) -> a row for each chunk, with the bytes behind it in its document."""
    for batch in batches:
        n = np.diff(np.asarray(batch.column("digests").offsets))
        lengths = np.asarray(batch.column("lengths").flatten()).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        tail = 4 * (np.repeat(total[np.cumsum(n)], n) - total[1:])
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in ("doc_id", "start", "n_tokens")], batch.column("digests").flatten(), pa.array(tail)], ["doc_id", "start", "n_tokens", "digest", "tail"])


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document as the store holds it: the CRC-32 of its ids as little-endian
    32-bit integers. The recipes are held against the manifest first, each chunk is read once and checked against its
    digest, and a document against its number of ids; only CRC and length of a chunk meet the recipes."""
    checked(spark, folder)

    def sums(batches):
        for batch in batches:
            ids = [_ids(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], ["digest", "n", "crc"])

    def shifted(batches):
        for batch in batches:
            crc, tail = np.array(batch.column("crc")).astype(np.uint32), np.array(batch.column("tail"))
            yield batch.set_column(batch.schema.get_field_index("crc"), "crc", pa.array(shift_crc(crc, tail).astype(np.int64)))

    recipes = read_recipes(spark, folder).select("doc_id", "start", "n_tokens", "digests", "lengths")
    pieces = recipes.mapInArrow(_pieces, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, digest binary, tail bigint")
    joined = pieces.join(read_chunks(spark, folder).mapInArrow(sums, "digest binary, n bigint, crc bigint"), "digest", "left").select("doc_id", "start", "n_tokens", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), "tail")
    whole = joined.mapInArrow(shifted, joined.schema).groupBy("doc_id", "start", "n_tokens").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"))
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a document lacks chunks")).cast("bigint"))
    return whole.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark)
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return document_digests(spark, folder)
