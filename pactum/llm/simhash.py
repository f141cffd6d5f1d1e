"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within r / 2 bits of each. Every fingerprint emits
all its variants within that half radius, the variants are shuffled, and fingerprints that meet on one variant are within
r bits of each other: a group is a clique, so a link from each member to the least one loses no connection and no pair
need be listed. A group holds distinct fingerprints within two bits of its variant, so at most 2,081 whatever the data.

Before the balls, the same idea on part of the bits leaves out fingerprints that have no partner at all: of three thirds
of the bits, one holds at least two of any four differing bits, so the other two thirds differ in two at most and share a
variant within one bit. 132 short rows stand against 2,081 then, and only fingerprints that met one within four bits go on:
at billions of fingerprints most keys have chance company. Neighbours in a key's order are compared, as many as NEAR on
either side; in a longer group all go on, so that no group is held or paired in a task and none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.components import connected_components
from pactum.llm.shared import discard, materialize, slices

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
THIRDS = ((0, 21), (21, 42), (42, 64))
#: Fingerprints before and after one in a key's order that it is compared with; one that has more goes on unseen.
NEAR = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks that flip 0 to most (1 or 2) of the given bits, as signed longs."""
    masks = [0] + [1 << i for i in bits]
    if most > 1:
        masks += [1 << i | 1 << j for k, i in enumerate(bits) for j in bits[k + 1 :]]
    return [_signed(m) for m in masks]


def text_fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The fingerprint of lower-cased words: bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(text, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    found, votes = np.array(hashes, np.uint64), np.zeros(BITS, np.int64)
    for at in range(0, len(found), 1 << 16):
        votes += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, carried columns as _name) of every row. A-Z become lower case, words are [^\\x20\\x09-\\x0D]+; a null or wordless text has
    fingerprint 0, one with fewer words than a shingle is a shingle itself. Repeated rows stay; only the named columns are read."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [text_fingerprint((x or "").encode().lower().split()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *names])

    names = [f"_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *names)]
    return rows.mapInArrow(run, ", ".join([kinds[0], "fp bigint", *kinds[1:]]))


def with_partners(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp), those that share a variant on two thirds of the bits with another one within four bits,
    or with more than can be compared. The third left out is told by its lowest bit; if keys of two thirds should meet, a
    fingerprint more goes on, none less."""
    keys = F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ ((1 << b) - (1 << a))))).bitwiseXOR(F.lit(flip ^ _signed(1 << a)))
        for a, b in THIRDS
        for flip in _flips([i for i in range(BITS) if not a <= i < b], RADIUS // 4)
    ])
    met, fp = Window.partitionBy("key").orderBy("fp"), F.col("fp")
    rows = _spread(fps).select("fp", F.explode(keys).alias("key"))
    company = rows.select("fp", "key", F.lag("fp").over(met).alias("before"), F.lead("fp").over(met).alias("after")).where("before is not null or after is not null").select("fp", "key")
    around = [f("fp", k).over(met) for f in (F.lag, F.lead) for k in range(1, NEAR + 1)]
    seen = company.select("fp", F.array(*around).alias("around"), (F.lag("fp", NEAR + 1).over(met).isNotNull() | F.lead("fp", NEAR + 1).over(met).isNotNull()).alias("many"))
    close = F.coalesce(F.exists("around", lambda x: F.bit_count(x.bitwiseXOR(fp)) <= RADIUS), F.lit(False))
    return seen.where(F.col("many") | close).select("fp").distinct()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within four bits of each other, directly or in steps."""
    ball = F.array(*[F.lit(m) for m in _flips(list(range(BITS)), RADIUS // 2)])
    met = _spread(fps).select("fp", F.explode(ball).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    links = met.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("variant")).alias("b")).where("a <> b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _spread(fps: DataFrame) -> DataFrame:
    """fps in as many partitions as a shuffle has: each row is about to become hundreds."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: documents whose fingerprints differ in four bits or fewer are
    linked, component_id is the smallest doc_id reachable.

    Equal fingerprints are one node, so a group of copies costs one row however large it is. Null and empty texts have
    fingerprint zero and link like others; repeated rows get equal results; an empty table gives an empty result.
    """
    found = materialize(fingerprints(docs, id_col, text_col))
    joined = _with_roots(materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_roots(distinct: DataFrame) -> DataFrame:
    """distinct(fp, least) -> (fp, least, root): the fingerprint that stands for its component."""
    partners = materialize(with_partners(distinct.select("fp")))
    roots = connected_components(fingerprint_links(partners))
    discard(partners)
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of docs for each component: that with the smallest id (null last), of equal ids that with the least
    hash of its text, then the least in its other columns. Ids need be neither present nor unique, for no join reads
    them; a large component comes down by partial minima."""
    rest = tuple(c for c in docs.columns if c != id_col)
    found = fingerprints(docs, id_col, text_col, rest)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(f"_{text_col}").alias("hash"), *[f"_{c}" for c in rest])
    kept = _with_roots(materialize(found.groupBy("fp").agg(F.min(order).alias("least")))).groupBy("root").agg(F.min("least").alias("least"))
    return kept.select(*[F.col("least")["doc_id" if c == id_col else f"_{c}"].alias(c) for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
