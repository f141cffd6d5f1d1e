"""Merkle dataset manifest by nested-interval labels.

Leaves have ranks in the order of their trees; a node is labelled with the interval of leaf ranks that it covers, which is
nested in its parent's. A level's nodes meet their parents in the level's bucket of ranks, as wide as a parent, by
containment; what the parent's interval has beside the node's own are its siblings. So a proof is read off the labels: on
the way down every node hands its children what stands left and right of them, and no tree is walked by any one task.

Every fan-out nodes are one row, so a level has an eighth of the rows below it, and no group grows with the data. Ranks come from
ranges of the sort order: rows stay where they are dealt, and only a count for each range is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.shared import discard, materialize

FAN = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def field(column: Column) -> Column:
    """A value with its length before it, so that no two rows run into the same text; `-` for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: hexed(c["digest"])), "")


def ranked(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """df with `rank`, from 0, in the order of the columns, null first, and `part`, the range of the order that a row is dealt
    to; and the table in the shared folder that it reads. The last column tells rows apart that are equal in all others."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each range, so the running sum has no more rows than there are partitions
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(before, "part").withColumn("rank", F.col("before") + F.col("at")).drop("before", "at"), placed


def climb(leaves: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """leaves(tree, size, lo, digest, ...): lo is the leaf's rank, tree that of its tree's first leaf, size the tree's leaves.
    -> (levels, tops): levels[k] has the parents of nodes of level k as (tree, size, lo, hi, children, digest), children with
    lo, digest and what else the leaves carry; tops(tree, size, height, digest, ...) has the last node of each tree."""
    carried = [c for c in leaves.columns if c not in ("tree", "size", "lo", "digest")]
    widest = leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    levels, now, width = [], leaves, 1
    tops = leaves.where("size = 1").select("tree", "size", F.lit(0).alias("height"), "digest", *carried)
    while width < widest:
        extra = carried if width == 1 else []
        nodes = now.where(F.col("size") > width)
        # the bucket of a level is as wide as a parent; a node lies in its parent's interval if it lies in its bucket
        parent = F.col("tree") + F.floor((F.col("lo") - F.col("tree")) / (width * fan)).cast("bigint") * (width * fan)
        runs = nodes.groupBy("tree", "size", parent.alias("parent")).agg(F.sort_array(F.collect_list(F.struct("lo", "digest", *extra))).alias("children"))
        own = runs.select("tree", "size", F.col("parent").alias("lo"), F.least(F.col("parent") + width * fan, F.col("tree") + F.col("size")).alias("hi"), "children", digest(_joined(F.col("children"))).alias("digest"))
        levels.append(materialize(own))
        width *= fan
        now = levels[-1].select("tree", "size", "lo", "digest")
        done = now.where((F.col("size") <= width)).select("tree", "size", F.lit(len(levels)).alias("height"), "digest", *[F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in carried])
        tops = tops.unionByName(done)
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame, keep: tuple[str, ...], fan: int = FAN) -> DataFrame:
    """tops(tree, height, path, keep...) -> (tree, path, keep..., child) for each leaf of a tree of more than one: path has, level by
    level from the leaf up, the digests left and right of its ancestor among the siblings, joined."""
    width, above = fan ** len(levels), None
    for k in range(len(levels) - 1, -1, -1):
        here = tops.where(F.col("height") == k + 1).select("tree", F.col("tree").alias("lo"), (F.col("tree") + width).alias("hi"), "path", *keep)
        # the interval of a node whose path is known holds that of the run below it, in the bucket of its level
        known = here if above is None else here.unionByName(above)
        run = levels[k].select(F.col("tree").alias("_tree"), F.col("lo").alias("begin"), F.col("hi").alias("end"), "children")
        met = run.join(known, F.expr("_tree = tree and begin = lo and end <= hi"))
        child = met.select("tree", "path", *keep, F.explode("children").alias("child"), "children")
        beside = lambda side: F.unhex(_joined(F.filter("children", side)))
        step = F.struct(beside(lambda c: c["lo"] < F.col("child.lo")).alias("left"), beside(lambda c: c["lo"] > F.col("child.lo")).alias("right"))
        width //= fan
        rows = child.select("tree", F.concat(F.array(step), "path").alias("path"), *keep, "child")
        if k == 0:
            return rows
        above = rows.select("tree", F.col("child.lo").alias("lo"), (F.col("child.lo") + width).alias("hi"), "path", *keep)
    return tops.select("tree", "path", *keep, F.struct(F.lit(0).cast("bigint").alias("lo")).alias("child")).limit(0)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside its ancestors give."""
    return F.aggregate(path, leaf, lambda own, s: digest(F.concat(hexed(s["left"]), hexed(own), hexed(s["right"]))))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""))


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = FAN) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> (doc_id, lang, leaf, subroot, root, path, folded_root, verified): a tree for
    each lang over its leaves by doc_id, and one over the subroots by lang, null first, in the order of bytes.

    tampered is the text as it is found later (the text itself if not given): folded_root is what it gives with the
    siblings of the manifest, verified whether that is the root. Digests are 32 bytes; path is as in descend(), the leaf's level first.
    A null doc_id stands before all others; rows of one id stand by leaf, and equal rows are leaves each. Any column may be
    null; other columns are not read. An empty table has no rows and no root."""
    parts = lambda text: digest(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)))
    changed = F.when(tampered.eqNullSafe(F.col("text")), F.lit(None)).otherwise(parts(tampered)) if tampered is not None else F.lit(None).cast("binary")
    hashed = materialize(docs.select("doc_id", "lang", parts(F.col("text")).alias("digest"), changed.alias("found"), F.monotonically_increasing_id().alias("row")))
    placed, written = ranked(hashed, "lang", "doc_id", "digest", "row")
    discard(hashed)
    # a tree's first rank and size: from one row for each range and lang, of which a lang has no more than there are ranges
    ranges = placed.groupBy("part", "lang").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    trees = ranges.select(F.col("part").alias("_part"), F.col("lang").alias("_lang"), F.min("first").over(of_lang).alias("tree"), F.sum("n").over(of_lang).alias("size"))
    leaves = materialize(placed.join(trees, (F.col("part") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "size", F.col("rank").alias("lo"), "digest", "doc_id", "lang", "found"))
    discard(written)
    levels, tops = climb(leaves, fan)
    tops = materialize(tops)
    discard(leaves)

    order, _ = ranked(tops.select(F.col("tree").alias("own"), "digest"), "own")
    count = order.count()
    upper, last = climb(order.select(F.lit(0).cast("bigint").alias("tree"), F.lit(count).cast("bigint").alias("size"), F.col("rank").alias("lo"), "digest", "own"), fan)
    none = F.array().cast(_PATH)
    top = last.select("tree", "height", F.col("digest").alias("root"), none.alias("path"), "own", F.col("digest").alias("subroot"))
    down = descend(upper, top, ("root",), fan)
    paths = down.select(F.col("child.own").alias("tree"), F.col("child.digest").alias("subroot"), "root", "path") if upper else top.select(F.col("own").alias("tree"), "subroot", "root", "path")
    known = tops.join(paths, "tree")
    keep = ("subroot", "root")
    alone = known.where("height = 0").select("doc_id", "lang", "digest", "found", "path", *keep)
    rows = descend(levels, known.select("tree", "height", "path", *keep), keep, fan).select("child.doc_id", "child.lang", "child.digest", "child.found", "path", *keep).unionByName(alone) if levels else alone
    out = rows.withColumn("folded_root", fold(F.coalesce("found", "digest"), F.col("path")))
    return out.select("doc_id", "lang", F.col("digest").alias("leaf"), *keep, "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    out = manifest(docs, tampered)
    return out.select("doc_id", *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], hexed(proof(F.col("path"))).alias("proof_sha256"), hexed(F.col("folded_root")).alias("folded_root"), "verified")
