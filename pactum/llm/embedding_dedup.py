"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors of a label become one. The others of a label are dealt into overlapping shards: a vector is a member of the
cells of its two nearest pivots, and a cell that is too large is dealt again by pivots of its own, however dense it is.
Besides, a vector visits the cells of all pivots within twice the range of it, where members no farther from their pivot
than the range may be linked with it, and those nearly as near as its second. Each shard builds a graph of pruned nearest
neighbours, the adjacency lists of a vector are united over its shards, and members and visitors are sought in each shard:
a greedy search from the medoid (and a member's own place), then on through all neighbours of what lies within the range.
So a group of near copies is cut like anything else, and its links between shards are found by visits. Pairs found are
verified by their cosine in double precision and counted in the first shard that has both; none is written out.
A sample compared with all rows audits the recall of each run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.components import connected_components
from pactum.llm.shared import discard, materialize, tidy

COSINE = 0.98
#: Mean size of a cell and greatest number of a shard's members; pivots of a cell; times that cells are dealt by pivots,
#: after which members are dealt by a hash and all rows of the cell visit each part.
CELL, SHARD, PIVOTS, LEVELS = 250, 600, 256, 8
#: Neighbours kept by pruning, its slack, vectors held during a search.
DEGREE, SLACK, BEAM = 16, 1.2, 24
#: Rows of a cell that are dealt at once, each perhaps to all pivots; visitors that search a shard at once; queries of a
#: search that share arrays; components of vectors that are gathered at once.
SALT_ROWS, VISITORS, BLOCK, GATHER = 1024, 1024, 256, 1 << 20
#: Radians by which a pivot may be farther than the second nearest and is visited still.
NEARLY = 0.015
#: Vectors that the audit compares with all rows of their label, and the least recall that passes.
AUDITED, LEAST_RECALL = 100, 0.9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)])
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def prune(x: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """For each row of unit rows x, its out-neighbours: the nearest, leaving out those that a kept one is nearer to by the slack."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    wide = min(3 * degree, len(x) - 1)
    near = np.argsort(-sims, axis=1, kind="stable")[:, :wide] if wide > 0 else np.zeros((len(x), 0), int)
    gaps, out = 1 - sims, []
    for row in range(len(x)):
        left, kept = near[row], []
        while len(left) and len(kept) < degree:
            kept.append(left[0])
            rest = left[1:]
            left = rest[slack * gaps[left[0], rest] > gaps[row, rest]]
        out.append(np.array(kept, int))
    return out


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes is connected with by links a, b."""
    part = np.arange(n)
    while len(a):
        low = part.copy()
        np.minimum.at(low, a, part[b])
        np.minimum.at(low, b, part[a])
        low = low[low]
        if (low == part).all():
            break
        part = low
    return part


def graph(x: np.ndarray, neighbours: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """(n x n table of links, medoid): every link in both directions, and links between the medoid and the middle of each
    part that none reaches, since a dense group's nearest neighbours are all of its own."""
    n = len(x)
    a = np.repeat(np.arange(n), [len(own) for own in neighbours])
    b = np.concatenate([*neighbours, np.zeros(0, int)]).astype(int)
    part, start = _parts(n, a, b), int(np.argmax(x @ x.mean(0)))
    middles = np.array([rows[np.argmax(x[rows] @ x[rows].mean(0))] for p in np.unique(part) if p != part[start] for rows in [np.flatnonzero(part == p)]], int)
    out = np.zeros((n, n), bool)
    out[a, b] = out[b, a] = True
    out[middles, start] = out[start, middles] = True
    return out, start


def _dots(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The inner product of row at[k] of a and row to[k] of b for each k, GATHER components at once."""
    step = max(1, GATHER // max(1, a.shape[1]))
    return np.concatenate([np.zeros(0, a.dtype), *(np.einsum("ij,ij->i", a[at[k : k + step]], b[to[k : k + step]]) for k in range(0, len(at), step))])


def range_search(x: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, own: np.ndarray, cosine: float = COSINE, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row of x) within the range that a search of each query reaches from the medoid and from its own row
    (own: its number, -1 if it has none), a block of queries at once. It moves in single precision and verifies in double.
    Its arrays hold a value for each query of the block and row of x, however many links the rows have."""
    n, fine = len(x), (x, queries)
    x, queries, steps = x.astype(np.float32), queries.astype(np.float32), links.astype(np.float32)
    found: list[np.ndarray] = []
    for first in range(0, len(queries), BLOCK):
        asked, at = queries[first : first + BLOCK], own[first : first + BLOCK]
        every = np.arange(len(asked))
        seen, done, sims = np.zeros((len(asked), n), bool), np.zeros((len(asked), n), bool), np.full((len(asked), n), -2.0, np.float32)

        def see(q: np.ndarray, v: np.ndarray, asked=asked, seen=seen, sims=sims) -> None:
            seen[q, v] = True
            sims[q, v] = _dots(asked, x, q, v)

        def visit(query: np.ndarray, node: np.ndarray, done=done, seen=seen, see=see) -> None:
            done[query, node] = True
            at, v = np.nonzero(links[node] & ~seen[query])
            see(query[at], v)

        see(every, np.full(len(asked), start))
        at_home = np.flatnonzero(at >= 0)
        see(at_home, at[at_home])
        visit(at_home, at[at_home])
        while True:  # greedy: the nearest of the beam that has not been expanded
            held = np.argpartition(-sims, min(beam, n) - 1, axis=1)[:, : min(beam, n)]
            value = np.where(done[every[:, None], held], -3.0, sims[every[:, None], held])
            best = value.argmax(1)
            live = value[every, best] > -2.0
            if not live.any():
                break
            visit(every[live], held[every, best][live])
        while True:  # the range: every vector within it is expanded, all of a round by one product with the links
            front = (sims >= cosine - 1e-5) & ~done
            if not front.any():
                break
            done |= front
            see(*np.nonzero((front.astype(np.float32) @ steps > 0) & ~seen))
        query, node = np.nonzero(sims >= cosine - 1e-5)
        true = _dots(fine[1][first : first + BLOCK], fine[0], query, node) >= cosine
        found.append(np.stack([first + query[true], node[true]]))
    return tuple(np.concatenate([*found, np.zeros((2, 0), int)], axis=1))


def _sound(e: Column) -> Column:
    """Whether an array<double> is a vector that has a direction."""
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


_ROWS = "rep bigint, n bigint, e array<double>, cell string, member boolean"
_RESULT = "rep bigint, links bigint, other bigint"


def _deal(rows: DataFrame, sizes: DataFrame, level: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """rows(rep, n, e, cell, member) of cells that are too large -> (the same, each row in the cells of its pivots; the table
    of pivots that they are read from)."""
    own = rows.join(sizes, "cell")
    ranked = own.where("member").withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("rep", F.lit(level)), "rep"))).where(F.col("k") <= PIVOTS)
    pivots = materialize(ranked.where(F.col("k") <= F.greatest(F.lit(3), F.ceil(F.col("size") / CELL))).groupBy("cell", "size").agg(F.collect_list(F.struct("k", "e")).alias("pivots")))
    salts = F.ceil(F.col("size") / SALT_ROWS)
    left = own.withColumn("salt", F.pmod(F.xxhash64("rep"), salts)).drop("size")
    right = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("size")
    reach = math.cos(min(math.pi, 2 * math.acos(cosine)))

    def nearest(rows: pa.Table, around: pa.Table) -> pa.Table:
        kept = rows.drop_columns(["cell", "salt", "member"])
        if not rows.num_rows:
            return kept.append_column("cell", pa.array([], pa.string())).append_column("member", pa.array([], pa.bool_()))
        cell, found = rows.column("cell")[0].as_py(), sorted(around.column("pivots")[0].as_py(), key=lambda p: p["k"])
        centres, member = _matrix(pa.chunked_array([_lists([p["e"] for p in found], pa.float64())])), np.array(rows.column("member"))
        sims = _matrix(rows.column("e")) @ centres.T
        two = np.argsort(-sims, axis=1, kind="stable")[:, :2]
        second = np.arccos(np.clip(np.take_along_axis(sims, two[:, -1:], 1), -1, 1))
        visits = (sims >= reach) | (sims >= np.cos(np.minimum(second + NEARLY, np.pi)))
        home = np.zeros(sims.shape, bool)
        np.put_along_axis(home, two, True, 1)
        at, pivot = np.nonzero(visits | home)
        out = kept.take(pa.array(at)).append_column("cell", pa.array([f"{cell}/{p}" for p in pivot.tolist()]))
        tidy()
        return out.append_column("member", pa.array(home[at, pivot] & member[at]))

    return left.select("rep", "n", "e", "cell", "member", "salt").groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(nearest, _ROWS), pivots


def shards(distinct: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, list[DataFrame]]:
    """distinct(rep, n, e, cell) -> (rep, n, e, cell, member): the leaf cells that each vector is a member of or visits. No
    cell has more than SHARD members, or about CELL where hashing had to part them. Beside it the tables it is read from."""
    tables: list[DataFrame] = []
    leaves, rows = None, distinct.withColumn("member", F.lit(True))
    for level in range(LEVELS + 1):
        rows = materialize(rows)
        tables.append(rows)
        sizes = rows.groupBy("cell").agg(F.count_if("member").alias("size")).where(F.col("size") > SHARD)
        if sizes.isEmpty():
            break
        small = rows.join(sizes, "cell", "left_anti").select(*rows.columns)
        leaves = small if leaves is None else leaves.union(small)
        large = rows.join(sizes, "cell", "left_semi").select(*rows.columns)
        if level < LEVELS:
            rows, pivots = _deal(large, sizes, level, cosine)
            tables.append(pivots)
        else:
            parts = F.ceil(F.col("size") / CELL)
            rows = large.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).select("rep", "n", "e", F.concat_ws("/", "cell", F.concat(F.lit("h"), "part")).alias("cell"), (F.col("member") & (F.pmod(F.xxhash64("rep", F.lit("part")), parts) == F.col("part"))).alias("member"))
    return rows if leaves is None else leaves.union(rows.select(*leaves.columns)), tables


def _holds(column: pa.ChunkedArray, values: np.ndarray) -> np.ndarray:
    """(rows x values) 1 where the row's list has the value, else 0; values ascend."""
    lists = column.combine_chunks()
    flat, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    out, at = np.zeros((len(lists), len(values)), np.float32), np.searchsorted(values, flat)
    known = at < len(values)
    known[known] = values[at[known]] == flat[known]
    out[row[known], at[known]] = 1
    return out


def _counted(query: np.ndarray, node: np.ndarray, here: int, homes: pa.ChunkedArray, places: pa.ChunkedArray) -> np.ndarray:
    """Which pairs (query, node) this shard counts: those of which no shard with a lesser number has the query, and the node
    as a member."""
    others = np.unique(homes.combine_chunks().flatten().to_numpy(zero_copy_only=False))
    others = others[others < here]
    return ~((_holds(places, others) @ _holds(homes, others).T > 0)[query, node])


def _search(table: pa.Table, cosine: float) -> pa.Table:
    """(rep, links, other) of one shard and some of its visitors: for each query its counted links, and for each vector of a
    connected group the group's least."""
    order = np.argsort(~np.array(table.column("member")), kind="stable")  # members first
    table = table.take(pa.array(order))
    ids, n = np.array(table.column("rep")), int(np.array(table.column("member")).sum())
    x = _matrix(table.column("e"))
    at = {v: k for k, v in enumerate(ids[:n].tolist())}
    near = [np.array([at[v] for v in own or () if v in at], int) for own in table.column("near").to_pylist()[:n]]
    if not n:
        return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "links", "other")})
    links, start = graph(x[:n], near)
    asks = np.array(table.column("asks"))
    asked = np.flatnonzero(asks)
    query, node = range_search(x[:n], links, start, x[asked], np.where(asked < n, asked, -1), cosine)
    query = asked[query]
    both = (query < n) & asks[node]  # a link found from one end holds for both
    pairs = np.unique(np.concatenate([query * len(ids) + node, node[both] * len(ids) + query[both]]))
    query, node = pairs // len(ids), pairs % len(ids)
    query, node = query[query != node], node[query != node]
    counted = _counted(query, node, table.column("number")[0].as_py(), table.column("homes")[:n], table.column("places"))
    totals = np.bincount(query[counted], np.array(table.column("n"))[node[counted]], len(ids)).astype(np.int64)
    rank = np.argsort(np.argsort(ids))
    by = np.argsort(ids)
    least = ids[by[_parts(len(ids), rank[query], rank[node])]][rank]
    some = (totals > 0) | (least != ids)
    tidy()
    return pa.table({"rep": pa.array(ids[some]), "links": pa.array(totals[some]), "other": pa.array(least[some])})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. Rows are compared if labels are equal and not null and vectors
    have one length; pairs found with a cosine of at least `cosine` are links. n_links counts other ids.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing
    and are their own component. Equal vectors are one vector with a count, so copies link with each other and share
    all else without being paired. Repeated rows count once and each get the result. An empty table gives an empty one.
    A group of g different near copies costs g * g / CELL searches, since each link counts; groups of equal vectors cost one."""
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _sound(F.col("e"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"), F.col(label_col).cast("string").alias("label"))
    good = rows.where(sound)
    # a vector is known by a number of its own, as an id may stand on several
    distinct = materialize(good.groupBy("label", "e").agg(F.min("vec_id").alias("low"), F.countDistinct("vec_id").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    spread, tables = shards(distinct.select("rep", "n", "e", F.concat_ws("|", F.size("e"), "label").alias("cell")), cosine)
    spread = materialize(spread.withColumn("number", F.xxhash64("cell")).drop("cell"))
    discard(*tables)

    def build(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("rep"))
        near = [ids[a] for a in prune(_matrix(table.column("e")))]
        tidy()
        return pa.table({"rep": table.column("rep"), "near": _lists(near, pa.int64())})

    united = spread.where("member").select("number", "rep", "e").groupBy("number").applyInArrow(build, "rep bigint, near array<bigint>").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    places = spread.groupBy("rep").agg(F.sort_array(F.collect_list("number")).alias("places"), F.sort_array(F.collect_list(F.when(F.col("member"), F.col("number")))).alias("homes"))
    crowds = spread.groupBy("number").agg(F.ceil(F.count_if(~F.col("member")) / VISITORS).alias("crowds"))
    known = spread.join(united.join(places, "rep"), "rep").join(crowds, "number")
    # the members of a shard stand in every crowd of its visitors, and search in the first
    salt = F.when(F.col("member"), F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("crowds") - 1, F.lit(0)))).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.greatest(F.col("crowds"), F.lit(1)))))
    dealt = known.withColumn("salt", F.explode(salt)).withColumn("asks", ~F.col("member") | (F.col("salt") == 0))
    found = materialize(dealt.select("number", "salt", "rep", "n", "e", "member", "asks", F.when(F.col("member"), F.col("near")).alias("near"), "homes", "places").groupBy("number", "salt").applyInArrow(lambda t: _search(t, cosine), _RESULT))

    roots = connected_components(found.where("other <> rep").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    discard(spread)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = distinct.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    by_rep = linked.join(lows, "root").select("label", "e", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = good.join(by_rep, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("bigint"), "vec_id")
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, found: DataFrame, sample: int = AUDITED, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, true_links) for at most `sample` vectors spread by a hash of their id, each compared with every row
    of its label: recall is sum(n_links) / sum(true_links). The sample is the only part sent to all executors."""
    vectors = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("label").isNotNull() & _sound(F.col("embedding")))
    own = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    pairs = vectors.join(F.broadcast(own.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"), "label")), "label").where((F.col("vec_id") != F.col("q")) & (F.size("embedding") == F.size("x")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    near = dot(F.col("embedding"), F.col("x")) >= cosine * F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("x"), F.col("x")))
    true = pairs.groupBy("q").agg(F.count(F.when(near, 1)).alias("true_links"))
    by_id = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    return by_id.join(F.broadcast(true), F.col("vec_id") == F.col("q")).select("vec_id", "n_links", "true_links")


def audited(vectors: DataFrame, cosine: float = COSINE, least: float = LEAST_RECALL) -> DataFrame:
    """near_duplicates() of vectors(vec_id, embedding, label), written to the shared folder and audited there: an error if a
    sample of vectors has fewer than `least` of its links."""
    found = materialize(near_duplicates(vectors, cosine=cosine))
    got, true = audit_recall(vectors, found, cosine=cosine).agg(F.coalesce(F.sum("n_links"), F.lit(0)), F.coalesce(F.sum("true_links"), F.lit(0))).first()
    if got < least * true:
        discard(found)
        raise RuntimeError(f"recall {got / true:.3f} of the audited vectors is below {least}")
    return found


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
