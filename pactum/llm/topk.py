"""Exact top-k by inner product with a bit-sliced index.

Rows are dealt into blocks; for each attribute (component of the quantised vector) a block keeps one bitmap for each
binary digit, over all its rows. A query's scores are sums of those slices, shifted by the digits of the query's own
components and added with bitmap arithmetic (three bitmaps of one weight become one, and a carry of the next). The top
rows are then read off from the most significant slice of the sums downward; rows that tie at the boundary are taken in
order of vec_id. The queries are sent to the blocks, up to QUERY_BLOCK of them at once, so the index is shuffled once for
as many queries; k rows for each query and block go on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, SCALE = 10, 1024
#: Least and greatest number of rows of a block, between which it follows the partitions of a shuffle; queries that meet a
#: block at once.
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 18, 1 << 14


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, x array<bigint>): floor(scale * component, as double) of vectors without a null or non-finite component."""
    e = F.col("e")
    sound = e.isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).where(sound)
    return rows.select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale).cast("bigint")).alias("x"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return np.array(lists.flatten(), np.int64).reshape(len(lists), dim)


def build_slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x[row, attribute] -> the least value of each attribute, and bitmaps[attribute, digit, word] of what is above it."""
    low = x.min(0) if len(x) else np.zeros(x.shape[1], np.int64)
    above = (x - low).astype(np.uint64)
    digits = int(above.max(initial=0)).bit_length()
    bits = np.zeros((x.shape[1], digits, -(-len(x) // 64) * 64), np.uint8)
    for j in range(digits):
        bits[:, j, : len(x)] = (above >> np.uint64(j) & np.uint64(1)).T
    return low, np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def _signed_digits(q: int) -> list[tuple[int, int]]:
    """(position, +1 or -1) of the non-adjacent form of q: the fewest digits."""
    out, k = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((k, d))
            q -= d
        q >>= 1
        k += 1
    return out


def add_slices(slices: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bit-sliced sums s[weight] and a constant c: a row's score is its sum plus c. Subtrahends are added as complements."""
    piles: dict[int, list[np.ndarray]] = {}
    constant, digits = int((query.astype(object) * low.astype(object)).sum()) if len(low) else 0, slices.shape[1]
    flipped = ~slices
    for d, q in enumerate(query.tolist()):
        for k, sign in _signed_digits(q):
            for j in range(digits):
                piles.setdefault(k + j, []).append((slices if sign > 0 else flipped)[d, j])
            if sign < 0:
                constant -= ((1 << digits) - 1) << k
    sums, weight = [], 0
    while piles:
        own = np.array(piles.pop(weight, []), np.uint64).reshape(-1, slices.shape[2])
        carries = []
        while len(own) > 1:
            n = len(own) // 3
            if n:
                a, b, c = own[: 3 * n : 3], own[1 : 3 * n : 3], own[2 : 3 * n : 3]
                x = a ^ b
                carries.append((a & b) | (x & c))
                own = np.concatenate([x ^ c, own[3 * n :]])
            else:
                carries.append(own[:1] & own[1:])
                own = own[:1] ^ own[1:]
        if carries:
            piles.setdefault(weight + 1, []).extend(np.concatenate(carries))
        sums.append(own[0] if len(own) else np.zeros(slices.shape[2], np.uint64))
        weight += 1
    return sums, constant


def top_rows(sums: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """The k rows of bitmap `among` with the greatest sums, ties to lower row numbers; all of them if there are fewer."""
    sure, open_ = np.zeros_like(among), among.copy()
    for digit in reversed(sums):
        some = sure | (open_ & digit)
        n = int(np.bitwise_count(some).sum())
        if n > k:
            open_ &= digit
        else:
            sure = some
            open_ &= ~digit
            if n == k:
                open_ = np.zeros_like(open_)
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
    return np.concatenate([rows, ties[: max(0, k - len(rows))]])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", row_block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query (a condition on vec_id) holds, the k other rows with
    the greatest inner product of quantised components, ties to the smaller vec_id, all if there are fewer.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Vectors of
    different lengths have no score together. Rows with the query's id are its own; an id that occurs twice is a query
    once, with its first vector. An empty table gives an empty result. Components must be below 2**52 / 1024 in size."""
    rows = quantised(vectors, id_col, vec_col)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v")).select("vec_id", "v.dim", "v.x")
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    if row_block is None:
        row_block = min(MOST_BLOCK, max(LEAST_BLOCK, n // int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(m / query_block))
    packed = "dim int, block int, ids binary, low binary, digits int, slices binary"

    def build(table: pa.Table) -> pa.Table:
        dim, ids = table.column("dim")[0].as_py(), np.array(table.column("vec_id"), np.int64)
        order = np.argsort(ids, kind="stable")
        low, slices = build_slices(_matrix(table.column("x"), dim)[order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary()), "digits": pa.array([slices.shape[1]], pa.int32()), "slices": pa.array([slices.tobytes()], pa.binary())})

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index.num_rows and queries.num_rows:
            one = index.slice(0, 1).to_pylist()[0]
            ids, low = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["low"], np.int64)
            words = -(-len(ids) // 64)
            slices = np.frombuffer(one["slices"], np.uint64).reshape(one["dim"], one["digits"], words)
            full = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
            for query_id, query in zip(queries.column("vec_id").to_pylist(), _matrix(queries.column("x"), one["dim"]), strict=True):
                sums, constant = add_slices(slices, low, query)
                among, (a, b) = full.copy(), np.searchsorted(ids, [query_id, query_id + 1])
                for row in range(a, b):
                    among[row // 64] &= ~np.uint64(1 << row % 64)
                for row in top_rows(sums, among, k).tolist():
                    score = constant + sum(int(s[row // 64]) >> row % 64 << w & 1 << w for w, s in enumerate(sums))
                    out.append((query_id, int(ids[row]), score))
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    block = lambda n, name: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name)
    index = rows.select("*", block(row_blocks, "block")).groupBy("dim", "block").applyInArrow(build, packed)
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.select("*", block(query_blocks, "part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    found = left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
