"""Substring dedup by fixed-block anchors.

Words repeat if a window of 35 covers them whose sequence also starts elsewhere. Every such window holds a whole block of
18 words at a multiple of 18 in its text, so those blocks are the index, and every rolling run of 18 words probes it. A
run that meets an indexed block in another place is an anchor; the windows around anchors are compared in turn, which
extends each anchor to the maximal exact repeats through it, and no pair of places is ever listed.

Texts are dealt into batches of some megabytes by a hash of their id. A batch sends each hash once to the bucket of the
hash, however often it holds it, as one packed row a bucket; a passage that a third of all texts share costs a bucket one
entry a batch. Buckets answer with the hashes found. The batches' texts are shuffled once: the three passes over them
read the same exchange.
"""

from __future__ import annotations

import math
import secrets
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import pack, squeeze, strong_hashes, text_bytes, tidy, unpack, unsqueeze, window_hashes, word_hashes, word_spans

WINDOW = 35
#: Bits by which rolling hashes are shortened to 48.
_LOST = np.uint64(16)
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 48 << 20


class _Batch:
    """Words of a batch of texts; texts without a whole window have no starts."""

    def __init__(self, table: pa.Table, window: int):
        texts = table.column("text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        data, at = text_bytes(texts)
        self.data = data
        self.begin, self.end, self.first = word_spans(data, at)
        self.words = word_hashes(data, self.begin, self.end)
        n = np.diff(self.first)
        self.place = np.arange(len(self.words)) - np.repeat(self.first[:-1], n)
        self.left = np.repeat(n, n) - self.place
        self.long = np.repeat(n >= window, n)

    def starts(self, n: int) -> np.ndarray:
        """Indexes of words that begin a run of n words in a text with a whole window."""
        return np.flatnonzero(self.long & (self.left >= n))

    def second(self, starts: np.ndarray, window: int, key: int) -> np.ndarray:
        """A hash of the windows at starts that shares nothing with their first one: other keys from the bytes on."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        return strong_hashes(word_hashes(self.data, self.begin, self.end, key), starts, window, key)


def _rows(batch: int, hashes: np.ndarray, flags: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket, a range of the 48-bit hashes, with its hashes (ascending, each once), flags for each, and
    extra bits."""
    bucket = (hashes >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(24)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    out: list[tuple] = []
    for b in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[b], cuts[b + 1])
        out.append((int(b), batch, pack(hashes[own]), squeeze(flags[own].tobytes()), b"" if extra is None else extra[own].tobytes()))
    return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate(_PACKED)})


_PACKED = [("bucket", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary()), ("flags", pa.binary()), ("extra", pa.binary())]
_PACKED_DDL, _FOUND_DDL = "bucket bigint, batch bigint, hashes binary, flags binary, extra binary", "batch bigint, hashes binary, extra binary"


def _once(hashes: np.ndarray, marks: np.ndarray, extra: np.ndarray | None = None):
    """Each hash (with its extra) once, ascending; flag 1: it occurs again, flag 2: one of its marks is set."""
    order = np.argsort(hashes, kind="stable") if extra is None else np.lexsort((extra, hashes))
    sorted_ = hashes[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, bool)
    if extra is not None and len(sorted_):
        new[1:] |= extra[order][1:] != extra[order][:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(sorted_)))
    marked = np.add.reduceat(marks[order].astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
    return sorted_[at], ((counts > 1) | marked << 1).astype(np.uint8), None if extra is None else extra[order][at]


def _match(table: pa.Table, need_mark: bool) -> pa.Table:
    """For each batch of a bucket, those of its hashes that occur in two places, of which one is marked if need_mark."""
    batches, found = table.column("batch").to_pylist(), []
    hashes = [unpack(x) for x in table.column("hashes").to_pylist()]
    flags = np.frombuffer(b"".join(map(unsqueeze, table.column("flags").to_pylist())), np.uint8)
    extra = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.uint64)
    every = np.concatenate(hashes)
    order = np.lexsort((extra, every)) if len(extra) else np.argsort(every, kind="stable")
    sorted_ = every[order]
    same = sorted_[1:] == sorted_[:-1]
    if len(extra):
        same &= extra[order][1:] == extra[order][:-1]
    at = np.flatnonzero(np.concatenate([[True], ~same]))
    many = (np.diff(np.append(at, len(sorted_))) > 1) | (np.add.reduceat((flags[order] & 1).astype(np.int64), at) > 0)
    if need_mark:
        many &= np.add.reduceat((flags[order] >> 1).astype(np.int64), at) > 0
    hit = np.zeros(len(every), bool)
    hit[order] = np.repeat(many, np.diff(np.append(at, len(sorted_))))
    start = 0
    for batch, own in zip(batches, hashes, strict=True):
        some, odd = hit[start : start + len(own)], np.zeros(len(own), bool)
        if some.any():
            rest = b""
            if len(extra):  # a first hash that a batch has with two second ones does not tell which of them was found
                twice = own[1:] == own[:-1]
                odd[1:] |= twice
                odd[:-1] |= twice
                rest = own[some & odd].tobytes() + extra[start : start + len(own)][some & odd].tobytes()
            found.append((batch, pack(own[some & ~odd]), rest))
        start += len(own)
    tidy()
    return pa.table({c: pa.array([x[i] for x in found], kind) for i, (c, kind) in enumerate((("batch", pa.int64()), ("hashes", pa.binary()), ("extra", pa.binary())))})


def _found(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes found for a batch, ascending; pairs of hashes, in ascending order, for those that are not enough alone."""
    parts = [unpack(x) for x in table.column("hashes").to_pylist()]
    odd = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table.column("extra").to_pylist()]
    first, second = np.concatenate([*odd, np.zeros((2, 0), np.uint64)], axis=1)
    order = np.lexsort((second, first))
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), first[order], second[order]


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _both_among(values: np.ndarray, extra: np.ndarray, found: np.ndarray, found_extra: np.ndarray) -> np.ndarray:
    """Whether each pair of values is one of the pairs found; first values are nearly always enough to tell."""
    at, stop, hit = np.searchsorted(found, values, "left"), np.searchsorted(found, values, "right"), np.zeros(len(values), bool)
    while (open_ := np.flatnonzero((at < stop) & ~hit)).size:
        hit[open_] = found_extra[at[open_]] == extra[open_]
        at[open_] += 1
    return hit


def _same_first(firsts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of the windows away from anchors share their first hash with one near an anchor: such windows differ from it, as
    equal ones would be near an anchor themselves."""
    away, known = np.flatnonzero(~near), np.unique(firsts[near])
    spread = np.zeros(1 << 22, bool)
    spread[known & np.uint64(spread.size - 1)] = True
    away = away[spread[firsts[away] & np.uint64(spread.size - 1)]]
    return away[_among(firsts[away], known)]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, first_bits: int = 48) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans, carried columns under their names after an underscore) of every row.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Each word covered by a window of `window` words whose sequence also starts
    anywhere else (same text included) is removed; windows are judged on the input. kept has the other words, joined by
    one space; spans are the removed runs as (start, end) in words, end excluded. A null or wordless text has none, kept is
    empty. Rows with equal ids are separate texts, so repeated rows repeat each other. Windows count as equal if two
    hashes are that share nothing, from the bytes on: first_bits (48 at most) of a rolling one, and 64 of a multilinear one of
    which the keys are drawn anew for each run. A window is never removed on its rolling hash alone: where a batch has windows
    of one rolling hash and several second ones, both are sent back. carry names columns to hand on as they are. An empty
    table gives an empty result."""
    half, key, lost = (window + 1) // 2, secrets.randbits(63), np.uint64(64 - first_bits)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry if c != text_col])
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    batches = max(1, math.ceil(size / batch_bytes))
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_bytes))
    dealt = own.withColumn("batch", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(batches)))

    def anchors(table: pa.Table) -> pa.Table:
        one, batch = _Batch(table, window), table.column("batch")[0].as_py()
        at = one.starts(half)
        hashes = window_hashes(one.words, half)[at] >> _LOST
        return _rows(batch, *_once(hashes, one.place[at] % half == 0)[:2], buckets)

    def around(table: pa.Table, hits: pa.Table) -> pa.Table:
        found = _found(hits)[0]
        if not table.num_rows or not len(found):
            return _rows(0, np.zeros(0, np.uint64), np.zeros(0, np.uint8), buckets, np.zeros(0, np.uint64))
        one, batch = _Batch(table, window), table.column("batch")[0].as_py()
        at = one.starts(half)
        at = at[_among(window_hashes(one.words, half)[at] >> _LOST, found)]
        near = np.zeros(len(one.words) + 1, np.int64)
        np.add.at(near, np.maximum(at - half + 1, at - one.place[at]), 1)
        np.add.at(near, at + 1, -1)
        starts = one.starts(window)
        firsts, is_near = window_hashes(one.words, window)[starts] >> lost, np.cumsum(near)[starts] > 0
        some = np.concatenate([np.flatnonzero(is_near), _same_first(firsts, is_near)])
        starts, firsts = starts[some], firsts[some]
        hashes, flags, extra = _once(firsts, np.zeros(len(starts), bool), one.second(starts, window, key))
        return _rows(batch, hashes, flags, buckets, extra)

    def remove(table: pa.Table, hits: pa.Table) -> pa.Table:
        one, (found, first, second) = _Batch(table, window), _found(hits)
        gone = np.zeros(len(one.words) + 1, np.int64)
        if len(found) or len(first):
            starts = one.starts(window)
            hashes = window_hashes(one.words, window) >> lost
            # a first hash that is found alone has one second hash among all windows of the batch
            sure, open_ = starts[_among(hashes[starts], found)], starts[_among(hashes[starts], first)]
            open_ = open_[_both_among(hashes[open_], one.second(open_, window, key), first, second)]
            starts = np.concatenate([sure, open_])
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[one.first])
        kept, spans = [], []
        for k, text in enumerate(table.column("text").to_pylist()):
            words, a, b = (text or "").encode().split(), one.first[k], one.first[k + 1]
            own_spans = []
            if n_removed[k]:
                mask = covered[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                own_spans = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
                words = compress(words, (~mask).tolist())
            kept.append(b" ".join(words).decode())
            spans.append(own_spans)
        columns = {"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(one.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return pa.table(columns | {f"_{c}": table.column("text" if c == text_col else f"_{c}") for c in carry})

    by = dealt.groupBy("batch")
    hits = by.applyInArrow(anchors, _PACKED_DDL).groupBy("bucket").applyInArrow(lambda t: _match(t, True), _FOUND_DDL)
    whole = by.cogroup(hits.groupBy("batch")).applyInArrow(around, _PACKED_DDL).groupBy("bucket").applyInArrow(lambda t: _match(t, False), _FOUND_DDL)
    kinds = [f"`_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    kinds = ", ".join([f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:int,end:int>>", *kinds])
    return by.cogroup(whole.groupBy("batch")).applyInArrow(remove, kinds)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
