"""Helpers that several operators of this subpackage use: the shared folder, word spans and hashes in numpy, packed columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task turns into arrays at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20
#: Values that are hashed at once, so that the 64-bit copies of bytes stay small however long a text is.
BLOCK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_tables: dict[tuple, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see. Where that is unset, a session
    whose tasks run in this very process (tests) gets a temporary one; on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="pactum-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back: cuts lineage and survives the loss of any executor."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once nothing is going to read them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the machine, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _offsets(texts: pa.Array) -> np.ndarray:
    """Where each text begins in its buffer, whichever width of offsets the session has Arrow use."""
    wide = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    return np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * wide.itemsize)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch with about limit bytes of text each; no row is cut or left out."""
    sizes = np.diff(_offsets(batch.column(column))) if len(batch) else np.zeros(0, int)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    tidy()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and the n + 1 places where they begin (null: empty)."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data, at = texts.buffers()[2], _offsets(texts).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data; for each text, the index of its first word (n + 1 values)."""
    ink = ~_SPACE[data]
    before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink.copy()
    after = np.concatenate([ink[1:], [False]]) if len(ink) else ink.copy()
    cuts = at[:-1][at[:-1] < len(data)]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that spreads every bit of x over 64 bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(key: int, start: int, stop: int) -> np.ndarray:
    """Random-looking multipliers of the places from start to stop, which `key` chooses."""
    return mix(np.arange(start, stop, dtype=np.uint64) ^ mix(np.array([key & _MASK], np.uint64), 5), 3)


def _table(name: tuple, make) -> np.ndarray:
    if name not in _tables:
        if len(_tables) > 16:
            _tables.clear()
        _tables[name] = make()
    return _tables[name]


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], key: int = 0) -> list[np.ndarray]:
    """For each array of ends, a 64-bit hash of each data[start:end]; the last array has the whole words' ends, ascending,
    the others lie between starts and those. Multilinear hashing: each byte times a key of its place in the word, so that
    no two words, however long, agree unless the keys happen to allow it."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    table, last, at = _table(("bytes", key), lambda: _keys(key, 0, BLOCK)), ends[-1], 0
    while at < len(starts):
        a = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(last, a + BLOCK, "right")))
        b = int(last[stop - 1])
        begin = starts[at:stop] - a
        if b - a <= BLOCK:
            place = np.arange(b - a) - np.repeat(begin, np.diff(np.append(begin, b - a)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * table[place], dtype=np.uint64)])
            for k, own in enumerate(ends):
                stop_at = own[at:stop] - a
                out[k][at:stop] = mix(total[stop_at] - total[begin] + (stop_at - begin).astype(np.uint64))
        else:  # one word longer than a block
            for k, own in enumerate(ends):
                e, sum_ = int(own[at]), np.zeros(1, np.uint64)
                for p in range(a, e, BLOCK):
                    q = min(e, p + BLOCK)
                    sum_ += ((data[p:q].astype(np.uint64) + np.uint64(1)) * _keys(key, p - a, q - a)).sum(dtype=np.uint64)
                out[k][at] = mix(sum_ + np.uint64(e - a))[0]
        at = stop
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    return prefix_hashes(data, starts, [ends], key)[0]


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A rolling 64-bit hash of each run of n words, for each start at which n words follow (of whichever text): a filter,
    to be followed by strong_hashes()."""
    out = np.empty(max(0, len(words) - n + 1), np.uint64)
    power = _table(("power", n), lambda: _powers(_WORD_BASE, BLOCK + n))
    back = _table(("back", n), lambda: _powers(pow(_WORD_BASE, -1, 1 << 64), BLOCK + n))
    for a in range(0, len(out), BLOCK):
        own = words[a : min(a + BLOCK, len(out)) + n - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[: len(own)], dtype=np.uint64)])
        out[a : a + BLOCK] = mix((total[n:] - total[:-n]) * back[: len(own) - n + 1])
    return out


def strong_hashes(words: np.ndarray, starts: np.ndarray, n: int, key: int) -> np.ndarray:
    """A second hash of the runs of n words that begin at starts, multilinear in word hashes that were made with the key."""
    out, keys = np.zeros(len(starts), np.uint64), _keys(~key, 0, n)
    for a in range(0, len(starts), BLOCK):
        own = starts[a : a + BLOCK]
        for j in range(n):
            out[a : a + BLOCK] += words[own + j] * keys[j]
    return mix(out, 7)


def squeeze(data: bytes) -> bytes:
    """Compressed bytes, unless they are few; unsqueeze() gives them back."""
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(data) if len(data) >= 128 else b"\0" + data


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]) if data[:1] == b"\1" else data[1:]


def pack(values: np.ndarray) -> bytes:
    """Ascending uint64 values as squeezed planes of the differences' bytes; unpack() gives them back."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return squeeze(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
