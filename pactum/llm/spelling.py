"""Spelling variants by blocked Gram matrices of letter counts.

One edit moves the vector of a word's letter counts by a squared distance of 1 (a letter more or less) or 2 (another letter),
and |a - b|^2 = |a|^2 + |b|^2 - 2ab, so one NumPy product of two blocks of words gives all their distances. Words are blocked by
length, and within a length by their counts over CLASSES classes of letters: two words one edit apart have equal counts, or
the counts that they share are a letter short of one or of both. So a word goes to the block of its own counts and to those
a letter short, each pair of words one edit apart meets in exactly one block, and only words of adjacent lengths meet. What is left
is compared letter by letter.

A block of more than SIDE words is cut into parts, and each two parts are a task's work; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import discard, materialize, text_bytes, tidy

SHORTEST, FEWEST = 5, 3
CLASSES, SIDE, BUCKET = 6, 1 << 14, 1 << 16
#: Rows of a product at once, and cells of letters compared at once.
STRIP, CELLS = 1 << 10, 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of the letters a-z and U+00C0 to U+00FF in a vector of counts.
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123], _LETTER[192:256] = np.arange(26), np.arange(26, 90)
_LETTERS = 90


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97) -> DataFrame:
    """(word, n): maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, of SHORTEST letters and
    FEWEST occurrences at least. Where `noise` divides the CRC-32 of `<id>:<run>` the run loses the letter at that number modulo
    its length (0: no run does). A null text has no words, a null id is written as nothing."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]{5,}"), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words as bytes of Latin-1, one word after another, and the n + 1 places where words begin."""
    data, at = text_bytes(words)
    lead = data == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    return (data + np.where(data >= 0x80, 0x40, 0).astype(np.uint8))[~lead], at - before[at]


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words(word, n) -> (block, role, word, n): role 0 in the block of the word's own counts over the classes, role r in that a
    letter of class r short."""
    for batch in batches:
        words, n = batch.column("word"), batch.column("n")
        letters, at = _letters(words)
        row = np.repeat(np.arange(len(words)), np.diff(at))
        own = np.bincount(row * CLASSES + letters % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES).astype("<i4")
        for role in range(CLASSES + 1):
            some = np.flatnonzero(own[:, role - 1] > 0) if role else np.arange(len(words))
            counts = own[some].copy()
            if role:
                counts[:, role - 1] -= 1
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(np.full(len(some), role), pa.int32()), words.take(take), n.take(take)], names=["block", "role", "word", "n"])
    tidy()


def _one_edit(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows a, b of the letters m (padded with 0), of equal length or b one longer, differ by one edit."""
    out, step = np.zeros(len(a), bool), max(1, CELLS // m.shape[1])
    for k in range(0, len(a), step):
        x, y, longer = m[a[k : k + step]], m[b[k : k + step]], size[b[k : k + step]] > size[a[k : k + step]]
        differ = x != y
        # a letter more: all is equal up to some place, and all from there on once the longer one is moved back by it
        moved = np.concatenate([x[:, :-1] != y[:, 1:], np.zeros((len(x), 1), bool)], axis=1)
        first = np.where(differ.any(1), differ.argmax(1), m.shape[1])
        last = np.where(moved.any(1), m.shape[1] - moved[:, ::-1].argmax(1), 0)
        out[k : k + step] = np.where(longer, first >= last, differ.sum(1) == 1)
    return out


def _pairs(letters: np.ndarray, at: np.ndarray, role: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that are one edit apart, each two once. Rows of a part meet rows of the other part, or each other if
    there is one part only; rows meet rows of other roles, those of role 0 each other too."""
    size = np.diff(at)
    m = np.zeros((len(size), int(size.max()) + 1), np.uint8)
    m[np.arange(m.shape[1]) < size[:, None]] = letters
    row = np.repeat(np.arange(len(size)), size)
    # squares of counts add up to whole numbers that the type holds
    kind = np.float32 if m.shape[1] < 2000 else np.float64
    counts = np.bincount(row * _LETTERS + _LETTER[letters], minlength=len(size) * _LETTERS).reshape(-1, _LETTERS).astype(kind)
    square = (counts * counts).sum(1)
    split = np.flatnonzero(part != part[0])
    found = []
    for k in range(0, len(size) if not len(split) else int(split[0]), STRIP):
        stop = min(k + STRIP, len(size) if not len(split) else int(split[0]))
        low = k if not len(split) else int(split[0])
        far = counts[k:stop] @ counts[low:].T
        far *= -2
        far += square[k:stop, None]
        far += square[None, low:]
        a, b = np.nonzero((far > 0.5) & (far < 2.5))
        a, b = a + k, b + low
        meet = (role[a] != role[b]) | ((role[a] == 0) & (role[b] == 0))
        if not len(split):
            meet &= a < b
        a, b = a[meet], b[meet]
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        sure = _one_edit(m, size, a, b)
        found.append((a[sure], b[sure]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def compare(table: pa.Table) -> pa.Table:
    """(block, i, j, part, role, word, n) of many blocks -> (word, near, near_n), both ways, of words one edit apart."""
    keys = np.frombuffer(b"".join(table.column("block").to_pylist()), "<i4").reshape(-1, CLASSES)
    i, j, part, role = (np.asarray(table.column(c)) for c in ("i", "j", "part", "role"))
    order = np.lexsort((role, part, j, i, *keys.T))
    keys, i, j, part, role = keys[order], i[order], j[order], part[order], role[order]
    words = table.column("word").take(pa.array(order)).combine_chunks()
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    n = np.asarray(table.column("n"))[order]
    letters, at = _letters(words)
    new = (keys[1:] != keys[:-1]).any(1) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys)]])
    left, right = [], []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        # two parts only meet if both are there
        if b - a < 2 or (i[a] != j[a] and part[a] == part[b - 1]):
            continue
        x, y = _pairs(letters[at[a] : at[b]], at[a : b + 1] - at[a], role[a:b], part[a:b])
        left.append(x + a)
        right.append(y + a)
    x, y = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right))
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    tidy()
    return pa.table({"word": words.take(pa.array(x)).cast(pa.string()), "near": words.take(pa.array(y)).cast(pa.string()), "near_n": pa.array(n[y], pa.int64())})


def near_words(words: DataFrame, side: int = SIDE, bucket: int = BUCKET) -> DataFrame:
    """words(word, n), each once -> (word, near, near_n): each word with each that differs by one inserted, deleted or replaced
    letter. Of `bucket` rows or so a task makes one batch of blocks."""
    rows = words.select("word", "n").mapInArrow(blocked, "block binary, role int, word string, n bigint")
    wide = rows.groupBy("block").agg(F.count("*").alias("rows")).where(F.col("rows") > side).select(F.col("block").alias("_block"), F.ceil(F.col("rows") / side).cast("int").alias("parts"))
    cut = rows.join(wide, F.col("block") == F.col("_block"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = cut.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "role", "word", "n")
    buckets = max(1, -(-words.count() * (CLASSES + 1) // bucket))
    return sides.withColumn("bucket", F.pmod(F.xxhash64("block", "i", "j"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: compare(t.drop_columns("bucket")), "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), each word once, without cycles -> (word, root): the last of the forms that follow each other. The
    distance that a row has followed doubles in each round, so a chain of 2**k forms takes k + 1 rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        new = materialize(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of counted_words(): the form is the near word with the largest n, of
    equals the smallest in code-point order, if that is `ratio` times the word's n or more, else null; the root is the word
    itself where there is no form. An empty table, or one without words, gives an empty result."""
    words = materialize(counted_words(docs, id_col, text_col, noise))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    judged = materialize(known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.n")).alias("form_n")))
    discard(words)
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
