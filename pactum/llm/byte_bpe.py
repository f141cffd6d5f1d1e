"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

#: Longer texts are cut at safe boundaries before the library sees them.
LONG_TEXT = 1 << 14

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}
#: The characters of Unicode's property White_Space, which the pattern's \\s stands for.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_RUN = re.compile(f"[{_WHITE}]{{4096,}}")


def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; one for each Python worker."""
    if (ranks, pattern) not in _encodings:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks, pattern]


def safe_parts(text: str, size: int = LONG_TEXT):
    """Parts of text of about size characters whose encodings, joined, are the encoding of text.

    No match of the pattern holds white space after a character that is none, so a single space between two such
    characters always begins a match. A text without such a place is one part.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(own: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text, without special tokens. Very long runs of white space, at which the library's
    regular expression gives up, are taken apart by the pattern's own rule: all but the last character of a run
    that text follows are one match, a run at the end is one match."""
    if len(text) <= LONG_TEXT:
        return own.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text):
        at = 0
        for run in _RUN.finditer(part):
            stop = run.end() if run.end() == len(part) else run.end() - 1
            ids += own.encode_ordinary(part[at : run.start()]) + own._encode_single_piece(part[run.start() : stop])
            at = stop
        ids += own.encode_ordinary(part[at:])
    return ids


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row. A null text is empty, and an empty text has no ids; repeated rows stay
    repeated, a null id stays null. Only the two named columns are read, so others may have any name."""

    def run(batches):
        own = encoding(ranks, pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = [encode_text(own, x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary): the raw bytes of the ids, which need not be whole characters."""

    def run(batches):
        own = encoding(ranks, pattern)
        for batch in batches:
            data = [own.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def encode_decode_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass: the digests of encode() and of decode()
    after it; with_ids adds ids array<int>."""

    def run(batches):
        own = encoding(ranks, pattern)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part, rows = batch.slice(start, 512), []
                for text in part.column(1):
                    ids = np.array(encode_text(own, text.as_py() or ""), "<u4")
                    rows.append((ids, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode_bytes(ids.tolist())).hexdigest()))
                columns = [part.column(0), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
