"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import html
import re
import shutil
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from pactum.llm import byte_bpe, components, embedding_dedup, html_text, licences, mixing, simhash, substrings, token_store, topk, toxicity
from pactum.llm.shared import window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside stand beside the ones they are asked to read.
DOCS = "doc_id long, text string, source string, batch string, fp string, kept string, size string, n string, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "b", "f", "k", "s", "n", "l") for i, t, s in rows], DOCS)


def sample_docs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "ß'", "日本", "1,2"]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows = []
    for k in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 120))))
        if k % 7 == 0:
            words = words[:10] + passage.split() + words[10:]
        rows.append((k, " ".join(words), f"s{k % 3}" if k % 5 else None))
    rows += [(100, rows[3][1], "s0"), (101, rows[3][1] + " extra", "s0"), (102, None, None), (103, "", "s1"), (104, " \t\n ", "s1"), (105, "one two", "s2"), (106, "a b " * 4000, "s2"), (107, "x\n" * 40, "s9"), (7, rows[7][1], rows[7][2])]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return sample_docs(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 7), (3, 10), (10, 11), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 4: 4, 5: 4, 7: 7, 8: 7}
    assert components.connected_components(edges.limit(0)).count() == 0


def brute_fingerprint(text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    votes = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), seed=42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(items, linked):
    root = dict.fromkeys(items)
    for i in sorted(items):
        if root[i] is None:
            todo, root[i] = [i], i
            while todo:
                a = todo.pop()
                for b in items:
                    if root[b] is None and linked(a, b):
                        root[b] = i
                        todo.append(b)
    return root


def test_simhash(docs, rows):
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    root = brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", root[i]) for i, p in prints.items()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_every_distance(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (0, 1, 2, 3, 4, 5, 6) for _ in range(3)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.fingerprint_links(simhash.with_partners(fps))).collect()}
    root = brute_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {p: got.get(p, p) for p in signed} == root


def brute_repeats(rows, window=35):
    texts = [WORD.findall(t or "") for _, t, _ in rows]
    seen = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _, _), w in zip(rows, texts, strict=True):
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("batch_bytes", [1 << 22, 2000])
def test_substrings(docs, rows, batch_bytes):
    got = substrings.repeats(docs, batch_bytes=batch_bytes, carry=("text", "batch"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute_repeats(rows)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and r._batch == "b"
    assert substrings.repeats(docs.limit(0)).count() == 0


def test_op6_tells_windows_of_one_rolling_hash_apart(docs, rows, monkeypatch):
    """With rolling hashes of two bits the second hash decides everything."""
    monkeypatch.setattr(substrings, "window_hashes", lambda words, n: window_hashes(words, n) & np.uint64(3 << 62))
    one = substrings._Batch(pa.table({"text": [t for _, t, _ in rows]}), 35)
    starts = one.starts(35)
    first, second = substrings.window_hashes(one.words, 35)[starts] >> np.uint64(16), one.second(starts, 35, 9)
    h, flags, extra = substrings._once(first, np.zeros(len(starts), bool), second)
    table = substrings._rows(4, h, flags, 3, extra)
    hits = [substrings._match(table.slice(k, 1), False) for k in range(table.num_rows)]
    found, a, b = substrings._found(pa.concat_tables(hits))
    got = set(starts[substrings._both_among(first, second, a, b)]) | set(starts[substrings._among(first, found)])
    counts = Counter(second.tolist())
    assert got == {s for s, x in zip(starts, second.tolist(), strict=True) if counts[x] > 1} and len(a) > 10


@pytest.mark.parametrize("bits", [12, 16, 20])
def test_op6_removes_no_window_by_its_first_hash_alone(docs, rows, bits):
    """All three passes with rolling hashes of few bits, by which windows far from any anchor meet found ones all the time."""
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.repeats(docs, first_bits=bits).collect())
    assert got == Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.repeats(docs).collect())
    assert got == Counter(brute_repeats(rows))


def test_byte_bpe(docs, rows, spark):
    import tiktoken

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.encoding(ranks, public_tokenizers.PATTERN)
    got = byte_bpe.encode_decode_digests(docs, ranks, public_tokenizers.PATTERN)
    expected = []
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, bytes(r.data).decode()) for r in byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN).collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert got.limit(0).count() == 0 and isinstance(own, tiktoken.Encoding)


def test_byte_bpe_long_texts():
    own = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    import regex

    for text in ("ab c's  d\n" * 9000, "x" + " " * 50_000 + "b c", "y\n" + " \t" * 9000, "ab" * 20_000, "a " + "　" * 9000 + " z"):
        expected = [t for m in regex.findall(public_tokenizers.PATTERN, text) for t in own._encode_single_piece(m)]
        assert byte_bpe.encode_text(own, text) == expected


def test_token_store(docs, rows, spark, tmp_path):
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/store"
    library = Tokenizer.from_file(path)
    token_store.write_store(docs, folder, path)
    expected, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, ids))
        start += len(ids)
    got = token_store.document_digests(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in expected)
    assert sorted((r.doc_id, r.start, r.ids) for r in token_store.read_documents(spark, folder).collect()) == sorted(expected)
    assert token_store.verify(spark, folder).count() == 0
    assert token_store.read_chunks(spark, folder).groupBy("digest").count().where("count > 1").count() == 0
    recipes = token_store.read_recipes(spark, folder)
    damaged = f"file://{tmp_path}/damaged"
    shutil.copytree(f"{tmp_path}/store", f"{tmp_path}/damaged")
    recipes.withColumn("start", F.col("start") + F.when(F.col("doc_id") == 12, 1).otherwise(0)).write.mode("overwrite").parquet(f"{damaged}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.document_digests(spark, damaged)
    recipes.where("doc_id <> 12").write.mode("overwrite").parquet(f"{damaged}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_documents(spark, damaged)
    recipes.write.mode("overwrite").parquet(f"{damaged}/recipes")
    parts = spark.read.parquet(f"{folder}/parts").where("kind = 'chunk'")
    parts.where(F.col("k") != parts.orderBy("k").first()["k"]).write.mode("overwrite").parquet(f"{damaged}/parts/kind=chunk")
    with pytest.raises(Exception, match="lacks chunks"):
        token_store.document_digests(spark, damaged).collect()
    empty = f"file://{tmp_path}/empty"
    token_store.write_store(docs.limit(0), empty, path)
    assert token_store.document_digests(spark, empty).count() == 0


def test_token_store_pieces_of_many_chunks():
    """What stands behind each of a document's chunks is added up in one pass."""
    rng = np.random.default_rng(2)
    lengths = [rng.integers(1, 5000, n).astype(np.int32) for n in (3, 0, 100_000, 1)]
    digests = [[str(k).encode() for k in range(len(x))] for x in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4], pa.int64()), pa.array([0] * 4, pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "digests", "lengths"])
    begun = time.time()
    [out] = token_store._pieces([batch.slice(0, 4)])
    assert time.time() - begun < 1
    [out2] = token_store._pieces([batch.slice(2, 2)])
    expected = np.concatenate([4 * (x.sum() - np.cumsum(x.astype(np.int64))) for x in lengths])
    assert (np.asarray(out.column("tail")) == expected).all() and out.column("digest").to_pylist() == sum(digests, [])
    assert out2.column("doc_id").to_pylist() == [3] * 100_000 + [4] and (np.asarray(out2.column("tail")) == expected[3:]).all()


def test_token_store_words_and_wide_ids(spark, tmp_path, monkeypatch):
    """Words of every kind against the library, while the kept ones are let go; repeated and null ids; ids of 32 bits."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "KEPT_WORDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), np.random.default_rng(6)
    pieces = ["ab", "Stra\xdfe", "\xc9t\xe9", "it's", "***", ".&", "x9", "'d", "-", ")", "\u0130", "e\u0301", "\u65e5", "\u00aa", "\u00b2", "\u00a0", "_", "#", "don", "\u01c5"]
    texts = [" ".join("".join(rng.choice(pieces, int(rng.integers(1, 5)))) for _ in range(40)) for _ in range(200)]
    for text, ids in zip(texts, token_store.encode_texts(texts, path, 1), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text
    rows = [(None if k % 3 else 7, texts[k % 30]) for k in range(90)]
    folder = f"file://{tmp_path}/wide"
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), folder, path, end_id=70_000)
    got = token_store.document_digests(spark, folder).collect()
    expected = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [[*library.encode(t, add_special_tokens=False).ids, 70_000]]]
    assert sorted(((r.doc_id is not None, r.n_tokens, r.ids_crc32) for r in got)) == sorted((i is not None, n, c) for i, n, c in expected)
    starts, at = sorted((r.start, r.n_tokens, r.doc_id is not None) for r in got), 0
    for start, n, _ in starts:
        assert start == at
        at += n
    assert [x[2] for x in starts] == sorted(x[2] for x in starts)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, source = brute_targets(sizes), {i: s for i, _, s in rows}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2)
        taken[s] += r.taken
    for s, most in ((s, max(len(WORD.findall(t or "")) for _, t, q in rows if q == s)) for s in sizes):
        assert abs(taken[s] - target[s]) <= most
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, cell string, rep string, dim string"


def vectors_of(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 8))
    rows = [(k, [float(x) for x in base[k % 40] + 0.02 * rng.normal(size=8)], k % 3) for k in range(300)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 8, 1), (1005, [float("nan")] * 8, 1), (1100, [None] + [1.0] * 7, 1), (1007, [2 * x for x in rows[3][1]], 0), (1008, [], 2), (1200, [1.0, 2.0], 1)]
    return [(i, v, label, "c", "r", "d") for i, v, label in rows]


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("limits", [(250, 600, 8), (10, 20, 8), (10, 20, 0)])
def test_embedding_dedup(spark, limits, monkeypatch):
    for name, value in zip(("CELL", "SHARD", "LEVELS"), limits, strict=True):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = vectors_of(spark)
    table = spark.createDataFrame(rows, VECTORS)
    exact = {i: np.array(np.array(v, np.float32), float) if sound(v) and label is not None else None for i, v, label, *_ in rows}
    label = {r[0]: r[2] for r in rows}

    def linked(a, b):
        x, y = exact[a], exact[b]
        return a != b and x is not None and y is not None and label[a] == label[b] and len(x) == len(y) and x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y))

    root = brute_components(list(exact), linked)
    found = embedding_dedup.near_duplicates(table)
    got = {r.vec_id: r for r in found.collect()}
    true = {i: sum(linked(i, j) for j in exact) for i in exact}
    assert set(got) == set(exact) and all(got[i].n_links <= true[i] for i in exact)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(true.values())
    assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in exact)
    audit = embedding_dedup.audit_recall(table, found, 50).agg(F.sum("n_links"), F.sum("true_links")).first()
    assert audit[0] >= 0.9 * audit[1] > 0
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embedding_rows_without_an_id_and_ids_of_several_vectors(spark):
    rows = [(None, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.01, 0.0], 1), (5, [0.0, 0.0, 1.0], 1), (7, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (3, [0.0, 0.01, 1.0], 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(0, 0, None, True)] * 2 + [(5, 2, 5, True), (5, 0, 5, True), (7, 2, 5, False), (9, 2, 5, False), (9, 2, 5, False), (3, 0, 3, True)], key=str)


def test_embedding_audit_stops_a_run_that_misses_links(spark, monkeypatch):
    table = spark.createDataFrame(vectors_of(spark), VECTORS)
    assert embedding_dedup.audited(table).count() == table.count()
    monkeypatch.setattr(embedding_dedup, "near_duplicates", lambda v, cosine: v.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.audited(table)


@pytest.mark.parametrize("kind", ["sparse", "dense", "copies"])
def test_embedding_recall_by_density(spark, kind):
    """One label with 2,500 vectors: in all directions with pairs of near copies, close together without near copies, and
    1,500 near copies of one vector, which no shard holds."""
    rng = np.random.default_rng(4)
    if kind == "sparse":
        base = rng.normal(size=(1250, 32))
        x = np.concatenate([base, base + 0.12 * rng.normal(size=base.shape)])
    elif kind == "dense":
        x = rng.normal(size=32) * 1.8 + rng.normal(size=(2500, 32)) * 0.7
    else:
        x = np.concatenate([rng.normal(size=32) + 0.085 * rng.normal(size=(1500, 32)), rng.normal(size=(1000, 32))])
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, 0)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    true = (sims >= 0.98).sum(1)
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= true).all() and links.sum() >= 0.99 * true.sum()
    if kind != "dense":
        assert true.sum() > 1000 and links.sum() >= 0.999 * true.sum()


def test_embedding_search_of_a_shard_of_near_copies_in_little_memory():
    """600 near copies in a shard, 1,000 that visit it: all links, few bytes for each pair of rows however many links there are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=64) + 0.05 * rng.normal(size=(1600, 64))
    near = [own.tolist() for own in embedding_dedup.prune(embedding_dedup._matrix(pa.chunked_array([pa.array(x[:600].tolist())])))]
    # member 0 is also one of shard 3, which counts its links with the visitors
    places = {"homes": [[3, 7]] + [[7]] * 599 + [[3]] * 1000, "places": [[3, 7]] + [[7]] * 599 + [[3, 7]] * 1000}
    table = pa.table({"number": [7] * 1600, "rep": list(range(1600)), "n": [1] * 1600, "e": x.tolist(), "member": [k < 600 for k in range(1600)], "asks": [True] * 1600, "near": near + [None] * 1000, **places})
    tracemalloc.start()
    got = embedding_dedup._search(table, 0.98)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(got["rep"].to_pylist(), got["links"].to_pylist(), strict=True)) == {k: 599 for k in range(1600)}
    assert set(got["other"].to_pylist()) == {0}
    assert peak < 128 << 20


def test_embedding_deal_in_parts(spark, monkeypatch):
    """The rows of a cell that are dealt at once change no cell of theirs."""
    monkeypatch.setattr(embedding_dedup, "SALT_ROWS", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=16) + 0.05 * rng.normal(size=(1500, 16))
    rows = spark.createDataFrame([(k, 1, v.tolist(), "c", True) for k, v in enumerate(x)], "rep long, n long, e array<double>, cell string, member boolean")
    dealt, _ = embedding_dedup._deal(rows, spark.createDataFrame([("c", 1500)], "cell string, size long"), 0, 0.98)
    got = dealt.groupBy("rep").agg(F.count("*").alias("cells"), F.count_if("member").alias("homes")).collect()
    assert len(got) == 1500 and all((r.cells, r.homes) == (6, 2) for r in got)


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_topk(spark, block):
    rows = vectors_of(spark) + [(r[0] + 5000, r[1], *r[2:]) for r in vectors_of(spark)[:40]]
    whole = {i: np.floor(1024 * np.array(np.array(v, np.float32), float)).astype(int) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in whole:
        if q % 100 == 0:
            scores = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    table = spark.createDataFrame(rows, VECTORS)
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, row_block=block, query_block=2)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_html_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header>
    <nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad --><aside>Side</aside>
    <article><h1>Title &amp; more</h1><p><b>First   line<br>goes&nbsp;on<p>Second &lt;b&gt; &eacute;.</p><form><p>Mail</p></form>
    <ul><li>one<li>two</ul><section class="comments"><p>Reader says</p></section><footer>by me</footer></article>
    <footer>&copy; x</footer>"""
    expected = "Title & more\n\nFirst line goes on\n\nSecond <b> é.\n\none\n\ntwo"
    assert html_text.page_text(page) == expected
    odd = """<HTML><BODY><DIV CLASS='siteHeader'>Brand</DIV><div id=topNav>Menu</div><div class="leftsidebar">Links</div><MAIN><div class="post-body">Lead text
    <p>One<br><br>two &mdash; three</p>tail <em>words</em></div><table><tr><td>a<td>b</table><pre>x   y</pre><blockquote>Quote</blockquote><figure><img src=a><figcaption>Caption</figcaption></figure>
    <div class="adContainer">Buy</div><div role="search">Find</div><div hidden>Secret</div><article class="comment"><p>Reader</p></article><noscript>No</noscript></MAIN><div>After</div>"""
    assert html_text.page_text(odd) == "Lead text\n\nOne two — three\n\ntail words\n\na\n\nb\n\nx y\n\nQuote\n\nCaption"
    assert html_text.page_text("<body><nav>Menu</nav><h2>Head</h2>Loose text<p>Para<ul><li>item</ul><footer>f</footer>") == "Head\n\nLoose text\n\nPara\n\nitem"
    assert html_text.page_text("<article>Only &lt; text") == "Only < text" and html_text.page_text("plain") == "plain" and html_text.page_text("<p></p><![CDATA[x]]><!doctype>") == ""
    shared = '<div class="box"><div class="x7">Same words on all pages</div></div>'
    rows = [(k, f"http://h.example/{k}", f"<body><div class=top>Shop now today</div><div id=c{k}><p>Story {k} text {k * k}</p></div>{shared}</body>") for k in range(20)]
    rows += [(100, "http://h.example/z", page), (101, None, page), (102, "http://h.example/n", None), (103, "u", ""), (104, "http://h.example/0", rows[0][2])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, low string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(table).collect()}
    assert len(got) == len(rows)
    assert got[3] == ("Story 3 text 9", 14) and got[104] == got[0]
    assert got[100] == got[101] == (expected, len(expected)) and got[102] == got[103] == ("", 0)
    assert html_text.extract(table.limit(0)).count() == 0
    assert html.unescape("&am") == "&am"


@pytest.mark.parametrize(("page", "expected"), [
    ("<body class='has-sidebar'><article><p>Text here</p></article></body>", "Text here"),
    ("<body class='menu-open'><article><p>Text here</p></article></body>", "Text here"),
    ("<body class='single right-sidebar'><div class='content with-sidebar'><p>Hello</p><div class='sidebar'>Links</div></div>", "Hello"),
    ("<article class='post comments-open'><p>A</p></article>", "A"),
    ("<article><p>Text</p><section class='related-work'><p>Work</p></section><div class='banner-history'><p>History</p></div></article>", "Text\n\nWork\n\nHistory"),
    ("<div id='comments-policy'><article><p>Policy</p></article></div>", "Policy"),
    ("<article><p>Let <math><mi>x</mi></math> be one</p></article>", "Let x be one"),
    ("<article><p>Read <a class='share-button'>Share this</a> on</p></article>", "Read on"),
    ("<article><p>The article</p></article><article class='teaser'><p>Tease</p></article>", "The article"),
    ("<main><p>Long text of main stands here.</p><article><p>card</p></article></main>", "Long text of main stands here."),
    ("<div class='sidebar'><p>only text</p></div>", "only text"),
    ("<article><p>Text</p></article><section class='comments'><article><p>" + "Reader " * 50 + "</p></article></section>", "Text"),
    ("<div class='siteMenu'>Menu</div><div class='ad-box'>Buy</div><p>Text</p><div class='cookie-notice'>Cookies</div><div class='related-posts'><article><p>Other</p></article></div>", "Text"),
    ("<div>" * 2000 + "<p>Deep</p>", "Deep"),
])
def test_html_names(page, expected):
    assert html_text.page_text(page) == expected


def test_html_style_tree(spark):
    """Importance recomputed from the pages' parse, branch by branch; pages with equal blocks count once."""
    shared = '<div class="box"><div class="x7">Same words on all pages</div></div>'
    rows = [(k, f"http://h.example/{k}", f"<body><div class=top>Shop {k % 3}</div><div id=c{k}><p>Story {k}</p><p>{k % 4}</p></div>{shared if k % 2 else '<ul><li>a<li>b</ul>'}</body>") for k in range(20)]
    rows += [(30, "http://h.example/copy", rows[0][2]), (31, "http://other.example/", rows[1][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.node): (r.pages, r.importance) for r in html_text.style_tree(html_text.parse(table)).collect()}
    expected = {}
    for host in ("h.example", "other.example"):
        pages = [html_text._Page(x) for x in dict.fromkeys(h for _, u, h in rows if host in u)]
        for node in {n for p in pages for b in p.blocks for n in b[1]}:
            own = [p for p in pages if node in p.styles]
            styles, texts = Counter(tuple(p.styles[node]) for p in own), Counter((b[1], b[0]) for p in own for b in {(x[0], x[1]): x for x in p.blocks}.values() if node in b[1])
            if len(own) < 2:
                expected[host, node] = (len(own), 1.0)
                continue
            m = np.log(len(own))
            style = sum(-c / len(own) * np.log(c / len(own)) for c in styles.values()) / m
            content = 1 - sum(c * np.log(c) for c in texts.values()) / sum(texts.values()) / m
            left = html_text.GAMMA ** len(styles)
            expected[host, node] = (len(own), (1 - left) * style + left * content)
    assert got.keys() == expected.keys()
    for k, (pages, importance) in expected.items():
        assert got[k][0] == pages and abs(got[k][1] - importance) < 1e-9
    out = {r.page_id: r for r in html_text.extract(table).collect()}
    assert out[1].text == "Shop 1\n\nStory 1\n\n1" and out[1].n_low == 1 and out[31].n_low == 0


def test_html_low_branches_by_join_or_broadcast(spark, monkeypatch):
    shared = "<div class=box>Same words on all pages</div>"
    rows = [(k, f"http://h{k % 2}.example/{k}", f"<body><div id=c><p>Story {k}</p></div>{shared}</body>") for k in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(tuple, html_text.extract(table).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_text.extract(table).collect())) == first and first[0][2] == "Story 0"


def test_licences(spark, rows):
    known = {f"{f} {k}": (f, t) for f, k, t in licences.templates()}
    prose = "It was late and the two of them had been walking along the river for hours without a word. "
    extra = [(200 + k, f"some words here\n{t}\nmore words", "s") for k, (_, t) in enumerate(known.values())] + [(600 + k, f"{prose}{t} {prose}", "s") for k, (_, t) in enumerate(known.values())]
    strange = ["Licensed under the Frobnicator Vendor License, which has terms of its own you must read.", "Licensed under the Nokia Open Source License.", "This work is licensed under the Hippocratic License 3.0.", "Released under the Elastic License 2.0."]
    extra += [(1000 + k, t, "s") for k, t in enumerate(strange)] + [(1100 + k, t, "s") for k, t in enumerate(licences.PLAIN)] + [(None, "Released under the MIT License.", "s"), (None, "nothing", "s"), (3000, "x " * 200_000 + "\nReleased under the MIT License.", "s")]
    got = [r for r in licences.document_licences(docs_of(spark, rows + extra)).collect()]
    assert sorted(r.licences for r in got if r.doc_id is None) == ["", "mit"]
    by = {r.doc_id: r for r in got}
    for k, (family, text) in enumerate(known.values()):
        for start in (200, 600) if text.endswith(".") else (200,):
            assert by[start + k].licences == family, (family, text, by[start + k])
    assert all(by[i].licences == "" and by[i].n_unknown == 0 for i, _, _ in rows)
    assert all(by[1000 + k].licences == "" for k in range(len(strange))) and by[1000].n_unknown == 1
    assert all(by[1100 + k].licences == "" for k in range(len(licences.PLAIN))) and by[3000].licences == "mit"
    assert licences.document_licences(docs_of(spark, rows).limit(0)).count() == 0


HELD_OUT = [
    ("mit", "This code is distributed under the MIT license, copyright the authors."), ("mit", "Foo is MIT licensed, as found in the LICENSE file."), ("apache", "Distributed under the terms of the Apache License, Version 2.0."), ("apache", "The sources are available under the Apache 2.0 license."),
    ("gpl", "This file is part of Foo, which is licensed under the GNU General Public License version 2."), ("agpl", "Foo is licensed under the GNU Affero General Public License, version 3 or later."), ("agpl", "You can redistribute the server and/or modify it under the terms of the GNU Affero General Public License."),
    ("lgpl", "The library is released under the GNU Lesser General Public License."), ("cc-by", "Text may be used under the Creative Commons Attribution 4.0 International License."), ("cc-by-sa", "The articles are licensed under a Creative Commons Attribution-ShareAlike 4.0 License."), ("cc-by-nd", "Released under CC BY-ND 4.0."), ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivs 3.0 Unported License."),
    ("cc-by-nc", "Photos are CC BY-NC 2.0 licensed."), ("cc-by-nc-sa", "This tutorial is shared under CC BY-NC-SA 4.0."), ("cc-by-nc-nd", "Podcast licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."), ("bsd", "This project uses the BSD 2-Clause License."), ("isc", "Licensed under the ISC license."), ("epl", "Made available under the Eclipse Public License v2.0."), ("mpl", "The code is available under the Mozilla Public License 2.0."),
    ("boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."), ("zlib", "This library is distributed under the zlib license."), ("unlicense", "This is free and unencumbered software released into the public domain, see the Unlicense."), ("cc0", "The data is released under the Creative Commons CC0 public domain dedication."), ("mit", 'The software is provided "as is", without warranty of any kind, express or implied.'),
    ("", "Licensed under the Frobnicator License."), ("", "Released under the Elastic License 2.0."), ("", "This work is licensed under the Hippocratic License 3.0."), ("", "Licensed under the Intel Open Source License."), ("", "The software is covered by the Academic Free License."), ("", "Licensed under the Nokia Open Source License."), ("", "The licence to print money was revoked."), ("", "Their license plates were from Ohio."), ("", "Copyright infringement is a crime in most countries."), ("", "Permission to film in the Apache reservation was refused."),
]


def test_licences_of_sentences_that_no_fit_saw(spark):
    """No family is confirmed that is not the one named, and most that are named are confirmed."""
    rows = [(k, text, "s") for k, (_, text) in enumerate(HELD_OUT)] + [(500 + k, f"the house number {k} was in the long street of the town", "s") for k in range(300)]
    got = {r.doc_id: r.licences for r in licences.document_licences(docs_of(spark, rows)).collect()}
    assert [(text, family, got[k]) for k, (family, text) in enumerate(HELD_OUT) if got[k] not in ("", family)] == []
    assert sum(got[k] == family for k, (family, _) in enumerate(HELD_OUT) if family) >= 20


NO_GRANTS = ["The program is not licensed under the GNU General Public License.", "Unlike software under the MIT License, this product may not be copied.", "He wrote an essay on why the GNU General Public License matters.", "The sources aren't released under the Apache License, Version 2.0.", "We chose our own terms rather than the Mozilla Public License, version 2.0."]
SEVERAL = [
    ("apache,mit", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."), ("gpl,mit", "Dual licensed under the MIT and GPL licenses."), ("apache,mit", "SPDX-License-Identifier: MIT OR Apache-2.0"), ("gpl", "SPDX-License-Identifier: GPL-2.0-only"), ("lgpl", "SPDX-License-Identifier: LGPL-3.0-or-later"), ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-3.0"),
    ("mit", "Released under both the MIT License and the Frobnicator Vendor License."),
]


def test_licences_denied_named_and_several(spark):
    rows = [(k, text, "s") for k, text in enumerate(NO_GRANTS)] + [(100 + k, text, "s") for k, (_, text) in enumerate(SEVERAL)] + [(500 + k, f"the house number {k} was in the long street of the town", "s") for k in range(300)]
    got = {r.doc_id: r for r in licences.document_licences(docs_of(spark, rows)).collect()}
    assert [(text, got[k].licences) for k, text in enumerate(NO_GRANTS) if got[k].licences] == []
    right = [set(got[100 + k].licences.split(",")) - {""} <= set(names.split(",")) for k, (names, _) in enumerate(SEVERAL)]
    assert all(right), [(text, got[100 + k].licences) for k, (_, text) in enumerate(SEVERAL) if not right[k]]
    missed = [(text, got[100 + k].licences) for k, (names, text) in enumerate(SEVERAL) if got[100 + k].licences != names]
    assert missed == []


def test_licence_probabilities_and_agreement_by_hand(spark):
    """Probabilities and agreement recomputed from the coefficients and the templates' grams."""
    docs = spark.createDataFrame([("the cat sat",), ("a dog ran off",)], "sentence string")
    model = licences.Classifier(spark, docs, licences.templates(), 100)
    asked = ["Licensed under the Apache License, Version 2.0.", "We license cats to dogs.", "Licensed under CC BY-SA 4.0 or so."]
    scored = model.score(spark.createDataFrame(list(enumerate(asked)), "key long, sentence string"))
    w, b, at = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray(), {g: k for k, g in enumerate(model.vocabulary)}
    grams = lambda s: (lambda x: {*x, *map(" ".join, zip(x, x[1:]))})([y for y in re.split(licences.GAP, s.lower()) if y])
    weights = {r.gram: r.weight for r in model.grams.collect()}
    lines = {}
    for r in model.inverted.collect():
        lines.setdefault((r.family, r.line), set()).add(r.gram)
    compared = {r.key: r for r in model.agreement(scored, "key").collect()}
    for r in scored.collect():
        x = np.zeros(len(at))
        x[[at[g] for g in grams(r.sentence) if g in at]] = 1
        z = w @ x + b
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(r.p_none - p[0]) < 1e-9 and abs(r.probability - p[1:].max()) < 1e-9 and r.guess == model.families[1 + int(p[1:].argmax())]
        if r.key in compared and r.key != 1:
            own = grams(r.sentence)
            size = sum(weights.get(g, 0) for g in own)
            best = {}
            for (family, _), line in lines.items():
                s = 2 * sum(weights[g] for g in own & line) / (size + sum(weights[g] for g in line))
                best[family] = max(best.get(family, 0), s)
            assert abs(compared[r.key].similarity - best[r.guess]) < 1e-9
            assert abs(compared[r.key].rival - max(v for f, v in best.items() if f != r.guess)) < 1e-9


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain, bad = [f"word{k}" for k in range(80)], ["vileish", "vileous", "grubby", "scornful"]
    texts, labels = [], []
    for k in range(600):
        words, toxic = list(rng.choice(plain, int(rng.integers(20, 80)))), int(k % 6 == 0)
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        texts.append((k, " ".join(words), "s"))
        labels.append((k, toxic))
    texts += [(1000, None, "s"), (1001, "", "s"), (1002, "idle " * 5000, "s"), (5, texts[5][1], "s")]
    labels += [(None, 1), (7, None), (0, 1)]
    table, marks = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = toxicity.toxicity(table, marks, held).collect()
    assert len(got) == len(texts)
    truth = dict(labels[:600])
    judged = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged) and sum(b for a, b in judged if a) >= 0.9 * sum(a for a, _ in judged)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels[:600]], "doc_id long, toxic int")
    first, second = ({r.doc_id: r.score for r in toxicity.toxicity(table, m, held).collect()} for m in (spark.createDataFrame(labels[:600], "doc_id long, toxic int"), flipped))
    assert all(abs(first[i] - second[i]) < 1e-9 for i in first)
    assert toxicity.toxicity(table.limit(0), marks, held).count() == 0
    assert len({r.score for r in toxicity.toxicity(table, marks.limit(0), held).collect()}) == 1


def brute_evidence(labelled, everything, asked):
    """Two interpolated Kneser-Ney models by dictionaries: the difference of log-likelihoods of each asked text."""
    fold = lambda t: re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", b" ", t.encode()).lower().split()
    discount, cut, strength = toxicity.DISCOUNT, toxicity.CUT, toxicity.STRENGTH
    far, has = {}, {}
    for text, c in labelled:
        words = fold(text)
        for k, w in enumerate(words):
            h, g = words[k - 1] if k else None, words[k - 2] if k > 1 else None
            far.setdefault((h, w), (set(), set()))[c].add(g)
            has.setdefault(w, [0, 0])[c] = 1
    n = {p: [len(x) for x in sides] for p, sides in far.items()}
    tables = [{}, {}, {}]
    for (_, w), counts in n.items():
        own = tables[0].setdefault(w, [0, 0])
        for c in (0, 1):
            own[c] += counts[c] > 0
    sixes = {}
    for w, sides in has.items():
        for c in (0, 1):
            tables[1].setdefault(w[:6], [0, 0])[c] += sides[c]
            sixes.setdefault((w[:6], w[:4]), [0, 0])[c] |= sides[c]
    for (_, four), sides in sixes.items():
        for c in (0, 1):
            tables[2].setdefault(four, [0, 0])[c] += sides[c]
    tables = [{k: v for k, v in t.items() if sum(v) >= cut} for t in tables]
    tokens = [w for t in everything for w in fold(t)]
    shares = [Counter(w[: (1 << 40, 6, 4)[k]] for w in tokens) for k in range(3)]
    share = lambda k, x: (shares[k][x] + 0.5) / (len(tokens) + 1.0)
    lifts = [{}, {}, {}]
    for k in (2, 1, 0):
        for c in (0, 1):
            kinds, some = max(sum(v[c] for v in tables[k].values()), 1), sum(v[c] > 0 for v in tables[k].values())
            for x, v in tables[k].items():
                above = lifts[k + 1].get(x[: (6, 4)[k]], [1.0, 1.0])[c] if k < 2 else 1.0
                lifts[k].setdefault(x, [0, 0])[c] = (max(v[c] - discount, 0) / share(k, x) + (discount * some + strength * kinds) * above) / (kinds * (1 + strength))
    seen = {}
    for (h, _), counts in n.items():
        if h is not None:
            for c in (0, 1):
                own = seen.setdefault(h, [[0, 0.0], [0, 0.0]])[c]
                own[0] += counts[c]
                own[1] += min(counts[c], discount)
    weight = lambda h, c: (seen[h][c][1] + strength * seen[h][c][0]) / (seen[h][c][0] * (1 + strength)) if h in seen and seen[h][c][0] else 1.0
    out = []
    for text in asked:
        total, words = 0.0, fold(text)
        for k, w in enumerate(words):
            h = words[k - 1] if k and words[k - 1] in tables[0] else None
            d = np.log(weight(h, 1) / weight(h, 0)) if h is not None else 0.0
            level = next((j for j, x in enumerate((w, w[:6], w[:4])) if x in tables[j]), None)
            if level == 0:
                d += np.log(lifts[0][w][1] / lifts[0][w][0])
                if h is not None and sum(n.get((h, w), (0, 0))) >= cut:
                    both = [max(n[h, w][c] - discount, 0) / max(seen[h][c][0] * (1 + strength), 1e-9) + weight(h, c) * lifts[0][w][c] * share(0, w) for c in (0, 1)]
                    own = np.log(both[1] / both[0])
                    if abs(np.log1p(toxicity.MIXTURE * np.expm1(own)) - np.log1p(toxicity.MIXTURE * np.expm1(d))) >= toxicity.PRUNED:
                        d = own
            elif level:
                x = (w[:6], w[:4])[level - 1]
                d = np.log(lifts[level][x][1] / lifts[level][x][0])
            total += np.log1p(toxicity.MIXTURE * np.expm1(d))
        out.append(total / max(len(words), 1) ** toxicity.LENGTH_POWER)
    return out


def test_toxicity_evidence_by_hand(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"{a}{b}{c}" for a in ("word", "Stem", "other", "x-") for b in ("", "ab", "abcd") for c in range(6)]
    texts = [(k, " ".join(rng.choice(vocabulary[k % 2 * 20 :], int(rng.integers(1, 40)))), "s") for k in range(200)] + [(900, None, "s"), (901, "", "s")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts).select("doc_id", "text"), labels, F.lit(True))
    counted = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) > 0).collect()}
    asked = [t for _, t, _ in texts[:60]] + ["unknown wordabc", "", "word1, word2; STEMAB3"]
    expected = brute_evidence([(t, int(k % 3 == 0)) for k, t, _ in texts[:200] if k in counted], [t or "" for _, t, _ in texts], asked)
    assert np.allclose(model.evidence(pa.array(asked)), expected, rtol=1e-9, atol=1e-12) and np.ptp(expected) > 0.001


def test_toxicity_counts_every_labelled_text(spark):
    rng = np.random.default_rng(8)
    texts = [(k, " ".join(str(w) for w in rng.choice([f"word{j}" for j in range(40)] + [f"own{k // 40}x"], 30)), "s") for k in range(800)]
    labels = spark.createDataFrame([(k, int(k % 40 == 0)) for k in range(800)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts).select("doc_id", "text"), labels, F.lit(True))
    counted = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) > 0).collect()}
    contexts = {(k % 40 == 0, before, word) for k, t, _ in texts if k in counted for before, word in zip(["", *t.split()], t.split())}
    expected = {w for w, n in Counter(w for *_, w in contexts).items() if n >= toxicity.CUT}
    hashes = {w: int(toxicity._words(pa.array([w]))[0][0]) for w in expected}
    assert set(model.levels[0][0].tolist()) == set(hashes.values()) and sum(w.startswith("own") for w in expected) == 20
    joined = toxicity.fit(docs_of(spark, texts).select("doc_id", "text"), labels, F.lit(True), max_sent=10)
    assert all((a == b).all() for x, y in zip(model.levels, joined.levels, strict=True) for a, b in zip(x, y, strict=True)) and abs(model.slope - joined.slope) < 1e-9


def thue_morse(letters: str, n: int) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_op6_keeps_windows_that_differ_in_one_long_word(spark):
    """Words at which polynomial hashes modulo 2**64 fail, and words longer than a block of the hashing."""
    line = [f"v{k}" for k in range(40)]
    for a, b in ((thue_morse("ab", 2048), thue_morse("ba", 2048)), ("x" * 70_000 + "y" * 70_000, "x" * 70_000 + "y" * 69_999 + "z")):
        texts = [" ".join([*line[:20], word, *line[21:]]) for word in (a, b, a)]
        found = {r.doc_id: r for r in substrings.repeats(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts[:2])])).collect()}
        assert [found[k].n_removed for k in (0, 1)] == [0, 0]
        found = {r.doc_id: r for r in substrings.repeats(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
        assert [found[k].n_removed for k in (0, 1, 2)] == [40, 0, 40]


def test_packed_hashes_come_back(spark):
    from pactum.llm.shared import pack, unpack

    for n in (0, 1, 100, 5000):
        values = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert (unpack(pack(values)) == values).all()


def test_hashes_of_long_and_short_words_agree_with_a_plain_sum():
    from pactum.llm import shared

    words = [b"a", b"", b"ab" * 50_000, b"c" * 65_536, b"d" * 65_537, b"e"]
    data = np.frombuffer(b" ".join(w for w in words if w), np.uint8)
    starts, ends, _ = shared.word_spans(data, np.array([0, len(data)]))
    keys = shared._keys(9, 0, 100_000)
    for word, got in zip([w for w in words if w], shared.word_hashes(data, starts, ends, 9), strict=True):
        total = sum((c + 1) * int(k) for c, k in zip(word, keys[: len(word)], strict=True)) + len(word)
        assert int(shared.mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0]) == int(got)
