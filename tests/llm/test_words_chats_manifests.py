"""Spelling variants, chat formatting and the Merkle manifest against plain loops, with odd rows, and with each query on the
smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pactum.llm import chat, merkle, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_chat", "op13_merkle"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    expected = con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, expected))


def brute_variants(rows, noise=97):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {x: n for x, n in counts.items() if len(x) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {a: [b for b in words if b != a and abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in words}
    form = {}
    for a, some in near.items():
        best = min(some, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {a: (form[a], root(a), n, len(near[a]), words[form[a]] if form[a] else None) for a, n in words.items()}


def spelled(seed=3, n=300):
    """Words and their slips, some often, some seldom, in rows with odd ids, scripts and lengths."""
    rng = np.random.default_rng(seed)
    letters = list("abcdeéÿz×")
    stems = ["".join(rng.choice(letters, int(rng.integers(5, 9)))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "colour", "color", "colours"]
    rows = []
    for k in range(n):
        own = []
        for w in rng.choice(stems, 30):
            if rng.random() < 0.4:
                at = int(rng.integers(0, len(w)))
                w = w[:at] + str(rng.choice([*letters, ""])) + w[at + int(rng.integers(0, 2)) :]
            own.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((k, "; ".join(own)))
    long = "x" * 3000
    rows += [(None, None), (7, ""), (None, " colour Colour COLOUR ÀÉÎÕÜ ÀÉÎÕÜ àéîõü àéîõü àéîõü ÀÉÎÕÜ"), (9, f"{long} {long} {long} {long}y {long}y {long}y"), (9, "日本語日本語 abcd abcd"), (11, "cafés cafés")]
    return rows + rows[:3] + [(12, "stone " * 3 + "stane " * 6 + "stans " * 12)]


@pytest.mark.parametrize("noise", [97, 5])
def test_variants(spark, noise):
    rows = spelled()
    docs = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], "doc_id long, text string, word string, n int, run string")
    got = {r.word: tuple(r)[1:] for r in spelling.variants(docs, noise=noise).collect()}
    expected = brute_variants(rows, noise)
    assert got == expected
    assert sum(v[0] is not None for v in got.values()) > 20 and any(v[1] not in (k, v[0]) for k, v in got.items())
    assert spelling.variants(docs.limit(0)).count() == 0


def test_variants_without_noise_and_words(spark):
    docs = spark.createDataFrame([(1, "house house house mouse mouse mouse mouse mouse mouse hous hous hous"), (2, None)], "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(docs, noise=0).collect()}
    assert got == {("house", "mouse", "mouse", 3, 1, 6), ("mouse", None, "mouse", 6, 1, None)}


@pytest.mark.parametrize(("side", "bucket"), [(3, 10), (40, 300)])
def test_blocks_cut_in_parts_find_the_same(spark, side, bucket):
    """One block holds most words, and is cut however small its parts are."""
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("agm"), 7)) for _ in range(150)} | {"".join(rng.choice(list("abc"), int(rng.integers(5, 8)))) for _ in range(100)}
    df = spark.createDataFrame([(w, k + 3) for k, w in enumerate(sorted(words))], "word string, n long")
    count = {w: k + 3 for k, w in enumerate(sorted(words))}
    got = sorted(tuple(r) for r in spelling.near_words(df, side, bucket).collect())
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
    assert got == sorted((a, b, count[b]) for a in words for b in words if a != b and (apart(a, b) or apart(b, a)))


def test_squared_distances_of_one_edit():
    """Each pair one edit apart meets once, whatever its classes; the product keeps no pair at a distance of three."""
    words = sorted({"abcdefg", "abcdefgh", "bcdefg", "abcxefg", "gfedcba", "abcdegf", "zzzzz", "zzzzzz"})
    batch = pa.RecordBatch.from_pydict({"word": pa.array(words), "n": pa.array(range(3, 3 + len(words)), pa.int64())})
    table = pa.Table.from_batches(list(spelling.blocked(iter([batch]))))
    zero = pa.array([0] * len(table), pa.int32())
    found = spelling.compare(table.append_column("i", zero).append_column("j", zero).append_column("part", zero))
    pairs = Counter(zip(found.column("word").to_pylist(), found.column("near").to_pylist(), strict=True))
    assert set(pairs.values()) == {1}
    assert {p for p in pairs if p[0] < p[1]} == {("abcdefg", "abcdefgh"), ("abcdefg", "bcdefg"), ("abcdefg", "abcxefg"), ("zzzzz", "zzzzzz")}


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{k}": "w40" for k in range(40)}
    assert spelling.roots(forms.limit(0)).count() == 0


TURNS = [
    (1, 0, "user", "a\\<turn> <turn> \\\\</turn>\n</turn>\n"), (1, 1, "user", None), (1, 2, "assistant", "x\n<next>\n"), (1, 2, "assistant", "x\n<next>\n"), (1, None, "we\\ird\n\\n<turn>\\", "end\\"), (None, 3, None, "<next>"), (2, 5, "assistant", ""), (2, 1, "assistant", "\\"), (2, 9, "user", "\n"), (2, 10, "assistant", "é日本 </turn"), (3, 1, "assistant", "\n</turn>\n<turn>user\nhi"), (3, 1, "", "tie"), (3, 1, None, "tie"),
]


def test_chats(spark):
    df = spark.createDataFrame([(*r, 1, "p", []) for r in TURNS], "conv_id long, turn long, role string, text string, t int, formatted string, pieces array<string>")
    out = chat.format_chats(df).withColumns({"read": chat.read_turns(F.col("formatted")), "learned": chat.learned_text(F.col("pieces"))}).collect()
    by = defaultdict(list)
    for c, n, role, text in TURNS:
        by[c].append(((n is not None, n), role or "", text or ""))
    assert {r.conv_id for r in out} == set(by) and len(out) == len(by)
    for r in out:
        turns = [(role, text) for _, role, text in sorted(by[r.conv_id])]
        assert [tuple(t) for t in r.read] == turns
        assert r.learned == "".join(text for role, text in turns if role == "assistant")
        assert r.formatted == "".join(p.text for p in r.pieces)
        assert r.formatted.count("\n</turn>\n") == sum(k == 0 or turns[k - 1][0] != role for k, (role, _) in enumerate(turns))
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_chats_of_many_turns_and_long_texts(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 5, F.repeat(F.lit("\\<turn>"), F.lit(300_000))).otherwise(F.col("id").cast("string")).alias("text"))
    [r] = chat.format_chats(turns).select(chat.read_turns(F.col("formatted")).alias("r"), F.length(chat.learned_text(F.col("pieces"))).alias("n"), F.size(F.filter(F.split("formatted", "\n"), lambda x: x == "</turn>")).alias("blocks")).collect()
    assert len(r.r) == 3000 and r.r[5].text == "\\<turn>" * 300_000 and r.r[2999].text == "2999" and r.blocks == 2000
    assert r.n == 7 * 300_000 + sum(len(str(k)) for k in range(3000) if k % 3 and k != 5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def brute_tree(nodes, fan):
    """Digest of a tree's last node, and for each leaf what stands left and right of its ancestors."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k in range(len(nodes)):
            begin = at[k] // fan * fan
            run = now[begin : begin + fan]
            paths[k].append(("".join(run[: at[k] - begin]), "".join(run[at[k] - begin + 1 :])))
            at[k] //= fan
        now = [sha("".join(now[k : k + fan])) for k in range(0, len(now), fan)]
    return now[0], paths


def brute_manifest(rows, later, fan=8):
    """rows (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for g in order:
        langs[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subs[g] = brute_tree([leaf(r, r[4]) for r in langs[g]], fan)
    root, top = brute_tree([subs[g][0] for g in order], fan)
    out = []
    for g, above in zip(order, top, strict=True):
        for r, below in zip(langs[g], subs[g][1], strict=True):
            own, path = leaf(r, later(r)), below + above
            for a, b in path:
                own = sha(a + own + b)
            out.append((r[0], leaf(r, r[4]), subs[g][0], root, sha("".join(a + b for a, b in path)), own, own == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, tampered=None, fan=8):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, size int, path string")
    out = merkle.manifest(df, tampered, fan)
    h = lambda c: merkle.hexed(F.col(c)).alias(c)
    return sorted((tuple(r) for r in out.select("doc_id", h("leaf"), h("subroot"), h("root"), merkle.hexed(merkle.proof(F.col("path"))).alias("proof"), h("folded_root"), "verified").collect()), key=str)


def manifest_docs():
    rows = [(k, f"s{k % 3}" if k % 7 else None, ["en", "de", "é", None, "", "Z"][k % 6] if k < 300 else "en", k * 2 if k % 5 else None, ["Text É", "", None, "lower", "X" * 5000][k % 5]) for k in range(400)]
    # one lang with a single leaf, null and repeated ids, and rows that stand twice
    return [*rows, (1, "a", "lone", 3, "one"), (None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 1, "A"), (5, "other", "en", 1, "B"), (5, "other", "en", 1, "B"), *rows[:9]]


def test_manifest(spark):
    rows = manifest_docs()
    later = lambda r: r[4].translate(LOW) if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4]
    change = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    rows = [r if r[4] != "Text É" else (*r[:4], "Text e") for r in rows]
    got = manifest_rows(spark, rows, change)
    assert got == brute_manifest(rows, later)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_manifest_of_few_rows(spark, n):
    rows = manifest_docs()[300 : 300 + n]
    got = manifest_rows(spark, rows)
    assert got == (brute_manifest(rows, lambda r: r[4]) if rows else []) and all(r[-1] for r in got)


def test_manifest_of_many_trees(spark):
    """More trees than a node has children, each of another height."""
    rows = [(k, "s", f"l{j}", 1, f"t{k}") for j in range(12) for k in range(1 + j * 3)]
    assert manifest_rows(spark, rows, fan=3) == brute_manifest(rows, lambda r: r[4], 3)
