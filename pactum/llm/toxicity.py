"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, of toxic and of ordinary labelled texts, score a text by the difference of its
log-likelihoods over a power of its length; a logistic curve fitted on other labelled texts turns that into 0 to 1. A word
after another backs off to the word, a rare word to its stems, and all levels to counts over every document that both
classes share, so a rare expression weighs little until a class has shown it in several contexts. A toxic text is taken as
mostly ordinary words with some of its own, so its model is interpolated with the ordinary one.

The models count every labelled text of either class, so their tables grow with the labelled vocabulary (40 bytes a word and
stem on the driver); pairs are judged on the executors, and those that say no more than their words go. Only the
curve's two numbers are fitted on a bounded sample (max_calibration texts). The shared counts cover every document. They
are taken for expressions of labelled texts alone: where neither class has shown one, its shared count is the same factor
of both likelihoods and falls out of their difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import discard, materialize, mix, prefix_hashes, slices, text_bytes, word_spans

#: Texts that the curve is fitted on.
MAX_CALIBRATION = 8000
#: Ids of labelled texts that are sent to all executors, 16 bytes each; more are joined by key.
MAX_SENT = 1 << 21
#: Expressions that the labelled texts show in fewer contexts are left to what they back off to.
CUT = 3
#: Stems (first bytes of a word) that a rare word backs off to, the longer first.
STEMS = (6, 4)
DISCOUNT, THRESHOLD = 0.75, 0.3
#: Bytes of text that are scored at once, and whose expressions are gathered at once.
SLICE, GATHERED = 1 << 20, 2 << 20
#: How much the shared counts weigh, as a multiple of a class's own; how much of a toxic text its own model explains,
#: the rest being ordinary; the power of the length that divides the difference of log-likelihoods.
STRENGTH, MIXTURE, LENGTH_POWER = 0.01, 0.01, 1.0
#: Pairs of words of which the evidence differs by less from what they back off to are left to that: nearly all are, so
#: what goes through the driver and to all executors is the words, and the few pairs that tell.
PRUNED = 0.005

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes of the words of all texts (A-Z lower-cased, ASCII punctuation as space), of their stems, longest first, and
    the index of each text's first word."""
    data, at = text_bytes(texts)
    data = _FOLD[data]
    starts, ends, first = word_spans(data, at)
    *stems, words = prefix_hashes(data, starts, [*(np.minimum(ends, starts + k) for k in STEMS), ends])
    return words, *stems, first


def _before(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the word before it in its text, 0 for the first."""
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words.copy()
    before[first[:-1][first[:-1] < len(words)]] = 0
    return before


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before, 1) ^ mix(words, 2)


def _find(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """The place of each sought value in ascending keys, -1 where it is none of them."""
    if not len(keys):
        return np.full(len(sought), -1)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return np.where(keys[at] == sought, at, -1)


def sent(ids: DataFrame, most: int) -> DataFrame:
    """A table of ids for a join: sent to all executors if it is counted to have at most `most` rows, else joined by key."""
    return F.broadcast(ids) if ids.count() <= most else ids


def sample_ids(labels: DataFrame, keep: Column, most: int, id_col: str) -> DataFrame:
    """At most `most` ids of labelled rows, spread evenly by a hash of the id: the same on each run."""
    return labels.where(keep).orderBy(F.xxhash64(id_col), id_col).limit(most)


class Model:
    """Tables of log-likelihood differences (toxic less ordinary) by stem, word and pair of words, and the curve."""

    def __init__(self, levels, context_diff, pairs, pair_diff, mixture, length_power):
        self.levels, self.context_diff, self.pairs, self.pair_diff = levels, context_diff, pairs, pair_diff
        self.mixture, self.length_power, self.slope, self.offset = mixture, length_power, 1.0, 0.0

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """The difference of log-likelihoods of each text over a power of its number of words (no words: 0)."""
        *forms, first = _words(texts)
        words, diff, left = forms[0], np.zeros(len(forms[0])), np.arange(len(forms[0]))
        before = _before(words, first)
        for k, (form, (keys, own)) in enumerate(zip(forms, self.levels, strict=True)):
            at = _find(keys, form[left])
            diff[left[at >= 0]] = own[at[at >= 0]]
            if k == 0:
                context = np.concatenate([[-1], at[:-1]]) if len(at) else at
                context[before == 0] = -1
                diff[context >= 0] += self.context_diff[context[context >= 0]]
                likely = np.flatnonzero((context >= 0) & (at >= 0))
            left = left[at < 0]
        at = _find(self.pairs, _pair(before[likely], words[likely]))
        diff[likely[at >= 0]] = self.pair_diff[at[at >= 0]]
        total, n = np.concatenate([[0.0], np.cumsum(np.log1p(self.mixture * np.expm1(diff)))]), np.diff(first)
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1) ** self.length_power

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.offset, -700, 700)))


def _count_contexts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, w, n0, n1): for each word before another in the labelled texts, how many different words stand before the two, in
    ordinary and in toxic texts: a passage that many copies share counts once, as in the lower orders of Kneser-Ney.
    (w, stems, in0, in1): each word, its stems and whether ordinary and toxic texts have it."""
    stems = [f"s{k}" for k in STEMS]

    def contexts(batches):
        for batch in batches:
            for part in slices(batch, "text", GATHERED):
                words, *_, first = _words(part.column(0))
                before = _before(words, first)
                # 40 bits tell the words before one pair apart; the class is the lowest bit
                far = (mix(_before(before, first)) >> np.uint64(24) << np.uint64(1)) | np.repeat(np.array(part.column(1)), np.diff(first)).astype(np.uint64)
                order = np.argsort(words, kind="stable")  # like stands beside like: the shuffle packs it
                far, before, words = far[order], before[order], words[order]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (far, before, words)), pa.array((before & np.uint64(7)).astype(np.int32))], ["g", "h", "w", "salt"])

    def forms(batches):
        for batch in batches:
            for part in slices(batch, "text", GATHERED):
                *found, first = _words(part.column(0))
                toxic = np.repeat(np.array(part.column(1)), np.diff(first))
                _, at = np.unique(mix(found[0], 1) ^ toxic.astype(np.uint64), return_index=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in found), *(pa.array((toxic[at] == c).astype(np.int32)) for c in (0, 1))], ["w", *stems, "in0", "in1"])

    # one shuffle, by a frequent word's eighths, serves both steps: rows that agree in (h, w) are in one partition already
    rows = texts.mapInArrow(contexts, "g bigint, h bigint, w bigint, salt int").repartition("w", "salt").distinct()
    seen_in = rows.groupBy("h", "w", "salt").agg(*[F.count(F.when(F.col("g") % 2 == c, 1)).alias(f"n{c}") for c in (0, 1)]).drop("salt")
    known = texts.mapInArrow(forms, ", ".join([*(f"{x} bigint" for x in ("w", *stems)), "in0 int, in1 int"])).groupBy("w").agg(*[F.min(x).alias(x) for x in stems], *[F.max(x).alias(x) for x in ("in0", "in1")])
    return materialize(seen_in.sortWithinPartitions("w", "h")), materialize(known)


def _corpus_counts(docs: DataFrame, tables: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """How often each key of each table (words, then stems) occurs in all documents, and the number of all words."""
    shared, size = docs.sparkSession.sparkContext.broadcast(tables), sum(map(len, tables))

    def run(batches):
        counts, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                *forms, first = _words(part.column(0))
                total, start = total + int(first[-1]), 0
                for keys, form in zip(shared.value, forms, strict=True):
                    at = _find(keys, form)
                    counts[start : start + len(keys)] += np.bincount(at[at >= 0], minlength=len(keys))
                    start += len(keys)
        if total:
            found = np.append(np.flatnonzero(counts), -1)
            for start in range(0, len(found), 100_000):
                rows = found[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.where(rows < 0, total, counts[rows]))], ["key", "n"])

    got = docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n, counts = np.array(got["key"], np.int64), np.array(got["n"], np.int64), np.zeros(size, np.int64)
    counts[key[key >= 0]] = n[key >= 0]
    return np.split(counts, np.cumsum([len(t) for t in tables])[:-1]), int(n[key < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, max_docs: int | None = None, max_calibration: int = MAX_CALIBRATION, max_sent: int = MAX_SENT, mixture: float = MIXTURE, length_power: float = LENGTH_POWER, strength: float = STRENGTH) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> the model. Labels are read where `allowed` (a condition on doc_id)
    holds: three quarters of those for the counts (max_docs texts a class, if given), the others for the curve. Null labels are
    left out; labelled ids are sent to all executors up to max_sent of them, else joined by key; an id labelled twice counts as toxic if one label says so. Without texts of both classes the evidence is 0
    and all scores are equal; without texts for the curve they are next to 0."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0
    classes = own.where(~curve).select("toxic").distinct().count()
    counted = own.where(~curve & F.lit(classes == 2))
    if max_docs is not None:
        counted = sample_ids(counted, F.col("toxic") == 1, max_docs, "doc_id").union(sample_ids(counted, F.col("toxic") == 0, max_docs, "doc_id"))
    seen_in, known = _count_contexts(docs.join(sent(counted, max_sent), "doc_id").select("text", "toxic"))
    by_class = lambda x, name="n": [F.sum(F.expr(x.format(c))).cast("double").alias(f"{name}{c}") for c in (0, 1)]
    forms = ["w", *(f"s{k}" for k in STEMS)]
    # spreads: a word counts the different words before it, a stem the different longer forms that begin with it
    usual = materialize(seen_in.groupBy("w").agg(*by_class("int(n{} > 0)")).where(F.col("n0") + F.col("n1") >= CUT))
    keys, spreads, parents = [], [], []
    for k, form in enumerate(forms):
        if not k:
            found = usual.join(known.select("w", F.col(forms[1]).alias("parent")), "w").toArrow()
        else:
            rows = known.groupBy(forms[k - 1 : k + 2]).agg(F.max("in0").alias("in0"), F.max("in1").alias("in1")) if k > 1 else known
            found = rows.groupBy(form).agg(*by_class("in{}"), F.min(forms[k + 1] if k + 1 < len(forms) else F.lit(0)).alias("parent")).where(F.col("n0") + F.col("n1") >= CUT).toArrow()
        key = np.array(found[form], np.int64).view(np.uint64)
        order = np.argsort(key)
        keys.append(key[order])
        spreads.append([np.array(found[f"n{c}"], float)[order] for c in (0, 1)])
        parents.append(np.array(found["parent"], np.int64).view(np.uint64)[order])
    shares, total = _corpus_counts(docs, keys) if len(keys[0]) else ([np.zeros(len(x)) for x in keys], 0)
    lifts: list[list[np.ndarray]] = [[] for _ in forms]
    for k in reversed(range(len(forms))):
        share = (shares[k] + 0.5) / (total + 1.0)
        above = _find(keys[k + 1], parents[k]) if k + 1 < len(forms) else np.full(len(keys[k]), -1)
        for c in (0, 1):
            spread, all_kinds = spreads[k][c], max(spreads[k][c].sum(), 1.0)
            pull = (DISCOUNT * (spread > 0).sum() + strength * all_kinds) * np.where(above >= 0, lifts[k + 1][c][above] if k + 1 < len(forms) and len(keys[k + 1]) else 1.0, 1.0)
            lifts[k].append((np.maximum(spread - DISCOUNT, 0) / share + pull) / (all_kinds * (1 + strength)))
    by_context = seen_in.where("h <> 0").groupBy("h").agg(*by_class("n{}"), *by_class(f"least(n{{}}, {DISCOUNT}d)", "t"))
    contexts = by_context.join(usual.select(F.col("w").alias("h")), "h", "left_semi").toArrow()
    place = _find(keys[0], np.array(contexts["h"], np.int64).view(np.uint64))
    seen, weight = [], []
    for c in (0, 1):
        n, taken = np.zeros(len(keys[0])), np.zeros(len(keys[0]))
        n[place[place >= 0]], taken[place[place >= 0]] = np.array(contexts[f"n{c}"], float)[place >= 0], np.array(contexts[f"t{c}"], float)[place >= 0]
        seen.append(np.maximum(n * (1 + strength), 1e-9))
        weight.append(np.where(n > 0, (taken + strength * n) / seen[c], 1.0))
    single = [lifts[0][c] * (shares[0] + 0.5) / (total + 1.0) for c in (0, 1)]
    context_diff, word_diff = np.log(weight[1]) - np.log(weight[0]), np.log(lifts[0][1]) - np.log(lifts[0][0])
    shared = docs.sparkSession.sparkContext.broadcast((keys[0], seen, weight, single, context_diff, word_diff))

    def telling(batches):
        known, seen, weight, single, context_diff, word_diff = shared.value
        for batch in batches:
            h, w = (np.array(batch.column(x), np.int64).view(np.uint64) for x in ("h", "w"))
            at_word, at_context = _find(known, w), _find(known, h)
            both = (at_word >= 0) & (at_context >= 0)
            at_word, at_context = at_word[both], at_context[both]
            logs = [np.log(np.maximum(np.array(batch.column(f"n{c}"), float)[both] - DISCOUNT, 0) / seen[c][at_context] + weight[c][at_context] * single[c][at_word]) for c in (0, 1)]
            diff, plain = logs[1] - logs[0], context_diff[at_context] + word_diff[at_word]
            keep = np.abs(np.log1p(mixture * np.expm1(diff)) - np.log1p(mixture * np.expm1(plain))) >= PRUNED
            yield pa.RecordBatch.from_arrays([pa.array(_pair(h[both], w[both])[keep].view(np.int64)), pa.array(diff[keep])], ["pair", "diff"])

    found = seen_in.where("h <> 0").where(F.col("n0") + F.col("n1") >= CUT).select("h", "w", "n0", "n1").mapInArrow(telling, "pair bigint, diff double").toArrow()
    pair_keys = np.array(found["pair"], np.int64).view(np.uint64)
    order = np.argsort(pair_keys)
    levels = [(x, np.log(lift[1]) - np.log(lift[0])) for x, lift in zip(keys, lifts, strict=True)]
    model = Model(levels, context_diff, pair_keys[order], np.array(found["diff"], float)[order], mixture, length_power)
    discard(seen_in, known, usual)
    _fit_curve(model, docs, sample_ids(own, curve, max_calibration, "doc_id"))
    return model


def _fit_curve(model: Model, docs: DataFrame, ids: DataFrame) -> None:
    """Logistic regression of the label on the evidence, by Newton's method with a slight pull of the slope to 0."""
    found = _scored(docs.join(F.broadcast(ids), "doc_id"), model, "evidence", ["toxic"]).select("toxic", "evidence").toArrow()
    y, x = np.array(found["toxic"], float), np.array(found["evidence"], float)
    if not len(y):  # nothing says that anything is toxic
        model.slope, model.offset = 0.0, -20.0
        return
    scale = (x.std() if len(x) else 0.0) or 1.0
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30)))
        v, e = p * (1 - p) + 1e-9, y - p
        g, m = np.array([(e * x / scale).sum() - 0.1 * a, e.sum() - 0.01 * b]), np.array([[(v * (x / scale) ** 2).sum() + 0.1, (v * x / scale).sum()], [(v * x / scale).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(m, g)
        a, b = np.clip(a + np.clip(step[0], -2, 2), 0, 50), np.clip(b + np.clip(step[1], -2, 2), -20, 20)
    model.slope, model.offset = float(a / scale), float(b)


def _scored(docs: DataFrame, model: Model, what: str, keep: list[str], with_text: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep, *["text"] * with_text]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                values = getattr(shared.value, what)(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values, pa.float64())], [*names, what])

    rows = docs.select("doc_id", *keep, "text")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, {what} double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, carried columns) of every row, from its whole text alone. Labels of held_out
    ids are not read.

    A null, empty or wordless text has no evidence either way and gets the curve's value at 0. Without labels no text is toxic. Repeated rows get equal
    scores; an empty table gives an empty result; columns that are neither named nor carried are not read."""
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry if c != text_col])
    model = fit(own, labels.select("doc_id", "toxic"), ~out)
    scored = _scored(own, model, "score", [f"_{c}" for c in carry if c != text_col], text_col in carry)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col("text" if c == text_col else f"_{c}").alias(c) for c in carry])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return toxicity(read("documents"), read("labels"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
