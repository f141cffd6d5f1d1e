from collections import Counter

import corpus_pipeline
from pactum.llm import mixing


def test_stages_chain(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, source)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name in ("toxicity", "simhash"):
            assert 0.5 * before < docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, source)
    assert last.count() == docs.count() and last.where("size(ids) <> n_tokens").count() == 0
    whole = corpus_pipeline.run(spark, source)
    assert whole.columns == last.columns and sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in last.collect())


def labels_at(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_every_stage_takes_odd_rows(spark, tmp_path):
    """Nulls in each column, empty, wordless and very long texts, repeated rows, columns with clashing names, and no rows."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", None, 4), (3, "x" * 300_000, None, "s", 300_000), (4, "one two three four five", "en", "s", 23), (4, "one two three four five", "en", "s", 23), (5, "word " * 60_000, "de", "t", 300_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "a", 1, "b", 2.0) for r in rows], schema + ", fp string, batch int, copies string, score double")
    folder = labels_at(spark, tmp_path, [(1, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)])
    kept = Counter(tuple(r)[:5] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).collect()
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if name in ("toxicity", "substrings"):
            assert len(out) == len(rows) or name == "toxicity" and len(out) <= len(rows)
        if name == "toxicity":
            assert all(tuple(r) in kept for r in out)
        if name == "simhash":
            assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, ""), (3, rows[3][1]), (4, rows[4][1]), (5, rows[6][1])])
        if name == "substrings":
            by = {r.doc_id: r for r in out}
            assert by[None].text is None and by[5].text == "" and by[4].text == rows[4][1] and by[3].n_chars == 300_000
        if name == "mixing":
            assert {(r.doc_id, r.text) for r in out} <= {r[:2] for r in rows} and Counter(r.doc_id for r in out)[1] == 1
        if name == "byte_bpe":
            assert len(out) == len(rows) and {r.n_tokens for r in out if r.doc_id in (None, 1)} == {0}


def test_toxicity_without_labels_keeps_everything(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k}", "en", "s", 13) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = labels_at(spark, tmp_path, [])
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == 20


def test_rows_with_null_and_shared_ids_stay(spark):
    def text(k):
        return " ".join(f"w{(k * 7919 + j * j * 31) % 5003}x{k}" for j in range(40 + k))

    ids = [None, None, 5, 5, 6, None, 7, 8, 8]
    texts = [text(0), text(1), text(2), text(3), text(4), text(4), text(5), text(6), text(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    expected = sorted([(-1, text(0)), (-1, text(1)), (5, text(2)), (5, text(3)), (6, text(4)), (7, text(5)), (8, text(6))])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect()) == expected
    cut = corpus_pipeline.cut_repeats(spark, kept, "")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in cut.collect()) == expected
    copies = sorted((r.text, r.copies) for r in mixing.mix(kept, carry=("text",)).withColumnRenamed("_text", "text").collect())
    mixed = Counter(r.text for r in corpus_pipeline.mix_sources(spark, kept, "").collect())
    assert len(copies) == 7 and mixed == Counter({t: n for t, n in copies if n}) and sum(mixed.values()) > 7
