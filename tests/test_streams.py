"""Streaming jobs driven to completion on files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pactum.operators.chunks import chunk
from pactum.plans import books
from pactum.sources.stored import read_stored
from pactum.streaming import streams


def files(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def drained(spark, df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def at(minute, second=0):
    return dt.datetime(2026, 1, 1, minute // 60, minute % 60, second)


def test_first_uploads(spark, tmp_path):
    stream = files(spark, tmp_path, [[("a", at(0)), ("b", at(1))], [("a", at(2)), ("c", at(3))]], "content string, arrived_at timestamp")
    assert sorted(r.content for r in drained(spark, streams.first_uploads(stream), tmp_path)) == ["a", "b", "c"]


def test_drain_is_idempotent(spark, tmp_path):
    schema = "document_id string, page_number int, text string, image_area_ratio double, has_text_layer boolean, has_table_hint boolean, table_extraction_failed boolean"
    stream = files(spark, tmp_path, [[("d", 1, "one. " * 300, 0.1, True, False, False)], [("e", 1, "two words", 0.1, True, False, False)]], schema)
    for _ in range(2):
        streams.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(180)
    chunks = spark.read.parquet(f"file://{tmp_path}/out/chunks")
    assert sorted({r.document_id for r in chunks.collect()}) == ["d", "e"] and chunks.count() == chunks.select("hash").distinct().count()


def test_a_batch_of_one_file_is_all_cores_work(spark, tmp_path):
    schema = "document_id string, page_number int, text string, image_area_ratio double, has_text_layer boolean, has_table_hint boolean, table_extraction_failed boolean"
    rows = [("d", k, f"Page {k}. " * 9, 0.1, True, False, False) for k in range(40)]
    streams.drain_batch(spark.createDataFrame(rows, schema).coalesce(1), 0, f"file://{tmp_path}/out")
    assert len(list(tmp_path.glob("out/pages/batch=0/*.parquet"))) == spark.sparkContext.defaultParallelism
    assert [r.ordinal for r in spark.read.parquet(f"file://{tmp_path}/out/chunks").orderBy("page_number").collect()] == list(range(40))


PAGES = "document_id string, page_number int, text string, image_area_ratio double, has_text_layer boolean, has_table_hint boolean, table_extraction_failed boolean"


def page(document, number, sentences):
    return (document, number, " ".join(f"Sentence {k} of page {number} is as long as it has to be." for k in range(sentences)), 0.1, True, False, False)


def test_ordinals_run_on_over_batches(spark, tmp_path):
    """Three batches, the second run again after the third batch's state is not there yet, give what one batch gives."""
    out = f"file://{tmp_path}/out"
    batches = [[page("a", 1, 60), page("a", 2, 3), page("b", 1, 30)], [page("a", 3, 45), page("c", 7, 1), (None, 1, "no document", 0.1, True, False, False)], [page("b", 2, 25), page("a", 4, 1), page("a", 5, 70)]]
    frames = [spark.createDataFrame(rows, PAGES) for rows in batches]
    for k in (0, 1, 1, 2, 2):
        streams.drain_batch(frames[k], k, out)
    columns = ["document_id", "page_number", "ordinal", "char_start", "char_end", "hash"]
    got = sorted(map(str, spark.read.parquet(f"{out}/chunks").select(*columns).collect()))
    whole = sorted(map(str, chunk(spark.createDataFrame(sum(batches, []), PAGES)).select(*columns).collect()))
    assert got == whole
    state = {r.document_id: (r.next, r.batch) for r in read_stored(spark, f"{out}/ordinals", streams.ORDINALS).collect()}
    assert {d: b for d, (_, b) in state.items()} == {"a": 2, "b": 2, "c": 1}
    assert state["a"][0] == 1 + max(r.ordinal for r in spark.read.parquet(f"{out}/chunks").where("document_id = 'a'").collect())


END = [(None, dt.datetime(2026, 1, 9), 0, True)]


def test_failure_monitor(spark, tmp_path):
    spark.conf.set(*streams.STATE_STORE)
    rows = [[("u", at(0), 1, False), ("u", at(1), 2, False), ("v", at(1), 3, False)], [("u", at(2), 4, True), ("u", at(3), 5, False), ("v", at(30), 6, False)], END]
    stream = files(spark, tmp_path, rows, "user string, ts timestamp, event_id long, succeeded boolean")
    got = sorted((r.key, r.ts.minute, r.failures) for r in drained(spark, streams.failure_monitor(stream, "user"), tmp_path))
    assert got == [("u", 0, 1), ("u", 1, 2), ("u", 3, 1), ("v", 1, 1), ("v", 30, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_failure_monitor_in_any_order_of_arrival(spark, tmp_path, seed):
    """Events come up to 50 minutes late, a success after the failures that it ends; one comes too late and counts nowhere."""
    spark.conf.set(*streams.STATE_STORE)
    rng = random.Random(seed)
    events = [(rng.choice("uv"), at(0) + dt.timedelta(seconds=rng.randrange(6 * 3600)), k, rng.random() < 0.2) for k in range(120)]
    arrived = sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=rng.randrange(50)))
    batches = [arrived[k : k + 24] for k in range(0, 120, 24)]
    stream = files(spark, tmp_path, [*batches, END, [("u", at(5), 999, False)]], "user string, ts timestamp, event_id long, succeeded boolean")
    got = sorted((r.key, r.ts, r.failures) for r in drained(spark, streams.failure_monitor(stream, "user"), tmp_path))
    expected = []
    for key in "uv":
        times = []
        for _, ts, _, ok in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            times = [] if ok else [t for t in times if t >= ts - dt.timedelta(seconds=900)] + [ts]
            if not ok:
                expected.append((key, ts, len(times)))
    assert got == sorted(expected)


def test_spend_admission(spark, tmp_path):
    spark.conf.set(*streams.STATE_STORE)
    rows = [[(1, "d", at(0), 3.0), (2, "d", at(1), 1.5)], [(3, "d", at(2), 1.0), (4, "d", at(3), 0.5), (5, "e", at(3), 5.0)]]
    stream = files(spark, tmp_path, rows, "request_id long, document_id string, ts timestamp, estimate double").withColumn("estimate", F.col("estimate").cast("decimal(12,6)"))
    got = {r.request_id: (r.admitted, r.spent_micros) for r in drained(spark, streams.spend_admission(stream), tmp_path)}
    assert got == {1: (True, 3_000_000), 2: (True, 4_500_000), 3: (False, 4_500_000), 4: (True, 5_000_000), 5: (True, 5_000_000)}


def test_streams_of_tables_that_are_folders(spark, tmp_path):
    """A table is one file or a folder of files."""
    rows = spark.createDataFrame([(k, f"Text {k}.", "s", 7) for k in range(6)], "doc_id long, text string, source string, n_chars long")
    rows.repartition(3).write.parquet(f"file://{tmp_path}/folder/documents.parquet")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file/documents.parquet")
    got = [sorted(map(tuple, books.streamed_pages(spark, f"file://{tmp_path}/{d}").collect())) for d in ("folder", "file")]
    assert got == [sorted((kind, k, n) for k in range(6) for kind, n in (("page", 7), ("ink", 6)))] * 2
