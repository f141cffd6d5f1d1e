"""Incremental intake and monitors as Structured Streaming jobs. Each takes a streaming DataFrame and a checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pactum.operators.chunks import assess_pages, chunk
from pactum.sources.stored import read_stored, upsert_stored
from pactum.sources.tables import saved, scratch, spread

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


ORDINALS = "document_id string, first bigint, next bigint, batch bigint"


def drain_batch(batch: DataFrame, batch_id: int, out: str, index: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A batch of pages -> quality, chunks and, if given, an index, each in the batch's own folder, which a replay overwrites.

    Chunks are numbered on over batches. `{out}/ordinals` keeps for each document where the numbers of its last batch began and
    where those of the next begin, in buckets of which only the batch's are read and rewritten. A batch that is run again finds
    its own number there and begins where it began, so it gives the same chunks and leaves the same state."""
    spark, batch = batch.sparkSession, spread(batch)
    with scratch(spark):
        assess_pages(batch).write.mode("overwrite").parquet(f"{out}/pages/batch={batch_id}")
        own = batch.withColumn("document_id", F.col("document_id").cast("string"))
        state = read_stored(spark, f"{out}/ordinals", ORDINALS).join(own.select("document_id").distinct(), "document_id", "left_semi")
        begin = F.when(F.col("batch") == batch_id, F.col("first")).otherwise(F.col("next"))
        known = saved(state.select("document_id", begin.alias("begin")))
        place = f"{out}/chunks/batch={batch_id}"
        chunk(own, after=known.select("document_id", (F.col("begin") - 1).alias("ordinal"))).write.mode("overwrite").parquet(place)
        chunks = spark.read.parquet(place)
        moved = chunks.groupBy("document_id").agg(F.min("ordinal").cast("bigint").alias("first"), (F.max("ordinal") + 1).cast("bigint").alias("next")).withColumn("batch", F.lit(batch_id).cast("bigint"))
        upsert_stored(f"{out}/ordinals", moved.where("document_id is not null"), ["document_id"])
        if index is not None:
            index(chunks).write.mode("overwrite").parquet(f"{out}/index/batch={batch_id}")


def drain(pages: DataFrame, out: str, checkpoint: str, index: Callable[[DataFrame], DataFrame] | None = None):
    """Queued pages -> drain_batch(), batch by batch until the queue is empty. The checkpoint is the claim. A document whose pages
    come in several batches, in the order of pages, has the ordinals that one batch would have given it."""
    work = lambda batch, batch_id: drain_batch(batch, batch_id, out, index)
    return pages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_uploads(uploads: DataFrame, within: str = "1 day") -> DataFrame:
    """Uploads (content, arrived_at) without those whose bytes came before, as far back as the watermark."""
    return uploads.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["sha256"])


class _Streak(StatefulProcessor):
    """Failures of a key since its last success. Events wait in a list until the watermark has passed them, since until then
    an earlier one may come; timers wake the key, and events are then applied in the order of their times."""

    def __init__(self, window: int, keep: int):
        self.window, self.keep = window, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "at array<bigint>")
        self.waiting = handle.getListState("waiting", "at bigint, event_id bigint, succeeded boolean")

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), int(r.event_id), bool(r.succeeded)) for part in rows for r in part.itertuples()]
        self.waiting.appendList(new)
        timers, first = list(self.handle.listTimers()), min(x[0] for x in new)
        if not timers or first // 1000 < min(timers):
            self._wake(first)
        yield pd.DataFrame([], columns=["key", "at", "failures"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        at = list(self.times.get()[0]) if self.times.exists() else []
        rows = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in rows if x[0] <= mark], [x for x in rows if x[0] > mark]
        out = []
        for now, _, succeeded in ready:
            at = [] if succeeded else [t for t in at if t >= now - self.window] + [now]
            if not succeeded:
                out.append((key[0], now, len(at)))
        if at and not rest and at[-1] + self.keep <= mark:
            at = []
        if at:
            self.times.update((at,))
        else:
            self.times.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
            if at:
                self._wake(at[-1] + self.keep)
        yield pd.DataFrame(out, columns=["key", "at", "failures"])

    def close(self) -> None:
        pass


def failure_monitor(events: DataFrame, key: str, window_s: float = 900, keep_s: float = 86_400, late: str = "1 hour") -> DataFrame:
    """events(key, ts, event_id, succeeded) -> (key, ts, failures) for each failure: those since the last success within the
    window, in the order of event times, whatever order they came in within the watermark: a row comes out once the watermark
    has passed it. Events later than the watermark are dropped; a key without failures for keep_s is forgotten. Rows of
    a null key only carry their time to the watermark: one of them, later than all others by the delay, ends a stream."""
    rows = events.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), "event_id", "succeeded")
    found = rows.groupBy("key").transformWithStateInPandas(_Streak(int(window_s * 1e6), int(keep_s * 1e6)), "key string, at bigint, failures int", "Append", "EventTime")
    return found.where("key is not null").select("key", F.timestamp_micros("at").alias("ts"), "failures")


class _Spend(StatefulProcessor):
    """Admitted spend of a document, in millionths."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spent, out = (self.spent.get()[0] if self.spent.exists() else 0), []
        for row in pd.concat(list(rows)).sort_values(["ts", "request_id"]).itertuples():
            fits = spent + row.micros <= self.cap
            spent += row.micros if fits else 0
            out.append((row.request_id, key[0], bool(fits), spent))
        self.spent.update((spent,))
        yield pd.DataFrame(out, columns=["request_id", "document_id", "admitted", "spent_micros"])

    def close(self) -> None:
        pass


def spend_admission(requests: DataFrame, cap_usd: str = "5.00") -> DataFrame:
    """requests(request_id, document_id, ts, estimate decimal) -> (request_id, document_id, admitted, spent_micros): admitted
    if the document's admitted spend so far plus the estimate is within the cap; a rejected request adds nothing."""
    from decimal import Decimal

    rows = requests.select("request_id", F.col("document_id").cast("string").alias("document_id"), "ts", F.round(F.col("estimate") * 1_000_000).cast("long").alias("micros"))
    return rows.groupBy("document_id").transformWithStateInPandas(_Spend(int(Decimal(cap_usd) * 1_000_000)), "request_id long, document_id string, admitted boolean, spent_micros long", "Append", "None")
