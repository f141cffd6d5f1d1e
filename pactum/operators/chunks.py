"""Pages to chunks: blank-line blocks, headings, sentence splits and grouping, all as folds over arrays of spans. A chunk is
always a verbatim slice of its page; offsets count characters from 0, ends excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions.joins import by_key
from pactum.functions.text import garbled_ratio, language, let, matches, once, text_search_config
from pactum.sources.tables import saved

MAX_CHARS, HEADING_CHARS, HEADING_UPPER = 1200, 120, 0.70
SPAN, ITEM = "array<struct<start:int,end:int>>", "array<struct<start:int,end:int,kind:string>>"


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _trimmed(text: Column, s: Column) -> Column:
    """A span without the white space at its ends."""

    def ends(cut):
        start = s["end"] - F.length(cut)
        return let(start, lambda at: _span(at, at + F.length(F.regexp_replace(cut, r"\s+\z", ""))))

    return let(F.regexp_replace(_cut(text, s["start"], s["end"]), r"^\s+", ""), ends)


def _filled(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["end"] > s["start"])


def blocks(text: Column) -> Column:
    """Trimmed spans of what blank lines part."""
    gaps = matches(text, r"\n[ \t]*\n+")
    starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["end"]))
    ends = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(F.length(text)))
    return _filled(F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda s: _trimmed(text, s)))


def bodies(text: Column) -> Column:
    """array<struct<start, end, body>>: blocks() with their text, taken as the blank lines part it: no block is looked up from
    the beginning of a long text."""
    gap = r"\n[ \t]*\n+"
    pieces, gaps = F.split(text, gap, -1), F.concat(F.regexp_extract_all(text, F.lit(gap), F.lit(0)), F.array(F.lit("")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(F.zip_with(pieces, gaps, lambda p, g: F.struct(F.length(p).alias("p"), F.length(g).alias("g"))), begin, lambda a, x: F.struct((a["at"] + x["p"] + x["g"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    left = lambda p: F.regexp_replace(p, r"^\s+", "")
    trimmed = F.zip_with(pieces, starts, lambda p, at: let(left(p), lambda own: F.struct((at + F.length(p) - F.length(own)).cast("int").alias("start"), F.regexp_replace(own, r"\s+\z", "").alias("body"))))
    return F.transform(F.filter(trimmed, lambda b: b["body"] != ""), lambda b: F.struct(b["start"].alias("start"), (b["start"] + F.length(b["body"])).cast("int").alias("end"), b["body"].alias("body")))


def without(spans: Column, tables: Column) -> Column:
    """Spans less the table spans that they overlap: what stands on either side remains."""

    def less(s, t):
        apart = (s["start"] >= t["end"]) | (t["start"] >= s["end"])
        return F.when(apart, F.array(_span(s["start"], s["end"]))).otherwise(_filled(F.array(_span(s["start"], t["start"]), _span(t["end"], s["end"]))))

    return F.aggregate(tables, spans.cast(SPAN), lambda acc, t: F.flatten(F.transform(acc, lambda s: less(s, t))))


def is_heading(body: Column) -> Column:
    """One short line that doesn't end like a sentence, whose letters are mostly capitals."""

    def holds(text):
        letters, capitals = F.length(F.regexp_replace(text, r"\P{L}", "")), F.length(F.regexp_replace(text, r"\P{Lu}", ""))
        return F.length(text).between(1, HEADING_CHARS) & ~F.contains(text, F.lit("\n")) & ~text.rlike("[.,;]$") & (letters > 0) & (capitals >= HEADING_UPPER * letters)

    return let(F.trim(F.regexp_replace(body, r"^\s+|\s+\z", "")), holds)


def split_long(text: Column, span: Column, most: int = MAX_CHARS) -> Column:
    """A span in pieces of at most `most` characters. Rule: sentences (ended by . ! ? ; and white space) are taken while the piece
    from its first to their last character fits; one that alone is too long is cut every `most` characters, and what is left of
    it goes on; each piece is trimmed."""
    # sentences follow each other without gaps, so their lengths are their places
    sentences = F.regexp_extract_all(_cut(text, span["start"], span["end"]), F.lit(r"(?s).+?(?:[.!?;]\s+|\z)"), F.lit(0))
    begin = F.struct(span["start"].alias("start"), span["start"].alias("packed"), F.array().cast(SPAN).alias("out"))

    def step(a, sentence):
        start, end = F.greatest(a["start"], a["packed"]), a["packed"] + F.length(sentence)
        closed = F.when(a["packed"] > a["start"], F.array(_span(a["start"], a["packed"]))).otherwise(F.array().cast(SPAN))
        cuts = lambda hard: F.when(hard > 0, F.transform(F.sequence(F.lit(0), F.greatest(hard - 1, F.lit(0))), lambda k: _span(start + k * most, start + (k + 1) * most))).otherwise(F.array().cast(SPAN))
        moved = lambda hard: F.struct((start + hard * most).alias("start"), end.alias("packed"), F.concat(a["out"], closed, cuts(hard)).alias("out"))
        hard = F.greatest(F.lit(0), F.ceil((end - start) / most).cast("int") - 1)
        return F.when(end - a["start"] <= most, F.struct(a["start"].alias("start"), end.alias("packed"), a["out"].alias("out"))).otherwise(let(hard, moved))

    last = lambda a: F.concat(a["out"], F.when(a["packed"] > a["start"], F.array(_span(a["start"], a["packed"]))).otherwise(F.array().cast(SPAN)))
    short = span["end"] - span["start"] <= most
    return F.when(short, F.array(_span(span["start"], span["end"]))).otherwise(_filled(F.transform(F.aggregate(sentences, begin, step, last), lambda s: _trimmed(text, s))))


def grouped(items: Column, most: int = MAX_CHARS) -> Column:
    """Items in page order -> chunks: a table stands alone, a heading opens a chunk, prose joins up to `most` characters."""
    none = F.lit(None).cast("struct<start:int,end:int,kind:string>")
    begin = F.struct(none.alias("now"), F.array().cast(ITEM).alias("out"))
    item = lambda s, e, k: F.struct(s.alias("start"), e.alias("end"), k.alias("kind"))

    def step(a, x):
        now, table = a["now"], x["kind"] == "table"
        flushed = F.when(now.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(now)))
        joins = now.isNotNull() & ~table & (x["kind"] != "heading") & (x["end"] - now["start"] <= most)
        kept = F.struct(item(now["start"], x["end"], F.lit("paragraph")).alias("now"), a["out"].alias("out"))
        fresh = F.struct(F.when(~table, item(x["start"], x["end"], x["kind"])).alias("now"), F.when(table, F.concat(flushed, F.array(item(x["start"], x["end"], x["kind"])))).otherwise(flushed).alias("out"))
        return F.when(joins, kept).otherwise(fresh)

    return F.aggregate(items, begin, step, lambda a: F.when(a["now"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["now"]))))


def chunk(pages: DataFrame, text_col: str = "text", most: int = MAX_CHARS, after: DataFrame | None = None) -> DataFrame:
    """pages(document_id, page_number, text[, tables array<struct<start,end>>]) -> chunks (document_id, page_number, ordinal,
    char_start, char_end, chunk_text, chunk_type, language, fts_config, section_title, hash).

    The pages are cut at once, into a work table; no document is any one task's. Ordinals run over a document, after those in after(document_id, ordinal) if given: text that came later, as from
    recognition of scans, is chunked the same way and numbered on. A null or blank page has no chunks. A page that stands
    twice under one number is numbered twice, in either order."""
    text = F.col("page_text")
    tables = F.coalesce(F.col("tables"), F.array().cast(SPAN)) if "tables" in pages.columns else F.array().cast(SPAN)
    own = pages.select("document_id", "page_number", F.col(text_col).alias("page_text"), tables.alias("tables")).where(text.isNotNull())
    body = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), _cut(text, b["start"], b["end"]).alias("body"))
    cut = F.when(F.size("tables") == 0, F.col("whole")).otherwise(F.transform(without(F.transform("whole", lambda b: _span(b["start"], b["end"])), F.col("tables")), body))
    parts = once(once(once(own, "whole", bodies(text)), "blocks", cut), "heads", F.transform("blocks", lambda b: is_heading(b["body"])))
    item = lambda s, kind, at=0: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), kind.alias("kind"))
    pieces = lambda b: F.transform(split_long(b["body"], F.struct(F.lit(0).alias("start"), F.length(b["body"]).alias("end")), most), lambda s: item(s, F.lit("paragraph"), b["start"]))
    prose = F.flatten(F.transform(F.arrays_zip(F.col("blocks").alias("b"), F.col("heads").alias("h")), lambda z: F.when(z["h"], F.array(item(z["b"], F.lit("heading")))).otherwise(pieces(z["b"]))))
    items = F.array_sort(F.concat(F.transform("tables", lambda t: item(t, F.lit("table"))).cast(ITEM), prose.cast(ITEM)))
    inked = lambda c: (c["kind"] != "table") | (F.trim(F.regexp_replace(_cut(text, c["start"], c["end"]), r"\s+", " ")) != "")
    whole = once(once(parts, "items", items), "chunks", F.filter(grouped(F.col("items"), most), inked))
    # titles and ordinals are worked out by page, before pages become chunks: one shuffle, of pages by their document
    whole = once(whole, "headings", F.filter("items", lambda i: i["kind"] == "heading"))
    lead = lambda c: F.try_element_at(F.filter("headings", lambda i: i["start"] == c["start"]), F.lit(1))
    own_titles = F.when(F.size("headings") > 0, F.transform("chunks", lambda c: F.substring(F.trim(_cut(text, lead(c)["start"], lead(c)["end"])), 1, 512))).otherwise(F.array().cast("array<string>"))
    whole = once(whole, "titles", own_titles)
    # written once, with a number for each row: ordinals are counted without the text, and come back to it by that number
    pages_ = saved(whole.select("document_id", "page_number", "page_text", "chunks", "titles", F.size("chunks").alias("n"), F.monotonically_increasing_id().alias("row")))
    whole = by_key(pages_).join(first_ordinals(pages_, after), "row")
    # a page's text ends here: its chunks go on without it
    made = F.arrays_zip(F.col("chunks").alias("c"), F.transform("chunks", lambda c: _cut(text, c["start"], c["end"])).alias("chunk_text"), F.transform("chunks", lambda c, k: F.try_element_at(F.filter(F.slice("titles", 1, k + 1), lambda t: t.isNotNull()), F.lit(-1))).alias("title"))
    found = whole.select("document_id", "page_number", "base", F.posexplode(made).alias("place", "made")).select("document_id", "page_number", "base", "place", "made.*")
    out = once(found, "language", language(F.col("chunk_text")))
    key = F.sha2(F.concat_ws("|", F.col("page_number").cast("string"), F.col("c.start").cast("string"), F.col("c.end").cast("string"), F.col("chunk_text")), 256)
    return out.select("document_id", "page_number", (F.col("base") + F.col("place")).cast("int").alias("ordinal"), F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"), "chunk_text", F.col("c.kind").alias("chunk_type"), "language", text_search_config(F.col("language")).alias("fts_config"), F.col("title").alias("section_title"), key.alias("hash"))


#: Pages of a document that are numbered together.
PAGE_RANGE = 1000


def first_ordinals(pages: DataFrame, after: DataFrame | None = None, width: int = PAGE_RANGE) -> DataFrame:
    """pages(row, document_id, page_number, n chunks) -> (row, base): the ordinal of the page's first chunk, counted over ranges of
    pages first, then within each, after the ordinals in after(document_id, ordinal)."""
    rows = pages.select("row", "document_id", "page_number", "n", F.floor(F.col("page_number") / width).alias("_range"))
    ranges = rows.groupBy("document_id", "_range").agg(F.sum("n").alias("n"))
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("document_id").alias("_document"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before("_range").partitionBy("document_id")), F.lit(0)).alias("start"))
    if after is not None:
        starts = starts.join(after.groupBy("document_id").agg((F.max("ordinal") + 1).alias("first")), F.col("_document") == F.col("document_id"), "left").withColumn("start", F.col("start") + F.coalesce("first", F.lit(0))).drop("document_id", "first")
    own = rows.withColumn("own", F.coalesce(F.sum("n").over(before("page_number", "row").partitionBy("document_id", "_range")), F.lit(0)))
    return own.join(starts, F.col("document_id").eqNullSafe(F.col("_document")) & F.col("_range").eqNullSafe(F.col("_r"))).select("row", (F.col("own") + F.col("start")).alias("base"))


def span_violations(chunks: DataFrame, pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Chunks that are not the slice of their page that they claim to be; must be empty."""
    own = by_key(pages.select("document_id", "page_number", F.col(text_col).alias("page_text")))
    return chunks.join(own, ["document_id", "page_number"], "left").where(~_cut(F.col("page_text"), F.col("char_start"), F.col("char_end")).eqNullSafe(F.col("chunk_text"))).drop("page_text")


# The checks of a page, each with what it costs.
PENALTIES = [("no_text_layer", 1.00), ("low_char_count", 0.40), ("high_image_area", 0.30), ("table_extraction_failed", 0.15), ("garbled_unicode", 0.30)]


def assess_pages(pages: DataFrame) -> DataFrame:
    """Adds char_count, garbled_ratio, reasons, confidence and needs_vlm to pages."""
    size, garbled = F.length(F.coalesce("text", F.lit(""))), garbled_ratio(F.coalesce("text", F.lit("")))
    failed = [~F.col("has_text_layer"), F.col("char_count") < 120, F.col("image_area_ratio") > 0.70, F.col("has_table_hint") & F.col("table_extraction_failed"), F.col("garbled_ratio") > 0.25]
    reasons = F.array_compact(F.array(*[F.when(bad, name) for bad, (name, _) in zip(failed, PENALTIES, strict=True)]))
    cost = sum((F.when(bad, F.lit(x)).otherwise(0.0) for bad, (_, x) in zip(failed, PENALTIES, strict=True)), F.lit(0.0))
    out = pages.withColumns({"char_count": size, "garbled_ratio": garbled}).withColumns({"reasons": reasons, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cost))})
    return out.withColumn("needs_vlm", F.size("reasons") > 0)


def document_quality(pages: DataFrame, cap: int = 40) -> DataFrame:
    """Of assessed pages: mean confidence of each document, its pages that need vision, and whether they are over the cap,
    at which the whole document fails."""
    return pages.groupBy("document_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("parse_confidence"), F.count_if("needs_vlm").alias("vision_pages")).withColumn("over_cap", F.col("vision_pages") > cap)


def document_language(chunks: DataFrame) -> DataFrame:
    """One known language: that one; several: mixed; none: unknown."""
    known = F.collect_set(F.when(F.col("language") != "unknown", F.col("language")))
    return chunks.groupBy("document_id").agg(known.alias("l")).select("document_id", F.when(F.size("l") == 0, "unknown").when(F.size("l") > 1, "mixed").otherwise(F.col("l")[0]).alias("language"))


def pages_needing_vision(pages: DataFrame, threshold: float = 0.6) -> DataFrame:
    return pages.where((F.col("confidence") < threshold) & ~F.col("vlm_used")).orderBy("document_id", "page_number")


def awaiting_rechunk(pages: DataFrame) -> DataFrame:
    """Documents with recognised text."""
    return pages.where("ocr_text is not null").select("document_id").distinct()
