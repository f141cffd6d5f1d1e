"""Holdings, instruments, clauses and covenants: lookups, joins, exposure."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions.dates import next_on_or_after
from pactum.functions.ratings import normalise, rank
from pactum.sources.tables import saved


def enrich(instruments: DataFrame) -> DataFrame:
    """Adds current_notch and current_rating_rank, derived from the rating each time so that they cannot drift."""
    return instruments.withColumns({"current_notch": normalise(F.col("current_rating")), "current_rating_rank": rank(F.col("current_rating"))})


def rating_rejects(instruments: DataFrame) -> DataFrame:
    """Instruments whose rating is given but not on the scale."""
    return instruments.where(F.col("current_rating").isNotNull() & rank(F.col("current_rating")).isNull())


def where_equal(df: DataFrame, order: list[str], limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """Rows whose columns equal the given values (None values are not filters), ordered, paged."""
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value)) if value is not None else df
    df = df.orderBy(*order).offset(offset)
    return df.limit(limit) if limit is not None else df


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids; each once however often it is asked for, absent ids absent."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def rated_at_or_below(instruments: DataFrame, notch: str) -> DataFrame:
    return instruments.where(F.col("current_rating_rank") >= rank(F.lit(notch)))


def rated_below(instruments: DataFrame, notch: str) -> DataFrame:
    """Strictly worse; unrated and unrankable ones are left out, not counted as below."""
    return instruments.where(F.col("current_rating_rank").isNotNull() & (F.col("current_rating_rank") > rank(F.lit(notch))))


def triggered_at(triggers: DataFrame, notch: str) -> DataFrame:
    """Triggers that fire at a notch or better ones."""
    return triggers.where(F.col("trigger_rank") <= rank(F.lit(notch)))


def find_instruments(instruments: DataFrame, instrument_id: str | None = None, isin: str | None = None, name: str | None = None) -> DataFrame:
    for value, test in ((instrument_id, lambda v: F.col("instrument_id") == v), (isin, lambda v: F.col("isin") == v), (name, lambda v: F.contains(F.lower("instrument_name"), F.lower(F.lit(v))))):
        instruments = instruments.where(test(value)) if value is not None else instruments
    return instruments


def below_threshold(covenants: DataFrame, covenant_type: str, amount: str, currency: str, limit: int = 100) -> DataFrame:
    rows = covenants.where((F.col("covenant_type") == covenant_type) & (F.col("threshold_currency") == currency) & (F.col("threshold_amount") < F.lit(amount).cast("decimal(20,4)")))
    return rows.orderBy("threshold_amount", "covenant_id").limit(limit)


def calls_between(calls: DataFrame, start: str, end: str) -> DataFrame:
    return calls.where(F.col("call_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def next_calls(calls: DataFrame, as_of: str) -> DataFrame:
    """Each instrument's next call date on or after as_of, null after the last."""
    return calls.groupBy("instrument_id").agg(next_on_or_after(F.col("call_date"), F.lit(as_of).cast("date")).alias("next_call"))


def with_clauses(covenants: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covenants with their clause, and those whose clause is missing, which are reported, not shown."""
    return covenants.join(clauses, "clause_id"), covenants.join(clauses, "clause_id", "left_anti")


def covenants_of(covenants: DataFrame, clauses: DataFrame, instruments: DataFrame | None = None, documents: DataFrame | None = None, covenant_type: str | None = None) -> DataFrame:
    rows = covenants.join(clauses.select("clause_id", "document_id", "page_number"), "clause_id")
    rows = rows.join(instruments.select("instrument_id").distinct(), "instrument_id", "left_semi") if instruments is not None else rows
    rows = rows.join(documents.select("document_id").distinct(), "document_id", "left_semi") if documents is not None else rows
    return rows.where(F.col("covenant_type") == covenant_type) if covenant_type else rows


def without_covenants(documents: DataFrame, clauses: DataFrame, covenants: DataFrame) -> DataFrame:
    """Documents from which nothing was extracted."""
    return documents.join(clauses.join(covenants.select("clause_id"), "clause_id").select("document_id").distinct(), "document_id", "left_anti")


def triggers_with_clauses(triggers: DataFrame, clauses: DataFrame) -> DataFrame:
    """Triggers with the clause they cite, if any; of equal ones (agency, rating, direction) of an instrument the cited one,
    then the tightest."""
    rows = triggers.join(clauses.select(F.col("clause_id").alias("source_clause_id"), "source_quote", "page_number"), "source_clause_id", "left")
    best = Window.partitionBy("instrument_id", "rating_agency", "trigger_rating", "trigger_direction").orderBy(F.col("source_clause_id").isNull(), "trigger_rank", "source_clause_id")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def as_of_latest(holdings: DataFrame) -> DataFrame:
    """Holdings of each portfolio at its latest date."""
    latest = holdings.groupBy("portfolio_id").agg(F.max("as_of_date").alias("as_of_date"))
    return holdings.join(latest, ["portfolio_id", "as_of_date"], "left_semi")


def holdings_view(holdings: DataFrame, instruments: DataFrame, portfolio_id: str | None = None, as_of: str | None = None, rating_below: str | None = None, rated_at_most: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(holdings with their instruments, strictly below a notch or at most at one if asked, holdings whose instrument is
    missing); as_of None means each portfolio's latest date."""
    rows = holdings.where(F.col("portfolio_id") == portfolio_id) if portfolio_id is not None else holdings
    rows = rows.where(F.col("as_of_date") == F.lit(as_of).cast("date")) if as_of is not None else as_of_latest(rows)
    joined = rows.join(instruments, "instrument_id")
    joined = rated_below(joined, rating_below) if rating_below else joined
    return (rated_at_or_below(joined, rated_at_most) if rated_at_most else joined), rows.join(instruments, "instrument_id", "left_anti")


def exposure(rows: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Positions and summed market value of each portfolio: 0 where nothing is priced in `exposure`, null in `total`."""
    return rows.groupBy(key).agg(F.count("*").alias("positions"), F.coalesce(F.sum("market_value"), F.lit(0)).cast("decimal(30,4)").alias("exposure"), F.sum("market_value").cast("decimal(30,4)").alias("total"))


def instrument_detail(instruments: DataFrame, calls: DataFrame, triggers: DataFrame, covenants: DataFrame) -> DataFrame:
    """One row an instrument with its calls, triggers (tightest first) and covenants nested."""
    def nested(df: DataFrame, name: str, order: Column, *fields: str) -> DataFrame:
        return df.groupBy("instrument_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))

    out = instruments
    for df, name, order, fields in ((calls, "calls", F.col("call_date"), ("call_date", "call_price", "call_type")), (triggers, "triggers", F.col("trigger_rank"), ("trigger_rating", "trigger_rank", "rating_agency")), (covenants, "covenants", F.col("covenant_type"), ("covenant_id", "covenant_type"))):
        out = out.join(nested(df, name, order, *fields), "instrument_id", "left")
    return out


def provenance(clauses: DataFrame, chunks: DataFrame, covenants: DataFrame) -> DataFrame:
    """Clauses with their chunk, the quote's place in it (from 0, null if absent) and their covenants."""
    own = chunks.select(F.col("hash").alias("source_chunk_id"), "chunk_text")
    nested = covenants.groupBy("clause_id").agg(F.sort_array(F.collect_list("covenant_type")).alias("covenants"))
    at = F.instr("chunk_text", F.col("source_quote"))
    return clauses.join(own, "source_chunk_id", "left").join(nested, "clause_id", "left").withColumn("quote_start", F.when(at > 0, at - 1)).withColumn("quote_end", F.col("quote_start") + F.length("source_quote"))


def cite(clauses: DataFrame, chunks: DataFrame, clause_ids: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Quotes of clauses and chunks by id, at most 600 characters each."""
    a = by_ids(clauses, clause_ids, "clause_id").select(F.lit("clause").alias("kind"), F.col("clause_id").alias("id"), F.substring("source_quote", 1, 600).alias("quote"))
    b = chunks.join(chunk_ids.select(F.col("chunk_id").alias("hash")).distinct(), "hash", "left_semi").select(F.lit("chunk"), "hash", F.substring("chunk_text", 1, 600))
    return a.union(b)


#: Bytes of names that are sent to all executors at once, with what the automaton needs for each name besides its letters.
NAME_BYTES, NAME_EXTRA = 4 << 20, 64
_automata: dict[int, ahocorasick.Automaton] = {}


def _collapsed(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def _automaton(number: int, names: list[tuple]) -> ahocorasick.Automaton:
    """The automaton of a part of the names, built once by each worker; a name has its rows and one of its instruments."""
    if number not in _automata:
        _automata.clear()
        known: dict[str, tuple] = {}
        for name, n, one in names:
            name = _collapsed(name)
            n, one = (n + known[name][0], min(one, known[name][1])) if name in known else (n, one)
            known[name] = (n, one)
        made = ahocorasick.Automaton()
        for name, value in known.items():
            if name:
                made.add_word(name, (name, *value))
        made.make_automaton()
        _automata[number] = made
    return _automata[number]


def _names_in(names) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(names.id, names.value)
        for batch in batches:
            rows = []
            for document, pieces in zip(batch.column("document_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                met = {value for _, value in made.iter(_collapsed(" ".join(p["chunk_text"] for p in pieces)))} if len(made) else set()
                if met:
                    rows.append((document, sum(v[1] for v in met), min(v[2] for v in met)))
            types = (batch.schema.field("document_id").type, pa.int64(), names.kind)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["document_id", "n", "instrument_id"])

    return find


class _Names:
    """A part of the names as all executors have it."""

    def __init__(self, number: int, sent, kind: pa.DataType):
        self.id, self._sent, self.kind = number, sent, kind

    @property
    def value(self) -> list[tuple]:
        return self._sent.value


def link_issuers(chunks: DataFrame, instruments: DataFrame, first: int = 20, name_bytes: int = NAME_BYTES) -> DataFrame:
    """(document_id, instrument_id): the one instrument whose issuer's name, white space and case apart, stands anywhere in a
    document's first chunks, inside words too; none if several do. Blank names and null texts match nothing.

    Distinct names are dealt into parts of at most name_bytes, measured before any is sent; each part is an automaton that
    every executor builds, and a document's text runs through it once, so time does not depend on the number of names."""
    spark = chunks.sparkSession
    heads = chunks.where((F.col("ordinal") < first) & F.col("chunk_text").isNotNull()).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_text"))).alias("pieces"))
    names = saved(instruments.where("trim(issuer_name) <> ''").groupBy("issuer_name").agg(F.count("*").alias("n"), F.min("instrument_id").alias("one")))
    size, parts = F.octet_length("issuer_name") + NAME_EXTRA, 1
    part = lambda: F.pmod(F.xxhash64("issuer_name"), F.lit(parts))
    total = names.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-total * 5 // (name_bytes * 4)))
    while parts > 1 and (names.groupBy(part()).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0) > max(name_bytes, 1 << 12):
        parts *= 2
    heads = saved(heads) if parts > 1 else heads
    kind = pa.string() if instruments.schema["instrument_id"].dataType.simpleString() == "string" else pa.int64()
    ddl = f"document_id {chunks.schema['document_id'].dataType.simpleString()}, n bigint, instrument_id {'string' if kind == pa.string() else 'bigint'}"
    found = None
    for k in range(parts):
        own = [tuple(r) for r in names.where(part() == k).collect()]
        met = heads.mapInArrow(_names_in(_Names(next(_numbers), spark.sparkContext.broadcast(own), kind)), ddl)
        found = met if found is None else found.unionByName(met)
    one = found.groupBy("document_id").agg(F.sum("n").alias("n"), F.min("instrument_id").alias("instrument_id")).where("n = 1").drop("n")
    return one.withColumn("instrument_id", F.col("instrument_id").cast(instruments.schema["instrument_id"].dataType))


_numbers = itertools.count()


def page_of(rows: DataFrame, order: list, page: int, size: int = 50) -> DataFrame:
    """One page of sorted rows, the number clamped to those there are; order ends with a unique key. The rows are worked out
    once; only those up to the page are kept while sorting, and only their number comes to the driver."""
    rows = saved(rows)
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(page, 1), last) - 1) * size).limit(size)
