"""Chat formatting with relational expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one block by array
aggregation (where a block begins, the turns up to the next beginning are sliced off); blocks are concatenated. No Python runs.

The template, of which every mark stands where no backslash can precede it:

    <turn>role          a block: its role,
    first text          the texts of its turns,
    <next>              parted by a line of their own
    second text
    </turn>             and its end.

Inside roles and texts a backslash is put before each control string (<turn>, </turn>, <next>), in front of those that
may stand there already, so that taking one away gives the text back, whatever it held. Roles are kept to one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTROL = "(?=(?:/?turn|next)>)"
OPEN, NEXT, CLOSE = "<turn>", "\n<next>\n", "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"<{_CONTROL}", r"\\<")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\<{_CONTROL}", "<")


def _role_line(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_of(line: Column) -> Column:
    parts = F.split(unescape(line), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, formatted, pieces array<struct<text, loss>>): the pieces in order are
    `formatted`; loss is set for the texts of the roles to learn, not for marks, roles or separators.

    A null text or role is empty. Rows are taken by turn, null first, those of one turn by role, then text; equal rows are
    turns each. A null conv_id is a conversation like others. Other columns are not read. An empty table gives an empty one."""
    said = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    t = F.col("t")
    begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, F.greatest(i - 1, F.lit(0)))["role"] != F.get(t, i)["role"]))
    bounds = F.col("bounds")
    blocks = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda a, k: F.struct(F.get(t, a)["role"].alias("role"), F.transform(F.slice(t, a + 1, F.get(bounds, k + 1) - a), lambda x: x["text"]).alias("texts")))
    merged = sorted_.withColumn("bounds", F.concat(begins, F.array(F.size(t)))).select("conv_id", F.explode(F.array(blocks)).alias("blocks"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    own = lambda b: F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, "").otherwise(NEXT), F.lit(False)), piece(escape(x), b["role"].isin(*learn))))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(F.array(piece(F.concat(F.lit(OPEN), _role_line(b["role"]), F.lit("\n")), F.lit(False))), F.flatten(own(b)), F.array(piece(F.lit(CLOSE), F.lit(False))))))
    return merged.select("conv_id", F.explode(F.array(pieces)).alias("pieces")).select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, as they were."""
    blocks = F.split(formatted, CLOSE, -1)
    cut = lambda b: F.struct(_role_of(F.substring(F.substring_index(b, "\n", 1), len(OPEN) + 1, F.length(b))).alias("role"), F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), NEXT, -1).alias("texts"))
    return F.flatten(F.transform(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), cut), lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))


def learned_text(pieces: Column) -> Column:
    """All text under the loss mask, as it was, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


#: A conversation whose texts hold what templates mark turns with.
TRAP = "\\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(trap)
    out = format_chats(turns).select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), F.explode(F.array(read_turns(F.col("formatted")))).alias("read"), learned_text(F.col("pieces")).alias("learned"))
    listed = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
