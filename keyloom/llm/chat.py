"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Control strings inside
roles and texts are escaped reversibly: ``<`` followed by k backslashes and ``|`` becomes
``<`` with k + 1 backslashes and ``|``, so no ``<|`` of a text is left; in roles a
backslash and a line break are written as ``\\\\`` and ``\\n`` first.

Every assistant turn is an example of its own: all preceding turns are its context and
only its reply is trainable.  Examples are written in full, each with its context as text,
so the output grows with the squares of conversations' lengths.  A conversation's rows are
written in order, so that what one context repeats of the one before compresses well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # A backslash pair is one backslash, a backslash and n a line break; \x00 keeps pairs apart from what follows.
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """The formatted output, a row for each turn of (conv_id, turn, role, text).

    Columns: conv_id, position (0.. in its conversation), formatted (the turn with its
    marks), example (whether the turn is an example's target), context (all preceding turns
    with their marks, the example's prefix), loss_start and loss_end (the trainable span
    within ``formatted``, the end not included, code points); the last three are null unless
    an example.  Turns are ordered by turn, ties by role and text; nulls come first.  A null
    role or text is empty.  Rows with null conv_id form one conversation.  Other columns are
    ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END + "\n")).alias("formatted"), (F.col("role") == trained_role).alias("example"), F.length(head).alias("head_chars"), F.length(body).alias("body_chars"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.collect_list("formatted").over(order.rowsBetween(Window.unboundedPreceding, -1))
    span = lambda c: F.when(F.col("example"), c)
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "formatted", "example", span(F.array_join(before, "")).alias("context"), span(F.col("head_chars")).alias("loss_start"), span(F.col("head_chars") + F.col("body_chars")).alias("loss_end"))


def expand(formatted: DataFrame) -> DataFrame:
    """The written examples, a row for each assistant turn: conv_id, position, context (all preceding turns), target (the turn), with its trainable span."""
    return formatted.where("example").select("conv_id", "position", "context", F.col("formatted").alias("target"), "loss_start", "loss_end")


def loss_text(target: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(target, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def parse_turns(formatted: DataFrame) -> DataFrame:
    """Turns read back from the output: conv_id, position, role, text, loss_text (the span under the loss mask, unescaped) and context_chars (length of the example's context), both null outside examples, formatted_chars."""
    inner = F.substring("formatted", F.lit(len(START) + 1), F.length("formatted") - F.lit(len(START) + len(END) + 1))
    cut = F.instr(inner, "\n")
    role = F.substring(inner, F.lit(1), cut - 1)
    text = F.substring(inner, cut + 1, F.length(inner))
    return formatted.select("conv_id", "position", _unescape_role(role).alias("role"), unescape(text).alias("text"), F.when(F.col("example"), loss_text(F.col("formatted"))).alias("loss_text"), F.length("context").cast("long").alias("context_chars"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    work = Workspace(spark, "chat")
    written = work.write_zstd(format_turns(turns.select("conv_id", "turn", "role", "text").unionByName(extra)), "formatted")
    work.release()
    # The digests are of a conversation's turns in a row, so these have to come together; nothing else of the operator does.
    # A turn that is an example comes with what is trained on of it, which is a part of its text: side by side they are compressed.
    turn = F.struct("position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), F.col("loss_text").alias("loss"))
    together = parse_turns(written).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("formatted_chars").alias("formatted_chars"), F.count("loss_text").alias("n_examples"), F.coalesce(F.sum("context_chars"), F.lit(0)).alias("context_chars"))
    inorder = lambda c: F.array_join(F.transform("turns", lambda x: x[c]), "")
    together = together.select("conv_id", F.size("turns").cast("long").alias("n_turns"), inorder("said").alias("said"), inorder("loss").alias("loss"), "formatted_chars", "n_examples", "context_chars")
    return together.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")
