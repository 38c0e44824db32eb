r"""Chat formatting with Spark expressions only.

A conversation becomes one string.  Turns stand in the order of ``turn`` (null
first), ties by role and text.  Adjacent turns of one role share a block; a cut
mark separates them, so every source turn can be read back.

    <turn>ROLE
    TEXT<cut/>TEXT</turn>

Inside a role or a text a backslash is doubled and ``<`` becomes backslash-l; a
line break inside a role becomes backslash-n.  Escaped text therefore holds no
``<``, no mark can occur in it, and unescaping is exact.

Defined cases: a null text is the empty text, a null role the empty role; rows
with a null ``conv_id`` form one conversation with a null id; repeated rows are
turns of their own; an empty table gives an empty result; columns other than
the four named ones are ignored.

One conversation is one output row, so its turns meet in one place by nature of
the result; no other grouping takes place.  The places of the loss spans are sums
of lengths before them; these are taken over chunks of about the root of the
number of turns, so the work is the turns times that root, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BREAK, CUT, CLOSE = "<turn>", "\n", "<cut/>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    # Escaped text holds no "<": it stands in for an escaped backslash while
    # the backslashes that are left, each the start of an escape, trade places.
    swapped = F.translate(F.replace(c, F.lit("\\\\"), F.lit("<")), "<\\", "\\<")
    return F.replace(F.replace(swapped, F.lit("<n"), F.lit("\n")), F.lit("<l"), F.lit("<"))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans.

    ``loss_spans`` lists (start, length) in code points, from 0, of each escaped
    text of ``trained_role`` in ``formatted``.
    """
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )
    n, at = F.size("t"), lambda a, i: F.get(F.col(a), i)
    # A block is a run of turns of one role: adjacent turns are merged into it.
    split = sorted_turns.select(
        "conv_id",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), escape(x["text"]).alias("body"))).alias("t"),
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at("t", i)["role"] != at("t", i - 1)["role"])).alias("first"),
        F.ceil(F.sqrt(n)).cast("int").alias("chunk"),
    )
    head = lambda role: F.concat(F.lit(OPEN), escape_role(role), F.lit(BREAK))
    merged = split.select(
        "*",
        F.transform(
            "first",
            lambda i, k: F.concat(
                head(at("t", i)["role"]),
                F.array_join(F.transform(F.slice("t", i + 1, F.coalesce(at("first", k + 1), n) - i), lambda x: x["body"]), CUT),
                F.lit(CLOSE),
            ),
        ).alias("blocks"),
        # What stands before each text: the head of its block, after the end of the block before, or a cut.
        F.transform(
            "t",
            lambda x, i: F.when(i == 0, F.length(head(x["role"])))
            .when(at("t", i - 1)["role"] == x["role"], len(CUT))
            .otherwise(len(CLOSE) + F.length(head(x["role"]))),
        ).alias("lead"),
    )
    total = lambda a, start, length: F.aggregate(F.slice(a, start, length), F.lit(0), lambda s, x: s + x)
    chunks = F.sequence(F.lit(0), F.ceil(n / F.col("chunk")).cast("int") - 1)
    sized = merged.withColumn("size", F.zip_with("t", "lead", lambda x, s: F.length(x["body"]) + s))
    summed = sized.withColumn("sums", F.transform(chunks, lambda c: total("size", c * F.col("chunk") + 1, F.col("chunk"))))
    based = summed.withColumn("base", F.transform(chunks, lambda c: total("sums", F.lit(1), c)))
    spans = F.transform(
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: at("t", i)["role"] == trained_role),
        lambda i: F.struct(
            (at("base", (i / F.col("chunk")).cast("int")) + total("size", i - i % F.col("chunk") + 1, i % F.col("chunk")) + at("lead", i)).alias("start"),
            F.length(at("t", i)["body"]).alias("length"),
        ),
    )
    return based.select("conv_id", F.array_join("blocks", "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds ``turns`` (role, text) and ``loss_texts``."""
    blocks = F.filter(F.split("formatted", "</turn>\\n"), lambda b: b.startswith(OPEN))
    body = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), BREAK, 1)).alias("role"),
            F.split(F.substr(b, F.locate(BREAK, b) + 1), CUT).alias("parts"),
        ),
    )
    turns = F.flatten(
        F.transform(body, lambda b: F.transform(b["parts"], lambda p: F.struct(b["role"].alias("role"), unescape(p).alias("text"))))
    )
    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])),
    )
    return formatted.withColumns({"turns": turns, "loss_texts": loss})
