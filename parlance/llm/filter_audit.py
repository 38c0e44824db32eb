"""What each of a chain of filters removes, in every order they could have.

Each document gets a mask with one bit a filter, set where it fails.  Documents of
one part (a language, say) and one mask behave alike in every order, so a histogram
of masks, at most 2^filters cells a part, holds all that the orders can tell:
permutations are enumerated from the cells, not from documents.

The filters are Spark expressions over the text.  The last one, copies, needs the
table: grouping by the text gives the smallest doc_id that has it.  The SHA-256 of a
text stands for it, so 32 bytes a document are grouped, not texts; a group of any
size is a running minimum.  Whether a row is that first one is asked by digest and
doc_id together, so the rows of a large group do not meet in one task.

Defined cases: a null text is empty; a null part is the empty string; null doc_ids
come after all others, as one first row together; rows that repeat doc_id and text
are first or not together; a document with several labels has those any of them
gives, one without labels none; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import text_or_empty

#: White space that parts words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: The letter of the filter that fails later copies of a text.
COPIES = "E"
#: Orders are enumerated; more filters than this have too many.
MOST_FILTERS = 7


def quality_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, few distinct words, capitals, marks."""
    words = F.array_remove(F.split(text, SPACE + "+", -1), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column], copies: str | None = COPIES) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each failure mask, all and by label.

    ``filters``: failure conditions over ``docs``, whose first is bit 0; ``copies``
    adds one for the later copies of a text.  ``labels``: (doc_id, quality, toxic).
    """
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    if copies is not None:
        first = docs.select("doc_id", digest.alias("d")).groupBy("d").agg(F.min("doc_id").alias("first"))
        rows = rows.join(first, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
        rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("d").isNull(), 1 << len(filters)).otherwise(0))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row a part, order of the filters and step, from the histogram of masks.

    A document of mask m counts as removed by a filter in those orders in which that
    filter stands before all others it fails: one of every ``popcount(m)``.
    """
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be put in every order")
    every, steps = " ".join("".join(p) for p in permutations(letters)), len(letters)
    bit = lambda at: f"shiftleft(1, instr('{letters}', substring(filter_order, {at}, 1)) - 1)"
    rows = cells.withColumn("filter_order", F.explode(F.split(F.lit(every), " ")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    rows = rows.withColumns({"bit": F.expr(bit("step")), "before": F.expr(f"aggregate(filter(sequence(1, {steps}), j -> j < step), 0, (a, j) -> a | {bit('j')})")})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    share = (F.lit(factorial(steps)) / F.bit_count("mask")).cast("long")
    count = lambda name, where, what="n": F.sum(F.when(where, F.col(what) if isinstance(what, str) else what).otherwise(0)).alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        count("kept", ~fails & ~gone), count("removed", fails & ~gone), count("redundant", fails & gone),
        count("unique_fails", F.col("mask") == F.col("bit")), count("good_lost", fails & ~gone, "good"),
        count("toxic_lost", fails & ~gone, "toxic"), count("shapley", fails, F.col("n") * share),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column] | None = None) -> DataFrame:
    """The interaction report of ``filters`` (the four of quality by default) and of copies."""
    filters = quality_filters(text_or_empty()) if filters is None else filters
    return orders(cells(docs, labels, part, filters), "".join(filters) + COPIES)
