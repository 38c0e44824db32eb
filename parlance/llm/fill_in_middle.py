"""Fill-in-middle: prefix, middle and suffix of a text in an order a model can learn to fill.

A text is cut at two random ranks of its units (code points, or whatever a pattern
matches from left to right).  No array of units is made: a first pass of the
matcher counts them, a second advances the matcher's iterator to the lower rank
and then to the higher one.  Besides the text a task holds two numbers.

The ranks and the form come from a hash of the seed and doc_id, so a run again, or
on other machines, gives the same result.  A text moves to a Python worker once,
for its two places; Spark expressions put the parts together.

Defined cases: a null text counts as empty; an empty text, and one that holds a
mark, stays plain; a text without any unit is all suffix; a null doc_id hashes as
no digits; rows that repeat a doc_id are cut alike; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bounded_batches, text_or_empty

CODE_POINT = r"(?s:.)"
#: Marks of the parts.  None overlaps itself or another, so the first one found is the one put there.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"


def places(pattern: re.Pattern, text: str, a: int, b: int) -> tuple[int, int, int]:
    """(units, end of the unit of the lower rank, of the higher) for two hash values."""
    counter = count()
    deque(zip(pattern.finditer(text), counter), maxlen=0)
    n = next(counter)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    matches = pattern.finditer(text)
    first = last_end(matches, low, 0)
    return n, first, last_end(matches, high - low, first)


def last_end(matches, steps: int, before: int) -> int:
    """Where the match ends that is ``steps`` further on; ``before`` if there are none to take."""
    reached = deque(islice(matches, steps), maxlen=1)
    return reached[0].end() if reached else before


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output.

    ``n``: units of the text; ``form``: plain, or the order of the parts (psm: prefix,
    suffix, middle; spm: suffix first); characters are code points, null if plain.
    """
    pattern = re.compile(unit)

    def cut(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        found = [places(pattern, t.as_py(), x, y) for t, x, y in zip(text, a.to_pylist(), b.to_pylist(), strict=True)]
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "low", "high"])

    bounded_batches(docs.sparkSession)
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    rows = docs.select("doc_id", text_or_empty().alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.withColumn("at", F.arrow_udf(cut, "n long, low long, high long")("text", "h1", "h2"))
    plain = (F.col("text") == "") | F.col("text").rlike(ANY_MARK) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "at.*", form.alias("form"))
    part = lambda start, end: F.substr("text", (start + 1).cast("int"), (end - start).cast("int"))
    prefix, middle = part(F.lit(0), F.col("low")), part(F.col("low"), F.col("high"))
    suffix = part(F.col("high"), F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(
        F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    ).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut_up = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(cut_up, F.col("low")).alias("prefix_chars"),
        F.when(cut_up, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    parts = F.split(output, ANY_MARK, -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
