"""Document fingerprints: one-permutation MinHash, in Spark expressions alone.

The hashes of a text's five-word shingles fall into ``BINS`` bins by their top
bits; each bin keeps its smallest.  An empty bin borrows the value of a filled
one by optimal densification: it follows a probe sequence of its own, the same
for every text, to the first filled bin.  After ``PROBES`` misses the filled bin
that comes first in the order of hash(bin, other) is taken, which ends the same
search at once.  A fingerprint is the low ``BITS`` bits of each bin, in hex.

Two random values agree in their low bits with probability 2**-BITS; likeness
takes that share out of the agreeing bins (and stays within 0 and 1).

Words are runs of characters other than white space; fewer than five words form
one shingle, no word the shingle of the empty word.

Defined cases: null text is empty and has the fingerprint of an empty text, so
two empty texts have likeness 1; equal texts have equal fingerprints; for
neighbours, rows with a null doc_id are left out (they have no place in the
order) and equal doc_ids follow each other by text; one row is its own next
document; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parlance.llm.common import shuffle_width, text_or_empty

SHINGLE, BINS, BITS, PROBES = 5, 128, 8, 12
SHIFT = 64 - (BINS - 1).bit_length()
LOW = (1 << SHIFT) - 1


def sentinels() -> Column:
    """The largest value of each bin; it stays the smallest only if the bin is empty."""
    return F.array(*[F.lit(((b - BINS // 2) << SHIFT) | LOW) for b in range(BINS)])


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, an array of BINS small numbers, for the column ``text``.

    Each step is a column of its own that the next one reads twice or more, so
    that no step is evaluated inside another's loop.
    """
    w, s, m, f = (f"_{out}_{x}" for x in "wsmf")
    rest = [c for c in df.columns if c != out]
    words = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    df = df.select(*rest, F.transform(words, lambda x: F.xxhash64(x)).alias(w))
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE)]),
    )
    df = df.select(*rest, F.sort_array(F.concat(shingles, sentinels())).alias(s))
    bin_of = lambda x: F.shiftright(x, SHIFT)
    firsts = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1))))
    df = df.select(*rest, F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != LOW, x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))).alias(m))
    df = df.select(*rest, m, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda c: F.get(F.col(m), c).isNotNull() & (F.size(m) > 0)).alias(f))
    probe = lambda b, j: F.get(F.col(m), F.pmod(F.xxhash64(b, F.lit(j)), F.lit(BINS)).cast("int"))
    first = lambda b: F.when(
        F.size(f) > 0,
        F.array_min(F.transform(f, lambda c: F.struct(F.xxhash64(b, c, F.lit(-1)).alias("h"), F.get(F.col(m), c).alias("v"))))["v"],
    )
    dense = F.transform(m, lambda v, b: F.coalesce(v, *[probe(b, j) for j in range(PROBES)], first(b)))
    return df.select(*rest, dense.alias(out))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda v: F.substring(F.hex(v + (1 << BITS)), 2, BITS // 4)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles in common, 0 to 1."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / BINS
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1 - chance)))


def bounds_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are no more than ``value``: first among every root-th one, then between two of these."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda array: F.size(F.filter(array, lambda x: x <= value))
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs])
    coarse = below(fixed(bounds[step - 1 :: step])) * step
    return (coarse + below(F.slice(fixed(bounds), coarse + 1, step))).cast("int")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, text, fp, next_text, next_fp by ascending doc_id, the first after the last.

    Ranges of doc_id are windows of their own.  The last row of a range gets the
    first document of the next range through a join, one row a range.
    """
    base = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    width = shuffle_width(docs.sparkSession)
    parts = parts or 4 * width
    cuts = base.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    base = base.withColumn("part", bounds_below(F.col("doc_id"), sorted(set(cuts))))

    heads = base.groupBy("part").agg(F.min("doc_id").alias("doc_id"))
    ring = heads.select(
        "doc_id",
        F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"),
    )
    edge = base.drop("part").join(ring, "doc_id").groupBy("part").agg(F.min("text").alias("edge_text"))
    edge = with_fingerprint(edge, "edge_text", "edge_fp")

    dealt = with_fingerprint(base.repartition(width, "part"), "text", "fp")
    order = Window.partitionBy("part").orderBy("doc_id", "text")
    led = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"))
    return led.join(edge, "part").select(
        "doc_id", "text", "fp", F.coalesce("next_text", "edge_text").alias("next_text"), F.coalesce("next_fp", "edge_fp").alias("next_fp")
    )


def edited(text: Column, next_text: Column) -> Column:
    """The last quarter of ``text`` replaced by the start of ``next_text``."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(next_text, F.lit(1), quarter))
