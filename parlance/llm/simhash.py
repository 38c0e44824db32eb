"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's words (ASCII letters lowered, runs of anything but blank and the
control blanks) form four-word shingles.  Bit b of the fingerprint is 1 if more
than half of the shingles' XXH64 values have it.  Two fingerprints are linked if
at most ``max_bits`` bits differ.

The index: distinct fingerprints are sorted by Gray rank, so that neighbours in
the order share many bits, and cut into blocks.  A node stands for a run of the
order and holds the bits its whole run shares (a mask and a pattern).  Two nodes
whose shared bits differ in more than ``max_bits`` places rule out all pairs
below them.  Upper nodes, over whole blocks, are compared level by level by
joins on the parent node; lower nodes inside the task that gets two blocks.

What two nodes share is mostly a prefix, so the search runs in two orders, one
from each half of the bits.  A pair within ``max_bits`` differs in at most half
as many places in one of the halves, and there the order of that half finds it:
the differences allowed in the leading half are ``max_bits // 2``.  With 2**d
runs that leaves 1 + d + d(d-1)/2 partners of each, for the usual four bits.

Fingerprints themselves are the nodes of the graph; a task reports a spanning
forest of the links it finds, never all pairs of a group, so a large group of
near copies costs as many rows as it has fingerprints.

Defined cases: a null or empty text has no word and the fingerprint zero, which
links like any other; fewer than four words form one shingle; rows with a null
doc_id are left out, having no identity; equal doc_ids are one document each and
do not link texts that differ; an empty table gives an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, bounded_batches, by_class, durable, shuffle_width
from parlance.llm.components import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Fingerprints of one block: 8 bytes each, so a task holds a few MB.
BLOCK = 32_768
#: Blocks below a node of the first level (on average), and nodes below one of the next levels.
FANOUT = 16
#: Bits of a block's number within its range of the order.
INNER = 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    h = np.fromiter((hashed(view[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    # Bits by byte column: 64 sums over n values.
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Add ``fp``, the fingerprint's bits as a signed long."""

    def each(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle, seed) for x in s], np.uint64).view(np.int64))

    bounded_batches(docs.sparkSession)
    return docs.withColumn("fp", F.pandas_udf(each, "long")(text))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in the reflected Gray order, as a sortable long."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def halves_swapped(fp: Column) -> Column:
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


# ---- nodes inside a task -------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shared(fps: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits shared by each run of ``width`` values."""
    cuts = np.arange(0, len(fps), width)
    ones = np.bitwise_and.reduceat(fps, cuts)
    anyone = np.bitwise_or.reduceat(fps, cuts)
    return ~(ones ^ anyone), ones


def tree(fps: np.ndarray, leaf: int = 8, fanout: int = 8) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Levels of nodes over a Gray-ordered block, widest first."""
    levels, width = [], leaf
    while True:
        levels.append((width, *shared(fps, width)))
        if width >= len(fps):
            return levels[::-1]
        width *= fanout


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool, most: int = MAX_BITS, chunk: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield index pairs of two Gray-ordered blocks that differ in ``most`` bits or fewer.

    Both trees are walked together.  A pair of nodes whose shared bits differ in
    more places, or in over half as many in the leading half, is dropped with
    everything below it; such pairs are the business of the other order.
    """
    ta, tb = tree(a), tree(b)
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        (wa, ma, pa), (wb, mb, pb) = ta[la], tb[lb]
        differ = (pa[i] ^ pb[j]) & ma[i] & mb[j]
        keep = (popcount(differ) <= most) & (popcount(differ >> np.uint64(32)) <= most // 2)
        if same:
            keep &= i * wa <= j * wb + wb - 1
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        last_a, last_b = la == len(ta) - 1, lb == len(tb) - 1
        if last_a and last_b:
            for s in range(0, len(i), chunk // 64 + 1):
                ii, jj = i[s : s + chunk // 64 + 1], j[s : s + chunk // 64 + 1]
                x = (ii[:, None] * wa + np.arange(wa)).repeat(wb, axis=1).ravel()
                y = np.tile(jj[:, None] * wb + np.arange(wb), (1, wa)).ravel()
                inside = (x < len(a)) & (y < len(b))
                if same:
                    inside &= x < y
                x, y = x[inside], y[inside]
                near = popcount(a[x] ^ b[y]) <= most
                if near.any():
                    yield x[near], y[near]
            continue
        # Open the wider node of the two; halve the work list if it grows large.
        if len(i) > chunk // 8:
            mid = len(i) // 2
            stack += [(la, lb, i[:mid], j[:mid]), (la, lb, i[mid:], j[mid:])]
            continue
        if last_b or (not last_a and wa >= wb):
            i, j, la = np.repeat(i * 8, 8) + np.tile(np.arange(8), len(i)), np.repeat(j, 8), la + 1
            j = j[i < len(ta[la][1])]
            i = i[i < len(ta[la][1])]
        else:
            j, i, lb = np.repeat(j * 8, 8) + np.tile(np.arange(8), len(j)), np.repeat(i, 8), lb + 1
            i = i[j < len(tb[lb][1])]
            j = j[j < len(tb[lb][1])]
        stack.append((la, lb, i, j))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Roots of n nodes after joining all pairs (smallest index of each tree)."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            low, high = np.minimum(rx, ry), np.maximum(rx, ry)
            open_ = low < high
            if not open_.any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            x, y = x[open_], y[open_]
    return root


# ---- the distributed index -------------------------------------------------


def links(classes: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp), each once -> (a, b): a spanning forest of the links between fingerprints."""
    spark = classes.sparkSession
    parts = max(1, -(-2 * classes.count() // (block * FANOUT)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << INNER
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        held, turn, k = np.zeros(0, np.int64), 0, 0

        def node(f: np.ndarray) -> pd.DataFrame:
            mask, ones = (int(v[0]) for v in shared(f.view(np.uint64), len(f)))
            return pd.DataFrame({"turn": [turn], "at": [first + k], "mask": [signed(mask)], "ones": [signed(ones)], "fps": [f.tobytes()]})

        for pdf in batches:
            for t, rows in pdf.groupby("turn", sort=True):  # the order is by turn first
                if t != turn and len(held):
                    yield node(held)
                    k, held = k + 1, held[:0]
                turn, held = int(t), np.concatenate((held, rows["fp"].to_numpy(np.int64)))
                while len(held) >= block:
                    yield node(held[:block])
                    k, held = k + 1, held[block:]
        if len(held):
            yield node(held)

    both = classes.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp")), F.struct(F.lit(1).alias("turn"), halves_swapped(F.col("fp")).alias("fp")))).alias("x")).select("x.*")
    ordered = both.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank")
    blocks = durable(ordered.select("turn", "fp").mapInPandas(pack, "turn int, at long, mask long, ones long, fps binary"))
    pairs = node_pairs(durable(blocks.drop("fps")), most, parts)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for turn, x, y, fa, fb in zip(pdf["turn"], pdf["x"], pdf["y"], pdf["fa"], pdf["fb"], strict=True):
                a, b = np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)
                if x == y:
                    fps, root = a, forest(len(a), close_pairs(a, a, True, most))
                else:
                    fps = np.concatenate((a, b))
                    root = forest(len(fps), ((i, j + len(a)) for i, j in close_pairs(a, b, False, most)))
                if turn:
                    fps = fps << np.uint64(32) | fps >> np.uint64(32)
                child = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"a": fps[child].view(np.int64), "b": fps[root[child]].view(np.int64)})

    left = blocks.select("turn", F.col("at").alias("x"), F.col("fps").alias("fa"))
    right = blocks.select("turn", F.col("at").alias("y"), F.col("fps").alias("fb"))
    with arrow_rows(spark, 8):
        return durable(pairs.join(left, ["turn", "x"]).join(right, ["turn", "y"]).select("turn", "x", "y", "fa", "fb").repartition(shuffle_width(spark)).mapInPandas(search, "a long, b long"))


def node_pairs(nodes: DataFrame, most: int, parts: int) -> DataFrame:
    """(turn, at, mask, ones) -> pairs (turn, x, y) of blocks, x <= y, whose shared bits differ little enough.

    A block's number starts with that of its range of the order, so the node above
    it is the range, then FANOUT ranges, and so on up to one root a turn.  From the
    root down, a surviving pair of nodes is opened by joining both sides' children
    on their parents, so no level compares all its nodes with each other.
    """
    shifts = [0, INNER]
    while parts - 1 >> shifts[-1] - INNER:
        shifts.append(shifts[-1] + FANOUT.bit_length() - 1)
    pairs = None
    for shift, above in reversed(list(zip(shifts, [*shifts[1:], None], strict=True))):
        # A bit is shared above if all blocks below share it with one value.
        level = nodes.groupBy("turn", F.shiftright("at", shift).alias("at")).agg(F.bit_and("mask").alias("mask"), F.bit_and("ones").alias("ones"), F.bit_or("ones").alias("some"))
        level = level.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some")))))
        if pairs is None:
            pairs = level.select("turn", F.col("at").alias("x"), F.col("at").alias("y"))
            continue
        side = lambda c: level.select("turn", F.col("at").alias(f"c{c}"), F.shiftright("at", above - shift).alias(c), F.col("mask").alias(f"m{c}"), F.col("ones").alias(f"o{c}"))  # noqa: E731, B023
        differ = F.col("ox").bitwiseXOR(F.col("oy")).bitwiseAND(F.col("mx")).bitwiseAND(F.col("my"))
        near = (F.bit_count(differ) <= most) & (F.bit_count(F.shiftrightunsigned(differ, 32)) <= most // 2)
        pairs = pairs.join(side("x"), ["turn", "x"]).join(side("y"), ["turn", "y"]).where((F.col("cx") <= F.col("cy")) & near)
        pairs = pairs.select("turn", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return pairs


def near_duplicates(docs: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id for every row with an id."""
    with arrow_rows(docs.sparkSession, 1000):
        ids = durable(with_fingerprints(docs.where("doc_id is not null").select("doc_id", "text")).select("doc_id", "fp"))
    classes = durable(ids.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    rows, distinct = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = connected_components(links(classes.select("fp"), most, block))
    labelled = classes.join(found, classes.fp == found.node, "left").select("fp", "n", "rep", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    placed = by_class(labelled.select("fp", F.col("n").alias("rows"), "label"), least, "label", distinct)
    return by_class(ids, placed.select("fp", "component_id", F.col("rows").alias("n")), "fp", rows).select("doc_id", "fp", "component_id")
