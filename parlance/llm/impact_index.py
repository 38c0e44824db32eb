"""Exact top-k by integer inner product, on an index ordered by impact.

Index: rows are dealt evenly over blocks of about ``COMPONENTS`` components.  In a
block each dimension has a posting list for each sign.  A list is cut into segments by
quantised magnitude, in at most ``LEVELS`` levels that are narrow where magnitudes are
dense; a segment keeps the largest and the least magnitude of its level.  A segment is
a row of the index (block, dim, signed impact, rows); whole vectors are rows beside them.

Search, score at a time: a query's segments are added up in descending order of impact,
weight times largest magnitude, whatever the sign.  Each adds the most its rows can have
from it.  The sum so far, with the next impact for every dimension in which a row was
not yet seen, bounds the row's score from above.  Rows that lead are scored exactly,
which gives a threshold: so many rows have at least that score.  The search stops only
when it is proved that no row outside a set of possible members reaches the threshold
and to score that set costs no more than the postings that are left; the set is then
scored exactly.

Queries travel packed, in chunks, to every block; a task holds one block and one
chunk.  All queries meet all blocks because any row may be an answer of each.

Defined cases: vectors that are null or hold null or non-finite components take no
part, nor do rows with a null vec_id; zero vectors take part; in vectors of several
lengths a missing component is zero; every row is a candidate but the query's own, so
another row with the same vec_id is one; rows that repeat a query are queries of their
own; ties go to the smaller vec_id; an empty table gives an empty result; extra
columns are not read.  A component of 2^23 or more in magnitude, or scores beyond 53
bits, stop the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import bounded_batches, durable, shuffle_width

#: Components of a block on average, levels of a list, vectors of a chunk.
COMPONENTS, LEVELS, CHUNK = 1 << 21, 16, 1024
#: Proofs that are tried on the way through the postings of a query, evenly spaced.
PROOFS = 8
VECTORS, SEGMENT, QUERIES = 0, 1, 2
SCHEMA = "block int, kind int, at int, impact long, least long, ids binary, lengths binary, data binary"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, computed in double precision."""
    scaled = lambda x: F.lit(scale) * x.cast("double")
    refused = F.raise_error(F.lit("a component is too large for the index")).cast("long")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**31, F.floor(scaled(x))).otherwise(refused))


# ---- vectors and index rows ------------------------------------------------


class Vectors:
    """Rows of integers of any lengths: ids, lengths and all components, one after another."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray):
        self.ids, self.lengths, self.flat = ids, lengths, flat
        self.starts = np.cumsum(lengths) - lengths
        self.even = len(ids) > 0 and bool((lengths == lengths[0]).all())
        self.matrix = flat.reshape(len(ids), lengths[0]) if self.even else None

    def __len__(self) -> int:
        return len(self.ids)

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.lengths[i]]

    def products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows with a vector."""
        if self.even:
            n = min(self.matrix.shape[1], len(q))
            return self.matrix[rows, :n] @ q[:n]
        out = np.zeros(len(rows), np.int64)
        for j, i in enumerate(rows.tolist()):
            v = self.row(i)
            n = min(len(v), len(q))
            out[j] = v[:n] @ q[:n]
        return out

    def packed(self, block: int, kind: int) -> Iterator[dict]:
        """Chunks as rows of ``SCHEMA``; components in the fewest bytes that hold them."""
        for at, s in enumerate(range(0, len(self), CHUNK)):
            e = min(s + CHUNK, len(self))
            flat = self.flat[self.starts[s] : self.starts[e - 1] + self.lengths[e - 1]]
            small = next(t for t in (np.int16, np.int32, np.int64) if not len(flat) or (np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max))
            yield {"block": block, "kind": kind, "at": at, "impact": 0, "least": 0, "ids": self.ids[s:e].tobytes(), "lengths": self.lengths[s:e].tobytes(), "data": flat.astype(small).tobytes()}

    @staticmethod
    def unpacked(rows: list[dict]) -> Vectors:
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        flats = []
        for r in rows:
            n = int(np.frombuffer(r["lengths"], np.int64).sum())
            flats.append(np.frombuffer(r["data"], f"<i{len(r['data']) // n}" if n else np.int64).astype(np.int64))
        ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
        return Vectors(join(ids, np.int64), join([np.frombuffer(r["lengths"], np.int64) for r in rows], np.int64), join(flats, np.int64))

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Vectors:
        """All rows of ``vec_id, vector``."""
        ids, lengths, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            v = b.column("vector")
            ids.append(b.column("vec_id").to_numpy(zero_copy_only=False))
            lengths.append(np.diff(v.offsets.to_numpy()).astype(np.int64))
            flat.append(v.flatten().to_numpy(zero_copy_only=False))
        return Vectors(np.concatenate(ids), np.concatenate(lengths), np.concatenate(flat))


def levels_of(size: np.ndarray, levels: int) -> np.ndarray:
    """Upper edges of ``levels`` magnitudes at most, spaced by the root of their density."""
    count, edges = np.histogram(size, 1024)
    place = np.cumsum(np.sqrt(count))
    cut = np.searchsorted(place, place[-1] * np.arange(1, levels) / levels)
    return np.unique(np.append(np.floor(edges[cut + 1]).astype(np.int64), size.max()))


def segments(vectors: Vectors, levels: int = LEVELS) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(dimension, signed impact, least magnitude, rows) of each posting segment."""
    row = np.repeat(np.arange(len(vectors)), vectors.lengths)
    dim = np.arange(len(vectors.flat)) - np.repeat(vectors.starts, vectors.lengths)
    kept = vectors.flat != 0
    row, dim, value = row[kept], dim[kept], vectors.flat[kept]
    if not len(value):
        return
    size = np.abs(value)
    level = np.sign(value) * (1 + np.searchsorted(levels_of(size, levels), size))
    order = np.lexsort((row, level, dim))
    row, dim, level, size = row[order], dim[order], level[order], size[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(dim) != 0) | (np.diff(level) != 0)])
    most, least = np.maximum.reduceat(size, starts), np.minimum.reduceat(size, starts)
    for i, (s, e) in enumerate(zip(starts.tolist(), np.append(starts[1:], len(row)).tolist(), strict=True)):
        yield int(dim[s]), int(np.sign(level[s]) * most[i]), int(least[i]), row[s:e].astype(np.int32)


def record_batches(rows: Iterator[dict], most: int = 512) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("at", pa.int32()), ("impact", pa.int64()), ("least", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The index of (vec_id, vector of integers): rows of ``SCHEMA``, written once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = Vectors.read(batches), TaskContext.get().partitionId()
        yield from record_batches(held.packed(block, VECTORS), 16)
        yield from record_batches({"block": block, "kind": SEGMENT, "at": d, "impact": i, "least": m, "ids": rows.tobytes()} for d, i, m, rows in segments(held))

    return durable(vectors.repartition(blocks).mapInArrow(build, SCHEMA))


def packed_queries(asked: DataFrame) -> DataFrame:
    """The queries in chunks; ``block`` and ``at`` name the chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for r in Vectors.read(iter([b])).packed(part, QUERIES):
                yield from record_batches(iter([r | {"at": n}]))
                n += 1

    return durable(asked.mapInArrow(pack, SCHEMA))


# ---- search ----------------------------------------------------------------


class Block:
    """The vectors and posting segments of one block."""

    def __init__(self, vectors: Vectors, rows: list[dict]):
        self.vectors = vectors
        self.dim = np.array([r["at"] for r in rows], np.int64)
        self.impact = np.array([r["impact"] for r in rows], np.int64)
        self.least = np.array([r["least"] for r in rows], np.int64)
        self.postings = [np.frombuffer(r["ids"], np.int32) for r in rows]
        self.sizes = np.array([len(p) for p in self.postings], np.int64)

    def top(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows by score, then id; exact."""
        v, n = self.vectors, len(self.vectors)
        used = np.flatnonzero(self.dim < len(q))
        used = used[q[self.dim[used]] != 0]
        impact = np.abs(q[self.dim[used]] * self.impact[used])
        order = np.argsort(-impact, kind="stable")
        used, impact = used[order], impact[order]
        weight = q[self.dim[used]] * np.sign(self.impact[used])
        most = np.where(weight > 0, impact, weight * self.least[used])
        _, first = np.unique(self.dim[used], return_index=True)
        first.sort()
        # ``tops``: the largest impacts of the dimensions from one on, in the order in which they begin.
        tops = np.append(np.cumsum(impact[first][::-1])[::-1], 0)
        if len(q) * float(np.abs(q).max(initial=0)) * float(np.abs(self.impact).max(initial=0)) >= 2.0**53:
            raise ValueError("scores are beyond 53 bits")
        sums, seen = np.zeros(n), np.zeros(n, np.int64)
        work = np.append(0, np.cumsum(self.sizes[used]))
        stops = np.unique(np.append(np.searchsorted(work, work[-1] * np.arange(1, PROOFS) / PROOFS), len(used)))
        done, threshold = 0, None
        for stop in stops.tolist():
            if stop > done:
                rows = np.concatenate([self.postings[s] for s in used[done:stop].tolist()])
                sums += np.bincount(rows, np.repeat(most[done:stop], self.sizes[used[done:stop]]), n)
                seen += np.bincount(rows, minlength=n)
            done = stop
            if n > k:
                lead = np.argpartition(sums, n - min(n, 4 * k))[n - min(n, 4 * k) :]
                best = np.partition(v.products(lead, q), len(lead) - k)[len(lead) - k]
                threshold = best if threshold is None else max(threshold, best)
            begun = int(np.searchsorted(first, done))
            rest = int(impact[done]) if done < len(impact) else 0
            bound = sums + (tops[begun] + rest * (begun - seen))
            possible = np.arange(n) if threshold is None else np.flatnonzero(bound >= threshold)
            if len(possible) * len(q) <= work[-1] - work[done] or done == len(used):
                break
        scores = v.products(possible, q)
        o = np.lexsort((v.ids[possible], -scores))[:k]
        return possible[o], scores[o]


def answers(block: Block, chunk: dict, k: int) -> pa.RecordBatch:
    queries, out = Vectors.unpacked([chunk]), []
    for i in range(len(queries)):
        q = queries.row(i)
        rows, scores = block.top(q, k)
        ids = block.vectors.ids[rows]
        own = np.array([a == queries.ids[i] and np.array_equal(block.vectors.row(r), q) for r, a in zip(rows.tolist(), ids, strict=True)], bool)
        out.append((np.full(len(rows), i), np.full(len(rows), queries.ids[i]), ids, scores, own))
    place, qid, vid, score, own = (np.concatenate(c) for c in zip(*out, strict=True))
    part, at = np.full(len(place), chunk["impact"]), np.full(len(place), chunk["at"])
    columns = [pa.array(c.astype(t)) for c, t in ((part, np.int64), (at, np.int64), (place, np.int64), (qid, np.int64), (vid, np.int64), (score, np.int64), (own, bool))]
    return pa.RecordBatch.from_arrays(columns, ["part", "at", "place", "query_id", "vec_id", "score", "own"])


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, vector) -> query_id, rank, vec_id, score: the k best of all rows for each row where ``queries`` holds."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector")
    size = kept.agg(F.count("*"), F.sum(F.size("vector"))).first()
    blocks = max(-(-(size[1] or 0) // components), min(size[0], shuffle_width(spark)), 1)
    whole = kept.withColumn("vector", integers(F.col("vector"), scale))
    bounded_batches(spark)
    asked = packed_queries(whole.where(queries))
    # A chunk keeps its own name in ``impact`` while ``block`` says where it goes.
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "kind", "at", F.col("block").cast("long").alias("impact"), "least", "ids", "lengths", "data")
    together = index(whole, blocks).unionByName(sent).repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "at", "impact")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ready, held, lists = None, None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != number:
                    number, ready, held, lists = r["block"], None, [], []
                if r["kind"] == VECTORS:
                    held.append(r)
                elif r["kind"] == SEGMENT:
                    lists.append(r)
                elif held:
                    if ready is None:
                        ready, lists = Block(Vectors.unpacked(held), lists), []
                    yield answers(ready, r, k + 1)

    found = together.mapInArrow(answer, "part long, at long, place long, query_id long, vec_id long, score long, own boolean")
    query = Window.partitionBy("part", "at", "place")
    best = found.withColumn("r", F.row_number().over(query.orderBy(F.desc("score"), "vec_id", F.desc("own")))).where(F.col("r") <= k + 1)
    best = best.withColumn("mine", F.min(F.when(F.col("own"), F.col("r"))).over(query)).where(F.col("mine").isNull() | (F.col("r") != F.col("mine")))
    rank = F.col("r") - F.when(F.col("r") > F.col("mine"), 1).otherwise(0)
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
