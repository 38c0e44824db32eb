"""Approximate nearest neighbours over learned partitions.

Fit, on a bounded sample of at most ``SAMPLE`` vectors (those with the smallest
hash of vec_id): the sample's neighbour graph is cut into balanced parts (median
splits along principal directions, then moves that keep more neighbours together
while no part exceeds its share by over a twentieth), and a small classifier
learns to tell the parts of a vector's neighbours from the vector.

Index: the classifier places every vector of the table in its most probable
part; parts are searched in blocks of about ``BLOCK`` rows, so a part of any size
is dealt out evenly.

Search: a query goes to the most probable parts, as many as a held-out share of
the sample needs for a recall of ``TARGET``, and more while these hold fewer than
k vectors; in a block all distances are taken, the nearest k kept, and a query's
blocks are merged.

Equal vectors are one place in space: of each, the k + 1 smallest ids can be
among anyone's nearest k, and only these are searched.  A vector that stands in
a third of all rows therefore costs k + 1 rows, and no answer changes.

The number of parts is a quarter of the root of the table's size, so a part is
four times that root; the sample allows ``MOST_PARTS``, 32 of its vectors each,
and beyond that parts grow with the table.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows with a null vec_id; vectors of another length than the
table's most common one are searched among those of their own length, all of them;
rows that repeat both id and vector count once; a query does not find rows of its
own vec_id; ties go to the smaller vec_id; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parlance.llm.common import durable

SAMPLE, BLOCK, TARGET = 8192, 2048, 0.96
MOST_PARTS = SAMPLE // 32
HIDDEN, EPOCHS, RATE = 128, 24, 3e-3


# ---- fit on the bounded sample ---------------------------------------------


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def neighbours(queries: np.ndarray, x: np.ndarray, k: int, own: bool) -> np.ndarray:
    out = []
    for s in range(0, len(queries), 256):
        d = squared(queries[s : s + 256], x)
        if own:
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def median_splits(x: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by repeated splits along the leading principal direction."""
    label, todo, used = np.zeros(len(x), np.int64), [(np.arange(len(x)), parts)], 0
    while todo:
        at, n = todo.pop()
        if n == 1:
            label[at], used = used, used + 1
            continue
        y = x[at] - x[at].mean(axis=0)
        direction = np.linalg.eigh(y.T @ y)[1][:, -1]
        o, cut = at[np.argsort(y @ direction, kind="stable")], len(at) * (n // 2) // n
        todo += [(o[:cut], n // 2), (o[cut:], n - n // 2)]
    return label


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """Label of each sample vector; no part holds over 1.05 times its share."""
    label = median_splits(x, parts)
    most = int(np.ceil(1.05 * len(x) / parts))
    size = np.bincount(label, minlength=parts)
    rows = np.arange(len(x))
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(rows, graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[rows, best] - votes[rows, label]
        moved = 0
        for r in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            to = best[r]
            if size[to] < most:
                size[label[r]] -= 1
                size[to] += 1
                label[r] = to
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier with one hidden layer: vectors to log-weights of the parts."""

    def __init__(self, dim: int, parts: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(dim), 1.0
        self.w = [r.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Router:
        """Adam on the cross entropy with the parts of each vector's neighbours."""
        self.shift = x.mean(axis=0)
        self.scale = 1 / max(float(np.sqrt(((x - self.shift) ** 2).mean())), 1e-12)
        r, z = np.random.default_rng(seed), (x - self.shift) * self.scale
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = r.permutation(len(z))
            for s in range(0, len(z), 256):
                i = order[s : s + 256]
                a = z[i] @ self.w[0] + self.w[1]
                h = np.maximum(a, 0)
                o = h @ self.w[2] + self.w[3]
                p = np.exp(o - o.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
                dh = (d @ self.w[2].T) * (a > 0)
                step += 1
                for k, g in enumerate((z[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(x: np.ndarray, parts: int, k: int, target: float = TARGET) -> tuple[Router, int]:
    """The router, and how many parts a query is sent to."""
    held = max(1, len(x) // 8)
    train, queries = x[held:], x[:held]
    k = min(k, len(train) - 1)
    graph = neighbours(train, train, k, own=True)
    label = balanced_cut(train, graph, parts)
    soft = np.zeros((len(train), parts))
    np.add.at(soft, (np.repeat(np.arange(len(train)), k), label[graph].ravel()), 0.9 / k)
    soft[np.arange(len(train)), label] += 0.1
    router = Router(x.shape[1], parts).fit(train, soft)
    near, home = neighbours(queries, train, k, own=False), router(train).argmax(axis=1)
    place = np.argsort(np.argsort(-router(queries), axis=1, kind="stable"), axis=1)
    reached = np.take_along_axis(place, home[near], axis=1).ravel()
    return router, int(np.quantile(reached, target, method="higher")) + 1


# ---- search ----------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_in_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    matrix = lambda t: np.stack(t.column("vector").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
    out = ([], [], [])
    if len(queries) and len(rows):
        q, x = matrix(queries), matrix(rows)
        qid, xid = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        # Squares of huge components would leave the range of doubles; a power of two scales without rounding.
        most = max(np.abs(q).max(), np.abs(x).max())
        scale = 2.0 ** np.floor(np.log2(most)) if most > 1e100 else 1.0
        q, x = q / scale, x / scale
        far = float((x * x).sum(axis=1).max())
        for s in range(0, len(q), 256):
            d = squared(q[s : s + 256], x)
            own = qid[s : s + 256, None] == xid[None]
            d[own] = np.inf
            cut = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            # The quick form only sifts; what may be among the nearest is measured exactly.
            slack = 1e-9 * ((q[s : s + 256] ** 2).sum(axis=1) + far)
            for i, near in enumerate(d <= (cut + slack)[:, None]):
                j = np.flatnonzero(near & ~own[i])
                exact = scale * np.sqrt(((q[s + i] - x[j]) ** 2).sum(axis=1))
                o = np.lexsort((xid[j], exact))[:k]
                out[0].append(np.full(len(o), qid[s + i]))
                out[1].append(xid[j[o]])
                out[2].append(exact[o])
    columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(vec_id, vector) -> query_id, rank, vec_id, score for rows where ``queries`` holds."""
    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector")
    common = kept.agg(F.mode(F.size("vector"), True)).first()[0] or 0
    asked = kept.where(queries).distinct()
    one_place = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    every = durable(kept.withColumn("n", F.dense_rank().over(one_place)).where(F.col("n") <= k + 1).drop("n").distinct())
    usual = F.size("vector") == common
    found = routed_search(every.where(usual), asked.where(usual), k).unionByName(search_by_length(every.where(~usual), asked.where(~usual), k))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_by_length(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the nearest k of each block of the query's own length."""
    long = lambda df: df.withColumn("length", F.size("vector"))
    blocks = long(rows).groupBy("length").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = long(rows).join(blocks, "length").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    routed = long(asked).join(blocks, "length").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # Both sides hold one column of `blocks`, which a cogroup calls ambiguous.
    return nearest(routed.drop("blocks"), dealt.drop("blocks"), ["length", "block"], k)


def nearest(routed: DataFrame, dealt: DataFrame, block: list[str], k: int) -> DataFrame:
    return routed.groupBy(*block).cogroup(dealt.groupBy(*block)).applyInArrow(lambda q, x: nearest_in_block(q, x, k), "query_id long, vec_id long, score double")


def routed_search(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the nearest k of each block of the parts a query is sent to."""
    total = rows.count()
    parts = max(1, min(MOST_PARTS, int(total**0.5) // 4))
    router, probes = None, 1
    if parts > 1:
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
        router, probes = fit(np.stack(sample["vector"]).astype(np.float64), parts, k)

    def home(s: pd.Series) -> pd.Series:
        return pd.Series(router(np.stack(s).astype(np.float64)).argmax(axis=1) if router and len(s) else np.zeros(len(s), np.int64))

    placed = durable(rows.withColumn("part", F.pandas_udf(home, "long")("vector")))
    sizes = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # a row a part, MOST_PARTS at most
        sizes[r["part"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def targets(s: pd.Series) -> pd.Series:
        if router is None:
            return pd.Series([list(range(blocks[0]))] * len(s))
        starts, out = np.cumsum(blocks) - blocks, []
        for order in np.argsort(-router(np.stack(s).astype(np.float64)), axis=1, kind="stable") if len(s) else ():
            enough = int(np.searchsorted(np.cumsum(sizes[order]), 2 * k + 2)) + 1
            out.append(np.concatenate([starts[p] + np.arange(blocks[p]) for p in order[: max(probes, enough)]]).tolist())
        return pd.Series(out)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = np.cumsum(blocks) - blocks
        for pdf in batches:
            p = pdf["part"].to_numpy()
            yield pdf.assign(block=starts[p] + pdf["h"].to_numpy() % blocks[p])[["vec_id", "vector", "block"]]

    hashed = placed.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)))
    schema = "vec_id long, vector array<float>, block long"
    dealt = hashed.mapInPandas(block, schema.replace("float", rows.schema["vector"].dataType.elementType.simpleString()))
    routed = asked.withColumn("block", F.explode(F.pandas_udf(targets, "array<long>")("vector")))
    return nearest(routed, dealt, ["block"], k)
