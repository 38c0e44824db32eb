"""Near copies: SimHash links and exact similarity of five-word shingles.

Two texts are linked if the Jaccard similarity of their sets of ``SHINGLE``-word
shingles is ``SIMILAR`` or more; of each connected group one text stays.  Words
are those of the SimHash operator.  Shingles are compared by 64-bit hashes.

1. Equal texts are one class; only classes go on.
2. The SimHash operator, over shingles of five words, links classes in its
   Gray-order index.  Its links are candidates like the others.
3. A pair at similarity 0.8 differs in ten of 64 bits on average, more than an
   index of bit patterns can span, so further fingerprints add candidates: each of
   ``BANDS`` joins ``ROWS`` minima of a text's hashed shingles.  A pair at
   similarity s agrees in one of them at least with probability
   1 - (1 - s**ROWS)**BANDS, which is 0.9999 at 0.8.
4. Confirmation.  First every text meets the leader of each of its buckets, with a
   new leader in every round, so that a large group costs a few rows a text.  After
   that, texts of different groups in one bucket are compared.  Buckets of at most
   ``FEW`` texts give pairs.  Larger ones are cut into blocks of ``BLOCK_BYTES``, and a
   task that gets two blocks counts what their sets share with inverted lists of what
   sets it apart from the majority of its texts; only links of different groups leave it.

Defined cases: a null text is empty; texts without a word are copies of each other;
fewer than five words form one shingle; rows with a null doc_id are documents like
others, each behind all ids in the order; rows with equal doc_id and other texts are
documents of their own; of rows with equal doc_id and text one stays, that whose other
columns are least; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, bounded_batches, durable, fresh, text_or_empty
from parlance.llm.components import connected_components
from parlance.llm.simhash import LOWER, WORD, fingerprint
from parlance.llm.simhash import links as simhash_links

SHINGLE, SIMILAR_PERCENT = 5, 80
BANDS, ROWS, SEED = 24, 5, 42
#: Words whose hash a Python worker keeps.
KEPT_WORDS = 100_000
#: Rounds against leaders go on while more pairs than these a member are open.
ROUNDS, OPEN = 4, 4
#: Texts of a bucket whose pairs are rows, and bytes of shingles in one block of a larger bucket.
FEW, BLOCK_BYTES = 16, 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(max(1, len(w) - k + 1), k, np.uint64)
    for i in range(k):
        h = h * MIX + w[i : len(w) - k + 1 + i]
    h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """One signed long a band."""
    draws = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    factor, plus = (draws[0] | np.uint64(1))[:, None], draws[1][:, None]
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), 512):
        np.minimum(least, (h[None, lo : lo + 512] * factor ^ plus).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ least[r::ROWS]) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * 100 >= (len(x) + len(y) - both) * SIMILAR_PERCENT


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """Add ``size``, the number of shingles, ``bands``, the fingerprints, and ``fp``, that of SimHash."""

    def each(s: pd.Series) -> pd.DataFrame:
        known = WordHashes()
        sets = [shingles(x, known) for x in s]
        fp = np.array([fingerprint(x, SHINGLE) for x in s], np.uint64).view(np.int64)
        return pd.DataFrame({"size": [len(h) for h in sets], "bands": [fingerprints(h) for h in sets], "fp": fp})

    found = docs.withColumn("_f", F.pandas_udf(each, "size long, bands array<long>, fp long")("text"))
    return found.select(*docs.columns, "_f.size", "_f.bands", "_f.fp")


def shingle_sets(texts: DataFrame) -> DataFrame:
    def each(s: pd.Series) -> pd.Series:
        known = WordHashes()
        return s.map(lambda x: shingles(x, known).tobytes())

    return texts.select("node", F.pandas_udf(each, "binary")("text").alias("set"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""
    check = F.pandas_udf(lambda x, y: pd.Series([similar(a, b) for a, b in zip(x, y, strict=True)], dtype=bool), "boolean")
    held = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return held.where(check("sa", "sb")).select("a", "b")


def block_links(label: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links between the groups (``label``) of similar sets, one place in ``left``, the other in ``right``.

    With p the hashes that over half of the sets hold, a set x is told by what it
    adds to p and what it lacks of p.  Two sets share |x & p| + |y & p| - |p| hashes
    and as many more as these differences have in common.  The inverted lists hold
    differences alone, so the passages that make the sets near copies are in no list.
    """
    size = np.array([len(x) for x in sets])
    hashes, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    usual = np.bincount(at, minlength=len(hashes)) * 2 > len(sets)
    p = np.flatnonzero(usual)
    has = np.zeros((len(sets), len(p)), bool)
    of_p = usual[at]
    has[row[of_p], np.searchsorted(p, at[of_p])] = True
    core = has.sum(axis=1)
    lacks, lacked = np.nonzero(~has)
    row, item = np.concatenate((row[~of_p], lacks)), np.concatenate((at[~of_p], p[lacked]))

    listed = np.zeros(len(sets), bool)
    listed[right] = True
    by_item = np.flatnonzero(listed[row])
    by_item = by_item[np.argsort(item[by_item], kind="stable")]
    holders = row[by_item]
    ends = np.cumsum(np.bincount(item[by_item], minlength=len(hashes)))
    by_row = item[np.argsort(row, kind="stable")]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sets)))))

    group = np.unique(label, return_inverse=True)[1]
    root, found = list(range(group.max() + 1)), []

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    for x in left.tolist():
        mine = by_row[cuts[x] : cuts[x + 1]]
        stop = ends[mine]
        n = stop - np.where(mine > 0, ends[mine - 1], 0)
        places = np.arange(n.sum()) + np.repeat(stop - np.cumsum(n), n)
        both = core[x] + core - len(p) + np.bincount(holders[places], minlength=len(sets))
        near = np.flatnonzero((both * 100 >= (size[x] + size - both) * SIMILAR_PERCENT) & listed & (group != group[x]))
        for g, first in zip(*np.unique(group[near], return_index=True), strict=True):
            a, b = top(int(g)), top(int(group[x]))
            if a != b:
                root[a] = b
                found.append((x, int(near[first])))
    return found


def large_bucket_links(live: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, size, label) -> links (a, b) within buckets, each bucket cut into blocks of bounded size."""
    blocks = live.groupBy("key").agg(F.ceil(F.sum("size") * 8 / BLOCK_BYTES).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = live.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "label", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))

    def each(rows: pa.Table) -> pa.Table:
        node, label, mine = (rows.column(c).to_numpy() for c in ("node", "label", "mine"))
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        held = [np.frombuffer(b, np.uint64) for b in rows.column("set").to_pylist()]
        links = block_links(label, held, np.flatnonzero(mine == x), np.flatnonzero(mine == y))
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})

    return dealt.join(sets, "node").groupBy("key", "x", "y").applyInArrow(each, "a long, b long")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(node, fp) -> pairs (a, b) of nodes: those of one fingerprint with their first, and firsts of linked fingerprints."""
    first = durable(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = classes.join(first.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    linked = simhash_links(first.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, key, size, bands, fp) -> (node, label): label is the smallest node of the group.

    ``texts`` (key, text) hold the texts, which only candidates need.
    """
    spark = classes.sparkSession
    rows = classes.select("node", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(rows.join(shared, "key", "left_semi").select("key", "node", "size"))
    proposed = durable(simhash_pairs(classes))
    some = members.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = classes.select("node", "key").join(some, "node", "left_semi")
    with arrow_rows(spark, 200):
        sets = durable(shingle_sets(texts.join(wanted, "key").dropDuplicates(["key"])))
    labels = None
    near = (F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * SIMILAR_PERCENT) & (F.col("la") != F.col("lb"))
    for turn in range(ROUNDS + 1):
        now = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        now = durable(now)
        groups = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        still = groups.where("n * n > same")
        open_, of = still.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        if not open_:
            break
        last = turn == ROUNDS or (turn and open_ <= OPEN * of)
        left = now.select("key", "node", F.col("size").alias("sa"), F.col("label").alias("la"))
        if last:
            live = now.join(still.select("key", "n"), "key")
            large = live.where(F.col("n") > FEW).select("key", "node", "size", "label")
            right = live.where(F.col("n") <= FEW).select("key", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("label").alias("lb"))
            pairs = left.join(right, "key").where(near & (F.col("node") < F.col("b")))
        else:
            order = F.col("node") if not turn else F.xxhash64("node", F.lit(turn))
            lead = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("b"), F.col("size").alias("sb"), F.col("label").alias("lb"))).alias("m"))
            lead = lead.join(still.select("key"), "key", "left_semi").select("key", "m.b", "m.sb", "m.lb")
            pairs = left.join(lead, "key").where(near)
        pairs = pairs.select(F.col("node").alias("a"), "b").distinct()
        if labels is None:
            pairs = pairs.unionByName(proposed)
        with arrow_rows(spark, 200):
            edges = confirmed(pairs, sets)
            edges = durable(edges.unionByName(large_bucket_links(large, sets)) if last else edges)
        # What is known so far is one link a node; only new links join it.
        labels = connected_components(edges if labels is None else edges.unionByName(labels.toDF("a", "b")))
        if last:
            break
    if labels is None:  # no bucket holds two classes
        with arrow_rows(spark, 200):
            labels = connected_components(confirmed(proposed, sets))
    return labels


def survivors(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> the rows of the smallest doc_id of each group, once."""
    bounded_batches(docs.sparkSession)
    digest, key, row = fresh(docs, "digest", "key", "row")
    named = docs.withColumn(digest, F.md5(text_or_empty()))
    # One name for a document and its copies under the same id; never null, as ids may be.
    named = named.withColumn(key, F.concat_ws(" ", digest, F.col("doc_id").cast("string")))
    texts = named.select(F.col(key).alias("key"), "doc_id", F.col(digest).alias("digest"), "text")
    with arrow_rows(docs.sparkSession, 1000):
        printed = durable(with_fingerprints(texts).select("key", "doc_id", "digest", "size", "bands", "fp"))
    # The smallest id, those without one last, tells which document and which class stays.
    classes = printed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at"), *[F.first(c).alias(c) for c in ("size", "bands", "fp")])
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("key", F.col("at.key")))
    placed = classes.join(links(classes, texts.select("key", "text")), "node", "left").groupBy(F.coalesce("label", "node").alias("label"))
    first = placed.agg(F.min("at").alias("at")).select(F.col("at.key").alias(key))
    least = F.min(F.struct(*[c for c in docs.columns if c != "text"], "text")).alias(row)
    return named.join(first, key, "left_semi").groupBy(key).agg(least).select(f"{row}.*").select(*docs.columns)
