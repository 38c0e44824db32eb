"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (one to three code points
of the lowered text) that both contain, whatever their number in each, divided
by the root of the product of both totals: the normalised blended-spectrum
presence kernel.  n-grams are hashed to ``2**bits`` places.

Nystroem landmarks, a few labelled texts of each language, turn the kernel into
features; ridge regression on them, one language against the rest, is solved in
closed form on a bounded sample of labelled rows (``per_language`` a language,
``most`` in all, those with the smallest hash of doc_id).  The kernel is linear
in the presence vectors, so landmarks and regression weights multiply out to one
matrix, and a batch of whole texts is scored by one product.

Defined cases: a text that is null or without a letter gets ``und`` and score 0,
as does every text if no labelled row exists; ties go to the smallest language;
rows with a null label are not learned from; a null doc_id is no obstacle to
prediction; repeated rows are predicted one by one; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parlance.llm.common import bounded_batches, fresh

BITS, ORDERS = 14, 3
PER_LANGUAGE, MOST = 400, 4000
LANDMARKS, RIDGE, SHARPNESS = 256, 1e-2, 6.0
LETTER = regex.compile(r"\p{L}")


def presence(text: str, bits: int = BITS, orders: int = ORDERS) -> np.ndarray:
    """0/1 vector of the n-grams of one whole text."""
    out = np.zeros(1 << bits, np.uint8)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(orders):
        if len(c) <= n:
            break
        h = h[: len(c) - n] * np.uint32(0x01000193) ^ (c[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        out[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)] = 1
    return out


def held_out(doc_id: Column) -> Column:
    """Rows no model of this operator may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> pd.DataFrame:
    """Packed presence vectors of the bounded sample: columns lang, bits."""
    key = F.xxhash64("doc_id")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    # A share of each language that holds the wanted rows many times over comes
    # through, so that a language of any size is ordered at the same cost.
    # At most ``most`` languages can be learned, so their sizes are few enough to send.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most)
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) * F.col("rows") < F.lit(4 * per_language) * (1 << 20)
    labelled = labelled.join(F.broadcast(sizes), "lang").where(share).drop("rows")
    first = labelled.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))).where(F.col("n") <= per_language)
    chosen = first.orderBy("n", key, "doc_id").limit(most).select("doc_id").distinct()
    pack = F.pandas_udf(lambda s: s.map(lambda t: np.packbits(presence(t)).tobytes()), "binary")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").where("text is not null and lang is not null")
    # A doc_id that repeats gives one text a language, and all of them are ``2 * most`` at the most.
    texts = rows.where(F.col("text").rlike(r"\p{L}")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    sample = texts.orderBy(key, "doc_id", "lang").limit(2 * most).select("lang", "doc_id", pack("text").alias("bits")).toPandas()
    return sample.sort_values(["lang", "doc_id", "bits"], ignore_index=True)


def fit(sample: pd.DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix that maps presence vectors to their scores."""
    langs = sorted(sample["lang"].unique())
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in sample["bits"]]).astype(np.float32)
    x /= np.sqrt(x.sum(axis=1, keepdims=True)).clip(1)
    rank = sample.groupby("lang").cumcount().to_numpy()
    marks = x[np.sort(np.argsort(rank, kind="stable")[:landmarks])]
    w, v = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = w > 1e-6 * w.max()
    root = v[:, good] / np.sqrt(w[good])
    features = (x @ marks.T) @ root
    features = np.hstack([features, np.ones((len(x), 1))])
    y = np.where(sample["lang"].to_numpy()[:, None] == np.array(langs, object), 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = 1 / sample.groupby("lang")["lang"].transform("size").to_numpy(float)[:, None]
    gram = features.T @ (features * weight) + ridge / len(x) * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (y * weight))
    return langs, np.vstack([marks.T @ (root @ beta[:-1]), beta[-1:]]).astype(np.float32)


def classify(docs: DataFrame, langs: list[str], weights: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the share of the best language, 0 to 1)."""

    def predict(s: pd.Series) -> pd.DataFrame:
        pred, score = ["und"] * len(s), np.zeros(len(s))
        known = [k for k, t in enumerate(s) if t is not None and LETTER.search(t)] if langs else []
        for lo in range(0, len(known), 256):
            at = known[lo : lo + 256]
            x = np.stack([presence(s.iat[k]) for k in at]).astype(np.float32)
            f = (x @ weights[:-1]) / np.sqrt(x.sum(axis=1, keepdims=True)) + weights[-1]
            best = f.argmax(axis=1)
            e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
            for k, b, p in zip(at, best, 1 / e.sum(axis=1), strict=True):
                pred[k], score[k] = langs[b], p
        return pd.DataFrame({"lang_pred": pred, "score": score})

    bounded_batches(docs.sparkSession)
    # So called that a filter on the result does not move below and predict every text once more.
    found = F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()(text)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (both,) = fresh(docs, "found")
    return docs.select(*rest, found.alias(both)).select(*rest, f"{both}.lang_pred", f"{both}.score")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict every row."""
    sample = training_sample(docs)
    langs, weights = fit(sample) if len(sample) else ([], np.zeros((2, 1), np.float32))
    return classify(docs, langs, weights)
