"""Packing token sequences: first-fit decreasing on a tournament tree.

Documents are tokenized where they are read and cut into pieces of at most
``capacity`` ids.  A document belongs to one of many randomised groups, so that
groups are alike and bounded at any input size; each group is packed on its own.
Within a group pieces go, longest first, into the first sequence with room.  A
tournament tree over the sequences' free room finds it in log time: an inner
node holds the larger room of its two children.

Only (length, key) rows need to meet in a group; ids can travel along or stay
behind, as the caller selects.  Where a sequence must hold one kind of documents
(one language), each kind has groups of its own, as many as its size asks for.

Defined cases: a null or empty text has the end id alone; a null doc_id is kept
as null; repeated rows are documents of their own (rows are told apart by their
place in the table); a null kind is a kind of its own; an empty table gives an
empty result.  Extra columns are not read unless they are named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import bounded_batches, fresh, text_or_empty, worker_cache
from parlance.llm.tokenizer import Encoder

CAPACITY, END_ID, VOCABULARY = 2048, 1, "byte_bpe_50k"
#: Documents of one group, on average.
GROUP = 2048


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    path: Callable[[str], str] = public_tokenizers.path,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, text) -> doc_id, row, start, length, doc_tokens, ids (binary, little-endian uint32), the columns ``carry``."""
    pattern = public_tokenizers.PATTERN

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()
        if ("encoder", vocabulary) not in kept:
            kept["encoder", vocabulary] = Encoder(path, vocabulary, pattern)
        encode, end, width = kept["encoder", vocabulary], np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(batch), 256):
                source, start, total, ids = [], [], [], []
                for k, text in enumerate(texts.slice(lo, 256).to_pylist(), lo):
                    blob = encode(text) + end
                    for s in range(0, len(blob), width):
                        source.append(k)
                        start.append(s // 4)
                        total.append(len(blob) // 4)
                        ids.append(blob[s : s + width])
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                of = {c: batch.column(c).take(pa.array(source)) for c in ("doc_id", "row", *carry)}
                yield pa.RecordBatch.from_arrays(
                    [of["doc_id"], of["row"], pa.array(start, pa.int64()), pa.array(length), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), *(of[c] for c in carry)],
                    ["doc_id", "row", "start", "length", "doc_tokens", "ids", *carry],
                )

    bounded_batches(docs.sparkSession)
    read = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"), *carry)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return read.mapInArrow(cut, "doc_id long, row long, start long, length long, doc_tokens long, ids binary" + kinds)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece, and the number of bins.  Ties keep their order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    size = 1 << max(0, (len(rest) - 1).bit_length())
    room = [capacity] * (2 * size)
    sizes = lengths.tolist()
    used = 0
    for p in rest:
        need, node = sizes[p], 1
        while node < size:  # the leftmost leaf with room
            node *= 2
            if room[node] < need:
                node += 1
        bins[p], offsets[p] = full + node - size, capacity - room[node]
        used = max(used, node - size + 1)
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets, full + used


def place(pieces: DataFrame, documents: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; pieces need ``row``, ``start`` and ``length``.

    ``documents``: how many documents there are, which sets the number of groups.
    """
    groups = max(1, -(-documents // group))
    return fill(pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")), capacity)


def place_apart(pieces: DataFrame, docs: DataFrame, kind: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """As ``place``, but no sequence holds two values of the column ``kind`` of ``docs``, which pieces carry.

    There is one row a kind; kinds are meant to be few enough to be broadcast.
    """
    other, groups, before = fresh(pieces, "other", "groups", "before")
    sizes = docs.groupBy(F.col(kind).alias(other)).agg(F.ceil(F.count("*") / group).alias(groups))
    # Groups are numbered through, so that sequences of two kinds never share a number.
    sizes = sizes.withColumn(before, F.sum(groups).over(Window.orderBy(other)) - F.col(groups))
    dealt = pieces.join(F.broadcast(sizes), F.col(kind).eqNullSafe(F.col(other)))
    return fill(dealt.withColumn("group", F.col(before) + F.pmod(F.xxhash64("row"), F.col(groups))).drop(other, groups, before), capacity)


def fill(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack each group on its own; ``group``, a long, goes into the numbers of its sequences."""

    def pack(data: pa.Table) -> pa.Table:
        data = data.sort_by([("row", "ascending"), ("start", "ascending")])
        bins, offsets, _ = first_fit_decreasing(data.column("length").to_numpy(), capacity)
        return data.append_column("sequence_id", pa.array((data.column("group")[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", sequence_id long, offset long"
    return keyed.groupBy("group").applyInArrow(pack, schema).drop("group")


def pack_documents(docs: DataFrame, keep_ids: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """All documents packed: one row per piece, with its ids unless ``keep_ids`` is false."""
    pieces = token_pieces(docs, capacity)
    return place(pieces if keep_ids else pieces.drop("ids"), docs.count(), capacity)
