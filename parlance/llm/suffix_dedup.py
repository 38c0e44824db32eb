"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a ``span``-byte string that also starts in a document with
a smaller doc_id is removed; strings are compared on the input.  Texts are UTF-8
bytes and no match crosses documents.

1. Anchors.  The smallest hash among the ``GRAM``-byte strings of a window of
   ``span`` bytes is its anchor, so equal windows have equal anchors.  Anchors
   meet by hash; those of one document only are dropped, which leaves only text
   that is likely repeated.  About one anchor stands for sixteen bytes.
2. Suffix arrays of groups.  What is left of a group's documents is sorted in two
   stages: suffixes smaller than their successor directly, all others induced by
   one scan over the buckets of first bytes.  The common prefixes of neighbours
   follow; neighbours that share ``span`` bytes are equal windows, and the smallest
   doc_id among them keeps its bytes.  The windows of all others are decided.
3. Suffix arrays of buckets.  A maximal run of undecided windows with one anchor is
   one string.  These strings meet by anchor and are sorted in the same way, so a
   window costs one string a group here, however many documents hold it: copies
   and hot passages of a third of all rows do not gather in one bucket.
4. Covered intervals return to their documents.

Documents are dealt to groups of bounded size once; all passes read that one
exchange.  Between passes travel packed rows (a group's part for a bucket), a
few bytes an anchor.

Suffix arrays decide every byte.  With ``reduce=True`` exact copies go first: of
equal texts only the one with the smallest doc_id is sorted, every other is removed
whole if it has ``span`` bytes.  The result is the same, and tests hold both together.

Defined cases: null text is empty; texts shorter than ``span`` bytes stay; rows
with a null doc_id, having no order, stay whole and take from no other; rows with equal doc_id are
documents of their own that do not remove each other's bytes unless equal texts
stand under a smaller doc_id; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bounded_batches, by_class, durable, shuffle_width, text_or_empty

SPAN, GRAM = 50, 20
#: Bytes of text in one group of documents, and in one bucket of runs.
GROUP_BYTES, BUCKET_BYTES, SLICE = 4 << 20, 3 << 20, 1 << 19
KIND = "kind int, g long, key long, n long, a binary, b binary, c binary, d binary, e binary"
COPY, ENTRY, DECIDED = 0, 1, 2


# ---- suffix arrays ---------------------------------------------------------


def words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number (zeros at the end)."""
    padded = np.concatenate((t, np.zeros(SPAN + 16, np.uint8)))
    return np.ndarray((len(padded) - 8,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def offsets(span: int) -> list[int]:
    """Where to read eight-byte words so that together they cover ``span`` bytes."""
    return [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]


def sort_directly(pos: np.ndarray, w: np.ndarray, span: int) -> np.ndarray:
    """Sort suffixes by their first ``span`` bytes, opening only ties further."""
    pos = pos[np.argsort(w[pos], kind="stable")]
    key = w[pos]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(pos) else np.zeros(0, bool)
    off = 8
    while off < span:
        tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(tied):
            break
        # One number holds the tie and as many of the next bytes as fit; it is nearly in order already.
        sub, tie = pos[tied], np.cumsum(new[tied]).astype(np.uint64)
        free = (64 - int(tie[-1]).bit_length()) // 8
        key = tie << np.uint64(8 * free) | w[sub + off] >> np.uint64(64 - 8 * free)
        o = np.argsort(key, kind="stable")
        pos[tied], key = sub[o], key[o]
        new[tied[1:]] |= key[1:] != key[:-1]
        off += free
    return pos


def suffix_array(t: np.ndarray, w: np.ndarray, span: int = SPAN, asked: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of ``t`` in the order of their first ``span`` bytes, at least.

    With a mask ``asked``, only these suffixes and those that induce them: a suffix
    larger than its successor needs all up to the next smaller one, no others.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    # The first later place where the byte changes tells a suffix's type.
    change = np.where(np.concatenate((t[:-1] != t[1:], [True])), np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    after = np.concatenate((t, [0]))[change + 1].astype(np.int16)
    after[change == n - 1] = -1
    smaller = t < after  # smaller than its successor
    if asked is None:
        asked = np.ones(n, bool)
    # Larger suffixes and the smaller one that ends them form a row; what follows an asked one there takes part.
    row = np.maximum.accumulate(np.where(np.concatenate(([True], smaller[:-1])), np.arange(n), 0))
    part = np.maximum.accumulate(np.where(asked, np.arange(n), -1)) >= row
    direct = sort_directly(np.flatnonzero(smaller & part), w, span)
    ends = np.cumsum(np.bincount(t[direct], minlength=256))
    placed: dict[int, list[np.ndarray]] = defaultdict(list)
    if part[n - 1]:
        placed[int(t[n - 1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        larger = placed.pop(c, [])
        new = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        while len(new):  # runs of one byte feed their own bucket
            new = new[new > 0] - 1
            new = new[(t[new] == c) & part[new]]
            larger.append(new)
        bucket = np.concatenate([*larger, direct[ends[c - 1] if c else 0 : ends[c]]]).astype(np.int64)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = t[before]
        larger = (first > c) & part[before]
        before, first = before[larger], first[larger]
        o = np.argsort(first, kind="stable")
        before, first = before[o], first[o]
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else []
        for s, e in zip(cut, [*cut[1:], len(first)], strict=True) if len(first) else ():
            placed[int(first[s])].append(before[s:e])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(a: np.ndarray, b: np.ndarray, w: np.ndarray, span: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, ``span`` at most."""
    length = np.full(len(a), span)
    left = np.arange(len(a))
    for off in offsets(span):
        x = w[a[left] + off] ^ w[b[left] + off]
        unlike = x != 0
        x = x[unlike]
        high = x >> np.uint64(32)
        # The exponent of a number below 2**32 is exact; it tells the first byte that differs.
        bits = np.frexp(np.where(high > 0, high, x).astype(np.float64))[1]
        length[left[unlike]] = off + (np.where(high > 0, 32, 64) - bits) // 8
        left = left[~unlike]
    return length


def smallest_holder(texts: list[bytes], holder: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the strings that a string with a smaller holder also has.

    Returns (string, first window, last window) of each maximal run of such windows.
    """
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    t = np.frombuffer(b"".join(texts), np.uint8)
    w = words(t)
    source = np.repeat(np.arange(len(texts)), length)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    whole = np.arange(len(t)) - start[source] + span <= length[source]
    sa = suffix_array(t, w, span, whole)
    sa = sa[whole[sa]]
    same = common_prefixes(sa[:-1], sa[1:], w, span) >= span
    cut = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(holder[source[sa]], cut)
    least = np.repeat(least, np.diff(np.concatenate((cut, [len(sa)]))))
    mark = np.zeros(len(t), bool)
    mark[sa[least < holder[source[sa]]]] = True
    hit = np.flatnonzero(mark)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    edge = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (source[hit[1:]] != source[hit[:-1]])))
    first = hit[edge]
    last = hit[np.concatenate((np.flatnonzero(edge)[1:] - 1, [len(hit) - 1]))]
    s = source[first]
    return s, first - start[s], last - start[s]


# ---- anchors ---------------------------------------------------------------


def anchor_runs(blob: bytes, lengths: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor: (document, first, last window, hash).

    ``blob``: documents side by side; windows are counted from each one's start.
    """
    n = len(blob)
    buf = blob + b"\0" * 32
    w8 = np.ndarray((n + 16,), "<u8", buf, strides=(1,)).astype(np.uint64)
    h = w8[: n + 8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += w8[8 : n + 16] * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    tail = np.ndarray((n + 8,), "<u4", buf, offset=gram - 4, strides=(1,)).astype(np.uint64)
    h += tail * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    place = np.uint64((1 << 21) - 1)
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width, have, m = span - gram + 1, 1, v
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: -(width - have)], m[width - have :])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    windows = np.maximum(lengths - span + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    p = starts[doc] + at
    anchor = (m[p] & place).astype(np.int64)
    if not len(p):
        return doc, at, at, h[:0]
    edge = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    i = np.flatnonzero(edge)
    j = np.concatenate((i[1:] - 1, [len(p) - 1]))
    return doc[i], at[i], at[j], h[anchor[i]]


def slices(sizes: list[int], most: int = SLICE) -> list[tuple[int, int]]:
    out, lo, held = [], 0, 0
    for k, s in enumerate(sizes):
        if held and held + s > most:
            out.append((lo, k))
            lo, held = k, 0
        held += s
    return [*out, (lo, len(sizes))] if len(sizes) else out


def windows_of(blob: bytes) -> list[tuple[int, bytes]]:
    """A long document in overlapping parts, so that no part exceeds a slice."""
    if len(blob) <= SLICE:
        return [(0, blob)]
    return [(s, blob[s : s + SLICE + SPAN - 1]) for s in range(0, len(blob), SLICE) if len(blob) - s >= SPAN]


class Group:
    """The documents of one group in a fixed order, without copies and short ones."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        self.docs = docs.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        self.ids = self.docs.column("doc_id").to_numpy()
        self.blobs = [b or b"" for b in self.docs.column("bytes").to_pylist()]
        copies = notes.filter(pa.compute.equal(notes.column("kind"), COPY))
        listed = set(zip(copies.column("key").to_pylist(), copies.column("a").to_pylist(), strict=True))
        digests = self.docs.column("digest").to_pylist()
        self.copy = np.array([x in listed for x in zip(self.ids.tolist(), digests, strict=True)], bool)
        self.notes = notes

    def runs(self):
        """Yield (document, first, last window, hash) arrays, a slice of text at a time."""
        parts = [(k, s, b) for k, blob in enumerate(self.blobs) if not self.copy[k] and len(blob) >= SPAN for s, b in windows_of(blob)]
        for lo, hi in slices([len(b) for _, _, b in parts]):
            part = parts[lo:hi]
            i, first, last, h = anchor_runs(b"".join(b for _, _, b in part), np.array([len(b) for _, _, b in part]))
            index, base = np.array([k for k, _, _ in part]), np.array([s for _, s, _ in part])
            yield index[i], first + base[i], last + base[i], h


def decided_windows(group: Group, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those windows of the runs (in order) that a document of the same group with a smaller id has too.

    Runs that follow each other form one stretch of text, so no byte is sorted twice.
    """
    edge = np.concatenate(([True], (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1) | (first[1:] // SLICE != first[:-1] // SLICE)))
    i = np.flatnonzero(edge)
    doc, first, end = doc[i], first[i], last[np.concatenate((i[1:] - 1, [len(edge) - 1]))] + SPAN
    out = []
    for lo, hi in slices((end - first).tolist(), GROUP_BYTES):
        holder = group.ids[doc[lo:hi]]
        if (holder != holder[0]).any():
            texts = [group.blobs[d][f:e] for d, f, e in zip(doc[lo:hi].tolist(), first[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
            k, a, b = smallest_holder(texts, holder)
            out.append((doc[lo + k], first[lo + k] + a, first[lo + k] + b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def undecided(doc: np.ndarray, first: np.ndarray, last: np.ndarray, gone_doc: np.ndarray, gone_first: np.ndarray, gone_last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of each run without the windows that are gone: (run, first, last)."""
    n = last - first + 1
    base = np.cumsum(n) - n
    at = np.searchsorted(doc << 40 | first, gone_doc << 40 | gone_first, side="right") - 1
    start = base[at] + gone_first - first[at]
    step = np.zeros(n.sum() + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + gone_last - gone_first + 1, -1)
    left = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    run = np.repeat(np.arange(len(n)), n)[left]
    edge = np.concatenate(([True], (left[1:] != left[:-1] + 1) | (run[1:] != run[:-1])))[: len(left)]
    i = np.flatnonzero(edge)
    run = run[i]
    j = np.concatenate((i[1:] - 1, [len(left) - 1]))[: len(i)]
    return run, first[run] + left[i] - base[run], first[run] + left[j] - base[run]


def hash_parts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, and 40 more bits of the hash in two arrays."""
    return (h >> np.uint64(44)).astype(np.int64) % buckets, (h & np.uint64(0xFFFFFFFF)).astype("<u4"), ((h >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)


def packed(rows: list[tuple]) -> pa.Table:
    names = ["kind", "g", "key", "n", "a", "b", "c", "d", "e"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def by_key(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    o = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], keys[o][1:] != keys[o][:-1]))) if len(o) else []
    return [(int(keys[o[s]]), o[s:e]) for s, e in zip(cut, [*cut[1:], len(o)], strict=True)] if len(o) else []


def joined(notes: pa.Table, kind: int, column: str, dtype: str) -> np.ndarray:
    picked = notes.filter(pa.compute.equal(notes.column("kind"), kind))
    return np.frombuffer(b"".join(picked.column(column).to_pylist()), dtype)


def repeated_spans(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False, reduce: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, spans (start, end), kept (binary), carry.

    With ``as_text``, kept is a string, and a character that lost a byte goes
    whole.  ``carry`` is a struct of the columns so named, which travel with the texts.
    """
    spark = docs.sparkSession
    base = docs.where("doc_id is not null").select("doc_id", text_or_empty().cast("binary").alias("bytes"), F.struct(F.lit(None).cast("string").alias("_"), *carry).alias("carry"))
    bounded_batches(spark)
    total, rows = base.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)), F.count("*")).first()
    groups = max(shuffle_width(spark), -(-total // GROUP_BYTES))
    buckets = max(shuffle_width(spark), -(-total // BUCKET_BYTES))
    dealt = base.select("doc_id", F.unhex(F.md5("bytes")).alias("digest"), "bytes", "carry", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long").alias("g"))

    keys = durable(dealt.select("doc_id", "digest", "g"))
    least = keys.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where(F.col("n") > 1 if reduce else F.lit(False))
    copies = by_class(keys, least, "digest", rows).where("doc_id > least").select(
        F.lit(COPY).alias("kind"), (F.col("g") + 0).alias("g"), F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("n"), F.col("digest").alias("a"),
        *[F.lit(None).cast("binary").alias(c) for c in "bcde"],
    )

    def anchors(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return packed([])
        group, g = Group(docs, notes), docs.column("g")[0].as_py()
        found = list(group.runs())
        if not found:
            return packed([])
        doc, h = np.concatenate([x[0] for x in found]), np.concatenate([x[3] for x in found])
        o = np.lexsort((doc, h))
        doc, h = doc[o], h[o]
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        doc, h = doc[keep], h[keep]
        first = np.concatenate(([True], h[1:] != h[:-1]))
        several = first & np.concatenate((~first[1:], [False]))
        bucket, low, high = hash_parts(h, buckets)
        rows = []
        for kind, mask in ((ENTRY, first), (DECIDED, ~first)):
            # What is decided here needs no company: it is dealt out evenly.
            where = np.flatnonzero(mask)
            for b, i in by_key(bucket[where] if kind == ENTRY else (bucket[where] + g) % buckets):
                i = where[i]
                rows.append((kind, b, g, len(i), low[i].tobytes(), high[i].tobytes(), doc[i].astype("<u4" if len(group.ids) > 65535 else "<u2").tobytes(), np.packbits(several[i]).tobytes(), bucket[i].astype("<u4").tobytes() if kind == DECIDED else None))
        return packed(rows)

    def meet(notes: pa.Table) -> pa.Table:
        """Anchors of two documents or more, sent back to their groups."""
        rows, entries = [], []
        for kind, b, g, n, low, high, doc, several, bucket in zip(*[notes.column(c).to_pylist() for c in ("kind", "g", "key", "n", "a", "b", "c", "d", "e")], strict=True):
            if kind == DECIDED:
                rows.append((ENTRY, g, b, n, low, high, doc, bucket, None))
            else:
                entries.append((b, g, n, low, high, doc, np.unpackbits(np.frombuffer(several, np.uint8), count=n)))
        if entries:
            low = np.frombuffer(b"".join(x[3] for x in entries), "<u4").astype(np.uint64)
            high = np.frombuffer(b"".join(x[4] for x in entries), np.uint8).astype(np.uint64)
            key, several = high << np.uint64(32) | low, np.concatenate([x[6] for x in entries])
            o = np.argsort(key, kind="stable")
            k = key[o]
            edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.concatenate((edge, [len(k)])))
            many = np.empty(len(k), bool)
            many[o] = np.repeat((size > 1) | (np.add.reduceat(several[o].astype(np.int64), edge) > 0), size)
            at = 0
            for b, g, n, low, high, doc, _ in entries:
                m, at = many[at : at + n], at + n
                if m.any():
                    d = np.frombuffer(doc, "<u4" if len(doc) == 4 * n else "<u2")[m]
                    rows.append((ENTRY, g, b, len(d), np.frombuffer(low, "<u4")[m].tobytes(), np.frombuffer(high, np.uint8)[m].tobytes(), d.tobytes(), np.full(len(d), b, "<u4").tobytes(), None))
        return packed(rows)

    def strings(docs: pa.Table, notes: pa.Table) -> pa.Table:
        """Runs whose anchor several documents have, one for each distinct string."""
        if not len(docs):
            return packed([])
        group, g = Group(docs, notes), docs.column("g")[0].as_py()
        listed = notes.filter(pa.compute.equal(notes.column("kind"), ENTRY))
        if not len(listed):
            return packed([])
        key = lambda d, b, low, high: ((d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) << np.uint64(40)) ^ (high.astype(np.uint64) << np.uint64(32)) ^ low.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        wanted = np.sort(np.concatenate([
            key(np.frombuffer(d, "<u4" if len(d) == 4 * n else "<u2"), np.frombuffer(b, "<u4"), np.frombuffer(low, "<u4"), np.frombuffer(high, np.uint8))
            for n, low, high, d, b in zip(*[listed.column(c).to_pylist() for c in ("n", "a", "b", "c", "d")], strict=True)
        ]))
        found = []
        for doc, first, last, h in group.runs():
            bucket, low, high = hash_parts(h, buckets)
            k = key(doc, bucket, low, high)
            hit = wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k
            found.append((doc[hit], first[hit], last[hit], bucket[hit]))
        doc, first, last, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(doc):
            return packed([])
        gone = decided_windows(group, doc, first, last)
        d, f, n = gone[0], gone[1], gone[2] - gone[1] + SPAN
        spread = (np.arange(len(d)) // 4096 + g) % buckets
        rows = [(DECIDED, b, g, len(i), d[i].astype("<u4").tobytes(), f[i].astype("<u4").tobytes(), n[i].astype("<u4").tobytes(), None, None) for b, i in by_key(spread)]
        run, first, last = undecided(doc, first, last, *gone)
        doc, bucket, size = doc[run], bucket[run], last - first + SPAN
        texts = [group.blobs[d][f : f + n] for d, f, n in zip(doc.tolist(), first.tolist(), size.tolist(), strict=True)]
        rows += [(ENTRY, k, g, len(i), doc[i].astype("<u4").tobytes(), first[i].astype("<u4").tobytes(), size[i].astype("<u4").tobytes(), group.ids[doc[i]].astype("<i8").tobytes(), b"".join([texts[x] for x in i.tolist()])) for k, i in by_key(bucket)]
        return packed(rows)

    def sort_strings(notes: pa.Table) -> pa.Table:
        """Covered intervals of one bucket's runs, sent back to their groups."""
        source, doc, start, holder, texts, marks = [], [], [], [], [], []
        for kind, g, n, d, f, size, ids, text in zip(*[notes.column(c).to_pylist() for c in ("kind", "key", "n", "a", "b", "c", "d", "e")], strict=True):
            size = np.frombuffer(size, "<u4").astype(np.int64)
            if kind == DECIDED:
                marks.append((np.full(n, g), np.frombuffer(d, "<u4"), np.frombuffer(f, "<u4"), size))
                continue
            cut = np.concatenate(([0], np.cumsum(size))).tolist()
            source.append(np.full(n, g))
            doc.append(np.frombuffer(d, "<u4"))
            start.append(np.frombuffer(f, "<u4"))
            holder.append(np.frombuffer(ids, "<i8"))
            texts += [text[s:e] for s, e in zip(cut, cut[1:], strict=False)]
        if source:
            source, doc, start, holder = map(np.concatenate, (source, doc, start, holder))
            s, first, last = smallest_holder(texts, holder)
            marks.append((source[s], doc[s], start[s] + first, last - first + SPAN))
        if not marks:
            return packed([])
        g, d, f, n = (np.concatenate([m[k] for m in marks]).astype(np.int64) for k in range(4))
        return packed([(ENTRY, k, 0, len(i), d[i].astype("<u4").tobytes(), f[i].astype("<u4").tobytes(), n[i].astype("<u4").tobytes(), None, None) for k, i in by_key(g)])

    def remove(docs: pa.Table, notes: pa.Table) -> pa.Table:
        group = Group(docs, notes) if len(docs) else None
        out = ([], [], [], [], [])
        d, f, n = (joined(notes, ENTRY, c, "<u4").astype(np.int64) for c in "abc")
        marks = dict(by_key(d))
        for k, blob in enumerate(group.blobs if group else ()):
            if group.copy[k] and len(blob) >= SPAN:
                edges, kept = [(0, len(blob))], b""
            elif k in marks:
                i = marks[k]
                step = np.zeros(len(blob) + 1, np.int32)
                np.add.at(step, f[i], 1)
                np.add.at(step, f[i] + n[i], -1)
                gone = np.cumsum(step[:-1]) > 0
                flips = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                edges = list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))
                kept = np.frombuffer(blob, np.uint8)[~gone].tobytes()
            else:
                edges, kept = [], blob
            for column, value in zip(out, (group.ids[k], len(blob), len(blob) - len(kept), [{"start": s, "end": e} for s, e in edges], kept.decode("utf-8", "ignore") if as_text else kept), strict=True):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), span, pa.string() if as_text else pa.binary()), strict=True)]
        return pa.table([*columns, (group.docs if group else docs).column("carry")], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "carry"])

    texts = dealt.groupBy("g")
    found = texts.cogroup(copies.groupBy("g")).applyInArrow(anchors, KIND)
    several = found.groupBy("g").applyInArrow(meet, KIND)
    runs = texts.cogroup(several.unionByName(copies).groupBy("g")).applyInArrow(strings, KIND)
    marks = runs.groupBy("g").applyInArrow(sort_strings, KIND)
    out = f"doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept {"string" if as_text else "binary"}, carry {dealt.schema['carry'].dataType.simpleString()}"
    # Rows without an id have no place in the order; they stay whole.
    kept = text_or_empty() if as_text else text_or_empty().cast("binary")
    whole = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), kept.alias("kept"), F.struct(F.lit(None).cast("string").alias("_"), *carry).alias("carry"),
    )
    return texts.cogroup(marks.unionByName(copies).groupBy("g")).applyInArrow(remove, out).unionByName(whole)
