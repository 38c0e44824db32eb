"""SentencePiece encoding and decoding with a batched Viterbi search.

Distinct pre-tokens of equal length advance together through numpy: at each
place the hash of every substring that ends there, one for each word and piece
length, is looked up in the sorted hashes of the pieces of that length (after a
table of their leading bits has ruled most out); the best score and the length of
its last piece are kept as arrays.  Going back along the lengths gives the ids of
all words at once.  A hit counts only if the piece is the substring, code point
for code point.

A pre-token of more than ``LONG`` characters has no equals to advance with.  Its
substrings are looked up for a window of places at once, and one pass over the
hits carries the last few scores from window to window, so its memory is a few
bytes a character and its time is in proportion to its length.

Encoded pre-tokens stay with the worker, bounded; documents are their ids side
by side.  Nothing is shuffled.

Defined cases: null or empty text has no ids and decodes to the empty text;
null ids decode to the empty text; U+2581 in a text decodes to a blank; bytes
that are no UTF-8 decode to U+FFFD; a null doc_id passes through; repeated rows
are encoded one by one; an empty table gives an empty result; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import bounded_batches, worker_cache
from parlance.llm.unigram import KEPT, LONG, VOCABULARY, Pieces, kept_pieces, pretokens

BASE = 0x9E3779B97F4A7C15
#: Characters of equally long words searched at once, and places of a long word.
AT_ONCE, WINDOW = 1 << 17, 1 << 14
#: Characters of text worked on at once.
PART = 1 << 21


class Viterbi:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.shift = np.uint64(46)
        self.power = np.array([pow(BASE, k, 1 << 64) for k in range(pieces.longest + 1)], np.uint64)
        by_length: dict[int, list[str]] = {}
        for p in pieces.id:
            by_length.setdefault(len(p), []).append(p)
        self.keys = {}
        for n, group in sorted(by_length.items(), reverse=True):
            codes = self.codes(group, n)
            h = self.hashes(codes)[n]
            o = np.argsort(h)
            some = np.zeros(1 << 18, bool)
            some[(h >> self.shift).view(np.int64)] = True
            self.keys[n] = h[o], np.array([pieces.score[p] for p in group])[o], np.array([pieces.id[p] for p in group])[o], codes[o], some
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in by_length.get(1, [])]] = True

    @staticmethod
    def codes(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
        for k in range(codes.shape[1]):
            out[k + 1] = out[k] * self.power[1] + codes[:, k] + np.uint64(1)
        return out

    def hits(self, wanted: np.ndarray, size: int, substrings: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are a piece's of that size: (place in ``wanted``, place in the keys)."""
        keys, _, _, texts, some = self.keys[size]
        at = np.flatnonzero(some[(wanted >> self.shift).view(np.int64)])
        found = np.minimum(np.searchsorted(keys, wanted[at]), len(keys) - 1)
        hit = keys[found] == wanted[at]
        at, found = at[hit], found[hit]
        true = (substrings(at) == texts[found]).all(axis=1)
        return at[true], found[true]

    def equal_length(self, words: list[str], length: int) -> list[bytes]:
        n, rows = len(words), np.arange(len(words))
        codes = self.codes(words, length)
        h = self.hashes(codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, ids = np.zeros((length + 1, n), np.uint8), np.zeros((length + 1, n), np.int32)
        for end in range(1, length + 1):
            top = best[end]
            for size in self.keys:  # the longest first
                if size > end:
                    continue
                at, found = self.hits(h[end] - h[end - size] * self.power[size], size, lambda at: codes[at, end - size : end])  # noqa: B023
                score = best[end - size, at] + self.keys[size][1][found]
                better = score > top[at]
                at, found = at[better], found[better]
                top[at], back[end, at], ids[end, at] = score[better], size, self.keys[size][2][found]
            alone = ~self.single[codes[:, end - 1]]
            if alone.any():
                alone &= best[end - 1] + self.pieces.unknown > top
                top[alone], back[end, alone], ids[end, alone] = best[end - 1, alone] + self.pieces.unknown, 1, -1
        place, found = np.full(n, length), []
        while place.any():
            open_ = rows[place > 0]
            end = place[open_]
            found.append((open_, end, ids[end, open_]))
            place[open_] = end - back[end, open_]
        row, end, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
        o = np.lexsort((end, row))
        row, end, piece = row[o], end[o], piece[o]
        cut = np.searchsorted(row, np.arange(n + 1)).tolist()
        odd = set(np.unique(row[piece < 0]).tolist())  # words with a character that is no piece
        blob = piece.astype("<i4").tobytes()
        return [self.spelled(words[k], end[s:e], piece[s:e]) if k in odd else blob[4 * s : 4 * e] for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False))]

    def spelled(self, word: str, end: np.ndarray, piece: np.ndarray) -> bytes:
        got: list[int] = []
        for e, p in zip(end.tolist(), piece.tolist(), strict=True):
            got += [p] if p >= 0 else self.pieces.spell(word[e - 1])
        return np.array(got, "<i4").tobytes()

    def long_word(self, word: str) -> bytes:
        longest, unknown = self.pieces.longest, self.pieces.unknown
        back, ids = np.zeros(len(word) + 1, np.uint8), np.zeros(len(word) + 1, np.int32)
        scores = [0.0]  # of the last places before a window
        for lo in range(0, len(word), WINDOW):
            hi, first = min(len(word), lo + WINDOW), max(0, lo - longest + 1)
            codes = self.codes([word[first:hi]], hi - first)[0]
            views = np.lib.stride_tricks.sliding_window_view
            ends, starts, sizes, values, pieces = [], [], [], [], []
            h = np.zeros(len(codes), np.uint64)
            for size in range(1, longest + 1):  # grow each substring by the character before it
                if size > len(codes):
                    break
                h[size - 1 :] += (codes[: len(codes) - size + 1] + np.uint64(1)) * self.power[size - 1]
                if size in self.keys:
                    at, found = self.hits(h[size - 1 :], size, lambda at: views(codes, size)[at])  # noqa: B023
                    fresh = first + at + size > lo
                    at, found = at[fresh], found[fresh]
                    ends.append(first + at + size)
                    sizes.append(np.full(len(at), size))
                    values.append(self.keys[size][1][found])
                    pieces.append(self.keys[size][2][found])
            at = np.flatnonzero(~self.single[codes[lo - first :]])
            ends.append(lo + at + 1)
            sizes.append(np.ones(len(at), np.int64))
            values.append(np.full(len(at), unknown))
            pieces.append(np.full(len(at), -1))
            end, size, value, piece = map(np.concatenate, (ends, sizes, values, pieces))
            o = np.lexsort((-size, end))
            base = lo - len(scores) + 1  # the place that scores[0] stands for
            for e, s, v, p in zip(end[o].tolist(), size[o].tolist(), value[o].tolist(), piece[o].tolist(), strict=True):
                while len(scores) <= e - base:
                    scores.append(-np.inf)
                total = scores[e - s - base] + v
                if total > scores[e - base]:
                    scores[e - base], back[e], ids[e] = total, s, p
            scores = scores[-longest:]
        end, path = len(word), []
        while end:
            path.append(end)
            end -= int(back[end])
        path = np.array(path[::-1])
        return self.spelled(word, path, ids[path])

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as little-endian int32 bytes."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for length, group in by_length.items():
            if length > LONG:
                out.update((w, self.long_word(w)) for w in group)
                continue
            step = AT_ONCE // length
            for s in range(0, len(group), step):
                out.update(zip(group[s : s + step], self.equal_length(group[s : s + step], length), strict=True))
        return out


def texts_of(ids: list[np.ndarray], pieces: Pieces) -> list[str]:
    spelled, out = pieces.bytes, []
    for values in ids:
        values = values[(values >= 0) & (values < len(spelled))]
        out.append(b"".join(map(spelled.__getitem__, values.tolist())).decode("utf-8", "replace").removeprefix(" "))
    return out


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``PART`` characters."""
    lo, held = 0, 0
    for k, size in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + size > PART:
            yield lo, k
            lo, held = k, 0
        held += size
    if len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, path: Callable[[str], str] = public_tokenizers.path, round_trip: bool = False) -> DataFrame:
    """Add ``ids`` (array<int>) for whole texts; ``text`` stays.

    With ``round_trip``, ``decoded`` too: the text of the ids, in the same worker.
    """

    def batch_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()
        pieces, stored = kept_pieces(kept, path, vocabulary), kept.setdefault(("encoded", vocabulary), {})
        if ("viterbi", vocabulary) not in kept:
            kept["viterbi", vocabulary] = Viterbi(pieces)
        search = kept["viterbi", vocabulary]
        for batch in batches:
            for lo, hi in parts(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                split = [pretokens(t or "") for t in part.column(text).to_pylist()]
                new = set().union(*split) - stored.keys()
                if len(stored) + len(new) > KEPT:
                    stored.clear()
                    new = set().union(*split)
                stored.update(search.encode(sorted(new)))
                blobs = [b"".join(map(stored.__getitem__, w)) for w in split]
                for w in [w for w in new if len(w) > LONG]:
                    del stored[w]
                offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
                back = [pa.array(texts_of([np.frombuffer(b, "<i4") for b in blobs], pieces), pa.string())] if round_trip else []
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], ids, *back], [*rest, *made])

    made = ["ids", *(["decoded"] if round_trip else [])]
    rest = [c for c in docs.columns if c not in made]
    bounded_batches(docs.sparkSession)
    docs = docs.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(batch_ids, schema + ", ids array<int>" + (", decoded string" if round_trip else ""))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, path: Callable[[str], str] = public_tokenizers.path) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; ids outside the table are left out."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_pieces(worker_cache(), path, vocabulary)
        for batch in batches:
            ids = [i.values.to_numpy(zero_copy_only=False) if i.is_valid else np.zeros(0, np.int32) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts_of(ids, pieces), pa.string())], [*rest, "decoded"])

    rest = [c for c in encoded.columns if c != "decoded"]
    bounded_batches(encoded.sparkSession)
    encoded = encoded.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(texts, schema + ", decoded string")
