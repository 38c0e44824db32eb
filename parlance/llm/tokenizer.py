"""Byte-level BPE ids for whole texts, inside a Python worker.

The ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json``.  The
merges run through the rank file of the same vocabulary, several times faster,
and the few texts that hold the special token's string go to ``tokenizers``
itself.  Tests hold both against each other.

A text is cut at single blanks: there the pre-tokenizer always starts anew, so
a blank and the run after it have the same ids everywhere and can be kept in a
bounded cache.  Texts where a blank meets other white space go through whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np

SPECIAL = "<|endoftext|>"
#: Cached runs in one worker; the cache starts anew when full.
CACHE = 200_000


class Runs(dict):
    """Ids (little-endian uint32 bytes) of a blank and a run of other characters.

    None for a run whose ids depend on what stands beside it.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes | None:
        if len(self) >= CACHE:
            self.clear()
        self[run] = ids = None if run.strip() != run or not run else self.encode(" " + run)
        return ids


class Encoder:
    def __init__(self, path: Callable[[str], str], name: str, pattern: str):
        import tiktoken

        with open(path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ordinary = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = lambda text: np.array(ordinary(text), "<u4").tobytes()
        self.runs = Runs(self.whole)
        self.path, self.name, self.slow = path, name, None

    def __call__(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian uint32 bytes."""
        if SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path(f"{self.name}.json"))
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *runs = text.split(" ")
        if first.strip() == first:
            try:
                return self.whole(first) + b"".join(map(self.runs.__getitem__, runs))
            except TypeError:  # a None among the runs
                pass
        return self.whole(text)
