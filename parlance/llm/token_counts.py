"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct new pre-tokens of a batch form a trie.  The forward score of a node,
the best score of any segmentation of the characters on the way to it, depends
on nothing below; it is computed once for all pre-tokens that share the prefix,
along with the number of tokens on the best way.  Where a pre-token ends, its
count is stored, and a document's count is a sum of stored counts.

The trie is walked in the order of its sorted pre-tokens, keeping the scores of
the current path only.  Counts stay with the worker for later batches, bounded.
No row leaves its place: the operator shuffles nothing.

Defined cases: null or empty text has 0 tokens; a null doc_id passes through;
repeated rows are counted one by one; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bounded_batches, fresh, worker_cache
from parlance.llm.unigram import KEPT, LONG, VOCABULARY, Pieces, kept_pieces, pretokens


def count_in_trie(distinct: list[str], pieces: Pieces) -> dict[str, int]:
    """Tokens of each pre-token; ``distinct`` in any order, without repeats."""
    score, longest, unknown = pieces.score.get, pieces.longest, pieces.unknown
    best, count, path, out = [0.0], [0], "", {}
    for word in sorted(distinct):
        depth, most = 0, min(len(word), len(path))
        while depth < most and word[depth] == path[depth]:
            depth += 1
        del best[depth + 1 :], count[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):  # nodes below the shared prefix
            top, n = -1e308, 0
            for start in range(max(0, end - longest), end):
                s = score(word[start:end])
                if s is not None and best[start] + s > top:
                    top, n = best[start] + s, count[start] + 1
            if word[end - 1 : end] not in pieces.id and best[end - 1] + unknown > top:
                top, n = best[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            count.append(n)
        out[word] = count[len(word)]
        path = word
    return out


def with_token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, path: Callable[[str], str] = public_tokenizers.path) -> DataFrame:
    """Add ``n_pretokens`` and ``n_tokens`` for whole texts."""

    def each(s: pd.Series) -> pd.DataFrame:
        kept = worker_cache()
        pieces, stored = kept_pieces(kept, path, vocabulary), kept.setdefault(("token counts", vocabulary), {})
        tokens, words = [], []
        for lo in range(0, len(s), 512):
            split = [pretokens(t or "") for t in s.iloc[lo : lo + 512]]
            new = set().union(*split) - stored.keys()
            if len(stored) + len(new) > KEPT:
                stored.clear()
                new = set().union(*split)
            stored.update(count_in_trie(list(new), pieces))
            words += map(len, split)
            tokens += [sum(map(stored.__getitem__, w)) for w in split]
            for w in [w for w in new if len(w) > LONG]:
                del stored[w]
        return pd.DataFrame({"n_pretokens": words, "n_tokens": tokens})

    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_pretokens", "n_tokens")]
    counted = F.pandas_udf(each, "n_pretokens long, n_tokens long")(text)
    (both,) = fresh(docs, "counted")
    return docs.select(*rest, counted.alias(both)).select(*rest, f"{both}.n_pretokens", f"{both}.n_tokens")
