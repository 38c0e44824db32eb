"""Plain one-machine versions that the operators are held against."""

import re

import numpy as np
import xxhash


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum((h >> b) & 1 for h in hashes) * 2 > n)


def components(ids, fps, most):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, fa in zip(ids, fps):
        for b, fb in zip(ids, fps):
            if a < b and (fa ^ fb).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeated(docs, span=50):
    """{doc_id: (removed, kept bytes)} by a table of all windows."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        step = np.zeros(len(b) + 1, int)
        for i in range(len(b) - span + 1):
            if seen.setdefault(b[i : i + span], doc) < doc:
                step[i] += 1
                step[i + span] -= 1
        gone = np.cumsum(step)[:-1] > 0
        out[doc] = int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()
    return out


def pipeline_lines(rows, percent=10, least=5):
    pages, seen = {}, {}
    for _, source, text in rows:
        pages[source] = pages.get(source, 0) + 1
        for line in set(text.split("\n")):
            if line.strip(" "):
                seen[source, line] = seen.get((source, line), 0) + 1
    common = {k for k, n in seen.items() if n >= least and n * 100 > pages[k[0]] * percent}
    return {d: "\n".join(x for x in t.split("\n") if (s, x) not in common) for d, s, t in rows}
