import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from parlance.llm import near_copies
from test_operators import DOCS, WORDS, docs_frame, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def smallest_of_groups(texts):
    """Brute force: the smallest place of each group at Jaccard 0.8."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted({find(k) for k in root})


def edited(text, r, n):
    words = text.split(" ")
    for at in r.integers(0, len(words), n):
        words[at] = str(r.choice(WORDS)) + str(r.integers(1000))
    return " ".join(words)


def test_near_copies_are_those_of_brute_force(spark):
    r = np.random.default_rng(3)
    bases = [prose(k, 30 + 13 * k) for k in range(20)]
    texts = list(bases)
    for n in (1, 2, 3, 5, 8):
        texts += [edited(b, r, n) for b in bases]
    # One large group whose members are similar to the first, not all to each other.
    texts += [edited(bases[15], r, 4) for _ in range(150)]
    texts += [prose(99, 3), prose(99, 3).upper(), "one two", "one  two", "", " ", bases[7]]
    kept = pipeline.dedup_near_copies(spark, docs_frame(spark, texts), "").toPandas()
    assert sorted(kept.doc_id) == smallest_of_groups(texts)


def test_an_empty_table_has_no_near_copies(spark):
    assert pipeline.dedup_near_copies(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_documents_that_share_an_id_or_have_none_stay(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, b + " x"), (7, None), (8, ""), (None, prose(4, 60)), (9, c + " y")]
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], DOCS)
    kept = pipeline.dedup_near_copies(spark, docs, "").collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept))
    assert got == sorted([(False, 1, a), (False, 1, b), (False, 7, ""), (True, 0, prose(4, 60)), (False, 9, c + " y")])


def test_the_pipeline_runs_on_odd_and_on_empty_tables(spark, tmp_path):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a, "en"), (1, b, "en"), (None, prose(3, 40), None), (2, a, "en"), (3, None, None), (4, "", "en"), (5, "12", None), (6, "Zoë " * 20_000, None)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame([(d, t, lang, None, None) for d, t, lang in some], DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in got}) == [-1, 1, 6] and sum(r.start == 0 for r in got) == 4
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("few, block", [(near_copies.FEW, near_copies.BLOCK_BYTES), (2, 8192)])
def test_a_large_group_of_texts_that_are_mostly_no_links(spark, monkeypatch, few, block):
    """Members share buckets; only some pairs are similar, none all to one leader."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", block)
    monkeypatch.setattr(near_copies, "ROUNDS", 1)
    calls = []
    large = near_copies.large_bucket_links
    monkeypatch.setattr(near_copies, "large_bucket_links", lambda live, sets: calls.append(live.groupBy("key").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]) or large(live, sets))
    r = np.random.default_rng(11)
    base = prose(5, 150)
    texts = [edited(base, r, int(n)) for n in r.integers(4, 9, 90)]
    texts += [edited(t, r, 2) for t in texts[:25]]
    kept = pipeline.dedup_near_copies(spark, docs_frame(spark, texts), "").toPandas()
    want = smallest_of_groups(texts)
    assert 10 < len(want) < 100 and sorted(kept.doc_id) == want
    # The case is one of large buckets, and with small blocks one of several blocks.
    assert calls and calls[0] * 8 > 2 * 8192


def test_links_of_blocks_are_those_of_brute_force():
    r = np.random.default_rng(12)
    for trial in range(20):
        base = np.unique(r.integers(0, 1 << 60, 60, dtype=np.uint64))
        sets = []
        for _ in range(40):
            own = base[r.random(len(base)) > r.choice([0.02, 0.08, 0.2, 0.9])]
            sets.append(np.unique(np.concatenate((own, r.integers(0, 30, r.integers(1, 6), dtype=np.uint64)))))
        label = r.integers(0, 30, 40)
        left, right = (np.arange(40), np.arange(40)) if trial % 2 else (np.arange(15), np.arange(15, 40))
        links = near_copies.block_links(label, sets, left, right)
        alike = lambda i, j: near_copies.similar(sets[i].tobytes(), sets[j].tobytes())
        assert all(alike(i, j) and label[i] != label[j] and i in left and j in right for i, j in links)

        def groups(pairs):
            root = {int(g): int(g) for g in label}
            for i, j in pairs:
                a, b = root[int(label[i])], root[int(label[j])]
                root = {g: min(a, b) if t in (a, b) else t for g, t in root.items()}
            return root

        assert groups(links) == groups((i, j) for i in left for j in right if i != j and alike(i, j))
