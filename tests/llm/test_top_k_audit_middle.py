"""Exact top-k, filter audit and fill-in-middle on small odd tables, against plain versions and their SQL."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import fill_in_middle, filter_audit, impact_index, queries

FLOATS = "vec_id long, vector array<float>, part string, block int, own boolean"


# ---- exact top-k -------------------------------------------------------------


def plain_top(rows, asked, k, scale=256):
    """rows: (vec_id, list or None); the answer of each asked row, by its place."""
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = []
    for n, (i, q) in enumerate(kept):
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def top(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, v, "x", 1, True) for i, v in rows], FLOATS).repartition(3)
    return sorted(tuple(r) for r in impact_index.search(df, F.col("vec_id") % 50 == 0, k, **more).collect())


def test_top_k_with_ties_copies_nulls_and_other_lengths(spark):
    r = np.random.default_rng(5)
    rows = [(k, (r.normal(size=9) * r.choice([0.01, 1, 30])).round(3).tolist()) for k in range(160)]
    for k in range(40, 101):
        rows[k] = (k, rows[3][1])  # a third of all rows are one vector
    rows += [(50, rows[7][1]), (50, rows[7][1]), (100, rows[3][1]), (100, rows[100][1])]  # repeated ids and rows
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 9), (350, [float("inf")]), (None, [1.0] * 9)]
    rows += [(400, [0.0] * 9), (450, []), (500, [5.0, -5.0]), (550, [-3.0] * 12), (-50, [0.001] * 9)]
    want = plain_top(rows, lambda i: i % 50 == 0, 5)
    for more in ({}, {"components": 128}):
        assert top(spark, rows, **more) == want
    assert len({q for q, *_ in want}) == 9


def test_top_k_of_few_or_no_rows(spark):
    assert top(spark, []) == [] and top(spark, [(0, [1.0])]) == []
    assert top(spark, [(0, [1.0, 0.5]), (1, [-1.0, 0.25])]) == [(0, 1, 1, -256 * 256 + 128 * 64)]
    assert top(spark, [(0, None)]) == []


def test_components_beyond_the_bound_stop_the_job(spark):
    with pytest.raises(Exception, match="too large for the index"):
        top(spark, [(0, [1e9]), (1, [1.0])])


def block_of(x):
    v = impact_index.Vectors(np.arange(len(x)), np.full(len(x), x.shape[1]), x.reshape(-1))
    return impact_index.Block(v, [{"at": d, "impact": i, "least": m, "ids": rows.tobytes()} for d, i, m, rows in impact_index.segments(v)])


def test_a_proof_ends_the_search_early_and_never_too_early():
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 32))
    clustered = centres[r.integers(0, 40, 4000)] + 0.1 * r.normal(size=(4000, 32))
    for x, most in ((clustered, 0.3), (r.normal(size=(4000, 32)), 0.8), (r.integers(-1, 2, (4000, 32)) * 0.01, 1.01)):
        shares = []
        x = np.floor(256 * x).astype(np.int64)
        block, read = block_of(x), []
        block.postings = Counting(block.postings, read)
        for i in range(0, 4000, 400):
            read.clear()
            rows, scores = block.top(x[i], 6)
            exact = x @ x[i]
            order = np.lexsort((np.arange(len(x)), -exact))[:6]
            assert rows.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
            shares.append(sum(read) / int((x * x[i] != 0).sum()))
        assert max(shares) <= 1 and np.mean(shares) < most


class Counting(list):
    def __init__(self, lists, read):
        super().__init__(lists)
        self.read = read

    def __getitem__(self, i):
        self.read.append(len(super().__getitem__(i)))
        return super().__getitem__(i)


def test_an_impact_is_never_below_the_value_it_stands_for():
    x = np.random.default_rng(1).integers(-300, 300, (500, 7))
    seen = np.zeros_like(x)
    v = impact_index.Vectors(np.arange(500), np.full(500, 7), x.reshape(-1).astype(np.int64))
    for d, impact, least, rows in impact_index.segments(v):
        size = np.abs(x[rows, d])
        assert (np.sign(x[rows, d]) == np.sign(impact)).all() and (size.min(), size.max()) == (least, abs(impact))
        seen[rows, d] += 1
    assert np.array_equal(seen, (x != 0).astype(int))


# ---- filter audit ------------------------------------------------------------


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min((first.get(t or "", (1, 0)), (i is None, i or 0)))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        capitals = len(re.findall("[A-Z]", t))
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * capitals > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (i is None, i or 0) > first[t]}
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in here) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def odd_documents():
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    long = [" ".join(r.choice(words, n)) for n in (99, 100, 130, 400)]
    texts = [None, "", " \t\n", "A B", "é" * 9 + "A", "x # y", "a\x0bb\x0cc\rd", *long, long[3].upper(), " ".join(words[:100]), " ".join(words[:80] + words[:20]), " ".join(words[:79] + words[:21])]
    docs = [(k, texts[k % len(texts)], ("en", "de", None, "")[k % 4]) for k in range(60)]
    docs += [(k, "the same copy", "en") for k in range(100, 160)] + [(100, "the same copy", "en"), (None, "the same copy", "en"), (None, "only here", "fr"), (None, "only here", "fr"), (7, "other", "de")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1)]
    return docs, labels


def test_audit_against_every_order_played_through(spark):
    docs, labels = odd_documents()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, n int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    got = filter_audit.audit(df, lab, F.col("lang")).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got} == plain_audit(docs, labels)
    assert len(got) == 4 * 600 - 600 * ("" not in {d[2] or "" for d in docs})


def test_audit_of_own_filters_and_of_nothing(spark):
    docs = spark.createDataFrame([(k, "x" * k) for k in range(10)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, none, F.lit("all"), {"S": F.length("text") < 3, "O": F.length("text") % 2 == 1}).collect()
    assert len(got) == 6 * 3 and {(r.removed, r.redundant, r.unique_fails) for r in got if r.filter_order == "SOE" and r.step == 2} == {(4, 1, 4)}
    assert filter_audit.audit(docs.limit(0), none, F.lit("all")).count() == 0
    with pytest.raises(ValueError, match="filters"):
        filter_audit.orders(docs, "ABCDEFGH")


# ---- fill-in-middle ----------------------------------------------------------


def plain_middle(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, t
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    if d % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "a", "<", "<<P", "a<P>b", "<<S>>", "x<M>", "P>a<S", "é\U0001f600ź\n\r\n\x00", "\U0001f600" * 7, "line\n" * 40, "q" * 300_000, "<P" * 50]


def test_middle_against_slices(spark):
    rows = [(k, ODD[k % len(ODD)], "x", 1) for k in range(300)] + [(None, "no id", "x", 1), (3, ODD[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string, n int").repartition(3)
    made = fill_in_middle.fill_in_middle(df)
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    mine = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got), key=key)
    assert mine == sorted(((i, plain_middle(i, t)) for i, t, *_ in rows), key=key)
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(r.back == texts[r.doc_id] for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0


def test_other_units_cut_at_their_ends_only(spark):
    rows = [(k, " ".join(f"word{j}" for j in range(k))) for k in range(60)]
    made = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*", seed=9, plain_percent=0, spm_percent=50)
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = dict(rows)
    for r in got:
        assert r.n == r.doc_id and r.back == texts[r.doc_id]
        if r.form != "plain":
            ends = {0, *(m.end() for m in re.finditer(r"\S+\s*", texts[r.doc_id]))}
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends
    assert {r.form for r in got} == {"plain", "psm", "spm"} and sum(r.form == "plain" for r in got) == 1


def test_no_unit_array_is_stored():
    import tracemalloc

    text, pattern = "x" * 2_000_000, re.compile(fill_in_middle.CODE_POINT)
    tracemalloc.start()
    assert fill_in_middle.places(pattern, text, 10**9, 7) == (2_000_000, *sorted((10**9 % 2_000_001, 7)))
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


# ---- the registered queries --------------------------------------------------


def test_queries_against_their_sql(spark, tmp_path):
    docs, labels = odd_documents()
    docs += [(200 + k, t, "en") for k, t in enumerate(ODD)]
    r = np.random.default_rng(8)
    vectors = [(k, r.normal(size=8).tolist()) for k in range(120)] + [(150, None), (200, [float("nan")] * 8)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
    }
    sql = duckdb.connect()
    for name, df in tables.items():
        df.repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op11_exact_top_k", "op12_filter_audit", "op13_fill_in_middle"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        rows = sorted((tuple(x) for x in df.collect()), key=repr)
        want = sql.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(want, key=repr) and rows, name
