"""Every registered query on small odd tables, held against plain versions, digests included."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from parlance.llm import ann, fingerprints, language_id, line_dedup, packing, queries, suffix_dedup, token_counts
from test_operators import DOCS, prose

GERMAN = "der die das und nicht auch schön über straße können würde".split()


def german(seed, n):
    return " ".join(np.random.default_rng(seed).choice(GERMAN, n)) + "."


@pytest.fixture(scope="module")
def docs():
    texts = {k: prose(k, 5 + k % 60) if k % 2 else german(k, 5 + k % 50) for k in range(60)}
    texts |= {60: None, 61: "", 62: " \t\n ", 63: texts[7], 64: texts[8][:300], 65: "12 !!", 66: "Zoë \U0001f600  x", 67: "w" * 60_000, 68: "one two", 70: texts[9] + " tail", 75: "a b c d e"}
    return texts


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, ("de" if k % 2 == 0 else "el") if k < 50 else None, None, None, "x") for k, t in docs.items()]
    spark.createDataFrame(rows, DOCS + ", found string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def result(spark, folder, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    return {r["doc_id"]: r for r in rows}, rows


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, docs, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, rows = result(spark, folder, "op1_packing")
    for d, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == d)
        assert [m[0] for m in mine] == [0, *np.cumsum([m[1] for m in mine])[:-1]] and sum(m[1] for m in mine) == len(ids)
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) and t == len(ids) for s, n, crc, t in mine)
    for q in {r["sequence_id"] for r in rows}:
        held = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == q)
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 2048


def test_op4(spark, docs, folder):
    got, _ = result(spark, folder, "op4_simhash")
    fps = {d: brute.simhash(t) for d, t in docs.items()}
    group = brute.components(list(docs), list(fps.values()), 4)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fps[d]:016x}", group[d]) for d in docs}


def test_op5_and_op6(spark, docs, folder):
    counts, _ = result(spark, folder, "op5_token_counts")
    coded, _ = result(spark, folder, "op6_sentencepiece")
    assert all(counts[d]["n_tokens"] == coded[d]["n_ids"] == len(coded[d]["ids"]) for d in docs)
    assert all(coded[d]["lossless"] and coded[d]["decoded_sha256"] == sha(t or "") for d, t in docs.items())


def test_op7(spark, docs, folder):
    got, _ = result(spark, folder, "op7_suffix_array")
    want = brute.repeated(list(docs.items()))
    for d, text in docs.items():
        removed, kept = want[d]
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len((text or "").encode()), removed, sha(kept))
        assert (got[d]["n_spans"] > 0) == (removed > 0)
    assert sum(r["n_removed"] for r in got.values()) > 0


def xx(value, seed):
    """Spark's xxhash64 of one value after ``seed``, signed."""
    h = xxhash.xxh64_intdigest(value if isinstance(value, bytes) else int(value).to_bytes(8, "little", signed=True), seed & (2**64 - 1))
    return h - (1 << 64) if h >> 63 else h


def xx_int(value, seed):
    h = xxhash.xxh64_intdigest(int(value).to_bytes(4, "little", signed=True), seed & (2**64 - 1))
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text):
    words = [xx(w.encode(), 42) for w in re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").split(" ")]
    least = {}
    for i in range(max(1, len(words) - fingerprints.SHINGLE + 1)):
        h = 42
        for w in words[i : i + fingerprints.SHINGLE]:
            h = xx(w, h)
        b = (h >> fingerprints.SHIFT) + fingerprints.BINS // 2
        least[b] = min(least.get(b, h), h)
    low = {b: h & (2**fingerprints.BITS - 1) for b, h in least.items()}
    out = []
    for b in range(fingerprints.BINS):
        tries = [b, *(xx_int(j, xx_int(b, 42)) % fingerprints.BINS for j in range(fingerprints.PROBES))]
        at = next((c for c in tries if c in low), None)
        if at is None:
            at = min((xx_int(-1, xx_int(c, xx_int(b, 42))), low[c], c) for c in low)[2]
        out.append(low[at])
    return out


def test_op8(spark, docs, folder):
    got, _ = result(spark, folder, "op8_fingerprints")
    order = sorted(docs)
    for d, after in zip(order, order[1:] + order[:1]):
        text, then = docs[d] or "", docs[after] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + then[:quarter]
        mine, new, other = map(plain_fingerprint, (text, edited, then))
        alike = lambda a, b: min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b)) / len(a) - 2.0**-8) / (1 - 2.0**-8)))
        digits = lambda f: "".join(f"{v:02x}" for v in f)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), sha(edited), digits(mine), digits(new)), d
        assert math.isclose(r["near_edited"], alike(mine, new)) and math.isclose(r["near_next"], alike(mine, other))
    assert queries.QUERIES["op8_fingerprints"](spark, folder).count() == len(docs)


def test_bounds_are_found_in_two_steps(spark):
    for bounds in ([], [3], list(range(0, 90, 7)), [-5, 0, 2, 9, 11, 40]):
        rows = spark.range(-10, 100).select("id", fingerprints.bounds_below(F.col("id"), bounds).alias("n")).collect()
        assert all(r.n == sum(b <= r.id for b in bounds) for r in rows)


def places(text):
    c, out = [ord(x) for x in text.lower()], set()
    for start in range(len(c)):
        h = 0
        for n in range(min(language_id.ORDERS, len(c) - start)):
            h = ((h * 0x01000193) ^ ((c[start + n] + n + 1) * 0x9E3779B1)) & 0xFFFFFFFF
            out.add((h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_id.BITS))
    return out


def kernel(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b))


def test_op9(spark, docs, folder):
    got, _ = result(spark, folder, "op9_language_id")
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs}
    letters = {d for d, t in docs.items() if t and any(x.isalpha() for x in t)}
    train = sorted((("de", "el")[d % 2], d) for d in docs if d < 50 and not held[d] and d in letters)
    sets = [places(docs[d]) for _, d in train]
    # Landmarks, their kernel's root, and one ridge regression a language, with explicit kernels.
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    w, v = np.linalg.eigh(gram)
    good = w > 1e-6 * w.max()
    root = v[:, good] / np.sqrt(w[good])
    x = np.hstack([gram @ root, np.ones((len(sets), 1))])
    lang = [l for l, _ in train]
    share = np.array([1 / lang.count(l) for l in lang])[:, None]
    y = np.array([[1.0 if l == c else -1.0 for c in ("de", "el")] for l in lang])
    beta = np.linalg.solve(x.T @ (x * share) + language_id.RIDGE / len(x) * np.eye(x.shape[1]), x.T @ (y * share))
    for d, text in docs.items():
        assert got[d]["held_out"] == held[d]
        if d not in letters:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        f = np.append(np.array([kernel(places(text), s) for s in sets]) @ root, 1.0) @ beta
        e = np.exp(language_id.SHARPNESS * (f - f.max()))
        assert got[d]["lang_pred"] == ("de", "el")[int(f.argmax())] and abs(got[d]["score"] - 1 / e.sum()) < 1e-3
    right = [got[d]["lang_pred"] == ("de", "el")[d % 2] for d in range(60) if held[d]]
    assert len(right) > 5 and sum(right) >= 0.9 * len(right)


def test_a_repeated_doc_id_is_learned_from_once(spark):
    rows = [(k % 3, german(k, 9), "de", None, None) for k in range(300)] + [(10 + k, prose(k, 9), "el", None, None) for k in range(50)]
    assert len(language_id.training_sample(spark.createDataFrame(rows, DOCS))) <= 60


def test_op3_reads_little_of_a_table_with_structure(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(5)
    x = (r.normal(size=(200, 64))[r.integers(0, 200, 20_000)] + 0.25 * r.normal(size=(20_000, 64))).astype(np.float32)
    short = r.normal(size=(120, 5)).astype(np.float32)  # other lengths are searched among their own
    made = pa.table({"vec_id": np.arange(20_120), "embedding": pa.array([*x, *short], pa.list_(pa.float32()))})
    pq.write_table(made, f"{tmp_path}/embeddings.parquet")
    fitted, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    got = queries.QUERIES["op3_ann"](spark, str(tmp_path)).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, g in got.groupby("query_id"):
        table, first = (x, 0) if q < 20_000 else (short, 20_000)
        d = ((table.astype(float) - table[q - first]) ** 2).sum(1)
        d[q - first] = np.inf
        same = len(set(np.argsort(d)[:10] + first) & set(g.vec_id))
        assert len(g) == 10 and (same == 10 or not first)
        hits += same
    assert got.query_id.nunique() == 202 and hits >= 0.9 * 2020
    (router, probes), = fitted
    order = np.argsort(-router(x.astype(float)), axis=1)
    sizes = np.bincount(order[:, 0])
    assert len(sizes) > 20 and sizes[order[::100, :probes]].sum(axis=1).mean() < 0.1 * len(x)


def test_op3_and_op10(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(250, 6)).astype(np.float32)
    x[50:120] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 6), (1200, [1.0, None] * 3), (1300, [float("inf")] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op3_ann"](spark, str(tmp_path)).toPandas().sort_values(["query_id", "rank"])
    assert sorted(got.query_id.unique()) == [0, 100, 200]
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert g["rank"].tolist() == list(range(1, 11)) and np.array_equal(g.score.to_numpy(), d[g.vec_id.to_numpy()])
        hits += len(set(np.lexsort((np.arange(250), d))[:10]) & set(g.vec_id))
    assert hits >= 27
    turns = [(1, 0, "user", "a<b"), (1, 1, "assistant", None), (1, 2, "assistant", "x\\"), (2, 0, None, "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {c.conv_id: c for c in queries.QUERIES["op10_chat"](spark, str(tmp_path)).collect()}
    assert got[1].turns_sha256 == sha("user\na<b\nassistant\n\nassistant\nx\\\n") and (got[1].loss_sha256, got[1].loss_chars, got[1].n_turns) == (sha("x\\"), 2, 3)
    assert got[-7].loss_sha256 == sha(queries.HARD_TEXT) and set(got) == {1, 2, -7}


def test_columns_named_like_the_operators_own_pass_through(spark):
    names = ("_common", "_salt", "_salts", "_hit", "_all", "counted", "found", "line", "pages", "n")
    rows = spark.createDataFrame([(k, prose(k % 2, 5) + "\nsame", "en") for k in range(12)], "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in names})
    kept = line_dedup.drop_boilerplate(rows, F.lit("s"), F.split("text", "\n"), overall=True)
    for made in (kept, token_counts.with_token_counts(rows), language_id.identify(rows)):
        got = made.collect()
        assert len(got) == 12 and all(r[c] == c for r in got for c in names)
    assert {tuple(r.kept_lines) for r in kept.collect()} == {()} and packing.pack_documents(rows).count() == 12
    assert suffix_dedup.repeated_spans(rows).count() == 12 and ann is not None


def test_line_dedup_of_nulls_and_a_hot_site(spark):
    rows = [(k, None if k % 50 == 0 else "hot" if k % 3 else f"s{k % 7}", None if k % 40 == 0 else f"head\nown {k}") for k in range(400)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "id long, host string, text string"), F.col("host"), F.split("text", "\n"))
    plain = brute.pipeline_lines([(k, h or "", t or "") for k, h, t in rows])
    assert {r.id: "\n".join(r.kept_lines) for r in got.collect()} == plain
