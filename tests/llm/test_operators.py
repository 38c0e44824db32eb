import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from parlance.llm import (
    ann, chat, fingerprints, language_id, line_dedup, packing, sentencepiece_codec, simhash, suffix_dedup, token_counts,
)
from parlance.llm.components import connected_components
from parlance.llm.tokenizer import SPECIAL, Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n)) + "."


def docs_frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a clashing extra column."""
    rows = [(0, prose(0, 60)), (1, None), (2, ""), (3, prose(0, 60)), (4, "x" * 200_000), (5, "Zoë  naïve\n\n\ttext \U0001f600"), (None, prose(3, 9)), (6, prose(0, 59)), (6, prose(0, 59))]
    return spark.createDataFrame([(d, t, None if d == 2 else "en", None, None, "g") for d, t in rows], DOCS + ", g string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- packing ---------------------------------------------------------------


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = Encoder(public_tokenizers.path, "byte_bpe_50k", public_tokenizers.PATTERN)
    texts = [prose(1, 50), "", " ", "  a", "a  b", "a   b", "a \nb", "a\n b", "a\n  b ", " lead", "trail ", "trail  ", "it's  'll", "\u00a0x \u3000y", "naïve 你好 \U0001f600", f"a {SPECIAL} b{SPECIAL}", "\t\t x\r\n y", "x" * 5000]
    for t in texts:
        assert np.frombuffer(fast(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_first_fit_decreasing_matches_a_scan():
    lengths = np.random.default_rng(5).integers(1, 100, 500)
    bins, offsets, n = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
        if k is None:
            room.append(100)
            k = len(room) - 1
        want[i] = (k, 100 - room[k])
        room[k] -= lengths[i]
    assert n == len(room) and all(want[i] == (bins[i], offsets[i]) for i in want)


def test_packing_keeps_every_id_once(spark, odd, empty):
    rows = packing.pack_documents(odd).toPandas()
    assert rows.groupby("row").length.sum().tolist() == rows.groupby("row").doc_tokens.first().tolist()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= packing.CAPACITY
    assert rows.doc_id.isna().sum() == 1 and len(rows[rows.doc_id == 1]) == 1 and all(len(i) == 4 * n for i, n in zip(rows.ids, rows.length))
    assert zlib.crc32(rows[rows.doc_id == 2].ids.iloc[0]) == zlib.crc32(np.array([1], "<u4").tobytes())
    assert packing.pack_documents(empty).count() == 0


# ---- line dedup ------------------------------------------------------------


def test_boilerplate_goes_on_its_site_only(spark):
    rows = [(k, "a" if k < 20 else "b", ["head" if k % 4 == 0 or k >= 20 else f"own {k}", f"text {k}", "", f"text {k}"]) for k in range(40)]
    rows += [(100, None, ["head"]), (101, "a", None)]
    found = {r.id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "id long, host string, lines array<string>"), F.col("host"), F.col("lines")).collect()}
    assert found[0].kept_lines == ["text 0", "", "text 0"] and found[1].n_dropped == 0 and found[25].n_dropped == 1
    assert found[100].kept_lines == ["head"] and found[100].site == "" and found[101].n_lines == 0


def test_line_dedup_against_brute_force(spark, empty):
    r = np.random.default_rng(2)
    rows = [(k, f"s{k % 3}", "\n".join(r.choice(["one", "two", "three", f"own {k}", " ", "rare"], 4, p=[0.3, 0.1, 0.02, 0.4, 0.08, 0.1]))) for k in range(200)]
    frame = spark.createDataFrame(rows, "id long, source string, text string")
    got = line_dedup.drop_boilerplate(frame, F.col("source"), F.split("text", "\n")).select("id", F.array_join("kept_lines", "\n").alias("t")).collect()
    assert {x.id: x.t for x in got} == brute.pipeline_lines(rows)
    assert line_dedup.drop_boilerplate(empty, F.col("source"), F.split("text", "\n")).count() == 0


# ---- nearest neighbours ----------------------------------------------------


def test_search_is_exact_on_small_tables(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[200:] = x[7]  # a third of all rows are one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [1.0]), (None, [1.0] * 8), (7, x[7].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, vector array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        o = np.lexsort((np.arange(300), d))[:10]
        g = g.sort_values("rank")
        assert g.vec_id.tolist() == o.tolist() and np.array_equal(g.score.to_numpy(), d[o])
    assert sorted(got.query_id.unique()) == [0, 50, 100, 150, 200, 250]


def test_huge_and_far_vectors_are_found(spark):
    rows = [(0, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [0.0, 3e200]), (3, [1.0, 1.0]), (4, [1.0, 1.0 + 1e-9]), (5, [1.0, 1.0 + 2e-9])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") % 3 == 0, k=2).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].score.tolist() == [1e200, 1e200] and got[got.query_id == 3].vec_id.tolist() == [4, 5]


def test_recall_over_learned_partitions(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(12, 16))[r.integers(0, 12, 1500)] * 2 + r.normal(size=(1500, 16))).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, vector array<float>")
    got = ann.search(frame, F.col("vec_id") % 25 == 0).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(g.vec_id))
    assert hits / (10 * 60) >= 0.9
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


# ---- SimHash ---------------------------------------------------------------


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_simhash_against_brute_force(spark, odd, empty):
    r = np.random.default_rng(4)
    texts = [prose(k, 40) for k in range(60)]
    for k in range(120):
        words = texts[k % 20].split(" ")
        words[r.integers(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += ["", None, "one", "one two"]
    fps = [brute.simhash(t) for t in texts]
    got = simhash.near_duplicates(docs_frame(spark, texts), most=8, block=64).toPandas().set_index("doc_id")
    assert [int(got.fp[k]) & (2**64 - 1) for k in range(len(texts))] == fps
    assert got.component_id.to_dict() == brute.components(list(range(len(texts))), fps, 8)
    assert got.component_id.nunique() < len(texts) - 60
    # The same ids a second time, each under the next text: no link is lost, none is made by an id.
    again = docs_frame(spark, texts).unionByName(docs_frame(spark, texts[1:] + texts[:1]))
    rows = simhash.near_duplicates(again, most=8, block=16).toPandas()
    group = brute.components(list(range(len(texts))), fps, 8)
    least = {}
    for k in range(len(texts)):  # text k stands under the ids k and k - 1
        least[group[k]] = min(least.get(group[k], k), k, (k - 1) % len(texts))
    at = {f: least[group[k]] for k, f in enumerate(fps)}
    assert all(c == at[int(f) & (2**64 - 1)] for f, c in zip(rows.fp, rows.component_id)) and len(rows) == 2 * len(texts)
    found = simhash.near_duplicates(odd).toPandas()
    assert len(found) == 8 and found[found.doc_id == 3].component_id.iloc[0] == 0 and simhash.near_duplicates(empty).count() == 0


# ---- tokens ----------------------------------------------------------------


def test_unigram_search_is_that_of_the_library(spark, odd, empty, tmp_path):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    from parlance.llm.unigram import Pieces, pretokens

    model = pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # single-precision sums in the library lose small scores beside huge ones
        p.score = max(p.score, -40000.0)
    (tmp_path / "m").write_bytes(model.SerializeToString())
    library, pieces = sp.SentencePieceProcessor(model_file=str(tmp_path / "m")), Pieces(str(tmp_path / "m"))
    texts = ["Hello wörld  the 你好 \U0001f600 x", "a\nb  c\n\n d", " lead", "trail ", "", *[prose(k, 6) for k in range(20)]]
    words = sorted({w for t in texts for w in pretokens(t)})
    ids, counts = sentencepiece_codec.Viterbi(pieces).encode(words), token_counts.count_in_trie(words, pieces)
    for t in texts:
        assert np.frombuffer(b"".join(ids[w] for w in pretokens(t)), "<i4").tolist() == library.encode(t)
    assert all(len(ids[w]) == 4 * counts[w] for w in words)


def test_codec_and_counts_on_odd_rows(spark, odd, empty):
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).toPandas()
    assert (coded.decoded == coded.text.fillna("")).all() and coded.doc_id.isna().sum() == 1 and "g" in coded
    counted = token_counts.with_token_counts(odd).toPandas()
    assert counted.n_tokens.tolist() == [len(i) for i in coded.ids]
    assert sentencepiece_codec.encode(empty).count() == 0 and token_counts.with_token_counts(empty).count() == 0


# ---- suffix arrays ---------------------------------------------------------


@pytest.mark.parametrize("text", [b"banana", b"", b"a", b"aaaaaaaa", b"abcabcabc" * 7, bytes(range(255, -1, -1)), np.random.default_rng(0).integers(97, 100, 3000).astype(np.uint8).tobytes()])
def test_suffix_array_sorts_all_suffixes(text):
    t = np.frombuffer(text, np.uint8)
    found = suffix_dedup.suffix_array(t, suffix_dedup.words(t)).tolist()
    assert sorted(found) == list(range(len(text)))
    keys = [text[i : i + 50] for i in found]
    assert keys == sorted(keys)
    asked = np.random.default_rng(len(text)).random(len(text)) < 0.2
    some = suffix_dedup.suffix_array(t, suffix_dedup.words(t), asked=asked)
    assert len(set(some.tolist())) == len(some) and set(np.flatnonzero(asked).tolist()) <= set(some.tolist())
    keys = [text[i : i + 50] for i in some.tolist()]
    assert keys == sorted(keys)


def test_repeated_spans_against_brute_force(spark, odd, empty):
    r = np.random.default_rng(6)
    passage, texts = prose(99, 30), [prose(k, 50) for k in range(40)]
    texts += [texts[k] for k in range(10)] + [texts[k][:100] + passage + texts[k + 1][40:] for k in range(10)] + [passage] * 5 + ["short", "short", None, "", "ab" * 400, "ab" * 300]
    texts += [texts[int(r.integers(40))][7:90] + "é" * 60 for _ in range(4)]
    got = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup.repeated_spans(docs_frame(spark, texts)).collect()}
    assert got == brute.repeated(list(enumerate(texts)))
    plain = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup.repeated_spans(docs_frame(spark, texts), reduce=False).collect()}
    assert plain == got  # suffix arrays alone
    first = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup.repeated_spans(docs_frame(spark, texts), reduce=True).collect()}
    assert first == got  # exact copies before them
    # One passage in every third document with other text on either side.
    hot = [prose(k, 12) + (passage if k % 3 == 0 else "") + prose(1000 + k, 12) for k in range(300)]
    got = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup.repeated_spans(docs_frame(spark, hot)).collect()}
    assert got == brute.repeated(list(enumerate(hot)))
    rows = suffix_dedup.repeated_spans(odd, ("lang", "g"), as_text=True).toPandas()
    idless = rows[rows.doc_id.isna()].iloc[0]
    assert len(rows) == 9 and (idless.n_removed, idless.kept, len(idless.spans)) == (0, prose(3, 9), 0)
    rows = rows.dropna(subset=["doc_id"])
    assert rows.set_index("doc_id").n_removed[3] == rows.set_index("doc_id").n_bytes[3] and rows.carry.iloc[0]["g"] == "g"
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_common_prefixes_are_lengths():
    r = np.random.default_rng(8)
    t = np.concatenate((r.integers(97, 99, 4000), np.full(200, 97))).astype(np.uint8)
    w, a, b = suffix_dedup.words(t), r.integers(0, 4100, 3000), r.integers(0, 4100, 3000)
    found = suffix_dedup.common_prefixes(a, b, w, 50)
    padded = bytes(t) + bytes(80)
    for x, y, n in zip(a.tolist(), b.tolist(), found.tolist()):
        assert n == next((k for k in range(50) if padded[x + k] != padded[y + k]), 50)


# ---- fingerprints ----------------------------------------------------------


def test_likeness_estimates_the_shared_shingles(spark, empty):
    texts = [prose(k, 150) for k in range(30)]
    texts += [" ".join([*t.split(" ")[:120], *prose(500 + k, 30).split(" ")]) for k, t in enumerate(texts)] + ["", None, "one", "one"]
    rows = fingerprints.with_fingerprint(docs_frame(spark, texts).withColumn("text", F.coalesce("text", F.lit(""))), "text", "fp").toPandas().sort_values("doc_id")
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    off = []
    for k in range(30):
        a, b = shingles(texts[k]), shingles(texts[k + 30])
        agree = np.mean(np.array(rows.fp.iloc[k]) == np.array(rows.fp.iloc[k + 30]))
        off.append((agree - 2**-8) / (1 - 2**-8) - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.03 and np.abs(off).max() < 0.2
    same = lambda a, b: list(rows.fp.iloc[a]) == list(rows.fp.iloc[b])
    assert same(60, 61) and same(62, 63) and not same(60, 62) and all(len(f) == fingerprints.BINS for f in rows.fp)


def test_next_document_across_ranges(spark, odd, empty):
    texts = [prose(k, 5) for k in range(50)]
    for parts in (1, 7, 64):
        got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs_frame(spark, texts), parts).collect()}
        assert got == {k: texts[(k + 1) % 50] for k in range(50)}
    assert fingerprints.with_next(odd).count() == 8 and fingerprints.with_next(empty).count() == 0
    row = spark.createDataFrame([("abcdéfgh", "XYZ")], "a string, b string").select(fingerprints.edited(F.col("a"), F.col("b")).alias("e")).first()
    assert row.e == "abcdéfXY"


# ---- languages -------------------------------------------------------------


def test_languages_are_told_apart(spark, odd, empty):
    other = "der die das und nicht auch schön über".split()
    r = np.random.default_rng(7)
    rows = [(k, prose(k, 20) if k % 2 else " ".join(r.choice(other, 20)), "el" if k % 2 else "de", "s", 0) for k in range(200)]
    rows += [(500, None, "de", "s", 0), (501, "12 !!", "de", "s", 0), (502, prose(1, 9), None, None, None)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).toPandas().set_index("doc_id")
    assert (got.lang_pred[:200] == got.lang[:200]).mean() > 0.99 and got.score.between(0, 1).all()
    assert got.lang_pred[500] == got.lang_pred[501] == "und" and got.lang_pred[502] == "el"
    assert len(language_id.identify(odd).collect()) == 9 and language_id.identify(empty).count() == 0


# ---- chat ------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "a\\", "\\l<l<cut/>\\n\n", "", None, "<turn>user\nx</turn>\n", "\U0001f600<"]
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], t) for k, t in enumerate(hard)] + [(2, None, None, "x"), (2, None, None, "x"), (None, 0, "a<b\\\nc", "y"), (3, 1, "assistant", "b"), (3, 0, "system", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(hard)]]
    assert got[1].loss_texts == [t or "" for k, t in enumerate(hard) if k % 3]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x"), ("", "x")] and got[2].formatted.count(chat.OPEN) == 1
    assert got[None].turns[0].role == "a<b\\\nc" and [t.text for t in got[3].turns] == ["a", "b"]
    assert chat.format_conversations(frame.limit(0)).count() == 0
    # One conversation of many turns, and very long texts; further columns named like the operator's own.
    many = [(1, k, ("user", "assistant")[k // 3 % 2], "t<" * (k % 7)) for k in range(3000)] + [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "<" * 300_000)]
    wide = spark.createDataFrame(many, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("z") for c in ("t", "formatted", "loss_spans", "blocks", "lead")})
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(wide)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for c, _, r, t in many if c == 1]
    assert got[1].loss_texts == [t for c, _, r, t in many if c == 1 and r == "assistant"] and got[2].loss_texts == ["<" * 300_000]
