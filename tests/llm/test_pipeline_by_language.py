"""The language that the first stage tells decides what the last stage packs together."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from parlance.llm import packing
from test_operators import DOCS, prose

OTHER = "der die das und ist nicht mit auf ein eine für über wäre könnte straße größe zwischen schließlich jedoch während".split()


def german(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(OTHER, n)) + "."


@pytest.fixture(scope="module")
def mixed():
    """120 documents, odd ids German; a third has no label, and those that are held out from learning a wrong one."""
    rows = []
    for k in range(120):
        lang = ("el", "de")[k % 2]
        given = None if k % 3 == 0 else ("de", "el")[k % 2] if zlib.crc32(str(k).encode()) % 4 == 2 else lang
        rows.append((k, (prose, german)[k % 2](k, 40 + k), given, "s", 0))
    return rows


def test_the_language_told_goes_on_in_place_of_the_label(spark, mixed):
    told = pipeline.identify_language(spark, spark.createDataFrame(mixed, DOCS), "").collect()
    assert {r.doc_id: r.lang for r in told} == {k: ("el", "de")[k % 2] for k in range(120)}


def test_every_text_is_predicted_once(spark, mixed, capsys):
    pipeline.identify_language(spark, spark.createDataFrame(mixed, DOCS), "").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_without_a_label_to_learn_from_all_are_und(spark):
    rows = [(k, prose(k, 20), None, "s", 0) for k in range(4)]
    assert {r.lang for r in pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS), "").collect()} == {"und"}


def test_no_sequence_of_the_whole_pipeline_mixes_languages(spark, tmp_path, mixed):
    spark.createDataFrame(mixed, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(range(120))
    assert (got.doc_id.map(lambda k: ("el", "de")[k % 2]) == got.lang).all()
    assert (got.groupby("sequence_id").lang.nunique() == 1).all() and got.sequence_id.nunique() > 2
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()


@pytest.mark.parametrize("group", [packing.GROUP, 7])
def test_kinds_are_packed_apart_and_whole(spark, group):
    kinds = ["en"] * 60 + ["de"] * 9 + [None] * 20 + ["fr"]
    rows = [(k, prose(k, 10 + 37 * k % 3000), kind, "s", 0) for k, kind in enumerate(kinds)] + [(90, None, "fr", "s", 0), (None, "x " * 3000, "de", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).localCheckpoint()
    got = packing.place_apart(packing.token_pieces(docs, carry=("lang",)).drop("ids"), docs, "lang", group=group).toPandas().fillna({"lang": "?", "doc_id": -1})
    whole = packing.token_pieces(docs).toPandas().fillna({"doc_id": -1})
    assert sorted(zip(got.doc_id, got.start, got.length)) == sorted(zip(whole.doc_id, whole.start, whole.length))
    assert {int(d): lang for d, lang in zip(got.doc_id, got.lang)} == {-1 if d is None else d: lang or "?" for d, _, lang, *_ in rows}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048 and s.lang.nunique() == 1
    if group == packing.GROUP:  # one group a kind: no two of its sequences but the last could be one
        filled = got.groupby(["lang", "sequence_id"]).length.sum()
        for _, f in filled.groupby("lang"):
            assert len(f) == 1 or np.sort(f)[:2].sum() > 2048
    assert packing.place_apart(packing.token_pieces(docs.limit(0), carry=("lang",)), docs.limit(0), "lang").count() == 0


def test_of_equal_rows_the_one_with_the_least_language_stays(spark):
    a = prose(1, 60)
    rows = [(d, a, lang, "s", 0) for d in (3, 4) for lang in ("fr", "de", "en", "es")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows[::-1] if parts == 1 else rows, DOCS).repartition(parts)
        assert [(r.doc_id, r.lang) for r in pipeline.dedup_near_copies(spark, docs, "").collect()] == [(3, "de")]
