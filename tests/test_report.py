import dataclasses

import numpy as np
import pytest

from parlance.config import Settings
from parlance.jobs.report import Report, validate
from parlance.operators.community import partition
from parlance.operators.people import person_key
from plain import one_row_an_event
from pyspark.sql import functions as F

TWOS = Settings(min_word_uses=2, min_phrase_uses=2, min_voices=2, unit_min_uses=2, unit_min_voices=2, unit_min_days=2, min_association=0.0, topic_resolution=1.0)
SCHEMA = "id string, timestamp string, server_id string, server string, channel string, user_id string, user string, is_bot boolean, message string, type string"


def report(spark, texts, settings=TWOS, words=(("the", 1000),), pairs=(("long time", 900), ("other thing", 100))):
    rows = [(f"m{k}", f"2026-01-{k + 1:02d}T10:00:00Z", "s", "S", "room", f"u{k % 2}", ("Ann", "Bob")[k % 2], False, t, None) for k, t in enumerate(texts)]
    make = lambda x: spark.createDataFrame(list(x), "term string, cnt long")
    return Report(spark.createDataFrame(rows, SCHEMA), make(words), make(pairs), settings)


def test_common_bigram_needs_lift_and_ordinary_one_stays(spark):
    r = report(spark, ["long time september event"] * 4, pairs=(("long time", 1),))
    assert {x.term for x in r.phrases().collect() if x.size == 2} == {"time september", "september event"}


def test_lexicon_saturates_and_marks_unknown_words(spark):
    words = (("culture", 1), ("the", 10**9))
    rows = {x.term: x for x in report(spark, ["culture culture xylophone"] * 2 + ["culture culture"] * 2, words=words).lexicon().collect()}
    assert rows["culture"].place == 1 and rows["culture"].reference_status == "measured"
    assert rows["xylophone"].reference_status == "not_found" and rows["xylophone"].lift is None


def test_atomic_units(spark):
    r = report(spark, ["observer theory and theory with observer"] * 4)
    g = r.graph()
    uses = {(x.term, x.kind): x.uses for x in g["inventory"].collect()}
    assert uses["observer theory", "bigram"] == 4 and uses["theory", "word"] == 4 and uses["observer", "word"] == 4


def test_trigram_needs_two_subjects(spark):
    settings = dataclasses.replace(TWOS, scaffolding=("merely", "accumulated"))
    r = report(spark, ["merely the accumulated genetic trait selection"] * 4, settings, words=(("genetic", 1000), ("the", 1000)))
    assert {x.term for x in r.phrases().collect() if x.size == 3} == {"genetic trait selection"}


def test_aliases_stay_out(spark):
    r = report(spark, ["ann spoke of quantum quantum theory"] * 4)
    assert "ann" not in {x.term for x in r.lexicon().collect()}


def test_validator(spark):
    with pytest.raises(RuntimeError, match="forbidden"):
        validate(spark.range(1).select(F.struct(F.lit(1).alias("user_id")).alias("x")))
    assert validate(spark.range(1)).columns == ["id"]


def test_communities_split_two_cliques():
    links = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0), ("c", "x", 0.1)]
    at = {n: k for k, n in enumerate("abcxyz")}
    l, r, w = (np.array(v) for v in zip(*[(at[a], at[b], x) for a, b, x in links]))
    # A community is named by any one of its nodes.
    groups = lambda found: [np.flatnonzero(found == x).tolist() for x in dict.fromkeys(found.tolist())]
    assert groups(partition(l, r, w, 6, 1.0)) == [[0, 1, 2], [3, 4, 5]]
    # Single nodes move, never whole groups: a weak bridge joins nothing even without the size term.
    assert groups(partition(l, r, w, 6, 0.0)) == [[0, 1, 2], [3, 4, 5]]


def test_one_row_an_event_prefers_the_phrase():
    rows = [("september",), ("september", "event"), ("event",), ("trip",)]
    assert one_row_an_event(rows) == [1, 3]
    assert one_row_an_event([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b")]) == [2, 3]
    assert one_row_an_event([(w,) for w in "abcd"], 2) == [0, 1]


def test_person_key_is_short_and_stable(spark):
    keys = [r.k for r in spark.createDataFrame([("u1",), ("u1",), ("u2",)], "s string").select(person_key(F.col("s")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 12
