from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import messages, units


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_credentials_go_and_prose_stays(spark):
    secrets = ["sk-" + "a" * 24, "ghp_" + "Z9" * 12, "xoxb-" + "1-" * 8, "AIza" + "x" * 32, "M" + "a" * 23 + ".abcdef." + "b" * 24]
    said = " then ".join(secrets)
    assert one(spark, said, text.redact(F.col("x"))) == " then ".join([text.REDACTED] * 5)
    plain = "ask sk-short, task-aaaaaaaaaaaaaaaaaaaaaaaa and ghp of it"
    assert one(spark, plain, text.redact(F.col("x"))) == plain


def test_tokens_and_breaks(spark):
    c = text.clean(F.col("x"))
    row = spark.createDataFrame([("observer theory. Mind and world\nmodel; good faith <:wave:1> https://x.org/a end",)], "x string").select(text.word_tokens(c).alias("t"), text.breaks(c).alias("b")).first()
    assert row.t == ["observer", "theory", "mind", "and", "world", "model", "good", "faith", "end"]
    assert row.b == [False, True, False, False, True, True, False, True]


def test_short_words_break_phrases(spark):
    c = text.clean(F.col("x"))
    rows = spark.createDataFrame([("theory of mind wave function",)], "x string").select(text.word_tokens(c).alias("t"), text.breaks(c).alias("b"))
    grams = rows.select(text.places(F.col("t"), F.col("b"))).select("pos", text.gram(2).alias("g")).where("g is not null").orderBy("pos").collect()
    assert [r.g for r in grams] == ["mind wave", "wave function"]


def test_domains(spark):
    d = text.domain(F.col("x"))
    assert one(spark, "https://www.Example.org/a).", d) == "example.org"
    assert one(spark, "https://youtu.be/x", d) == "youtube.com"
    assert one(spark, "https://", d) is None


def test_plural_folds_only_to_an_observed_singular(spark):
    terms = spark.createDataFrame([("s", w) for w in ("theories", "theory", "glasses", "minds", "virus", "boxes", "box")], "server_id string, term string")
    found = {r.term: r.canonical for r in units.folded(terms, terms).collect()}
    assert found == {"theories": "theory", "theory": "theory", "glasses": "glasses", "minds": "minds", "virus": "virus", "boxes": "box", "box": "box"}


def test_mentions(spark):
    rows = spark.createDataFrame(
        [("ask <@42>, <@!84>, and <@999>", [("42", "a", None, ("Server Nick",)), ("84", "b", "Second Person", (None,))])],
        "content string, mentions array<struct<id:string,username:string,global_name:string,member:struct<nick:string>>>",
    )
    assert rows.select(text.resolve_mentions(F.col("content"), F.col("mentions")).alias("y")).first()["y"] == "ask @Server Nick, @Second Person, and <@999>"


def test_claims_leave_no_token_twice(spark):
    tokens = spark.createDataFrame(
        [("m", "s", "a", "c", "2024-01-01", True, ["observer", "theory", "observer", "theory", "with"], [False, False, False, False])],
        "id string, server_id string, speaker string, channel string, day string, is_current boolean, tokens array<string>, breaks array<boolean>",
    )
    pairs = spark.createDataFrame([("s", "observer theory"), ("s", "theory observer")], "server_id string, term string")
    found = [(u.term, u.kind) for u in units.unit_rows(tokens, pairs).first()["units"]]
    assert found == [("observer theory", "bigram"), ("observer theory", "bigram"), ("with", "word")]


def test_eligibility(spark):
    rows = spark.createDataFrame(
        [(False, None, "2024-01-01T00:00:00Z"), (True, None, "2024-01-01T00:00:00Z"), (None, "19", "2024-01-01T00:00:00+03:00"), (False, "7", "2024-01-01T00:00:00Z"), (False, None, "x")],
        "is_bot boolean, type string, timestamp string",
    )
    assert [r.ok for r in rows.select(messages.is_eligible().alias("ok")).collect()] == [True, False, True, False, False]
