"""Large rows move once, and shuffles leave no files behind."""

import glob
import time

from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import plans
from parlance.functions.plans import keep
from parlance.jobs import fact_store
from parlance.operators import messages, units
from parlance.sources import corpus, files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def batch(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("2026-0"), F.col("id") % 3 + 4, F.lit("-05T10:00:00Z")).alias("timestamp"), F.lit("s").alias("server_id"),
                                 F.concat(F.lit("u"), F.col("id") % 5).alias("user_id"), F.lit("room").alias("channel"), F.lit("grand words here").alias("message"), F.col("id").alias("seq"))
    return spark.createDataFrame([], schemas.MESSAGE + ", seq long").unionByName(rows, allowMissingColumns=True)


def test_a_kept_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    kept = keep(spark.range(1000).groupBy(F.col("id") % 10).count())
    left = time.time() + 20  # they are removed by another thread
    while shuffle_files(spark) - before and time.time() < left:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and len(kept.collect()) == 10


def test_a_merge_moves_records_once(spark):
    old = batch(spark, 6).withColumn("month", corpus.month_of(F.col("timestamp"))).drop("seq")
    told = plan(corpus.merge(old, batch(spark, 9))[0])
    # The other one has the marks: month, moment, id and number.
    assert told.count("Exchange rangepartitioning") == told.count("Exchange hashpartitioning") == 1


def test_equal_versions_of_one_number_are_one_row(spark):
    """A stored month that holds an id twice, with one stamp or with two, has it once afterwards."""
    old = batch(spark, 2).withColumn("month", corpus.month_of(F.col("timestamp"))).drop("seq")
    later = old.where("id = 'm0'").withColumn("timestamp", F.lit("2026-04-06T10:00:00Z"))
    rows, receipt = corpus.merge(old.unionByName(old).unionByName(later), batch(spark, 4).where("id = 'm3'"))
    assert sorted(r.id for r in rows.collect()) == ["m0", "m1", "m3"] and receipt.agg(F.sum("added"), F.sum("updated")).first()[:] == (1, 0)


def test_an_inventory_moves_facts_once(spark):
    facts = spark.createDataFrame([], "server_id string, size int, term string, speaker string, day date, uses long, first_ts timestamp")
    assert "Expand" not in plan(messages.inventory(facts, False)) and plan(messages.inventory(facts, False)).count("Exchange") == 1


def test_months_are_renewed_in_turn_and_terms_counted_in_pieces(spark, tmp_path, monkeypatch):
    history, store = str(tmp_path / "history"), str(tmp_path / "facts")
    corpus.write_months(*corpus.merge(batch(spark, 0).drop("seq").withColumn("month", F.lit("")), batch(spark, 30)), history, "a")
    monkeypatch.setattr(fact_store, "PORTION", 1)
    monkeypatch.setattr(plans, "PIECE", 1000)
    assert fact_store.portions(spark, history, ["2026-04", "2026-05", "2026-06"]) == [["2026-04"], ["2026-05"], ["2026-06"]]
    fact_store.refresh(spark, history, store, ["2026-04", "2026-05", "2026-06"], batch="a")
    assert sum(files.size(spark, f"{store}/month={m}/facts") for m in fact_store.months(spark, store)) > 1000
    found = {(r.term, r.uses, r.voices, r.active_days) for r in fact_store.history_inventory(spark, store).collect()}
    assert found == {(t, 30, 5, 3) for t in ("grand", "words", "here", "grand words")}


def spoken(spark, n=40):
    words = ["alpha beta gamma", "beta gamma delta", "grand alpha beta"]
    rows = [(f"m{k}", f"2026-{k % 6 + 1:02d}-{k % 20 + 1:02d}T10:00:00Z", "s", "S", "room", f"u{k % 5}", "x", False, words[k % 3], None) for k in range(n)]
    return spark.createDataFrame(rows, "id string, timestamp string, server_id string, server string, channel string, user_id string, user string, is_bot boolean, message string, type string")


def test_phrases_in_pieces_are_those_of_one_piece(spark, monkeypatch):
    tokens = keep(messages.tokenized(spoken(spark)))
    told = lambda: {tuple(r[c] for c in ("term", "uses", "voices", "active_days", "first_ts")) for r in messages.phrase_inventory(tokens, 3).collect()}
    whole, one = told(), plan(messages.phrase_inventory(tokens, 3))
    assert one.count("Exchange") == 1 and {t for t, *_ in whole} >= {"alpha beta", "alpha beta gamma"}
    monkeypatch.setattr(plans, "PIECE", 1)
    assert told() == whole and plan(messages.phrase_inventory(tokens, 3)).count("Exchange") == 0  # each piece is written


def test_history_terms_in_pieces_have_both_periods(spark, monkeypatch):
    tokens = keep(messages.tokenized(spoken(spark)))
    told = lambda: {r.term: (r.size, r.uses, r.voices, r.recent_uses, r.previous_uses) for r in messages.history_terms(tokens).collect()}
    whole = told()
    assert whole["alpha beta"][1:3] == (27, 5) and sum(whole["alpha"][3:]) == 27 and whole["alpha"][3] != whole["alpha"][4]
    monkeypatch.setattr(plans, "PIECE", 1)
    assert told() == whole


def test_a_long_message_is_not_compared_pair_by_pair(spark):
    """Distinct units and pairs are strings, which Spark hashes; pairs and kinds are as before."""
    unit = lambda term, at, kind="word": (term, kind, at, at + (kind == "bigram"), True)
    said = [unit("alpha", 0), unit("beta gamma", 1, "bigram"), unit("alpha", 3), unit("delta", 30)]
    rows = spark.createDataFrame([("m", "s", "u", "room", "2026-01-01", said)], "id string, server_id string, speaker string, channel string, day string, units array<struct<term:string,kind:string,start:int,end:int,content:boolean>>")
    facts = units.unit_facts(rows)
    assert {(r.term, r.kind, r.uses, r.documents) for r in facts.collect()} == {("alpha", "word", 2, 1), ("beta gamma", "bigram", 1, 1), ("delta", "word", 1, 1)}
    keep_all = rows.select("server_id", F.explode("units.term").alias("term"))
    pairs = units.pair_documents(rows, keep_all)
    assert [tuple(r) for r in pairs.select("l", "r", "documents").collect()] == [("alpha", "beta gamma", 1)]
    long = spark.range(1).select(F.lit("s").alias("server_id"), F.lit("u").alias("speaker"), F.lit("room").alias("channel"), F.lit("2026-01-01").alias("day"), F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.struct(
        F.concat(F.lit("w"), i).alias("term"), F.lit("word").alias("kind"), i.alias("start"), i.alias("end"), F.lit(True).alias("content"))).alias("units"))
    began = time.time()
    assert units.unit_facts(long).count() == 60_000 and time.time() - began < 15
