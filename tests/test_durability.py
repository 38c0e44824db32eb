"""What is published or stored survives a stop at any step."""

import pytest
from pyspark.sql import functions as F

from parlance.jobs import sink
from parlance.jobs.report import read_report
from parlance.sources import corpus, files
from parlance.streaming.ingest import ingest
from test_report import report


def table(spark, *servers):
    return spark.createDataFrame([(s, k, [float(k)]) for s in servers for k in range(3)], "server_id string, n int, v array<double>")


def names(spark, path, what):
    return files.children(spark, f"{path}/{what}")


def test_tables_without_rows_keep_their_schema(spark, tmp_path):
    path = str(tmp_path / "r")
    sink.publish(spark, {"some": table(spark, "007", "b"), "none": table(spark), "plain": spark.range(0)}, path)
    some, none = sink.read_table(spark, path, "some"), sink.read_table(spark, path, "none")
    assert some.schema == none.schema == table(spark).schema and none.count() == 0 and sink.read_table(spark, path, "plain").count() == 0
    assert {r.server_id for r in some.collect()} == {"007", "b"}  # a name of digits stays a name
    assert {r.name: r.n_rows for r in sink.manifest(spark, path).collect()} == {"some": 6, "none": 0, "plain": 0}
    with pytest.raises(KeyError):
        sink.read_table(spark, path, "other")


def test_a_stop_between_two_tables_leaves_the_published_report(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        sink.manifest(spark, path)
    sink.publish(spark, {"a": table(spark, "x"), "b": table(spark, "x", "gone")}, path)
    broken = table(spark, "y").withColumn("n", F.raise_error(F.lit("stopped")).cast("int"))
    with pytest.raises(Exception, match="stopped"):
        sink.publish(spark, {"a": table(spark, "y"), "b": broken}, path)
    assert {r.server_id for r in sink.read_table(spark, path, "a").collect()} == {"x"} and len(names(spark, path, "versions")) == 2
    # A manifest that was begun and not finished does not count.
    (tmp_path / "r" / "manifests" / "99999999999999999999-x" / "_temporary").mkdir(parents=True)
    assert {r.server_id for r in sink.read_table(spark, path, "b").collect()} == {"x", "gone"}
    sink.publish(spark, {"a": table(spark, "z"), "b": table(spark, "z")}, path, versions=1, orphan_hours=0)
    # Old versions, vanished servers and what the stop left behind are gone.
    assert {r.server_id for r in sink.read_table(spark, path, "b").collect()} == {"z"} and len(names(spark, path, "versions")) == 1


def test_versions_are_kept_as_many_as_asked_for(spark, tmp_path):
    path = str(tmp_path / "r")
    made = [sink.publish(spark, {"t": table(spark, s)}, path, versions=2) for s in "abc"]
    assert names(spark, path, "versions") == made[1:] == sink.published(spark, path)
    assert {r.server_id for r in sink.read_table(spark, path, "t", made[1]).collect()} == {"b"}
    with pytest.raises(FileNotFoundError):
        sink.manifest(spark, path, made[0])


def test_a_whole_report_with_empty_tables_is_read_back(spark, tmp_path):
    with report(spark, ["long time september event"] * 4, pairs=(("long time", 1),)) as r:
        want = {name: df.count() for name, df in r.tables().items()}
        r.write(str(tmp_path))
    assert {name: read_report(spark, str(tmp_path), name).count() for name in want} == want and 0 in want.values() and not r.held


# ---- history ---------------------------------------------------------------


def say(spark, incoming, *rows):
    spark.createDataFrame(list(rows), "id string, timestamp string, message string").coalesce(1).write.mode("append").json(incoming)


JUNE, JULY, MAY = "2026-06-30T23:59:00Z", "2026-07-01T00:01:00Z", "2026-05-02T00:00:00Z"


def stored(spark, history):
    return {(r.id, r.message, r.month) for r in corpus.read_history(spark, history).collect()}


@pytest.mark.parametrize("stop", ["stage", "ledger", "first move", "second move", "third move", "fourth move", "fifth move", "cleaning"])
def test_a_stop_anywhere_loses_no_month_and_counts_no_batch_twice(spark, tmp_path, monkeypatch, stop):
    incoming, history, checkpoint = (str(tmp_path / x) for x in ("in", "history", "cp"))
    say(spark, incoming, ("a", JUNE, "x"), ("b", JULY, "y"), ("m", MAY, "old"))
    ingest(spark, incoming, history, checkpoint).awaitTermination()
    say(spark, incoming, ("a", JUNE, "new"), ("b", JULY, "new"), ("c", JULY, "z"))
    with monkeypatch.context() as m:
        calls = []

        def fail(*_):
            raise OSError("stopped")

        def after(k, f):
            return lambda *a: fail() if len(calls) == k else (calls.append(1), f(*a))[1]

        if stop == "stage":
            m.setattr(corpus, "enter_ledger", fail)
        elif stop == "ledger":
            settle, entered = corpus.settle, []
            enter = corpus.enter_ledger
            m.setattr(corpus, "enter_ledger", lambda *a: (enter(*a), entered.append(1)))
            m.setattr(corpus, "settle", lambda *a: fail() if entered else settle(*a))
        elif stop == "cleaning":
            m.setattr(corpus.files, "remove", fail)
        else:
            m.setattr(corpus.files, "move", after(("first", "second", "third", "fourth", "fifth").index(stop.split()[0]), files.move))
        if stop == "fifth move":
            ingest(spark, incoming, history, checkpoint).awaitTermination()  # there are four: nothing stops
        else:
            with pytest.raises(Exception, match="stopped"):
                ingest(spark, incoming, history, checkpoint).awaitTermination()
    for _ in range(2):
        ingest(spark, incoming, history, checkpoint).awaitTermination()
        assert stored(spark, history) == {("a", "new", "2026-06"), ("b", "new", "2026-07"), ("c", "z", "2026-07"), ("m", "old", "2026-05")}
    told = {(r.batch[-1], r.month): (r.added, r.updated, r.unchanged) for r in corpus.receipts(spark, history).collect()}
    assert told == {("0", "2026-05"): (1, 0, 0), ("0", "2026-06"): (1, 0, 0), ("0", "2026-07"): (1, 0, 0), ("1", "2026-06"): (0, 1, 0), ("1", "2026-07"): (1, 1, 0)}
    assert not files.children(spark, f"{history}/_staged") and not files.exists(spark, f"{history}/_replaced")


def test_files_come_in_as_many_batches_as_asked(spark, tmp_path):
    incoming, history = str(tmp_path / "in"), str(tmp_path / "history")
    for k in range(3):
        say(spark, incoming, (f"m{k}", JUNE, "x"), ("same", JUNE, f"v{k}"))
    ingest(spark, incoming, history, str(tmp_path / "cp"), files_a_batch=1).awaitTermination()
    total = corpus.receipts(spark, history).agg(F.sum("added"), F.sum("updated"), F.countDistinct("batch")).first()
    assert tuple(total) == (4, 2, 3)
    assert corpus.receipts(spark, str(tmp_path / "nothing")).count() == 0
