import pytest
from pyspark.sql import functions as F

from parlance import schemas
from parlance.sources import corpus
from parlance.streaming.ingest import ingest

SCHEMA = "id string, timestamp string, message string, attachments array<struct<name:string,url:string,bytes:bigint,file:string>>, reactions array<struct<emoji:string,count:bigint>>, seq long"


def message(i, seq=0, ts="2026-06-30T23:59:00Z", files=(), reactions=None, text="hi"):
    return (i, ts, text, [("n", u, 1, f) for u, f in files], reactions, seq)


def merged(spark, old, new):
    stored = spark.createDataFrame(old, SCHEMA).withColumn("month", corpus.month_of(F.col("timestamp")))
    rows, receipt = corpus.merge(stored, spark.createDataFrame(new, SCHEMA))
    total = receipt.agg(F.sum("added"), F.sum("updated"), F.sum("unchanged")).first()
    return rows.collect(), tuple(total)


def test_repeat_in_a_batch_counts_once(spark):
    rows, receipt = merged(spark, [], [message("a"), message("a", 1)])
    assert len(rows) == 1 and receipt == (1, 0, 1)


def test_new_reactions_update(spark):
    rows, receipt = merged(spark, [message("a")], [message("a", reactions=[("x", 2)])])
    assert receipt == (0, 1, 0) and rows[0].reactions[0]["count"] == 2


def test_local_file_survives_a_new_link(spark):
    rows, receipt = merged(spark, [message("a", files=[("https://c/x/f.png?ex=1", "m/f.png")])], [message("a", files=[("https://c/x/f.png?ex=2", None)])])
    assert rows[0].attachments[0]["file"] == "m/f.png" and rows[0].attachments[0]["url"].endswith("ex=2") and receipt == (0, 1, 0)


def test_months(spark):
    rows, _ = merged(spark, [], [message("a"), message("b", 1, "2026-07-01T00:01:00Z"), message("c", 2, "odd")])
    assert sorted(r.month for r in rows) == ["2026-06", "2026-07", "undated"]


def test_missing_id_fails(spark):
    with pytest.raises(Exception, match="no id"):
        merged(spark, [], [message(None)])


def test_threads_compare_instants(spark):
    rows = spark.createDataFrame([("a", "2026-01-02T01:30:00+03:00"), ("b", "2026-01-02T00:00:00+03:00"), ("c", "?")], "id string, archive_timestamp string")
    assert sorted(r.id for r in corpus.threads_in_window(rows, "2026-01-01 22:00:00").collect()) == ["a", "c"]


def test_reference_counts(spark, tmp_path):
    (tmp_path / "w.txt").write_text("the\t10\nbad line\nthe\t12\nof\tx\nand\t3\n")
    assert {r.term: r.cnt for r in corpus.reference_counts(spark, str(tmp_path / "w.txt")).collect()} == {"the": 12, "and": 3}
    with pytest.raises(RuntimeError):
        corpus.reference_counts(spark, str(tmp_path / "w.txt"), digest="0" * 64)
    with pytest.raises(RuntimeError):
        corpus.reference_counts(spark, str(tmp_path / "w.txt"), least_rows=5)


def test_ingest_is_idempotent(spark, tmp_path):
    incoming, history = str(tmp_path / "in"), str(tmp_path / "history")
    rows = spark.createDataFrame([("a", "2026-06-30T23:59:00Z", "x"), ("b", "2026-07-01T00:01:00Z", "y")], "id string, timestamp string, message string")
    rows.write.json(incoming)
    ingest(spark, incoming, history, str(tmp_path / "cp1")).awaitTermination()
    ingest(spark, incoming, history, str(tmp_path / "cp2")).awaitTermination()
    rows.where("id = 'a'").withColumn("message", F.lit("z")).write.mode("append").json(incoming)
    ingest(spark, incoming, history, str(tmp_path / "cp2")).awaitTermination()
    assert {(r.id, r.message, r.month) for r in corpus.read_history(spark, history).collect()} == {("a", "z", "2026-06"), ("b", "y", "2026-07")}
    assert schemas.MESSAGE


def plain_merge(old, new):
    """(last version by id, receipt): versions folded one after another, as lists."""
    path = lambda u: u.partition("?")[0]
    rows, receipt = {i: (i, ts, t, a) for i, ts, t, a, _, _ in old}, [0, 0, 0]
    for i, ts, t, a, _, _ in sorted(new, key=lambda m: m[5]):
        before = rows.get(i)
        known = [x for x in (before[3] or [] if before else []) if x[3]]
        find = lambda u: next((k[3] for k in reversed(known) if path(k[1]) == path(u)), None)  # noqa: E731, B023
        now = (i, ts, t, a and [(n, u, b, f or find(u)) for n, u, b, f in a])
        receipt[0 if before is None else 2 if now == before else 1] += 1
        rows[i] = now
    return rows, tuple(receipt)


@pytest.mark.parametrize("seed", range(4))
def test_merge_is_the_fold_of_all_versions(spark, seed):
    r = __import__("random").Random(seed)
    some = lambda: [(f"https://c/{r.choice('pq')}.png?ex={r.randrange(2)}", r.choice([None, None, "", "m/1", "m/2"])) for _ in range(r.randrange(4))]
    make = lambda i, seq: message(i, seq, files=some(), text=r.choice(["a", "b"]))
    old, new = [make(f"i{k}", 0) for k in range(6)], [make(f"i{r.randrange(9)}", s) for s in range(80)]
    old = [(*m[:3], [(n, u, b, f or None) for n, u, b, f in m[3]], *m[4:]) for m in old]
    rows, receipt = merged(spark, old, new)
    want, counts = plain_merge(old, new)
    assert receipt == counts and {x.id: (x.message, [tuple(a) for a in x.attachments]) for x in rows} == {i: (m[2], m[3]) for i, m in want.items()}


def test_an_id_of_very_many_versions_streams(spark):
    n = 60_000
    new = spark.range(n).select(F.lit("a").alias("id"), F.lit("2026-06-30T23:59:00Z").alias("timestamp"), (F.col("id") / 2).cast("long").cast("string").alias("message"), F.col("id").alias("seq"))
    new = new.withColumn("attachments", F.array(F.struct(F.lit("n").alias("name"), F.lit("https://c/x").alias("url"), F.lit(1).cast("long").alias("bytes"), F.when(F.col("seq") == 5, "m/5").alias("file"))))
    stored = new.limit(0).drop("seq").withColumn("month", F.lit(""))
    rows, receipt = corpus.merge(stored, new)
    assert tuple(receipt.first())[1:4] == (1, n // 2, n // 2 - 1) and rows.first().attachments[0]["file"] == "m/5"
