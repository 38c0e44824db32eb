import corpus_pipeline as pipeline
from test_operators import DOCS, prose


def test_planted_lines_go_from_a_hot_and_a_small_source(spark):
    rows = []
    for k in range(3000):
        text = prose(k, 6)
        text += "\nLicensed under Z." * (k % 50 == 0) + "\nAll in one." * (k % 100 == 1) + "\nYes." * (k % 600 == 2)
        rows.append((k, text, "en", "hot", 0))
    for k in range(3000, 3060):
        text = prose(k, 6) + "\nLicensed under Z." * (k % 20 == 0) + "\nNo." * (k % 20 == 1)
        rows.append((k, text, "en", "small", 0))
    kept = pipeline.dedup_lines(spark, spark.createDataFrame(rows, DOCS), "").toPandas()
    gone = ("Licensed under Z.", "All in one.")
    want = {d: "\n".join(x for x in t.split("\n") if x not in gone) for d, t, *_ in rows}
    assert kept.set_index("doc_id").text.to_dict() == want
    assert kept.text.str.contains("Yes.", regex=False).sum() == 5 and kept.text.str.contains("No.", regex=False).sum() == 3
