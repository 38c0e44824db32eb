import corpus_pipeline as pipeline
from test_operators import DOCS, prose


def test_texts_stay_where_no_language_can_be_learned(spark):
    texts = [prose(0, 20), "12345", None, "", "Ünï 1", prose(1, 9)]
    rows = [(k, t, None, "s", 0) for k, t in enumerate(texts)]
    told = pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS), "").toPandas()
    assert sorted(told.doc_id) == [0, 4, 5]
