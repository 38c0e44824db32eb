import numpy as np

import brute
import corpus_pipeline as pipeline
from parlance.llm import simhash
from test_operators import DOCS, docs_frame, prose


def test_stages_keep_the_contract(spark, tmp_path):
    texts = [prose(k, 80) for k in range(60)]
    for k in range(60):
        texts[k] += "\nAll rights reserved." if k % 3 == 0 else f"\nline {k}"
    texts += [texts[5], texts[5], "12345", None, ""]
    rows = [(k, t, "en" if t and k % 2 else None, f"s{k % 2}", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)

    told = pipeline.identify_language(spark, docs, "").toPandas()
    assert sorted(told.doc_id) == list(range(62)) and list(told.columns) == list(pipeline.COLUMNS)

    lined = pipeline.dedup_lines(spark, spark.createDataFrame(told, DOCS), "").toPandas().set_index("doc_id")
    want = brute.pipeline_lines([(r.doc_id, r.source, r.text) for r in told.itertuples()])
    assert lined.text.to_dict() == want and (lined.n_chars == lined.text.str.len()).all()

    fps = {d: simhash.fingerprint(t) for d, t in lined.text.items()}
    label = brute.components(list(fps), list(fps.values()), simhash.MAX_BITS)
    near = pipeline.dedup_near_copies(spark, spark.createDataFrame(lined.reset_index()[list(pipeline.COLUMNS)], DOCS), "").toPandas()
    assert sorted(near.doc_id) == sorted(d for d, c in label.items() if d == c)

    cut = pipeline.dedup_substrings(spark, spark.createDataFrame(near, DOCS), "").toPandas().set_index("doc_id")
    want = brute.repeated(list(zip(near.doc_id, near.text)))
    assert cut.text.to_dict() == {d: k.decode("utf-8", "ignore") for d, (_, k) in want.items()}

    packed = pipeline.pack(spark, docs_frame(spark, list(cut.text)), "").toPandas()
    assert packed.groupby("doc_id").length.sum().tolist() == packed.groupby("doc_id").doc_tokens.first().tolist()
    assert np.all(packed.groupby("sequence_id").length.sum() <= 2048) and [n for n, _ in pipeline.STAGES][0] == "language ID"
