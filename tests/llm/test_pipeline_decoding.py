"""The last stage decodes its ids."""

import corpus_pipeline


def test_ids_decode_to_the_text(spark):
    texts = ["Two words", "été à la maison", "line\nbreak  and spaces", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.tokenized(spark, docs, "").collect()}
    assert len(got) == len(texts) and got[0].round_trip and got[0].piece_ids
    assert all(r.round_trip is not None for r in got.values())
