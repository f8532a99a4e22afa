"""Ids and the texts they give again come from one Python pass."""

import corpus_pipeline
from eligo.llm import pieces


def test_ids_and_texts_in_one_pass(spark):
    texts = ["a b  c", "", None, "▁x अक \U0001f600", "the the the"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    vocabulary = pieces.Vocabulary.load()
    both = pieces.encode_and_decode(docs, vocabulary).orderBy("doc_id").collect()
    apart = pieces.decode(pieces.encode(docs, vocabulary), vocabulary, to="decoded").orderBy("doc_id").collect()
    assert both == apart and [r["decoded"] for r in both] == texts
    for plan in (corpus_pipeline.token_ids(spark, docs, ""), pieces.round_trip(docs, vocabulary)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
