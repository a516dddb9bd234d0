"""Cases from reviews of the pipeline."""

import numpy as np

import corpus_pipeline
from hydrospark.llm import shingle_dedup


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """With no MinHash bucket shared, what operator 7 links is found, and its links are still verified on whole sets."""
    import itertools

    fresh = itertools.count(1)
    monkeypatch.setattr(shingle_dedup, "band_keys", lambda s: np.array([next(fresh)], np.int64))
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), "some other text of no more than nine words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {0, 2}
    loose = shingle_dedup.simhash_candidates(df)
    assert loose.groupBy("key").count().filter("count = 2").count() == 1
    none = shingle_dedup.drop_near_copies(df, least=1.0, candidates=loose)
    assert none.count() == 3
