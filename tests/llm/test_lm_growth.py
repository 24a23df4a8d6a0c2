import inspect

import numpy as np
import pytest

from isohyet.llm import bloom_lm


def test_no_pair_is_left_out_by_size():
    """Many more entries in a segment than one of 8,192 bits takes: all are found."""
    most = inspect.signature(bloom_lm.lm_scores).parameters["segment_bits"].default
    key = np.arange(1, 20001, dtype=np.uint64) * np.uint64(0x9E3779B97F)
    n = np.random.default_rng(1).geometric(0.7, len(key))
    own = bloom_lm.Filter(dict(zip(*bloom_lm.build_segments(key, n, 8, most))))
    assert (own.levels(key) >= bloom_lm.quantised(n)).all()
    assert (own.levels(key + np.uint64(1)) > 0).mean() < 0.1


@pytest.mark.parametrize("shard_bytes", [1 << 16, 1])
def test_scores_do_not_depend_on_shards(spark, sf_dir, shard_bytes):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60 if shard_bytes > 1 else 2).cache()
    score = lambda **x: sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in bloom_lm.lm_scores(documents, **x).collect())
    filter_ = bloom_lm.train(documents, 8, None, 1 << 19, shard_bytes)[0]
    assert len(filter_.parts) > 2
    assert score(shard_bytes=shard_bytes) == score()


def _shuffled(spark):
    """Bytes that shuffles have written so far, and those that are still on disk."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = [files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")]
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite(), sum(sizes)


def test_keys_travel_once_and_their_shuffle_is_deleted(spark, sf_dir):
    """A filter that isn't broadcast: no more is shuffled than counts, texts and answers, and nothing of it stays."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = sum(len((r.text or "").encode()) for r in documents.select("text").collect())
    written, there = _shuffled(spark)
    scored = bloom_lm.lm_scores(documents, broadcast_bytes=0)
    more, left = _shuffled(spark)
    print(text, more - written, left - there)
    assert more - written < 4 * text
    assert left - there < 0.2 * text
    assert scored.count() == documents.count()


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_scores_do_not_depend_on_rounds(spark, sf_dir, rounds):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    score = lambda **x: sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in bloom_lm.lm_scores(documents, **x).collect())
    assert score(broadcast_bytes=0, rounds=rounds) == score()


def test_a_filter_larger_than_expected_is_not_broadcast(spark, monkeypatch):
    """Few bytes of text a key: only the filter that was built tells its size."""
    documents = spark.createDataFrame([(i, " ".join(chr(97 + (i * k) % 23) for k in range(40))) for i in range(60)], "doc_id long, text string")
    score = lambda **x: sorted((r.doc_id, r.n_known, r.train_tokens, r.score) for r in bloom_lm.lm_scores(documents, **x).collect())
    want, called = score(), []
    monkeypatch.setattr(bloom_lm, "_broadcast_filter", lambda *a: called.append(a))
    assert score(broadcast_bytes=1000) == want and not called
