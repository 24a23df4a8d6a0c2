from collections import Counter

import corpus_pipeline
from isohyet.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == columns
        kept[name], docs = out.collect(), out
    ids = {k: Counter(r.doc_id for r in v) for k, v in kept.items()}
    assert len(kept["language"]) == len(kept["lines"]) == 200
    assert set(ids["near_duplicates"]) < set(ids["lines"]) and max(ids["near_duplicates"].values()) == 1
    assert set(ids["mix"]) <= set(ids["near_duplicates"]) and max(ids["mix"].values()) <= 3
    pieces = Counter(r.doc_id for r in kept["packing"] if r.piece == 0)
    assert pieces == ids["mix"]
    used = Counter()
    for r in kept["packing"]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in kept["packing"])


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
