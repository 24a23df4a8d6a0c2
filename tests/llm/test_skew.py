import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import common, decision_list, golay, hd_langid, line_chunks, maxscore
from isohyet.llm.common import classes, numbered, spread_join, written
from isohyet.llm.entropy_mix import entropy_mix, mixed_documents
from isohyet.llm.slack_packing import slack_packing

from .test_mix_and_lines import brute_targets
from .test_models import brute_statistics, brute_top
from .test_near_duplicates import find

# Hot keys


def test_spread_join_like_a_join(spark):
    rows = written(spark.range(20_000).selectExpr("IF(id % 2 = 0, 7, id % 500) AS k", "id", "id AS _salt"))
    table = rows.groupBy("k").agg(F.count("*").alias("_n"), F.sum("id").alias("s")).filter("k % 3 <> 2")
    for how in ("inner", "left"):
        want = Counter(map(tuple, rows.join(table.drop("_n"), "k", how).select("k", "id", "_salt", "s").collect()))
        joined = spread_join(rows, table, ["k"], 20_000, how, least=100)
        assert Counter(map(tuple, joined.select("k", "id", "_salt", "s").collect())) == want
        assert set(joined.columns) == {"k", "id", "_salt", "s"}


def test_equal_rows_are_numbered_in_many_cells(spark):
    rows = written(spark.range(40_000, numPartitions=8).selectExpr("'x' AS k", "IF(id % 2 = 0, NULL, id) AS v").withColumn("_part", F.spark_partition_id()))
    got = numbered(rows, ["k"], ["v"], 40_000, part="_part").toPandas()
    assert sorted(got["rank"]) == list(range(40_000))
    again = numbered(rows.repartition(5), ["k"], ["v"], 40_000, part="_part").toPandas()
    same = lambda f: f.dropna().sort_values("v")["rank"].tolist()
    assert same(got) == same(again)  # numbers of different rows depend on their contents only


def test_star_and_path(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(200)]
    own = {r.node: r.root for r in classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert own == {**{i: 0 for i in range(3000)}, **{5000 + i: 5000 for i in range(201)}}


def test_crowded_keys(spark):
    """Thousands of fingerprints that agree in whole segments, few of which are near."""
    rng = random.Random(4)
    base, prints = rng.getrandbits(64), set()
    for _ in range(300):
        x = (base & ((1 << 46) - 1)) | rng.getrandbits(18) << 46
        prints |= {x, x ^ (1 << rng.randrange(64)), x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    prints = sorted(prints)
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]
    want = find(links, prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowd in (8, 1 << 14):
        got = {r.fp % (1 << 64): r.root for r in golay.fingerprint_classes(frame, crowd=crowd).collect()}
        group = lambda of: Counter(frozenset(k for k in of if of[k] == v) for v in set(of.values()))
        assert group(got) == group(want)


def test_finer_keys_of_near_fingerprints():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        b = a.copy()
        for i in rng.integers(0, 64, 3):
            b ^= np.uint64(1) << np.uint64(i)
        key = np.array([5], np.uint64)
        assert set(golay.finer_keys(key, a)[1].tolist()) & set(golay.finer_keys(key, b)[1].tolist())


def test_repeats_of_a_row(spark):
    n = 12_000
    rows = [(1, "same words here", "s")] * (n // 2) + [(None, "same words here", "s")] * (n // 4) + [(i + 10, f"w{i} other text", "t") for i in range(n // 4)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = entropy_mix(documents).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    mixed = Counter(r.doc_id for r in mixed_documents(documents).collect())
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert mixed == Counter({k: v for k, v in copies.items() if v})
    packed = slack_packing(documents).collect()
    assert len(packed) == n
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    assert {r.component_id for r in golay.simhash_classes(documents.filter("source = 's'")).collect()} == {1}


# The mix by brute force


def test_rates_and_copies_like_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 2, 5, 9, 30, 200]), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    size = lambda t: len(t.split())
    by_source = {}
    for _, t, s in rows:
        by_source.setdefault(s, []).append(size(t))
    targets = brute_targets({s: sum(v) for s, v in by_source.items()})
    got = {r.doc_id: r for r in entropy_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for s, sizes in by_source.items():
        sizes = [x for x in sizes if x]
        mean = sum(sizes) / len(sizes)
        rate = lambda x, t: min(3.0, math.exp(min(t * x / mean, 5.0)))
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(x * rate(x, mid) for x in sizes) < targets[s] else (lo, mid)
        wanted = taken = 0.0
        for x in sorted(set(sizes), reverse=True):
            n = sizes.count(x)
            wanted += n * x * rate(x, lo)
            copies = min(3 * n, max(0, math.floor((wanted - taken) / x + 0.5)))
            taken += copies * x
            own = [got[i] for i, t, q in rows if q == s and size(t) == x]
            assert all(r.rate == pytest.approx(rate(x, lo), rel=1e-4) for r in own)
            assert sum(r.copies for r in own) == copies and max(r.copies for r in own) - min(r.copies for r in own) <= 1


# Others by brute force


def test_long_texts_of_repeats(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(n)) for n in (6, 7, 50, 3000, 60_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decision_list.with_statistics(rows).collect():
        assert r.n_repeat_words == brute_statistics(texts[r.doc_id])[4]


def test_predictions_like_brute_force(spark):
    texts = [("the house and the garden of the town", "en"), ("das haus und der garten der stadt", "de"), ("la casa y el jardin de la ciudad", "es")]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts * 7)] + [(100 + i, t, None) for i, t in enumerate(["the garden", "der garten", "el jardin y la casa", "xyz", "the die la"])]
    first, second, third = hd_langid._places(1024, 7)

    def bundle(text):
        v = np.zeros(1024)
        for g in hd_langid.grams_of(text).tolist():
            v += first[g >> 12].astype(int) * second[g >> 6 & 63] * third[g & 63]
        return v

    sums = {}
    for _, t, lang in rows:
        if lang:
            sums[lang] = sums.get(lang, 0) + bundle(t) / len(hd_langid.grams_of(t))
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    got = {r.doc_id: r for r in hd_langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=10**9).collect()}
    for i, t, _ in rows:
        best = max(sorted(sums), key=lambda k: cosine(bundle(t), sums[k]))
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0, cosine(bundle(t), sums[best])), abs=1e-5)


def test_boundaries_like_brute_force():
    import xxhash

    multiplier, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for seed in range(30):
        rng = random.Random(seed)
        lines = [f"line {rng.randrange(50)}" for _ in range(rng.randrange(1, 90))]
        own = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
        want, size = [], 0
        for i in range(len(lines)):
            rolling = (own[i] + (own[i - 1] * multiplier if i else 0)) & mask
            rolling = (rolling ^ rolling >> 32) * multiplier & mask
            size += 1
            if (rolling ^ rolling >> 29) % 2 == 0 and size >= 2 or i == len(lines) - 1 or size == 64:
                want.append(i + 1)
                size = 0
        if len(want) > 1 and want[-1] - want[-2] < 2:
            del want[-2]
        chunks = line_chunks.chunks_of("\n".join(lines))
        assert np.cumsum([n for _, n in chunks]).tolist() == want


def test_search_of_large_components(spark):
    made = [(0, [1e4] * 64), (1, [1e8] * 64), (2, [1e9] * 64), (3, [-1e12] * 64), (50, [3e37] * 64), (4, [3e38] * 64), (5, [3.1e38] * 60), (6, [0.0] * 64)]
    own = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    ends = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    assert sorted(map(tuple, maxscore.top_k(own).collect())) == [(a, b, c, ends(s)) for a, b, c, s in brute_top(own.collect())]
    own = spark.createDataFrame([(i, [10.0 ** (i % 5 + 3), -5.0 * i]) for i in range(60)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, maxscore.top_k(own).collect())) == brute_top(own.collect())


# Clashing names and odd rows


NAMES = ["score", "lang_pred", "_hd_lang", "_start", "_cell", "_n", "_salt", "_hot", "mix_id", "mix_place", "gs_id", "n_lines_removed", "N_Chunks_removed", "rank", "copies", "key", "fp", "place", "content", "_hash"]


@pytest.fixture(scope="module")
def odd(spark):
    passage = "\n".join(f"line {i} of the passage that some share" for i in range(12))
    rows = [(1, None, "en"), (2, "", "en"), (3, f"the own start\n{passage}", "en"), (4, f"the other start\n{passage}", "en"), (4, f"the other start\n{passage}", "en"), (4, "the same id", "en"), (None, "the null id", "en"), (None, "the null id", "en"), (5, "der hund und die katze", None), (6, "the " * 5000, "en"), (7, "!!", "en")]
    documents = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return documents.withColumns({n: F.lit(i) for i, n in enumerate(NAMES)})


@pytest.mark.parametrize("stage", [hd_langid.known_language, lambda d: line_chunks.deduplicated_lines(d, run_words=50), golay.one_of_each, mixed_documents])
def test_stages_keep_all_columns(odd, stage):
    out = stage(odd)
    rows = out.collect()
    assert out.columns == odd.columns and rows and all(r[n] == i for r in rows for i, n in enumerate(NAMES))
    assert stage(odd.limit(0)).count() == 0
    again = stage(stage(odd))
    assert again.columns == odd.columns and again.count() <= 3 * len(rows)


def test_names_of_the_operator_are_refused(odd):
    with pytest.raises(ValueError, match="_lc_text"):
        line_chunks.line_chunk_dedup(odd.withColumn("_lc_text", F.lit(1)))


def test_whole_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.drop("N_Chunks_removed").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {2, 3, 4, 5, 6, None} and out


def test_no_silent_local_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": lambda self, k, d: d})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())


def test_released_tables_go(spark):
    import os

    frame = written(spark.range(3))
    path = frame.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(path)
    common.release(frame)
    assert not os.path.exists(path)


def test_caches_are_bounded_by_bytes():
    import pyarrow as pa

    from isohyet.llm.pretokens import PieceCache, vocabulary_path

    cache = PieceCache(vocabulary_path("word_bpe_49k.json"), len, 0, {"the": 1}, 10**6, most_bytes=20_000)
    texts = pa.array(["the " + "x" * 20_000, *(" ".join(f"w{i}{'ab' * 50}{j}" for j in range(40)) for i in range(50))])
    counts = list(cache.values_of(texts, sum))
    assert len(counts) == 51 and cache.bytes <= 20_000 and max(map(len, cache)) <= 256 and cache["the"] == 1
    assert sum(map(len, cache)) <= 20_000 and sum(map(len, cache.old)) <= 21_000
