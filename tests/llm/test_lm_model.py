import math
import zlib
from collections import Counter

import numpy as np
import pytest

from isohyet.llm import bloom_lm

EDGES = [1, 2, 3, 4, 5, 7, 9, 12, 16, 22, 31, 43, 60, 84, 118, 166, 234, 330, 466, 659, 931, 1316, 1861, 2631, 3720, 5260, 7438, 10518]


def low(n):
    return max((e for e in EDGES if e <= n), default=0)


def high(n):
    return min(e for e in EDGES if e > n) - 1


def brute_scores(rows, priors):
    """The model from plain dictionaries of the same quantised counts."""
    words = {i: ["<s>"] * len(priors) + [*(t or "").encode().lower().split(), "</s>"] for i, t in enumerate(rows)}
    counts, m = Counter(), len(priors)
    for i, own in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            for at in range(m, len(own)):
                for n in range(m + 1):
                    counts[tuple(own[at - n : at + 1])] += 1
    ends = counts["</s>",]
    total, distinct = sum(n for k, n in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)
    out = {}
    for i, own in words.items():
        score = 0.0
        for at in range(m, len(own)):
            p, most = (low(counts[own[at],]) + 0.1) / (total + 0.1 * (distinct + 1)), high(counts[own[at],])
            for n, prior in enumerate(priors, 1):
                run, history = tuple(own[at - n : at + 1]), tuple(own[at - n : at])
                seen = high(ends if set(history) == {"<s>"} else counts[history])
                most = min(high(counts[run]), most, seen)
                p = (min(low(counts[run]), most) + prior * p) / (seen + prior)
            score += math.log10(p)
        out[i] = score
    return out


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdeFGH"), rng.integers(0, 40), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(150)] + [None, "", "a " * 500, "a b c"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("priors", [(100.0,), (100.0, 4.0), (5.0, 2.0, 1.0)])
def test_scores_like_brute_force(documents, priors):
    want = brute_scores([r.text for r in documents.orderBy("doc_id").collect()], priors)
    for r in bloom_lm.lm_scores(documents, priors=priors, bits_per_entry=4096).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9), r.doc_id


def test_edges():
    assert bloom_lm.EDGES[: len(EDGES)].tolist() == EDGES


@pytest.mark.parametrize("options", [{"broadcast_bytes": 0}, {"broadcast_bytes": 0, "bucket_bytes": 64, "frequent": 2}, {"shard_bytes": 64}])
def test_every_way_gives_the_same(documents, options):
    own = lambda **x: {r.doc_id: r for r in bloom_lm.lm_scores(documents, **x).collect()}
    want, got = own(), own(**options)
    assert set(want) == set(got)
    for k, r in want.items():
        assert got[k].score == r.score and got[k].n_known == r.n_known and got[k].base_score == pytest.approx(r.base_score, rel=1e-12)


@pytest.mark.parametrize("segment_bits", [64, 1 << 10, 1 << 13])
def test_every_key_is_found_at_any_size(segment_bits):
    key = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F)
    n = np.random.default_rng(1).geometric(0.3, len(key))
    segments, bits = bloom_lm.build_segments(key, n, 8, segment_bits)
    assert all(8 * len(b) == segment_bits for b in bits)
    assert (bloom_lm.Filter(dict(zip(segments.tolist(), bits))).levels(key) >= bloom_lm.quantised(n)).all()


def test_blobs_keep_keys_and_counts():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    n = rng.integers(1, 2000, len(key))
    for bits in (8, 11):
        cut = bloom_lm._by_bucket(key, bits)
        back, times = bloom_lm._Sums(), 0
        for i in range(1 << bits):
            k, c = bloom_lm._unpacked(bloom_lm._packed(key[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]), i, bits, True)
            back.add(k, c.astype(np.int64))
        got = back.result()
        assert (got[0] == np.unique(key)).all() and got[1].sum() == n.sum()


def test_sums_stay_compact():
    sums = bloom_lm._Sums()
    for _ in range(50):
        sums.add(np.arange(100_000, dtype=np.uint64), np.ones(100_000, np.int64))
        assert sums.size <= 2 * (1 << 20) + 100_000
    key, n = sums.result()
    assert len(key) == 100_000 and (n == 50).all()
