import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isohyet.llm import golay, queries
from isohyet.llm.common import classes


def find(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBcC \t\n\x0b\x1c\xa0éÉ", max_size=60))
def test_fingerprints_like_brute_force(text):
    assert golay.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_the_engines(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("x y",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert golay.fingerprint("X  y") == r.h % (1 << 64)


def test_code_is_perfect():
    x = np.arange(1 << 23, dtype=np.int64)
    low, high, errors = golay._syndromes()
    e = errors[low[x & 0xFFF] ^ high[x >> 12]]
    assert np.bitwise_count(e).max() == 3
    assert np.unique(x ^ e).size == 1 << 12


@settings(max_examples=300, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=3))
def test_pairs_within_three_bits_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    row, key = golay.fuzzy_keys(np.array([x, y], np.uint64))
    assert set(key[row == 0]) & set(key[row == 1])


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 6).astype(np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 62, 40).astype(np.uint64)) for b in base]))
    links = [(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ a) <= 3]]
    nodes = [int(a) for a in fp]
    own = golay.forest(fp, 3)
    assert len(own) < len(fp)
    assert find([(int(a), int(b)) for a, b in own], nodes) == find(links, nodes)


def test_classes_of_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == find([e for e in edges if e[0] != e[1]], nodes)
    assert classes(spark.createDataFrame([], "a long, b long")).count() == 0


def check(rows, documents):
    prints = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in documents}
    distinct = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3]
    root = find(links, distinct)
    lowest = {}
    for (doc, _), p in prints.items():
        if doc is not None:
            lowest[root[p]] = min(doc, lowest.get(root[p], doc))
    want = sorted(((r.doc_id, f"{prints[r.doc_id, r.text]:016x}", lowest.get(root[prints[r.doc_id, r.text]])) for r in documents), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


def test_whole_table_like_brute_force(spark, sf_dir):
    check(queries.op8_golay_simhash(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None, "q"), (2, "a b c d", "s"), (2, "a b c d", "s"), (None, "A b  c D", "t"), (4, "", "u"), (None, "zz z", None), (7, long, "v"), (8, long + " more", "v"), (9, "\x0b", "w"), (10, "one", "x"), (10, "other words here", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


def test_edge_cases(odd):
    check(golay.simhash_classes(odd).collect(), odd.collect())
    assert golay.simhash_classes(odd.limit(0)).count() == 0


def test_one_of_each(odd):
    kept = golay.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text[:3] if r.text else r.text) for r in kept.collect()), key=str) == sorted([(1, None), (2, "a b"), (None, "zz "), (7, "w0 "), (10, "one"), (10, "oth")], key=str)
    assert golay.one_of_each(odd.limit(0)).count() == 0
