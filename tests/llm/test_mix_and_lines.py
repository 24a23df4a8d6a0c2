import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isohyet.llm import line_chunks, queries
from isohyet.llm.common import numbered
from isohyet.llm.entropy_mix import entropy_mix, mixed_documents, source_targets


def brute_targets(sizes: dict, most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def check(rows, documents):
    size = lambda t: len((t or "").encode().split())
    by_source = {}
    for d in documents:
        by_source[d.source] = by_source.get(d.source, 0) + size(d.text)
    targets = brute_targets(by_source)
    sources = {}
    for d in documents:
        sources.setdefault(d.doc_id, []).append((d.source, size(d.text)))
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in documents)
    taken = Counter()
    for r in rows:
        source = next(s for s, n in sources[r.doc_id] if n == r["size"] and by_source[s] == r.source_size)
        assert r.target == pytest.approx(targets[source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[source] += r.taken
    for source, t in targets.items():
        small = min([n for own in sources.values() for s, n in own if s == source and n], default=0)
        assert abs(taken[source] - t) <= max(small, 0.02 * t)


def test_mix_of_a_whole_table(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    first = queries.op3_entropy_mix(spark, sf_dir).collect()
    check(first, documents)
    assert Counter(queries.op3_entropy_mix(spark, sf_dir).collect()) == Counter(first)


def test_mix_on_edge_cases(spark):
    rows = [(1, None, "a", 1), (2, "x y z", "a", 1), (2, "x y z", "a", 1), (None, "p q", "b", 2), (4, "", "c", 3), (5, "w " * 20000, None, 4), (6, "s", "é", 5), (7, "t", "Z", 6)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    got = entropy_mix(documents).collect()
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert taken[1] == taken[4] == 0
    assert entropy_mix(documents.limit(0)).count() == 0 and mixed_documents(documents.limit(0)).count() == 0
    mixed = mixed_documents(documents)
    assert mixed.columns == documents.columns
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})


def test_targets_like_water_filling(spark):
    rng = random.Random(0)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000, 4000]) for i in range(n)} | {None: 10}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        for r in got:
            assert r.target == pytest.approx(want[r.source], abs=1e-6), (n, r)


def test_rates_are_tilted_by_size(spark, sf_dir):
    rows = queries.op3_entropy_mix(spark, sf_dir).filter("rate > 0 AND rate < 2.999 AND size > 0").collect()
    by_source = {}
    for r in rows:
        by_source.setdefault((r.source_size, r.target), set()).add(round(math.log(r.rate) / r["size"], 9))
    assert all(len(tilts) == 1 for tilts in by_source.values())


def test_numbers_in_cells(spark):
    data = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id")
    for k, own in numbered(data, ["k"], ["id"], 5000).toPandas().groupby("k"):
        assert sorted(own["rank"]) == list(range(len(own))), k


def brute_dedup(documents, least=2):
    """Documents in order of id, nulls last; a chunk with enough lines that was there before goes."""
    seen, out = {}, {}
    order = sorted({(d.doc_id is None, d.doc_id if d.doc_id is not None else 0, d.text or "", d.doc_id) for d in documents if d.text})
    for _, _, text, doc in order:
        kept = []
        for place, (chunk, n) in enumerate(line_chunks.chunks_of(text)):
            if n >= least and seen.setdefault(chunk, (doc, text, place)) != (doc, text, place):
                continue
            kept.append(chunk)
        out[doc, text] = "\n".join(kept)
    return out


def test_lines_of_a_whole_table(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute_dedup(documents)
    rows = queries.op4_line_chunks(spark, sf_dir).collect()
    own = {d.doc_id: d.text for d in documents}
    assert all(r.text == want[r.doc_id, own[r.doc_id]] for r in rows) and len(rows) == len(documents)
    assert sum(r.n_chunks_removed for r in rows) > 0


def test_lines_on_edge_cases(spark):
    passage = "\n".join(f"line {i} of a passage that many documents share" for i in range(12))
    rows = [(1, None, "q", 0), (2, "", "q", 0), (3, f"own start\n{passage}\nown end", "q", 9), (4, f"other\nstart\n\n{passage}", "q", 9), (4, "b\nsame id", "q", 3), (5, passage, "q", 3), (5, passage, "q", 3), (None, passage, "q", 1), (6, "\n\n \n", "q", 1), (7, "z" * 50000, "q", 1), (8, "\n".join(["again"] * 500), "q", 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, places string, n_chars long")
    out = line_chunks.line_chunk_dedup(documents)
    assert out.columns == [*documents.columns, "n_lines_removed", "n_chunks_removed"]
    got = out.collect()
    want = brute_dedup(documents.collect())
    assert len(got) == len(rows)
    texts = Counter((r.doc_id, r.text) for r in got)
    assert texts == Counter((d, want[d, t] if t else t) for d, t, _, _ in rows)
    assert all(r.n_chars == len(r.text or "") for r in got)
    five = [r for r in got if r.doc_id == 5]
    assert five[0].text == five[1].text
    assert five[0].n_lines_removed >= 8  # found although it begins at another line elsewhere
    assert line_chunks.line_chunk_dedup(documents.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n ", max_size=80))
def test_chunks_give_the_text_back(text):
    chunks = line_chunks.chunks_of(text)
    assert "\n".join(c for c, _ in chunks) == text
    assert sum(n for _, n in chunks) == sum(bool(x.strip()) for x in text.split("\n"))


def test_different_texts_with_one_hash(spark, monkeypatch):
    """The byte comparison: with a hash that sees lengths only, nothing wrong is removed."""
    import os
    import subprocess
    import sys

    code = '''
import sys, xxhash
sys.path.insert(0, sys.argv[1])
xxhash.xxh3_128_intdigest = lambda b: len(b)
from pyspark.sql import SparkSession
import pyspark.cloudpickle as cp
from isohyet.llm import line_chunks as lc
cp.register_pickle_by_value(lc)
def rows(batches, options, least_lines, only, real=lc._rows):
    import xxhash
    xxhash.xxh3_128_intdigest = lambda b: len(b)
    yield from real(batches, options, least_lines, only)
lc._rows = rows
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
d = spark.createDataFrame([(1, "a1\\na2"), (2, "b1\\nb2"), (3, "a1\\na2"), (4, "b1\\nb2"), (5, "c1\\nc2")], "doc_id long, text string")
print("GOT", sorted((r.doc_id, r.text) for r in lc.line_chunk_dedup(d, divisor=10**9).collect()))
'''
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=200)
    assert "GOT [(1, 'a1\\na2'), (2, 'b1\\nb2'), (3, ''), (4, ''), (5, 'c1\\nc2')]" in out.stdout, out.stderr[-2000:]
