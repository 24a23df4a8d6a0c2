import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isohyet.llm import queries
from isohyet.llm.pretokens import PieceCache, tokenizer, vocabulary_path
from isohyet.llm.slack_packing import fullest, plan_patterns, slack_packing
from isohyet.llm.token_counts import token_counts

PATH = vocabulary_path("word_bpe_49k.json")
ODD = "aAbB'sStTrReEvVmMlLdD’ .,!?19²½ßéÉÑñªº_-<|>\t\n\r\x0b\x0c\x1c\x85\xa0́ŉİıſǅǰΣσς中ー\xad©$%~`ȘșẞɏﬁſK‍🙂"
TEXTS = [None, "", " \n ", "a", "It's THEY'LL don't 'sx ''s", "<|endoftext|>", "a<|startoftext|>b", "tab\tand\x0bmore", "ẞtraße Σίσυφος", "x" * 30000, "word " * 9000, "Same text.", "Same text."]


def ids(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(max_codepoint=0x250, blacklist_categories=("Cs",))), max_size=40))
def test_pieces_give_the_librarys_ids(text):
    cache = PieceCache(PATH, list, [], {}, 8)
    assert next(iter(cache.values_of(pa.array([text]), lambda x: sum(x, [])))) == ids(text)


def test_cache_keeps_its_bound():
    cache = PieceCache(PATH, len, 0, {}, 50)
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=3)) + f" w{i}" for i in range(300)]
    assert list(cache.values_of(pa.array(texts), sum)) == [len(ids(t)) for t in texts]
    assert len(cache) <= 60 and len(cache.old) <= 60


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)] + [(11, TEXTS[11], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts_on_edge_cases(documents):
    got = [tuple(r) for r in token_counts(documents).collect()]
    want = [(r.doc_id, len((r.text or "").encode()), n := len(ids(r.text)), n > 2048) for r in documents.collect()]
    assert Counter(got) == Counter(want)
    assert token_counts(documents.limit(0)).count() == 0


def test_counts_on_a_whole_table(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes) == (len(ids(r.text)), len(r.text.encode()))


def check_packing(rows, texts: dict, capacity=2048):
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, own in by_doc.items():
        whole = [*ids(texts[doc]), 0]
        copies = len(own) // -(-len(whole) // capacity)
        want = Counter()
        for piece, at in enumerate(range(0, len(whole), capacity)):
            part = whole[at : at + capacity]
            want[piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += copies
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in own) == want
    return len(sequences), sum(r.length for r in rows)


def test_packing_on_edge_cases(documents):
    rows = slack_packing(documents).collect()
    check_packing(rows, {r.doc_id: r.text for r in documents.collect()})
    assert slack_packing(documents.limit(0)).count() == 0


def test_packing_of_a_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, total = check_packing(queries.op5_slack_packing(spark, sf_dir).collect(), texts)
    assert n <= 1.01 * -(-total // 2048) + 1


def brute_fullest(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_subset_sums_like_brute_force(counts, room):
    chosen = fullest(counts, room)
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == brute_fullest(counts, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_patterns_place_everything(counts):
    placed = Counter()
    for pattern, times in plan_patterns(counts, 64):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            placed[k] += n * times
    assert placed == Counter(counts)
