"""Token counts by a map-side two-tier lookup.

Tier one is a table of frequent pre-tokens (pieces between white space, in lower case) and their numbers of tokens,
broadcast to the workers and kept beside their caches; tier two is each worker's cache, which encodes what the table misses. No pre-token is
shuffled, neither for counting nor for the table. The table only saves time: whatever it holds, results are the library's.

The table. Each task counts the pieces of its part of a sample of about `table_documents` documents, and gives the driver its most frequent ones of at most 32 characters,
`table_pieces` / 8 at most. These come one task after the other; the driver adds them up, keeps 8 * `table_pieces` at most and broadcasts the `table_pieces` most frequent ones (32,768 pieces: 1 MB). A worker's cache is bounded
by pieces and by bytes, and pieces of over 256 characters are not kept.

Null text counts as empty (0 bytes, 0 tokens); rows are neither joined nor grouped, so repeated rows stay repeated and
an empty table gives an empty result. Very long texts are counted whole, one at a time. Of equally frequent pieces the first by code point is in the table. Other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sliced
from .pretokens import UNPLAIN, PieceCache, tokenizer, vocabulary_path

def _heaviest(counts: Counter, most: int) -> list[tuple[str, int]]:
    return heapq.nsmallest(most, counts.items(), key=lambda x: (-x[1], x[0]))


def _frequent(batches, most):
    counts: Counter = Counter()
    for batch in batches:
        text = pc.fill_null(batch.column(0), "")
        for x in text.filter(pc.invert(pc.match_substring_regex(text, UNPLAIN))).to_pylist():
            counts.update(w for w in x.lower().split() if len(w) <= 32)
    rows = _heaviest(Counter({k: n for k, n in counts.items() if n > 1}), most)
    yield pa.RecordBatch.from_pydict({"piece": pa.array([x[0] for x in rows], pa.string()), "n": pa.array([x[1] for x in rows], pa.int64())})


def frequent_table(documents: DataFrame, path: str, table_documents: int, table_pieces: int) -> dict[str, int]:
    """The first tier: frequent pieces and their numbers of tokens."""
    texts = documents.select("text")
    sample = texts.sample(min(1.0, table_documents / max(1, texts.count())), seed=1)
    counts: Counter = Counter()
    for r in sample.mapInArrow(functools.partial(_frequent, most=max(1024, table_pieces // 8)), "piece string, n long").toLocalIterator():
        counts[r.piece] += r.n
        if len(counts) > 8 * table_pieces:
            counts = Counter(dict(_heaviest(counts, 4 * table_pieces)))
    pieces = [k for k, _ in _heaviest(counts, table_pieces)]
    return dict(zip(pieces, (len(x.ids) for x in tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)))) if pieces else {}


def _count(batches, path, table, tag, most):
    cache = kept(tag, lambda: PieceCache(path, len, 0, table.value, most))
    for batch in sliced(batches, tag=tag):
        text = pc.fill_null(batch.column(1), "")
        sizes = pc.binary_length(text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()))
        counts = pa.array(list(cache.values_of(text, sum)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int64()), counts], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, table_documents: int = 2000, table_pieces: int = 32768, cache_pieces: int = 250_000) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary_path(vocabulary)
    table = documents.sparkSession.sparkContext.broadcast(frequent_table(documents, path, table_documents, table_pieces))
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = documents.select("doc_id", "text").mapInArrow(functools.partial(_count, path=path, table=table, tag=uuid.uuid4().hex, most=cache_pieces), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
