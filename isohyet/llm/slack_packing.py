"""Best-fit packing by minimum bin slack.

Documents become token ids followed by an end id; only those longer than a sequence are cut, into full pieces and a rest.
Which piece goes where depends on lengths only, and there are at most `capacity` different lengths: so the plan is
made from the histogram of lengths, which is bounded whatever the corpus, and holds *patterns* (a combination of
lengths and how often it is used) instead of single bins. For each pattern the longest remaining length is placed and
a subset-sum dynamic program over the remaining lengths, a bitset of reachable sums, finds the fullest combination that
fits beside it; it is removed as often as the counts allow. Each removal leaves some length with fewer pieces than the
pattern has, so there are at most a few thousand patterns.

Pieces are then numbered within their length (in cells, see common.numbered, as a third of all pieces may be full ones, and many of those equal),
and a number is looked up in the plan.

Null text counts as empty: one piece with only the end id. Repeated rows are packed as often as they occur; which of several equal lengths goes into which sequence is a matter of
their hashes. Very long texts are cut into full pieces, one text at a time (about 40 bytes a word in memory). Null
ids are kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, numbered, sliced, written
from .pretokens import PieceCache, vocabulary_path

def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _cut(batches, path, tag, capacity, end_id, most):
    cache, end, step = kept(tag, lambda: PieceCache(path, _bytes_of, b"", {}, most)), _bytes_of([end_id]), 4 * capacity
    for batch in sliced(batches, tag=tag):
        rows, pieces, starts, lengths, sums = (array("q") for _ in range(5))
        for row, ids in enumerate(cache.values_of(pc.fill_null(batch.column(1), ""), b"".join)):
            ids += end
            for piece, at in enumerate(range(0, len(ids), step)):
                own = ids[at : at + step]
                rows.append(row)
                pieces.append(piece)
                starts.append(at // 4)
                lengths.append(len(own) // 4)
                sums.append(zlib.crc32(own))
        ids = batch.column(0).take(pa.array(np.asarray(rows, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.asarray(pieces, dtype=np.int32)), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (starts, lengths, sums))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def cut_documents(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, cache_pieces: int = 450_000) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    cut = functools.partial(_cut, path=vocabulary_path(vocabulary), tag=uuid.uuid4().hex, capacity=capacity, end_id=end_id, most=cache_pieces)
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the available lengths (length -> how many), the combination with the largest sum up to room."""
    if room <= 0:
        return {}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, before = min(counts[length], room // length), reach
        k = 1
        while n > 0:
            k = min(k, n)
            reach |= (reach << (k * length)) & mask
            n -= k
            k *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return chosen


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces of it) and how many sequences each is used for; all pieces are placed."""
    counts, patterns = {k: n for k, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fullest({k: n for k, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        patterns.append((pattern, times))
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return patterns


def _slots(patterns) -> dict[int, np.ndarray]:
    """Length -> rows (first number, pieces a sequence, first sequence, offset of the first piece), ascending."""
    taken, slots, sequence = {}, {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            slots.setdefault(length, []).append((taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def _place(batches, slots):
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            first, n, base, start = slots.value[int(one)][np.searchsorted(slots.value[int(one)][:, 0], rank[at], "right") - 1].T
            sequence[at] = base + (rank[at] - first) // n
            offset[at] = start + (rank[at] - first) % n * one
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces; sequences are at most capacity long and gapless from 0."""
    pieces = written(pieces.withColumn("_part", F.spark_partition_id()))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_patterns(counts, capacity)))
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], sum(counts.values()), part="_part")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(functools.partial(_place, slots=slots), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def slack_packing(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_documents(documents, vocabulary, capacity, end_id), capacity)
