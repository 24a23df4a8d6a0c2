"""Language-model scores from a log-frequency Bloom filter.

Training texts give counts of words and of runs of 2 to `order` words. A count is quantised on a roughly geometric scale of whole numbers (1, 2, 3,
4, 6, 8, 12, ...: EDGES); a key of quantised count j is entered j times, as (key, 1) to (key, j). A lookup probes (key, 1), (key, 2), ...
until one is missing: the last one found is the quantised count. A wrong hit (odds about 3 in 100 a probe) so adds one step. An entry's four bits are in one 64-bit
word, so that a probe reads one place.

Counting. A block of texts sorts its different keys and sends them on as one blob for each *bucket* (the key's leading bits), so that the
shuffle moves a few fat rows; a blob has the differences of neighbouring keys. A bucket is summed while its blobs come in; what is held is compacted whenever it has doubled, so that memory is that of the bucket's
different keys. There are as many buckets as the texts have pieces of `bucket_bytes`, so a bucket doesn't grow with the input.

Filter. Keys are cut into 65,536 segments by their leading 16 bits, a segment's size in bits is `bits_per_entry` times its entries, in whole words: all are entered, and the
filter grows with the number of different runs. Up to `broadcast_bytes` it is broadcast to the workers in shards of `shard_bytes`, and a block of texts
probes one shard after the other; a worker maps a shard's file and has one mapped at a time. A larger filter (expected from the texts' size, or found when it is built) isn't moved at all: all texts,
not only those that are learned from, are counted (keys that only others have with the count 0), and a bucket, once summed and entered in its segments, probes them for the blobs that it has got and answers each with the
quantised counts. So keys travel once, in `rounds` parts of the buckets, of which the disk holds one at a time; texts and answers then meet by block. Scores are the same either way.

Model. P1(w) = (words(w) + 0.1) / (N + 0.1 * (V + 1)); for a history h of n - 1 words, which the text's start fills up,
Pn(w | h) = (runs(h, w) + m * Pn-1(w | h without its first word)) / (runs(h) + m), m = priors[n - 2]. w is a word or the text's end. Where counts are summed over w, the lower
edge of the quantised count is used, for runs(h) the upper edge, so that probabilities sum to at most 1 (but for wrong hits).

The base score needs exact counts: the `frequent` most frequent words are broadcast with their counts (16 bytes each); other words' occurrences
are joined with the table of counts by key. Words are 64-bit hashes throughout (XXH64; at 10 million different words, odds of a shared hash are 3e-6).

Null text counts as empty: one token, the end. Rows with a null id are never held out. Repeated rows are scored each and learned from as often as
they occur. Very long texts are blocks of their own: memory is some 150 bytes a word of the longest text. An empty table gives an empty result; with no training
text N = V = 0. Equal counts need no order. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import functools
import mmap
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, id_remainder, release, sliced, written

#: A key's segment is its leading 16 bits.
SEGMENTS, SEGMENT_SHIFT = 1 << 16, np.uint64(48)
#: Keys of longer runs lack their last byte, which needn't be sent then: of 10 ** 12 runs one in 70,000 shares its key, far fewer than the filter's wrong hits.
KEPT = np.uint64((1 << 64) - 256)
#: m of runs of 2, 3, ... words.
PRIORS = (100.0, 4.0)
ORDER = len(PRIORS) + 1
#: Bytes of text that give a byte of the filter: measured were 4.1 at 0.17 GB of text and 4.6 at 0.86 GB.
TEXT_PER_FILTER = 5


def _edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 62:
        edges.append(max(edges[-1] + 1, int(edges[-1] * 2**0.5)))
    return np.array(edges, dtype=np.float64)


#: EDGES[j - 1]: the least count whose quantised count is j.
EDGES = _edges()


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, counts, "right")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A word's hash; a dictionary of words, tried before, costs more than hashing again.
_hash = xxhash.xxh64_intdigest


#: Keys of the text's end and start: no word contains a space.
END, START = _hash(b"the end"), _hash(b"the start")


def tokens(text: str | None) -> np.ndarray:
    """Keys of a text's words and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.empty(len(words) + 1, np.uint64)
    own[:-1] = np.fromiter(map(_hash, words), np.uint64, len(words))
    own[-1] = END
    return own


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Keys of runs that are one word longer than those with the keys `before`."""
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + (after << np.uint64(1) | np.uint64(1))) & KEPT


def run_keys(own: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the runs of 1, 2, ..., order words that end at each token; texts begin at starts."""
    runs = [own]
    for n in range(1, order):
        before = np.empty_like(own)
        before[1:] = runs[-1][:-1]
        before[starts] = np.uint64((START + n) & (1 << 64) - 1)  # n times the start
        runs.append(pair_keys(before, own))
    return runs


def _in_blocks(texts: list[str | None], most: int = 1 << 20):
    """(place of the first text, the texts' tokens)."""
    block, n, first = [], 0, 0
    for i, text in enumerate(texts):
        block.append(tokens(text))
        n += len(block[-1])
        if n >= most or i == len(texts) - 1:
            yield first, block
            block, n, first = [], 0, i + 1


def _starts(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in block])
    return sizes, np.cumsum(sizes) - sizes


def _counted(key: np.ndarray, left_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each is there, not counting those left out (so 0 is possible)."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    other = None if left_out is None or not left_out.any() else _counted(key[left_out])
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, n = key[at], np.diff(np.append(at, len(key)))
    if other:
        n[np.searchsorted(key, other[0])] -= other[1]
    return key, n


def _by_bucket(key: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's part of ordered keys begins, and the end."""
    return np.append(np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(key))


def _blobs(key: np.ndarray, n: np.ndarray, cut: np.ndarray, skip: int = 0) -> list[bytes]:
    """Of ordered keys that are cut into buckets, a blob for each: the bytes of a difference and of a count, the first key's lower seven bytes (a bucket's keys have the first in
    common), the differences of the following keys, all without the last `skip` bytes, and the counts."""
    out, full = [b""] * (len(cut) - 1), np.flatnonzero(np.diff(cut))
    if not len(full):
        return out
    low = (key & np.uint64((1 << 56) - 1)) >> np.uint64(8 * skip)
    starts, step = cut[full], np.zeros(len(key), "<u8")
    step[1:] = low[1:] - low[:-1]
    step[starts] = 0
    wide = 1 + np.searchsorted(np.uint64(1) << np.arange(8, 56, 8, dtype=np.uint64), np.maximum.reduceat(step, starts), "right")
    counts = np.array([1, 2, 4, 8])[np.searchsorted([1 << 8, 1 << 16, 1 << 32], np.maximum.reduceat(n, starts), "right")]
    steps = {w: memoryview(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :w])).cast("B") for w in set(wide.tolist())}
    times = {c: memoryview(n.astype(f"<u{c}").view(np.uint8)) for c in set(counts.tolist())}
    for i, a, b, w, c, first in zip(full.tolist(), starts.tolist(), cut[full + 1].tolist(), wide.tolist(), counts.tolist(), low[starts].tolist()):
        out[i] = b"".join((bytes((w, c)), first.to_bytes(7, "little"), steps[w][w * (a + 1) : w * b], times[c][c * a : c * b]))
    return out


def _packed(key: np.ndarray, n: np.ndarray, skip: int = 0) -> bytes:
    """One bucket's blob."""
    return _blobs(key, n, np.array([0, len(key)]), skip)[0]


def _unpacked(blob: bytes, bucket: int, bits: int, counted: bool = True, skip: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """A blob's keys and, if wanted, counts."""
    if not blob:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8) if counted else None
    w, c = blob[0], blob[1]
    size = (len(blob) - 9 + w) // (w + c)
    step = np.zeros((size, 8), np.uint8)
    step[0, :7] = np.frombuffer(blob, np.uint8, 7, 2)
    step[1:, :w] = np.frombuffer(blob, np.uint8, w * (size - 1), 9).reshape(-1, w)
    key = np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) << np.uint64(8 * skip) | np.uint64(bucket >> (bits - 8) << 56)
    return key, np.frombuffer(blob, f"<u{c}", size, len(blob) - c * size) if counted else None


def _block_counts(block: list[np.ndarray], order: int, bits: int, left_out: np.ndarray | None = None, part: tuple[int, int] = (0, 1)) -> tuple[list[int], list[bytes], list[bytes]]:
    """Of a block: the buckets that it has keys of, and for each of them the words with their counts, and the longer runs. Texts that are left out give keys, but aren't counted.
    part: (i, n) for the i-th of n parts of the buckets."""
    sizes, starts = _starts(block)
    runs = run_keys(np.concatenate(block), starts, order)
    out = None if left_out is None else np.repeat(left_out, sizes)

    def counted(key, out):
        if part[1] > 1:
            own = (key >> np.uint64(56)) * np.uint64(part[1]) >> np.uint64(8) == np.uint64(part[0])
            key, out = key[own], None if out is None else out[own]
        return _counted(key, out)

    words, w = counted(runs[0], out)
    longer, n = counted(np.concatenate(runs[1:]), None if out is None else np.tile(out, order - 1)) if order > 1 else (words[:0], w[:0])
    of_words, own = _blobs(words, w, _by_bucket(words, bits)), _blobs(longer, n, _by_bucket(longer, bits), 1)
    some = [i for i in range(1 << bits) if own[i] or of_words[i]]
    return some, [of_words[i] for i in some], [own[i] for i in some]


def _count(batches, order, bits):
    """Of each block and bucket: the words with their counts, and the longer runs."""
    for batch in sliced(batches, 4096):
        for _, block in _in_blocks(batch.column(0).to_pylist(), 1 << 19):
            some, words, runs = _block_counts(block, order, bits)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(words, pa.binary()), pa.array(runs, pa.binary())], names=["bucket", "words", "runs"])


class _Sums:
    """Keys and their counts, added up; what is held is compacted whenever it has doubled."""

    def __init__(self):
        self.parts, self.size, self.compact = [], 0, 1 << 20

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        if len(key):
            self.parts.append((key, n))
            self.size += len(key)
            if self.size > 2 * self.compact:
                self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(c for _, c in self.parts)])
        if len(self.parts) > 1:
            place = np.argsort(key)
            key, n = key[place], n[place]
        if len(key):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[at], np.add.reduceat(n, at)
        self.parts, self.size = [(key, n)], len(key)
        self.compact = max(1 << 20, len(key))
        return key, n


def _two_bits() -> np.ndarray:
    """For each 12-bit number: a word with the two bits that its halves name."""
    x = np.arange(1 << 12, dtype=np.uint64)
    return np.uint64(1) << (x & np.uint64(63)) | np.uint64(1) << (x >> np.uint64(6))


_TWO_BITS = _two_bits()


def _word_and_hash(key: np.ndarray, level: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `size` words an entry's bits are in (by a multiplication instead of a remainder), and the hash whose low 24 bits name them."""
    own = _mix(key + np.uint64((level * 0xD1B54A32D192ED03) & (1 << 64) - 1))
    return ((own >> np.uint64(32)) * size) >> np.uint64(32), own


def build_segments(key: np.ndarray, n: np.ndarray, bits_per_entry: int, segment_bits: int | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Segments that these keys belong to, and their bits; all keys are entered. A segment's size in bits is a multiple of 64, or segment_bits
    (one too) if that is given: with too few bits counts come out too high, never too low."""
    segments, own = np.unique((key >> SEGMENT_SHIFT).astype(np.int64), return_inverse=True)
    level = quantised(n)
    entries = np.bincount(own, weights=level, minlength=len(segments))
    words = (np.maximum(1, np.ceil(entries * bits_per_entry / 64)) if segment_bits is None else np.full(len(segments), segment_bits // 64)).astype(np.int64)
    ends = np.cumsum(words)
    start, size = (ends - words).astype(np.uint64)[own], words.astype(np.uint64)[own]
    bits = np.zeros(64 * int(ends[-1]) if len(ends) else 0, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level >= j)
        word, hashed = _word_and_hash(key[at], j, size[at])
        base = (start[at] + word) << np.uint64(6)
        for i in (0, 6, 12, 18):
            bits[(base + (hashed >> np.uint64(i) & np.uint64(63))).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return segments, [packed[8 * (e - size) : 8 * e] for e, size in zip(ends.tolist(), words.tolist())]


def _summed_buckets(batches, bits):
    """Of rows ordered by bucket: (bucket, words and their counts, all keys and their counts, and if the rows name their blocks, for each row the block, its words and its runs)."""
    now, words, runs, asked = None, _Sums(), _Sums(), []

    def done():
        key, n = words.result()
        more, m = runs.result()
        return now, key, n, np.concatenate([key, more]), np.concatenate([n, m]), asked

    for batch in batches:
        for bucket, of_words, own, *block in zip(*(x.to_pylist() for x in batch.columns)):
            if bucket != now:
                if now is not None:
                    yield done()
                now, words, runs, asked = bucket, _Sums(), _Sums(), []
            (key, n), (more, m) = _unpacked(of_words, bucket, bits), _unpacked(own, bucket, bits, skip=1)
            words.add(key, n.astype(np.int64))
            runs.add(more, m.astype(np.int64))
            if block:
                asked.append((block[0], key, more))
    if now is not None:
        yield done()


def _trimmed(make, batches, **options):
    """What make gives; then, when nothing of it is held any more, the worker's free memory goes back to the system."""
    yield from make(batches, **options)
    give_back()


def _word_columns(bucket: int, key: np.ndarray, n: np.ndarray):
    """Bucket, key and n of the summed words, some at a time."""
    for i in range(0, len(key), 1 << 18):
        own = key[i : i + (1 << 18)]
        yield [pa.array(np.full(len(own), bucket, np.int32)), pa.array(own.view(np.int64)), pa.array(n[i : i + len(own)])]


def _build(batches, bits, bits_per_entry, segment_bits):
    """The summed counts of words (segment -1), and the segments' bits."""
    names = ["bucket", "key", "n", "segment", "bits"]
    for bucket, k, c, key, n, _ in _summed_buckets(batches, bits):
        for own in _word_columns(bucket, k, c):
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(own[0]), -1, np.int32)), pa.nulls(len(own[0]), pa.binary())], names=names)
        segments, found = build_segments(key, n, bits_per_entry, segment_bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bucket, np.int32)), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(segments.astype(np.int32)), pa.array(found, pa.binary())], names=names)


def _answer(batches, bits, bits_per_entry, segment_bits, most=1 << 18):
    """The summed counts of words (block null), and for each row that came in the quantised counts of its words and of its runs, by the bucket's segments."""
    names = ["bucket", "key", "n", "block", "words", "runs"]
    for bucket, k, c, key, n, asked in _summed_buckets(batches, bits):
        for own in _word_columns(bucket, k[c > 0], c[c > 0]):
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(own[0]), kind) for kind in (pa.int64(), pa.binary(), pa.binary()))], names=names)
        segments, found = build_segments(key[n > 0], n[n > 0], bits_per_entry, segment_bits)
        own = Filter(dict(zip(segments.tolist(), found)))
        ends = np.cumsum([len(x) + len(y) for _, x, y in asked])
        while asked:
            some = max(1, int(np.searchsorted(ends, ends[0] + most)))
            now, asked, ends = asked[:some], asked[some:], ends[some:]
            level = memoryview(own.levels(np.concatenate([x for _, *both in now for x in both])).astype(np.uint8))
            at = np.cumsum([0, *(len(x) for _, *both in now for x in both)]).tolist()
            found = [bytes(level[a:b]) for a, b in zip(at, at[1:])]
            m, whole = len(now), pa.nulls(len(now), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, bucket, np.int32)), whole, whole, pa.array([x[0] for x in now], pa.int64()), pa.array(found[::2], pa.binary()), pa.array(found[1::2], pa.binary())], names=names)


def _probed(words: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Quantised counts (0: none) by repeated probes, of keys whose segments begin at these words and have so many."""
    level, at, j = np.zeros(len(key), np.int64), np.flatnonzero(size), 0
    key, start, size = key[at], start[at], size[at]
    low = np.uint64(4095)
    while len(at) and j < len(EDGES):
        j += 1
        word, hashed = _word_and_hash(key, j, size)
        wanted = _TWO_BITS[hashed & low] | _TWO_BITS[hashed >> np.uint64(12) & low]
        hit = words[start + word] & wanted == wanted
        at, key, start, size = at[hit], key[hit], start[hit], size[hit]
        level[at] = j
    return level


class Filter:
    """A filter, or some segments of one, in one piece."""

    def __init__(self, segments: dict[int, bytes]):
        self.starts, self.sizes = np.zeros(SEGMENTS, np.uint64), np.zeros(SEGMENTS, np.uint64)
        at = 0
        for i, own in segments.items():
            self.starts[i], self.sizes[i] = at, len(own) // 8
            at += len(own) // 8
        self.words = np.frombuffer(b"".join(segments.values()), "<u8")

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Quantised counts (0: none) by repeated probes."""
        segment = (key >> SEGMENT_SHIFT).astype(np.int64)
        return _probed(self.words, key, self.starts[segment], self.sizes[segment])


#: What the file of broadcast bytes begins with (then four bytes of their number), if they are fewer than 2 ** 32.
_PICKLED = b"\x80\x05B"


@contextlib.contextmanager
def _mapped(part):
    """The words of a broadcast shard, which are behind one byte. On a worker its file is mapped, so that nothing is copied or kept."""
    path = getattr(part, "_path", None)
    if path and os.path.getsize(path) > 8:
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as file:
            n = int.from_bytes(file[3:7], "little") - 1
            if file[:3] == _PICKLED and len(file) >= 8 + n:
                words = np.frombuffer(file, "<u8", n // 8, 8)
                yield words
                del words
                return
    yield np.frombuffer(part.value, "<u8", offset=1)


class ShardedFilter:
    """A filter whose shards are broadcast each by itself; without them (`parts`) it is small."""

    def __init__(self, segments, broadcast, shard_bytes: int):
        """segments: pairs of a segment and its bits, in any order; only those of one shard are kept at a time."""
        self.shard = np.full(SEGMENTS, -1, np.int32)
        self.starts, self.sizes = np.zeros(SEGMENTS, np.uint64), np.zeros(SEGMENTS, np.uint64)
        self.parts, own = [], bytearray(1)
        for segment, bits in segments:
            if len(own) > 1 and len(own) - 1 + len(bits) > shard_bytes:
                self.parts.append(broadcast(bytes(own)))
                own = bytearray(1)
            self.shard[segment], self.starts[segment], self.sizes[segment] = len(self.parts), len(own) // 8, len(bits) // 8
            own += bits
        if len(own) > 1:
            self.parts.append(broadcast(bytes(own)))

    def __getstate__(self):
        return self.__dict__ | {"parts": None}

    def levels(self, key: np.ndarray, parts: list | None = None) -> np.ndarray:
        """Quantised counts (0: none), shard by shard."""
        parts = self.parts if parts is None else parts
        segment, level = (key >> SEGMENT_SHIFT).astype(np.int64), np.zeros(len(key), np.int64)
        shard = self.shard[segment]
        for k, part in enumerate(parts):
            at = np.flatnonzero(shard == k)
            if len(at):
                with _mapped(part) as words:
                    level[at] = _probed(words, key[at], self.starts[segment[at]], self.sizes[segment[at]])
                    del words
        return level


def low_edge(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, EDGES[np.maximum(level, 1) - 1], 0.0)


def high_edge(level: np.ndarray) -> np.ndarray:
    return EDGES[level] - 1


_SCORED = "uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, key long"


def probes(block: list[np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block's different words in order, then its longer runs in order, and for each length the places of its tokens' runs among them."""
    runs = run_keys(np.concatenate(block), _starts(block)[1], order)
    key, place = np.unique(runs[0], return_inverse=True)
    if order == 1:
        return key, [place]
    more, places = np.unique(np.concatenate(runs[1:]), return_inverse=True)
    return np.concatenate([key, more]), [place, *np.split(places + len(key), order - 1)]


def block_scores(block: list[np.ndarray], places: list[np.ndarray], level: np.ndarray, below: float, priors: tuple[float, ...]) -> np.ndarray:
    """log10 probabilities of a block's texts, given the quantised counts of its keys."""
    sizes, starts = _starts(block)
    low, high = low_edge(level), high_edge(level)
    probability = (low[places[0]] + 0.1) / below if below else np.ones(len(places[0]))
    texts = high[places[0][sizes[0] - 1]]  # a text's last token is the end: so many texts there are, so often the start
    together_most = high[places[0]]
    for n, prior in enumerate(priors, 1):
        history = np.empty(len(probability))
        history[1:] = high[places[n - 1]][:-1]
        history[starts] = texts
        # A run can't be more frequent than one in it: that corrects some wrong hits.
        together_most = np.minimum(high[places[n]], np.minimum(together_most, history))
        probability = (np.minimum(low[places[n]], together_most) + prior * probability) / (history + prior)
    return np.add.reduceat(np.log10(probability), starts)


def _scored_rows(block, key, place, ids, held_out, uid, score, table, below):
    """One row per text, with the base score of the words in the broadcast table, and one per occurrence of another word. The tokens are at `place` of the block's different keys."""
    words, counts = table
    sizes, starts = _starts(block)
    own, c = key[place], np.zeros(len(key), np.int64)
    text = np.repeat(np.arange(len(block)), sizes)
    if len(words):  # keys in order are found several times faster than tokens
        at = np.minimum(np.searchsorted(words, key), len(words) - 1)
        c = np.where(words[at] == key, counts[at], 0)
    c = c[place]
    known = c > 0
    logs = np.where(known, np.log10((c + 0.1) / below) if below else 0.0, 0.0)
    rare, m = np.flatnonzero(~known), len(block)
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "key"]
    yield pa.RecordBatch.from_arrays([pa.array(uid), ids, held_out, pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(logs, starts)), pa.array(score), pa.nulls(m, pa.int64())], names=names)
    if len(rare):
        k, whole, real = len(rare), pa.nulls(len(rare), pa.int64()), pa.nulls(len(rare), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(uid[text[rare]]), pa.nulls(k, ids.type), pa.nulls(k, pa.bool_()), whole, whole, real, real, pa.array(own[rare].view(np.int64))], names=names)


def _partition() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def _score(batches, model, parts, priors):
    """Scores by the broadcast filter."""
    filter_, *table, below = model.value
    row = _partition() << 33
    for batch in sliced(batches, 4096):
        for first, block in _in_blocks(batch.column(2).to_pylist(), 1 << 18):
            key, places = probes(block, len(priors) + 1)
            # All different keys of the block at once, as each call reads all shards.
            score = block_scores(block, places, filter_.levels(key, parts), below, priors)
            m = len(block)
            yield from _scored_rows(block, key, places[0], batch.column(0).slice(first, m), batch.column(1).slice(first, m), row + np.arange(m), score, table, below)
            row += m


def _blocks(batches, most=3 << 20):
    """Texts of about `most` bytes together: a number, and the texts with their other columns, as a stream."""
    at, options = _partition() << 24, pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in sliced(batches, 4096):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch.slice(first, last - first))
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])
            at, first = at + 1, last


def _opened(texts: bytes) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    batch = pa.ipc.open_stream(texts).read_next_batch()
    return batch, [tokens(x) for x in batch.column(2).to_pylist()]


def _count_all(batches, order, bits, part):
    """Of each block and bucket of a part: the words with their counts in training, and the longer runs."""
    for batch in sliced(batches, 1):
        rows, block = _opened(batch.column(1)[0].as_py())
        some, words, runs = _block_counts(block, order, bits, rows.column(1).to_numpy(zero_copy_only=False).astype(bool), part)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(words, pa.binary()), pa.array(runs, pa.binary()), pa.array(np.full(len(some), batch.column(0)[0].as_py()), pa.int64())], names=["bucket", "words", "runs", "block"])


def _score_answered(batches, model, priors):
    """Scores from rows ordered by block and bucket: the block's texts come first, then its keys' quantised counts."""
    *table, below = model.value
    now, texts, of_words, of_runs = None, None, [], []

    def done():
        batch, block = _opened(texts)
        key, places = probes(block, len(priors) + 1)
        level = np.frombuffer(b"".join(of_words + of_runs), np.uint8).astype(np.int64)
        if len(level) != len(key):
            raise RuntimeError(f"{len(level)} answers for {len(key)} keys")
        score = block_scores(block, places, level, below, priors)
        yield from _scored_rows(block, key, places[0], batch.column(0), batch.column(1), (now << 12) + np.arange(len(block)), score, table, below)

    for batch in batches:
        for block, words, runs in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if block != now:
                if now is not None:
                    yield from done()
                now, texts, of_words, of_runs = block, words, [], []
            else:
                of_words.append(words)
                of_runs.append(runs)
    if now is not None:
        yield from done()


def _answered(blocks: DataFrame, bits: int, order: int, bits_per_entry: int, segment_bits: int | None, rounds: int) -> DataFrame:
    """Rows of words (block null: key, n) and of quantised counts by block and bucket (words, runs). One part of the buckets after the other, as the disk must hold a round's keys."""
    n, parts = _partitions(blocks.sparkSession, bits), []
    for i in range(rounds):
        counted = blocks.mapInArrow(functools.partial(_trimmed, _count_all, order=order, bits=bits, part=(i, rounds)), "bucket int, words binary, runs binary, block long")
        ordered = _by_task(counted, n).sortWithinPartitions("bucket")
        parts.append(written(ordered.mapInArrow(functools.partial(_trimmed, _answer, bits=bits, bits_per_entry=bits_per_entry, segment_bits=segment_bits), "bucket int, key long, n long, block long, words binary, runs binary"), lean=True))
    return functools.reduce(DataFrame.unionByName, parts)


def _scores_by_block(blocks: DataFrame, answers: DataFrame, bits: int, model, priors: tuple[float, ...], kind: str) -> DataFrame:
    """Texts and the quantised counts of their keys meet by block."""
    texts = blocks.select("block", F.lit(-1).alias("bucket"), F.col("texts").alias("words"), F.lit(None).cast("binary").alias("runs"))
    together = texts.unionByName(answers).repartition(_partitions(blocks.sparkSession, bits), "block").sortWithinPartitions("block", "bucket")
    return together.mapInArrow(functools.partial(_trimmed, _score_answered, model=model, priors=priors), _SCORED.format(kind=kind))


def least_frequent(words: DataFrame, most: int) -> int:
    """A count that at most `most` words reach, from the number of words per eighth of a power of two."""
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = sorted(((r.step, r.words) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for at, n in steps:
        total += n
        if total > most:
            break
        least = int(np.ceil(2 ** (at / 8) - 1e-9))
    return least


def _text_bytes(texts: DataFrame) -> int:
    return int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def _bucket_bits(size: int, bucket_bytes: int) -> int:
    """Buckets are a power of two, 256 at least, one for every bucket_bytes of the texts."""
    return max(8, (size // bucket_bytes).bit_length())


def _partitions(spark: SparkSession, bits: int) -> int:
    """Tasks for a shuffle by bucket or block: as buckets grow in number, not in size, so do they."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << bits >> 2, 100_000))


def _by_task(frame: DataFrame, n: int) -> DataFrame:
    """Buckets dealt to n tasks in turn: they are of equal size, which a hash of their numbers would not share out evenly."""
    return frame.repartitionById(n, F.pmod("bucket", F.lit(n)))


def _built(texts: DataFrame, bits: int, order: int, bits_per_entry: int, segment_bits: int | None) -> DataFrame:
    """Rows of words (segment -1: key, n) and of segments (segment, bits), with their bucket."""
    counted = texts.select("text").mapInArrow(functools.partial(_trimmed, _count, order=order, bits=bits), "bucket int, words binary, runs binary")
    ordered = _by_task(counted, _partitions(texts.sparkSession, bits)).sortWithinPartitions("bucket")
    return written(ordered.mapInArrow(functools.partial(_trimmed, _build, bits=bits, bits_per_entry=bits_per_entry, segment_bits=segment_bits), "bucket int, key long, n long, segment int, bits binary"), lean=True)


def _broadcast_filter(built: DataFrame, shard_bytes: int) -> ShardedFilter:
    segments = ((r.segment, r.bits) for r in built.filter("segment >= 0").select("segment", "bits").toLocalIterator())
    return ShardedFilter(segments, built.sparkSession.sparkContext.broadcast, shard_bytes)


def _frequent_words(words: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    top = words.filter(F.col("n") >= least_frequent(words, frequent)).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    place = np.argsort(keys)
    return keys[place], top["n"].to_numpy()[place]


def train(texts: DataFrame, bits_per_entry: int, segment_bits: int | None, frequent: int, shard_bytes: int = 1 << 26, order: int = ORDER, bucket_bytes: int = 1 << 22) -> tuple[ShardedFilter, DataFrame, np.ndarray, np.ndarray, int, int]:
    """The filter, the table (key, n) of words, the most frequent words and their counts, N and V."""
    built = _built(texts, _bucket_bits(_text_bytes(texts), bucket_bytes), order, bits_per_entry, segment_bits)
    words = built.filter("segment < 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return _broadcast_filter(built, shard_bytes), words, *_frequent_words(words, frequent), int(total), int(distinct)


def lm_scores(documents: DataFrame, held_out: int = 10, priors: tuple[float, ...] = PRIORS, frequent: int = 1 << 19, bits_per_entry: int = 8, segment_bits: int | None = None, shard_bytes: int = 1 << 26, broadcast_bytes: int = 1 << 30, bucket_bytes: int = 1 << 22, rounds: int = 2) -> DataFrame:
    """One row per row of documents: doc_id, held_out (the id's crc32 modulo held_out is 0), n_tokens, n_known, train_tokens, base_score, score."""
    out = F.coalesce(id_remainder("doc_id", held_out) == 0, F.lit(False))
    texts, context = documents.filter(~out), documents.sparkSession.sparkContext
    size, order = _text_bytes(documents), len(priors) + 1
    bits = _bucket_bits(size, bucket_bytes)
    rows = documents.select("doc_id", out.alias("held_out"), "text")
    built = blocks = None
    if size <= TEXT_PER_FILTER * broadcast_bytes:
        built = _built(texts, bits, order, bits_per_entry, segment_bits)
        if (built.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) > broadcast_bytes:
            release(built)
            built = None
    if built is None:
        blocks = written(rows.mapInArrow(_blocks, "block long, texts binary"))
        built = _answered(blocks, bits, order, bits_per_entry, segment_bits, rounds)
    words = built.filter("key is not null").select("key", "n")
    total, distinct = map(int, words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    below = total + 0.1 * (distinct + 1) if total else 0.0
    table = _frequent_words(words, frequent)
    kind = documents.schema["doc_id"].dataType.simpleString()
    if blocks is None:
        filter_ = _broadcast_filter(built, shard_bytes)
        model = context.broadcast((filter_, *table, below))
        scored = written(rows.mapInArrow(functools.partial(_score, model=model, parts=filter_.parts, priors=priors), _SCORED.format(kind=kind)), lean=True)
    else:
        answers = built.filter("block is not null").select("block", "bucket", "words", "runs")
        scored = written(_scores_by_block(blocks, answers, bits, context.broadcast((*table, below)), priors, kind), lean=True)
        release(blocks)
    # A rare word: how often a text has it, then its count in training (none: 0).
    rare = scored.filter("key is not null").groupBy("uid", "key").agg(F.count("*").alias("times")).join(words, "key", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("uid").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(below))).alias("more_base"))
    whole = scored.filter("key is null").drop("key").join(rare, "uid", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
