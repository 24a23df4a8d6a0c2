"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64-bit SimHash over 3-word shingles, each bit by majority of the shingles' XXH64 hashes.

Candidates. The binary Golay code (23, 12) is perfect: each 23-bit value has exactly one codeword within 3 bits. The keys of
a value are the codewords that it and its 23 neighbours at distance 1 decode to (one key or six). Two values at distance
2 or less have a value within distance 1 of both, so they share a key. The 64 bits are cut into segments A (23 bits), B (23) and
C (18), with a, b and c differing bits, a + b + c <= 3. Every such pair agrees in at least one of these keys:

* c = 0, a <= 2: C exactly, a Golay key of A;         * c = 0, a = 3: B and C exactly;
* c > 0, a = 0, so b <= 2: A exactly, a key of B;     * c > 0, b = 0, so a <= 2: B exactly, a key of A;
* a = b = c = 1: a key of A, and exactly one half of B and one half of C (four choices).

That is about 38 keys of at least 30 bits for each different fingerprint (documents with equal fingerprints are one). Keys that more than `crowd`
fingerprints have are cut further: of six blocks of the 64 bits at least three agree, so each of the 20 choices of three blocks makes a finer key, with
32 more bits.

Links. Fingerprints that share a key are compared exactly. In one key's group the links form a graph of which only a spanning forest
is returned: a breadth-first search that compares one fingerprint with those not reached yet, all at once. A group of k
near copies so gives k - 1 rows, not k * k / 2, and memory is 16 bytes a fingerprint. No link is lost, as classes are all that is asked.

Null text has no words: fingerprint zero, linked like any other. Repeated rows and ties give equal fingerprints, so one
class, whose rows are spread over many tasks where a class or a fingerprint has very many. A very long text is hashed by itself, 16 bytes a word. A null id is kept with its
fingerprint and class, and isn't the smallest id. An empty table gives an empty result. Other columns are ignored, whatever their names; one_of_each() keeps them.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, classes, free_name, sliced, spread_join, written

#: The Golay code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@functools.lru_cache(1)
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders modulo the generator of the low 12 and the high 11 bits, and for each remainder its error pattern of weight <= 3."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = (1 << i) | (1 << j) | (1 << k)
                errors[remainder(e)] = e
    return low, high, errors


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each 23-bit value."""
    low, high, errors = _syndromes()
    return (x ^ errors[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codeword indices of each value and its neighbours at distance 1."""
    keys = np.sort(np.stack([decode(x), *(decode(x ^ (1 << i)) for i in range(23))], axis=1), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, at = np.nonzero(new)
    return row, keys[row, at]


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fingerprints (uint64); a key's top three bits say which kind it is."""
    f = fingerprints.astype(np.uint64)
    a, b, c = ((f >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    (row_a, key_a), (row_b, key_b), every = golay_keys(a), golay_keys(b), np.arange(len(f))
    parts = [(every, b << 18 | c), (row_a, key_a << 18 | c[row_a]), (row_b, key_b << 23 | a[row_b]), (row_a, key_a << 23 | b[row_a])]
    for half_b, bits_b in ((b & 0xFFF, 12), (b >> 12, 11)):
        for half_c in (c & 0x1FF, c >> 9):
            parts.append((row_a, (key_a << bits_b | half_b[row_a]) << 9 | half_c[row_a]))
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] | i << 58 for i, x in enumerate(parts)])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text; as an unsigned number."""
    import xxhash

    own = (text or "").encode().lower().split()
    if not own:
        return 0
    whole = b" ".join(own)
    n = max(1, len(own) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in own])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(own)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[s:e], 42) for s, e in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches, words):
    for batch in sliced(batches):
        own = np.fromiter((fingerprint(x, words) for x in batch.column(batch.num_columns - 1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(documents: DataFrame, words: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` and fp (the 64 bits as a signed long) of each row."""
    kept = documents.select(*carry, F.col("text").alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return kept.mapInArrow(functools.partial(_fingerprints, words=words), schema)


def _keys(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for i in range(0, len(fp), 4096):
            row, key = fuzzy_keys(fp[i : i + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 4096][row])], names=["key", "fp"])


#: The bits of six blocks (first, number), and the choices of three of them.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHOICES = tuple(itertools.combinations(BLOCKS, 3))


def finer_keys(key: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of rows (key, fingerprint): 20 each, hashes of the key, the choice and the chosen bits."""
    out = []
    for i, choice in enumerate(CHOICES):
        mask = np.uint64(sum(((1 << n) - 1) << s for s, n in choice))
        x = (key ^ (fingerprints & mask) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(i)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(31)))
    return np.tile(np.arange(len(key)), len(CHOICES)), np.concatenate(out)


def _finer(batches):
    for batch in batches:
        key, fp = (batch.column(i).to_numpy() for i in (0, 1))
        for i in range(0, len(fp), 4096):
            row, own = finer_keys(key[i : i + 4096].view(np.uint64), fp[i : i + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(fp[i : i + 4096][row])], names=["key", "fp"])


def forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links different fingerprints at `most` or fewer differing bits."""
    edges, left = [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= most
            found = left[near]
            edges += [(x, y) for y in found]
            queue += list(found)
            left = left[~near]
    return edges


def _links(batches, most):
    """Of rows sorted by key: forests of each key's group. The last group of a batch waits for the next batch."""
    rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def found(key, fp):
        ends = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(key)]])
        pairs = [(fp[s], fp[s + 1]) for s in starts[ends - starts == 2]]
        a, b = (np.array([x[i] for x in pairs], dtype=np.uint64) for i in (0, 1))
        near = np.bitwise_count(a ^ b) <= most
        out = [(a[near], b[near])]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            if own := forest(np.unique(fp[s:e]), most):
                out.append(tuple(np.array(x, dtype=np.uint64) for x in zip(*own)))
        a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])

    for batch in batches:
        key, fp = (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in ((0, rest_key), (1, rest_fp)))
        if not len(key):
            continue
        cut = np.searchsorted(key, key[-1])
        rest_key, rest_fp = key[cut:], fp[cut:]
        if cut:
            yield found(key[:cut], fp[:cut].view(np.uint64))
    if len(rest_key):
        yield found(rest_key, rest_fp.view(np.uint64))


def near_links(distinct: DataFrame, most: int = 3, crowd: int = 1 << 14) -> DataFrame:
    """distinct: different fingerprints, column fp. Rows (x, y): a set of links that connects what all links connect."""
    if most > 3:
        raise ValueError("the keys find fingerprints at 3 or fewer differing bits")
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    crowded = checkpoint(keys.groupBy("key").count().filter(F.col("count") > crowd).select("key"))
    if n := crowded.count():
        crowded = F.broadcast(crowded) if n <= 1 << 20 else crowded
        finer = keys.join(crowded, "key", "left_semi").mapInArrow(_finer, "key long, fp long")
        keys = keys.join(crowded, "key", "left_anti").unionByName(finer)
    grouped = keys.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(functools.partial(_links, most=most), "x long, y long").distinct()


def fingerprint_classes(distinct: DataFrame, most: int = 3, crowd: int = 1 << 14) -> DataFrame:
    """distinct: different fingerprints, column fp. Adds root, the same for all of a class."""
    root = classes(near_links(distinct, most, crowd).select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "fp")
    return distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_classes(documents: DataFrame, words: int = 3, most: int = 3, crowd: int = 1 << 14) -> DataFrame:
    """One row per row of documents: doc_id, fingerprint (16 hex digits), component_id (the smallest id of its class)."""
    rows = written(fingerprints(documents, words))
    first = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    named = checkpoint(fingerprint_classes(first, most, crowd))
    lowest = checkpoint(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"), F.sum("rows").alias("rows")))
    total = lowest.agg(F.sum("_n"), F.sum("rows")).first()
    of = spread_join(named, lowest.drop("rows"), ["root"], total[0] or 0).select("fp", "component_id", F.col("rows").alias("_n"))
    return spread_join(rows, of, ["fp"], total[1] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, words: int = 5, most: int = 3) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest id stays (null last, then by the text's hash; of repeated
    rows one). Null and empty texts are one class. An empty table gives an empty one. Extra columns are kept, whatever their names."""
    id_, content, order = (free_name(x, documents) for x in ("gs_id", "gs_content", "gs_order"))
    hashed = F.xxhash64("text")
    rows = fingerprints(documents.withColumn(order, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", hashed.alias("content"))), words, (order,))
    first = checkpoint(rows.groupBy("fp").agg(F.min(order).alias("first")))
    kept = checkpoint(fingerprint_classes(first, most).groupBy("root").agg(F.min("first").alias("kept")).select(F.col("kept.doc_id").alias(id_), F.col("kept.content").alias(content)))

    def like(other: DataFrame, how: str, own: DataFrame = documents) -> DataFrame:
        return own.join(other, own["doc_id"].eqNullSafe(other[id_]) & (F.xxhash64(own["text"]) == other[content]), how)

    counts = documents.select(F.col("doc_id").alias(id_), hashed.alias(content)).groupBy(id_, content).count()
    repeated = checkpoint(counts.filter("count > 1").select(id_, content))
    if not repeated.limit(1).count():
        return like(kept, "left_semi")
    once, again = like(repeated, "left_anti"), like(repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return like(kept, "left_semi", once).unionByName(like(kept, "left_semi", again))
