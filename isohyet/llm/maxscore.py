"""Exact top-k by inner product of integer vectors, by MaxScore.

Vectors are read in blocks by all tasks, and a block is indexed by posting lists of signed dimensions: list (d, +) has the vectors with v_d > 0 and their
components, (d, -) those with v_d < 0. A query's component q_d is a term: vectors in the list of its sign gain by it, at most
bound_d = |q_d| * (largest |v_d| of that list), vectors in the other list lose, all others get nothing. With the terms in ascending order of bounds, those whose bounds sum to
less than the threshold (the k-th best score so far) are non-essential: they can't bring a vector in by themselves. Essential terms'
lists are traversed, which gives each vector's exact score in these terms; vectors whose partial
score plus the rest's bounds reaches the threshold are then probed in the non-essential terms, strongest first, and dropped as soon as they fall short. Equal
scores go to smaller ids, so only scores strictly below the threshold are dropped.

Each task keeps k results a query from block to block, and a window merges the tasks' results. Queries are broadcast in chunks of about `chunk` (chosen by a hash of the
id); with more than one chunk each is a scan of its own whose results are written before its broadcast is released and the next begins, so that neither memory nor the plan grows with their number.

Components: floor(256 * x). Scores are computed in 64-bit integers where the largest component and the longest vector show that no score leaves them,
else in integers of any size; the order is then exact too, but a score outside the range of a long is given as the range's end. Vectors that are null or
hold a null or non-finite component take no part; different lengths are
padded with zeros. A query's own id is no candidate. Of rows that share an id every one is a candidate, and the smallest vector is the query. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written_parts

LONG = 1 << 63


def _whole(x: float, scale: float) -> int:
    """floor(scale * x), also where the product isn't finite as a double."""
    return math.floor(scale * x) if math.isfinite(scale * x) else math.floor(x) * int(scale)


def _matrix(column: pa.Array, scale: float, width: int | None = None, big: bool = False) -> np.ndarray:
    """Rows of components; lists of unequal length are padded with zeros or cut to width. big: as Python's integers."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if big:
        flat, real = np.empty(len(flat), object), flat
        flat[:] = [_whole(x, scale) for x in real.tolist()]
    else:
        flat = np.floor(scale * flat).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


class _Best:
    """The k best (score, id) of one query."""

    def __init__(self, k: int, kind):
        self.k, self.scores, self.ids = k, np.zeros(0, kind), np.zeros(0, np.int64)

    @property
    def threshold(self):
        """None as long as there are fewer than k."""
        return self.scores[-1] if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if (least := self.threshold) is not None:
            some = scores >= least
            scores, ids = scores[some], ids[some]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], dtype=np.int64)
        self.scores, self.ids = scores[order], ids[order]


class Postings:
    """A block's vectors by signed dimension: lists[d] has the places and components of v_d > 0, then those of v_d < 0."""

    def __init__(self, values: np.ndarray, ids: np.ndarray):
        self.ids, self.by_term = ids, np.ascontiguousarray(values.T)
        self.lists = []
        for own in self.by_term:
            above, below = np.flatnonzero(own > 0), np.flatnonzero(own < 0)
            self.lists.append(((above, own[above]), (below, own[below])))
        ends = [(a[1].max(initial=0), b[1].min(initial=0)) for a, b in self.lists]
        self.highest, self.lowest = (np.array([x[i] for x in ends], self.by_term.dtype) for i in (0, 1))


def search_block(best: _Best, query: np.ndarray, own: int, block: Postings) -> None:
    """Adds a block's vectors to the best of one query."""
    bounds = np.where(query > 0, query * block.highest, query * block.lowest)
    order = np.argsort(bounds, kind="stable")
    sums, least = np.cumsum(bounds[order]), best.threshold
    # So many weakest terms can't reach the threshold by themselves.
    n = 0 if least is None else int(np.searchsorted(sums, least, "left"))
    if n == len(order) and n:
        return
    score = np.zeros(len(block.ids), query.dtype)
    for term in order[n:]:
        if q := query[term]:
            for at, values in block.lists[term]:
                score[at] += q * values
    at = np.flatnonzero(block.ids != own)
    score, probed = score[at], order[:n][::-1]
    rest = sums[n - 1] if n else 0
    for i in range(0, len(probed), 8):
        competitive = score + rest >= least
        score, at, terms = score[competitive], at[competitive], probed[i : i + 8]
        if not len(at):
            return
        score = score + query[terms] @ block.by_term[np.ix_(terms, at)]
        rest = rest - bounds[terms].sum()
    best.add(score, block.ids[at])


def _key(score: int, bits: int) -> str:
    """Text of fixed length that sorts as scores below 2 ** bits do."""
    return f"{score + (1 << bits):0{bits // 4 + 2}x}"


def _search(batches, queries, scale, k, rows, bits):
    query_ids, vectors = queries.value
    width, big = vectors.shape[1], bits >= 62
    found = [_Best(k, vectors.dtype) for _ in query_ids]
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            block = Postings(_matrix(part.column(1), scale, width, big), part.column(0).to_numpy())
            for own, query, best in zip(query_ids, vectors, found):
                search_block(best, query, own, block)
    n = [len(x.ids) for x in found]
    scores = [int(x) for own in found for x in own.scores]
    keys = pa.array([_key(x, bits) for x in scores] if big else [None] * len(scores), pa.string())
    columns = [pa.array(np.repeat(query_ids, n), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.ids for x in found)])), pa.array([min(max(x, -LONG), LONG - 1) for x in scores], pa.int64()), keys]
    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "key"])


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, chunk: int = 4096, rows: int = 4096) -> DataFrame:
    """The k best of each query (vec_id divisible by `every`): query_id, rank (from 1), vec_id, score."""
    spark, vectors = embeddings.sparkSession, usable(embeddings)
    is_query = F.col("vec_id") % every == 0
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x))))
    facts = vectors.agg(F.count_if(is_query).alias("n"), largest.alias("most"), F.max(F.size("embedding")).alias("width")).first()
    # No score has more bits than this.
    bits = (_whole(facts.most or 0.0, scale) + 1).bit_length() * 2 + (facts.width or 0).bit_length()
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    schema, chunks = "query_id long, vec_id long, score long, key string", -(-facts.n // chunk)

    def results(i: int) -> tuple[DataFrame, object]:
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i).orderBy("vec_id").toArrow()
        held = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), _matrix(part["embedding"].combine_chunks(), scale, None, bits >= 62)))
        return vectors.mapInArrow(functools.partial(_search, queries=held, scale=scale, k=k, rows=rows, bits=bits), schema), held

    if chunks <= 1:
        found = results(0)[0] if chunks else spark.createDataFrame([], schema)
    else:
        found = written_parts(spark, (results(i) for i in range(chunks)))
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
