"""Line dedup by content-defined chunks of lines.

A text's lines (split at \\n; one without a word belongs to the chunk around it) are hashed; a rolling hash over the last
`window` line hashes ends a chunk where it is 0 modulo `divisor` and the chunk has `shortest` lines, or after `longest` lines; what is shorter at the text's end joins the chunk before. Boundaries so
depend on nearby lines only: lines inserted before a shared passage move its chunks but, after the first one or two, don't change them.

Chunks of at least `least_lines` lines with words that occur more than once in the corpus are removed but for the first
occurrence (smallest doc_id, then place; null ids last). Equal hashes only propose: the texts of proposed chunks are compared
byte by byte (smallest = largest text of a hash, aggregated on the map side), and a hash whose texts differ is resolved by grouping
on the texts themselves.

With `run_words`, every run of lines of more than so many words that an earlier document has too goes as well, wherever chunks end.
Such a run is the union of its shortest runs of more than `run_words` words from each line on and up to each line, and these follow from
the lines alone: they are hashed, proposed and compared as the chunks are. All of a run's occurrences in its first document stay. Lines without a word are
ignored in comparing, and go with the line before them.

Texts are shuffled twice, by id: once for the comparison and once for the removal. These joins are sort-merge joins at every size,
as neither side is bounded. The occurrences of a chunk or run that very many documents have are spread over many tasks (common.spread_join).

Null text stays null, empty text empty. A document that loses all its chunks keeps its row with an empty text. Rows that
share an id are told apart by their texts; rows equal in both are one document, so all of them keep a first occurrence. An empty
table gives an empty result. A very long text is cut by itself, in memory of some 200 bytes a line. Other columns are kept, but for `n_lines_removed` and `n_chunks_removed`, which are the
operator's (deduplicated_lines() keeps those too); a column whose name begins with `_lc_` is an error.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free_name, release, sliced, spread_join, written

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def chunk_bounds(hashes: np.ndarray, window: int, divisor: int, shortest: int, longest: int) -> list[int]:
    """Ends (exclusive) of the chunks of lines with these hashes."""
    if not len(hashes):
        return []
    rolling = np.zeros(len(hashes), np.uint64)
    for back in range(window):  # a polynomial over the last lines; fewer at the start
        rolling[back:] += hashes[: len(hashes) - back] * np.uint64(pow(int(MULTIPLIER), back, 1 << 64))
    cut = _mixed(rolling) % np.uint64(divisor) == 0
    ends, start = [], 0
    for end in [*(np.flatnonzero(cut) + 1).tolist(), len(hashes)]:
        if end - start < shortest and end < len(hashes):
            continue
        ends += range(start + longest, end, longest)
        if end > start:
            ends.append(end)
        start = end
    if len(ends) > 1 and ends[-1] - ends[-2] < shortest:  # what is too short at the end belongs to the chunk before
        del ends[-2]
    return ends


def chunks_of(text: str, window: int = 2, divisor: int = 2, shortest: int = 2, longest: int = 64) -> list[tuple[str, int]]:
    """The chunks of a text and their numbers of lines with words; joined by \\n they give the text."""
    import xxhash

    lines = text.split("\n")
    encoded = [x.encode("utf-8", "surrogatepass") for x in lines]
    worded = np.array([bool(x.split()) for x in encoded])
    own = np.flatnonzero(worded)
    ends = chunk_bounds(np.fromiter((xxhash.xxh64_intdigest(encoded[i]) for i in own), np.uint64, len(own)), window, divisor, shortest, longest)
    starts = [0, *(int(own[e]) for e in ends[:-1])]
    stops = [*starts[1:], len(lines)]
    return [("\n".join(lines[s:e]), int(worded[s:e].sum())) for s, e in zip(starts, stops)]


def _units(text: str) -> list[str]:
    """A text's lines with words, each with the lines without one that follow it (the first: also those before); joined by \\n they give the text."""
    lines = text.split("\n")
    own = [i for i, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").split()]
    starts = [0, *own[1:]]
    return ["\n".join(lines[s:e]) for s, e in zip(starts, [*starts[1:], len(lines)])]


def runs_of(text: str, run_words: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines with words, and the shortest runs (start, end) of them that have more than run_words words, from each line on and up to each."""
    lines = [x for x in (y.encode("utf-8", "surrogatepass") for y in text.split("\n")) if x.split()]
    total = np.cumsum([0, *(len(x.split()) for x in lines)])
    if total[-1] <= run_words:
        return lines, []
    ends = np.searchsorted(total, total[:-1] + run_words, "right")
    starts = np.searchsorted(total, total[1:] - run_words, "left") - 1
    return lines, sorted({(i, e) for i, e in enumerate(ends.tolist()) if e <= len(lines)} | {(s, j + 1) for j, s in enumerate(starts.tolist()) if s >= 0})


def _run_rows(text: str, run_words: int, keep: set | None, body: bool):
    """(place, hash, text) of the runs; places are -1, -2, ..."""
    import xxhash

    lines, runs = runs_of(text, run_words)
    digests = [xxhash.xxh3_128_digest(x) for x in lines] if runs else []
    for k, (s, e) in enumerate(runs):
        if keep is None or -1 - k in keep:
            yield -1 - k, xxhash.xxh3_128_intdigest(b"run" + b"".join(digests[s:e])), b"\n".join(lines[s:e]).decode("utf-8", "surrogatepass") if body else None


def _rows(batches, options, least_lines, only):
    """(id, content, place, hash[, text]) of the chunks with enough lines and of the runs; with `only`, of those places that the row's list names."""
    import xxhash

    options = dict(options)
    run_words = options.pop("run_words", None)
    for batch in sliced(batches):
        texts = batch.column(2).to_pylist()
        wanted = batch.column(3).to_pylist() if only else [None] * len(texts)
        row, place, high, low, body = [], [], [], [], []
        for i, (text, own) in enumerate(zip(texts, wanted)):
            keep = None if own is None else set(own)
            for k, (chunk, n) in enumerate(chunks_of(text, **options) if text else ()):
                if n >= least_lines and (keep is None or k in keep):
                    h = xxhash.xxh3_128_intdigest(chunk.encode("utf-8", "surrogatepass"))
                    row.append(i)
                    place.append(k)
                    high.append(h >> 64)
                    low.append(h & (1 << 64) - 1)
                    if only:
                        body.append(chunk)
            for k, h, run in _run_rows(text, run_words, keep, only) if text and run_words is not None else ():
                row.append(i)
                place.append(k)
                high.append(h >> 64)
                low.append(h & (1 << 64) - 1)
                if only:
                    body.append(run)
        at = pa.array(row, pa.int64())
        out = {"doc_id": batch.column(0).take(at), "content": batch.column(1).take(at), "place": pa.array(place, pa.int32()), "high": pa.array(np.array(high, np.uint64).view(np.int64)), "low": pa.array(np.array(low, np.uint64).view(np.int64))}
        if only:
            out["chunk"] = pa.array(body, pa.string())
        yield pa.RecordBatch.from_pydict(out)


def _without(text: str, drop: set, options: dict, run_words: int | None) -> tuple[str, int, int]:
    """The text without the chunks and runs of these places, and the numbers of lines with words and of chunks that went."""
    parts = chunks_of(text, **options)
    chunks = sum(k >= 0 for k in drop)
    if chunks == len(drop):
        return "\n".join(x for k, (x, _) in enumerate(parts) if k not in drop), sum(n for k, (_, n) in enumerate(parts) if k in drop), chunks
    units = _units(text)
    gone, at = np.zeros(len(units), bool), 0
    for k, (_, n) in enumerate(parts):
        gone[at : at + n] = k in drop
        at += n
    for k, (s, e) in enumerate(runs_of(text, run_words)[1]):
        if -1 - k in drop:
            gone[s:e] = True
    return "\n".join(x for x, g in zip(units, gone) if not g), int(gone.sum()), chunks


def _cut(batches, options):
    options = dict(options)
    run_words = options.pop("run_words", None)
    for batch in sliced(batches):
        texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, lines, gone = [], [], []
        for text, own in zip(texts, wanted):
            cut = _without(text, set(own), options, run_words) if text and own else (text, 0, 0)
            for values, x in zip((out, lines, gone), cut):
                values.append(x)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names[2:], "_lc_text", "_lc_lines", "_lc_chunks"])


def repeated_chunks(documents: DataFrame, least_lines: int, options: dict) -> DataFrame:
    """(doc_id, content, places): the chunks to remove. content, the text's hash, tells rows apart that share an id."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("content"), "text").filter(F.col("text").isNotNull())
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, content long, place int, high long, low long"
    found = written(rows.mapInArrow(functools.partial(_rows, options=options, least_lines=least_lines, only=False), schema))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "place"))
    many = written(found.groupBy("high", "low").agg(F.count("*").alias("_n"), first.alias("first")).filter("_n > 1"))
    proposed = written(spread_join(found, many, ["high", "low"], found.count(), hint="merge"))
    # The byte comparison: every proposed chunk's text, from the documents that have one.
    of = proposed.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.collect_set("place").alias("places"))
    texts = rows.join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))).select("doc_id", "content", "text", "places")
    texts = texts.mapInArrow(functools.partial(_rows, options=options, least_lines=least_lines, only=True), schema + ", chunk string")
    compared = written(texts.groupBy("high", "low").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a <> b").select("high", "low"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content")) & ((F.col("place") == F.col("first.place")) | (F.col("place") < 0))
    extra = proposed.filter(~is_first)
    collided = compared.limit(1).count()
    if collided:  # different texts with one hash: their groups are told apart by the texts
        own = texts.join(compared, ["high", "low"], "left_semi")
        own = own.withColumn("run", F.col("place") < 0)
        firsts = own.groupBy("chunk", "run").agg(first.alias("first"))
        real = own.join(firsts, ["chunk", "run"]).filter(~is_first)
        extra = extra.join(compared, ["high", "low"], "left_anti").select("doc_id", "content", "place").unionByName(real.select("doc_id", "content", "place"))
    places = checkpoint(extra.groupBy("doc_id", "content").agg(F.collect_set("place").alias("places")))
    release(found, many, proposed, compared)
    return places


def line_chunk_dedup(documents: DataFrame, least_lines: int = 2, window: int = 2, divisor: int = 2, shortest: int = 2, longest: int = 64, run_words: int | None = None) -> DataFrame:
    """documents with shortened texts, and n_lines_removed, n_chunks_removed (whole chunks). n_chars, if there, is counted anew."""
    if taken := [c for c in documents.columns if c.lower().startswith("_lc_")]:
        raise ValueError(f"these names are the operator's own: {taken}")
    options = {"window": window, "divisor": divisor, "shortest": shortest, "longest": longest, "run_words": run_words}
    drop = repeated_chunks(documents, least_lines, options).select(F.col("doc_id").alias("_lc_id"), F.col("content").alias("_lc_content"), F.col("places").alias("_lc_places"))
    kept = [c for c in documents.columns if c != "text"]
    joined = documents.join(drop.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_lc_id")) & (F.xxhash64("text") == F.col("_lc_content")), "left").select("text", "_lc_places", *kept)
    fields = [documents.schema[c] for c in kept] + [T.StructField("_lc_text", T.StringType()), T.StructField("_lc_lines", T.LongType()), T.StructField("_lc_chunks", T.LongType())]
    cut = joined.mapInArrow(functools.partial(_cut, options=options), T.StructType(fields)).withColumnRenamed("_lc_text", "text")
    if "n_chars" in kept:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType))
    columns = [c for c in documents.columns if c.lower() not in ("n_lines_removed", "n_chunks_removed")]
    return cut.select(*columns, F.col("_lc_lines").alias("n_lines_removed"), F.col("_lc_chunks").alias("n_chunks_removed"))


def deduplicated_lines(documents: DataFrame, **options) -> DataFrame:
    """As line_chunk_dedup(), with exactly the columns of documents, whatever their names."""
    ours = {c: free_name(f"own_{c}", documents) for c in documents.columns if c.lower() in ("n_lines_removed", "n_chunks_removed")}
    out = line_chunk_dedup(documents.withColumnsRenamed(ours), **options)
    return out.drop("n_lines_removed", "n_chunks_removed").withColumnsRenamed({v: k for k, v in ours.items()}).select(*documents.columns)
