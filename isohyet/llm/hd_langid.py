"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) those of its letters, each permuted
by its place; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles its training texts, each
with the same weight. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; anything else is a boundary, and runs of it are one. a-z have vectors of their own, all other letters
share 37 by a hash of their code point. Vectors come from a seed, so workers need only the prototypes: languages x dimensions.

Binding is done once per different n-gram of a block of texts; bundling is a matrix product of the block's counts
with these vectors. For prototypes counts are added up first, as bundling is linear.

A text that is null or has no letter gets `und` with score 0. Score: the cosine, from 0 to 1. Rows without a language are not
learned from; rows with a null id are (they are never held out). With no labelled row (or an empty table) every text is `und`. Repeated rows count as often as they occur. Ties go
to the language that comes first by code point. A very long text is a block of its own, in memory of some 30 bytes a character. Other columns are ignored, whatever their names.

Prototypes are the only thing that is broadcast: at most MOST_LANGUAGES, counted first, of 4 KB each. More languages than there are is an error, not a cut.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, id_remainder, sliced

#: Languages that can be learned: more than the world has.
MOST_LANGUAGES = 8192
#: Letters with vectors of their own (0 is the boundary), and letters of an n-gram.
LETTERS, PLACES = 64, 3


@functools.lru_cache(1)
def _alphabet() -> np.ndarray:
    """Code point -> 0 (no letter) to 63."""
    points = np.arange(0x110000, dtype=np.int64)
    ids = (27 + (points * 2654435761 >> 7) % (LETTERS - 27)).astype(np.uint8)
    ids[ord("a") : ord("z") + 1] = np.arange(1, 27)
    letter = np.fromiter((x not in _SURROGATES and chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)
    ids[~letter] = 0
    return ids


_SURROGATES = range(0xD800, 0xE000)


@functools.lru_cache(2)
def _places(dimensions: int, seed: int) -> list[np.ndarray]:
    """For each place of an n-gram: the letters' vectors, permuted as often as letters follow."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))
    return [np.roll(letters, PLACES - 1 - i, axis=1) for i in range(PLACES)]


def bound(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Vectors of n-grams, given as numbers to the base 64."""
    first, second, third = _places(dimensions, seed)
    return first[grams >> 12] * second[grams >> 6 & 63] * third[grams & 63]


def bundled(counts: np.ndarray, grams: np.ndarray, dimensions: int, seed: int, most: int = 4096) -> np.ndarray:
    """Sums of n-grams' vectors, each as often as counts (text, n-gram) say; `most` n-grams are bound at a time."""
    total = np.zeros((len(counts), dimensions), np.float32)
    for i in range(0, len(grams), most):
        total += counts[:, i : i + most].astype(np.float32) @ bound(grams[i : i + most], dimensions, seed).astype(np.float32)
    return total


def grams_of(text: str) -> np.ndarray:
    """A text's n-grams, boundaries at its ends included; none if it has no letter."""
    ids = _alphabet()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    ids = np.concatenate([[0], ids, [0]]).astype(np.int32)
    ids = ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])]
    return ids[:-2] << 12 | ids[1:-1] << 6 | ids[2:] if len(ids) > 2 else ids[:0]


def _blocks(texts: list[str | None], rows: int = 256, characters: int = 1 << 20):
    """Blocks of texts: places in the list, the block's different n-grams, and (text, n-gram, count) as a matrix."""
    present, column = np.zeros(LETTERS**PLACES, bool), np.zeros(LETTERS**PLACES, np.int32)
    block, n = [], 0
    for i, text in enumerate(texts):
        own = grams_of(text or "")
        block.append((i, own))
        n += len(own)
        if len(block) == rows or n > characters or i == len(texts) - 1:
            sizes = [len(x) for _, x in block]
            every = np.concatenate([x for _, x in block])
            present[:] = False
            present[every] = True
            grams = np.flatnonzero(present)
            column[grams] = np.arange(len(grams))
            counts = np.zeros((len(block), len(grams)), np.float32)
            for row, (_, own) in enumerate(block):
                counts[row] = np.bincount(column[own], minlength=len(grams))
            yield np.array([x for x, _ in block]), grams, counts, np.array(sizes)
            block, n = [], 0


def _learn(batches, dimensions, seed):
    sums: dict[str, np.ndarray] = {}
    for batch in sliced(batches):
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for at, grams, counts, sizes in _blocks(batch.column(0).to_pylist()):
            weighed = counts / np.maximum(sizes, 1)[:, None]
            names = sorted(set(langs[at]))
            if len(grams):
                total = bundled(np.stack([weighed[langs[at] == x].sum(axis=0) for x in names]), grams, dimensions, seed)
                for name, one in zip(names, total):
                    sums[name] = sums.get(name, 0.0) + one.astype(np.float64)
    names = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], names=["lang", "v"])


def prototypes(labelled: DataFrame, dimensions: int, seed: int) -> dict[str, np.ndarray]:
    """Language -> unit vector, from rows (text, lang). Each task returns one sum per language."""
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different languages")
    sums = labelled.mapInArrow(functools.partial(_learn, dimensions=dimensions, seed=seed), "lang string, v array<double>")
    rows = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    found = {r.lang: np.array([x.x for x in r.v]) for r in rows}
    return {k: (found[k] / n).astype(np.float32) for k in sorted(found) if (n := np.linalg.norm(found[k])) > 0}


def _predict(batches, model, dimensions, seed, keep, fields):
    """The columns at the places `keep`, then language and score of the last column's texts; named `fields`."""
    names, vectors = model.value
    for batch in sliced(batches):
        best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        for at, grams, counts, sizes in _blocks(batch.column(batch.num_columns - 1).to_pylist()):
            if not len(grams) or not len(names):
                continue
            own = bundled(counts, grams, dimensions, seed)
            norm = np.linalg.norm(own, axis=1)
            cosine = own @ vectors.T / np.maximum(norm, 1e-9)[:, None]
            some = sizes > 0
            best[at[some]] = cosine.argmax(axis=1)[some]
            score[at[some]] = np.clip(cosine.max(axis=1)[some], 0.0, 1.0)
        chosen = pa.array([names[x] if x >= 0 else "und" for x in best], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), chosen, pa.array(score, pa.float64())], names=fields)


def predicted(documents: DataFrame, kept: DataFrame, dimensions: int, held_out: int, seed: int, text_too: bool) -> tuple[DataFrame, str, str]:
    """The columns of kept, whose last is the text (left out unless text_too), with language and score, and these two's names; learned from documents."""
    out = F.coalesce(id_remainder("doc_id", held_out) == 0, F.lit(False))
    learned = prototypes(documents.filter(~out & F.col("lang").isNotNull()).select("text", "lang"), dimensions, seed)
    model = documents.sparkSession.sparkContext.broadcast((list(learned), np.stack(list(learned.values())) if learned else np.zeros((0, dimensions), np.float32)))
    fields = kept.schema.fields if text_too else kept.schema.fields[:-1]
    lang, score = free_name("lang_pred", kept), free_name("score", kept)
    schema = T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    predict = functools.partial(_predict, model=model, dimensions=dimensions, seed=seed, keep=list(range(len(fields))), fields=schema.names)
    return kept.mapInArrow(predict, schema), lang, score


def language_id(documents: DataFrame, dimensions: int = 1024, held_out: int = 5, seed: int = 7) -> DataFrame:
    """One row per row of documents: doc_id, held_out (the id's crc32 modulo held_out is 0), lang_pred, score."""
    out = F.coalesce(id_remainder("doc_id", held_out) == 0, F.lit(False))
    return predicted(documents, documents.select("doc_id", out.alias("held_out"), "text"), dimensions, held_out, seed, False)[0]


def known_language(documents: DataFrame, least: float = 0.1, dimensions: int = 1024, held_out: int = 5, seed: int = 7) -> DataFrame:
    """The documents whose language is recognised: `und` and cosines under `least` go. One pass, without a shuffle.

    least lies above what texts of other alphabets and of random letters reach by chance (about 0.03 to 0.08, as 1,024 dimensions give 0.03), and below the documents'
    own cosines (99.9 % of them are above 0.14). Null and empty texts go; repeated rows stay as often as they are; an empty table gives an empty one. Extra columns are kept, whatever their names."""
    others = [c for c in documents.columns if c != "text"]
    found, lang, score = predicted(documents, documents.select(*others, "text"), dimensions, held_out, seed, True)
    return found.filter((F.col(lang) != "und") & (F.col(score) >= least)).select(*documents.columns)
