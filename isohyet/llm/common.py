"""What several operators of this package need: shared storage, numbering without hot tasks, connected classes.

Words are everywhere the runs of characters that match ``[^\\x20\\x09-\\x0D]+``. On UTF-8 bytes that is what
``bytes.split()`` gives, and ``bytes.lower()`` changes A-Z only, so Python code works on encoded texts.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words, as the inside of a regular expression's class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the cluster's own setting. Only where driver and executors are one machine, as in tests,
    one of ours is set instead."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """Computes the frame once, into the shared folder. For narrow rows."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: Frame's id -> its folder, of frames of written() that are not yet released.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: With it, the shuffles of a query are deleted when the query ends (Spark 4.1).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, lean: bool = False) -> DataFrame:
    """As checkpoint(), but as Parquet: for many rows. The table goes when release() says so, at the latest when the application
    ends, as results are lazy. lean: the shuffles that it took go at once, not when the driver happens to collect its garbage, and the table is
    compressed more."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if lean:
        spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path, compression="zstd" if lean else None)
    finally:
        if lean:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    stored = spark.read.parquet(path)
    _WRITTEN[stored] = path
    return stored


def written_parts(spark: SparkSession, parts: Iterable[tuple[DataFrame, object]]) -> DataFrame:
    """One table of many frames, written one after the other; what is broadcast for a frame is released once it is written."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    for frame, held in parts:
        frame.write.mode("append").parquet(path)
        held.unpersist()
    stored = spark.read.parquet(path)
    _WRITTEN[stored] = path
    return stored


def release(*frames: DataFrame) -> None:
    """Deletes the tables of written() frames that nothing lazy needs any more."""
    for frame in frames:
        if path := _WRITTEN.pop(frame, None):
            system, place = _file_system(frame.sparkSession, path)
            system.delete(place, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has; names are compared without case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """On a worker, which lives on after a task: returns the memory that its allocators keep but don't use to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library's
        trim(0)


#: Of this worker: what the call that it last had a task of keeps between tasks, by the call's tag.
_KEPT: dict[str, object] = {}


def kept(tag: str, make):
    """On a worker: what make() gave in this call's first task here. It goes with the first task of another call."""
    if tag not in _KEPT:
        _KEPT.clear()
        _KEPT[tag] = make()
    return _KEPT[tag]


def sliced(batches, rows: int = 1024, tag: str | None = None):
    """Smaller batches of the same rows: what a worker makes Python objects of at a time. Memory goes back when they end; what calls
    other than `tag` have kept goes at once."""
    if tag not in _KEPT:
        _KEPT.clear()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    give_back()


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def word_count(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")), F.lit(0)).cast("long")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", salt=None, salts: int = 64, share: int = 256, least: int = 100_000, hint: str | None = None) -> DataFrame:
    """rows.join(table, keys); table has one row per key, and in `_n` how many rows have it (`total` in all). The result lacks `_n`.

    A key of more than total / share (and `least`) rows would be one task's work: its rows are spread over `salts` tasks and its row of the table is there
    for each. There are fewer than `share` such keys, so their list is broadcast. salt: a whole number that rows of a key differ in; by default
    a row's place, for which rows must be a stored table.
    """
    plain = table.drop("_n")
    crowded = table.filter(F.col("_n") > max(least, total // share)).select(*keys).limit(share)
    if total <= least or not crowded.limit(1).count():
        return rows.join(plain.hint(hint) if hint else plain, keys, how)
    hot, by = free_name("_hot", rows, table), free_name("_salt", rows, table)
    crowded = checkpoint(crowded.withColumn(hot, F.lit(True)))
    spread = F.pmod(F.monotonically_increasing_id() if salt is None else salt, F.lit(salts))
    left = rows.join(F.broadcast(crowded), keys, "left").withColumn(by, F.when(F.col(hot), spread).otherwise(0).cast("int")).drop(hot)
    every = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = plain.join(F.broadcast(crowded), keys, "left").withColumn(by, F.explode(every)).drop(hot)
    return left.join(right.hint(hint) if hint else right, [*keys, by], how).drop(by)


def numbered(frame: DataFrame, keys: list[str], order: list[str], n_rows: int, name: str = "rank", part: str | None = None) -> DataFrame:
    """Adds a number from 0 to each row among those with equal keys, ascending without gaps.

    A plain window would sort a whole group in one task. Here rows of a group go to about sqrt(n_rows) cells by
    a hash of the order columns; a cell is numbered by itself and starts after the cells before it. So the largest
    task has 1 / sqrt(n_rows) of a group, and the table of cells has at most sqrt(n_rows) rows of a group.

    Rows that are equal in the order columns share a cell whatever its number. With `part`, a stored column that says which part of a table a
    row lies in, a cell that is far too large (fewer than sqrt(n_rows) / 2 can be) is cut further by the rows' whole hash and by part. Numbers of
    different rows depend on their contents only; equal rows may change places.
    """
    cells = max(1, int(n_rows**0.5))
    celled = frame.withColumn("_hash", F.xxhash64(*order)).withColumn("_cell", F.pmod("_hash", F.lit(cells)))
    sub: list[str] = []
    if part is not None and n_rows > 10_000:
        sizes = celled.groupBy(*keys, "_cell").count()
        hot = checkpoint(sizes.filter(F.col("count") > 2 * cells + 1000).select(*keys, "_cell", F.lit(True).alias("_hot")))
        if hot.limit(1).count():
            sub = ["_sub_hash", "_sub_part"]
            same = [celled[c].eqNullSafe(hot[c]) for c in (*keys, "_cell")]
            joined = celled.join(F.broadcast(hot), reduce(lambda a, b: a & b, same), "left").select(*(celled[c] for c in celled.columns), "_hot")
            celled = joined.withColumn("_sub_hash", F.when(F.col("_hot"), F.col("_hash")).otherwise(0)).withColumn("_sub_part", F.when(F.col("_hot"), F.col(part)).otherwise(0)).drop("_hot")
    cell = ["_cell", *sub]
    starts = (
        celled.groupBy(*keys, *cell).count()
        .withColumn("_start", F.sum("count").over(Window.partitionBy(*keys).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, *cell, F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy(*keys, *cell).orderBy(*order)) - 1
    return celled.drop("_hash").join(starts, [*keys, *cell]).withColumn(name, F.col("_start") + within).drop(*cell, "_start")


def classes(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected classes of the graph with edges (a, b), both long and not null: one row (node, root) per node, root
    the smallest of its class.

    Alternates the large-star and small-star steps: each node passes its smallest neighbour to the others, until
    every node but the root hangs on the root. Minima are aggregated on the map side and joined back; a node of high degree, as the hub of a star, has its
    edges spread over many tasks there. The number of rounds grows with the logarithm of a path's length.
    """
    edges = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before, total = None, edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n"))
        large = spread_join(both, lowest, ["a"], 2 * total).filter("b > a").select(F.col("m").alias("a"), "b")
        large = checkpoint(large.filter("a < b").distinct())
        lowest = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("_n"))
        joined = spread_join(large, lowest, ["b"], total)
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b"))
        edges = checkpoint(small.filter("a < b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before, total = now, now[0]
    raise RuntimeError(f"the classes did not settle within {most_rounds} rounds")
