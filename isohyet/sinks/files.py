"""Files by Spark's own file systems, so that they may be in any store that Spark can write."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    system, own = _at(spark, path)
    return system.exists(own)


def delete(spark: SparkSession, path: str) -> None:
    system, own = _at(spark, path)
    system.delete(own, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's folders."""
    system, own = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(own) if f.isDirectory())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    system, own = _at(spark, path)
    stream = system.open(own)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    system, own = _at(spark, path)
    stream = system.create(own, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def _store(path: str):
    """On a worker: the store of a path, of any kind that pyarrow knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def get_file(path: str, store=None):
    """On a worker: the store and a file's content, None where there is no file."""
    found, place = _store(path)
    store = store or found
    try:
        with store.open_input_stream(place) as f:
            return store, f.read()
    except FileNotFoundError:
        return store, None


def put_files(batches, folder: str):
    """On a worker: writes files (name, content) into a folder, and gives their names and sizes. A name may have folders of its own; a file gets its name when it is whole."""
    store, place = _store(folder)
    store.create_dir(place)
    made = set()
    for batch in batches:
        names, contents = batch.column("name").to_pylist(), batch.column("content").to_pylist()
        for name, content in zip(names, contents):
            inner, _, last = name.rpartition("/")
            own = f"{place}/{inner}" if inner else place
            if own not in made:
                store.create_dir(own)
                made.add(own)
            part = f"{own}/.{last}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(content)
            store.move(part, f"{own}/{last}")
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(c) for c in contents], pa.int64())], names=["name", "size"])


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the application ends: below spark.checkpoint.dir, on a single machine below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="isohyet-")
    path = f"{base}/scratch-{uuid.uuid4().hex}"
    system, own = _at(spark, path)
    system.mkdirs(own)
    system.deleteOnExit(own)
    return path


def land(frame: DataFrame) -> DataFrame:
    """The frame, computed once and stored in a scratch folder."""
    path = f"{scratch_folder(frame.sparkSession)}/rows"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)
