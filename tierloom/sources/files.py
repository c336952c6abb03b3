"""Files on any file system that both Spark and Arrow can open: one file for each row, existence, byte ranges."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; local paths may have any characters, others are URIs."""
    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


#: A task reads about so many files, and so many bytes of small ones.
FILES, BYTES = 500, 4 << 20


def packed(found: DataFrame) -> DataFrame:
    """What is read from files, with many small ones in a task.

    Spark counts a file as 4 MB at least, which makes a task of every 32 small ones; such tasks are put together, without a shuffle.
    """
    leaf = found._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
    count, size = leaf.relation().location().allFiles().size(), int(str(leaf.stats().sizeInBytes()))
    return found.coalesce(max(found.sparkSession.sparkContext.defaultParallelism, -(-count // FILES), -(-size // BYTES)))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files below `path`, from any store that Spark reads, `packed`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return packed((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write `content` (text as UTF-8, or bytes) to folder/name for each row and return (name, bytes) of what was written.

    A file appears under its name when it is complete, so a task that is run again leaves the same files. Rows are written as the
    result is read, once: save it, or count it. Null names are left out, null contents are empty files; of rows
    with one name that which is written last stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, root = open_fs(folder)
            names, sizes, made = batch.column(0).to_pylist(), [], set()
            for n, c in zip(names, batch.column(1)):
                raw = c.as_py() or b""
                path = f"{root}/{n}"
                if (at := path.rpartition("/")[0]) not in made:
                    store.create_dir(at)
                    made.add(at)
                part = f"{at}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(raw)
                store.move(part, path)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    rows = files.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(run, "name string, bytes long")


def without_sentinel(files: DataFrame, root: str, relpath: str, sentinel: str) -> DataFrame:
    """Files whose folder (root/relpath) doesn't hold the file `sentinel`, which may be hidden; each folder is asked once, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, top = open_fs(root)
            paths = ["/".join(x for x in (top.rstrip("/"), d, sentinel) if x) for d in batch.column(0).to_pylist()]
            bad = [i.type == fs.FileType.File for i in store.get_file_info(paths)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad, pa.bool_()))], names=[relpath])

    bad = files.select(relpath).distinct().mapInArrow(run, f"`{relpath}` string")
    return files.join(bad, relpath, "left_anti")


def npz_contents(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(*keys, content): the given columns of each row, numbers and arrays of numbers, as the bytes of an .npz archive; nulls are left out."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for values in zip(*(batch.column(len(keys) + k).to_pylist() for k in range(len(columns)))):
                out = io.BytesIO()
                np.savez(out, **{c: np.asarray(v) for c, v in zip(columns, values) if v is not None})
                found.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.binary())], names=[*keys, "content"])

    return rows.select(*keys, *columns).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "content binary"]))
