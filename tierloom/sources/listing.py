"""Listings of directory trees, with columns from named groups of patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.sources.files import binary_files, open_fs, without_sentinel

FILES = "path string, bytes long, mtime double"


def _groups(pattern: str) -> dict[str, int]:
    """Names of the pattern's groups with their numbers, in order."""
    found = re.compile(pattern).groupindex
    return dict(sorted(found.items(), key=lambda x: x[1]))


def _java(pattern: str) -> str:
    """The pattern with numbers for the names of groups, of which Java allows fewer: groups and references keep their numbers."""
    numbers = _groups(pattern)
    plain = re.sub(r"\(\?P<[^>]*>", "(", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{numbers[m[1]]}(?:)", plain)


def list_files(spark: SparkSession, folder: str, file_pattern: str | None = None, dir_pattern: str | None = None, add: Sequence[str] = (), sentinel: str | None = ".bad.txt", dotfiles: bool = False) -> DataFrame:
    """(relpath, fname, captures...) of all files, with any of dirname, barename, ext, bytes and mtime.

    Named groups of the patterns become string columns, whatever their names. Folders that hold the file `sentinel` are left
    out, on any file system. Spark doesn't list hidden files (and those in hidden folders); with `dotfiles` the driver lists the folder.
    """
    root = folder.rstrip("/")
    if dotfiles:
        store, top = open_fs(root)
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        rows = [(f.path, f.size, f.mtime.timestamp() if f.mtime else None) for f in found if f.type == fs.FileType.File]
        files, base = spark.createDataFrame(rows, FILES), top.rstrip("/")
    else:
        found = binary_files(spark, root)
        files, base = found.select("path", F.col("length").alias("bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")), re.sub("^file:/+", "/", root)
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"^\Q" + base.replace(r"\E", r"\E\\E\Q") + r"\E/?", "")
    files = files.withColumn("_in", inside).withColumns({"relpath": F.regexp_extract("_in", "^(?:(.*)/)?[^/]*$", 1), "fname": F.regexp_extract("_in", "([^/]*)$", 1)})
    if sentinel:
        files = without_sentinel(files, root, "relpath", sentinel).where(F.col("fname") != sentinel)
    captures = {}
    for pattern, col in ((dir_pattern, "relpath"), (file_pattern, "fname")):
        if pattern:
            files = files.where(F.col(col).rlike(_java(pattern)))
            captures |= {g: F.regexp_extract(col, _java(pattern), k) for g, k in _groups(pattern).items()}
    extra = {"dirname": F.lit(root), "barename": F.regexp_extract("fname", r"^(.+?)(\.[^.]*)?$", 1), "ext": F.regexp_extract("fname", r"(\.[^.]*)$", 1), "bytes": F.col("bytes"), "mtime": F.col("mtime")}
    return files.select("relpath", "fname", *[extra[a].alias(a) for a in add], *[c.alias(n) for n, c in captures.items()])
