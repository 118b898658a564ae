"""Files that Python tasks list and read by byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_WILD = re.compile(r"[*?\[]")


def reachable(spark: SparkSession, path: str) -> str:
    """A path or glob with the scheme of the store that really holds it, as Spark resolves it (default stores, mounts)."""
    wild = _WILD.search(path)
    base = path[: path.rindex("/", 0, wild.start())] if wild else path
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(at).toString()
    return re.sub(r"^s3[an]:", "s3:", found) + path[len(base) :]


def _store(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what goes before such paths to name them in full."""
    uri = re.sub(r"^file:/+", "/", uri)
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path, "file:" if uri.startswith("/") else uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"


def opened(uri: str):
    """A file open for reads at any place."""
    fs, path, _ = _store(uri)
    return fs.open_input_file(path)


def children(uri: str) -> list[tuple[str, int | None]]:
    """(full path, bytes) of what a folder holds, in order; folders have no bytes."""
    fs, path, before = _store(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((before + i.path, i.size if i.is_file else None) for i in found if not i.base_name.startswith((".", "_")))


def listed(pattern: str) -> Iterator[tuple[str, int]]:
    """(full path, bytes) of the files that match a glob of ``*``, ``?`` and ``[..]``; only folders that match are looked into."""
    wild = _WILD.search(pattern)
    if not wild:
        fs, path, before = _store(pattern)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(pattern)
        yield from [(before + path, info.size)] if info.is_file else [(p, n) for p, n in children(pattern) if n is not None]
        return
    start = pattern.rindex("/", 0, wild.start())
    level = [(pattern[:start], None)]
    for name in pattern[start + 1 :].split("/"):
        level = [c for p, n in level if n is None for c in children(p) if fnmatchcase(c[0].rsplit("/", 1)[1], name)]
    yield from ((p, n) for p, n in level if n is not None)
