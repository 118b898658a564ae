"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage with tables written below ``spark.checkpoint.dir``. Such a
table survives a lost executor, keeps its columns compressed, and gives later joins a plain
exchange on both sides, which adaptive execution can split when a key is hot.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Frees the shuffle files of a finished write at once, not when the driver next collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a file where the number of rows is known.
ROWS = 200_000

_roots: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the setting is absent, a folder of this driver, which only a local master shares."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{KEY} must name a folder that the driver and the executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tessera-")
        found = _own[app]
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for root, spark in _roots.items():
        try:
            _delete(spark, root)
        except Exception:  # the session is gone already
            pass


atexit.register(_clean)


def clear(spark: SparkSession) -> None:
    """Deletes the tables of all calls so far. For long sessions: a result that was not read yet, or is to be read again, needs its tables."""
    for root in [r for r, of in _roots.items() if of is spark]:
        del _roots[root]
        _delete(spark, root)


class Scratch:
    """Tables of one operator call. ``save`` writes and rereads; ``drop`` frees one that is done with.

    Tables that feed the returned, lazy result stay until ``clear`` or the end of the Python process. settings: what holds
    in the session while a table is written, besides the freeing of its shuffle files.
    """

    def __init__(self, spark: SparkSession, label: str, settings: dict[str, str] | None = None):
        self.spark, self.settings = spark, {FREE: "true", **(settings or {})}
        self.root = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        _roots[self.root] = spark

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """The table, written and read again. rows: how many it has at most, where that is known; a few rows fill few files."""
        if rows is not None:
            df = df.coalesce(rows // ROWS + 1)
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)
