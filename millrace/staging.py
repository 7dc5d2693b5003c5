"""Tables written once to the shared folder of the cluster.

A staged table cuts lineage: later steps read files, so a lost executor costs a re-read and not a
recomputation, and two branches of one plan see exactly the same rows in exactly the same order.
The planner also knows the real size of a staged table, so whether it is broadcast is decided on
measured bytes.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_local_root: str | None = None
_unreleased: list[Staging] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for local masters."""
    global _local_root
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="millrace-")
    return _local_root


def exists(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _located(spark: SparkSession, path: str):
    """A Hadoop path and its file system; listed paths come as escaped URIs."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if "://" in path or path.startswith("file:") else path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    path, files = _located(spark, path)
    files.delete(path, True)


def move_file(spark: SparkSession, path: str, folder: str | None) -> None:
    """Move a file into a folder, or delete it without one; a file that is gone already is fine."""
    path, files = _located(spark, path)
    if not files.exists(path):
        return
    if folder is None:
        files.delete(path, False)
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files.mkdirs(target)
    if not files.rename(path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, path.getName())):
        raise OSError(f"{path} could not be moved to {folder}")


def batch_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The ``batch=<n>`` folders below a path, by number."""
    path, files = _located(spark, path)
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("batch="):
            found.append((int(name.removeprefix("batch=")), status.getPath().toString()))
    return sorted(found)


class Staging:
    """A private folder below the shared root.  ``release`` removes only what this object made.

    Lazy frames may read a staged table long after the call that wrote it, so a folder lives until
    ``release`` or, when nobody calls that, until the program ends.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{root or shared_root(spark)}/millrace/{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        # kept here, because the session may be stopped before the folder is released
        self._jvm = spark.sparkContext._jvm
        self._settings = spark.sparkContext._jsc.hadoopConfiguration()
        _unreleased.append(self)

    def folder(self, name: str) -> str:
        """A new path inside this staging folder."""
        return f"{self.path}/{name}-{next(self._numbers)}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete this staging folder; call it once its readers are done."""
        if self in _unreleased:
            _unreleased.remove(self)
        path = self._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._settings).delete(path, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_exc) -> None:
        self.release()


@atexit.register
def release_all() -> None:
    """Delete every staging folder of this program that was not released yet."""
    for staging in list(_unreleased):
        with contextlib.suppress(Exception):  # the Java side may be gone already
            staging.release()
