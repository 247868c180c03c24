"""Tables and files that a query writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_live: list["Scratch"] = []
#: What was made inside the scopes that this thread or task is in, the innermost last.
_scopes: ContextVar[tuple[list["Scratch"], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return qualified(spark, found)
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="cubeloom-")
    return _own["dir"]


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system's scheme, as Hadoop's and pyarrow's file systems both take it."""
    if "://" not in path:
        given = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    return (path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path).rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers on this machine find this package wherever the driver was started."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return spark


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive the loss of an executor.

    They stay until ``drop``, the end of the ``scope`` they were made in, or the end of the driver's Python."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = importable(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _live.append(self)
        for made in _scopes.get()[-1:]:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables made inside, by this thread, are dropped at its end: what is returned from it must have been written elsewhere."""
    made: list[Scratch] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for one in made:
            one.drop()
            _live.remove(one)


@atexit.register
def _drop_all() -> None:
    for made in _live:
        try:
            made.drop()
        except Exception:  # the JVM has ended before
            break
    if "dir" in _own:
        shutil.rmtree(_own["dir"].removeprefix("file://"), ignore_errors=True)
