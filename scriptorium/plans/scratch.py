"""Scratch tables in the folder that every executor shares.

Iterative plans cut their lineage here: a table is written once as Parquet and
reread, so a lost executor costs at most the running step.  The folder is the
session's ``spark.checkpoint.dir``; only a local session without one gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _local_root
    found = spark.conf.get(_SETTING, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return "file://" + _local_root


class Scratch:
    """Tables of one running operator: ``keep`` writes one, ``discard`` deletes it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write ``df`` and return it as read back."""
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def discard(self, df: DataFrame) -> None:
        """Delete a kept table that no later step reads."""
        path = self._paths.pop(id(df), None)
        if path:
            jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
