"""Tables written between steps, in the folder that driver and executors share.

Writing a step's rows and reading them back cuts the lineage, so a lost executor costs a re-read
and not a re-run.  The folder is ``spark.checkpoint.dir``; where a session on one machine has none (tests) a temporary
folder is made and set, and on a cluster that is an error, as its machines would each write to their own disk.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        placed = spark.sparkContext._jsc.sc().getCheckpointDir()
        if placed.isDefined():
            found = placed.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            found = tempfile.mkdtemp(prefix="procurelake-")
            spark.sparkContext.setCheckpointDir(found)
            spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Scratches of this process, in order; ``drop_since`` removes those that a finished step made.
_made: list[Scratch] = []


def mark() -> int:
    """The place in the list of scratches to give to ``drop_since``."""
    return len(_made)


def drop_since(place: int) -> None:
    """Delete all tables of scratches made after ``mark`` gave ``place``: their step's result has been written."""
    for scratch in _made[place:]:
        scratch.drop_all()
    del _made[place:]


class Scratch:
    """Named intermediate tables of one operator call, removed when the JVM ends or on ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/procurelake/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.written = 0
        _made.append(self)
        self._filesystem(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _filesystem(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return the table that reads it."""
        path, self.written = f"{self.path(name)}-{self.written}", self.written + 1
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
        out = self.spark.read.schema(T.StructType(fields)).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop_all(self) -> None:
        self.drop(*[df for df, _ in self.paths.values()])

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                self._filesystem(path).delete(self._path(path), True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver's JVM collects garbage, which a small driver heap may not do for hours; a step
    that has just written its table calls this so that the files don't lie beside the table until then.
    """
    for _ in range(2):  # the first round lets go of what Python's objects held in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
