"""The knowledge base: documents in a folder, by dataset, with a log of what was added.

An addition is written to a hidden folder first.  Its log entry, one JSON file that names its data files with their dataset,
least and largest id, is what makes it count; then the files move into place, and an addition that was logged but not
moved, as the driver was lost, is moved by whoever comes next.  So readers see whole additions only, and the next
addition reads of the standing files those alone that may hold one of its documents.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, STAGED = "_log", "_staged"
ENTRY = "run string, n long, files array<struct<name:string,dataset:string,low:string,high:string,nulls:boolean>>, error string"


class _Folder:
    """The few file operations that Spark's readers and writers don't have."""

    def __init__(self, spark: SparkSession, path: str):
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def write(self, name: str, text: str) -> None:
        """Make a file that isn't there yet; one that is there is an error."""
        out = self.fs.create(self.at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move(self, source: str, target: str) -> None:
        if self.fs.exists(self.at(source)):
            self.fs.mkdirs(self.at(target).getParent())
            if not self.fs.rename(self.at(source), self.at(target)):
                raise OSError(f"{source} can't be moved to {target}")


def _settle(folder: _Folder) -> None:
    """Move the files of additions that were logged but not moved; drop what never was."""
    logged = {n.removesuffix(".json") for n in folder.names(LOG)}
    for run in folder.names(STAGED):
        if run in logged:
            for f in json.loads(folder.read(f"{LOG}/{run}.json"))["files"]:
                folder.move(f"{STAGED}/{run}/{f['name']}", f["name"])
            folder.fs.delete(folder.at(f"{STAGED}/{run}"), True)


def log(spark: SparkSession, path: str) -> DataFrame:
    """(run, n, files ARRAY<STRUCT<name, dataset, low, high, nulls>>, error): the additions, failed ones with their error."""
    return spark.read.schema(ENTRY).json(f"{path.rstrip('/')}/{LOG}")


def held_files(spark: SparkSession, path: str, keys: DataFrame) -> list[str]:
    """Names of the files that may hold a document of ``keys`` (dataset, id), by the log alone."""
    kind = keys.schema["id"].dataType.simpleString()
    wanted = keys.groupBy("dataset").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("without"))
    each = log(spark, path).select(F.explode("files").alias("f")).select("f.*").withColumnsRenamed({"dataset": "d"})
    each = each.join(wanted, F.col("d") == F.col("dataset"))
    meets = (F.col("low").cast(kind) <= F.col("most")) & (F.col("high").cast(kind) >= F.col("least"))
    return [r.name for r in each.where(F.coalesce(meets, F.lit(False)) | (F.col("nulls") & (F.col("without") > 0))).select("name").distinct().collect()]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the knowledge base."""
    _settle(_Folder(spark, path))
    return spark.read.parquet(path)


def ingest(docs: DataFrame, path: str, dataset_col: str = "dataset", id_col: str = "doc_id", strict: bool = True) -> DataFrame:
    """Add documents (dataset, doc_id, content, ...) to the knowledge base in the folder ``path``; (dataset, doc_id, run).

    A dataset is a partition, made at its first document and used again after.  A document that its dataset holds with
    the same content isn't written again, so a job that failed half-way can be run again whole; of rows that repeat
    dataset, id and content one is written.  Null and blank datasets go under ``unknown``; null contents are empty.  ``run`` is
    DONE for the given documents that the base holds then.  An addition that fails is logged with its error and raised;
    with ``strict`` false its documents are FAIL instead, but for those that were held before.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    folder = _Folder(spark, path)
    _settle(folder)
    key = [dataset_col, id_col, "digest"]
    tidy = docs.withColumns({dataset_col: F.coalesce(F.nullif(F.trim(dataset_col), F.lit("")), F.lit("unknown")), "content": F.coalesce("content", F.lit("")), "digest": F.sha2(F.coalesce("content", F.lit("")), 256)})
    new, held = tidy.dropDuplicates(key), None
    if folder.names(LOG):
        files = held_files(spark, path, tidy.select(F.col(dataset_col).alias("dataset"), F.col(id_col).alias("id")))
        if files:
            held = spark.read.schema(tidy.schema).option("basePath", path).parquet(*[f"{folder.root}/{f}" for f in files]).select(*[F.col(c).alias(f"__{c}") for c in key])
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
            new = new.join(held, same, "left_anti")
    staged = f"{folder.root}/{STAGED}/{run}"
    try:
        new.write.partitionBy(dataset_col).parquet(staged)
        rows = []
        if [n for n in folder.names(f"{STAGED}/{run}") if not n.startswith(("_", "."))]:
            written = spark.read.schema(tidy.schema).parquet(staged).select(F.input_file_name().alias("file"), F.col(dataset_col).alias("dataset"), F.col(id_col).alias("id"))
            rows = written.groupBy("file", "dataset").agg(F.count("*").alias("n"), F.min("id").cast("string").alias("low"), F.max("id").cast("string").alias("high"), (F.count_if(F.col("id").isNull()) > 0).alias("nulls")).collect()  # one for each file
        parts = ["/".join(r.file.rsplit("/", 2)[1:]) for r in rows]
        from urllib.parse import unquote

        files = [{"name": unquote(name), "dataset": r.dataset, "low": r.low, "high": r.high, "nulls": r.nulls} for name, r in zip(parts, rows, strict=True)]
        folder.write(f"{LOG}/{run}.json", json.dumps({"run": run, "n": sum(r.n for r in rows), "files": files}))
    except Exception as error:
        folder.fs.delete(folder.Path(staged), True)
        folder.write(f"{LOG}/{run}.json", json.dumps({"run": run, "n": 0, "files": [], "error": str(error)[:500]}))
        if strict:
            raise
        told = tidy.select(*key).distinct()
        if held is not None:
            told = told.join(held.withColumn("__there", F.lit(True)).distinct(), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left")
        else:
            told = told.withColumn("__there", F.lit(None).cast("boolean"))
        return told.groupBy(dataset_col, id_col).agg(F.when(F.bool_and(F.coalesce("__there", F.lit(False))), "DONE").otherwise("FAIL").alias("run"))
    _settle(folder)
    return tidy.select(dataset_col, id_col, F.lit("DONE").alias("run")).distinct()
