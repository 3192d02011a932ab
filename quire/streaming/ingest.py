"""Incremental ingestion: new and changed PDFs to Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quire.session import materialize
from quire.sources.datasource import register
from quire.sources.pdf import extract, schema_of

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.col("path").alias("doc_id"), "modificationTime", "length", "content")


def distinct_files(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """One file of each content within the delay; state is kept by digest only."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["digest"])


def ingest(files: DataFrame, table: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a table of the files to Parquet. The kernel keeps no state, so a batch
    that fails is run again from the file source's log."""
    writer = extract(files, table).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


class Ingested:
    """A table of TABLES over files that come and change, in the folder `out`.

    Each batch writes its rows, and then a log of the files that it took, to folders of its
    own name; rows count once their batch's log is complete. A file's rows are those of
    the batch that took it last, so a changed file supersedes what it was, and a batch
    that is run again writes over itself."""

    LOG = "doc_id string, digest string, modificationTime timestamp, batch long"

    def __init__(self, spark: SparkSession, out: str, table: str):
        self.spark, self.out, self.table = spark, out.rstrip("/"), table

    def _batches(self) -> list[int]:
        """Batches whose log is complete."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/log")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [n for n in names if n.startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/log/{n}/_SUCCESS"))]
        return sorted(int(n[6:]) for n in done)

    def _read(self, what: str, schema, batches: list[int]) -> DataFrame:
        paths = [f"{self.out}/{what}/batch={b}" for b in batches]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.out}/{what}")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _taken(self, batches: list[int]) -> DataFrame:
        """doc_id, digest, batch: of each file what was taken last."""
        last = F.max_by(F.struct("digest", "batch"), F.struct("modificationTime", "batch"))
        return self._read("log", self.LOG, batches).groupBy("doc_id").agg(last.alias("l")).select("doc_id", "l.*")

    def take(self, files: DataFrame, batch: int) -> None:
        """Takes in doc_id, modificationTime, content. Of files of one name the latest
        counts; a file whose content is what was taken last is passed over."""
        own = files.select("doc_id", "modificationTime", "content", F.sha2("content", 256).alias("digest"))
        latest = own.groupBy("doc_id").agg(F.max(F.struct("modificationTime", "digest")).alias("l")).select("doc_id", "l.*")
        known = self._taken([b for b in self._batches() if b < batch]).select("doc_id", F.col("digest").alias("was"))
        new = materialize(latest.join(known, "doc_id", "left").where("was is null or was <> digest").select("doc_id", "digest", "modificationTime"), "new")
        one = own.join(new, ["doc_id", "digest", "modificationTime"], "left_semi").dropDuplicates(["doc_id"])
        extract(one, self.table).write.mode("overwrite").parquet(f"{self.out}/rows/batch={batch}")
        new.write.mode("overwrite").parquet(f"{self.out}/log/batch={batch}")

    def rows(self) -> DataFrame:
        """The table's rows of all files as they were taken last."""
        batches, schema = self._batches(), schema_of(self.table)
        held = self._read("rows", StructType([*schema.fields, StructField("batch", LongType())]), batches)
        return held.join(self._taken(batches).select("doc_id", "batch"), ["doc_id", "batch"]).select(schema.names)

    def follow(self, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Takes in files under a path, new ones and those that change, a batch at a time."""
        register(self.spark)
        stream = self.spark.readStream.format("pdf").option("table", "files").load(path)
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
