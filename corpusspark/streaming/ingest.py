"""Incremental ingest with Structured Streaming: new chunk files are merged into a collection batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import Collection


def _stream(spark: SparkSession, source: str, files_per_batch: int = 8) -> DataFrame:
    """The Parquet files below a folder as a stream; a single file is the only one of its folder that is read."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(str(path.getParent()))
    return reader.parquet(source)


def ingest(spark: SparkSession, source: str, collection: Collection, checkpoint: str, newest: str = "indexed_at", files_per_batch: int = 8) -> None:
    """Read all Parquet files that are new below ``source`` and merge them: of rows with one key the newest stays, and a batch rewrites only the buckets of its keys. Runs until there are none left, and goes on from there next time."""
    stream = _stream(spark, source, files_per_batch)
    query = stream.writeStream.foreachBatch(lambda batch, _: collection.upsert(batch, newest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
