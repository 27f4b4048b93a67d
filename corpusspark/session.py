"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and ``bench.py`` use it; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind stages that are written: it does so only when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet below the shared checkpoint folder, partitioned by ``by``, and its path: for a stage that is removed once the next ones are written."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder, partitioned by ``by``, and read it from there.

    For stages that several steps read in part: each reads only its partitions and columns. The files stay until the folder is cleared, like checkpoints.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """A path's file system, as Spark's Hadoop settings name it, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens where there is none."""
    fs, at = _path(spark, path)
    fs.delete(at, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(name, bytes, modification time)`` of a file, or of the files below a folder: what tells one version of a table from another."""
    fs, at = _path(spark, path)
    found = fs.listFiles(at, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def children(spark: SparkSession, path: str) -> list[str]:
    """The paths right below a folder; none where it isn't there."""
    fs, at = _path(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place, whole or not at all."""
    fs, at = _path(spark, path)
    _, draft = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, at):
        raise FileExistsError(f"{path} was written by another job")


def read_small(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())
