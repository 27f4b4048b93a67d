"""Versioned Parquet collections and the incremental diff that keeps them up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, cut_lineage, read_small, remove, write_small
from .retrieval import dense_topk, latest


class NothingFoundError(RuntimeError):
    """Raised when no source yields a file while the collection has rows: a wrong path must not empty it."""


def diff(candidates: DataFrame, snapshot: DataFrame, key: str, fields: list[str], failed_paths: DataFrame | None = None, path_col: str = "file_path") -> DataFrame:
    """``(key, change)`` for each key of either side: ``new``, ``updated``, ``same``, ``stale``, or ``preserved``.

    Fields are compared with nulls as values. Stale rows whose path is among ``failed_paths`` (files that could not be read this time) are preserved.
    Keys must be unique on each side.
    """
    left = candidates.select(key, F.struct(*fields).alias("_new"))
    right = snapshot.select(key, F.struct(*fields).alias("_old"), F.col(path_col).alias("_path"))
    both = left.join(right, key, "full_outer")
    stale = F.lit("stale")
    if failed_paths is not None:
        marked = failed_paths.select(F.col(path_col).alias("_path")).distinct().withColumn("_failed", F.lit(True))
        both = both.join(marked, "_path", "left")
        stale = F.when(F.col("_failed"), "preserved").otherwise("stale")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), stale).when(F.col("_new").eqNullSafe(F.col("_old")), "same").otherwise("updated")
    return both.select(key, change.alias("change"))


def counters(changes: DataFrame) -> DataFrame:
    """``(change, n)``."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


class Collection:
    """Rows with unique keys under one root, in buckets by a hash of the key.

    A commit writes all buckets, an upsert only those that its keys fall in; a version is a small list of the buckets' folders that is put in place last, so
    that a reader or a failed writer never sees half a version. Folders that neither of the last two versions uses are deleted.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", buckets: int = 16) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _versions(self) -> list[int]:
        names = [n.rsplit("/", 1)[-1] for n in children(self.spark, f"{self.root}/versions")]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The number of the last complete version; 0 when there is none."""
        return max(self._versions(), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        lines = read_small(self.spark, f"{self.root}/versions/{version}").splitlines()
        return {int(k): folder for k, folder in (line.split(" ", 1) for line in lines)}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame:
        version = self.version()
        if not version:
            raise FileNotFoundError(f"no collection at {self.root}; commit one first")
        return self._rows(list(self._folders(version).values()) or ["empty"])

    def count(self) -> int:
        return self.read().count() if self.version() else 0

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kept: dict[int, str]) -> int:
        """The next version: ``kept`` folders and those of ``rows``."""
        version = self.version() + 1
        data = f"{self.root}/data/{version}"
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
        written = {int(f.rsplit("=", 1)[1]): f"data/{version}/{f.rsplit('/', 1)[-1]}" for f in children(self.spark, data) if "_bucket=" in f}
        folders = {**kept, **written}
        if not folders:  # the schema of an empty collection
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/empty")
        write_small(self.spark, f"{self.root}/versions/{version}", "\n".join(f"{k} {f}" for k, f in sorted(folders.items())))
        self._clean()
        return version

    def _clean(self) -> None:
        versions = self._versions()
        used = {f for v in versions[-self.KEPT :] for f in self._folders(v).values()}
        for v in versions[: -self.KEPT]:
            for folder in set(self._folders(v).values()) - used:
                remove(self.spark, f"{self.root}/{folder}")
            remove(self.spark, f"{self.root}/versions/{v}")

    def commit(self, rows: DataFrame) -> int:
        """Write ``rows`` as the next version, which may read the one before."""
        return self._write(rows, {})

    def upsert(self, rows: DataFrame, newest: str | None = None) -> int:
        """Add rows, and replace those of the same key unless they are newer by ``newest``; only the buckets of the given keys are rewritten."""
        plain = [c for c, t in rows.dtypes if not t.startswith("map")]
        order = [*([F.desc_nulls_last(newest)] if newest else []), F.desc("_given"), F.xxhash64(*plain)]
        given = rows.withColumn("_given", F.lit(1))
        version = self.version()
        if not version:
            return self._write(latest(given, self.key, *order).drop("_given"), {})
        touched = {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # at most as many numbers as buckets
        folders = self._folders(version)
        old = [f for k, f in folders.items() if k in touched]
        if old:
            given = self._rows(old).withColumn("_given", F.lit(0)).unionByName(given, allowMissingColumns=True)
        return self._write(latest(given, self.key, *order).drop("_given"), {k: f for k, f in folders.items() if k not in touched})

    def existing_ids(self, keys: DataFrame) -> DataFrame:
        """Those of the given keys that the collection has."""
        return keys.select(self.key).distinct().join(self.read().select(self.key), self.key, "left_semi")

    def snapshot(self, *fields: str) -> DataFrame:
        """The keys with some fields only; no text or vector is read that isn't among them."""
        return self.read().select(self.key, *fields)

    def query(self, vector: list[float], k: int, condition: Column | None = None, vector_col: str = "embedding") -> DataFrame:
        """The ``k`` nearest rows that meet the condition."""
        return dense_topk(self.read(), vector, k, self.key, vector_col, condition)

    def refresh(self, candidates: DataFrame, fields: list[str], files_seen: int, failed_paths: DataFrame | None = None, path_col: str = "file_path") -> dict[str, int]:
        """Bring the collection to ``candidates``: new rows added, changed ones replaced, stale ones dropped, rows of failed files kept; returns the counts."""
        if not self.version():
            self.commit(candidates)
            return {"new": self.count(), "updated": 0, "same": 0, "stale": 0, "preserved": 0}
        old = self.read()
        if files_seen == 0 and old.limit(1).count():
            raise NothingFoundError("0 files found in all sources, but the collection has rows; nothing was changed")
        changes = cut_lineage(diff(candidates, old, self.key, fields, failed_paths, path_col))  # read for the counts and for the rows that stay
        counts = {"new": 0, "updated": 0, "same": 0, "stale": 0, "preserved": 0} | {r["change"]: r["n"] for r in counters(changes).collect()}
        kept = old.join(changes.where("change = 'preserved'").select(self.key), self.key, "left_semi")
        self.commit(candidates.unionByName(kept, allowMissingColumns=True))
        return counts

    def delete(self, keys: DataFrame) -> int:
        """Drop rows by key; only the buckets of the given keys are rewritten. The number of the new version."""
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        folders = self._folders(self.version())
        old = [f for k, f in folders.items() if k in touched]
        kept = {k: f for k, f in folders.items() if k not in touched}
        if not old:
            return self.version()
        return self._write(self._rows(old).join(keys.select(self.key), self.key, "left_anti"), kept)

    def update_metadata(self, changed: DataFrame) -> int:
        """Replace the given fields of the given keys, leaving all other fields and rows; the number of the new version."""
        fields = [c for c in changed.columns if c != self.key]
        new = changed.select(self.key, F.struct(*fields).alias("_new"))
        both = self.read().join(new, self.key, "left")
        return self.commit(both.select(*[(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c) for c in both.columns if c != "_new"]))

    @staticmethod
    def names(spark: SparkSession, parent: str) -> list[str]:
        """The collections below a folder that have a complete version."""
        found = [n.rsplit("/", 1)[-1] for n in children(spark, parent)]
        return sorted(n for n in found if Collection(spark, f"{parent.rstrip('/')}/{n}").version())

    def drop(self, force: bool = False, active: bool = False) -> int:
        """Delete the collection and return how many rows it had; the active one only with ``force``."""
        if active and not force:
            raise ValueError("this is the active collection; pass force to drop it")
        n = self.count()
        remove(self.spark, self.root)
        return n


def freshness(existing: Column, made: Column, newest_input: Column) -> Column:
    """``MISSING``, ``STALE`` or ``OK`` of an output by its own time and that of its newest input."""
    return F.when(~existing | made.isNull(), "MISSING").when(newest_input > made, "STALE").otherwise("OK")
