"""Retrieval quality: hits, recall and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_hit(expected: Column, title: Column, path: Column) -> Column:
    """Whether an expected string occurs in the title or the path, any case."""
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(path, F.lit(""))))
    return F.exists(expected, lambda e: hay.contains(F.lower(e)))


def hit_ranks(ranked: DataFrame, golden: DataFrame, title: str = "title", path: str = "file_path", depth: int = 10) -> DataFrame:
    """``(query_id, query_kind, hit_rank)`` for each golden query; null without a hit. The golden set is a fixed, small table."""
    hits = ranked.where(F.col("rank") <= depth).join(F.broadcast(golden.select("query_id", "expected")), "query_id").where(is_hit(F.col("expected"), F.col(title), F.col(path)))
    first = hits.groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return golden.select("query_id", "query_kind").join(first, "query_id", "left")


def metrics(ranks: DataFrame, by: list[str], rank: str = "hit_rank") -> DataFrame:
    """Number, recall at 5 and 10 and mean reciprocal rank of each group; no rows, no groups."""
    r = F.col(rank)
    return ranks.groupBy(*by).agg(*_measures(r))


def metrics_with_total(ranks: DataFrame, kind: str, rank: str = "hit_rank") -> DataFrame:
    """The same for each kind, and for all of them together as ``overall``, in one pass."""
    grouped = ranks.select(F.col(kind).alias("_kind"), F.col(rank).alias("_rank")).rollup("_kind").agg(*_measures(F.col("_rank")), F.grouping("_kind").alias("_all"))
    return grouped.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("_kind")).alias(kind), "n", "recall_at_5", "recall_at_10", "mrr")


def _measures(r: Column) -> list[Column]:
    def share(k: int) -> Column:
        return F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 4)

    return [F.count("*").alias("n"), share(5).alias("recall_at_5"), share(10).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 4).alias("mrr")]
