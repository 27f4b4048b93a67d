"""Problem 6: fill containers of fixed capacity with whole documents.

Method: minimum bin slack. Only the histogram of lengths matters for the plan, and it has at most ``capacity`` rows whatever the
size of the corpus. For the largest length left, a bitset subset-sum dynamic program picks the multiset of other lengths that
comes closest to the capacity; the pattern is repeated as often as the counts allow. Spark then numbers the documents of each
length and looks up the container of each number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Rows of one length and salt that are numbered in one task, on average.
GROUP_ROWS = 2_000_000
LEAST_SALTS = 64


def best_fill(gap: int, left: dict[int, int]) -> dict[int, int]:
    """The multiset of the lengths in ``left`` (length to count) whose sum is closest to ``gap`` from below, larger lengths first."""
    reach, layers = 1, []
    mask = (1 << (gap + 1)) - 1
    for size in sorted((s for s in left if s <= gap), reverse=True):
        count, step = min(left[size], gap // size), 1
        before = reach
        while count > 0:
            take = min(step, count)
            reach |= (reach << (size * take)) & mask
            count -= take
            step *= 2
        layers.append((size, before))
        if reach >> gap & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, before in reversed(layers):
        used = 0
        while not before >> at & 1:
            at -= size
            used += 1
        if used:
            chosen[size] = used
    return chosen


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(length to count, repeats)`` of each container pattern; every length of the histogram is used exactly as often as it occurs."""
    left, out = {s: c for s, c in histogram.items() if c > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = best_fill(capacity - seed, {s: c for s, c in left.items() if c})
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        repeats = min(left[s] // c for s, c in pattern.items())
        for s, c in pattern.items():
            left[s] -= c * repeats
            if not left[s]:
                del left[s]
        out.append((pattern, repeats))
    return out


def pack(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", text_col: str | None = "text", capacity: int = 2048) -> DataFrame:
    """``(id, part_no, size, container)``: each row of ``df`` in one container, rows over the capacity in several.

    A row over the capacity is split: its full parts fill containers of their own, its rest is packed like any item. A null or
    negative size is counted from the text (matches of ``\\w+|[^\\w\\s]+``), and is 0 without a text. Rows of size 0 need no room
    and share container 0. Repeated rows are items of their own. An empty table gives no rows. Containers are numbered from 0 without gaps.
    """
    spark = df.sparkSession
    size = F.col(size_col).cast("long")
    given = df.where(size >= 0).select(F.col(id_col).alias("_id"), size.alias("_n"))
    # texts are read only where the size is missing, which the scan's filter decides
    other = df.where(F.col(size_col).isNull() | (size < 0))
    counted = F.lit(0).cast("long") if text_col is None else F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"(?U)\w+|[^\w\s]+")).cast("long"), F.lit(0).cast("long"))
    rows = given.unionByName(other.select(F.col(id_col).alias("_id"), counted.alias("_n")))
    full = (F.col("_n") / capacity).cast("long")
    rest = F.col("_n") % capacity
    parts = F.concat(
        F.when(full > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(full, F.lit(1))), lambda k: F.struct(k.cast("int").alias("part_no"), F.lit(capacity).cast("long").alias("size")))).otherwise(F.array()),
        F.when((rest > 0) | (F.col("_n") == 0), F.array(F.struct((full + 1).cast("int").alias("part_no"), rest.cast("long").alias("size")))).otherwise(F.array()),
    )
    salts = max(LEAST_SALTS, df.count() // GROUP_ROWS)  # a count from the Parquet footers
    items = rows.select("_id", F.inline(parts)).withColumn("_salt", F.pmod(F.xxhash64("_id", "part_no"), F.lit(salts)).cast("int"))

    # the histogram has at most capacity + 1 rows, however large the corpus is; where each salted group's numbers begin stays in Spark
    counts = cut_lineage(items.groupBy("size", "_salt").agg(F.count("*").alias("_rows")))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("_rows").alias("n")).collect()}
    patterns = plan_patterns({int(s): int(c) for s, c in histogram.items() if s > 0}, capacity)
    before = F.sum("_rows").over(Window.partitionBy("size").orderBy("_salt")) - F.col("_rows")
    first = counts.select("size", "_salt", before.alias("_first"))

    # of each length, the number from which on its items go to a pattern, with the pattern's first container and items a container
    used: dict[int, int] = {}
    segments, container = [], 0
    for pattern, repeats in patterns:
        for s, c in pattern.items():
            segments.append((s, used.get(s, 0), container, c))
            used[s] = used.get(s, 0) + c * repeats
        container += repeats
    segments.append((0, 0, 0, 0))
    table = np.array(sorted(segments), dtype=np.int64)
    shared = spark.sparkContext.broadcast(table)  # as many rows as the patterns have lengths, a few thousand

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        width = np.int64(1) << 48
        starts = table[:, 0] * width + table[:, 1]
        for size, rank in batches:
            s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
            seg = table[np.searchsorted(starts, s * width + r, side="right") - 1]
            yield pd.Series(seg[:, 2] + (r - seg[:, 1]) // np.maximum(seg[:, 3], 1) * (seg[:, 3] > 0))

    number = F.row_number().over(Window.partitionBy("size", "_salt").orderBy("_id", "part_no"))
    numbered = items.join(first, ["size", "_salt"]).withColumn("_rank", F.col("_first") + number - 1)
    return numbered.select(F.col("_id").alias(id_col), "part_no", "size", place("size", "_rank").alias("container"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(containers, items, tokens, least_possible, full_share)`` of an assignment, one row."""
    each = packed.groupBy("container").agg(F.sum("size").alias("load"), F.count("*").alias("items"))
    tokens = F.sum("load")
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        tokens.alias("tokens"),
        F.ceil(tokens / capacity).alias("least_possible"),
        F.max("load").alias("fullest"),
        F.round(F.avg((F.col("load") == capacity).cast("double")), 4).alias("full_share"),
    )
