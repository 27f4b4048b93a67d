"""Problem 7: passages of held-out test items inside a training corpus.

Method: the n-grams of the test passages form a hash set that is broadcast; each task slides a window over its documents' words,
verifies every hit word by word (by the words' 64-bit hashes) and merges hits to spans, which can be cut out. The set may be broadcast
because its size is checked; beyond ``broadcast_words`` words of test material a bit table of bounded size sorts out nearly all windows
in the scan, and what passes is joined by hash and verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import WordHasher, concatenated, sliced, windows

_WORD = re.compile(r"[^\W_]+")
TABLE_BITS = 28  #: of the table of test hashes beyond the broadcast: 32 MB


def words_of(text: str) -> list[str]:
    """The lower-cased runs of Unicode letters and digits."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return _WORD.findall(lowered)
    return [w.lower() for w in _WORD.findall(text)]  # where lower case adds marks that would end a run


class _TestSet:
    """Window hashes of the test passages in order, and where each window stands in the passages' word hashes: 24 bytes a window."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        hasher = WordHasher()
        self.n = n
        words, hashes, at, owner = [], [], [], []
        place = 0
        for item, passage in items:
            own = hasher(words_of(passage))
            found = windows(own, n)
            words.append(own)
            hashes.append(found)
            at.append(np.arange(place, place + len(found), dtype=np.int64))
            owner.append(np.full(len(found), item, np.int64))
            place += len(own)
        joined = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.at = np.concatenate([np.empty(0, np.int64), *at])[order]
        self.items = np.concatenate([np.empty(0, np.int64), *owner])[order]
        self.words = np.concatenate([np.empty(0, np.uint64), *words])

    def hits(self, hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, item)`` of the windows of a text whose words, compared hash by hash, are those of a test window."""
        if not len(self.hashes) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        k = np.flatnonzero(self.hashes[low] == hashes)
        low, high = low[k], np.searchsorted(self.hashes, hashes[k], side="right")
        count = high - low
        window = np.repeat(k, count)
        entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = np.ones(len(window), bool)
        for j in range(self.n):
            same &= words[window + j] == self.words[self.at[entry] + j]
        return window[same], self.items[entry[same]]


def _spans(hits: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """``(item, first word, last word + 1)`` of the runs of overlapping hits of one item."""
    out: list[tuple[int, int, int]] = []
    for item, at in sorted(set(hits)):
        if out and out[-1][0] == item and at <= out[-1][2]:
            out[-1] = (item, out[-1][1], at + n)
        else:
            out.append((item, at, at + n))
    return out


def leaked_spans(
    docs: DataFrame, items: DataFrame, n: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", broadcast_words: int = 2_000_000
) -> DataFrame:
    """``(id, item, start, end, n_words)``: the stretches of a text, in code points, that repeat ``n`` or more words of a passage.

    Null texts and passages have none, items without an id are left out; passages of fewer than ``n`` words can't be found; repeated rows give the same spans once.
    """
    tests = items.select(F.col(item_col).alias("_item"), F.col(passage_col).alias("_passage")).where("_passage is not null and _item is not null").distinct()
    size = tests.agg(F.sum(F.length("_passage")).alias("chars")).first()["chars"] or 0
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text")).where("_text is not null")
    if size > 6 * broadcast_words:
        return _joined(source, tests, n, id_col, item_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_TestSet([(r["_item"], r["_passage"]) for r in tests.collect()], n))
    schema = docs.select(F.col(id_col)).schema
    schema.add(item_col, "long").add("start", "long").add("end", "long").add("n_words", "integer")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = shared.value, WordHasher()
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            words, offsets = concatenated(map(words_of, texts))
            own = hasher(words)
            at, item = known.hits(windows(own, n), own)
            owner = np.searchsorted(offsets, at, side="right") - 1
            inside = at + n <= offsets[owner + 1]
            hits: dict[int, list[tuple[int, int]]] = {}
            for k, doc, which in zip(at[inside].tolist(), owner[inside].tolist(), item[inside].tolist()):
                hits.setdefault(doc, []).append((which, k - int(offsets[doc])))
            rows: list[tuple] = []
            for doc, found in hits.items():
                marks = [m.span() for m in _WORD.finditer(texts[doc])]
                rows += [(doc, item, marks[a][0], marks[b - 1][1], b - a) for item, a, b in _spans(found, n)]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1))], schema.names)

    return source.mapInArrow(scan, schema).distinct()


def _joined(source: DataFrame, tests: DataFrame, n: int, id_col: str, item_col: str) -> DataFrame:
    """The same spans by a shuffled join of window hashes, for test material that is too large to broadcast; windows that no test hash can equal stay in the scan."""
    spark = source.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in sliced(batches):
            found = [windows(hasher(words_of(t)), n) >> np.uint64(64 - TABLE_BITS) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.uint64), *found])).astype(np.int64))], ["at"])

    # the table has 2 ** TABLE_BITS bits whatever the test material's size: blocks of it are set in tasks and put together here
    block = 1 << (TABLE_BITS - 8)

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(block, bool)
        bits[frame["at"].to_numpy() % block] = True
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    places = tests.mapInArrow(hashed, "at long").distinct().withColumn("block", (F.col("at") / block).cast("int"))
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for row in places.groupBy("block").applyInPandas(mark, "block int, bits binary").toLocalIterator():
        table[row["block"] * (block >> 3) : (row["block"] + 1) * (block >> 3)] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def grams(batches: Iterator[pa.RecordBatch], filtered: bool) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            for row, text in enumerate(texts):
                marks = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                words = [text[a:b].lower() for a, b in marks]
                found = windows(hasher(words), n)
                k = np.arange(len(found))
                if filtered and len(found):
                    at = (found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    k = np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                found, k = found[k].view(np.int64), k.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * len(k), pa.int32())), pa.array(found), pa.array(k, pa.int32()), pa.array([" ".join(words[i : i + n]) for i in k], pa.string()),
                     pa.array([marks[i][0] for i in k], pa.int64()), pa.array([marks[i + n - 1][1] for i in k], pa.int64())],
                    ["_key", "_hash", "_at", "_words", "_start", "_end"],
                )

    def schema(df: DataFrame):
        kind = df.schema[0].dataType.simpleString()
        return f"_key {kind}, _hash long, _at int, _words string, _start long, _end long"

    left = source.mapInArrow(lambda b: grams(b, True), schema(source)).withColumnRenamed("_key", id_col)
    right = tests.mapInArrow(lambda b: grams(b, False), schema(tests)).select(F.col("_key").alias(item_col), "_hash", F.col("_words").alias("_wanted")).distinct()
    hits = left.join(right, "_hash").where("_words = _wanted").select(id_col, item_col, "_at", "_start", "_end").distinct()
    by = [id_col, item_col]
    order = Window.partitionBy(*by).orderBy("_at")
    fresh = F.coalesce((F.col("_at") > F.lag("_at").over(order) + n).cast("int"), F.lit(1))
    return (
        hits.withColumn("_run", F.sum(fresh).over(order))
        .groupBy(*by, "_run")
        .agg(F.min("_start").alias("start"), F.max("_end").alias("end"), (F.max("_at") - F.min("_at") + n).cast("int").alias("n_words"))
        .drop("_run")
    )


def leaks(spans: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """``(id, item)`` of all spans."""
    return spans.select(id_col, item_col).distinct()


def cleaned(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_share: float = 0.5) -> DataFrame:
    """The affected documents as ``(id, action, removed, text)``: spans cut out, or null text (``drop``) when they cover ``drop_share`` or more.

    Only documents with spans are returned: all others stay as they are, and the training set is ``docs`` anti-joined with these, plus these.
    """
    whole = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    cuts = spans.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cuts"))  # bounded by the text's length
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        return F.struct(
            F.concat(acc["kept"], F.when(x["start"] > acc["at"], F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).otherwise(F.lit(""))).alias("kept"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        )

    kept = F.aggregate("_cuts", start, step, lambda acc: F.concat(acc["kept"], F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), F.length("_text"))))
    out = whole.join(cuts, id_col).select(id_col, F.length("_text").alias("_size"), kept.alias("_kept"))
    removed = F.col("_size") - F.length("_kept")
    drop = removed >= drop_share * F.col("_size")
    return out.select(id_col, F.when(drop, "drop").otherwise("cut").alias("action"), removed.alias("removed"), F.when(~drop, F.col("_kept")).alias("text")).distinct()
