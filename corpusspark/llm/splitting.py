"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

Method: agglomerative merging. The atoms of a text are its sentences (words, where a sentence is longer than a piece; slices,
where a word is). Adjacent atoms wait in a heap, the weakest boundary first, and are merged while their size plus the overlap
fits; what remains are cuts at the strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cut's strength: inside a word, at a word's end, a sentence's end, a paragraph's end, the end of the text.
KINDS = ("inside", "word", "sentence", "paragraph", "end")
_STRONG = re.compile(r"(?P<p>[ \t\r]*\n[ \t\r]*\n\s*)|[.!?…]+[\"'”’»)\]*_]*(?=\s+[^\sa-zß-ÿ]|\s*\Z)")
_BLANK = re.compile(r"\s+")


def _cuts(text: str, room: int) -> list[tuple[int, int]]:
    """(position, strength) of the boundaries between atoms, the text's end last; no atom is longer than ``room``."""
    found: list[tuple[int, int]] = []
    size = len(text)

    def add(at: int, strength: int) -> None:
        last = found[-1][0] if found else 0
        if at > last:
            found.append((at, strength))
        elif found and at == last:
            found[-1] = (at, max(found[-1][1], strength))

    def fill(start: int, stop: int) -> None:
        """Word ends, and slices of words that are too long, between two far boundaries."""
        for m in _BLANK.finditer(text, start, stop):
            while m.start() - (found[-1][0] if found else 0) > room:
                add((found[-1][0] if found else 0) + room, 0)
            if m.start() > start:
                add(m.start(), 1)
        while stop - (found[-1][0] if found else 0) > room:
            add((found[-1][0] if found else 0) + room, 0)

    for m in _STRONG.finditer(text):
        at, strength = (m.start(), 3) if m["p"] is not None else (m.end(), 2)
        if at - (found[-1][0] if found else 0) > room:
            fill(found[-1][0] if found else 0, at)
        add(at, strength)
    if size - (found[-1][0] if found else 0) > room:
        fill(found[-1][0] if found else 0, size)
    add(size, 4)
    return found


def merged_cuts(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(end, strength) of each piece's end, in order."""
    cuts = _cuts(text, max_chars - overlap)
    n = len(cuts)
    begin = [0, *(at for at, _ in cuts[:-1])]
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n

    def entry(left: int, right: int) -> tuple[int, int, int, int]:
        return cuts[left][1], cuts[right][0] - begin[left], left, right

    def fits(length: int, left: int) -> bool:
        return length + (overlap if begin[left] else 0) <= max_chars

    heap = [entry(i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, length, left, right = heapq.heappop(heap)
        # an entry is stale when one of its sides has been merged since: its size is then no longer the pair's
        if gone[left] or gone[right] or after[left] != right or cuts[right][0] - begin[left] != length or not fits(length, left):
            continue
        gone[left] = True
        begin[right], before[right] = begin[left], before[left]
        if before[right] >= 0:
            after[before[right]] = right
            heapq.heappush(heap, entry(before[right], right))
        if after[right] < n:
            heapq.heappush(heap, entry(right, after[right]))
    return [cuts[i] for i in range(n) if not gone[i]]


def split_oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """``(id, piece_no, n_pieces, start, end, boundary, piece)``: the ordered pieces of every text.

    No piece is longer than ``max_chars`` code points, and each piece but the first starts ``overlap`` code points before the end of
    the one before; together they cover the whole text. A text that fits is one piece, null and empty texts have none.
    Rows are independent, so the plan has no shuffle; repeated rows give repeated pieces; other columns are not read.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    schema = df.select(F.col(id_col)).schema
    schema.add("piece_no", "integer").add("n_pieces", "integer").add("start", "long").add("end", "long").add("boundary", "string").add("piece", "string")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            source: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                ends = merged_cuts(text, max_chars, overlap) if len(text) > max_chars else [(len(text), 4)]
                start = 0
                for no, (end, strength) in enumerate(ends, 1):
                    for column, value in zip(rows, (no, len(ends), start, end, KINDS[strength], text[start:end])):
                        column.append(value)
                    source.append(row)
                    start = end - overlap
            ids = batch.column(0).take(pa.array(source, pa.int32()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rows, kinds))], schema.names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(pieces, schema)


def oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """The ids of the texts that had to be cut."""
    pieces = split_oversized(df, id_col, text_col, max_chars, overlap)
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select(id_col).distinct()
