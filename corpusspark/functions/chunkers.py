"""Sections and paragraph packing as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chunk_windows, col, collapse_blank_lines, let, strip


LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"  #: besides the line feed


def sections(text: Column | str, least_level: int = 1) -> Column:
    """``array<struct<heading, body>>``: the parts of a text between heading lines, those without a body dropped.

    At level 1 every line that starts with ``#`` is a heading; from level 2 on only lines with at least so many ``#`` and a blank. A heading is
    its line without ``#`` at both ends; what precedes the first heading, or has an empty one, is called ``Document``.
    """
    mark = "#" if least_level == 1 else rf"#{{{least_level},}}[^\S\n]"
    lines = F.regexp_replace(col(text), LINE_ENDS, "\n")
    parts = F.split(F.concat(F.lit("\n"), lines), rf"\n(?={mark})")

    def heading_of(part: Column) -> Column:
        return F.coalesce(F.nullif(strip(F.regexp_replace(F.substring_index(part, "\n", 1), r"^#+|#+$", "")), F.lit("")), F.lit("Document"))

    def cut(part: Column, at: Column) -> Column:
        titled = part.rlike(rf"^{mark}")
        body = F.when(titled, F.when(part.contains("\n"), F.regexp_replace(part, r"^[^\n]*\n", "")).otherwise("")).otherwise(part)
        return F.struct(F.when(titled, heading_of(part)).otherwise("Document").alias("heading"), strip(body).alias("body"))

    return F.filter(F.transform(parts, cut), lambda s: s["body"] != "")


def pack_paragraphs(text: Column | str, max_chars: int = 1200, overlap: int = 150) -> Column:
    """Chunks of whole paragraphs up to ``max_chars``; longer paragraphs are packed by sentences, longer sentences cut in windows.

    One fold over the units of a text: a unit joins the open chunk when it is of the same kind (and paragraph) and still fits.
    Null and empty texts have no chunks.
    """

    def unit(kind: str, piece: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("of"), piece.alias("piece"))

    def sentence_units(sentence: Column, at: Column) -> Column:
        return F.when(F.length(sentence) > max_chars, F.transform(chunk_windows(sentence, max_chars, overlap), lambda w: unit("window", w, at))).otherwise(F.array(unit("sentence", sentence, at)))

    def units(paragraph: Column, at: Column) -> Column:
        sentences = F.filter(F.transform(F.split(paragraph, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
        return F.when(F.length(paragraph) > max_chars, F.flatten(F.transform(sentences, lambda s: sentence_units(s, at)))).otherwise(F.array(unit("paragraph", paragraph, F.lit(-1))))

    start = F.struct(F.lit("").alias("kind"), F.lit(-1).alias("of"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        between = F.when(x["kind"] == "paragraph", "\n\n").otherwise(" ")
        joins = (acc["kind"] == x["kind"]) & (acc["of"] == x["of"]) & (x["kind"] != "window") & (F.length(acc["open"]) + F.length(between) + F.length(x["piece"]) <= max_chars)
        closed = F.when(joins | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(x["kind"].alias("kind"), x["of"].alias("of"), F.when(joins, F.concat(acc["open"], between, x["piece"])).otherwise(x["piece"]).alias("open"), closed.alias("done"))

    def packed(body: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), strip), lambda p: p != "")
        folded = F.aggregate(F.flatten(F.transform(paragraphs, units)), start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
        return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.length(body) <= max_chars, F.array(body)).otherwise(folded)

    return let(collapse_blank_lines(text), packed)
