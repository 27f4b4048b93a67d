"""Readers for files: Markdown notes, extracted JSON texts, golden queries, and file types by content."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunkers import pack_paragraphs, sections
from ..functions.text import chunk_windows, normal_tags, stable_id, strip, strip_navigation_tail, strip_template_variables, strip_wikilinks, subdomain, widened_date, wikilinks

GOLDEN = "query string, expected array<string>, kind string"
EXTRACTION = "filename string, file_type string, extracted_at string, total_pages long, total_documents long, text_layer_chars long, ocr_page_count long, ocr_chars long, total_chars long, ocr_used boolean, ocr_pages array<int>, text string"
DOCUMENT = "file_name string, title string, resource_type string, source_group string, primary_topic string, tags array<string>, confidence string, text string"
META = "title string, domain string, subdomain string, type string, confidence string, status string, source string, tags array<string>"


def excluded(relative: Column | str, directories: list[str], files: list[str], patterns: list[str]) -> Column:
    """Whether a path lies in one of the directories, has one of the names, or a name that matches one of the shell patterns."""
    path = F.col(relative) if isinstance(relative, str) else relative
    name = F.element_at(F.split(path, "/"), -1)

    tests = [(path == d) | path.startswith(d + "/") for d in directories] + [name.rlike(fnmatch.translate(p)) for p in patterns]
    if files:
        tests.append(name.isin(*files))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text)`` of all Markdown files below ``root``, the path relative to it."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    relative = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return raw.select(relative.alias("path"), F.col("value").alias("text"))


_FRONT = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])


def _unquoted(value: str) -> str:
    return value.strip().strip("\"'")


def _fields(block: list[str]) -> tuple[dict[str, list[str]], str | None]:
    """The fields of a front matter's lines, and the first line that is no part of one."""
    meta: dict[str, list[str]] = {}
    key, listed, error = None, False, None
    for line in block:
        bare = line.strip()
        name, colon, rest = line.partition(":")
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") or bare == "-":
            if key is None:
                error = error or bare
            elif _unquoted(bare[1:]):
                meta[key] = [*(meta.get(key, []) if listed else []), _unquoted(bare[1:])]
                listed = True
        elif colon and name.strip():
            key, listed = name.strip(), False
            if _unquoted(rest):
                meta[key] = [_unquoted(rest)]
        else:
            error = error or bare
    return meta, error


@F.pandas_udf(_FRONT)
def front_matter(text: pd.Series) -> pd.DataFrame:
    """The front matter of notes as a map of lists, the body, and the first line that can't be read; ``key: value`` lines and lists of ``- item`` lines are known.

    Scalars are lists of one item; an inline list stays one string; a key without a value is left out. Python, as the lines depend on those before.
    """
    rows = []
    for t in text:
        lines = t.split("\n") if t else []
        end = next((k for k, line in enumerate(lines[1:], 1) if line.startswith("---")), None) if lines and lines[0] == "---" else None
        meta, error = _fields(lines[1:end]) if end else ({}, None)
        rows.append((meta, "\n".join(lines[end + 1 :]).strip() if end else t, error))
    return pd.DataFrame(rows, columns=["meta", "body", "error"])


def unreadable_notes(rows: DataFrame) -> DataFrame:
    """``(path, error)`` of the notes ``(path, text)`` whose front matter can't be read; their chunks in a collection are to be preserved."""
    return rows.select("path", front_matter(strip_template_variables("text"))["error"].alias("error")).where("error is not null")


def note_chunks(rows: DataFrame, max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of Markdown notes ``(path, text)`` with ids and metadata; the links of the whole note, the text without its navigation.

    Notes whose front matter can't be read have none; ``unreadable_notes`` lists them.
    """
    one = lambda k: F.element_at(F.col("f.meta")[k], 1)
    parsed = rows.withColumn("f", front_matter(strip_template_variables("text"))).where("f.error is null")
    tags = F.when(F.size(F.col("f.meta")["tags"]) > 1, F.transform(F.col("f.meta")["tags"], lambda t: F.regexp_replace(F.lower(F.trim(t)), "^#+", ""))).otherwise(normal_tags(one("tags")))
    meta = parsed.select(
        "path", *[F.coalesce(one(k), F.lit("")).alias(k) for k in ("title", "domain", "type", "status", "source", "confidence")],
        subdomain("path", F.coalesce(one("subdomain"), F.lit(""))).alias("subdomain"), tags.alias("tags"), wikilinks("f.body").alias("wikilinks"),
        sections(strip_wikilinks(strip_navigation_tail("f.body"))).alias("parts"),
    )
    parts = meta.select(*[c for c in meta.columns if c != "parts"], F.posexplode("parts").alias("section_no", "s"))
    pieces = parts.select(*[c for c in parts.columns if c != "s"], F.col("s.heading").alias("heading"), F.posexplode(chunk_windows("s.body", max_chars, overlap)).alias("chunk_no", "document"))
    return pieces.where("document <> ''").withColumn("chunk_id", stable_id("path", "section_no", "chunk_no", "document"))


def extracted_documents(spark: SparkSession, path: str) -> DataFrame:
    """Extracted JSON texts, one file each; files that can't be read have null fields and their text in ``_corrupt_record``."""
    return spark.read.schema(DOCUMENT + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True)


def document_chunks(rows: DataFrame, least_chars: int = 40, max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of extracted texts: by headings of level two and more where there are any, packed by paragraphs."""
    kept = rows.where(F.length(strip("text")) >= least_chars)
    parts = kept.select(*[c for c in kept.columns if c != "text"], F.posexplode(sections("text", 2)).alias("section_no", "s"))
    pieces = parts.select(*[c for c in parts.columns if c != "s"], F.col("s.heading").alias("heading"), F.posexplode(pack_paragraphs("s.body", max_chars, overlap)).alias("chunk_no", "document"))
    return pieces.withColumn("chunk_id", stable_id("file_name", "section_no", "chunk_no", "document"))


def page_blocks(pages: DataFrame, least_chars: int = 40, max_chars: int = 1200, file_col: str = "path", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """``(path, first_page, last_page, text)``: pages of a file gathered until they reach ``max_chars``; short pages are skipped.

    A fold over the pages of one file, which one task holds in page order; other files are other groups.
    """
    schema = f"{file_col} string, first_page int, last_page int, text string"

    def fold(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(page_col)
        rows, open_pages, texts = [], [], []
        for page, text in zip(frame[page_col], frame[text_col]):
            open_pages.append(page)
            texts.append(text)
            if sum(map(len, texts)) >= max_chars:
                rows.append((key[0], open_pages[0], open_pages[-1], "\n\n".join(texts)))
                open_pages, texts = [], []
        if texts:
            rows.append((key[0], open_pages[0], open_pages[-1], "\n\n".join(texts)))
        yield pd.DataFrame(rows, columns=[file_col, "first_page", "last_page", "text"])

    return pages.where(F.length(strip(text_col)) >= least_chars).select(file_col, page_col, text_col).groupBy(file_col).applyInPandas(fold, schema)


def page_chunks(pages: DataFrame, max_chars: int = 1200, overlap: int = 150, file_col: str = "path") -> DataFrame:
    """Chunks of page blocks with ids; the heading names the pages, ``p.3`` or ``p.3-5``."""
    blocks = page_blocks(pages, max_chars=max_chars, file_col=file_col)
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    heading = F.concat(F.lit("p."), first, F.when(first == last, "").otherwise(F.concat(F.lit("-"), last)))
    pieces = blocks.select(file_col, "first_page", heading.alias("heading"), F.posexplode(chunk_windows("text", max_chars, overlap)).alias("chunk_no", "document"))
    return pieces.where("document <> ''").withColumn("chunk_id", stable_id(file_col, "heading", "chunk_no", "document"))


def listed_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """``(path, bytes, modified)`` of the files below a folder; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def extraction_manifest(listing: DataFrame, extracted: DataFrame, known_types: tuple[str, ...] = ("pdf", "epub", "txt", "md"), key: str = "file_name") -> DataFrame:
    """``(file, status)``: what an extraction run has to do and has done with each listed file.

    ``skipped`` for types that nothing reads, ``cached`` for a usable extraction, ``error`` for one without usable text, ``missing`` where there is none. ``listing`` has
    ``file_type``; ``extracted`` has ``ocr_used``, ``ocr_chars`` and ``total_chars``, of which a file may have several.
    """
    usable = (F.coalesce("total_chars", F.lit(0)) > 0) & ~(F.coalesce("ocr_used", F.lit(False)) & (F.coalesce("ocr_chars", F.lit(0)) == 0))
    each = extracted.groupBy(key).agg(F.bool_or(usable).alias("_usable"))
    known = F.coalesce(F.lower("file_type").isin(*known_types), F.lit(False))
    status = F.when(~known, "skipped").when(F.col("_usable").isNull(), "missing").when(F.col("_usable"), "cached").otherwise("error")
    return listing.select(key, "file_type").distinct().join(each, key, "left").select(key, "file_type", status.alias("status"))


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of golden queries; blank lines and those that start with ``#`` are skipped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).where(~F.trim("value").startswith("#"))
    return lines.select(F.from_json("value", GOLDEN).alias("q")).select("q.*")


def file_type(name: Column | str, head: Column | str) -> Column:
    """The type of a file by its suffix, else by its first bytes."""
    low, content = F.lower(F.col(name) if isinstance(name, str) else name), F.col(head) if isinstance(head, str) else head
    start = F.hex(F.substring(content, 1, 4))
    return F.when(low.rlike(r"\.(md|markdown)$"), "md").when(low.endswith(".txt"), "txt").when(start == "25504446", "pdf").when((start == "504B0304") & F.hex(F.substring(content, 1, 100)).contains(F.hex(F.lit("application/epub+zip"))), "epub").otherwise("unknown")


def usable_extraction(text: Column, ocr_used: Column, ocr_chars: Column) -> Column:
    """Whether a cached extraction can stay: it has text, and isn't a scan that gave nothing. Shortness is no reason to redo it."""
    return (F.coalesce(strip(text), F.lit("")) != "") & ~(F.coalesce(ocr_used, F.lit(False)) & (F.coalesce(ocr_chars, F.lit(0)) == 0))


def not_covered(files: DataFrame, covered: DataFrame, key: str = "file_name") -> DataFrame:
    """The files that no extracted text covers; joined on the listing, before any content is read."""
    return files.join(covered.select(key), key, "left_anti")


def all_sources(*parts: DataFrame) -> DataFrame:
    """The chunks of all sources; fields that a source lacks are null, so that a filter on them drops its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def catalog_notes(rows: DataFrame, least_words: int = 10) -> DataFrame:
    """Notes ``(path, text)`` as catalog records: no topic maps, no stubs; the file's stem stands for a missing title."""
    one = lambda k: F.element_at(F.col("f.meta")[k], 1)
    name = F.element_at(F.split("path", "/"), -1)
    parsed = rows.where(~name.contains("MOC")).withColumn("f", front_matter("text")).where(F.coalesce(one("type"), F.lit("")) != "MOC")
    long = parsed.where(F.size(F.split(strip("f.body"), r"\s+")) >= least_words)
    return long.select(
        stable_id("path").alias("id"), F.col("path").alias("file_name"), F.coalesce(one("title"), F.regexp_replace(name, r"\.md$", "")).alias("title"), F.coalesce(one("domain"), F.lit("")).alias("primary_topic"),
        widened_date(F.coalesce(one("updated"), one("created"))).alias("classified_at"), F.col("f.body").alias("text"),
    )


def epub_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, part_no, html, error)``: the content files of EPUB archives in reading order; a broken archive is a row with its error."""
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import posixpath
        import zipfile

        for frame in frames:
            rows: list[tuple] = []
            for file, content in zip(frame["path"], frame["content"]):
                try:
                    book = zipfile.ZipFile(io.BytesIO(content))
                    files = set(book.namelist())
                    text = lambda n, book=book: book.read(n).decode("utf-8", "replace")
                    attributes = lambda tag: dict(re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', tag))
                    package = next((attributes(t).get("full-path") for t in re.findall(r"<rootfile\b[^>]*>", text("META-INF/container.xml"))), None) if "META-INF/container.xml" in files else None
                    order: list[str] = []
                    if package in files:
                        opf = text(package)
                        items = {a.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), a.get("href", ""))) for a in map(attributes, re.findall(r"<item\b[^>]*>", opf))}
                        order = [items[r] for r in (attributes(t).get("idref") for t in re.findall(r"<itemref\b[^>]*>", opf)) if items.get(r) in files]
                    for no, name in enumerate(order or sorted(n for n in files if re.search(r"\.x?html?$", n, re.I))):
                        rows.append((file, no, text(name), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((file, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "part_no", "html", "error"]).astype({"part_no": "Int32"})

    return binary.mapInPandas(read, "path string, part_no int, html string, error string")
