"""The document catalog: merging metadata with extractions, enrichment, counts, duplicates and reports."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import WordHasher, concatenated, sliced, windows
from ..functions.stemming import stem_word
from ..functions.text import clean_author, clean_title, filled, find_isbn, folded_text, moc_name, parsed_time, safe_stem, split_list, stem
from ..session import cut_lineage, release, remove, scratch
from .retrieval import latest, terms_of, where


def _last(rows: DataFrame, newest: Column, *fields: str) -> DataFrame:
    """The newest row of each file, of equal ones that with the larger fields in their order, so that the choice never depends on the plan."""
    return latest(rows, "file_name", newest.desc_nulls_last(), *[F.desc_nulls_last(c) for c in fields if c in rows.columns])


def last_inventory(inventory: DataFrame) -> DataFrame:
    """The row of each file that was loaded last."""
    return _last(inventory, F.col("loaded_at"), "created_at", "file_key", "title", "author", "isbn", "lang_code", "primary_topic", "tags")


def last_extractions(extractions: DataFrame) -> DataFrame:
    """The extraction of each file with the latest time in any of its notations, the larger one of equal times."""
    return _last(extractions, parsed_time("extracted_at"), "total_chars", "text_layer_chars", "total_pages", "ocr_chars", "ocr_page_count", "total_documents", "ocr_used")


def index_documents(inventory: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row for each file that has both, lists split and numbers parsed, the extraction nested."""
    nested = extractions.select("file_name", F.struct(*[c for c in extractions.columns if c != "file_name"]).alias("extraction"))
    return inventory.join(nested, "file_name").withColumns({"tags": split_list("tags"), "secondary_topics": split_list("secondary_topics")})


def unmatched(inventory: DataFrame, documents: DataFrame, key: str = "file_name") -> DataFrame:
    """``(key, side)``: files of only one side, one row for each."""
    left, right = inventory.select(key).distinct(), documents.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("no text")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("no inventory")))


def enriched(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """Title, author, language and ISBN filled where they are blank (or the title is but the file's stem), with a flag for each.

    The inventory's values come first, an ISBN found in the text after that.
    """
    other = inventory.select("file_name", F.col("title").alias("_title"), F.col("author").alias("_author"), F.col("lang_code").alias("_lang"), F.col("isbn").alias("_isbn"))
    both = documents.join(other, "file_name", "left")
    base = stem("file_name")
    no_title = filled("title").isNull() | (F.lower(F.trim("title")) == F.lower(base))
    title = F.when(no_title, F.coalesce(clean_title("_title", base), F.col("title"))).otherwise(F.col("title"))
    author = F.coalesce(filled("author"), clean_author("_author", "title"))
    isbn = F.coalesce(filled("isbn"), filled("_isbn"), find_isbn("text"))
    lang = F.coalesce(filled("lang"), filled("_lang"))
    named = {"title": title, "author": author, "isbn": isbn, "lang": lang}
    return both.select("file_name", *[v.alias(f"new_{k}") for k, v in named.items()], *[(~v.eqNullSafe(F.col(k))).alias(f"{k}_filled") for k, v in named.items()])


def tag_rows(documents: DataFrame, id_col: str, tags_col: str = "tags") -> DataFrame:
    """``(id, tag)``, each pair once."""
    return documents.select(id_col, F.explode(tags_col).alias("tag")).distinct()


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


#: Counters of the sketch that orders shingles by frequency, and ids that are broadcast (sixteen bytes each); more are joined.
BUCKETS = 1 << 18
FEW_IDS = 200_000
BITS, MORE_BITS = 1024, 8192  #: of a set's bitmap: for all sets, and for those with a candidate
PART = 1000  #: Members of a class that one key of a join holds, about; larger classes have several keys.
_WORD = re.compile("[a-z0-9]+")


def _sets(texts: list[str | None], n: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted set of hashed ``n``-word shingles of each text; empty for null texts and fewer words."""
    words, offsets = concatenated(_WORD.findall((t or "").lower()) for t in texts)
    hashes = windows(hasher(words), n)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield np.unique(hashes[start : max(start, stop - n + 1)])


def _mapped_sets(documents: DataFrame, columns: str, n: int, row: Callable[[np.ndarray], tuple | None], rest: Callable[[], list[tuple]] | None = None) -> DataFrame:
    """``(id, ...)``: what ``row`` makes of each text's set, nothing where that is null; ``rest`` gives further rows, without an id, at a task's end."""
    schema = T.StructType([documents.schema["id"], *T._parse_datatype_string(columns).fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in sliced(batches):
            made = [row(s) for s in _sets(batch.column(1).to_pylist(), n, hasher)]
            kept = [k for k, m in enumerate(made) if m is not None]
            columns = zip(*[made[k] for k in kept]) if kept else [[]] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), *[pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:])]], names=kinds.names)
        if rest is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(None, *r) for r in rest()]), kinds)], names=kinds.names)

    return documents.select("id", "text").mapInArrow(run, schema)


def _bitmap(found: np.ndarray, size: int) -> np.ndarray:
    """A bit for each range of hashes, set where the set has one in it."""
    bits = np.zeros(size, bool)
    bits[found >> np.uint64(64 - size.bit_length() + 1)] = True
    return np.packbits(bits).view(np.int64)


def _possible(pairs: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs (a, b, size, size_b)`` whose bitmaps allow the threshold: each bit that only one set has is a shingle at least that the other lacks."""
    both = pairs.join(bits.withColumnsRenamed({"id": "a", "bits": "bits_a"}), "a").join(bits.withColumnsRenamed({"id": "b", "bits": "bits_b"}), "b")
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda p, q: p + q)
    most = F.least(F.col("size") - lacks("bits_a", "bits_b"), F.col("size_b") - lacks("bits_b", "bits_a"))
    kept = both.withColumn("most", most).where(F.col("most") >= F.lit(threshold) * (F.col("size") + F.col("size_b") - F.col("most")) - 1e-6)
    return cut_lineage(kept.select("a", "b", "size", "size_b"))


def similar_pairs(documents: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Exact pairs by shingle similarity: ``pairs (a, b, jaccard)`` of class representatives and ``members (rep, id)``.

    Texts with the same set are one class. In any order of all shingles, two sets with a Jaccard similarity of ``threshold`` share one of the first
    shingles of each, all but ``ceil(threshold * size) - 1`` of them, so only those are joined; no pair is lost. A sketch of counters puts frequent
    shingles last: its size is fixed, and where shingles share a counter the order is only less good. Bitmaps then tell how many shingles two sets lack of
    each other at least, which drops most chance pairs. Only the texts of the others are read again for their whole sets.
    """
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = documents.sparkSession

    class Counts:  # one for each task, as it is made where it is unpickled
        def __init__(self) -> None:
            self.n = np.zeros(BUCKETS, np.int64)

        def row(self, found: np.ndarray) -> tuple | None:
            if not len(found):
                return None
            np.add.at(self.n, found & np.uint64(BUCKETS - 1), 1)
            return hashlib.sha256(found.tobytes()).digest(), _bitmap(found, BITS), None, None

        def rest(self) -> list[tuple]:
            used = np.flatnonzero(self.n)
            return [(None, None, used, self.n[used])]

    counts = Counts()
    read, read_path = scratch(_mapped_sets(source, "print binary, bits array<long>, bucket array<int>, n array<long>", n, counts.row, counts.rest))
    sketch = np.zeros(BUCKETS, np.int64)
    summed = read.where("bucket is not null").select(F.inline(F.arrays_zip("bucket", "n"))).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row for each counter at most
    sketch[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    prints = read.where("print is not null").select("id", "print")
    members = cut_lineage(prints.distinct().join(prints.groupBy("print").agg(F.min("id").alias("rep")), "print").select("rep", "id"))
    reps = members.where("rep = id").select("id").distinct()
    release(spark)

    shared = spark.sparkContext.broadcast(sketch)

    def first(found: np.ndarray) -> tuple | None:
        if not len(found):
            return None
        order = np.lexsort((found, shared.value[found & np.uint64(BUCKETS - 1)]))
        return len(found), found[order[: len(found) - math.ceil(threshold * len(found) - 1e-6) + 1]].view(np.int64)

    firsts = _mapped_sets(source, "size int, items array<long>", n, first).join(reps, "id", "left_semi").dropDuplicates(["id"])
    # written before they are exploded; the join shuffles the items once for both sides
    prefix = cut_lineage(firsts).select("id", "size", F.explode("items").alias("item"))
    del firsts  # and the files of its shuffle
    release(spark)
    other = prefix.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "item")
    near = F.least("size", "size_b") >= F.lit(threshold) * F.greatest("size", "size_b") - 1e-6
    met = prefix.select(F.col("id").alias("a"), "size", "item").join(other, "item").where((F.col("a") < F.col("b")) & near).select("a", "b", "size", "size_b").distinct()
    met, met_path = scratch(met)
    del prefix, other  # their files go too
    release(spark)
    bits = read.where("print is not null").select("id", "bits").join(reps, "id", "left_semi").dropDuplicates(["id"])
    candidates = _possible(met, bits, threshold)
    del met, bits
    remove(spark, read_path)
    remove(spark, met_path)
    release(spark)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted
    near_sets = _mapped_sets(source.join(wanted, "id", "left_semi"), "set array<long>, bits array<long>", n, lambda found: (found.view(np.int64), _bitmap(found, MORE_BITS)) if len(found) else None)
    whole = cut_lineage(near_sets.dropDuplicates(["id"]))
    release(spark)
    candidates = _possible(candidates, whole.select("id", "bits"), threshold)
    release(spark)
    left, right = whole.select(F.col("id").alias("a"), F.col("set").alias("_a")), whole.select(F.col("id").alias("b"), F.col("set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("double")
    pairs = candidates.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("_a") + F.size("_b") - both)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= threshold), members


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b, jaccard)`` of all documents from the pairs of representatives and the ``members`` of their classes, each pair once, ``a`` the smaller id.

    Members of one class have a similarity of 1; each member of a class is paired with each one of a similar class. A null id has no pairs. The members
    of a large class are spread over several keys, so that no task gets all pairs of a class.
    """
    known = members.where("id is not null")
    sizes = cut_lineage(known.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.expr(f"n div {PART} + 1").alias("parts")))
    copies = known.join(sizes, "rep").select("rep", "id", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    links = pairs.select("a", "b", "jaccard", F.lit(False).alias("one")).unionByName(sizes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("one")))
    for side in ("a", "b"):  # a class of one is its representative
        wide = links.join(sizes.withColumnRenamed("rep", side), side, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        both = wide.join(copies.withColumnRenamed("rep", side), [side, "part"], "left").where("parts is null or id is not null")
        links = both.select(F.coalesce("id", side).alias(side), *[c for c in links.columns if c != side])
    return links.where("not one or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def duplicate_report(pairs: DataFrame, isbns: DataFrame) -> DataFrame:
    """``(a, b, jaccard, same_isbn)``: similar pairs and pairs with one ISBN, those with one ISBN first, then by similarity.

    ``isbns`` is ``(id, isbn)``. Each document with an ISBN is paired with the first one that has it, so that a group of any size gives one row a member.
    """
    known = isbns.where("isbn is not null").distinct()
    first = known.groupBy("isbn").agg(F.min("id").alias("a"))
    same = known.join(first, "isbn").where("a < id").select("a", F.col("id").alias("b")).distinct().withColumn("same_isbn", F.lit(True))
    both = pairs.join(same, ["a", "b"], "full_outer").select("a", "b", "jaccard", F.coalesce("same_isbn", F.lit(False)).alias("same_isbn"))
    return both.orderBy(F.desc("same_isbn"), F.desc_nulls_last("jaccard"), "a", "b")


def same_isbn(documents: DataFrame, isbn: Column, id_col: str) -> DataFrame:
    """``(isbn, rows, copies, first_id, last_id)`` of the ISBNs that several rows have; ``copies`` counts different ids."""
    grouped = documents.where(isbn.isNotNull()).groupBy(isbn.alias("isbn"))
    return grouped.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("copies"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("rows > 1")


def books_by_topic(documents: DataFrame) -> DataFrame:
    """``(topic, books, name, file_name)``: the lines of the books index; books without a topic are under ``Other``.

    A line is a row, so that a topic of any size is written by many tasks; order by ``topic, lower(name), file_name`` when writing.
    """
    books = documents.where("resource_type = 'book'").select(F.coalesce(filled("primary_topic"), F.lit("Other")).alias("topic"), F.coalesce(filled("title"), F.col("file_name")).alias("name"), "file_name")
    return books.join(books.groupBy("topic").agg(F.count("*").alias("books")), "topic")


def resource_lines(inventory: DataFrame) -> DataFrame:
    """``(moc, notes, level, line)``: the lines of the resource block of each topic, secondary topics marked; each file once for each topic.

    Levels order the lines: beginner, intermediate, advanced, other; within a level they are ordered by title, any case.
    """
    base = inventory.select(
        safe_stem("file_name").alias("stem"), F.coalesce(filled("title"), safe_stem("file_name")).alias("title"), F.lower(F.coalesce(F.trim("skill_level"), F.lit(""))).alias("skill"),
        F.concat(F.array(F.struct(filled("primary_topic").alias("topic"), F.lit(0).alias("second"))), F.transform(split_list("secondary_topics"), lambda t: F.struct(t.alias("topic"), F.lit(1).alias("second")))).alias("topics"),
    )
    level = F.when(F.col("skill") == "beginner", 0).when(F.col("skill") == "intermediate", 1).when(F.col("skill") == "advanced", 2).otherwise(99)
    rows = base.select("stem", "title", level.alias("level"), F.inline("topics")).where("topic is not null").withColumn("moc", moc_name("topic"))
    one = rows.groupBy("moc", "stem").agg(F.min(F.struct("second", "level", "title")).alias("x"))
    line = F.concat(F.lit("- [["), F.col("stem"), F.lit("|"), F.col("x.title"), F.lit("]]"), F.when(F.col("x.second") == 1, " ·  _(secondary)_").otherwise(""))
    return one.select("moc", F.col("x.level").alias("level"), line.alias("line")).join(one.groupBy("moc").agg(F.count("*").alias("notes")), "moc")


def _haystack(column: str, stem: bool) -> Column:
    """The terms of a column with two blanks between, so that occurrences of a phrase never share one."""
    return F.concat(F.lit(" "), F.array_join(terms_of(F.concat_ws(" ", column), stem), "  "), F.lit(" "))


class WordQuery:
    """A word query: ``NOT`` binds closer than ``AND``, that closer than ``OR``; words side by side must all occur and bind closest.

    Quotes make phrases, a star after a word its prefix, parentheses group. Broken syntax is read as the words that it has.
    """

    def __init__(self, query: str) -> None:
        self.phrases: list[str] = []
        self.tokens = re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+', query)
        self.at = 0
        self.tree = self._either()
        if self.at < len(self.tokens) or self.tree is None:
            self.phrases, self.tree = [], None
            for word in re.findall(r"[^\W_]+", query):
                if word not in ("AND", "OR", "NOT"):
                    found = self._phrase(word)
                    self.tree = found if self.tree is None else ("and", self.tree, found)

    def _next(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _chain(self, operator: str, inner):
        left = inner()
        while left is not None and self._next() == operator:
            self.at += 1
            right = inner()
            if right is None:
                return None
            left = (operator.lower(), left, right)
        return left

    def _either(self):
        return self._chain("OR", self._all)

    def _all(self):
        return self._chain("AND", self._but)

    def _but(self):
        return self._chain("NOT", self._beside)

    def _beside(self):
        left = None
        while (token := self._next()) is not None and token not in ("AND", "OR", "NOT", ")"):
            self.at += 1
            if token == "(":
                found = self._either()
                if found is None or self._next() != ")":
                    return None
                self.at += 1
            else:
                found = self._phrase(token)
            left = found if left is None or found is None else ("and", left, found)
        return left

    def _phrase(self, token: str):
        self.phrases.append(token)
        return ("has", len(self.phrases) - 1)

    def condition(self, counts: list[Column]) -> Column:
        """Whether a row matches, from the number of occurrences of each phrase."""

        def walk(node) -> Column:
            if node[0] == "has":
                return counts[node[1]] > 0
            left, right = walk(node[1]), walk(node[2])
            return left | right if node[0] == "or" else left & ~right if node[0] == "not" else left & right

        return F.lit(False) if self.tree is None else walk(self.tree)

    def counts(self, haystacks: list[Column], stem: bool = False) -> list[Column]:
        """The number of occurrences of each phrase in all columns; a phrase doesn't cross from one column to the next."""
        out = []
        for phrase in self.phrases:
            words = re.findall(r"[^\W_]+", folded_text(phrase))
            words = [stem_word(w) for w in words] if stem and not phrase.endswith("*") else words
            wanted = " " + "  ".join(words) + ("" if phrase.endswith("*") else " ")
            out.append(reduce(lambda a, b: a + b, [F.size(F.split(h, wanted)) - 1 for h in haystacks]) if words else F.lit(0))
        return out


def full_text(documents: DataFrame, query: str, text_cols: list[str], stem: bool = False) -> Column:
    """The condition of a word query over the given columns."""
    parsed = WordQuery(query)
    return parsed.condition(parsed.counts([_haystack(c, stem) for c in text_cols], stem))


def search_catalog(documents: DataFrame, query: str, text_cols: list[str], limit: int = 15, id_col: str = "file_name", stem: bool = False, **filters: str | None) -> DataFrame:
    """The best ``limit`` rows that match a word query and the filters, with their ``score`` (BM25 of the query's phrases over all rows); equal ones by id.

    Without a query the rows are ordered by title. One pass counts the phrases, one finds the rows.
    """
    kept = documents.where(where(**filters))
    parsed = WordQuery(query)
    if parsed.tree is None:
        return kept.withColumn("score", F.lit(0.0)).orderBy(F.asc_nulls_last("title"), id_col).limit(limit)

    def counted(rows: DataFrame) -> DataFrame:
        hay = rows.select("*", *[_haystack(c, stem).alias(f"_hay{k}") for k, c in enumerate(text_cols)])
        names = [F.col(f"_hay{k}") for k in range(len(text_cols))]
        size = reduce(lambda a, b: a + b, [F.when(h == "  ", 0).otherwise(F.size(F.split(h, "  "))) for h in names])
        return hay.select(*rows.columns, size.alias("_size"), *[c.alias(f"_f{k}") for k, c in enumerate(parsed.counts(names, stem))])

    found = [F.col(f"_f{k}") for k in range(len(parsed.phrases))]
    stats = counted(documents).agg(F.count("*").alias("n"), F.avg("_size").alias("length"), *[F.count_if(f > 0).alias(f"n{k}") for k, f in enumerate(found)]).first()  # one row
    score = F.lit(0.0)
    for k, f in enumerate(found):
        idf = math.log((stats["n"] - stats[f"n{k}"] + 0.5) / (stats[f"n{k}"] + 0.5))
        score = score + F.lit(idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("_size") / F.lit(float(stats["length"] or 1.0))))
    ranked = counted(kept).where(parsed.condition(found)).select(*documents.columns, F.round(score, 6).alias("score"))
    return ranked.orderBy(F.desc("score"), id_col).limit(limit)


def topic_links(documents: DataFrame, notes: DataFrame, topic_col: str = "primary_topic", note_col: str = "note") -> DataFrame:
    """``(topic, link)``: a link to the topic's note where it exists, else the topic as code. Topics are few, notes are looked up once for each."""
    topics = documents.select(filled(topic_col).alias("topic")).where("topic is not null").distinct().withColumn("_note", moc_name("topic"))
    known = notes.select(F.col(note_col).alias("_note")).distinct().withColumn("_there", F.lit(True))
    link = F.when(F.col("_there"), F.concat(F.lit("[["), F.col("_note"), F.lit("|"), F.col("topic"), F.lit("]]"))).otherwise(F.concat(F.lit("`"), F.col("topic"), F.lit("`")))
    return topics.join(known, "_note", "left").select("topic", link.alias("link"))


def loaded_documents(*parts: DataFrame, key: str = "id", newest: Column | None = None) -> DataFrame:
    """The records of several sources as one table: of those with one key the last source's wins, within a source the newest. Fields that a source lacks are null."""
    numbered = [p.withColumn("_source", F.lit(k)) for k, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    order = [F.desc("_source"), *([newest] if newest is not None else []), F.xxhash64(*plain)]
    return latest(rows, key, *order).drop("_source")
