"""Retrieval as DataFrame plans: filters, cosine top-k, BM25, rank fusion, tag filter and reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stemming import stemmed
from ..functions.text import folded_words
from ..session import exists, remove

#: Scores and distances are rounded to this many digits before they are ordered, so that the order of summation can't change a rank.
DIGITS = 9


def where(**wanted: str | None) -> Column:
    """A conjunction of equalities; arguments that are null or empty are left out, rows with a null in a wanted field are not kept."""
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in wanted.items() if v), F.lit(True))


def pool_width(n: int, rerank: bool = False, tags: bool = False, hybrid: bool = False, rerank_k: int = 20, tag_k: int = 200, hybrid_k: int = 50) -> int:
    """How many candidates a search needs before its filters and rankings cut them to ``n``."""
    return max([n, *([rerank_k] if rerank else []), *([tag_k] if tags else []), *([hybrid_k] if hybrid else [])])


def latest(df: DataFrame, key: str, *newest: Column) -> DataFrame:
    """One row for each key, the first by the given order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where("_first = 1").drop("_first")


def cosine_distance(a: Column, vector: list[float]) -> Column:
    """One less the dot product of a unit vector and a given one, in double precision; null for vectors that are shorter.

    The product is written out term by term, which Spark compiles, unlike higher-order functions.
    """
    terms = [F.get(a, F.lit(k)).cast("double") * F.lit(float(x)) for k, x in enumerate(vector)]
    return F.round(1 - reduce(lambda total, x: total + x, terms, F.lit(0.0)), DIGITS)


def dense_topk(rows: DataFrame, vector: list[float], k: int, id_col: str, vector_col: str = "embedding", condition: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows to one vector, with ``distance`` and ``rank``; the condition is applied before."""
    kept = rows if condition is None else rows.where(condition)
    top = kept.withColumn("distance", cosine_distance(F.col(vector_col), vector)).orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))  # k rows


def dense_topk_batch(queries: DataFrame, rows: DataFrame, k: int, query_col: str, id_col: str, query_vector: str = "embedding", vector_col: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """``(query, id, distance, rank)``: the ``k`` nearest rows to each query.

    The queries are taken in blocks of at most ``block_bytes`` of vectors, which bounds what a task is sent, and rows in slices whose distances
    take as many; each slice keeps its own best ``k`` for each query, and only those are shuffled. Null vectors match nothing; all others must
    have the queries' length. Each block is one scan of the rows.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(query_col).cast("long").alias("_q"), F.col(query_vector).alias("_v")).where("_v is not null and _q is not null").dropDuplicates(["_q"])
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("length")).first()
    parts = max(1, math.ceil(size["n"] * (size["length"] or 1) * 8 / block_bytes))
    given = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where("_v is not null and _id is not null")
    schema = f"_q long, _id {given.schema[0].dataType.simpleString()}, distance double"
    found = None
    for part in range(parts):
        table = asked.where(F.pmod(F.xxhash64("_q"), F.lit(parts)) == part).orderBy("_q").toArrow()
        if not table.num_rows:
            continue
        shared = spark.sparkContext.broadcast((table["_q"].to_numpy(), np.array(table["_v"].to_pylist(), np.float64)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            for whole in batches:
                some_rows = max(k, block_bytes // 8 // len(names))
                for at in range(0, whole.num_rows, some_rows):
                    batch = whole.slice(at, some_rows)
                    vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                    distance = np.round(1 - wanted @ vectors.T, DIGITS)
                    some = min(k, distance.shape[1])
                    limit = np.partition(distance, some - 1, axis=1)[:, some - 1]
                    q, r = np.nonzero(distance <= limit[:, None])  # ties at the limit are all kept
                    yield pa.RecordBatch.from_arrays([pa.array(names[q]), batch.column(0).take(pa.array(r)), pa.array(distance[q, r])], ["_q", "_id", "distance"])

        hits = given.mapInArrow(scan, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias(query_col), F.col("_id").alias(id_col), "distance", "rank")


def terms_of(text_col: Column | str, stem: bool) -> Column:
    """The terms of a text: folded words, or their English stems."""
    return stemmed(folded_words(text_col)) if stem else folded_words(text_col)


def term_frequencies(rows: DataFrame, id_col: str, text_col: str, stem: bool = False) -> DataFrame:
    """``(term, df, tf)`` of each term, over all rows."""
    each = rows.select(id_col, F.explode(terms_of(text_col, stem)).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


class LexicalIndex:
    """BM25 over a written table of postings, partitioned by a hash of the term; statistics cover all rows."""

    #: Terms whose table and query weights are small enough to be broadcast (short strings and two numbers each).
    FEW_TERMS = 200_000
    #: Entries of the matrix of weights by term and query up to which documents are scored for all queries at once (32 MB).
    MATRIX = 4_000_000

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if not exists(spark, f"{self.path}/stats/_SUCCESS"):
            raise FileNotFoundError(f"no lexical index at {path}; build one with LexicalIndex.build")
        stats = spark.read.parquet(f"{self.path}/stats").first()
        self.n, self.length, self.stem, self.id_col, self.buckets = stats["n"], stats["length"] or 1.0, stats["stem"], stats["id_col"], stats["buckets"]
        self.postings, self.documents = spark.read.parquet(f"{self.path}/postings"), spark.read.parquet(f"{self.path}/documents")

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, text_col: str, path: str, stem: bool = False, buckets: int = 16) -> LexicalIndex:
        """Write the index of ``rows`` to ``path``, replacing what is there; its statistics come last and mark it as complete. Null texts are left out.

        A search reads the buckets of its terms: take more of them as the corpus grows.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        remove(spark, path)
        documents = rows.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("_id"), terms_of(text_col, stem).alias("_terms"))
        # written first, so that a document keeps its number in all postings whatever is computed again
        documents.withColumn("size", F.size("_terms")).write.parquet(f"{path}/documents")
        documents = spark.read.parquet(f"{path}/documents")
        postings = documents.select("doc", "size", F.explode("_terms").alias("term")).groupBy("term", "doc", "size").agg(F.count("*").cast("int").alias("tf"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        # a bucket with a frequent term is several files, small buckets share a task
        spread = postings.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        spread.write.partitionBy("bucket").parquet(f"{path}/postings")
        stats = documents.agg(F.count("*").alias("n"), F.avg("size").alias("length"))
        stats.select("n", "length", F.lit(stem).alias("stem"), F.lit(id_col).alias("id_col"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/stats")
        return cls(spark, path)

    def _by_matrix(self, postings: DataFrame, weights: DataFrame, query_col: str, k: int) -> DataFrame:
        """``(query, doc, score)``: each task's best ``k`` documents for each query, with all ties, where the weights of all queries are one small matrix.

        A document's postings of all queries' terms meet in one row; the matrix product scores it for all queries, so that nothing is multiplied by the queries.
        """
        given = weights.toArrow()
        terms, queries = given["term"].unique(), given[query_col].unique()
        matrix = np.zeros((len(terms), len(queries)))
        matrix[pc.index_in(given["term"], terms).to_numpy(), pc.index_in(given[query_col], queries).to_numpy()] = given["weight"].to_numpy()
        shared = self.spark.sparkContext.broadcast((terms, queries, matrix))
        length = float(self.length)
        grouped = postings.groupBy("doc").agg(F.first("size").alias("size"), F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))  # at most the queries' terms

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, queries, matrix = shared.value
            rows = max(1, 4_000_000 // max(1, max(matrix.shape)))
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    batch = whole.slice(at, rows)
                    counts = batch.column(2).value_lengths().to_numpy()
                    doc = np.repeat(np.arange(batch.num_rows), counts)
                    tf = batch.column(3).flatten().to_numpy().astype(float)
                    long = batch.column(1).to_numpy().astype(float)[doc]
                    parts = np.zeros((batch.num_rows, len(terms)))
                    parts[doc, pc.index_in(batch.column(2).flatten(), terms).to_numpy()] = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * long / length))
                    exact = (parts @ matrix).T
                    rounded = np.round(exact, 6)
                    some = min(k, rounded.shape[1])
                    limit = np.partition(rounded, rounded.shape[1] - some, axis=1)[:, rounded.shape[1] - some]
                    q, d = np.nonzero((rounded >= limit[:, None]) & (exact > 0))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), batch.column(0).take(pa.array(d)), pa.array(rounded[q, d])], [query_col, "doc", "score"])

        kind = weights.schema[query_col].dataType.simpleString()
        return grouped.select("doc", "size", "terms", "tfs").mapInArrow(score, f"{query_col} {kind}, doc long, score double")

    def document_frequency(self) -> DataFrame:
        """``(term, df, tf)`` of each term."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))

    def topk(self, queries: DataFrame, query_col: str, text_col: str, k: int) -> DataFrame:
        """``(query, id, score, rank)``: the ``k`` best rows for the terms of each query, any of which may match.

        Only the postings of the queries' terms are read where these are few; frequencies and weights are broadcast up to ``FEW_TERMS`` of each.
        """
        asked = queries.select(query_col, F.explode(terms_of(text_col, self.stem)).alias("term")).groupBy(query_col, "term").agg(F.count("*").alias("weight"))
        size = asked.agg(F.count("*").alias("rows"), F.count_distinct("term").alias("terms"), F.count_distinct(query_col).alias("queries")).first()
        small = size["rows"] <= self.FEW_TERMS
        postings = self.postings
        if size["terms"] <= 1_000:  # the list goes into the scan's filter
            wanted = [r[0] for r in asked.select("term").distinct().collect()]
            buckets = asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct()
            postings = postings.where(F.col("bucket").isin([r[0] for r in buckets.collect()]) & F.col("term").isin(wanted))
        else:
            terms = asked.select("term").distinct()
            postings = postings.join(F.broadcast(terms) if small else terms, "term", "left_semi")
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        raw = F.log((F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.join(df, "term").select(query_col, "term", (F.when(raw <= 0, F.lit(1e-6)).otherwise(raw) * F.col("weight")).alias("weight"))
        if size["terms"] * size["queries"] <= self.MATRIX:
            scored = self._by_matrix(postings, weights, query_col, k)
        else:
            part = F.col("weight") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / F.lit(float(self.length))))
            scored = postings.join(F.broadcast(weights) if small else weights, "term").groupBy(query_col, "doc").agg(F.round(F.sum(part), 6).alias("score"))
        best = scored.withColumn("_rank", F.rank().over(Window.partitionBy(query_col).orderBy(F.desc("score")))).where(F.col("_rank") <= k)  # with all ties at the limit
        named = self.documents.select("doc", F.col("_id").alias(self.id_col)).join(best, "doc")
        rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), self.id_col))
        return named.select(query_col, self.id_col, "score", rank.alias("rank")).where(F.col("rank") <= k)


def fuse(dense: DataFrame, lexical: DataFrame, query_col: str, key_col: str, weights: tuple[float, float] = (1.0, 1.0), k: int = 60, id_col: str | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: ``(query, key, fused, dense_rank, lexical_rank, distance, rank)``; weights are (lexical, dense).

    Rows of one list with the same key count at their best rank. A row that only one list has gets nothing from the other. The key may be the text, so that
    repeated texts take one place; ``id_col`` is then carried along, from the dense list where it has the text.
    """
    by = [query_col, key_col]
    carried = lambda name: [F.min_by(id_col, "rank").alias(name)] if id_col else []
    left = dense.groupBy(*by).agg(F.min("rank").alias("dense_rank"), F.min_by("distance", "rank").alias("distance"), *carried("_dense_id"))
    right = lexical.groupBy(*by).agg(F.min("rank").alias("lexical_rank"), *carried("_lexical_id"))
    both = left.join(right, by, "full_outer")
    if id_col:
        both = both.withColumn(id_col, F.coalesce("_dense_id", "_lexical_id")).drop("_dense_id", "_lexical_id")
    score = F.coalesce(F.lit(weights[1]) / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(weights[0]) / (k + F.col("lexical_rank")), F.lit(0.0))
    order = Window.partitionBy(query_col).orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), key_col)
    return both.withColumn("fused", F.round(score, 9)).withColumn("rank", F.row_number().over(order))


def with_tags(ranked: DataFrame, wanted: list[str], tags_col: str = "tags") -> DataFrame:
    """Rows that have all wanted tags (trimmed, any case); the ranks of the others leave gaps. Without a wanted tag nothing is dropped."""
    clean = sorted({t.strip().lower() for t in wanted if t.strip()})
    if not clean:
        return ranked
    own = F.transform(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    return ranked.where(F.size(F.array_except(F.array(*[F.lit(t) for t in clean]), own)) == 0)


def reranked(ranked: DataFrame, score: Column, n: int, partition: list[str] | None = None) -> DataFrame:
    """The best ``n`` by another score (``rerank_score``), equal ones in their order so far, ranked anew."""
    order = Window.partitionBy(*(partition or [])).orderBy(F.desc("rerank_score"), "_before")
    again = ranked.withColumnRenamed("rank", "_before").withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order))
    return again.where(F.col("rank") <= n).drop("_before")


def search(
    rows: DataFrame, vector: list[float], n: int, id_col: str, condition: Column | None = None, tags: list[str] | None = None, tags_col: str = "tags", lexical: DataFrame | None = None,
    rerank: Callable[[DataFrame], Column] | None = None, weights: tuple[float, float] = (0.3, 1.0), vector_col: str = "embedding",
) -> DataFrame:
    """One query from candidates to ranked rows: filter, nearest rows, fusion with a lexical ranking, tag filter, reranking or trim."""
    width = pool_width(n, rerank is not None, bool(tags), lexical is not None)
    pool = dense_topk(rows, vector, width, id_col, vector_col, condition)
    if lexical is not None:
        one = pool.select(F.lit(0).alias("_query"), id_col, "rank", "distance")
        fused = fuse(one, lexical.select(F.lit(0).alias("_query"), id_col, "rank"), "_query", id_col, weights).where(F.col("rank") <= width).drop("_query")
        pool = rows.join(F.broadcast(fused), id_col)
    if tags:
        pool = with_tags(pool, tags, tags_col)
    if rerank is not None:
        return reranked(pool, rerank(pool), n)
    return pool.orderBy("rank").limit(n)


def prompt(ranked: DataFrame, question: Column, by: list[str], title: str, path: str, text: str) -> DataFrame:
    """``(..., sources, prompt)``: numbered context blocks of the ranked rows and the question, one row for each group of ``by``."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(title), F.lit("")), F.lit(" — "), F.coalesce(F.col(path), F.lit("")), F.lit("\n"), F.col(text))
    # the rows of a group are a ranking that was cut to a few
    blocks = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_blocks"), F.first(question).alias("_question"), F.count("*").alias("sources"))
    return blocks.select(*by, "sources", F.concat(F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n\n"), F.lit("\n\nQuestion: "), F.col("_question")).alias("prompt"))


def answer_states(questions: DataFrame, prompts: DataFrame, key: str, refusal: str = "Nothing in the collection answers this.") -> DataFrame:
    """``(key, state, sources, answer)``: questions without context are refused with a fixed answer, the others are ready for a generator."""
    both = questions.select(key).join(prompts.select(key, "sources"), key, "left")
    return both.select(key, F.when(F.col("sources").isNull(), "refused").otherwise("ready").alias("state"), F.coalesce("sources", F.lit(0)).alias("sources"), F.when(F.col("sources").isNull(), refusal).alias("answer"))


def citations(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Each ranked row as a flat JSON record (nulls included), beside its rank."""
    return ranked.select(*keys, "rank", F.to_json(F.struct(*[c for c in ranked.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("citation"))


def hashed_vectors(rows: DataFrame, id_col: str, text_col: str, size: int = 256) -> DataFrame:
    """``(id, embedding)``: unit vectors of hashed word counts, a deterministic stand-in where no model is at hand; empty texts have none."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = rows.select(id_col, folded_words(text_col).alias("_words")).where(F.size("_words") > 0)
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(tokens)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.select(id_col, F.transform(vector_to_array("_unit"), lambda x: x.cast("float")).alias("embedding"))
