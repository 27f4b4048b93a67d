"""All registered queries of the core operators and their SQL.

Every query reads whole tables. The SQL restates it for an independent engine; where SQL can't (streams, Python rules), the tests compare with brute force.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunkers as C
from ..functions import text as X
from ..operators import catalog, evaluate, retrieval, store
from ..session import cut_lineage, ensure_checkpoint_dir, exists, listing
from ..sources import files
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Fragments of SQL that several queries share.
_CHUNKS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, chunk_no DESC NULLS LAST, chunk_text NULLS LAST, embedding NULLS LAST, title NULLS LAST, note_status NULLS LAST, domain_name NULLS LAST, confidence NULLS LAST, tags NULLS LAST) AS f FROM chunks) WHERE f = 1)"""
_LAST_INVENTORY = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY loaded_at DESC NULLS LAST, created_at DESC NULLS LAST, file_key DESC NULLS LAST, title DESC NULLS LAST, author DESC NULLS LAST, isbn DESC NULLS LAST, lang_code DESC NULLS LAST, primary_topic DESC NULLS LAST, tags DESC NULLS LAST) AS f FROM inventory) WHERE f = 1)"
_TIME = "coalesce(try_strptime(trim(extracted_at), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(extracted_at), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(extracted_at), '%Y-%m-%d'), try_strptime(trim(extracted_at), '%d.%m.%Y'), try_strptime(trim(extracted_at), '%d/%m/%Y'), try_strptime(trim(extracted_at), '%Y/%m/%d'))"
_LAST_EXTRACTIONS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY {_TIME} DESC NULLS LAST, total_chars DESC NULLS LAST, text_layer_chars DESC NULLS LAST, total_pages DESC NULLS LAST, ocr_chars DESC NULLS LAST, ocr_page_count DESC NULLS LAST, total_documents DESC NULLS LAST, ocr_used DESC NULLS LAST) AS f FROM extractions) WHERE f = 1)"
_INVENTORY = "(SELECT file_name, max(loaded_at) AS loaded_at FROM inventory GROUP BY file_name)"


def _version(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A name for what a table holds now: that of its files, their sizes and times."""
    return hashlib.sha256(repr(listing(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")).encode()).hexdigest()[:16]


def _shared(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each chunk id, the one indexed last; written once for each version of the table to the shared folder."""
    path = f"{_shared(spark)}/chunks-{_version(spark, sf_dir, 'chunks')}"
    if not exists(spark, f"{path}/_SUCCESS"):
        order = [F.desc_nulls_last("indexed_at"), F.desc_nulls_last("chunk_no"), *[F.asc_nulls_last(c) for c in ("chunk_text", "embedding", "title", "note_status", "domain_name", "confidence", "tags")]]
        retrieval.latest(table(spark, sf_dir, "chunks"), "chunk_id", *order).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lexical_index(spark: SparkSession, sf_dir: str, stem: bool = False) -> retrieval.LexicalIndex:
    """The written index of the current chunks; built where this version has none yet."""
    path = f"{_shared(spark)}/lexical-{_version(spark, sf_dir, 'chunks')}-{'stems' if stem else 'words'}"
    try:
        return retrieval.LexicalIndex(spark, path)
    except FileNotFoundError:
        return retrieval.LexicalIndex.build(current_chunks(spark, sf_dir), "chunk_id", "chunk_text", path, stem)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


# ---- retrieval ----

_FIRST = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_DISTANCE = "round(1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 9)"


@query(f"SELECT vec_id, label, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings, {_FIRST} ORDER BY distance, vec_id LIMIT 8)")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 8, "vec_id").select("vec_id", "label", "distance", "rank")


@query(f"SELECT vec_id, label, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings, {_FIRST} WHERE label = 3 ORDER BY distance, vec_id LIMIT 8)")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(rows, first_vector(spark, sf_dir), 8, "vec_id", condition=F.col("label") == 3).select("vec_id", "label", "distance", "rank")


@query("""SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_topk_batch(asked, rows, 10, "query_id", "vec_id")


_TAGS = "list_transform(coalesce(tags, []), lambda t: lower(trim(t)))"


@query(f"""SELECT chunk_id, rank FROM (SELECT chunk_id, tags, row_number() OVER (ORDER BY distance, chunk_id) AS rank
    FROM (SELECT chunk_id, tags, {_DISTANCE} AS distance FROM {_CHUNKS}, (SELECT embedding AS q FROM {_CHUNKS} WHERE embedding IS NOT NULL ORDER BY chunk_id LIMIT 1) WHERE embedding IS NOT NULL) ORDER BY distance, chunk_id LIMIT 200)
    WHERE list_contains({_TAGS}, 'log')""")
def tag_filter_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_chunks(spark, sf_dir).where("embedding is not null")
    vector = rows.orderBy("chunk_id").select("embedding").first()[0]
    return retrieval.with_tags(retrieval.dense_topk(rows, vector, retrieval.pool_width(8, tags=True), "chunk_id"), [" Log "]).select("chunk_id", "rank")


@query(f"SELECT chunk_id FROM {_CHUNKS} WHERE list_contains({_TAGS}, 'cluster')")
def tag_filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_tags(current_chunks(spark, sf_dir), ["cluster"]).select("chunk_id")


@query(f"SELECT source_kind, count(*) AS n, count(DISTINCT file_path) AS files FROM {_CHUNKS} WHERE domain_name = 'DevOps' AND note_status = 'active' GROUP BY source_kind")
def where_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = current_chunks(spark, sf_dir).where(retrieval.where(domain_name="DevOps", note_status="active", subdomain=None, confidence=""))
    return kept.groupBy("source_kind").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


_WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_BM25 = f"""
    d AS (SELECT chunk_id, {_WORDS.format('chunk_text')} AS w FROM {_CHUNKS} WHERE chunk_text IS NOT NULL),
    s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
    p AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_WORDS.format('query_text')}) AS term FROM golden_queries) GROUP BY ALL),
    b AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
          * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) * weight), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b)"""


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    return current_chunks(spark, sf_dir), lexical_index(spark, sf_dir).topk(table(spark, sf_dir, "golden_queries"), "query_id", "query_text", k)


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM l WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 10)[1]


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over English stems."""
    return lexical_index(spark, sf_dir, stem=True).topk(table(spark, sf_dir, "golden_queries"), "query_id", "query_text", 10)


def hybrid(spark: SparkSession, sf_dir: str, depth: int = 50) -> DataFrame:
    """All golden queries: BM25, the nearest chunks to the vector of the best lexical hit, and their weighted fusion.

    The queries have no vectors of their own, so the best lexical hit lends its own.
    """
    rows, lexical = _lexical(spark, sf_dir, depth)
    lexical = cut_lineage(lexical)  # at most ``depth`` rows for each query, read three times below
    seeds = lexical.where("rank = 1").join(rows.select("chunk_id", "embedding"), "chunk_id").select("query_id", "embedding")
    dense = retrieval.dense_topk_batch(seeds, rows, depth, "query_id", "chunk_id")
    texts = rows.select("chunk_id", "chunk_text")
    wanted = cut_lineage(dense.select("query_id", "chunk_id", "rank", "distance").unionByName(lexical.select("query_id", "chunk_id", "rank"), allowMissingColumns=True).join(texts, "chunk_id"))
    fused = retrieval.fuse(wanted.where("distance is not null"), wanted.where("distance is null"), "query_id", "chunk_text", (0.3, 1.0), id_col="chunk_id")
    return fused.where("rank <= 8").drop("chunk_text")


_HYBRID = f"""
    v AS (SELECT query_id, c.embedding AS q FROM l JOIN {_CHUNKS} c USING (chunk_id) WHERE rank = 1),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {_DISTANCE} AS distance FROM {_CHUNKS} c, v)),
    x AS (SELECT chunk_id, chunk_text FROM {_CHUNKS}),
    ea AS (SELECT query_id, chunk_text, min(rank) AS rank, arg_min(distance, rank) AS distance, arg_min(chunk_id, rank) AS chunk_id FROM e JOIN x USING (chunk_id) WHERE rank <= 50 GROUP BY query_id, chunk_text),
    la AS (SELECT query_id, chunk_text, min(rank) AS rank, arg_min(chunk_id, rank) AS chunk_id FROM l JOIN x USING (chunk_id) WHERE rank <= 50 GROUP BY query_id, chunk_text),
    h AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_text, b.chunk_text) AS t, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS dense_rank, a.distance, b.rank AS lexical_rank,
          round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(0.3::DOUBLE / (60 + b.rank), 0), 9) AS fused
          FROM ea a FULL JOIN la b ON a.query_id = b.query_id AND a.chunk_text = b.chunk_text),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, t) AS rank FROM h)"""


@query(f"WITH {_BM25}, {_HYBRID} SELECT query_id, chunk_id, dense_rank, distance, lexical_rank, fused, rank FROM r WHERE rank <= 8")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).orderBy("query_id", "rank")


@query(f"""WITH {_BM25}, c AS (SELECT l.query_id, l.rank, c.chunk_text, c.chunk_id, g.query_kind, len(list_intersect({_WORDS.format('c.heading')}, {_WORDS.format('g.query_text')})) AS rerank_score
    FROM l JOIN {_CHUNKS} c USING (chunk_id) JOIN golden_queries g USING (query_id) WHERE l.rank <= 20)
    SELECT query_id, chunk_id, rerank_score, rank FROM (SELECT query_id, chunk_id, rerank_score::BIGINT AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM c) WHERE rank <= 5""")
def rerank_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexical = _lexical(spark, sf_dir, 20)
    pool = lexical.join(rows.select("chunk_id", "heading"), "chunk_id").join(F.broadcast(table(spark, sf_dir, "golden_queries").select("query_id", "query_text")), "query_id")
    score = F.coalesce(F.size(F.array_intersect(X.folded_words("heading"), X.folded_words("query_text"))), F.lit(0)).cast("long")
    return retrieval.reranked(pool, score, 5, ["query_id"]).select("query_id", "chunk_id", "rerank_score", "rank")


@query(f"""WITH {_BM25} SELECT query_id, count(*) AS sources, string_agg('[' || rank || '] ' || coalesce(title, '') || ' — ' || coalesce(file_path, '') || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY rank)
    || chr(10) || chr(10) || 'Question: ' || any_value(query_text) AS prompt FROM l JOIN {_CHUNKS} c USING (chunk_id) JOIN golden_queries USING (query_id) WHERE rank <= 5 GROUP BY query_id""")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexical = _lexical(spark, sf_dir, 5)
    pool = lexical.join(rows.select("chunk_id", "title", "file_path", "chunk_text"), "chunk_id").join(F.broadcast(table(spark, sf_dir, "golden_queries").select("query_id", "query_text")), "query_id")
    return retrieval.prompt(pool, F.col("query_text"), ["query_id"], "title", "file_path", "chunk_text")


@query(f"""WITH {_BM25}, k AS (SELECT query_id, count(*) AS n FROM l WHERE rank <= 5 GROUP BY query_id) SELECT query_id, CASE WHEN n IS NULL THEN 'refused' ELSE 'ready' END AS state, coalesce(n, 0) AS sources,
    CASE WHEN n IS NULL THEN 'Nothing in the collection answers this.' END AS answer FROM golden_queries LEFT JOIN k USING (query_id)""")
def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.answer_states(table(spark, sf_dir, "golden_queries"), prompt_contexts(spark, sf_dir), "query_id")


@query(f"""WITH {_BM25} SELECT query_id, rank, '{{"chunk_id":' || to_json(chunk_id) || ',"score":' || score || ',"rank":' || rank || ',"title":' || coalesce(to_json(title)::VARCHAR, 'null') || ',"heading":' || coalesce(to_json(heading)::VARCHAR, 'null')
    || ',"file_path":' || coalesce(to_json(file_path)::VARCHAR, 'null') || ',"source_kind":' || coalesce(to_json(source_kind)::VARCHAR, 'null') || '}}' AS citation FROM l JOIN {_CHUNKS} c USING (chunk_id) WHERE rank <= 5""")
def citation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexical = _lexical(spark, sf_dir, 5)
    return retrieval.citations(lexical.join(rows.select("chunk_id", "title", "heading", "file_path", "source_kind"), "chunk_id"), ["query_id"])


@query(f"WITH {_BM25}, {_HYBRID} SELECT count(*) AS queries, count(*) FILTER (WHERE d < 0.75) AS passed, count(*) FILTER (WHERE d >= 0.75) AS weak FROM (SELECT query_id, min(distance) AS d FROM e WHERE rank BETWEEN 2 AND 10 GROUP BY query_id)")
def smoke_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexical = _lexical(spark, sf_dir, 1)
    seeds = cut_lineage(lexical.join(rows.select("chunk_id", "embedding"), "chunk_id").select("query_id", "embedding"))
    best = retrieval.dense_topk_batch(seeds, rows, 10, "query_id", "chunk_id").where("rank > 1").groupBy("query_id").agg(F.min("distance").alias("d"))
    return best.agg(F.count("*").alias("queries"), F.count_if(F.col("d") < 0.75).alias("passed"), F.count_if(F.col("d") >= 0.75).alias("weak"))


@query()
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", 64)


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(catalog.full_text(docs, "router OR cluster", ["text"])).select("doc_id", X.snippet("text", ["router", "cluster"]).alias("snippet"))


# ---- evaluation ----

_HIT = "len(list_filter(expected, lambda e: contains(lower(coalesce(title, '') || chr(10) || coalesce(file_path, '')), lower(e)))) > 0"
_MEASURES = "count(*) AS n, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_10, round(avg(coalesce(1.0 / hit_rank, 0)), 4) AS mrr"


@query(f"WITH {_BM25}, k AS (SELECT query_id, min(rank) AS hit_rank FROM l JOIN {_CHUNKS} c USING (chunk_id) JOIN golden_queries g USING (query_id) WHERE rank <= 10 AND {_HIT} GROUP BY query_id) SELECT query_id, query_kind, hit_rank FROM golden_queries LEFT JOIN k USING (query_id)")
def golden_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lexical = _lexical(spark, sf_dir, 10)
    return evaluate.hit_ranks(lexical.join(rows.select("chunk_id", "title", "file_path"), "chunk_id"), table(spark, sf_dir, "golden_queries"))


@query(f"WITH {_BM25}, k AS (SELECT query_id, min(rank) AS hit_rank FROM l JOIN {_CHUNKS} c USING (chunk_id) JOIN golden_queries g USING (query_id) WHERE rank <= 10 AND {_HIT} GROUP BY query_id) SELECT coalesce(query_kind, 'overall') AS query_kind, {_MEASURES} FROM golden_queries LEFT JOIN k USING (query_id) GROUP BY GROUPING SETS ((), (query_kind))")
def eval_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_with_total(golden_hits(spark, sf_dir), "query_kind")


_RUNS = "(SELECT run_id, query_id, min(hit_rank) AS hit_rank FROM (SELECT *, rank() OVER (PARTITION BY run_id, query_id ORDER BY ran_at DESC) AS f FROM eval_rows) WHERE f = 1 GROUP BY ALL)"


@query(f"SELECT run_id, query_kind, {_MEASURES} FROM {_RUNS} JOIN golden_queries USING (query_id) GROUP BY run_id, query_kind")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("run_id", "query_id").orderBy(F.desc("ran_at"))
    last = table(spark, sf_dir, "eval_rows").withColumn("_f", F.rank().over(newest)).where("_f = 1").groupBy("run_id", "query_id").agg(F.min("hit_rank").alias("hit_rank"))
    return evaluate.metrics(last.join(F.broadcast(table(spark, sf_dir, "golden_queries")), "query_id"), ["run_id", "query_kind"])


_WRONG = "(hit_at_5 AND coalesce(hit_rank, 99) > 5) OR (NOT hit_at_5 AND hit_rank <= 5) OR (hit_at_10 AND coalesce(hit_rank, 99) > 10) OR (NOT hit_at_10 AND hit_rank <= 10)"


@query(f"SELECT run_id, query_id, count(*) AS n, count(*) FILTER (WHERE {_WRONG}) AS wrong, count(DISTINCT coalesce(hit_rank, 0)) AS ranks FROM eval_rows GROUP BY ALL HAVING count(*) > 1 OR count(*) FILTER (WHERE {_WRONG}) > 0")
def eval_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that have a query more than once, or whose flags contradict the rank."""
    rank = F.coalesce("hit_rank", F.lit(99))
    wrong = (F.col("hit_at_5") != (rank <= 5)) | (F.col("hit_at_10") != (rank <= 10))
    each = table(spark, sf_dir, "eval_rows").groupBy("run_id", "query_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_distinct(F.coalesce("hit_rank", F.lit(0))).alias("ranks"))
    return each.where("n > 1 or wrong > 0")


# ---- text and chunks ----

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BODY = _STRIP.format(r"regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g')").replace("{{", "{").replace("}}", "}")
_WINDOWS = f"""b AS (SELECT doc_id, {_BODY} AS t FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, t, unnest(range(0, 1 + greatest(ceil((length(t) - 1200) / 1050.0), 0)::BIGINT)) AS i FROM b),
    w AS (SELECT doc_id, i, CASE WHEN length(t) <= 1200 THEN t ELSE {_STRIP.format("substr(t, 1 + i * 1050, 1200)")} END AS chunk, length(t) AS n FROM k),
    c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, chunk FROM w WHERE chunk <> '' OR n <= 1200)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.chunk_windows("text")).alias("chunk_no", "chunk"))


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_no, chunk FROM c")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_no, sha256(doc_id || '::' || chunk_no || '::' || chunk) AS chunk_id FROM c")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), X.stable_id("doc_id", "chunk_no", "chunk").alias("chunk_id"))


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(C.pack_paragraphs("text")).alias("chunk_no", "chunk"))


_LINES = r"regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"


@query(rf"""WITH u AS (SELECT doc_id, {_LINES} AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(string_split_regex(chr(10) || t, '\n#')) AS x, generate_subscripts(string_split_regex(chr(10) || t, '\n#'), 1) AS i FROM u),
    s AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'Document' ELSE coalesce(nullif({_STRIP.format("rtrim(ltrim(string_split(x, chr(10))[1], '#'), '#')")}, ''), 'Document') END AS heading,
          CASE WHEN i = 1 THEN {_STRIP.format("x")} WHEN contains(x, chr(10)) THEN {_STRIP.format("substr(x, strpos(x, chr(10)) + 1)")} ELSE '' END AS body FROM p)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_no, heading, body FROM s WHERE body <> ''""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(C.sections("text")).alias("_n", "s")).select("doc_id", F.col("_n").cast("long").alias("section_no"), "s.heading", "s.body")


@query(r"SELECT doc_id, link FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\[\[([^\]|#]+)', 1))) AS link FROM documents)")
def wikilink_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.wikilinks("text")).alias("link"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\{[^}]+\}\}', '', 'g'), '(?s)(?:^|\s*\n)#{1,6}\s*(?:Related Topics|Potential New Notes)[ \t\r]*(?:\n.*)?$', ''), '\[\[[^\]|]+\|([^\]]+)\]\]', '\1', 'g'),
    '\[\[([^\]]+)\]\]', '\1', 'g') AS body FROM documents""")
def plain_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_wikilinks(X.strip_navigation_tail(X.strip_template_variables("text"))).alias("body"))


@query(rf"""SELECT doc_id, {_STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<br\s*/?>', chr(10), 'g'), '(?is)</(?:p|div|h[1-6]|li|tr)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')")} AS plain FROM documents""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_tags("text").alias("plain"))


@query()
def html_text_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.unescaped(X.strip_tags("text")).alias("plain"))


@query()
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", files.front_matter("text").alias("f"))
    return docs.select("doc_id", F.explode(F.map_entries("f.meta")).alias("e"), F.length("f.body").alias("body_chars")).select("doc_id", F.col("e.key").alias("key"), F.array_join("e.value", "; ").alias("value"), "body_chars")


@query()
def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").where("file_type = 'md'").select(F.concat(F.lit("Knowledge/"), "primary_topic", F.lit("/"), "source", F.lit("/"), "file_name").alias("path"), "text").where("path is not null and text is not null")
    return files.note_chunks(notes).select("chunk_id", "path", "title", "subdomain", "section_no", "heading", "chunk_no", "document")


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("file_type <> 'md'").select("file_name", "title", "text")
    return files.document_chunks(docs).select("chunk_id", "file_name", "section_no", "heading", "chunk_no", "document")


@query()
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.title_from_file("file_name").alias("title"))


_STEM = r"regexp_replace(file_name, '(.)\.[^.]*$', '\1')"
_LIST = "list_filter(list_transform(string_split_regex({0}, '[;,]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _clean_title(t: str, stem: str) -> str:
    return rf"""CASE WHEN lower({t}) IN ('untitled', 'title', 'unknown', 'microsoft word', 'document', '') OR length({t}) < 3 OR contains(lower({t}), 'microsoft word') OR regexp_matches(lower({t}), '\.(doc|docx|indd|pdf|tex|qxd)\b')
    OR regexp_full_match({t}, '\d+') OR lower({t}) = lower({stem}) THEN NULL ELSE regexp_replace({t}, '\s+', ' ', 'g') END"""


def _clean_author(a: str, t: str) -> str:
    return rf"""CASE WHEN length({a}) < 2 OR regexp_full_match({a}, '\d+') OR regexp_matches({a}, '(?i)(adobe|acrobat|calibre|microsoft|pscript|ghostscript|quark|indesign|latex|pdftk|word|writer|nitro)') OR coalesce(lower({a}) = lower({t}), false) THEN NULL
    ELSE regexp_replace({a}, '\s+', ' ', 'g') END"""


_FOUND_ISBN = r"coalesce(nullif(regexp_replace(regexp_extract(text, '97[89](?:[-\s]?\d){10}', 0), '[-\s]', '', 'g'), ''), CASE WHEN length(s10) = 10 THEN s10 END)"
_TEN = r"regexp_replace(regexp_extract(text, '\b\d(?:[-\s]?\d){8}[-\s]?[\dXx]\b', 0), '[-\s]', '', 'g') AS s10"


@query(f"SELECT file_key, file_name, {_clean_title('t', _STEM)} AS title, {_clean_author('a', 't')} AS author FROM (SELECT file_key, file_name, {_STRIP.format('title')} AS t, {_STRIP.format('author')} AS a FROM inventory)")
def clean_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "inventory").select("file_key", "file_name", X.clean_title("title", X.stem("file_name")).alias("title"), X.clean_author("author", "title").alias("author"))


@query(rf"""SELECT file_key, array_to_string(coalesce({_LIST.format('tags')}, []), '|') AS tags, CASE WHEN regexp_full_match({_STRIP.format('page_count')}, '[+-]?\d+') THEN try_cast({_STRIP.format('page_count')} AS BIGINT) END AS pages,
    regexp_replace({_STEM}, '[\\/:*?"<>|]', '_', 'g') AS note FROM inventory""")
def parsed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "inventory").select("file_key", F.array_join(X.split_list("tags"), "|").alias("tags"), X.to_int("page_count").alias("pages"), X.safe_stem("file_name").alias("note"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_extract(text, '97[89](?:[-\s]?\d){10}', 0), '[-\s]', '', 'g'), ''), CASE WHEN length(s) = 10 THEN s END) AS found, nullif(regexp_replace(isbn, '[-\s]', '', 'g'), '') AS given
    FROM (SELECT *, regexp_replace(regexp_extract(text, '\b\d(?:[-\s]?\d){8}[-\s]?[\dXx]\b', 0), '[-\s]', '', 'g') AS s FROM documents)""")
def isbn_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.find_isbn("text").alias("found"), F.nullif(F.regexp_replace("isbn", r"[-\s]", ""), F.lit("")).alias("given"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 600 THEN regexp_replace(substr(t, 1, 600), '\s+$', '') || '…' ELSE t END AS excerpt FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM documents)""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.excerpt("text").alias("excerpt"))


# ---- catalog ----


@query(f"SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.chunk_id IS NULL THEN 'new' WHEN n.chunk_id IS NULL THEN 'stale' WHEN o.t IS NOT DISTINCT FROM n.t AND o.s IS NOT DISTINCT FROM n.s AND o.d IS NOT DISTINCT FROM n.d THEN 'same' ELSE 'updated' END AS change FROM (SELECT chunk_id, title AS t, note_status AS s, domain_name AS d FROM {_CHUNKS} WHERE coalesce(note_status, '') <> 'archived') n FULL JOIN (SELECT chunk_id, CASE WHEN confidence = 'high' THEN title || ' (old)' ELSE title END AS t, note_status AS s, domain_name AS d FROM {_CHUNKS} WHERE indexed_at < TIMESTAMPTZ '2025-07-01 00:00:00+00') o USING (chunk_id)) GROUP BY change")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = current_chunks(spark, sf_dir)
    before = now.where("indexed_at < timestamp '2025-07-01 00:00:00+00:00'").withColumn("title", F.when(F.col("confidence") == "high", F.concat("title", F.lit(" (old)"))).otherwise(F.col("title")))
    changes = store.diff(now.where(F.coalesce("note_status", F.lit("")) != "archived"), before, "chunk_id", ["title", "note_status", "domain_name"])
    return store.counters(changes)


@query("SELECT file_name, 'no text' AS side FROM (SELECT DISTINCT file_name FROM inventory) WHERE file_name NOT IN (SELECT file_name FROM documents WHERE file_name IS NOT NULL) UNION ALL SELECT file_name, 'no inventory' FROM documents WHERE file_name NOT IN (SELECT file_name FROM inventory WHERE file_name IS NOT NULL)")
def anti_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unmatched(table(spark, sf_dir, "inventory"), table(spark, sf_dir, "documents"))


@query("SELECT DISTINCT file_name FROM inventory WHERE file_type = 'pdf' AND file_name NOT IN (SELECT file_path FROM chunks WHERE source_kind = 'json' AND file_path IS NOT NULL)")
def json_covers_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = table(spark, sf_dir, "chunks").where("source_kind = 'json'").select(F.col("file_path").alias("file_name"))
    return files.not_covered(table(spark, sf_dir, "inventory").where("file_type = 'pdf'").select("file_name").distinct(), covered)


@query(f"""SELECT i.file_name, epoch_us(i.loaded_at) AS loaded_us, count(e.file_name) AS runs, max(e.total_chars) AS total_chars, max(e.ocr_chars) AS ocr_chars, bool_or(e.ocr_used) AS ocr_used FROM {_INVENTORY} i JOIN extractions e USING (file_name) GROUP BY ALL""")
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "inventory").groupBy("file_name").agg(F.max("loaded_at").alias("loaded_at"))
    runs = table(spark, sf_dir, "extractions").groupBy("file_name").agg(F.count("*").alias("runs"), F.max("total_chars").alias("total_chars"), F.max("ocr_chars").alias("ocr_chars"), F.bool_or("ocr_used").alias("ocr_used"))
    return last.join(runs, "file_name").select("file_name", F.unix_micros("loaded_at").alias("loaded_us"), "runs", "total_chars", "ocr_chars", "ocr_used")


@query(f"""SELECT file_name, i.title, i.author, i.primary_topic, array_to_string(coalesce({_LIST.format('i.tags')}, []), '|') AS tags, epoch_us({_TIME}) AS extracted_us, e.total_pages, e.total_chars, e.ocr_chars, e.ocr_used
    FROM {_LAST_INVENTORY} i JOIN {_LAST_EXTRACTIONS} e USING (file_name)""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = catalog.index_documents(catalog.last_inventory(table(spark, sf_dir, "inventory")), catalog.last_extractions(table(spark, sf_dir, "extractions")))
    e = F.col("extraction")
    return merged.select("file_name", "title", "author", "primary_topic", F.array_join("tags", "|").alias("tags"), F.unix_micros(X.parsed_time(e["extracted_at"])).alias("extracted_us"), *[e[c].alias(c) for c in ("total_pages", "total_chars", "ocr_chars", "ocr_used")])


@query("SELECT coalesce(primary_topic, '') AS topic, count(*) AS n FROM documents GROUP BY ALL")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts_by(table(spark, sf_dir, "documents"), F.coalesce("primary_topic", F.lit("")), "topic")


@query("SELECT coalesce(source_group, '') AS source_group, count(*) AS n, count(DISTINCT file_name) AS files FROM inventory GROUP BY ALL")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "inventory").groupBy(F.coalesce("source_group", F.lit("")).alias("source_group")).agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("files"))


@query("SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM documents) GROUP BY tag ORDER BY n DESC, tag LIMIT 60")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = catalog.tag_rows(table(spark, sf_dir, "documents"), "doc_id")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(60)


@query("SELECT count(*) AS documents, count(DISTINCT primary_topic) AS topics, count(DISTINCT source) AS sources FROM documents")
def distinct_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("primary_topic").alias("topics"), F.count_distinct("source").alias("sources"))


@query("SELECT doc_id, file_name, title FROM documents WHERE skill_level = 'beginner' AND list_contains(tags, 'cluster')")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = catalog.tag_rows(docs, "doc_id").where("tag = 'cluster'")
    return docs.where(retrieval.where(skill_level="beginner")).join(tagged, "doc_id", "left_semi").select("doc_id", "file_name", "title")


def _hay(column: str) -> str:
    return rf"' ' || array_to_string(regexp_extract_all(strip_accents(lower({column})), '[\p{{L}}\p{{N}}]+'), '  ') || ' '"


_HAYS = f"SELECT doc_id, file_name, title, source, {_hay("coalesce(title, '')")} AS a, {_hay("coalesce(array_to_string(tags, ' '), '')")} AS g, {_hay("coalesce(text, '')")} AS b FROM documents"
_IN = lambda phrase: f"(contains(a, '{phrase}') OR contains(g, '{phrase}') OR contains(b, '{phrase}'))"
_TIMES = lambda phrase: "(" + " + ".join(f"len(string_split({h}, '{phrase}')) - 1" for h in "agb") + ")"


@query(f"SELECT doc_id FROM ({_HAYS}) WHERE {_IN(' recursion ')} OR ({_IN(' router ')} AND {_IN(' second  edition ')})")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AND binds closer than OR, wherever they stand."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(catalog.full_text(docs, 'recursion OR router AND "second edition"', ["title", "tags", "text"])).select("doc_id")


@query(f"SELECT doc_id FROM ({_HAYS}) WHERE {_IN(' clust')} AND ({_IN(' pod ')} OR {_IN(' canary ')}) AND NOT {_IN(' rollout ')}")
def full_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parentheses, a prefix, and NOT."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(catalog.full_text(docs, "clust* AND ((pod OR canary) NOT rollout)", ["title", "tags", "text"])).select("doc_id")


@query(f"""WITH h AS ({_HAYS}), c AS (SELECT *, {_TIMES(' second  edition ')} AS f0, {_TIMES(' page ')} AS f1, len(regexp_extract_all(a || g || b, '[^ ]+')) AS size FROM h),
    s AS (SELECT count(*) AS n, avg(size) AS al, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM c)
    SELECT doc_id, file_name, title, round({" + ".join(f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), CASE WHEN n{k} * 2 >= n THEN 1e-6 ELSE -1e9 END) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * size / al))" for k in (0, 1))}, 6) AS score
    FROM c, s WHERE source = 'annex-shelf' AND f0 > 0 AND f1 > 0 ORDER BY score DESC, file_name LIMIT 15""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search_catalog(table(spark, sf_dir, "documents"), '"second edition" page', ["title", "tags", "text"], source="annex-shelf", primary_topic=None)
    return found.select("doc_id", "file_name", "title", "score")


@query()
def catalog_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over English stems."""
    found = catalog.search_catalog(table(spark, sf_dir, "documents"), "scheduling clusters OR revisions", ["title", "tags", "text"], stem=True)
    return found.select("doc_id", "file_name", "title", "score")


@query(rf"""WITH t AS (SELECT DISTINCT primary_topic AS topic FROM documents WHERE {_STRIP.format("primary_topic")} <> ''),
    n AS (SELECT topic, 'Topic MOC - ' || {_STRIP.format("replace(replace(topic, '&', 'and'), '/', '-')")} AS note FROM t),
    k AS (SELECT DISTINCT 'Topic MOC - ' || {_STRIP.format("replace(replace(domain_name, '&', 'and'), '/', '-')")} AS note FROM chunks WHERE domain_name <> '')
    SELECT topic, CASE WHEN note IN (SELECT note FROM k) THEN '[[' || note || '|' || topic || ']]' ELSE '`' || topic || '`' END AS link FROM n""")
def topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "chunks").where("domain_name <> ''").select(X.moc_name("domain_name").alias("note"))
    return catalog.topic_links(table(spark, sf_dir, "documents"), notes)


@query("SELECT source_kind, count(*) AS n, count(subdomain) AS with_subdomain FROM (SELECT source_kind, subdomain FROM chunks WHERE source_kind = 'vault' UNION ALL SELECT source_kind, NULL FROM chunks WHERE source_kind <> 'vault') GROUP BY source_kind")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    parts = [chunks.where("source_kind = 'vault'"), chunks.where("source_kind = 'pdf'").drop("subdomain"), chunks.where("source_kind = 'json'").drop("subdomain")]
    return files.all_sources(*parts).groupBy("source_kind").agg(F.count("*").alias("n"), F.count("subdomain").alias("with_subdomain"))


@query("""WITH a AS (SELECT file_name, title, 'documents' AS origin, 0 AS s FROM documents WHERE file_name IS NOT NULL UNION ALL SELECT file_name, max(title), 'inventory', 1 FROM inventory WHERE file_name IS NOT NULL GROUP BY file_name)
    SELECT file_name, arg_max(coalesce(title, ''), s) AS title, arg_max(origin, s) AS origin FROM a GROUP BY file_name""")
def union_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two sources; the inventory's replace those of the documents with the same file name."""
    docs = table(spark, sf_dir, "documents").where("file_name is not null").select("file_name", "title", F.lit("documents").alias("origin"))
    other = table(spark, sf_dir, "inventory").where("file_name is not null").groupBy("file_name").agg(F.max("title").alias("title")).withColumn("origin", F.lit("inventory"))
    return catalog.loaded_documents(docs, other, key="file_name").select("file_name", F.coalesce("title", F.lit("")).alias("title"), "origin")


@query()
def catalog_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").where("file_type = 'md' and text is not null").select(F.concat_ws("/", F.lit("Knowledge"), "source", "file_name").alias("path"), "text")
    return files.catalog_notes(notes)


@query(r"""SELECT doc_id, CASE WHEN strpos(text, '<hr>') > 0 AND strpos(text, '</center>') > strpos(text, '<hr>') THEN substr(text, 1, strpos(text, '<hr>') - 1) || '<hr>' || chr(10) || coalesce(title, '') || chr(10) || '</center>' || substr(text, strpos(text, '</center>') + 9)
    ELSE regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || '<hr>' || chr(10) || coalesce(title, '') || chr(10) || '</center>' || chr(10) END AS content FROM documents""")
def managed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.managed_block("text", F.coalesce("title", F.lit("")), "<hr>", "</center>").alias("content"))


@query("SELECT doc_id, len(list_distinct(CASE WHEN total_pages <= 12 THEN range(0, greatest(total_pages, 0)) ELSE list_transform(range(0, 12), lambda k: floor(k * (total_pages - 1) / 11)::BIGINT) END)) AS looks FROM documents WHERE total_pages IS NOT NULL")
def page_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("total_pages is not null").select("doc_id", F.size(X.evenly_spaced("total_pages")).cast("long").alias("looks"))


_FILLED = lambda c: f"CASE WHEN {_STRIP.format(c)} <> '' THEN {c} END"


_FILL = f"""WITH i AS {_LAST_INVENTORY}, d AS (SELECT d.file_name, d.title, d.author, d.isbn, d.lang, d.text, {_TEN}, {_STEM.replace('file_name', 'd.file_name')} AS stem, {_STRIP.format('d.title')} AS dt, {_STRIP.format('i.title')} AS t, {_STRIP.format('i.author')} AS a, i.isbn AS i_isbn, i.lang_code AS i_lang
      FROM documents d LEFT JOIN i ON i.file_name = d.file_name),
    n AS (SELECT *, CASE WHEN {_FILLED('title')} IS NULL OR lower(trim(title)) = lower(stem) THEN coalesce({_clean_title('t', 'stem')}, title) ELSE title END AS new_title,
      coalesce({_FILLED('author')}, {_clean_author('a', 'dt')}) AS new_author, coalesce({_FILLED('isbn')}, {_FILLED('i_isbn')}, {_FOUND_ISBN}) AS new_isbn, coalesce({_FILLED('lang')}, {_FILLED('i_lang')}) AS new_lang FROM d)
    SELECT file_name, new_title, new_author, new_isbn, new_lang, {", ".join(f"new_{c} IS DISTINCT FROM {c} AS {c}_filled" for c in ("title", "author", "isbn", "lang"))} FROM n"""


@query(_FILL)
def fill_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enriched(table(spark, sf_dir, "documents"), catalog.last_inventory(table(spark, sf_dir, "inventory")))


@query(f"SELECT count(*) AS files, {', '.join(f'count(*) FILTER (WHERE {c}_filled) AS {c}' for c in ('title', 'author', 'isbn', 'lang'))} FROM ({_FILL})")
def fill_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields the inventory and the texts fill."""
    return fill_if_empty(spark, sf_dir).agg(F.count("*").alias("files"), *[F.count_if(F.col(f"{c}_filled")).alias(c) for c in ("title", "author", "isbn", "lang")])


@query("""SELECT sum(CASE WHEN trim(coalesce(title, '')) = '' THEN 1 ELSE 0 END)::BIGINT AS no_title, sum(CASE WHEN trim(coalesce(author, '')) = '' THEN 1 ELSE 0 END)::BIGINT AS no_author, sum(CASE WHEN trim(coalesce(isbn, '')) = '' THEN 1 ELSE 0 END)::BIGINT AS no_isbn,
    sum(CASE WHEN trim(coalesce(lang, '')) = '' THEN 1 ELSE 0 END)::BIGINT AS no_lang, sum(CASE WHEN file_name NOT IN (SELECT file_name FROM inventory WHERE file_name IS NOT NULL) THEN 1 ELSE 0 END)::BIGINT AS no_source FROM documents""")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "inventory").select("file_name").distinct().withColumn("_known", F.lit(True))
    gap = lambda c: F.sum(X.filled(c).isNull().cast("long")).alias(f"no_{c}")
    return docs.join(known, "file_name", "left").agg(gap("title"), gap("author"), gap("isbn"), gap("lang"), F.sum(F.col("_known").isNull().cast("long")).alias("no_source"))


_SETS = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    j AS (SELECT x, y, p.c / (m.c + n.c - p.c) AS jaccard FROM p JOIN n AS m ON m.doc_id = x JOIN n ON n.doc_id = y WHERE p.c >= 0.8 * (m.c + n.c - p.c))"""


@query(f"""WITH {_SETS}, r AS (SELECT DISTINCT first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS rep FROM (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS k FROM s GROUP BY doc_id))
    SELECT x AS doc_id_a, y AS doc_id_b, round(jaccard, 6) AS jaccard FROM j WHERE x IN (SELECT rep FROM r) AND y IN (SELECT rep FROM r)""")
def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = catalog.similar_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH {_SETS},
    i AS (SELECT doc_id, nullif(regexp_replace(isbn, '[-\\s]', '', 'g'), '') AS isbn FROM documents), f AS (SELECT isbn, min(doc_id) AS a FROM i WHERE isbn IS NOT NULL GROUP BY isbn),
    m AS (SELECT DISTINCT a, doc_id AS b FROM i JOIN f USING (isbn) WHERE a < doc_id), q AS (SELECT x AS a, y AS b, jaccard FROM j)
    SELECT coalesce(q.a, m.a) AS a, coalesce(q.b, m.b) AS b, round(jaccard, 6) AS jaccard, m.a IS NOT NULL AS same_isbn FROM q FULL JOIN m ON q.a = m.a AND q.b = m.b""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = catalog.member_pairs(*catalog.similar_pairs(docs))
    isbns = docs.select(F.col("doc_id").alias("id"), F.nullif(F.regexp_replace("isbn", r"[-\s]", ""), F.lit("")).alias("isbn"))
    return catalog.duplicate_report(pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard")), isbns)


@query(f"WITH {_SETS}, k AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS k FROM s GROUP BY doc_id) SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS rep FROM k")
def dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.similar_pairs(table(spark, sf_dir, "documents"))[1].select(F.col("id").alias("doc_id"), "rep")


@query(r"SELECT isbn, count(*) AS rows, count(DISTINCT file_name) AS copies, min(file_name) AS first_id, max(file_name) AS last_id FROM (SELECT nullif(regexp_replace(isbn, '[-\s]', '', 'g'), '') AS isbn, file_name FROM inventory) WHERE isbn IS NOT NULL GROUP BY isbn HAVING count(*) > 1")
def isbn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.same_isbn(table(spark, sf_dir, "inventory"), F.nullif(F.regexp_replace("isbn", r"[-\s]", ""), F.lit("")), "file_name")


@query(rf"""WITH b AS (SELECT CASE WHEN {_STRIP.format("primary_topic")} <> '' THEN primary_topic ELSE 'Other' END AS topic, CASE WHEN {_STRIP.format("title")} <> '' THEN title ELSE file_name END AS name, file_name FROM documents WHERE resource_type = 'book')
    SELECT topic, count(*) OVER (PARTITION BY topic) AS books, name, file_name FROM b""")
def books_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.books_by_topic(table(spark, sf_dir, "documents"))


@query(rf"""WITH a AS (SELECT regexp_replace({_STEM}, '[\\/:*?"<>|]', '_', 'g') AS stem, * FROM inventory),
    b AS (SELECT stem, CASE WHEN {_STRIP.format("title")} <> '' THEN title ELSE stem END AS title, CASE lower(trim(coalesce(skill_level, ''))) WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2 ELSE 99 END AS level, primary_topic, secondary_topics FROM a),
    t AS (SELECT stem, title, level, primary_topic AS topic, 0 AS second FROM b WHERE {_STRIP.format("primary_topic")} <> '' UNION ALL SELECT stem, title, level, unnest({_LIST.format('secondary_topics')}), 1 FROM b),
    m AS (SELECT 'Topic MOC - ' || {_STRIP.format("replace(replace(topic, '&', 'and'), '/', '-')")} AS moc, * FROM t),
    o AS (SELECT moc, stem, level, title, second FROM (SELECT *, row_number() OVER (PARTITION BY moc, stem ORDER BY second, level, title) AS f FROM m) WHERE f = 1)
    SELECT moc, level, '- [[' || stem || '|' || title || ']]' || CASE WHEN second = 1 THEN ' ·  _(secondary)_' ELSE '' END AS line, count(*) OVER (PARTITION BY moc) AS notes FROM o""")
def resource_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resource_lines(table(spark, sf_dir, "inventory"))


@query("""SELECT file_name, bool_or(NOT (coalesce(ocr_used, false) AND coalesce(ocr_chars, 0) = 0) AND coalesce(total_chars, 0) > 0) AS usable, sum(total_chars)::BIGINT AS chars, sum(total_pages)::BIGINT AS pages, sum(len(ocr_pages))::BIGINT AS ocr_pages FROM extractions GROUP BY file_name""")
def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.coalesce("total_chars", F.lit(0)) > 0, "some")
    rows = table(spark, sf_dir, "extractions").withColumn("usable", files.usable_extraction(text, F.col("ocr_used"), F.col("ocr_chars")))
    return rows.groupBy("file_name").agg(F.bool_or("usable").alias("usable"), F.sum("total_chars").alias("chars"), F.sum("total_pages").alias("pages"), F.sum(F.size("ocr_pages")).alias("ocr_pages"))


@query("""WITH e AS (SELECT file_name, bool_or(coalesce(total_chars, 0) > 0 AND NOT (coalesce(ocr_used, false) AND coalesce(ocr_chars, 0) = 0)) AS u FROM extractions GROUP BY file_name)
    SELECT DISTINCT i.file_name, file_type, CASE WHEN coalesce(lower(file_type) NOT IN ('pdf', 'epub', 'txt', 'md'), true) THEN 'skipped' WHEN u IS NULL THEN 'missing' WHEN u THEN 'cached' ELSE 'error' END AS status FROM inventory i LEFT JOIN e ON e.file_name = i.file_name""")
def extraction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extraction_manifest(table(spark, sf_dir, "inventory"), table(spark, sf_dir, "extractions"))


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are what form feeds part in the extracted texts."""
    docs = table(spark, sf_dir, "documents").where("text is not null and file_name is not null")
    pages = docs.select(F.col("file_name").alias("path"), F.posexplode(F.split("text", "\f")).alias("_page", "text")).select("path", (F.col("_page") + 1).alias("page_no"), "text")
    return files.page_chunks(pages).select("chunk_id", "path", "heading", "chunk_no", "document")


@query("""SELECT d.file_name, CASE WHEN c.made IS NULL THEN 'MISSING' WHEN d.extracted_at > c.made THEN 'STALE' ELSE 'OK' END AS state FROM documents d LEFT JOIN (SELECT file_path AS file_name, max(indexed_at) AS made FROM chunks GROUP BY 1) c USING (file_name)""")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "chunks").groupBy(F.col("file_path").alias("file_name")).agg(F.max("indexed_at").alias("made"))
    both = table(spark, sf_dir, "documents").join(made, "file_name", "left")
    return both.select("file_name", store.freshness(F.lit(True), F.col("made"), F.col("extracted_at")).alias("state"))


@query("""SELECT source_kind, strftime(indexed_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, count(subdomain) AS with_subdomain FROM chunks GROUP BY ALL""")
def arrivals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("indexed_at", "yyyy-MM-dd")
    return table(spark, sf_dir, "chunks").groupBy("source_kind", day.alias("day")).agg(F.count("*").alias("n"), F.count("subdomain").alias("with_subdomain"))


@query(f"SELECT chunk_id, chunk_no, epoch_us(indexed_at) AS indexed_us FROM {_CHUNKS}")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks table read as a stream of files and merged into a collection; equal to the batch result."""
    from ..streaming.ingest import ingest

    root = f"{_shared(spark)}/ingest-{uuid.uuid4().hex}"
    target = store.Collection(spark, f"{root}/collection")
    ingest(spark, f"{sf_dir.rstrip('/')}/chunks.parquet", target, f"{root}/progress")
    return target.read().select("chunk_id", "chunk_no", F.unix_micros("indexed_at").alias("indexed_us"))
