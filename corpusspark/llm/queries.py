"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import leakage, names, neardup, packing, residue, scans, splitting, subjects

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "documents"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "documents"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items")))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.cleaned(docs, leakage.leaked_spans(docs, table(spark, sf_dir, "test_items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = names.spelling_pairs(names.linked_names(table(spark, sf_dir, "documents")))
    return pairs.withColumnsRenamed({"name_a": "author_a", "name_b": "author_b"})


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_names(table(spark, sf_dir, "documents")).withColumnRenamed("name", "author")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, topics = (table(spark, sf_dir, t) for t in ("documents", "topic_labels", "topics"))
    return subjects.subjects(docs, labels, topics)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(table(spark, sf_dir, "documents")).defects


def p4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scans.repaired(docs, scans.scan_noise(docs))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars >= 400")
    pairs, members = neardup.near_duplicates(docs, threshold=0.5)
    return neardup.all_pairs(pairs, members).withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neardup.duplicate_classes(*neardup.near_duplicates(docs)).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_records(table(spark, sf_dir, "documents")).where("residue").select("doc_id").distinct()


def p8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_records(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_entities, p3_found, p4_found, p4_repair, p5_found, p5_classes, p6_pack, p6_fill, p7_found, p7_clean, p8_found, p8_records)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT doc_id FROM documents WHERE length(text) > 1200",
        "p5_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE n_chars >= 400),
                 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
                 n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
                 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL)
            SELECT x AS doc_id_a, y AS doc_id_b FROM p JOIN n AS m ON m.doc_id = x JOIN n ON n.doc_id = y WHERE p.c >= 0.5 * (m.c + n.c - p.c)""",
        "p5_classes": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
                 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
                 m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS k FROM s GROUP BY doc_id)),
                 r AS (SELECT s.* FROM s JOIN m USING (doc_id) WHERE m.doc_id = m.rep),
                 n AS (SELECT doc_id, count(*) AS c FROM r GROUP BY doc_id),
                 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM r a JOIN r b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
                 j AS (SELECT x, y FROM p JOIN n AS o ON o.doc_id = x JOIN n ON n.doc_id = y WHERE p.c >= 0.8 * (o.c + n.c - p.c)),
                 l AS (SELECT rep, count(*) AS links FROM (SELECT x AS rep FROM j UNION ALL SELECT y FROM j) GROUP BY rep)
            SELECT doc_id, rep, count(*) OVER (PARTITION BY rep) AS copies, coalesce(links, 0) AS links FROM m LEFT JOIN l USING (rep)""",
        "p7_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
                 t AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM test_items),
                 dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
                 tg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN tg USING (g)""",
    }
