import math
import re

import pytest
from pyspark.sql import functions as F

from corpusspark.functions.stemming import stem_word
from corpusspark.functions.text import folded_text
from corpusspark.operators import evaluate as E
from corpusspark.operators import retrieval as R


def corpus(spark):
    rows = [("a", [1.0, 0.0], ["birds", "coast-line"], "gulls over the pier, gulls"), ("b", [0.8, 0.6], ["maps"], "a recipe for bread"), ("c", [0.6, 0.8], ["Birds ", "sea"], "pier in fog"), ("d", [0.0, 1.0], None, None)]
    return spark.createDataFrame(rows, "id string, embedding array<float>, tags array<string>, text string")


def test_dense_order(spark):
    got = R.dense_topk(corpus(spark), [1.0, 0.0], 3, "id").orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and abs(got[0]["distance"]) < 1e-6


def test_batch_equals_single(spark):
    rows = spark.range(60).select("id", F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).alias("embedding"))
    batch = R.dense_topk_batch(rows.where("id % 20 = 0").select(F.col("id").alias("q"), "embedding"), rows, 5, "q", "id", block_bytes=40)
    assert batch.count() == 15
    for q in (0, 20, 40):
        single = [r["id"] for r in R.dense_topk(rows, [math.cos(q), math.sin(q)], 5, "id").orderBy("rank").collect()]
        assert [r["id"] for r in batch.where(f"q = {q}").orderBy("rank").collect()] == single
    assert R.dense_topk_batch(rows.where("false").select(F.col("id").alias("q"), "embedding"), rows, 5, "q", "id").count() == 0


def test_bm25(spark, tmp_path):
    queries = spark.createDataFrame([(1, "Gulls pier"), (2, "!?"), (3, None)], "q int, text string")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        R.LexicalIndex(spark, path)
    R.LexicalIndex.build(corpus(spark), "id", "text", path)
    got = R.LexicalIndex(spark, path).topk(queries, "q", "text", 10).orderBy("q", "rank").collect()
    assert [(r["q"], r["id"]) for r in got] == [(1, "a"), (1, "c")]


def test_bm25_against_a_loop(spark, tmp_path):
    texts = ["the café by the harbour", "harbours and cafes", "a walk", "walking walks to the harbour", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame([(1, "Cafe harbours"), (2, "walked")], "q int, text string")
    for stem in (False, True):
        words = [[stem_word(w) if stem else w for w in re.findall(r"[^\W_]+", folded_text(t))] for t in texts]
        length = sum(map(len, words)) / len(words)
        want = []
        for q, text in ((1, "cafe harbours"), (2, "walked")):
            scores = {}
            for w in [stem_word(x) if stem else x for x in text.split()]:
                df = sum(w in x for x in words)
                idf = math.log((len(words) - df + 0.5) / (df + 0.5))
                for k, x in enumerate(words):
                    if w in x:
                        scores[k] = scores.get(k, 0) + (idf if idf > 0 else 1e-6) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / length))
            want += [(q, k, round(v, 6)) for k, v in scores.items()]
        index = R.LexicalIndex.build(rows, "id", "text", str(tmp_path / f"index{stem}"), stem)
        got = [(r["q"], r["id"], r["score"]) for r in index.topk(queries, "q", "text", 10).collect()]
        assert sorted(got) == sorted(want)


def test_fusion_by_text(spark):
    dense = spark.createDataFrame([(1, "x1", "same", 1, 0.1), (1, "y", "other", 2, 0.2)], "q int, id string, t string, rank int, distance double")
    lexical = spark.createDataFrame([(1, "x2", "same", 1)], "q int, id string, t string, rank int")
    got = R.fuse(dense, lexical, "q", "t", id_col="id").orderBy("rank").collect()
    assert [(r["id"], r["lexical_rank"]) for r in got] == [("x1", 1), ("y", None)]


def ranked(spark, ids, name="distance"):
    rows = [(1, x, k, k / 10) for k, x in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "q int, id string, rank int, distance double")


def test_fusion(spark):
    dense, lexical = ranked(spark, "abc"), ranked(spark, "cd")
    order = lambda w: [r["id"] for r in R.fuse(dense, lexical, "q", "id", w).orderBy("rank").collect()]
    assert order((1.0, 1.0)) == ["c", "a", "b", "d"]
    assert order((0.0, 1.0)) == ["a", "b", "c", "d"]
    assert order((1.0, 0.0))[:2] == ["c", "d"]
    assert R.fuse(dense, lexical, "q", "id").where("id = 'c'").first()["distance"] == 0.3


def test_tags_keep_gaps(spark):
    rows = corpus(spark).withColumn("rank", F.expr("ascii(id) - 96"))
    assert [r["rank"] for r in R.with_tags(rows, [" BIRDS "]).orderBy("rank").collect()] == [1, 3]
    assert R.with_tags(rows, ["coast"]).count() == 0 and R.with_tags(rows, [" "]).count() == 4


def test_pool_width():
    assert (R.pool_width(5, rerank=True), R.pool_width(30, rerank=True), R.pool_width(8, tags=True), R.pool_width(8, hybrid=True), R.pool_width(8)) == (20, 30, 200, 50, 8)


def test_search_and_rerank(spark):
    got = R.search(corpus(spark), [1.0, 0.0], 2, "id", rerank=lambda pool: F.when(F.col("id") == "c", 1.0).otherwise(0.0)).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [("c", 1), ("a", 2)]
    fused = R.search(corpus(spark), [1.0, 0.0], 1, "id", lexical=ranked(spark, "d").drop("q", "distance"), weights=(10.0, 1.0)).collect()
    assert fused[0]["id"] == "d"
    assert [r["id"] for r in R.search(corpus(spark), [1.0, 0.0], 3, "id", tags=["birds"]).collect()] == ["a", "c"]


def test_where(spark):
    df = spark.createDataFrame([("x", None), ("x", "y")], "a string, b string")
    assert df.where(R.where(a="x", b=None)).count() == 2 and df.where(R.where(a="x", b="y")).count() == 1


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, "v"), (7, "v"), (3, "r"), (None, "r")], "hit_rank int, kind string")
    got = {r["kind"]: r for r in E.metrics_with_total(ranks, "kind").collect()}["overall"]
    assert (got["n"], got["recall_at_5"], got["recall_at_10"], got["mrr"]) == (4, 0.5, 0.75, round((1 + 1 / 7 + 1 / 3) / 4, 4))


def test_hits(spark):
    ranks = spark.createDataFrame([(1, 1, "Other", "x.md"), (1, 2, "K3s notes", "y.md")], "query_id int, rank int, title string, file_path string")
    golden = spark.createDataFrame([(1, ["k3s"], "vault"), (2, ["z"], "vault")], "query_id int, expected array<string>, query_kind string")
    assert {r["query_id"]: r["hit_rank"] for r in E.hit_ranks(ranks, golden).collect()} == {1: 2, 2: None}


def test_prompt(spark):
    rows = spark.createDataFrame([(1, 2, "B", "b.md", "text b", "why"), (1, 1, "A", "a.md", "text a", "why")], "q int, rank int, title string, path string, text string, question string")
    got = R.prompt(rows, F.col("question"), ["q"], "title", "path", "text").first()
    assert got["prompt"] == "[1] A — a.md\ntext a\n\n[2] B — b.md\ntext b\n\nQuestion: why" and got["sources"] == 2
