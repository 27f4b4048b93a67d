import pytest
from pyspark.sql import functions as F

from corpusspark.llm import leakage

PASSAGE = "Under the usual convention, any coroutine which deprecates twice must surrender its generic recursion before noon — or Überfluß follows it."


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "too short to be found"), (3, None), (4, PASSAGE.upper())], "item_id long, passage string")


@pytest.fixture(scope="module")
def corpus(spark):
    words = leakage.words_of(PASSAGE)
    rows = [(1, "Intro. " + PASSAGE + " Outro."), (2, "x " + "; ".join(words[3:15]) + " y"), (3, " ".join(words[3:14])), (4, " ".join([*words[:8], "between", *words[8:]])), (5, None), (6, ""), (1, "Intro. " + PASSAGE + " Outro."), (7, "\n".join(words))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_found(corpus, items):
    spans = leakage.leaked_spans(corpus, items)
    assert sorted(map(tuple, leakage.leaks(spans).collect())) == [(1, 1), (1, 4), (2, 1), (2, 4), (4, 1), (7, 1), (7, 4)]  # in capitals the last word is another one
    assert {r["n_words"] for r in spans.where("doc_id = 2").collect()} == {12}


def test_join_gives_the_same(corpus, items, docs, spark, sf_dir):
    for d, i in ((corpus, items), (docs, spark.read.parquet(f"{sf_dir}/test_items.parquet"))):
        a, b = leakage.leaked_spans(d, i), leakage.leaked_spans(d, i, broadcast_words=0)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_brute_force(docs, spark, sf_dir):
    tests = spark.read.parquet(f"{sf_dir}/test_items.parquet")
    known = [(r["item_id"], {" ".join(w[k : k + 12]) for w in [leakage.words_of(r["passage"])] for k in range(len(w) - 11)}) for r in tests.collect()]
    want = set()
    for r in docs.select("doc_id", "text").collect():
        text = " ".join(leakage.words_of(r["text"]))
        want |= {(r["doc_id"], item) for item, grams in known if any(f" {g} " in f" {text} " for g in grams)}
    assert {tuple(r) for r in leakage.leaks(leakage.leaked_spans(docs, tests)).collect()} == want and want


def test_cleaned(corpus, items):
    got = {r["doc_id"]: r for r in leakage.cleaned(corpus, leakage.leaked_spans(corpus, items), drop_share=0.95).collect()}
    assert got[1]["action"] == "cut" and got[1]["text"].replace(" ", "") == "Intro..Outro." and got[7]["action"] == "drop" and got[7]["text"] is None


def test_messy(messy, items, docs):
    assert leakage.leaked_spans(messy, items).count() == 0
    assert leakage.leaked_spans(docs.where("false"), items).count() == 0
    assert leakage.leaked_spans(docs, items.where("false")).count() == 0
    assert leakage.leaked_spans(messy, messy.select(F.col("doc_id").alias("item_id"), F.col("text").alias("passage"))).where("doc_id = 8").count() == 1
