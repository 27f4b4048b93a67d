import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusspark.llm import packing


def test_best_fill_against_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        left = {rng.randint(1, 30): rng.randint(1, 2) for _ in range(5)}
        gap = rng.randint(1, 60)
        items = [s for s, c in left.items() for _ in range(c)]
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= gap)
        chosen = packing.best_fill(gap, left)
        assert sum(s * c for s, c in chosen.items()) == best and all(c <= left[s] for s, c in chosen.items())


def test_plan_uses_everything_once():
    rng = random.Random(4)
    histogram = {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(300)}
    used = Counter()
    for pattern, repeats in packing.plan_patterns(histogram, 2048):
        assert sum(s * c for s, c in pattern.items()) <= 2048 and repeats > 0
        used.update({s: c * repeats for s, c in pattern.items()})
    assert used == Counter(histogram)


def check(df, packed, capacity=2048):
    rows = packed.collect()
    loads = Counter()
    for r in rows:
        loads[r["container"]] += r["size"]
    assert not loads or (max(loads.values()) <= capacity and sorted(loads) == list(range(max(loads) + 1)))
    return rows, loads


def test_documents(spark, docs):
    rows, loads = check(docs, packing.pack(docs))
    assert sum(loads.values()) == docs.agg(F.sum("n_tokens")).first()[0]
    per = Counter(r["doc_id"] for r in rows)
    assert all(per[r["doc_id"]] == 1 for r in docs.where("n_tokens <= 2048").select("doc_id").collect())
    report = packing.fill_report(packing.pack(docs)).first()
    assert report["containers"] <= report["least_possible"] * 1.02 + 1


def test_messy(spark, messy, docs):
    rows, _ = check(messy, packing.pack(messy))
    assert len(rows) >= messy.count()
    counted = packing.pack(spark.createDataFrame([(1, "a b, c", None), (2, None, None), (3, None, -5)], "doc_id long, text string, n_tokens int")).collect()
    assert {r["doc_id"]: r["size"] for r in counted} == {1: 4, 2: 0, 3: 0}
    assert packing.pack(docs.where("false")).count() == 0


def test_hot_length(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 50 + 1).cast("int").alias("n_tokens"))
    rows, loads = check(df, packing.pack(df))
    assert len(rows) == 3000 and len({(r["doc_id"], r["part_no"]) for r in rows}) == 3000
    assert len(loads) <= 510  # 500 pairs of the hot length, and all else fits beside them
