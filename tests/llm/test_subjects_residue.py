"""Held-out accuracy on the small tables; the labels themselves are partly wrong."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusspark.llm import residue, subjects


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_subjects_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels, topics = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "topic_labels", "topics"))
    labels = labels.join(docs.where("lang = 'en'").select("doc_id"), "doc_id")
    held = labels.where("doc_id % 2 = 1").select("doc_id", "topic").distinct().cache()
    some = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").cache()
    found = subjects.subjects(some, labels.where("doc_id % 2 = 0"), topics).cache()
    hits = held.join(found, ["doc_id", "topic"]).count()
    assert hits >= 0.8 * held.count()  # about a tenth of the labels are wrong
    assert found.count() <= 1.6 * some.count()


def test_subjects_edges(spark, messy, docs, sf_dir):
    labels, topics = spark.read.parquet(f"{sf_dir}/topic_labels.parquet"), spark.read.parquet(f"{sf_dir}/topics.parquet")
    assert subjects.subjects(messy, labels.where("false"), topics).count() == 0
    assert subjects.subjects(docs.where("false"), labels, topics).count() == 0
    assert subjects.subjects(messy, labels, topics).count() >= 0
    assert subjects.subjects(docs, labels, topics.where("false")).count() == 0


def test_residue_has_no_subject(spark, larger):
    folder = "/root/testdata/sf0.01"
    labels, topics = spark.read.parquet(f"{folder}/topic_labels.parquet"), spark.read.parquet(f"{folder}/topics.parquet")
    without = subjects.subjects(larger, labels, topics)
    bad = residue.residue_records(larger).where("residue").select("doc_id")
    assert without.join(bad, "doc_id").count() == 0
    every = subjects.subjects(larger, labels, topics, skip_residue=False)
    assert without.exceptAll(every).count() == 0 and every.join(bad, "doc_id", "left_anti").exceptAll(without).count() == 0


def test_all_labels_count(spark):
    """A subject is learned from its labels wherever their ids come in the order of hashes, behind 8,200 other labels as well."""
    ids = [r[0] for r in spark.range(8_300).orderBy(F.xxhash64("id")).collect()]
    wording = {"birds": "heron wing nest feather plumage beak flock migration egg song", "bread": "dough yeast flour oven crust knead loaf rye starter proof"}
    pick = random.Random(1)
    text = lambda topic: " ".join(" ".join(["The", *pick.choices(wording[topic].split(), k=8)]) + "." for _ in range(3))
    given = [(k, "bread" if at >= 8_200 else "birds") for at, k in enumerate(ids)]
    new = [(10_000 + k, "birds" if k % 2 else "bread") for k in range(20)]
    docs = spark.createDataFrame([(k, text(t)) for k, t in given + new], "doc_id long, text string")
    topics = spark.createDataFrame([(t,) for t in wording], "topic string")
    found = subjects.subjects(docs, spark.createDataFrame(given, "doc_id long, topic string"), topics, skip_residue=False).where("doc_id >= 10000 and topic = 'bread'")
    assert {tuple(r) for r in found.collect()} == {n for n in new if n[1] == "bread"}


def test_counts_do_not_depend_on_the_tasks(spark, larger):
    """All records count in the fits, and their sums are the same however they are spread over tasks."""
    folder = "/root/testdata/sf0.01"
    labels, topics = spark.read.parquet(f"{folder}/topic_labels.parquet"), spark.read.parquet(f"{folder}/topics.parquet")
    one, many = (subjects.subjects(larger.repartition(n), labels, topics).cache() for n in (1, 7))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_fit_over_all_records(spark, larger):
    """The sums of the tasks give the weights that the driver gets from all records, and the short way to a verdict gives the long way's."""
    texts = [r[0] for r in larger.where("text is not null").select("text").collect()]
    weights = residue.fit(larger, sample=10**9)

    def read(batches):
        found = residue.WholeEvidence()
        for batch in batches:
            yield table(found.rows(batch.column(0).to_pylist()))
        yield table(found.rest())

    table = lambda rows: pa.Table.from_pylist([dict(zip(("kind", "_id", "values", "counts"), r)) for r in rows], kinds).combine_chunks().to_batches()[0]
    kinds = pa.schema([("kind", pa.string()), ("_id", pa.int64()), ("values", pa.binary()), ("counts", pa.binary())])
    evidence = larger.where("text is not null").select("text").repartition(5).mapInArrow(read, "kind string, _id long, values binary, counts binary").cache()
    assert np.allclose(residue.fitted_whole(evidence), weights, atol=1e-4)
    scorer = residue.Scorer(weights)
    assert (scorer.residue(texts) == scorer(texts)[0]).all() and scorer.residue(texts).any()


def test_margins_follow_the_labels():
    labels = np.zeros((400, 2), bool)
    labels[:200, 0] = labels[200:, 1] = True
    low = np.where(labels, 6, 0)
    low[:200, 1] = 3  # below the third candidate, texts of the first subject get the second as well
    tables = [(low if m < 2.0 else np.where(labels, 6, 0), labels) for m in subjects.MARGINS]
    margins = subjects._calibrated(tables, 0.25)
    assert (margins >= 2.0).all() and len(margins) == 2


def test_trusted_wording_outside_the_sample(spark, larger):
    """A page whose wording only one record has is found by its marks, however small the sample is."""
    extra = spark.createDataFrame([(900201, "HTTP/1.1 503 zzqx\n{{ qqvv }} {{ wwkk }}"), (900202, "{{ zeta.omicron.kappa }}")], "doc_id long, text string")
    df = larger.select("doc_id", "text").unionByName(extra)
    got = residue.residue_records(df, sample=200).where("doc_id > 900200 and residue").count()
    assert got == 2


def test_residue(spark, larger):
    planted = [
        (900001, "{{title}}\n\n{{ body }}\n- {{summary}}"), (900002, "404 Not Found\nThe requested URL /a/b was not found on this server."), (900003, "Please turn on JavaScript in your browser and reload the page."),
        (900004, "Lorem ipsum dolor sit amet.\nConsectetur adipiscing elit tempor."), (900005, "Menu\nSearch\n# {{title}}\n%%BODY%%"),
    ]
    real = [
        (900101, "The page shows a 404 Not Found answer when the result is missing, and the chapter explains how to log it. It took 23 days before the honeypot and its malicious token were modest again. Compare the local defendant of Rowan with the liable ordinance from page 180."),
        (900102, "Use {{ .Values.author }} in the chart, and give it a default in the values file. Without ephemeral rollout, neither the deployment nor the spare replica can be called early."),
    ]
    df = larger.select("doc_id", "text").unionByName(spark.createDataFrame(planted + real, "doc_id long, text string"))
    got = {r["doc_id"]: r["residue"] for r in residue.residue_records(df).where("doc_id > 900000").collect()}
    assert all(got[d] for d, _ in planted) and not any(got[d] for d, _ in real)


def test_residue_edges(messy, docs):
    got = residue.residue_records(messy).collect()
    assert len(got) == messy.where("text is not null").count() and not any(r["residue"] for r in got)
    assert residue.residue_records(docs.where("false")).count() == 0


PIECES = [*"abAZkKsS09  \n\n\t\r.,!?--''\"()[]{}<>$%#@_~=|*/:&;…’”•–­²éßİıſKΣσ\x00\x1c😀", "{{x}}", "${a}", "<%x%>", "%%AB%%", "[Name]", "TODO: fill in a", "404 not found", "Page introuvable", "<your name>", "ſcripts", "HTTP/1.1 503", "\n- item\n", "\n12. x", "\n|a|", "a-b's", "---"]


def test_splitting_finds_what_the_patterns_find(larger):
    """Texts of ASCII are split at spaces, and passages without a hint of a mark are not searched: with the same tokens and verdicts."""
    pick = random.Random(7)
    plain = [p for p in PIECES if p.isascii()]
    texts = ["".join(pick.choices(plain if k % 3 else PIECES, k=pick.randint(0, 80))) for k in range(20_000)] + [r[0] for r in larger.where("text is not null").select("text").limit(300).collect()]
    ids = residue._Ids()
    for text in texts:
        assert subjects._found(text) == [t.lower() if t[0].isalpha() else subjects.STOP for t in subjects._TOKEN.findall(text)]
        assert [*map(ids.__getitem__, residue._tokens(text))] == [*map(ids.__getitem__, residue._TOKEN.findall(text))]
        words = residue.re.findall(r"[^\W\d_]{4,}", text.lower())
        filler = bool(words) and 2 * sum(w in residue.FILLER for w in words) >= len(words)
        assert residue.is_trusted(text) == (bool(residue.TRUSTED.search(text)) or filler)


def test_plain_texts_skip_the_slow_patterns(monkeypatch):
    """A text of ASCII without a hint of a mark is neither searched for marks nor cut into tokens by a pattern, in the fit and in the scores."""

    class Slow:
        def __getattr__(self, name):
            raise AssertionError("a slow pattern reads a plain text")

    text = "The heron keeps its nest in the reeds - it's well-known there. Its wings (a span of 1.8 metres) are grey.\n\n" * 3
    want, trusted = subjects._tokens(text), residue.is_trusted_record(text)
    for module, name in ((subjects, "_TOKEN"), (subjects, "_HEADING"), (residue, "_TOKEN"), (residue, "_VARIABLE"), (residue, "TRUSTED")):
        monkeypatch.setattr(module, name, Slow())
    found = residue.WholeEvidence()
    assert len(list(found.rows([text]))) == 1 and found.number == {"trusted": 0, "every": 1} and not trusted
    assert subjects._tokens(text) == want and want.count(subjects.STOP) == 9
    assert not residue.Scorer(np.ones(residue.FEATURES, np.float32)).residue([text]).any()
