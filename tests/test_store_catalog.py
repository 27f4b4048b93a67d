import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusspark.operators import catalog, store
from corpusspark.plans import registry
from corpusspark.sources import files
from corpusspark.streaming import ingest

SCHEMA = "chunk_id string, domain string, file_path string"


def test_refresh_counts_and_guard(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        c.read()
    rows = spark.createDataFrame([("a", "x", "p"), ("b", "x", "q")], SCHEMA)
    assert c.refresh(rows, ["domain"], 2)["new"] == 2
    assert c.refresh(rows, ["domain"], 2) | {"preserved": 0} == {"new": 0, "updated": 0, "same": 2, "stale": 0, "preserved": 0}
    changed = rows.withColumn("domain", F.lit(None).cast("string"))
    assert c.refresh(changed, ["domain"], 2)["updated"] == 2
    with pytest.raises(store.NothingFoundError, match="0 files"):
        c.refresh(rows.where("false"), ["domain"], 0)
    assert c.count() == 2
    failed = spark.createDataFrame([("p",)], "file_path string")
    got = c.refresh(rows.where("false"), ["domain"], 1, failed)
    assert (got["preserved"], got["stale"]) == (1, 1) and [r[0] for r in c.read().select("chunk_id").collect()] == ["a"]
    with pytest.raises(ValueError):
        c.drop(active=True)
    assert c.drop() == 1 and c.version() == 0


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/chunks.parquet").repartition(5).write.parquet(source)
    c = store.Collection(spark, str(tmp_path / "c"))
    ingest.ingest(spark, source, c, str(tmp_path / "progress"), files_per_batch=2)
    assert c.count() == spark.read.parquet(source).select("chunk_id").distinct().count()


def test_similar_pairs_against_brute_force(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:58], "x", "y"]), " ".join(words[30:]), "too short", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = catalog.similar_pairs(df)
    assert [(r["a"], r["b"], round(r["jaccard"], 4)) for r in pairs.collect()] == [(0, 2, round(54 / 58, 4))]
    assert sorted((r["rep"], r["id"]) for r in members.collect()) == [(0, 0), (0, 1), (2, 2), (3, 3)]
    assert catalog.similar_pairs(df.where("false"))[0].count() == 0


def test_similar_pairs_of_shared_passages(spark, monkeypatch):
    """Texts that share much, of many lengths, against sets in Python; what is broadcast are ids, never shingles, whose number grows with the texts."""
    sent, real = [], F.broadcast
    monkeypatch.setattr(catalog.F, "broadcast", lambda df: (sent.append(df.columns), real(df))[1])
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(400)]
    texts = []
    for k in range(60):
        base = passage[: rng.randrange(20, 400)] + [f"t{k // 3}x{j}" for j in range(rng.choice((10, 300, 3000)))]
        texts.append(" ".join(w if rng.random() > 0.01 else "Changed" for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    pairs, members = catalog.similar_pairs(spark.createDataFrame([*enumerate(texts), (None, "a text without an id at all")], "doc_id long, text string").repartition(3))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    assert sent and not [c for c in sent if "item" in c] and members.count() == 61


def test_similar_pairs_at_the_threshold(spark):
    """0.55 * 100 is above 55 in floating point, 55 of 100 shingles are a similarity of 0.55 all the same."""
    words = [f"w{k}" for k in range(104)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:59])), (3, " ".join(words[45:103]))], "doc_id long, text string")
    assert [tuple(r) for r in catalog.similar_pairs(df, 0.55)[0].collect()] == [(1, 2, 0.55)]


def test_duplicate_report_has_the_pairs_of_copies(spark, tmp_path, monkeypatch):
    """Every pair at the threshold is in the report: copies of a text with each other, and with each similar text; a large class is spread over several keys."""
    monkeypatch.setattr(catalog, "PART", 3, raising=False)
    words = [f"w{k}" for k in range(60)]
    one, two, other = " ".join(words), " ".join([*words[:58], "x", "y"]), " ".join(f"v{k}" for k in range(9))
    texts = [one, two, one, "too short", other, one.upper(), two, None, other, "", "too short", *[one] * 6, " ".join(words[30:])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").lower().split() for t in texts)]
    want = [(i, j, round(len(x & y) / len(x | y), 6)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) >= 0.8 * len(x | y) > 0]
    spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, isbn string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.queries()["duplicate_report"](spark, str(tmp_path)).collect()]
    assert got == sorted([(*w, False) for w in want], key=lambda r: (-r[2], r[0], r[1])) and (0, 2, 1.0) in want and (2, 6, round(54 / 58, 6)) in want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(con.execute(registry.oracle_sql()["duplicate_report"]).fetchall()) == sorted(got)


def test_full_text(spark):
    df = spark.createDataFrame([(1, "alpha", "x"), (2, "beta", "gamma"), (3, "alpha beta", "gamma"), (4, "delta", "Álpha")], "id int, title string, text string")
    ids = lambda q: [r[0] for r in df.where(catalog.full_text(df, q, ["title", "text"])).select("id").orderBy("id").collect()]
    assert ids("alpha OR beta AND gamma") == [1, 2, 3, 4] and ids("x OR beta AND gamma") == [1, 2, 3]
    assert ids("beta AND (alpha OR zeta)") == [3] and ids("alph*") == [1, 3, 4] and ids("beta NOT alpha") == [2]
    assert ids('"beta gamma"') == [] and ids('"alpha beta"') == [3] and ids("alpha gamma") == [3]
    assert ids("") == [] and ids("alpha (") == [1, 3, 4] and ids("al/pha") == []


def test_catalog_search(spark):
    rows = [("a", "One", ["sea"], "tide " * 3, "x"), ("b", "Two", None, "tide and a long text of other words that go on and on", "x"), ("c", "Tide", ["sea"], "other", "y"), ("d", None, None, "nothing", "x"), ("e", "Tides", None, None, "x")]
    df = spark.createDataFrame(rows + [(f"f{k}", "Filler", None, "words", "z") for k in range(9)], "file_name string, title string, tags array<string>, text string, source string")
    ids = lambda q, **kw: [r["file_name"] for r in catalog.search_catalog(df, q, ["title", "tags", "text"], **kw).collect()]
    assert ids("tide")[0] == "a" and set(ids("tide")) == {"a", "b", "c"} and ids("tide", source="y") == ["c"] and ids("sea") == ["c", "a"] and ids("tide", limit=1) == ["a"]
    assert set(ids("tides", stem=True)) == {"a", "b", "c", "e"} and ids("", source="x", limit=2) == ["a", "e"]


def test_duplicate_report_and_union(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.95)], "a long, b long, jaccard double")
    isbns = spark.createDataFrame([(1, "x"), (2, "x"), (7, "x"), (5, None), (6, "y")], "id long, isbn string")
    assert [tuple(r) for r in catalog.duplicate_report(pairs, isbns).collect()] == [(1, 2, 0.9, True), (1, 7, None, True), (3, 4, 0.95, False)]
    one, two = spark.createDataFrame([("k", "old"), ("l", "only")], "id string, title string"), spark.createDataFrame([("k", "new", 3)], "id string, title string, pages int")
    assert sorted((r["id"], r["title"], r["pages"]) for r in catalog.loaded_documents(one, two).collect()) == [("k", "new", 3), ("l", "only", None)]


def test_extractions_by_time(spark):
    rows = spark.createDataFrame([("f", "2024-03-01T10:00:00Z", 5), ("f", "2024-03-02 09:00:00", 1), ("f", "01.01.2020", 9)], "file_name string, extracted_at string, total_chars long")
    assert catalog.last_extractions(rows).first()["total_chars"] == 1


def test_upsert_rewrites_only_its_buckets(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"), buckets=8)
    schema = "chunk_id string, at long, body string"
    c.commit(spark.createDataFrame([(f"k{k}", 1, "old") for k in range(40)], schema))
    before = c._folders(1)
    c.upsert(spark.createDataFrame([("k3", 2, "new"), ("k3", 3, "newest"), ("k4", 0, "late")], schema), "at")
    after = c._folders(2)
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2
    got = {r["chunk_id"]: r["body"] for r in c.read().collect()}
    assert len(got) == 40 and got["k3"] == "newest" and got["k4"] == "old"
    keys = spark.createDataFrame([("k1",), ("zz",), ("k1",)], "chunk_id string")
    assert [r[0] for r in c.existing_ids(keys).collect()] == ["k1"] and c.snapshot("at").columns == ["chunk_id", "at"]
    for at in range(5, 9):
        c.upsert(spark.createDataFrame([("k3", at, f"v{at}")], schema), "at")
    assert c._versions() == [5, 6] and c.read().where("chunk_id = 'k3'").first()["body"] == "v8" and c.count() == 40
    assert c.delete(keys) == 7 and c.count() == 39


def test_collection_query(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"))
    c.commit(spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "x"), ("c", [0.8, 0.6], "y")], "chunk_id string, embedding array<float>, kind string"))
    assert [r["chunk_id"] for r in c.query([1.0, 0.0], 2).orderBy("rank").collect()] == ["a", "c"]
    assert [r["chunk_id"] for r in c.query([1.0, 0.0], 2, F.col("kind") == "x").orderBy("rank").collect()] == ["a", "b"]


def test_unmatched_and_gate(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "file_name string"), spark.createDataFrame([("y",), ("z",)], "file_name string")
    assert sorted(map(tuple, catalog.unmatched(a, b).collect())) == [("x", "no text"), ("z", "no inventory")]
    rows = spark.createDataFrame([("good text", False, 0), ("", False, 0), (None, None, None), ("x", True, 0), ("short", None, None)], "t string, u boolean, c long")
    assert [r[0] for r in rows.select(files.usable_extraction(F.col("t"), F.col("u"), F.col("c"))).collect()] == [True, False, False, False, True]


def test_notes(spark, tmp_path):
    folder = tmp_path / "Knowledge" / "Garden" / "Herbs & Spices"
    folder.mkdir(parents=True)
    (folder / "mint.md").write_text("---\ntitle: On mint\ntags:\n  - '#Green'\n  - Tea\n---\n# Growing ##\nmint spreads below [[Soil|the ground]]\n\n## Related Topics\n- [[Water]]\n")
    (folder / "Old index.md").write_text("left out")
    (folder / "broken.md").write_text("---\ntitle: x\nno field at all\n---\ntext")
    rows = files.notes(spark, str(tmp_path)).where(~files.excluded("path", ["Drafts"], [], ["Old *.md"]))
    got = files.note_chunks(rows).collect()
    assert len(got) == 1 and got[0]["document"] == "mint spreads below the ground" and got[0]["wikilinks"] == ["Soil", "Water"] and got[0]["subdomain"] == "Herbs & Spices"
    assert got[0]["tags"] == ["green", "tea"] and got[0]["title"] == "On mint" and got[0]["heading"] == "Growing"
    assert [tuple(r) for r in files.unreadable_notes(rows).collect()] == [("Knowledge/Garden/Herbs & Spices/broken.md", "no field at all")]


def test_json_documents_and_golden(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"file_name": "a.pdf", "title": "A", "text": "## One\\nsome text that is long enough to be kept here\\n## Two\\nmore"}')
    (tmp_path / "b.json").write_text('{"file_name": "b.pdf", "text": "tiny"}')
    (tmp_path / "c.json").write_text("{broken")
    docs = files.extracted_documents(spark, str(tmp_path / "*.json"))
    chunks = files.document_chunks(docs.where("_corrupt_record is null")).collect()
    assert sorted(c["heading"] for c in chunks) == ["One", "Two"]
    assert docs.cache().where("_corrupt_record is not null").count() == 1
    (tmp_path / "g.jsonl").write_text('# comment\n\n{"query": "q", "expected": ["x"], "kind": "vault"}\n')
    assert [tuple(r) for r in files.golden_queries(spark, str(tmp_path / "g.jsonl")).collect()] == [("q", ["x"], "vault")]


def test_pages(spark):
    pages = spark.createDataFrame([("f", 1, "a" * 700), ("f", 2, "tiny"), ("f", 3, "b" * 700), ("f", 4, "c" * 50)], "path string, page_no int, text string")
    got = files.page_blocks(pages).orderBy("first_page").collect()
    assert [(r["first_page"], r["last_page"]) for r in got] == [(1, 3), (4, 4)]


def test_page_chunks_and_listing(spark, tmp_path):
    pages = spark.createDataFrame([("f", 1, "a" * 700), ("f", 3, "b" * 700), ("f", 4, "c" * 50)], "path string, page_no int, text string")
    got = files.page_chunks(pages).orderBy("first_page", "chunk_no").collect()
    assert [r["heading"] for r in got] == ["p.1-3", "p.1-3", "p.4"] and all(len(r["document"]) <= 1200 for r in got) and len({r["chunk_id"] for r in got}) == 3
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.pdf").write_bytes(b"%PDF")
    (tmp_path / "two.txt").write_text("no")
    assert [(r["path"][-7:], r["bytes"]) for r in files.listed_files(spark, str(tmp_path)).collect()] == [("one.pdf", 4)]


def test_extraction_manifest(spark):
    listing = spark.createDataFrame([("a", "pdf"), ("b", "PDF"), ("c", "pdf"), ("d", "zip"), ("e", None), ("a", "pdf")], "file_name string, file_type string")
    runs = spark.createDataFrame([("a", True, 0, 5), ("a", False, 0, 9), ("b", True, 0, 9)], "file_name string, ocr_used boolean, ocr_chars long, total_chars long")
    assert {r["file_name"]: r["status"] for r in files.extraction_manifest(listing, runs).collect()} == {"a": "cached", "b": "error", "c": "missing", "d": "skipped", "e": "skipped"}


def test_file_types(spark):
    rows = [("a.md", b"x"), ("b.bin", b"%PDF-1.7"), ("c.bin", b"PK\x03\x04....mimetypeapplication/epub+zip"), ("d.bin", b"zz")]
    df = spark.createDataFrame(rows, "name string, head binary")
    assert [r[0] for r in df.select(files.file_type("name", "head")).collect()] == ["md", "pdf", "epub", "unknown"]


def test_metadata_update_and_delete(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "all" / "one"))
    c.commit(spark.createDataFrame([("a", "x", "p"), ("b", "x", "q")], SCHEMA))
    c.update_metadata(spark.createDataFrame([("a", "Platform")], "chunk_id string, domain string"))
    assert sorted(map(tuple, c.read().collect())) == [("a", "Platform", "p"), ("b", "x", "q")]
    c.delete(spark.createDataFrame([("b",)], "chunk_id string"))
    assert c.count() == 1 and store.Collection.names(spark, str(tmp_path / "all")) == ["one"]


def test_epub_order(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", '<package><item href="two.html" id="t"/><item id="o" href="one.html"/><spine><itemref idref="o"/><itemref idref="t"/></spine></package>')
        z.writestr("OPS/one.html", "<p>1</p>")
        z.writestr("OPS/two.html", "<p>2</p>")
    (tmp_path / "b.epub").write_bytes(b"not a zip")
    got = files.epub_texts(spark, str(tmp_path)).orderBy("path", "part_no").collect()
    assert [(r["part_no"], r["html"]) for r in got[:2]] == [(0, "<p>1</p>"), (1, "<p>2</p>")] and got[2]["error"]


def test_topic_links(spark):
    docs = spark.createDataFrame([("A & B",), ("C",), (None,)], "primary_topic string")
    notes = spark.createDataFrame([("Topic MOC - A and B",)], "note string")
    assert sorted(r["link"] for r in catalog.topic_links(docs, notes).collect()) == ["[[Topic MOC - A and B|A & B]]", "`C`"]
