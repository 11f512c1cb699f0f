import pytest
from pyspark.sql import functions as F

from tessera.operators.catalog import Catalog, classify, fully_covered, insert_missing, upsert
from tessera.operators.embedding import HashedNgramProvider
from tessera.operators.views import document_listing, profile_listing
from tessera.sources.files import scan


def sync(catalog, kb, root):
    return catalog.sync(kb, *scan(catalog.spark, str(root)))


def test_lifecycle(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "alpha.md").write_text("# Alpha\n" + "alpha text " * 20)
    (root / "beta.TXT").write_text("beta text " * 12)
    (root / "ignored.docx").write_text("x")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    kb = catalog.create(" Name ", str(root), 80, 10)
    assert catalog.knowledge_base(kb).name == "Name"
    with pytest.raises(ValueError):
        catalog.create("again", str(root) + "/", 80, 10)
    with pytest.raises(ValueError):
        catalog.create("bad", str(tmp_path), 80, 80)

    first = sync(catalog, kb, root)
    assert (first["added"], first["updated"], first["removed"]) == (2, 0, 0) and first["chunks_created"] == catalog.table("chunk").count() > 2
    again = sync(catalog, kb, root)
    assert (again["added"], again["unchanged"], again["chunks_created"]) == (0, 2, 0)

    provider = HashedNgramProvider(16)
    result = catalog.index(kb, provider, mock=True)
    assert result["status"] == "MOCK_INDEXED" and result["inserted"] == catalog.table("vector_record").count()
    assert {r.status for r in catalog.table("document").collect()} == {"MOCK_INDEXED"}
    listing = document_listing(catalog.table("document"), catalog.table("chunk"), catalog.table("vector_record")).collect()
    assert all(r.chunk_count == r.vector_count > 0 for r in listing)

    (root / "alpha.md").write_text("# Alpha\nshort now")
    changed = sync(catalog, kb, root)
    assert (changed["updated"], changed["unchanged"], changed["chunks_created"]) == (1, 1, 1)
    assert catalog.table("index_state").first().status == "STALE"
    assert {r.status for r in catalog.table("document").where(F.col("file_name") == "alpha.md").collect()} == {"WAITING_EMBEDDING"}
    left = catalog.table("vector_record").join(catalog.table("chunk").select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    assert left.select("document_id").distinct().count() == 1

    other = catalog.index(kb, HashedNgramProvider(8))
    states = {r.embedding_profile_id: (r.status, r.detail) for r in catalog.table("index_state").collect()}
    assert states[other["profile_id"]] == ("INDEXED", None) and states[result["profile_id"]] == ("STALE", "another embedding space was activated")
    rows = profile_listing(catalog.table("embedding_profile"), catalog.table("index_state"), catalog.table("vector_record"), kb).collect()
    assert {r.dimension for r in rows} == {8, 16}

    (root / "beta.TXT").unlink()
    (root / "corrupt.md").write_bytes(b"\xff\xfe\xfd")
    gone = sync(catalog, kb, root)
    assert gone["removed"] == 1 and gone["added"] == 0 and len(gone["errors"]) == 1
    (root / "alpha.md").write_bytes(b"\xff\xfe\xfd")
    kept = sync(catalog, kb, root)
    assert kept["removed"] == 0 and catalog.table("document").count() == 1

    assert catalog.delete_vectors(profile_id=other["profile_id"]) == 1
    document = catalog.table("document").first().id
    catalog.delete_document(document)
    assert catalog.table("chunk").count() == 0
    with pytest.raises(KeyError):
        catalog.delete_document(document)
    catalog.delete_knowledge_base(kb)
    assert all(catalog.table(t).count() == 0 for t in ("knowledge_base", "document", "chunk", "embedding_profile", "vector_record", "index_state"))


def test_ingest_is_all_or_nothing(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("some text")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    kb = catalog.create("n", str(root), 50, 0)
    sync(catalog, kb, root)
    chunk = catalog.table("chunk").first().id
    info = HashedNgramProvider(2).info
    frame = lambda *rows: spark.createDataFrame(list(rows), "chunk_id string, vector array<float>")
    for rows, why in (([], "empty"), ([(chunk, [1.0])], "dimension"), ([(chunk, [1.0, float("nan")])], "finite"), ([("x", [1.0, 2.0])], "part of"), ([(chunk, [1.0, 2.0]), ("x", [1.0, 2.0])], "part of")):
        with pytest.raises(ValueError, match=why):
            catalog.ingest(kb, info, frame(*rows))
    assert catalog.table("vector_record").count() == 0
    catalog.ingest(kb, info, frame((chunk, [1.0, 2.0])))
    catalog.ingest(kb, info, frame((chunk, [3.0, 4.0])))
    assert [r.vector for r in catalog.table("vector_record").collect()] == [[3.0, 4.0]] and catalog.table("embedding_profile").count() == 1


def test_merge_helpers(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, keep string, v int")
    new = spark.createDataFrame([(2, "x", 20), (3, "c", 30)], "k int, keep string, v int")
    assert sorted(map(tuple, upsert(old, new, ["k"], ["keep"]).collect())) == [(1, "a", 1), (2, "b", 20), (3, "c", 30)]
    assert sorted(map(tuple, insert_missing(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 30)]
    assert {r.k: r.change for r in classify(old, new, ["k"], "v").collect()} == {1: "removed", 2: "updated", 3: "added"}
    assert {r.k: r.change for r in classify(old, old, ["k"], "v", force=True).collect()} == {1: "updated", 2: "updated"}
    children = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "p int, c int")
    parents = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    assert [r.p for r in fully_covered(parents, children, spark.createDataFrame([(10,), (20,)], "c int"), "p", "c").collect()] == [2]


def test_search(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    one, two = (catalog.create(n, str(tmp_path / n), 40, 0) for n in ("one", "two"))
    ids = [catalog.add_document(one, f"{tmp_path}/one/{n}.md", text) for n, text in (("a", "red apples and pears"), ("b", "the price of volume is rising " * 3))]
    catalog.add_document(two, f"{tmp_path}/two/c.md", "red apples and pears elsewhere")
    assert catalog.add_document(one, f"{tmp_path}/one/a.md", "red apples and green pears") == ids[0] and catalog.table("document").count() == 3
    with pytest.raises(ValueError):
        catalog.add_document(one, "x.md", "  ")
    provider = HashedNgramProvider(32)
    questions = spark.createDataFrame([(1, "red apples"), (2, "volume price")], "query_id int, text string")
    with pytest.raises(KeyError, match="index it first"):
        catalog.search(one, questions, provider)
    profile, other = catalog.index(one, provider)["profile_id"], catalog.index(two, provider)["profile_id"]
    hits = catalog.search(one, questions, provider, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank) for r in hits] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert hits[0].document_id == ids[0] and hits[2].document_id == ids[1] and {r.file_name for r in hits} <= {"a.md", "b.md"}
    assert catalog.search(one, questions, provider, 0).count() == 2
    frame = lambda v: spark.createDataFrame([(1, v)], "query_id int, vector array<float>")
    with pytest.raises(ValueError, match="belong"):
        catalog.search_vectors(one, other, frame([1.0] * 32))
    for bad in ([], [1.0], None, [float("nan")] * 32):
        with pytest.raises(ValueError, match="no finite vector"):
            catalog.search_vectors(one, profile, frame(bad))
    with pytest.raises(ValueError, match="no text"):
        catalog.search(one, questions.withColumn("text", F.lit(" ")), provider)

    catalog.index(one, HashedNgramProvider(16))
    signals = spark.createDataFrame([(1, "price_surge", "red apples", ""), (2, None, "volume", "price")], "query_id int, signal string, name string, symbol string")
    found = catalog.recall(signals, provider, 3).collect()
    assert len(found) == len({(r.query_id, r.chunk_id) for r in found}) == 6 and {(r.query_id, r.recall_reason) for r in found} == {(1, "price_surge"), (2, "unknown")}

    before, chunk = catalog.table("chunk").count(), hits[0].chunk_id
    catalog.delete_chunk(chunk)
    assert catalog.table("chunk").count() == before - 1 and catalog.table("vector_record").where(F.col("chunk_id") == chunk).isEmpty()
    with pytest.raises(KeyError):
        catalog.delete_chunk(chunk)
    catalog.reset()
    assert [catalog.table(t).count() for t in ("document", "chunk", "vector_record", "knowledge_base")] == [0, 0, 0, 2]
    assert {r.status for r in catalog.table("index_state").collect()} == {"EMPTY"}
    assert catalog.search(one, questions, provider).count() == 0


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_change_replaces_the_buckets_that_it_touches(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"), buckets=8)
    kb = catalog.create("n", str(tmp_path), 40, 0)
    files = spark.range(60).select(F.format_string("/r/%d.md", "id").alias("file_path"), F.format_string("%d.md", "id").alias("file_name"), F.sha2(F.col("id").cast("string"), 256).alias("file_hash"), F.lit("md").alias("file_type"), F.repeat(F.concat(F.lit("some words "), F.col("id")), 9).alias("text"))
    assert catalog.sync(kb, files)["added"] == 60
    catalog.index(kb, HashedNgramProvider(8))
    catalog.index(kb, HashedNgramProvider(16))
    before, counts = files_of(tmp_path / "catalog"), {t: catalog.table(t).count() for t in ("document", "chunk", "vector_record")}
    assert counts["vector_record"] == 2 * counts["chunk"]
    row = catalog.table("document").where(F.col("file_name") == "7.md").first()
    catalog.delete_document(row.id)
    after = files_of(tmp_path / "catalog")
    gone = {f for f in before if f not in after}
    bucket = f"bucket={spark.range(1).select(catalog._bucket(F.lit(row.id))).first()[0]}/"
    assert gone and all(bucket in f for f in gone if f.split("/")[0] in counts) and len([f for f in gone if f.startswith("vector_record")]) == 2
    assert sum(f in after and after[f] == t for f, t in before.items()) > 0.8 * len(before)
    assert catalog.table("document").count() == 59 and catalog.table("chunk").where(F.col("document_id") == row.id).isEmpty()
    assert catalog.table("vector_record").count() == 2 * catalog.table("chunk").count()
    changed = files.withColumn("file_hash", F.when(F.col("file_name") == "9.md", "new").otherwise(F.col("file_hash"))).where("file_name <> '7.md'")
    then = files_of(tmp_path / "catalog")
    assert catalog.sync(kb, changed)["updated"] == 1
    now = files_of(tmp_path / "catalog")
    assert len({f.split("bucket=")[1].split("/")[0] for f in then if f not in now and "bucket=" in f}) == 1
    chunk = catalog.table("chunk").first().id
    assert catalog.delete_vectors(chunk_id=chunk) == 2 or catalog.table("vector_record").where(F.col("chunk_id") == chunk).isEmpty()
    catalog.delete_knowledge_base(kb)
    assert all(catalog.table(t).count() == 0 for t in counts)


def test_fixture(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"), buckets=4)
    profile = catalog.load_fixture(25, 3)
    rows = sorted(((int(r.chunk_id[1:]), r.vector) for r in catalog.table("vector_record").collect()))
    assert [i for i, _ in rows] == list(range(25)) and all(abs(x - (i + 1) * (j + 3) % 97 / 97) < 1e-6 for i, v in rows for j, x in enumerate(v))
    assert catalog.table("chunk").where("chunk_index = 24 AND text = 'benchmark chunk 24'").count() == 1
    query = spark.createDataFrame([(1, [0.5] * 3)], "query_id int, vector array<float>")
    assert catalog.search_vectors("kb", profile, query, 4).count() == 4
    with pytest.raises(ValueError):
        catalog.load_fixture(1, 1)


def test_neural_models():
    from tessera.operators.embedding import NEURAL_MODELS, neural_model

    assert {m: neural_model(m).dimension for m in NEURAL_MODELS} == {"bge-small": 512, "m3e-base": 768, "bge-m3": 1024}
    assert neural_model("bge-small").config_hash.startswith("st-bge-small") and neural_model("bge-m3").normalize


def test_indexing_embeds_each_chunk_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counting(HashedNgramProvider):
        def transform(self, df, text="text", output="vector", input_type="DOCUMENT"):
            def counted(batches):
                for batch in batches:
                    calls.add(batch.num_rows)
                    yield batch

            return super().transform(df.mapInArrow(counted, df.schema), text, output, input_type)

    catalog = Catalog(spark, str(tmp_path / "catalog"), buckets=4)
    kb = catalog.create("n", str(tmp_path), 20, 0)
    files = spark.createDataFrame([(f"/{i}.md", f"{i}.md", str(i), "md", f"text {i} " * 30) for i in range(6)], "file_path string, file_name string, file_hash string, file_type string, text string")
    made = catalog.sync(kb, files)["chunks_created"]
    assert catalog.index(kb, Counting(4))["inserted"] == made == calls.value
    assert {r.status for r in catalog.table("document").collect()} == {"INDEXED"}
    assert not [p.name for p in (tmp_path / "catalog").iterdir() if p.name.startswith("_")]
