import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats, text, vectors
from tessera.operators import benchmarks, chunking, embedding, evaluation, rag, retrieval
from tessera.sources import files


def column(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, "一二三四五六七八九十"), (2, ""), (3, "ab"), (4, "a          b"), (5, None), (6, "🙂🙃🙂🙃")], "doc_id int, text string")
    got = {}
    for r in chunking.chunk_fixed(docs, 6, 2).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {1: ["一二三四五六", "五六七八九十"], 3: ["ab"], 4: ["a", "b"], 6: ["🙂🙃🙂🙃"]}
    with pytest.raises(ValueError):
        chunking.chunk_fixed(docs, 5, 5)
    assert chunking.chunk_fixed(docs, 3, 3, strict=False).where("doc_id = 3").count() == 1


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# one\nbody\n  ## two\nmore")], "doc_id int, text string")
    assert [r.content for r in chunking.chunk_sections(docs, 100).orderBy("chunk_index").collect()] == ["intro", "# one\nbody", "## two\nmore"]
    assert chunking.header_sections("x\n#h\n\n#k\ny") == [("", "x\n"), ("#h", "\n"), ("#k", "y\n")]


def test_structure_pieces():
    short, long = "s" * 20, "p" * 90
    assert chunking.structure_pieces(f"# a\n{short}\n# b\n{short}", 100, 50) == [("a", f"# a\n{short}\n\n# b\n{short}")]
    pieces = chunking.structure_pieces(f"# a\n{long}\n\n{long}\n\n{long}", 100, 50)
    assert [c for _, c in pieces] == [f"# a\n{long}", long, long] and {s for s, _ in pieces} == {"a"}
    one = "字" * 70 + "。" + "字" * 60
    assert [c for _, c in chunking.structure_pieces(one, 100, 10)] == ["字" * 70 + "。", "字" * 60]
    assert chunking.structure_pieces("") == []


def test_text_functions(spark):
    q = F.lit("宁德时代 毛利率 23.5% a-b")
    terms = column(spark, text.distinct_terms(q))
    assert {"宁德", "毛利", "23.5%", "a-b"} <= set(terms) and "如何" not in terms and len(terms) == len(set(terms))
    assert column(spark, text.segments(F.lit("the the x 毛利率 如何"))) == ["the", "the", "毛利", "利率"]
    assert column(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    rule = lambda c, must, any_of: column(spark, text.is_relevant(F.lit(c), F.array(*map(F.lit, must)), F.array(*map(F.lit, any_of)).cast("array<string>")))
    assert rule("毛利率为23.5%", ["毛利率"], ["23.5", "24.0"]) and not rule("毛利率未披露", ["毛利率"], ["23.5"]) and not rule("23.5%", ["毛利率"], ["23.5"]) and rule("毛利率", ["毛利率"], [])
    assert column(spark, text.category(F.lit("海外不良率"))) == "市场行情" and column(spark, text.category(F.lit("毛利"))) == "证券投研"
    assert column(spark, text.recall_query(F.lit("x"), F.lit("n"), F.lit("s"))) == "n s 分析"
    assert column(spark, text.parsed_vector(F.lit(" 1, 2\n3 "))) == [1.0, 2.0, 3.0]
    assert column(spark, text.decoded_url(F.lit("a%E4%B8%AD+b"))) == "a中 b"


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    assert column(spark, vectors.cosine(a, b)) == pytest.approx(0.96) and column(spark, vectors.cosine(a, z)) == 0
    assert column(spark, vectors.squared_l2(a, b)) == 2 and column(spark, vectors.cosine(a, F.array(F.lit(1.0)), "zero")) == 0
    with pytest.raises(Exception, match="dimension"):
        column(spark, vectors.cosine(a, F.array(F.lit(1.0))))
    df = spark.createDataFrame([(b"\x00\x00\x80?\x00\x00\x00@",)], "b binary")
    assert df.select(vectors.from_blob("b").alias("v")).first().v == [1.0, 2.0]
    assert bytes(df.select(vectors.to_blob(vectors.from_blob("b")).alias("b")).first().b) == b"\x00\x00\x80?\x00\x00\x00@"
    assert not column(spark, vectors.is_finite(F.array(F.lit(1.0), F.lit(float("nan")))))


def test_hashed_ngrams():
    v = embedding.hashed_ngrams(["ab", "", None], 96)
    assert v[0, 91] > 0 and np.linalg.norm(v[0]) == pytest.approx(1) and not v[1:].any()
    assert embedding.hashed_ngrams(["x"], 0).shape == (1, 0)


def test_registry_and_response():
    registry = embedding.ProviderRegistry()
    registry.register(embedding.HashedNgramProvider(4))
    assert registry.ids() == ["deterministic-mock-v1"] and registry.get("deterministic-mock-v1").info.dimension == 4
    with pytest.raises(KeyError):
        registry.get("x")
    info = embedding.HashedNgramProvider(2).info
    good = {"model_info": {"model_id": info.model_id}, "outputs": [{"request_id": "0", "vector": [1, 2]}]}
    assert embedding.checked_response(good, info, ["0"]) == [[1, 2]]
    for bad in ({**good, "model_info": {}}, {**good, "outputs": []}, {**good, "outputs": [{"request_id": "0", "vector": [1]}]}, {**good, "outputs": [{"request_id": "0", "vector": [1, float("inf")]}]}):
        with pytest.raises(ValueError):
            embedding.checked_response(bad, info, ["0"])


def test_search_edges(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0])], "id string, vector array<float>")
    query = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, vector array<float>")
    got = retrieval.vector_search(query, corpus, 3, "cosine", "zero").orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    with pytest.raises(Exception, match="dimension"):
        retrieval.vector_search(query, corpus, 3).collect()
    assert retrieval.vector_search(query.limit(0), corpus, 3).count() == 0 and retrieval.vector_search(query, corpus.limit(0), 3).count() == 0
    own = corpus.where("size(vector) = 2").withColumn("p", F.lit("x"))
    assert retrieval.store_search(query.withColumn("p", F.lit("x")), own, 0, "p").count() == 1


def test_lexical_edges(spark):
    corpus = spark.createDataFrame([(1, "aaaa bb"), (2, ""), (3, None)], "id int, text string")
    terms = spark.createDataFrame([("aa",), ("bb",), ("",), ("zz",)], "term string")
    assert sorted(map(tuple, retrieval.term_frequencies(terms, corpus).collect())) == [("aa", 1, 2), ("bb", 1, 1)]
    nothing = spark.createDataFrame([(1, "!!")], "query_id int, text string")
    assert retrieval.bm25_search(nothing, corpus, 3).count() == 0
    row = retrieval.analyze_queries(nothing, corpus).first()
    assert (row.specificity, row.vector_weight, row.bm25_weight, row.term) == ("0.500", "0.700", "0.800", None)


def test_latency_golden(spark):
    rows = spark.createDataFrame([(10.0, True), (20.0, False), (30.0, True), (None, True)], "latency_ms double, success boolean")
    r = rows.where("latency_ms IS NOT NULL").agg(*stats.latency_summary()).first()
    assert (r.total_samples, r.successful_samples, r.failed_samples, r.p50_ms, r.p99_ms) == (3, 2, 1, 20.0, None)
    values = spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double")
    assert values.agg(stats.linear_percentile(F.col("v"), 0.5), stats.linear_percentile(F.col("v"), 0.95)).first()[:] == (2.5, pytest.approx(3.85))
    with pytest.raises(ValueError):
        stats.linear_percentile(F.col("v"), 1.5)


def test_memory_and_matrix(spark):
    assert [column(spark, stats.memory_needed_gib(F.lit(g * 1024**3))) for g in (2, 4, 9, 200)] == [8, 16, 32, 512]
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    configs = spark.createDataFrame([("a", "fixed"), ("b", "fixed"), ("c", "fixed"), ("s", "structure")], "chunk_config string, strategy string")
    assert benchmarks.hardware_matrix(frame("p", "xyz"), frame("m", "xyz"), configs, frame("k", "123")).distinct().count() == 81


def test_quality_golden(spark):
    hits = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, False), ("r", 1, False), ("r", 2, False)], "query_id string, rank int, relevant boolean")
    totals = spark.createDataFrame([("q", 2), ("r", 0), ("s", 1)], "query_id string, total_relevant int")
    got = {r.query_id: r for r in evaluation.quality_details(hits, totals).collect()}
    q = got["q"]
    assert (q.hit, q.first_relevant_rank, q.reciprocal_rank, q.recall, q.average_precision) == (1, 2, 0.5, 0.5, 0.25) and 0 < q.ndcg < 1
    assert q.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert all(got[k].hit == 0 and got[k].recall == 0 and got[k].ndcg == 0 for k in "rs")
    assert evaluation.quality_summary(evaluation.quality_details(hits, totals)).first().query_count == 3


def test_recommended(spark):
    rows = spark.createDataFrame([("fixed-100-20", 0.70, "fixed", 3), ("fixed-200-40", 0.75, "fixed", 3), ("structure", 0.8, "structure", 3)], "chunk_config string, ndcg double, strategy string, top_k int")
    assert benchmarks.recommended_fixed(rows).first()[0] == "fixed-200-40"
    with pytest.raises(Exception, match="no fixed"):
        benchmarks.recommended_fixed(rows.where("strategy = 'structure'")).collect()


def test_entropy_needs_two_points(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 2.0, 3.0, 1.0), ("b", 1.0, 1.0, 1.0)], "g string, p50_ms double, p95_ms double, qps_sequential double")
    good = stats.entropy_scores(rows.where("g = 'a'"), ["g"]).collect()
    assert max(r.entropy_score for r in good) == pytest.approx(100)
    with pytest.raises(Exception, match="two points"):
        stats.entropy_scores(rows, ["g"]).collect()


def test_run_documents(spark):
    run = {s: [] for s in benchmarks.REQUIRED_SECTIONS} | {"run_info": {"run_id": "r"}, "latency_samples": [{"success": True, "latency_ms": 1}, {"success": False}], "summary": {"total_samples": 2, "successful_samples": 1, "failed_samples": 1}}
    assert benchmarks.run_errors(run) == []
    assert benchmarks.run_errors(run | {"summary": run["summary"] | {"total_samples": 99}}) == ["summary.total_samples does not match latency_samples"]
    assert benchmarks.run_errors({}) != []
    runs = spark.createDataFrame([("one", "COMPLETE")], "run_id string, status string")
    assert benchmarks.session_check("PASS", runs).first()[:] == (True, 1, [])
    assert benchmarks.session_check("PASS", runs.withColumn("status", F.lit("RUNNING"))).first()[:] == (False, 1, ["one"])
    with pytest.raises(ValueError):
        benchmarks.RunConfig("m", 100, 100, 3)


def test_synthetic_vectors(spark):
    row = benchmarks.synthetic_vectors(spark, 3, 4).where("id = 'c1'").first()
    assert row.vector == pytest.approx([2 * (j + 3) % 97 / 97 for j in range(4)]) and benchmarks.synthetic_vectors(spark, 0, 0).count() == 1


def test_rag(spark):
    class Picky:
        """A client that answers only prompts with a source."""

        def complete(self, prompt):
            if "[资料1" not in prompt:
                raise ValueError("no context")
            return "yes"

    hits = spark.createDataFrame([(1, 2, "b.md", 0, "B"), (1, 1, "a.md", 3, "A")], "query_id int, rank int, file_name string, chunk_index int, text string")
    assert rag.contexts(hits).first().context == "[资料1 | a.md | chunk 3]\nA\n\n[资料2 | b.md | chunk 0]\nB"
    questions = spark.createDataFrame([(1, "?"), (2, "!")], "query_id int, text string")
    assert {(r.query_id, r.llm_used, r.warning is not None) for r in rag.answers(questions, hits, mock=True).collect()} == {(1, False, True), (2, False, True)}
    with pytest.raises(ValueError):
        rag.LlmConfig("http://example.com", "k", "m")
    assert rag.LlmConfig("http://localhost:1", "k", "m", thinking=True).body("x")["reasoning_effort"] == "high"
    body = rag.LlmConfig("https://example.com", "k", "m").body("x")
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["thinking"] == {"type": "disabled"} and "reasoning_effort" not in body
    replied = {r.query_id: r for r in rag.answers(questions, hits, Picky()).collect()}
    assert (replied[1].answer, replied[1].error, replied[1].llm_used) == ("yes", None, True)
    assert (replied[2].answer, replied[2].error) == (None, "ValueError: no context")
    assert rag.answer_text({"choices": [{"message": {"content": "a"}}]}) == "a"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.docx").write_bytes(b"z")
    (tmp_path / "d.txt").write_bytes(b"\xff")
    found = files.binary_files(spark, str(tmp_path))
    rows = {r.title: (r.doc_type, r.text, r.error) for r in files.parse_documents(found).collect()}
    assert rows == {"a": ("markdown", "x", None), "b": ("research_report", None, "no PDF extractor"), "c": (None, None, "unsupported file type: docx"), "d": ("text", None, "not valid UTF-8")}
    assert files.import_summary(files.parse_documents(found)).first()[:] == (1, 3)
    assert [r.name for r in files.load_texts(spark, str(tmp_path)).collect()] == ["a.md"]
    queries = [{"query": "海外销量", "must_contain": ["a"], "any_of": []}, {"query": "毛利", "must_contain": ["b"], "any_of": ["c"]}]
    (tmp_path / "q.json").write_text(json.dumps(queries))
    got = files.load_queries(spark, str(tmp_path / "q.json")).orderBy("id").collect()
    assert [(r.id, r.category, r.any_of) for r in got] == [("Q01", "市场行情", []), ("Q02", "证券投研", ["c"])]
    assert len(files.manifest(found).first().sha256) == 64 and len(files.dataset_hash(found).first()[0]) == 64
    files.write_json_atomically(spark, {"a": "é"}, str(tmp_path / "out.json"))
    files.write_json_atomically(spark, {"a": 2}, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == {"a": 2}
    batch = json.dumps({"knowledge_base_id": "k", "model_info": {"model_id": "m", "dimension": 2}, "vectors": [{"chunk_id": "c", "vector": [1, 2]}]})
    assert files.vector_batches(spark.createDataFrame([(batch,)], "value string")).first().vector == [1.0, 2.0]
    with pytest.raises(ValueError):
        files.scan_one(spark, "x.docx")


def test_search_by_profile(spark):
    """All profiles in one scan give what a search in each gives."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)], None if i % 4 == 3 else f"p{i % 4}") for i in range(120)]
    corpus = spark.createDataFrame(rows, "id int, vector array<float>, p string").repartition(5)
    queries = corpus.where("id % 10 < 4").withColumnRenamed("id", "query_id")
    got = retrieval.vector_search(queries, corpus, 4, "l2", profile="p").collect()
    for i, q, p in (r for r in rows if r[0] % 10 < 4):
        want = sorted((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), j) for j, v, own in rows if own == p)[:4]
        assert sorted((r.score, r.id) for r in got if r.query_id == i) == want


def test_total_relevant(spark):
    texts = ["ab cd", "cd ef", "ab", "", None, "abab ef"]
    rules = [(1, ["ab"], []), (2, ["ab", "cd"], []), (3, [], ["cd", "ef"]), (4, [], []), (5, ["ab"], ["ef", "x"]), (6, [""], [""]), (7, ["zz"], []), (8, None, []), (9, ["ab", "ab"], [])]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    frame = spark.createDataFrame(rules, "query_id int, must_contain array<string>, any_of array<string>")
    want = {q: sum(t is not None and all(x in t for x in must) and (not other or any(x in t for x in other)) for t in texts) if must is not None else 0 for q, must, other in rules}
    assert dict(map(tuple, evaluation.total_relevant(frame, corpus).collect())) == want
    assert {r.total_relevant for r in evaluation.total_relevant(frame, corpus.limit(0)).collect()} == {0}


def test_case_evidence(spark):
    required = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", "z"), ("E", "none")], "case_id string, measured_id string").withColumn("description", F.col("case_id"))
    measured = spark.createDataFrame([("x", "PASS", 1.0, "1"), ("y", "FAIL", None, None), ("z", None, 2.0, "2")], "case_id string, status string, duration_ms double, actual string")
    checks = spark.createDataFrame([("B", False), ("E", True)], "case_id string, passed boolean")
    got = {r.case_id: r.status for r in benchmarks.case_evidence(required, measured, checks).collect()}
    assert got == {"A": "PASS", "B": "FAIL", "C": "FAIL", "D": "PASS", "E": "FAIL"}
    cases = benchmarks.case_evidence(required, measured)
    assert {r.case_id for r in cases.where("status = 'PASS'").collect()} == {"A", "B", "D"}
    assert tuple(benchmarks.case_summary(cases, 5).first()) == (3, 5, False) and tuple(benchmarks.case_summary(cases.limit(0), 0).first()) == (0, 0, True)


def test_historical_comparison(spark):
    rows = spark.createDataFrame([("c0", 3, 1.0), ("c0", 5, 2.0), ("c1", 3, 3.0)], "chunk_config string, top_k int, mean_ms double")
    row = benchmarks.historical_comparison(rows, rows, "c0", "c1").first()
    assert (row.old.mean_ms, row.new.mean_ms, row.strict_ab) == (1.0, 3.0, False)
    assert benchmarks.historical_comparison(rows.limit(0), rows, "c0", "c1").count() == 0


def test_quality_score(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0, 5.0), ("a", 1.0, 1.0, 3.0), (None, 0.5, 0.0, 4.0)], "g string, recall double, mrr double, ndcg double")
    over_all = {r.recall: r.quality_score for r in stats.quality_score(rows).collect()}
    assert over_all == {0.0: pytest.approx(200 / 3), 1.0: pytest.approx(200 / 3), 0.5: pytest.approx(100 / 3)}
    grouped = stats.quality_score(rows, by=["g"])
    assert grouped.columns == [*rows.columns, "quality_score"] and {r.recall: r.quality_score for r in grouped.collect()} == {0.0: pytest.approx(100 / 3), 1.0: pytest.approx(100 / 3), 0.5: 0.0}
    assert stats.quality_score(rows.limit(0)).count() == 0


def test_calls_are_bounded_over_all_tasks_and_tried_again(spark, tmp_path):
    class Counting:
        """Fails at first, and writes down how many calls are open at once."""

        def __init__(self, folder):
            self.folder = folder

        def complete(self, text: str) -> str:
            import os
            import time

            name = f"{self.folder}/{abs(hash(text))}"
            first = not os.path.exists(name)
            open(f"{name}.open", "w").close()
            with open(f"{self.folder}/log", "a") as log:
                log.write(f"{len([f for f in os.listdir(self.folder) if f.endswith('.open')])}\n")
            time.sleep(0.05)
            os.remove(f"{name}.open")
            if first:
                open(name, "w").close()
                raise TimeoutError("busy")
            return "yes"

    questions = spark.createDataFrame([(i, f"question {i}") for i in range(40)], "query_id int, text string").repartition(20)
    hits = spark.createDataFrame([], "query_id int, rank int, file_name string, chunk_index int, text string")
    rows = rag.answers(questions, hits, Counting(str(tmp_path)), at_once=2, calls=4, pause=0.01).collect()
    assert len(rows) == 40 and all(r.answer == "yes" and r.error is None for r in rows)
    assert max(map(int, (tmp_path / "log").read_text().split())) <= 4
    with pytest.raises(ValueError):
        rag.answers(questions, hits, Counting(""), calls=0)
