import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.operators.catalog import Catalog
from tessera.operators.embedding import HashedNgramProvider, HttpProvider, ModelInfo, ProviderRegistry

INFO = ModelInfo(**(HashedNgramProvider(2).info.__dict__ | {"model_id": "stub"}))


@pytest.fixture
def stub():
    """A service that fails every third time, refuses texts with "bad" and answers "odd" with a short vector."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            request = json.loads(body)
            texts = [i["text"] for i in request["inputs"]]
            asked.append((len(body), texts, request.get("normalize", True)))
            status = 503 if len(asked) % 3 == 1 else 400 if any("bad" in t for t in texts) else 200
            outputs = [{"request_id": i["request_id"], "vector": [float(len(i["text"]))] * (1 if "odd" in i["text"] else 2), "token_count": len(i["text"].split())} for i in request["inputs"]]
            answer = json.dumps({"model_info": {"model_id": "stub"}, "outputs": outputs}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_limits_retries_and_errors_a_row(spark, stub):
    url, asked = stub
    texts = [f"text number {i}" for i in range(40)] + ["bad one", "odd one", None, "x" * 3000, "é" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    provider = HttpProvider(url, INFO, batch=500, max_bytes=2000, pause=0.01, errors="error", tokens="tokens", normalize=False)
    got = {r.i: r for r in provider.transform(rows).collect()}
    assert len(got) == len(texts)
    wrong = {i for i, r in got.items() if r.error}
    assert wrong == {40, 41, 43} and "400" in got[40].error and "dimension" in got[41].error and "larger" in got[43].error
    assert all(got[i].vector == [float(len(t or ""))] * 2 and got[i].tokens == len((t or "").split()) for i, t in enumerate(texts) if i not in wrong)
    assert all(got[i].vector is None and got[i].tokens is None for i in wrong)
    assert max(size for size, *_ in asked) <= 2000 and max(len(t) for _, t, _ in asked) <= 128 and not any(n for *_, n in asked)


def test_batches_have_128_texts_at_most_and_strict_ones_raise(spark, stub):
    url, asked = stub
    rows = spark.range(300).select(F.col("id"), F.concat(F.lit("t"), F.col("id")).alias("text")).coalesce(1)
    assert HttpProvider(url, INFO, batch=1000, pause=0.01).transform(rows).where("size(vector) = 2").count() == 300
    assert max(len(t) for _, t, _ in asked) == 128 and all(n for *_, n in asked)
    with pytest.raises(Exception, match="400"):
        HttpProvider(url, INFO, pause=0.01).transform(rows.select(F.lit("bad").alias("text"))).collect()
    silent = HttpProvider("http://127.0.0.1:9", INFO, pause=0.01, retries=1, errors="e").transform(rows.limit(3)).collect()
    assert len(silent) == 3 and all(r.e and r.vector is None for r in silent)


def test_batch_ingest_and_search_requests(spark, tmp_path, stub):
    catalog = Catalog(spark, str(tmp_path / "catalog"), buckets=4)
    kb = catalog.create("n", "/r", 40, 0)
    files = [("/r/a.md", b"red apples and pears"), ("/r/b.txt", b"the price of volume is rising " * 3), ("/r/c.pdf", b"%PDF"), ("/r/d.md", b"\xff\xfe"), ("/r/e.md", b" \n"), ("/r/f.docx", b"x"), ("/r/g.md", b"a bad text")]
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    local = HashedNgramProvider(16)
    done = {r.file_path[3:]: r for r in catalog.add_files(kb, table, local).collect()}
    assert {k: bool(r.error) for k, r in done.items()} == {"a.md": False, "b.txt": False, "c.pdf": True, "d.md": True, "e.md": True, "f.docx": True, "g.md": False}
    assert done["a.md"].chunk_count == done["a.md"].vector_count == 1 and done["b.txt"].chunk_count == 3 and done["c.pdf"].document_id is None
    assert catalog.table("document").count() == 3 and catalog.table("vector_record").count() == 5
    url, _ = stub
    remote = catalog.add_files(kb, table, HttpProvider(url, INFO, pause=0.01, errors="e"))
    assert {r.file_path[3:]: r.error for r in remote.where("chunk_count > 0").collect()} == {"a.md": None, "b.txt": None, "g.md": "1 chunks have no vector"}

    registry = ProviderRegistry()
    registry.register(local)
    registry.register(HashedNgramProvider(8))
    asked = [(1, "red apples", None, None), (2, " ", None, 3), (3, "volume price", "no such model", 2), (4, "volume price", local.info.model_id, 2), (5, None, None, None)]
    requests = spark.createDataFrame(asked, "query_id int, text string, model string, top_k int")
    registry = ProviderRegistry()
    registry.register(local)
    rows = {r.query_id: r for r in catalog.answer(kb, requests, registry, local.info.model_id).collect()}
    assert {k: r.error for k, r in rows.items()} == {1: None, 2: "query is required", 3: "no embedding provider no such model", 4: None, 5: "query is required"}
    assert rows[1]["count"] == 5 and rows[1].results[0].file_name == "a.md" and [h["rank"] for h in rows[4].results] == [1, 2] and rows[3].results == []
    assert {r.error for r in catalog.answer(kb, requests.select("query_id", "text"), registry).collect()} == {"query is required", "no embedding provider bge-small"}
    other = catalog.create("m", "/m", 40, 0)
    assert {r.error for r in catalog.answer(other, requests.limit(1), registry, local.info.model_id).collect()} == {f"knowledge base {other} has no vectors of {local.info.model_id}; index it first"}
