import base64
import hashlib

import pytest

from tessera.llm import op2_warc as m
from tessera.llm._shared import fresh_path


def brute(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        f = first.get(html or "", i)
        b32 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), b32, "response" if f in (i, None) else "revisit", None if f in (i, None) else f))
    return sorted(map(str, out))


def through(spark, df, **kw):
    path = fresh_path(spark, "warc-test")
    m.write_archives(df, path, **kw)
    got = m.resolve_revisits(m.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(str(tuple(r)) for r in got.collect())


def test_query_equals_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(str(tuple(r)) for r in m.op2_warc(spark, sf_dir).collect()) == brute(pages)


def test_segments_copies_and_edges(spark):
    big = "é€\r\n\r\nWARC/1.1\r\n0\r\n" * 20000
    rows = [(5, "u", "x"), (3, "u\r\ny", "x"), (9, None, "x"), (1, "u", None), (2, "u", ""), (7, "u", big), (8, "u", big), (3, "u", "x"), (7, "u", big), (None, "u", "x"), (None, "u", "only")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string")
    want = brute([(i, h) for i, _, h in rows])
    assert through(spark, df) == want
    assert through(spark, df, segment=1000) == want
    assert through(spark, df.limit(0)) == []


def test_payloads_survive(spark):
    texts = {1: "a" * 70000, 2: "", 3: "ü" * 40000}
    df = spark.createDataFrame([(i, "u", t) for i, t in texts.items()], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    m.write_archives(df, path, segment=777)
    assert {r.page_id: bytes(r.block).decode() for r in m.read_archives(spark, path, payloads=True).collect()} == texts


def test_smaller_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert [x.split("'")[3] for x in through(spark, df, least_revisit=3)] == ["response", "response", "response", "revisit"]


def test_decoder_takes_any_cut():
    block = m.HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + m.chunked(b"hello\r\nworld" * 50, 7)
    for step in (1, 3, 1000):
        size, _, kept = m._payload_of((block[i : i + step] for i in range(0, len(block), step)), True)
        assert (size, kept) == (600, b"hello\r\nworld" * 50)
    with pytest.raises(ValueError):
        m._payload_of(iter([block[:-3]]), False)
