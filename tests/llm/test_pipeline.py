import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as p
from oracle import duck_rows
from pyspark.sql import functions as F

from tessera.llm import op9_decontamination as op9

from test_op3 import brute as near_brute
from test_op9 import brute as leak_brute

CLASHING = ["offset", "_rank", "rank", "target", "size", "source_size", "row", "row_key", "key", "keep", "n", "candidate", "path", "pos", "score", "lang_pred", "component_id", "secrets", "copy"]
SECRET = re.compile(r'token = "([0-9a-f]{40})"')


def brute(docs, items):
    """The pipeline in plain Python; what the models decide is read off the texts' plain marks."""
    docs = [d for d in docs if d["text"] and any(c.isalpha() for c in d["text"])]
    comp = {}
    for row in near_brute([(d["doc_id"], d["text"]) for d in docs], p.SHINGLE, p.PERCENT):
        doc, _, root = eval(row)
        comp[doc] = root
    docs = [d for d in docs if comp[d["doc_id"]] == d["doc_id"]]
    bad = {d for d, *_ in leak_brute([(d["doc_id"], d["text"]) for d in docs], items)}
    docs = [d | {"text": SECRET.sub('token = "[SECRET]"', d["text"])} for d in docs if d["doc_id"] not in bad]
    return mixed(docs)


def mixed(docs):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    total, weight = defaultdict(int), {}
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    for i, s in enumerate(sorted(total)):
        weight[s] = i % 3 + 1
    target, rest, free = {}, sum(total.values()), set(total)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        for s in over or free:
            target[s] = 3 * total[s] if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        free = free - over if over else set()
    out = Counter()
    for s in total:
        start = int(hashlib.md5(f"mix:{s}".encode()).hexdigest()[:8], 16) / 2**32
        order = sorted((d for d in docs if d["source"] == s), key=lambda d: (size[d["doc_id"]], d["doc_id"]))
        r = target[s] / total[s] if total[s] else 0
        for i, d in enumerate(order, 1):
            for _ in range(min(3, int(i * r + start) - int((i - 1) * r + start))):
                out[d["doc_id"], d["text"]] += 1
    return out


def test_run_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    names, rows = duck_rows("SELECT * FROM documents", sf_dir)
    docs = [dict(zip(names, r, strict=True)) for r in rows]
    _, items = duck_rows("SELECT item_id, text FROM benchmark", sf_dir)
    got = p.run(spark, sf_dir)
    assert got.columns == [*names, "copy"]
    ours = Counter((r.doc_id, r.text) for r in got.collect())
    assert ours == brute(docs, items)


def test_stages_keep_the_columns_and_survive_edges(spark):
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(40)) for _ in range(8)]
    rows = [(i, t, "en", "a", 5) for i, t in enumerate(texts)] + [(0, texts[0], "en", "a", 5), (None, None, None, None, None), (None, texts[1], None, None, 1), (30, "", "en", "b", 0), (31, "%% 12", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(f(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0 for _, f in p.STAGES)
    for name, stage in p.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns[:5] == docs.columns and (len(out.columns) == 5) == (name != p.STAGES[-1][0])
    clashing = docs.select("*", *(F.lit(c).alias(c) for c in CLASHING))
    for name, stage in p.STAGES:
        out = stage(spark, clashing, "/root/testdata/sf0.001")
        assert out.count() > 0 and out.columns[: len(clashing.columns) - 1] == clashing.columns[:-1]
        assert all(r[c] == c for r in out.collect() for c in CLASHING[:-1])
    kept = p.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, range(8)), "None", "30", "31"])
    assert op9.WINDOW == 10
