from oracle import assert_same
from pyspark.sql import functions as F

from tessera.llm import op8_mixing as m


def test_query_equals_sql(spark, sf_dir):
    assert_same(m.op8_mixing(spark, sf_dir), m.SQL, sf_dir)


def test_targets_use_all_words_and_stop_at_three_times(spark):
    rows = [(i, s, "w " * k) for i, (s, k) in enumerate([("a", 1), ("b", 100), ("b", 50), ("c", 10), (None, 7)])]
    df = m.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {r.source: (r.target, r.source_size) for r in df}
    assert abs(sum(t for t, _ in by.values()) - 168) < 1e-6
    assert all(t <= 3 * s for t, s in by.values())
    assert all(0 <= r.taken <= 3 * r.size for r in df)


def test_each_source_comes_near_its_target(spark, sf_dir):
    got = m.op8_mixing(spark, sf_dir).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in got)


def test_edges(spark):
    schema = "doc_id long, source string, text string, size string, copies string"
    assert m.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, "x", "y"), (1, "s", "", "x", "y"), (1, "s", "a b", "x", "y"), (1, "s", "a b", "x", "y"), (2, "s", "w " * 5000, "x", "y")]
    got = m.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r.size for r in got} == {0, 2, 5000}
    again = m.mix(spark.createDataFrame(rows[::-1], schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_ties_repeated_ids_and_null_sources(spark):
    """Systematic sampling over (size, id) in plain Python; rows that tie are interchangeable."""
    rows = [(i % 7 if i % 5 else None, [None, "a", "", "\x00null"][i % 4], "w " * (i % 3)) for i in range(60)]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    assert len(by_source) == 4 and len(got) == 60
    for each in by_source.values():
        assert len({(r.source_size, r.target) for r in each}) == 1 and each[0].source_size == sum(r.size for r in each)
        assert abs(sum(r.copies for r in each) - len(each) * each[0].target / each[0].source_size) <= 1


def test_a_hot_source_is_ranked_by_ranges(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("source"), (F.col("id") % 11).alias("size"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        placed = m.prefix_sums(rows.select("*", *m._no_source()), [F.col(c) for c in ("_none", "_source", "size", "doc_id")], {"rank": None, "words": F.col("size")}, ("_none", "_source"))
        got = placed.orderBy("source", "size", "doc_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for source in ("hot", "cold"):
        own, total = [r for r in got if r.source == source], 0
        for i, r in enumerate(own):
            assert (r["rank"], r.words) == (i, total)
            total += r["size"]


def test_columns_of_any_name_pass_through(spark):
    """One column of every name that the code makes, and a few in other cases."""
    names = ["row", "_none", "_source", "rank", "_rank", "_at", "_range", "_first", "_ratio", "offset", "Offset_", "number", "weight", "level", "own_level", "full_before", "weight_before", "all_sizes", "all_weights"]
    schema = "doc_id long, source string, text string, " + ", ".join(f"`{n}` string" for n in names) + ", Target string, copies string"
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * i, *(f"{n}{i}" for n in names), "t", "c") for i in range(9)], schema)
    got = m.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(9)) and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert all(isinstance(r.target, float) and isinstance(r.copies, int) for r in got)
    rows = m.mixed_rows(docs).collect()
    assert all(r["row"]["copies"] == "c" and r["row"]["Target"] == "t" for r in rows)
