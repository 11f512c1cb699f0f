from oracle import assert_same

from tessera.llm import op5_chat as m

SCHEMA = "conv_id long, turn long, role string, text string, part string, n string"


def chats(spark, convs):
    return spark.createDataFrame([(c, t, r, x, "p", "n") for c, turns in convs.items() for t, (r, x) in enumerate(turns)], SCHEMA)


def test_query_equals_sql(spark, sf_dir):
    assert_same(m.op5_chat(spark, sf_dir), m.SQL, sf_dir)


def test_snapshots_collapse(spark):
    a, b, c, d = ("user", "hi"), ("assistant", "yo"), ("user", "more"), ("user", "else")
    got = m.format_chats(chats(spark, {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, d], 5: [a, b, c], 6: [b], 7: [b, a]})).collect()
    assert {r.conv_id: (r.n_turns, r.n_logged) for r in got} == {3: (3, 2), 4: (3, 1), 7: (2, 1)}
    assert next(r.rendered for r in got if r.conv_id == 7) == "<|assistant|>\nyo\n<|end|>\n<|user|>\nhi\n<|end|>\n"


def test_long_conversations_come_in_parts(spark):
    long = [("user", f"t{i}") for i in range(600)]
    got = m.format_chats(chats(spark, {1: long, 2: long[:599], 3: long[:257]})).orderBy("part").collect()
    assert [(r.conv_id, r.part) for r in got] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r.rendered for r in got) == "".join(f"<|user|>\nt{i}\n<|end|>\n" for i in range(600))


def test_edges(spark):
    assert m.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x" * 200000), (2, 0, "user", ""), (None, 0, "a", "b"), (None, 0, "a", "b"), (3, None, None, None), (4, 0, "z", "2"), (4, 0, "a", "1")]
    got = {r.conv_id: r for r in m.format_chats(spark.createDataFrame([(*r, "p", "n") for r in rows], SCHEMA)).collect()}
    assert set(got) == {1, 2, None, 3, 4}
    assert got[1].n_turns == 2 and len(got[1].rendered) > 200000 and got[3].rendered == "<|unknown|>\n\n<|end|>\n"
    assert got[4].rendered.startswith("<|a|>")


def test_no_name_stands_for_null(spark):
    rows = [("null", 0, "a", "b"), ("\x00null", 0, "a", "c"), (None, 0, "a", "d"), ("", 0, None, "\x00null"), ("x", 0, "\x00null", None), ("y", 0, None, None), ("z", 0, "", "")]
    got = m.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted((r.conv_id is None, r.conv_id or "", r.n_logged) for r in got) == sorted((c is None, c or "", 1) for c, *_ in rows)
