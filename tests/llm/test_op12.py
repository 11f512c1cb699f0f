import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from oracle import TABLES, assert_same

from tessera.llm import op12_repair as m

GRAMMAR = re.compile(r"(s?(ua)+)?")


def every_repair(codes: str):
    """All edit sequences with at most one insertion more than there are turns: cost and audit."""

    def go(i, cost, audit, out, inserts):
        if i == len(codes) and GRAMMAR.fullmatch(out):
            yield cost, audit
        if inserts < len(codes) + 2:
            for role in "ua":
                yield from go(i, cost + 3, audit + "I", out + role, inserts + 1) if GRAMMAR.fullmatch(out + role) or GRAMMAR.fullmatch(out + role + "a") else ()
        if i < len(codes):
            c = codes[i]
            yield from go(i + 1, cost + 4, audit + "D", out, inserts)
            if c != "-":
                more = 3 * c.isupper()
                for op, role, price in [("K", c.lower(), 0), ("R", "u", 3), ("R", "a", 3)]:
                    new = out + role
                    if GRAMMAR.fullmatch(new) or GRAMMAR.fullmatch(new + "a") or GRAMMAR.fullmatch(new + "ua"):
                        yield from go(i + 1, cost + price + more, audit + op, new, inserts)

    return go(0, 0, "", "", 0)


def test_every_short_conversation_equals_brute_force():
    for n in range(4):
        for codes in map("".join, product("uaAsSx-", repeat=n)):
            best = min(every_repair(codes))
            assert m.align(codes) == best, codes
            assert m.align(codes, 0) == best, codes


def test_longer_conversations_by_lengths_and_by_automaton():
    rng = random.Random(1)
    for n in [5, 9, 30, 120, 400]:
        for _ in range(60 if n < 100 else 6):
            base = ("s" if rng.random() < 0.3 else "") + "ua" * n
            codes = "".join(rng.choice("uaAUsx-") if rng.random() < 0.25 else c for c in base[:n] if rng.random() < 0.9)
            assert m.align(codes) == m.align(codes, 0), codes
    for n in (6, 12):
        for _ in range(100):
            codes = "".join(rng.choices("uaAUsSx-", k=n))
            assert m.align(codes) == m.align(codes, 0), codes


def by_hand(rows):
    """The contract for one conversation, straight: (turn, role, text) rows before damage with the conversation's name."""
    after = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        code, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in after:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        c = role[:1] if role[:1] in tuple("uas") else "x"
        codes += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
    turns = {r[0] for r in after if r[0] is not None}
    cost, audit = m.align(codes, 0) if len(codes) > 4 else min(every_repair(codes))
    out, i, position, system = [], 0, 0, False
    for op in audit:
        if op == "D":
            i += 1
            continue
        role = ("user", "assistant")[(position - system) % 2]
        if op == "I":
            out.append(role + ":")
        else:
            _, own, text = after[i]
            system = system or (position == 0 and op == "K" and own[:1] == "s")
            out.append(f"{own if op == 'K' else role}:{text}")
            i += 1
        position += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = [*m.COUNTS, "audit", "repaired_sha256"]


def same_as_by_hand(df, rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert got == {k: by_hand(v) for k, v in groups.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_contract(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same_as_by_hand(m.op12_repair(spark, f"/root/testdata/{folder}"), rows)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_equals_sql(spark, folder):
    assert_same(m.op12_repair(spark, f"/root/testdata/{folder}"), m.SQL, f"/root/testdata/{folder}")


def test_sql_on_nulls_ties_and_system_turns(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system", "tool"]), rng.choice([None, " ", "Yes.", "No", "Why?", "é!\n"])) for _ in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for t in TABLES:
        if t != "conversations":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert_same(m.op12_repair(spark, str(tmp_path)), m.SQL, str(tmp_path))


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    rng = random.Random(2)
    schema = "conv_id long, turn long, role string, text string, absent string, audit string"
    assert m.repair_reports(m.damaged(spark.createDataFrame([], schema))).count() == 0
    texts, roles = [None, "", " \t", "Ja.", "Nein", "é?\n", "x" * 1_500_000 + "."], [None, "", "user", "assistant", "system", "tool"]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 1, 2, -4]), rng.choice(roles), rng.choice(texts), "a", "b") for _ in range(60)]
    rows += [(9, t, "user", "Same.", "a", "b") for t in range(30)] + [(10, next(t for t in range(999) if zlib.crc32(f"10:{t}".encode()) % 20 == 0), "user", "x.", "a", "b")]
    df = m.repair_reports(m.damaged(spark.createDataFrame(rows, schema)), m.F.col("absent"))
    same_as_by_hand(df, [r[:4] for r in rows])
    gone = df.where("conv_id = 10").first()
    assert [gone[c] for c in COLUMNS] == [0] * 6 + ["", hashlib.sha256(b"").hexdigest()]


def test_repaired_turns_follow_the_grammar(spark, sf_dir):
    turns = m.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")).where("NOT absent")
    reports = {r.conv_id: r for r in m.repair_reports(turns).collect()}
    rows = sorted(m.repaired_turns(turns).collect(), key=lambda r: (r.conv_id, r.position))
    for conv, report in reports.items():
        own = [r for r in rows if r.conv_id == conv]
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == report.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == report.repaired_sha256


def test_one_conversation_of_many_turns_is_streamed(spark):
    n = 120_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 7 = 3 OR id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.') AS text")
    report = m.repair_reports(turns).first()
    codes = "".join("u" if i % 7 == 3 or i % 2 == 0 else "a" for i in range(n))
    assert (report.cost, report.audit) == m.align(codes, 0) and report.truncated == report.gaps == 0
