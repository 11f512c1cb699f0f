import math
import re
from collections import Counter

import pytest

from tessera.llm import op9_decontamination as m

DOC = "doc_id long, text string, id string, pos string, template string"
KEY_CLASH = "doc_id long, text string, key string, row_key string, row string"


def brute_tokens(text):
    words = []
    for row in re.finditer(r"[^\x20\x09-\x0d\-/]+", text or ""):
        chars = row[0]
        keep = [
            c.isascii() and c.isalnum() or not c.isascii() and not " " <= c <= "‿" or c in ".," and 0 < i < len(chars) - 1 and re.match("[0-9]", chars[i - 1]) and re.match("[0-9]", chars[i + 1])
            for i, c in enumerate(chars)
        ]
        kept = "".join(c for c, k in zip(chars, keep, strict=True) if k)
        if kept:
            first = keep.index(next(k for k in keep if k))
            marks = lambda part, k: any(c in ".,;:!?()[]{}|" and not x for c, x in zip(part, k, strict=True))
            words.append((kept, marks(chars[:first], keep[:first]), marks(chars[first:], keep[first:])))
    capital = lambda ws: {*ws, *(w.capitalize() for w in ws if not w[0].isascii())}
    numbers, units, function = capital(m.NUMBERS), capital(m.UNITS), capital(m.FUNCTION)
    out, before, mark_after = [], None, True
    for kept, mark_before, mark_inside in words:
        low = "".join(c.lower() if c.isascii() else c for c in kept)
        spelled = low in numbers
        if re.search("[0-9]", kept) or spelled:
            kind = "<number>"
        elif before and before[0] == "<number>" and low in units:
            kind = "<unit>"
        elif (kept[0].isupper() or kept[0].istitle()) and ord(kept[0]) < 0xD800 and low not in function and not (before and before[1] in m.GERMAN_ARTICLES):
            kind = "<name>"
        else:
            kind = None
        close = before and not mark_after and not mark_before
        if close and (kind == "<name>" and before[0] == "<name>" or spelled and before[0] == "<number>"):
            out[-1] = (kind, out[-1][1] + low)
        else:
            out.append((kind, low))
        before, mark_after = (kind, low), mark_inside
    return [(k or w, w if k else None) for k, w in out]


def brute_windows(text, sizes):
    tokens = brute_tokens(text)
    for n in sizes:
        for i in range(len(tokens) - n + 1):
            w = tokens[i : i + n]
            yield i, tuple(t for t, _ in w), tuple(t + v for t, v in w if v is not None)


def agree(theirs, ours):
    first = lambda xs: [xs.index(x) for x in xs]
    p, q = first(theirs), first(ours)
    return all(ours[i] == ours[p[i]] and (not x.startswith("<name>") or p[i] == q[i]) for i, x in enumerate(ours))


def brute(docs, items):
    uses, windows = Counter(), []
    for item, text in items:
        tokens = brute_tokens(text)
        uses.update(t for t, _ in tokens)
        windows += [(item, t, s) for _, t, s in brute_windows(text, [min(len(tokens), m.WINDOW)] if tokens else [])]
    total, theirs = sum(uses.values()) + 1000, {}
    weight = lambda w: 0.0 if w in m.PLACEHOLDERS.values() else min(math.log2(total / uses[w]), m.FUNCTION_BITS if w in m.FUNCTION else 99)
    for item, t, s in windows:
        bits = sum(map(weight, t))
        if bits + m.SLOT_BITS * len(s) >= m.LEAST_BITS:
            theirs.setdefault(t, []).append((item, s, bits >= m.LEAST_BITS))
    sizes, found = {len(t) for t in theirs}, {}
    for doc, text in docs:
        for i, t, s in brute_windows(text, sizes):
            for item, s2, loose in theirs.get(t, []):
                if s == s2 or loose and agree(s2, s):
                    least, same = found.get((doc, i, t, s), (item, False))
                    found[doc, i, t, s] = min(item, least), same or s == s2
    out = {}
    for (doc, *_), (item, same) in found.items():
        n = out.setdefault(doc, [item, 0, 0])
        n[:] = min(item, n[0]), n[1] + 1, n[2] + same
    return sorted(((d, *n) for d, n in out.items()), key=str)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in m.op9_decontamination(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, items) and got


def test_other_parameters_are_caught_and_mixed_up_slots_are_not(spark):
    item = "A train leaves at 5 and drives 5 km to meet Anna before Bert drives 7 hours home again today."
    docs = [
        (1, "x y. A train leaves at 8 and drives 8 miles to meet Carl before Dora drives 3 hours home again today. z"),
        (2, "A train leaves at 8 and drives 9 miles to meet Carl before Carl drives 3 hours home again today."),
        (3, "Another text without any of it, but long enough to have windows of its own in the end."),
        (4, item), (4, item), (5, None), (None, item), (6, ""), (7, "filler words " * 50000 + item), (8, "a yes to it"),
    ]
    df = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOC)
    bench_rows = [(10, item), (11, None), (12, ""), (13, "yes"), (14, "seven plain words make a short item")]
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    got = sorted((tuple(r) for r in m.leaks(df, bench).collect()), key=str)
    assert got == brute(docs, bench_rows)
    assert {d for d, *_ in got} == {1, 4, 7, None}
    clash = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], KEY_CLASH)
    kept = m.clean_documents(clash, bench)
    assert sorted(str(tuple(r)[::2]) for r in kept.collect()) == [f"({i}, 'a', 'c')" for i in (2, 3, 5, 6, 8)] and kept.columns == clash.columns


REWORDED = [
    ("If 5 men and 3 boys earn 40 dollars, how much do 7 boys earn?", "If 6 men and 2 boys earn 90 dollars, how much do 4 boys earn?"),
    ("Anna has 5 pens. She gives 2 pens to Carl and keeps the others.", "John Smith has twenty two pens. She gives 7 pens to Zoe and keeps the others."),
    ("At five o'clock John Smith walks 2.5 km along the river bank.", "At nine o'clock Anna walks 3.75 km along the river bank."),
    ("Der Zug fährt um 5 Uhr los und braucht drei Stunden bis nach Hamburg.", "Der Zug fährt um 8 Uhr los und braucht sieben Stunden bis nach München."),
    ("Élodie achète cinq pommes et donne deux pommes à Chloé pour le dîner.", "Marie achète neuf pommes et donne trois pommes à Luc pour le dîner."),
    ("Íñigo compra seis manzanas y regala dos manzanas a su prima Ana.", "Pedro compra nueve manzanas y regala tres manzanas a su prima Eva."),
    ("Иван покупает 5 яблок и дарит 2 яблока своей сестре каждый день.", "Пётр покупает 9 яблок и дарит 4 яблока своей сестре каждый день."),
    ("JOHN buys 5 apples at 3 dollars each and pays with one note.", "MARY buys 8 apples at 2 dollars each\nand pays with one note."),
]


@pytest.mark.parametrize("item,other", REWORDED)
def test_reparameterised_questions_in_several_languages(spark, item, other):
    docs = spark.createDataFrame([(1, other), (2, item.replace(" ", "\n", 3)), (3, "nothing of the kind is asked in here, " * 3)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in m.leaks(docs, bench).collect()) == [1, 2]


def test_decimals_and_spelled_numbers_are_slots():
    import pyarrow as pa

    tokens = m.Tokens(pa.array(["It costs 3.5 or 1,000 euros, twenty-five in all, says “Anna Maria Smith”, Bob."]))
    template, slots = tokens.told(0, len(tokens.rows))
    assert slots == ["<number>3.5", "<number>1,000", "<unit>euros", "<number>twentyfive", "<name>annamariasmith", "<name>bob"]
    assert template == "it costs <number> or <number> <unit> <number> in all says <name> <name>"


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", "a", "b", "c")], DOC)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert m.leaks(df.limit(0), bench).count() == 0 and m.leaks(df, bench.limit(0)).count() == 0
    assert m.leaks(df, bench).count() == 1
