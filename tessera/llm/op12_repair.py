"""Repair of conversations: turns are aligned to the alternating grammar ``(s?(ua)+)?`` by edits of least cost.

A turn is kept (K, 0), gets the role that its place asks for (R, 3) or is deleted (D, 4); empty user and assistant turns
are inserted (I, 3). Blank and repeated turns have to go; a truncated one that stays costs 3 more. Of the cheapest audits
(the edits' initials in order) the least in ASCII order counts.

The alignment is Wagner and Fischer's, against every feasible length of the grammar's string: read from its end, each
such string begins the longest, so that one table holds them all, and a system turn in front is a last step on top. A
greedy repair gives the incumbent cost, and Ukkonen's band leaves out the cells that no repair within it can reach. The
lengths of least cost are traced back, and their audits compared. Deletions that have to be aren't part of the table.
Conversations whose band would have more than CELLS cells are aligned by the grammar's automaton, which keeps the best
of all lengths at once: the same audit in time linear in the turns.

A conversation's turns come to one task in order, as a stream. It holds 18 bytes for each turn; texts beyond SPOOLED
bytes wait in an unnamed temporary file until the audit says which of them stay.

Defined results: null conversations are one conversation; turns are taken by number, null first, then by role and text;
null roles and texts count as one space. A role's initial is its first character as it is; a turn whose initial is
neither u, a nor s can't be kept. Repeated rows are duplicates. Rows marked as absent only name their conversation: one
without any other has zeros, an empty audit and the hash of the empty string. Other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._words import slices

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CELLS = 1 << 22
SPOOLED = 8 << 20
ROLES = {"u": "user", "a": "assistant"}
ALLOWED = {"su", "ua", "au"}
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_FAR = 1 << 29
#: Codes of a turn as they are aligned: its initial, or x; upper case if truncated; - if it has to go.
_GONE = "-"


def _slack(code: str) -> int:
    """What deleting a turn costs beyond what it costs anyway."""
    return DELETE - TRUNCATED * code.isupper()


def _incumbent(live: str) -> int:
    """Slack of a greedy repair: a missing turn is inserted wherever the alternation breaks; or of deleting everything."""
    total, expected, begun = 0, "u", False
    for i, code in enumerate(live.lower()):
        if code == "s" and i == 0:
            begun = True
            continue
        if code not in "ua":
            total += REROLE
        elif code != expected:
            total += INSERT
            expected = code
        expected, begun = "a" if expected == "u" else "u", False
    total += INSERT * (2 if begun else expected == "a")
    return min(total, sum(map(_slack, live)))


def _table(live: str, most: int) -> tuple[np.ndarray, int]:
    """Cell [i, j - i + down]: the slack of the last i turns aligned to the last j characters of the grammar's string."""
    m = len(live)
    short = sum(c.isupper() for c in live)
    down = min(m, most if most <= short else short + (most - short) // DELETE)
    width = down + most // INSERT + 2
    table = np.full((m + 1, width), _FAR, np.int32)
    steps = INSERT * np.arange(width, dtype=np.int32)
    j = np.arange(width) - down
    table[0, j >= 0] = INSERT * j[j >= 0]
    for i in range(1, m + 1):
        code, j = live[m - i].lower(), j + 1
        row = table[i - 1] + np.where(j % 2 == (code == "a"), 0, REROLE) if code in "ua" else table[i - 1] + REROLE
        row[j < 1] = _FAR
        row[:-1] = np.minimum(row[:-1], table[i - 1, 1:] + _slack(live[m - i]))
        row[j < 0] = _FAR
        table[i] = np.minimum(np.minimum.accumulate(row - steps) + steps, _FAR)
    return table, down


def _traced(codes: str, live: str, table: np.ndarray, down: int, i: int, j: int) -> str:
    """The least audit of a cell's slack, for the turns of ``codes`` after those that aren't among the last i of ``live``."""
    m, width = len(live), table.shape[1]
    cell = lambda i, j: table[i, j - i + down] if i >= 0 and 0 <= j - i + down < width else _FAR
    ops, at = [], 0
    for code in codes:
        if code == _GONE:
            ops.append("D")
            continue
        while True:
            here, own, target = cell(i, j), live[m - i], "a" if j % 2 else "u"
            if cell(i - 1, j) + _slack(own) == here:
                ops.append("D")
                i -= 1
                break
            if j and cell(i, j - 1) + INSERT == here:
                ops.append("I")
                j -= 1
                continue
            ops.append("K" if own.lower() == target else "R")
            i, j = i - 1, j - 1
            break
        at += 1
    return "".join(ops) + "I" * j


def _by_lengths(codes: str, live: str, most: int) -> tuple[int, str]:
    m = len(live)
    table, down = _table(live, most)
    found = []
    j = np.arange(table.shape[1]) - down + m
    for w in np.flatnonzero((j >= 0) & (j % 2 == 0) & (table[m] <= most)):
        found.append((int(table[m, w]), None, m, int(j[w])))
    before = 0
    for p, code in enumerate(live):
        if before > most:
            break
        if code in "sS":
            i = m - p - 1
            j = np.arange(table.shape[1]) - down + i
            for w in np.flatnonzero((j >= 2) & (j % 2 == 0) & (table[i] + before <= most)):
                found.append((int(table[i, w]) + before, p, i, int(j[w])))
        before += _slack(code)
    best = min(f[0] for f in found)
    where = [k for k, c in enumerate(codes) if c != _GONE]
    audits = []
    for cost, p, i, j in found:
        if cost == best:
            start = 0 if p is None else where[p] + 1
            audits.append(("" if p is None else "D" * where[p] + "K") + _traced(codes[start:], live, table, down, i, j))
    return best, min(audits)


def _by_automaton(codes: str, live: str) -> tuple[int, str]:
    """The same by states: at the start, after a system turn, a user turn wanted (or the end), an assistant turn wanted."""
    m = len(live)
    start, system, user, assistant = range(4)
    go = np.zeros((m + 1, 4), np.int64)
    go[0] = 0, 2 * INSERT, 0, INSERT
    for i in range(1, m + 1):
        own, drop = live[m - i].lower(), _slack(live[m - i])
        past = go[i - 1].tolist()
        as_user, as_assistant = past[assistant] + REROLE * (own != "u"), past[user] + REROLE * (own != "a")
        u, a = min(past[user] + drop, as_user), min(past[assistant] + drop, as_assistant)
        u, a = min(u, a + INSERT), min(a, u + INSERT)
        s = min(past[system] + drop, as_user, a + INSERT)
        t = min(past[start] + drop, as_user, a + INSERT, past[system] if own == "s" else _FAR * _FAR)
        go[i] = t, s, u, a
    ops, state, i = [], start, m
    for code in codes:
        if code == _GONE:
            ops.append("D")
            continue
        while True:
            here, own, past = go[i, state], live[m - i].lower(), go[i - 1]
            if past[state] + _slack(live[m - i]) == here:
                ops.append("D")
                break
            wanted, after = ("a", user) if state == assistant else ("u", assistant)
            if go[i, after] + INSERT == here:
                ops.append("I")
                state = after
                continue
            if state == start and own == "s" and past[system] == here:
                ops.append("K")
                state = system
                break
            ops.append("K" if own == wanted else "R")
            state = after
            break
        i -= 1
    rest = {start: 0, system: 2, user: 0, assistant: 1}[state]
    return int(go[m, start]), "".join(ops) + "I" * rest


def align(codes: str, cells: int = CELLS) -> tuple[int, str]:
    """Cost and audit of the best repair of turns, one code each."""
    live = codes.replace(_GONE, "")
    base = DELETE * (len(codes) - len(live)) + TRUNCATED * sum(c.isupper() for c in live)
    if not live:
        return base, "D" * len(codes)
    most = _incumbent(live)
    slack, audit = _by_lengths(codes, live, most) if (len(live) + 1) * (most + 2) <= cells else _by_automaton(codes, live)
    return base + slack, audit


_aligned = lru_cache(maxsize=1 << 14)(align)


class _Conversation:
    """One conversation while its turns come in."""

    def __init__(self, name: object, spool: SpooledTemporaryFile):
        self.name, self.spool, self.codes, self.digests = name, spool, bytearray(), bytearray()
        self.illegal, self.before, self.turns, self.least, self.last = 0, None, 0, None, None
        spool.seek(0)
        spool.truncate()

    def add(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ALLOWED
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        found = next((c for c in reversed(text) if c not in "\x20\x09\x0a\x0b\x0c\x0d"), None)
        code = initial if initial and initial in "uas" else "x"
        self.codes += b" " if found is None else (code if found in ".!?" else code.upper()).encode()
        r, t = role.encode(), text.encode()
        head = struct.pack("<qq", len(r), len(t))
        self.digests += hashlib.blake2b(head + r + t, digest_size=16).digest()
        self.spool.write(head + r + t)

    def close(self) -> dict[str, object]:
        """Faults and audit. Equal 128-bit digests count as equal turns."""
        codes = np.frombuffer(bytes(self.codes), np.uint8).copy()
        pairs = np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)
        order = np.lexsort((np.arange(len(pairs)), pairs[:, 1], pairs[:, 0]))
        again = np.zeros(len(pairs), bool)
        again[order[1:]] = (pairs[order[1:]] == pairs[order[:-1]]).all(1)
        blank = codes == ord(" ")
        again &= ~blank
        codes[blank | again] = ord(_GONE)
        text = codes.tobytes().decode()
        cost, self.audit = (_aligned if len(text) <= 64 else align)(text)
        return {
            "gaps": self.last - self.least + 1 - self.turns if self.turns else 0, "blank": int(blank.sum()), "duplicate": int(again.sum()),
            "truncated": sum(c.isupper() for c in text), "illegal": self.illegal, "cost": cost, "audit": self.audit,
        }

    def repaired(self) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the turns that the audit leaves."""
        self.spool.seek(0)
        wanted, first = "u", True
        for op in self.audit:
            role, text = ROLES[wanted], ""
            if op != "I":
                r, t = struct.unpack("<qq", self.spool.read(16))
                own, body = self.spool.read(r).decode(), self.spool.read(t).decode()
                if op == "D":
                    continue
                role, text = (own if op == "K" else role), body
            if not (first and op == "K" and role.startswith("s")):
                wanted = "a" if wanted == "u" else "u"
            first = False
            yield op, role, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    with SpooledTemporaryFile(max_size=SPOOLED) as spool:
        current = None
        for batch in slices(batches):
            for name, turn, role, text, absent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or name != current.name:
                    if current is not None:
                        yield current
                    current = _Conversation(name, spool)
                if not absent:
                    current.add(turn, role, text)
        if current is not None:
            yield current


def _in_order(turns: DataFrame, absent: Column | None) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), gone.alias("absent"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_reports(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): fault counts, cost, audit, repaired_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for c in _conversations(batches):
            report, digest, begun = {"conv_id": c.name} | c.close(), hashlib.sha256(), False
            for _, role, text in c.repaired():
                digest.update(f"{chr(10) * begun}{role}:{text}".encode())
                begun = True
            rows.append(report | {"repaired_sha256": digest.hexdigest()})
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, kinds)

    rows = _in_order(turns, absent)
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256"))])
    kinds = pa.schema([("conv_id", _arrow(rows, "conv_id")), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return rows.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, position, edit (K, R or I), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for c in _conversations(batches):
            c.close()
            for i, (edit, role, text) in enumerate(c.repaired()):
                rows.append((c.name, i, edit, role, text))
                size += len(text)
                if size > SPOOLED or len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], kinds.names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], kinds.names)

    rows = _in_order(turns, absent)
    kinds = pa.schema([("conv_id", _arrow(rows, "conv_id")), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return rows.mapInArrow(run, T.StructType([rows.schema["conv_id"], T.StructField("position", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))]))


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the faults that the query plants, by a checksum of conversation and turn; dropped ones are ``absent``."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(code == 0, F.lit(None)).when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    rows = turns.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(plain("role")).alias("role"), text.alias("text"), code.alias("code"))
    twice = rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.select("conv_id", "turn", "role", "text", (F.col("code") == 0).alias("absent"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("absent"))


#: The automaton's states: 0 at the start, 1 after a system turn, 2 a user turn or the end wanted, 3 an assistant turn wanted.
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
      list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS code FROM keyed
), after AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM after
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS unended, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), turns AS (
  SELECT *, NOT blank AND seen AS repeated, NOT blank AND NOT seen AND unended AS truncated FROM judged
), inserted(q, q2, n) AS (VALUES (0, 0, 0), (0, 3, 1), (0, 2, 2), (1, 1, 0), (1, 3, 1), (1, 2, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
moves(q, q2, initial) AS (VALUES (0, 0, 'D'), (1, 1, 'D'), (2, 2, 'D'), (3, 3, 'D'), (0, 3, 'u'), (1, 3, 'u'), (2, 3, 'u'), (3, 2, 'a'), (0, 1, 's')),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': ''} AS best FROM conversations
  UNION ALL
  SELECT conv_id, i, q, min(best) AS best FROM (
    SELECT p.conv_id, t.i, m.q2 AS q, {
      'cost': p.best.cost + 3 * s.n + CASE WHEN m.initial = 'D' THEN 4 ELSE CASE WHEN m.initial = t.initial THEN 0 ELSE 3 END + CASE WHEN t.truncated THEN 3 ELSE 0 END END,
      'audit': p.best.audit || repeat('I', s.n) || CASE WHEN m.initial = 'D' THEN 'D' WHEN m.initial = t.initial THEN 'K' ELSE 'R' END} AS best
    FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1 JOIN inserted s ON s.q = p.q JOIN moves m ON m.q = s.q2
    WHERE m.initial = 'D' OR NOT (t.blank OR t.repeated) AND (m.initial <> 's' OR t.initial = 's')
  ) GROUP BY conv_id, i, q
), sizes AS (
  SELECT conv_id, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id AS own, i FROM turns) t ON t.own IS NOT DISTINCT FROM c.conv_id GROUP BY conv_id
), ended AS (
  SELECT p.conv_id, min({'cost': best.cost + CASE q WHEN 3 THEN 3 WHEN 1 THEN 6 ELSE 0 END, 'audit': best.audit || CASE q WHEN 3 THEN 'I' WHEN 1 THEN 'II' ELSE '' END}) AS best
  FROM paths p JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.i GROUP BY p.conv_id
), edits AS (
  SELECT conv_id, op, count_if(op <> 'I') OVER w AS i, count_if(op <> 'D') OVER w AS pos
  FROM (SELECT conv_id, unnest(string_split(best.audit, '')) AS op, unnest(range(len(best.audit))) AS spot FROM ended WHERE best.audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY spot)
), parts AS (
  SELECT e.conv_id, e.op, e.pos, t.role, CASE WHEN e.op = 'I' THEN '' ELSE t.text END AS text,
    max(CASE WHEN e.pos = 1 AND e.op = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (pos - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body FROM parts WHERE op <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(repeated) AS duplicate, count_if(truncated) AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  e.best.cost AS cost, e.best.audit AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
