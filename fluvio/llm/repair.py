"""Conversation structure repair: Knuth's lightest derivation over edits of a conversation.

A conversation's roles should read ``(system? (user assistant)+)?``. Each row is
kept (0), given the role user or assistant (2) or deleted (3; a must for blank
rows and repeats), an empty turn of user or assistant may be inserted anywhere
(2), and an undeleted truncated row adds 1. Items are (rows read, last role);
a deduction takes an item and one edit to the next item with the function
``(cost + c, audit + letter)``, which is superior: it never falls below its
item, so an agenda popped by (cost, audit) finalises every item at its lightest
derivation, and the first goal item popped is the answer (Knuth 1977). The
order of equal costs is kept by a common tail, as the letters fix the cost: of
two audits of one cost over the same rows neither begins the other. An audit
also fixes the roles, since an insert or a change of role after user can only
give assistant, and user otherwise.

At scale: equal rows become one with its number, rows are dealt in ranges of
(conversation, turn, role, text) and each task reads its sorted rows once, in
pieces of at most ``PIECE`` rows or ``PIECE_BYTES``. A conversation that lies
within one piece is settled there. Of one that spans pieces (it is long, or a
range ends in it) every piece is solved from each of the four last roles to
each, which is a deduction from pieces instead of rows; pieces combine 16 at a
time until one is left, and every piece learns its part of the audit. So a
conversation of a third of all rows is worked on by as many tasks as it has
pieces. Its audit, and the order of a digest over its texts, are in the nature
of the result one row's work.

Defined results: null role and text count as one space, so a null text is blank
and a null role must change; rows of one turn are in order of role, then text
(binary), nulls first in ``turn``; rows with a null ``conv_id`` are one
conversation; an empty role has no initial, is illegal beside any other and must
change; rows whose ``times`` is 0 only name their conversation; a conversation
without rows has zeros, an empty audit and no turns; an empty table gives an
empty result; further columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import map_arrow, need, send_package, table, write_table

PIECE, PIECE_BYTES = 256, 4 << 20
#: Pieces that one deduction step combines.
FAN = 16
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
_LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\x0b\x0c\r"
#: Last role of an item: none yet, system, user, assistant.
STATES = "esua"
#: The role that an insert or a change of role gives after each last role.
_NEXT = {"e": "u", "s": "u", "a": "u", "u": "a"}
_NAME = {"u": "user", "a": "assistant"}

Arc = tuple[int, str, int, str]


def edits(initial: str, must_go: bool, truncated: bool, state: str) -> Iterator[tuple[str, str]]:
    """(letter, next state) of the edits that one row allows after ``state``."""
    yield DELETE, state
    if not must_go:
        if initial == _NEXT[state] or (initial == "s" and state == "e"):
            yield KEEP, initial
        yield REROLE, _NEXT[state]


def lightest(n: int, arcs: Callable[[int, str], Iterable[Arc]], start: str, goal: str = "") -> dict[str, tuple[int, str]]:
    """Lightest (cost, audit) of the items at position ``n``, from ``start`` at 0.

    ``arcs(i, state)`` are the deductions from an item: (next position, next
    state, cost, letters). With ``goal`` (states) the first such item ends it.
    """
    agenda, done, out = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            out[state] = (cost, audit)
            if state in goal:
                return {state: out[state]}
        if (i, _NEXT[state]) not in done:
            heapq.heappush(agenda, (cost + COST[INSERT], audit + INSERT, i, _NEXT[state]))
        for j, to, c, letters in arcs(i, state) if i < n else ():
            if (j, to) not in done:
                heapq.heappush(agenda, (cost + c, audit + letters, j, to))
    return out


@dataclass
class Row:
    """A row with the fault that counts; ``times`` equal rows follow each other."""

    turn: int | None
    role: str
    text: str
    times: int
    repeat: bool

    def __post_init__(self):
        shown = self.text.rstrip(_WHITE)
        self.blank = not shown
        self.truncated = not self.blank and shown[-1] not in ".!?"
        self.must_go = self.blank or self.repeat


def row_arcs(rows: list[Row]) -> Callable[[int, str], Iterator[Arc]]:
    def arcs(i: int, state: str) -> Iterator[Arc]:
        r = rows[i]
        more = r.times - 1  # the repeats after the first of equal rows go, and a run of D is least before any I
        for letter, to in edits(r.role[:1], r.must_go, r.truncated, state):
            add = r.truncated and not r.must_go and letter != DELETE
            yield i + 1, to, COST[letter] + add + more * COST[DELETE], letter + DELETE * more
    return arcs


def walk(rows: list[tuple[str, str, int]], audit: str, state: str) -> tuple[list[dict[str, str]], str]:
    """The turns that an audit makes of (role, text, times) rows after ``state``; the state after them."""
    turns, at = [], 0

    def inserts() -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == INSERT:
            state = _NEXT[state]
            turns.append({"role": _NAME[state], "text": ""})
            at += 1

    for role, text, times in rows:
        inserts()
        letter = audit[at]
        at += times
        if letter == KEEP:
            state = role[0]
            turns.append({"role": role, "text": text})
        elif letter == REROLE:
            state = _NEXT[state]
            turns.append({"role": _NAME[state], "text": text})
    inserts()
    return turns, state


def counts(rows: list[Row]) -> dict:
    """Counts of a piece, with what the next piece needs to go on from it."""
    out = {"n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "first": None, "last": None}
    for r in rows:
        initial = r.role[:1]
        out["n"] += r.times
        if r.blank:
            out["blank"] += r.times
        else:
            again = r.times if r.repeat else r.times - 1
            out["duplicate"] += again
            out["truncated"] += r.truncated * (r.times - again)
        out["illegal"] += r.times - 1 + (out["last"] is not None and out["last"] + initial not in _LEGAL)
        out["first"] = initial if out["first"] is None else out["first"]
        out["last"] = initial
        if r.turn is not None:
            out["turns"] += r.turn != out["high"]
            out["low"] = r.turn if out["low"] is None else out["low"]
            out["high"] = r.turn
    return out


def joined(a: dict, b: dict) -> dict:
    """Counts of two neighbouring pieces."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in _LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
            "first": b["first"] if a["first"] is None else a["first"], "last": a["last"] if b["last"] is None else b["last"]}
    return out


_COUNTS = pa.struct([(k, pa.int64()) for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")] + [("first", pa.string()), ("last", pa.string())])
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64())]))
_ARCS = pa.list_(pa.struct([("start", pa.string()), ("to", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("open", pa.bool_()), ("counts", _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _TURNS), ("rows", _ROWS)])
_SOLVED = pa.schema([("conv_id", pa.int64()), ("key", pa.string()), ("piece", pa.int64()), ("counts", _COUNTS), ("arcs", _ARCS)])
_SLICES = pa.schema([("key", pa.string()), ("piece", pa.int64()), ("state", pa.string()), ("audit", pa.string())])


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _cut(batches: Iterator[pa.RecordBatch], piece_rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces; what is whole is settled, a range's first and last conversation are open."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    out: list[dict] = []
    held: list[tuple] = []
    conv, first, cut, size, k = None, True, False, 0, 0

    def flush(whole: bool) -> None:
        nonlocal held, size, k
        piece = {"conv_id": conv, "piece": base + k, "open": not whole, "counts": None, "cost": None, "audit": None, "repaired": None, "rows": None}
        if whole:
            seen, rows = set(), []
            for turn, role, text, times in held:
                if times:
                    rows.append(Row(turn, role, text, times, (role, text) in seen))
                    seen.add((role, text))
            (_, (cost, audit)), = lightest(len(rows), row_arcs(rows), "e", "ea").items()
            piece |= {"counts": counts(rows), "cost": cost, "audit": audit, "repaired": walk([(r.role, r.text, r.times) for r in rows], audit, "e")[0]}
        else:
            piece["rows"] = [dict(zip(("turn", "role", "text", "times"), r)) for r in held]
        out.append(piece)
        held, size, k = [], 0, k + 1

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times"))):
            if held and r[0] != conv:
                flush(not first and not cut)
                first, cut = False, False
            elif held and (len(held) == piece_rows or size > PIECE_BYTES):
                cut = True
                flush(False)
            conv = r[0]
            held.append(r[1:])
            size += len(r[3])
        yield pa.RecordBatch.from_pylist(out, _PIECES)
        out = []
    if held:
        flush(False)
        yield pa.RecordBatch.from_pylist(out, _PIECES)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each open piece from every last role to every other."""
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            again = set(p["again"] or ())
            rows = [Row(r["turn"], r["role"], r["text"], r["times"], i in again) for i, r in enumerate(p["rows"]) if r["times"]]
            arcs = [{"start": s, "to": q, "cost": c, "audit": a} for s in STATES for q, (c, a) in lightest(len(rows), row_arcs(rows), s).items()]
            out.append({"conv_id": p["conv_id"], "key": p["key"], "piece": p["piece"], "counts": counts(rows), "arcs": arcs})
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


def _combine(group: pa.Table) -> pa.Table:
    """Up to ``FAN`` neighbouring pieces to one."""
    pieces = sorted(group.to_pylist(), key=lambda p: p["piece"])
    by = [{} for _ in pieces]
    for i, p in enumerate(pieces):
        for a in p["arcs"]:
            by[i].setdefault(a["start"], []).append((i + 1, a["to"], a["cost"], a["audit"]))
    arcs = [{"start": s, "to": q, "cost": c, "audit": a} for s in STATES for q, (c, a) in lightest(len(pieces), lambda i, state: by[i].get(state, ()), s).items()]
    total = pieces[0]["counts"]
    for p in pieces[1:]:
        total = joined(total, p["counts"])
    return pa.Table.from_pylist([{"conv_id": pieces[0]["conv_id"], "key": pieces[0]["key"], "piece": pieces[0]["piece"], "counts": total, "arcs": arcs}], _SOLVED)


def _slices(group: pa.Table) -> pa.Table:
    """The part of a conversation's audit that belongs to each of its pieces, and the last role before it."""
    pieces = sorted(group.to_pylist(), key=lambda p: p["piece"])
    audit = next(p["audit"] for p in pieces if p["audit"] is not None)
    out, at, state = [], 0, "e"
    for k, p in enumerate(pieces):
        begin, before = at, state
        for initial, times in zip(p["initials"], p["times"]):
            while audit[at] == INSERT:
                at, state = at + 1, _NEXT[state]
            state = {KEEP: initial, REROLE: _NEXT[state], DELETE: state}[audit[at]]
            at += times
        out.append({"key": p["key"], "piece": p["piece"], "state": before, "audit": audit[begin:at] if k + 1 < len(pieces) else audit[begin:]})
    return pa.Table.from_pylist(out, _SLICES)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of open pieces."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("turns", _TURNS)])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{"conv_id": p["conv_id"], "piece": p["piece"], "whole": False, "turns": walk(
            [(r["role"], r["text"], r["times"]) for r in p["rows"] if r["times"]], p["audit"], p["state"])[0]} for p in batch.to_pylist()], schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns, piece after piece."""
    from hashlib import sha256

    schema = pa.schema([("key", pa.string()), ("sha256", pa.string())])
    key, h, some = None, sha256(), False
    for batch in batches:
        out = []
        for k, turns in zip(batch.column("key").to_pylist(), batch.column("turns").to_pylist()):
            if k != key:
                if key is not None:
                    out.append({"key": key, "sha256": h.hexdigest()})
                key, h, some = k, sha256(), False
            for t in turns:
                h.update((("\n" if some else "") + t["role"] + ":" + t["text"]).encode())
                some = True
        yield pa.RecordBatch.from_pylist(out, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "sha256": h.hexdigest()}], schema)


def _key() -> Column:
    """A conversation's key, where null equals null."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("key")


@dataclass
class Repaired:
    """``report``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation.

    ``turns``: ``conv_id, piece, whole, turns`` (array of ``role, text``), the
    repaired turns in order of ``piece``; one that is not whole has more pieces.
    """

    report: DataFrame
    turns: DataFrame

    def digests(self) -> DataFrame:
        """``key, sha256`` of the lines ``role:text`` of each conversation; of one with several pieces, in one pass over them in order."""
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        parts = self.turns.where("NOT whole").select(_key(), "piece", "turns").repartition("key").sortWithinPartitions("key", "piece")
        return self.turns.where("whole").select(_key(), F.sha2(lines, 256).alias("sha256")).union(map_arrow(parts, _digest, "key string, sha256 string"))


def repair(rows: DataFrame, piece_rows: int = PIECE) -> Repaired:
    """Repair conversations given as ``conv_id, turn`` (longs), ``role, text`` and, if there, ``times`` (equal rows that a row stands for)."""
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1)
    t = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times.alias("times"))
    t = t.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    t = t.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = write_table(map_arrow(t, partial(_cut, piece_rows=piece_rows), _ddl(_PIECES)), "repair-pieces")
    whole = pieces.where("NOT open").select("conv_id", "counts", "cost", "audit")

    opened = pieces.where("open").select(_key(), "conv_id", "piece", "rows")
    each = opened.select("key", "piece", F.posexplode("rows").alias("i", "r")).where("r.times > 0").select("key", "piece", "i", "r.role", F.sha2("r.text", 256).alias("text"))
    first = each.groupBy("key", "role", "text").agg(F.min(F.struct("piece", "i")).alias("m")).select("key", "m.piece", "m.i", F.lit(True).alias("new"))
    again = each.join(first, ["key", "piece", "i"], "left").where("new IS NULL").groupBy("key", "piece").agg(F.collect_list("i").alias("again"))
    solved = write_table(map_arrow(opened.join(again, ["key", "piece"], "left"), _solve, _ddl(_SOLVED)), "repair-solved")
    while solved.groupBy("key").count().where("count > 1").limit(1).count():
        place = solved.select("key", "piece", F.expr(f"(row_number() OVER (PARTITION BY key ORDER BY piece) - 1) DIV {FAN}").alias("batch"))
        send_package(rows.sparkSession)
        solved = write_table(solved.join(place, ["key", "piece"]).groupBy("key", "batch").applyInArrow(_combine, _ddl(_SOLVED)), "repair-solved")
    goal = F.array_min(F.expr("transform(filter(arcs, x -> x.start = 'e' AND x.to IN ('e', 'a')), x -> struct(x.cost, x.audit))"))
    ended = solved.select("conv_id", "key", "counts", goal.alias("goal")).select("conv_id", "key", "counts", "goal.cost", "goal.audit")

    report = whole.union(ended.select("conv_id", "counts", "cost", "audit"))
    c = lambda name: F.col(f"counts.{name}")
    span = c("high").cast("decimal(20,0)") - c("low") + 1 - c("turns")
    gaps = F.when(span.isNull(), 0).otherwise(F.least(span, F.lit(2**63 - 1)).cast("long"))
    report = report.select("conv_id", gaps.alias("gaps"), *[c(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")], "cost", "audit")

    initials = F.expr("transform(filter(rows, r -> r.times > 0), r -> substr(r.role, 1, 1))")
    ends = opened.select("key", "piece", initials.alias("initials"), F.expr("transform(filter(rows, r -> r.times > 0), r -> r.times)").alias("times"))
    lead = opened.groupBy("key").agg(F.min("piece").alias("piece")).join(ended, "key").select("key", "piece", "audit")
    parts = ends.join(lead, ["key", "piece"], "left").groupBy("key").applyInArrow(_slices, _ddl(_SLICES))
    turns = map_arrow(opened.join(parts, ["key", "piece"]), _apply, "conv_id long, piece long, whole boolean, turns array<struct<role:string,text:string>>")
    return Repaired(report, pieces.where("NOT open").select("conv_id", "piece", F.lit(True).alias("whole"), F.col("repaired").alias("turns")).union(turns))


def damaged(t: DataFrame) -> DataFrame:
    """The contract's faults, by the rest of the checksum of ``conv_id:turn`` modulo 20: a dropped row has ``times`` 0, a repeated one 2."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20
    return t.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(name("role")).alias("role"),
                    F.when(fault == 1, "").when(fault == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text")).alias("text"),
                    F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired: counts, cost, audit and the digest of the repaired lines."""
    t = need(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    return digested(repair(damaged(t)))


def digested(done: Repaired) -> DataFrame:
    """The report with the digest of the repaired lines."""
    report = done.report.withColumn("key", _key())
    return report.join(done.digests(), "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))


def _add(x: str, cost: str, letter: str) -> str:
    """SQL: a derivation, cost in 12 digits before the audit, with one edit more."""
    return f"(lpad(CAST(CAST({x}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {x}[13:] || '{letter}')"


#: CRC-32 of the ASCII text {0}, bit by bit.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a // 2, 3988292384 * (a % 2)) END), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
d AS (SELECT k, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE f <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
q AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS shown, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY i) AS before,
             row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again FROM n),
r AS (SELECT *, shown = '' AS blank, again AND shown <> '' AS dup, shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut FROM q),
v AS (SELECT *, blank OR dup AS go, CAST(cut AS INTEGER) AS t FROM r),
dp AS (
  SELECT k, CAST(0 AS BIGINT) AS i, '000000000000' AS e, NULL::VARCHAR AS s, '000000000002I' AS u, '000000000004II' AS a FROM (SELECT DISTINCT k FROM o)
  UNION ALL
  SELECT k, i, e, s, u1, least(a0, {_add("u1", "2", "I")}) FROM (
    SELECT k, i, e, s, least(u0, {_add("e", "2", "I")}, {_add("s", "2", "I")}, {_add("a0", "2", "I")}) AS u1, a0 FROM (
      SELECT p.k, v.i, {_add("p.e", "3", "D")} AS e,
        least({_add("p.s", "3", "D")}, CASE WHEN NOT go AND x = 's' THEN {_add("p.e", "t", "K")} END) AS s,
        least({_add("p.u", "3", "D")}, CASE WHEN NOT go AND x = 'u' THEN least({_add("p.e", "t", "K")}, {_add("p.s", "t", "K")}, {_add("p.a", "t", "K")}) END,
              CASE WHEN NOT go THEN least({_add("p.e", "t + 2", "R")}, {_add("p.s", "t + 2", "R")}, {_add("p.a", "t + 2", "R")}) END) AS u0,
        least({_add("p.a", "3", "D")}, CASE WHEN NOT go AND x = 'a' THEN {_add("p.u", "t", "K")} END, CASE WHEN NOT go THEN {_add("p.u", "t + 2", "R")} END) AS a0
      FROM dp p JOIN v ON v.k = p.k AND v.i = p.i + 1))),
best AS (SELECT k, least(e, a) AS z FROM dp QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
letters AS (SELECT k, j, z[12 + j] AS l FROM (SELECT k, z, unnest(range(1, length(z) - 11)) AS j FROM best)),
m AS (SELECT *, sum(CAST(l <> 'I' AS INTEGER)) OVER (PARTITION BY k ORDER BY j) AS i FROM letters),
y AS (SELECT m.k, m.j, m.l, v.role, v.text, v.x FROM m LEFT JOIN v ON m.l <> 'I' AND v.k = m.k AND v.i = m.i),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS j, 'e' AS state, NULL::VARCHAR AS line FROM best
  UNION ALL
  SELECT y.k, y.j, CASE l WHEN 'D' THEN state WHEN 'K' THEN x ELSE CASE state WHEN 'u' THEN 'a' ELSE 'u' END END,
         CASE l WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE l WHEN 'R' THEN text ELSE '' END END
  FROM walk w JOIN y ON y.k = w.k AND y.j = w.j + 1),
lines AS (SELECT k, sha256(coalesce(string_agg(line, chr(10) ORDER BY j), '')) AS digest FROM walk GROUP BY k),
c AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
             count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM v GROUP BY k)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(z[1:12] AS BIGINT) AS cost, z[13:] AS audit, digest AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM o) ids JOIN best USING (k) JOIN lines USING (k) LEFT JOIN c USING (k)
"""
