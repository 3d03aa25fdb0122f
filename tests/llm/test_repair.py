"""Structure repair against brute force over all edit sequences, and against the registered SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fluvio.llm import repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def after_damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        f = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def faults(talk):
    seen, out = set(), []
    for _, role, text in talk:
        shown = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def in_order(rows):
    return sorted(((t, r, x) for _, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))


def brute(talk):
    """All edit sequences with up to two inserts before each row and at the end."""
    fault = faults(talk)
    per = [[("D", None, 3)] + ([] if f in ("blank", "duplicate") else [("K", r, f == "truncated"), ("R", "user", 2 + (f == "truncated")), ("R", "assistant", 2 + (f == "truncated"))])
           for f, (_, r, _) in zip(fault, talk)]
    inserts = [()] + [(a,) for a in ("user", "assistant")] + [(a, b) for a in ("user", "assistant") for b in ("user", "assistant")]
    best = None
    for gaps in itertools.product(inserts, repeat=len(talk) + 1):
        for edits in itertools.product(*per):
            audit, cost, lines, initials = "", 0, [], ""
            for k, gap in enumerate(gaps):
                for role in gap:
                    audit, cost, initials = audit + "I", cost + 2, initials + role[0]
                    lines.append(role + ":")
                if k < len(edits):
                    letter, role, c = edits[k]
                    audit, cost = audit + letter, cost + c
                    if role is not None:
                        initials += role[:1] or "?"
                        lines.append(role + ":" + talk[k][2])
            if GOOD.match(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def expected(rows, solve=brute):
    out = {}
    for c in {r[0] for r in rows}:
        talk = in_order([r for r in after_damage(rows) if r[0] == c])
        f = faults(talk)
        turns = [t for t, _, _ in talk if t is not None]
        cost, audit, lines = solve(talk)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal,
                  cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def forward(talk):
    """Plain forward dynamic programme, for long conversations; compared with ``brute`` on short ones."""
    step = {"": "u", "s": "u", "a": "u", "u": "a"}
    name = {"u": "user", "a": "assistant"}

    def closed(v):
        for _ in range(2):
            for q, (c, a, x) in list(v.items()):
                new = (c + 2, a + "I", x + [name[step[q]] + ":"])
                if step[q] not in v or new[:2] < v[step[q]][:2]:
                    v[step[q]] = new
        return v

    v = closed({"": (0, "", [])})
    for f, (_, role, text) in zip(faults(talk), talk):
        new = {}
        for q, (c, a, x) in v.items():
            options = [(q, c + 3, a + "D", x)]
            if f not in ("blank", "duplicate"):
                t, r = int(f == "truncated"), role[:1]
                options.append((step[q], c + 2 + t, a + "R", x + [name[step[q]] + ":" + text]))
                if r == step[q] or (r == "s" and q == ""):
                    options.append((r, c + t, a + "K", x + [role + ":" + text]))
            for q2, *o in options:
                if q2 not in new or tuple(o[:2]) < tuple(new[q2][:2]):
                    new[q2] = tuple(o)
        v = closed(new)
    c, a, x = min(v[q] for q in ("", "a") if q in v)
    return c, a, "\n".join(x)


def talks(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest + 1)):
            turn = rng.choice([t, t, t, 0, None])
            rows.append((c, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         rng.choice([f"Word {t}.", f"No end {t}", "Same!", " \t\v", "", None, "Éa ☃?", "ends. \n"])))
    return rows


def run(spark, rows, piece_rows=256):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("piece", F.lit("x")).repartition(3)
    got = [tuple(r) for r in repair.digested(repair.repair(repair.damaged(df), piece_rows)).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def test_forward_equals_brute_force():
    for c in range(60):
        talk = in_order([(r[0], r[1], r[2] or " ", r[3] or " ") for r in talks(c, 1, 3)])
        assert forward(talk) == brute(talk)


def test_agenda_equals_brute_force_on_short_conversations():
    for c in range(120):
        talk = in_order([(r[0], r[1], r[2] or " ", r[3] or " ") for r in talks(1000 + c, 1, 3)])
        rows = [repair.Row(t, r, x, 1, f == "duplicate") for f, (t, r, x) in zip(faults(talk), talk)]
        ((_, (cost, audit)),) = repair.lightest(len(rows), repair.row_arcs(rows), "e", "ea").items()
        lines = [t["role"] + ":" + t["text"] for t in repair.walk([(r.role, r.text, r.times) for r in rows], audit, "e")[0]]
        assert (cost, audit, "\n".join(lines)) == brute(talk)


@pytest.mark.parametrize("piece", [256, 2])
def test_query_against_a_forward_programme(spark, piece):
    """With pieces of two rows nearly every conversation spans pieces, and the hot one several levels."""
    rows = talks(7, 60, 9)
    rows = rows + rows[::4] + [(None, None, "user", "x."), (None, 1, None, None), (500, 3, "assistant", "Hi.")] + [(900, t, "user" if t % 2 else "assistant", f"Line {t % 90}" + "." * (t % 5 > 0)) for t in range(150)]
    got = run(spark, rows, piece)
    want = expected(rows, forward)
    assert got == want


def test_all_rows_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = run(spark, [(5, gone, "user", "Hello.")])
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    done = repair.repair(spark.createDataFrame([], SCHEMA))
    assert done.report.count() == 0 and done.turns.count() == 0


def test_many_equal_rows(spark):
    """A row that is there 3,000 times is one row with its number."""
    df = spark.createDataFrame([(1, 0, "user", "Same.")] * 3000 + [(1, 1, "assistant", "Yes.")], SCHEMA)
    r = repair.repair(df).report.first()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (2999, 2999, 3 * 2999, "K" + "D" * 2999 + "K")


def test_query_equals_sql(spark, tmp_path):
    rows = talks(11, 80, 8) + [(None, 2, "user", None), (7777, 2**40, "assistant", "Late")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in repair.op11_structure_repair(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in con.execute(repair.OP11_SQL).fetchall()} == got == expected(rows, forward)
