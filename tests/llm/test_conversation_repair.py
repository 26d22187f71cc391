import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txguard.llm import conversation_repair as cr
from txguard.llm.conversation_repair import damage, repair_conversations, repair_report

ROWS = "conv_id long, turn long, role string, text string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """The report of rows (conv, turn, role, text) by plain Python."""
    out = []
    after = damaged(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            solid = text.strip(" \t\n\x0b\f\r")
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, messages = forward(turns)
        out.append((conv, gaps, *faults.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{a}:{b}" for a, b in messages).encode()).hexdigest()))
    return sorted(out, key=repr)


def forward(turns):
    """Least (cost, edits) per state, kept with all their text."""
    def inserted(st):
        st = dict(st)
        for state in ("", "s", "a", "u"):
            if state in st:
                to = "a" if state == "u" else "u"
                c, e, m = st[state]
                new = (c + 3, e + "I", m + [({"u": "user", "a": "assistant"}[to], "")])
                if to not in st or new[:2] < st[to][:2]:
                    st[to] = new
        return st

    st = inserted({"": (0, "", [])})
    for role, text, must_go, late in turns:
        new = {}
        for state, (c, e, m) in st.items():
            to = "a" if state == "u" else "u"
            options = [(state, (c + 4, e + "D", m))]
            if not must_go:
                options.append((to, (c + 3 + 3 * late, e + "R", [*m, ({"u": "user", "a": "assistant"}[to], text)])))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    options.append((role[:1], (c + 3 * late, e + "K", [*m, (role, text)])))
            for to, value in options:
                if to not in new or value[:2] < new[to][:2]:
                    new[to] = value
        st = inserted(new)
    return min((st[s] for s in ("", "a") if s in st), key=lambda v: v[:2])


def cheapest_by_trying_all(turns):
    """All edit strings up to a length, no dynamic programme."""
    found = []
    for n_insert in range(4):
        for edits in set(itertools.permutations(["I"] * n_insert + ["x"] * len(turns))) if turns or n_insert else {()}:
            for letters in itertools.product("DKR", repeat=len(turns)):
                it, at, state, cost, ok, audit, out = iter(letters), 0, "", 0, True, "", []
                for e in edits:
                    letter = "I" if e == "I" else next(it)
                    audit += letter
                    to = "a" if state == "u" else "u"
                    if letter == "I":
                        cost, state = cost + 3, to
                        continue
                    role, _, must_go, late = turns[at]
                    at += 1
                    if letter == "D":
                        cost += 4
                        continue
                    if must_go or (letter == "K" and not (role[:1] == to or (role[:1] == "s" and state == ""))):
                        ok = False
                        break
                    cost += 3 * late + (3 if letter == "R" else 0)
                    state = role[:1] if letter == "K" else to
                if ok and state in ("", "a"):
                    found.append((cost, audit))
    return min(found)


def test_tables_against_trying_all_edits():
    rng = random.Random(1)
    t = cr.tables()
    for _ in range(250):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "u"]), f"{k}.", rng.random() < 0.2, rng.random() < 0.3)
                 for k in range(rng.randrange(5))]
        symbols = [cr.GO if go else 2 * ("sua".find(r[:1]) if r and r[0] in "sua" else 3) + late for r, _, go, late in turns]
        edits, state, front, cost = cr.trace(np.array(symbols, np.uint8), t.end, cr.NOTHING)
        got = (cost + t.vectors[front][cr.NOTHING], edits + t.closing(state))
        assert got == cheapest_by_trying_all(turns) == forward(turns)[:2]


def conversations(seed, n=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why? ", " \n", "", None, "é!", f"Text {rng.randrange(4)}.", "x" * 50])
            rows.append((conv * 7, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    return rows


def report(spark, rows, parts=8):
    pieces = repair_conversations(spark, damage(spark.createDataFrame(rows, ROWS).repartition(parts)), dropped_col="dropped")
    got = repair_report(pieces)
    assert got.columns == ["conv_id", *NAMES]
    return sorted(map(tuple, got.collect()), key=repr)


def test_conversations_against_brute_force(spark):
    rows = conversations(1) + [(None, None, None, None), (None, 3, "user", "a."), (-5, 1, "user", "Only a question.")]
    assert report(spark, rows) == brute(rows)


@pytest.mark.parametrize(("span_rows", "span_bytes"), [(3, 4 << 20), (4096, 100)])
def test_long_conversations_in_many_spans(spark, span_rows, span_bytes):
    """One conversation has most rows, many of them equal; spans and partitions cut it at any place."""
    rng = random.Random(4)
    rows = conversations(2, 25) + [(3, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "Other", f"T{k}."]))
                                   for k in range(1500)]
    rows += [(11, 5, "user", "Again and again.")] * 300
    pieces = repair_conversations(spark, damage(spark.createDataFrame(rows, ROWS)), dropped_col="dropped", span_rows=span_rows,
                                  span_bytes=span_bytes).persist()
    assert pieces.filter("not closed").groupBy("conv_id").count().agg(F.max("count")).first()[0] > 20
    assert sorted(map(tuple, repair_report(pieces).collect()), key=repr) == brute(rows)
    pieces.unpersist()


def test_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair_report(repair_conversations(spark, damage(empty), dropped_col="dropped")).count() == 0
    # a conversation of which nothing is left
    none = [(c, t, "user", "Hello.") for c in range(40) for t in range(2)
            if all(zlib.crc32(f"{c}:{k}".encode()) % 20 == 0 for k in range(2)) or t == 0 and zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert none and report(spark, none) == brute(none)
    assert any(r[7] == "" and r[6] == 0 for r in report(spark, none))
    rows = conversations(5, 10)
    df = spark.createDataFrame(rows, ROWS)
    for name in ("conv", "pos", "place", "head", "tie", "gone", "key", "kind", "stats", "closed", "again", "dropped", "news"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    got = repair_report(repair_conversations(spark, damage(df), dropped_col="dropped")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    long_ = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "ok.")]
    assert report(spark, long_) == brute(long_)


def test_messages_are_the_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hi."), (1, 2, "user", " "), (2, 0, "tool", "Out.")]
    got = repair_conversations(spark, spark.createDataFrame(rows, ROWS)).collect()
    text = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        text.setdefault(r["conv_id"], []).extend((m["role"], m["text"]) for m in r["messages"])
    assert text == {1: [("system", "Be brief."), ("user", ""), ("assistant", "Hi.")], 2: []}
