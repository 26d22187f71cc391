"""Cheapest repair of conversations, computed by block tables (the method of Four Russians).

A conversation is repaired by edits until the initials of its roles read
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty
user or assistant turn 3; a truncated turn that stays costs 3 more; blank and
duplicate turns must go.  Four states say what was emitted so far (nothing, the
system turn, a user turn, an assistant turn), so the costs of finishing from a
place form a vector of four numbers.  Less its minimum such a vector is one of a
few dozen, which are found once by closing the end's vector under all symbols.

*Tables*: for every block of ``BLOCK`` symbols and every vector at its right end
there is the vector at its left end, the cost between, and, for each state that
enters on the left, the state that leaves on the right.  A conversation is
processed by one lookup per block, from its end to its start.  For the edits a
block is *expanded* backward into its inner vectors and walked forward, taking
the ASCII-least edit among the cheapest; an edit's letter fixes the next state,
so this greedy walk gives the least string of all cheapest ones.

*Scale*: rows are range-sorted by conversation and place.  A conversation inside
one partition is repaired there.  One that crosses partitions or has many turns
is cut in spans of bounded size: spans look their blocks up for all vectors at
once, these small maps are composed per conversation, and every span is then
traced on its own.  No task holds a conversation's turns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch

# Costs of the edits, and the damage of the query.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
END_MARKS = ".!?"
DAMAGE_KINDS = 20

#: Symbols of a block in the tables.
BLOCK = 4
#: Turns and bytes of text of a span.
SPAN_ROWS, SPAN_BYTES = 4096, 1 << 20

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: Symbols: initial s, u, a or another, clean or truncated; a turn that must go; no turn (fills a block up).
GO, NONE = 8, 9
SYMBOLS = 10
LEGAL_PAIRS = {"su", "ua", "au"}
_NEXT_TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_FAR = 10**6


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one turn, in ASCII order: letter, cost, next state."""
    out = [("D", DELETE, state)]
    if symbol == GO:
        return out
    initial, late = symbol // 2, TRUNCATED * (symbol % 2)
    turn = _NEXT_TURN[state]
    if initial == turn - SYSTEM or (initial == 0 and state == NOTHING):
        out.append(("K", KEEP + late, SYSTEM if initial == 0 else turn))
    return [*out, ("R", REROLE + late, turn)]


def _with_inserts(v: list[int]) -> tuple[int, ...]:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[NOTHING], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs of finishing in front of a turn, from those behind it."""
    return _with_inserts([min(cost + after[to] for _, cost, to in _moves(symbol, s)) for s in range(4)])


class Tables:
    """``vectors``, and by vector at the right end and block: ``left``, ``cost`` and ``leaves[.., state]``."""

    def __init__(self):
        self.end = 0
        self.vectors = [_with_inserts([0, _FAR, _FAR, 0])]
        known, at = {self.vectors[0]: 0}, 0
        left, cost = [], []
        while at < len(self.vectors):
            left.append([])
            cost.append([])
            for symbol in range(SYMBOLS):
                raw = self.vectors[at] if symbol == NONE else _before(symbol, self.vectors[at])
                norm = tuple(c - min(raw) for c in raw)
                if norm not in known:
                    known[norm] = len(self.vectors)
                    self.vectors.append(norm)
                left[-1].append(known[norm])
                cost[-1].append(min(raw))
            at += 1
        self.left1, self.cost1 = np.array(left, np.int32), np.array(cost, np.int64)
        n = len(self.vectors)
        leaves1 = np.array([[[self.step(v, c, s)[1] for s in range(4)] for c in range(SYMBOLS)] for v in range(n)], np.int8)
        self.left, self.cost, self.leaves = self.left1, self.cost1, leaves1
        for _ in range(BLOCK - 1):           # one more symbol in front of all blocks
            inner = self.left[:, None, :]                                         # vector behind the new symbol
            symbol = np.arange(SYMBOLS)[None, :, None]
            code = np.arange(self.left.shape[1])[None, None, :]
            cost = self.cost[:, None, :] + self.cost1[inner, symbol]
            leaves = self.leaves[np.arange(n)[:, None, None, None], code[..., None], leaves1[inner, symbol]]
            self.left = self.left1[inner, symbol].reshape(n, -1)
            self.cost = cost.reshape(n, -1)
            self.leaves = leaves.reshape(n, -1, 4)

    def step(self, v: int, symbol: int, state: int) -> tuple[str, int]:
        """Least cheapest edits of one turn with vector ``v`` behind it, inserts in front included, and the next state."""
        if symbol == NONE:
            return "", state
        after = self.vectors[v]
        here = _before(symbol, after)
        edits = ""
        while True:
            now = here[state]
            options = [(letter, to) for letter, cost, to in _moves(symbol, state) if cost + after[to] == now]
            if INSERT + here[_NEXT_TURN[state]] == now:
                options.append(("I", -1))
            letter, to = min(options)
            edits += letter
            if to >= 0:
                return edits, to
            state = _NEXT_TURN[state]

    def closing(self, state: int) -> str:
        """Inserts behind the last turn."""
        return {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=200_000)
def _expanded(v: int, block: tuple[int, ...], state: int) -> tuple[str, int]:
    """Edits of a block and the state that leaves it: backward through the inner vectors, then forward."""
    t = tables()
    behind = []
    for symbol in reversed(block):
        behind.append(v)
        v = int(t.left1[v, symbol])
    edits = ""
    for symbol, right in zip(block, reversed(behind)):
        more, state = t.step(right, symbol, state)
        edits += more
    return edits, state


def _blocks(symbols: np.ndarray) -> tuple[list[tuple[int, ...]], list[int]]:
    full = np.concatenate([symbols, np.full(-len(symbols) % BLOCK, NONE, np.uint8)]).reshape(-1, BLOCK).astype(np.int64)
    return list(map(tuple, full.tolist())), (full @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()


def span_map(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector behind the span: the vector in front, the cost, and the leaving state by entering state."""
    t = tables()
    n = len(t.vectors)
    left, cost, leaves = np.arange(n), np.zeros(n, np.int64), np.tile(np.arange(4), (n, 1))
    for code in reversed(_blocks(symbols)[1]):
        leaves = np.take_along_axis(leaves, t.leaves[left, code].astype(np.int64), axis=1)
        cost = cost + t.cost[left, code]
        left = t.left[left, code]
    return left, cost, leaves


def trace(symbols: np.ndarray, right: int, state: int) -> tuple[str, int, int, int]:
    """Edits of a span entered in ``state`` with vector ``right`` behind it; leaving state, front vector, cost."""
    t = tables()
    blocks, codes = _blocks(symbols)
    behind, cost = [], 0
    for code in reversed(codes):
        behind.append(right)
        cost += int(t.cost[right, code])
        right = int(t.left[right, code])
    edits = []
    for block, v in zip(blocks, reversed(behind)):
        more, state = _expanded(v, block, state)
        edits.append(more)
    return "".join(edits), state, right, cost


def apply_edits(edits: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """The turns that the edits leave, from the state in front of them."""
    out, at = [], 0
    for letter in edits:
        turn = _NEXT_TURN[state]
        if letter == "I":
            out.append((("user", "assistant")[turn == ASSISTANT], ""))
            state = turn
            continue
        if letter != "D":
            system = letter == "K" and roles[at][:1] == "s"
            out.append((roles[at] if letter == "K" else ("user", "assistant")[turn == ASSISTANT], texts[at]))
            state = SYSTEM if system else turn
        at += 1
    return out


def symbol_of(role: str, text: str, seen: bool) -> tuple[int, str]:
    """The symbol of a turn and its first fault: blank, duplicate, truncated or none."""
    end = text.rstrip(SPACE)
    if not end:
        return GO, "blank"
    if seen:
        return GO, "duplicate"
    initial = INITIALS.find(role[:1]) if role else -1
    late = end[-1] not in END_MARKS
    return 2 * (initial if initial >= 0 else 3) + late, "truncated" if late else ""


# ---- spans of the sorted rows ----

_STATS = ("low", "high", "turns", "first", "last", "illegal", "n")


def _stats(turns: list, roles: list[str]) -> dict:
    """Figures of sorted turns that can be joined with those of the turns behind: extremes, distinct turns, illegal pairs."""
    known = [t for t in turns if t is not None]
    first = [r[:1] for r in roles]
    return {"low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
            "first": first[0] if first else None, "last": first[-1] if first else None,
            "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(first, first[1:])), "n": len(roles)}


def _joined(a: dict, b: dict) -> dict:
    if not a["n"] or not b["n"]:
        return dict(a if a["n"] else b)
    both = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    return {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
            "turns": both, "first": a["first"], "last": b["last"], "n": a["n"] + b["n"],
            "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL_PAIRS)}


def _gaps(s: dict) -> int:
    return 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]


_MESSAGE = pa.struct([("role", pa.string()), ("text", pa.string())])
_PIECE = [("pos", pa.int64()), ("closed", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
          ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
          ("messages", pa.list_(_MESSAGE))]
_SPAN = [("stats", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
PIECE_DDL = ("pos long, closed boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
             "audit string, messages array<struct<role: string, text: string>>")
SPAN_DDL = "stats string, roles array<string>, texts array<string>"


def _batch(rows: list[dict], conv_type: pa.DataType, fields: list) -> pa.RecordBatch:
    schema = pa.schema([("conv", conv_type), *fields])
    return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _whole(conv, pos: int, turns: list, roles: list[str], texts: list[str]) -> dict:
    """The repair of a conversation that lies in one span."""
    t = tables()
    faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    seen, symbols = set(), []
    for turn in zip(roles, texts):
        symbol, fault = symbol_of(*turn, turn in seen)
        seen.add(turn)
        symbols.append(symbol)
        faults[fault] += 1
    edits, state, front, cost = trace(np.array(symbols, np.uint8), t.end, NOTHING)
    audit = edits + t.closing(state)
    messages = apply_edits(audit, roles, texts, NOTHING)
    stats = _stats(turns, roles)
    return {"conv": conv, "pos": pos, "closed": True, "gaps": _gaps(stats), "illegal": stats["illegal"],
            **{k: faults[k] for k in ("blank", "duplicate", "truncated")}, "cost": cost + t.vectors[front][NOTHING],
            "audit": audit, "messages": [{"role": r, "text": x} for r, x in messages]}


def _cut(batches: Iterator[pa.RecordBatch], span_rows: int, span_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition -> whole conversations repaired, the others as spans.

    The first and the last conversation of a partition may go on in its
    neighbours, so these stay open, as do those with more rows than a span.
    """
    out: list[dict] = []
    weight = 0
    conv = pos = conv_type = None
    turns, roles, texts = [], [], []
    held = 0
    first, started, cut = True, False, False

    def flush(is_open: bool) -> None:
        nonlocal turns, roles, texts, held, weight
        if is_open:
            out.append({"conv": conv, "pos": pos, "closed": False, "stats": json.dumps(_stats(turns, roles)),
                        "roles": roles, "texts": texts})
        else:
            out.append(_whole(conv, pos, turns, roles, texts))
        weight += held + 200
        turns, roles, texts, held = [], [], [], 0

    for batch in batches:
        conv_type = batch.schema.field(0).type
        for c, p, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns)):
            if not started or c != conv:
                if started:
                    flush(first or cut)
                    first = False
                conv, pos, started, cut = c, p, True, False
            if gone:
                continue
            if len(roles) >= span_rows or held >= span_bytes:
                flush(True)
                pos, cut = p, True
            turns.append(turn)
            roles.append(role)
            texts.append(text)
            held += len(text) + len(role) + 16
            if weight >= span_bytes:
                yield _batch(out, conv_type, _PIECE + _SPAN)
                out, weight = [], 0
    if started:
        flush(True)
        yield _batch(out, conv_type, _PIECE + _SPAN)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans with the places of their first occurrences -> symbols, fault counts and map."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            new = set(r["news"] or ())
            pairs = [symbol_of(role, text, k not in new) for k, (role, text) in enumerate(zip(r["roles"], r["texts"]))]
            faults = [f for _, f in pairs]
            symbols = np.array([s for s, _ in pairs], np.uint8)
            left, cost, leaves = span_map(symbols)
            stats = json.loads(r["stats"]) | {k: faults.count(k) for k in ("blank", "duplicate", "truncated")}
            rows.append({"conv": r["conv"], "pos": r["pos"], "stats": json.dumps(stats), "symbols": symbols.tobytes(),
                         "left": left.tolist(), "cost": cost.tolist(), "leaves": leaves.ravel().tolist()})
        yield _batch(rows, batch.schema.field(0).type, [("pos", pa.int64()), ("stats", pa.string()), ("symbols", pa.binary()),
                                                        ("left", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())),
                                                        ("leaves", pa.list_(pa.int32()))])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the maps of its spans -> for each span the vector behind it and the state that enters it."""
    t = tables()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans = sorted(r["spans"], key=lambda s: s["pos"])
            right, behind, cost = t.end, [], 0
            for s in reversed(spans):
                behind.append(right)
                cost += s["cost"][right]
                right = s["left"][right]
            cost += t.vectors[right][NOTHING]
            stats, faults, state = _stats([], []), {"blank": 0, "duplicate": 0, "truncated": 0}, NOTHING
            for k, (s, v) in enumerate(zip(spans, reversed(behind))):
                more = json.loads(s["stats"])
                faults = {name: n + more[name] for name, n in faults.items()}
                stats = _joined(stats, {name: more[name] for name in _STATS})
                rows.append({"conv": r["conv"], "pos": s["pos"], "right": v, "state": state, "last": k == len(spans) - 1,
                             "whole": None})
                state = s["leaves"][4 * v + state]
            rows[-1]["whole"] = json.dumps({"gaps": _gaps(stats), "illegal": stats["illegal"], **faults, "cost": cost})
        yield _batch(rows, batch.schema.field(0).type, [("pos", pa.int64()), ("right", pa.int32()), ("state", pa.int32()),
                                                        ("last", pa.bool_()), ("whole", pa.string())])


def _trace_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            edits, state, _, _ = trace(np.frombuffer(r["symbols"], np.uint8), r["right"], r["state"])
            if r["last"]:
                edits += tables().closing(state)
            messages = apply_edits(edits, r["roles"], r["texts"], r["state"])
            rows.append({"conv": r["conv"], "pos": r["pos"], "closed": False, "audit": edits,
                         "messages": [{"role": a, "text": b} for a, b in messages],
                         **(json.loads(r["whole"]) if r["whole"] else {})})
        yield _batch(rows, batch.schema.field(0).type, _PIECE)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows ``conv_id, turn, role, text, dropped`` after the deterministic damage of the query.

    ``crc32(conv_id:turn) % 20`` decides: 0 drops a row (it stays as a mark with
    ``dropped`` true), 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3
    repeats it, 4 sets role user.  Nulls in any of the four count as one space
    there, and null roles and texts become one.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    r = rows.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                    (F.crc32(name) % DAMAGE_KINDS).alias("kind"))
    kind = F.col("kind")
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    r = r.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                 (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return r.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).drop("again")


def repair_conversations(spark: SparkSession, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", dropped_col: str | None = None,
                         span_rows: int = SPAN_ROWS, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The repaired conversations, in pieces: id, ``pos``, ``closed``, figures, ``audit``, ``messages``.

    A ``closed`` row is a whole conversation.  The others have several pieces in
    the order of ``pos``: their audits and messages follow each other, and the
    last one has the figures of the conversation (null before).  Turns are taken
    by ``turn``, nulls first, ties by role, then by the text's first 64 code
    points and its hash; repeated rows are turns of their own.  Null roles and
    texts are one space; a null id is a conversation like others.  A row with
    ``dropped_col`` true is no turn, but its conversation is reported, with an
    empty audit if none is left.  Other columns are not read; an empty table
    gives an empty result.
    """
    scratch = Scratch(spark, "conversations")
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    gone = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    r = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
                    F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"))
    # equal rows may be a third of all: the place of a row in the input parts them
    r = r.withColumns({"head": F.substring("text", 1, 64), "tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("tie"), F.col("place")]
    placed = (r.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "gone"))
    conv_ddl = f"conv {r.schema['conv'].dataType.simpleString()}"
    cut = scratch.write(placed.mapInArrow(lambda it: _cut(it, span_rows, span_bytes), f"{conv_ddl}, {PIECE_DDL}, {SPAN_DDL}"))
    spans = cut.filter("not closed").select("conv", "pos", "stats", "roles", "texts")
    # where each (role, text) of an open conversation stands first; only hashes move
    turn = F.posexplode(F.zip_with("roles", "texts", lambda a, b: F.unhex(F.md5(F.concat(F.length(a).cast("string"), F.lit(":"), a, b)))))
    keys = spans.select("conv", "pos", turn.alias("k", "key"))
    first = keys.groupBy("conv", "key").agg(F.min(F.struct("pos", "k")).alias("f")).select("f.*")
    news = first.groupBy("pos").agg(F.collect_list("k").alias("news"))
    maps = scratch.write(spans.join(news, "pos", "left").select("conv", "pos", "stats", "roles", "texts", "news").mapInArrow(
        _maps, f"{conv_ddl}, pos long, stats string, symbols binary, left array<int>, cost array<long>, leaves array<int>"))
    by_conv = maps.groupBy("conv").agg(F.collect_list(F.struct("pos", "stats", "left", "cost", "leaves")).alias("spans"))
    entered = by_conv.mapInArrow(_compose, f"{conv_ddl}, pos long, right int, state int, last boolean, whole string")
    to_trace = (spans.join(maps.select("pos", "symbols"), "pos").join(entered.drop("conv"), "pos")
                .select("conv", "pos", "roles", "texts", "symbols", "right", "state", "last", "whole"))
    traced = to_trace.mapInArrow(_trace_spans, f"{conv_ddl}, {PIECE_DDL}")
    whole = cut.filter("closed").drop("stats", "roles", "texts")
    return whole.unionByName(traced).withColumnRenamed("conv", conv_col)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place -> one row per conversation, its text passed through one running hash."""
    conv_type = None
    now: dict | None = None
    for batch in batches:
        conv_type = batch.schema.field(0).type
        done = []
        for r in batch.to_pylist():
            if now is None or r["conv"] != now["conv"]:
                if now is not None:
                    done.append(now)
                now = {"conv": r["conv"], "audit": [], "hash": hashlib.sha256(), "some": False}
            now["audit"].append(r["audit"])
            for line in r["lines"]:
                now["hash"].update(("\n" if now["some"] else "").encode() + line.encode())
                now["some"] = True
            if r["cost"] is not None:
                now |= {k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        if done:
            yield _report_batch(done, conv_type)
    if now is not None:
        yield _report_batch([now], conv_type)


_REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
           ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_REPORT_DDL = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
               "repaired_sha256 string")


def _report_batch(rows: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
    rows = [r | {"audit": "".join(r["audit"]), "repaired_sha256": r["hash"].hexdigest()} for r in rows]
    return _batch(rows, conv_type, _REPORT)


def _lines() -> Column:
    return F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))


def repair_report(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``repair_conversations``: figures, audit and SHA-256 of the repaired text.

    SHA-256 has to read a text in order, so the pieces of one long conversation
    pass through one running hash; the task holds a batch of them and the audit,
    not the text.  Whole conversations are hashed where they are.
    """
    pieces = pieces.withColumnRenamed(conv_col, "conv")
    names = ["conv", *[n for n, _ in _REPORT]]
    whole = pieces.filter("closed").withColumn("repaired_sha256", F.sha2(F.array_join(_lines(), "\n"), 256)).select(*names)
    rest = pieces.filter("not closed").select("conv", "pos", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                              _lines().alias("lines"))
    rest = rest.repartition("conv").sortWithinPartitions("conv", "pos")
    ddl = f"conv {pieces.schema['conv'].dataType.simpleString()}, {_REPORT_DDL}"
    return whole.unionByName(rest.mapInArrow(_hashed, ddl)).withColumnRenamed("conv", conv_col)
