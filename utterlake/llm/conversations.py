"""Conversation structure repair: the cheapest edits that give role initials (s?(ua)+)?, and of those the least audit.

A conversation of n rows is a graph of nodes (row, state), the state being the last role given out. Forward and backward
minimum costs name all arcs that lie on some cheapest way; a set of frontier nodes then walks these arcs and takes the
least edit letter at each step.

Rows are dealt by range over (conversation, turn, role, digest), so one conversation may span many tasks. Those that lie
whole within one are solved where they stand. The first and the last of each task, and any long one, leave as segments: a
segment is a 4 x 4 matrix of costs between states, products of these give the costs at its ends, and its walk is found for
each state that it may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.runtime import dealt_by_range, materialize, table

#: Rows and characters from which a conversation leaves in segments.
SEGMENT_ROWS, SEGMENT_CHARS = 1 << 16, 16 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_INITIALS = "sua"
_WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INF = 1 << 60
MUST_GO = 0


def kind_of(role: str, must_go: bool, truncated: bool) -> int:
    """What the edits of a row hang on, as one number below 9."""
    return MUST_GO if must_go else 1 + 2 * (_INITIALS + role[:1]).index(role[:1]) + truncated if role else 7 + truncated


def _arcs(kind: int) -> list[dict[str, tuple[int, int]]]:
    """For each state the edits of a row of that kind: letter -> (next state, cost)."""
    out = []
    for s in range(4):
        arcs = {"D": (s, DELETE)}
        if kind != MUST_GO:
            initial, more = ("sua?"[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2))
            if s in _KEEPS.get(initial, {}):
                arcs["K"] = (_KEEPS[initial][s], more)
            arcs["R"] = (NEEDS[s], REROLE + more)
        out.append(arcs)
    return out


ARCS = [_arcs(k) for k in range(9)]
Costs = tuple[int, int, int, int]


def _closed(f: list[int]) -> Costs:
    """Costs to reach each state, inserts allowed."""
    user = min(f[USER], min(f[START], f[SYSTEM], f[ASSISTANT]) + INSERT)
    return f[START], f[SYSTEM], min(user, INF), min(f[ASSISTANT], user + INSERT, INF)


def _closed_back(b: list[int]) -> Costs:
    """Costs from each state on, inserts allowed."""
    user, assistant = min(b[USER], b[ASSISTANT] + INSERT, INF), min(b[ASSISTANT], b[USER] + INSERT, INF)
    return min(b[START], user + INSERT, INF), min(b[SYSTEM], user + INSERT, INF), user, assistant


@lru_cache(1 << 14)
def _step(f: Costs, kind: int) -> Costs:
    """Costs behind one row from those before it."""
    g = [INF] * 4
    for s, arcs in enumerate(ARCS[kind]):
        for t, cost in arcs.values():
            g[t] = min(g[t], f[s] + cost)
    return _closed(g)


@lru_cache(1 << 14)
def _step_back(b: Costs, kind: int) -> Costs:
    """Costs from before a row on, from those behind it."""
    return _closed_back([min(cost + b[t] for t, cost in arcs.values()) for arcs in ARCS[kind]])


def _relative(f: Costs) -> tuple[int, Costs]:
    """f as its least cost and what the others have above it: few different ones occur."""
    low = min(f)
    return low, tuple(x - low if x < INF else INF for x in f)


def forward(entry: Costs, kinds: bytes) -> list[Costs]:
    """Costs of the nodes before each row and behind the last."""
    low, f = _relative(_closed(list(entry)))
    out = [(low, f)]
    for kind in kinds:
        more, f = _relative(_step(f, kind))
        low += more
        out.append((low, f))
    return [tuple(min(low + x, INF) for x in f) for low, f in out]


def backward(exit_: Costs, kinds: bytes) -> list[Costs]:
    """Costs from the nodes before each row and behind the last on."""
    low, b = _relative(_closed_back(list(exit_)))
    out = [(low, b)]
    for kind in reversed(kinds):
        more, b = _relative(_step_back(b, kind))
        low += more
        out.append((low, b))
    return [tuple(min(low + x, INF) for x in b) for low, b in reversed(out)]


def _only(state: int) -> Costs:
    return tuple(0 if s == state else INF for s in range(4))


BEGIN, END = _closed(list(_only(START))), _closed_back([0, INF, INF, 0])


def matrix(kinds: bytes) -> list[Costs]:
    """For each state at the entry the least costs of each state at the exit."""
    return [forward(_only(s), kinds)[-1] for s in range(4)]


def product(f: Costs, m: list[Costs]) -> Costs:
    return tuple(min(min(f[s] + m[s][t] for s in range(4)), INF) for t in range(4))


def product_back(m: list[Costs], b: Costs) -> Costs:
    return tuple(min(min(m[s][t] + b[t] for t in range(4)), INF) for s in range(4))


def walks(kinds: bytes, entry: Costs, exit_: Costs, last: bool) -> list[tuple[int, int, str]]:
    """(state at the entry, state at the exit, audit) for each state at the entry that a cheapest way goes through.

    entry: costs from the conversation's start, exit_: costs to its end. Inserts behind the last row belong to what follows, where anything does.
    """
    f, b = forward(entry, kinds), backward(exit_, kinds)
    n, best = len(kinds), min(x + y for x, y in zip(f[0], b[0], strict=True))
    out = []
    for state in range(4):
        if f[0][state] + b[0][state] != best or f[0][state] >= INF:
            continue
        i, frontier, audit = 0, {state}, []
        while i < n or last:
            moves: dict[str, set[int]] = {}
            for s in frontier:
                if f[i][s] + INSERT + b[i][NEEDS[s]] == best:
                    moves.setdefault("I", set()).add(NEEDS[s])
                if i < n:
                    for letter, (t, cost) in ARCS[kinds[i]][s].items():
                        if f[i][s] + cost + b[i + 1][t] == best:
                            moves.setdefault(letter, set()).add(t)
            if not moves:
                break
            least = min(moves)
            frontier, i = moves[least], i + (least != "I")
            audit.append(least)
        out.append((state, min(frontier), "".join(audit)))
    return out


def edited(roles: list[str], texts: list[str], audit: str, state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            state = NEEDS[state]
            out.append((NAMES[state], ""))
            continue
        if letter == "K":
            state = _KEEPS[roles[i][0]][state]
            out.append((roles[i], texts[i]))
        elif letter == "R":
            state = NEEDS[state]
            out.append((NAMES[state], texts[i]))
        i += 1
    return out


class Held:
    """Rows of one conversation, or a segment of it, as they come."""

    def __init__(self) -> None:
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def faults(self) -> tuple[list[str], list[int]]:
        """The first fault of each row, "" where it has none, as far as these rows tell, and the places of the first rows of their role and text that are not blank."""
        seen, out, first = set(), [], []
        for i, (role, text) in enumerate(zip(self.roles, self.texts, strict=True)):
            shown = text.rstrip(_WHITE)
            if not shown:
                out.append("b")
            elif (role, text) in seen:
                out.append("d")
            else:
                seen.add((role, text))
                first.append(i)
                out.append("" if shown[-1] in ".!?" else "t")
        return out, first


def gaps_of(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """(least turn, largest turn, number of different turns) of ascending turns; nulls do not count."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:], strict=False))) if known else (None, None, 0)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FOUND = {
    "seg": pa.int64(), "open": pa.bool_(), **dict.fromkeys(_COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string(), "repaired": _ROWS,
    "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "faults": pa.list_(pa.string()), "firsts": pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.binary())])),
}
_FOUND_SQL = "seg long, open boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + """, audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>,
 turns array<long>, roles array<string>, texts array<string>, faults array<string>, firsts array<struct<at: int, digest: binary>>"""


def _digest(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def _solved(held: Held, with_rows: bool) -> dict:
    """The whole result for a conversation that is all here."""
    faults, _ = held.faults()
    kinds = bytes(kind_of(r, x in ("b", "d"), x == "t") for r, x in zip(held.roles, faults, strict=True))
    (_, _, audit), *_ = walks(kinds, BEGIN, END, True)
    rows = edited(held.roles, held.texts, audit)
    low, high, turns = gaps_of(held.turns)
    return {
        "open": False, "gaps": high - low + 1 - turns if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": _illegal([r[:1] for r in held.roles]), "cost": backward(END, kinds)[0][START], "audit": audit, "repaired_sha256": _digest(rows),
        "repaired": [{"role": r, "text": t} for r, t in rows] if with_rows else None,
    }


def _segment(held: Held) -> dict:
    """A part of a conversation that other tasks may hold more of."""
    faults, first = held.faults()
    named = [{"at": i, "digest": hashlib.sha256(f"{len(held.roles[i])}:{held.roles[i]}{held.texts[i]}".encode()).digest()} for i in first]
    return {"open": True, "turns": held.turns, "roles": held.roles, "texts": held.texts, "faults": faults, "firsts": named}


def _found(rows: DataFrame, with_rows: bool) -> DataFrame:
    """Solved conversations and open segments: (conv_id, columns of _FOUND). seg ascends over the rows of a conversation."""
    digest, tie = F.xxhash64("text"), F.monotonically_increasing_id()
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_digest"), F.col("_tie")]
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    dealt = dealt_by_range(named.withColumns({"_digest": digest, "_tie": tie}), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, is_open, first, done, seg, kind = None, None, True, True, [], 0, None

        def leave(open_: bool) -> None:
            nonlocal seg
            done.append({"conv_id": conv, "seg": seg} | (_segment(held) if open_ else _solved(held, with_rows)))
            seg += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d.get(c) for d in done], t) for c, t in ({"conv_id": kind} | _FOUND).items()], names=["conv_id", *_FOUND])
            done.clear()
            return out

        for b in batches:
            if b.num_rows and kind is None:
                kind, seg = b.column("conv_id").type, b.column("_part")[0].as_py() << 33
            for c, turn, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text")), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        leave(is_open)
                        first = False
                    conv, held, is_open = c, Held(), first
                elif len(held.roles) >= SEGMENT_ROWS or held.chars >= SEGMENT_CHARS:
                    is_open = True
                    leave(True)
                    held = Held()
                    yield flush()
                held.add(turn, role, text)
            if done:
                yield flush()
        if held is not None:
            leave(True)
            yield flush()

    schema = f"conv_id {named.schema['conv_id'].dataType.simpleString()}, {_FOUND_SQL}"
    return dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("_part")).mapInArrow(run, schema)


def _grouped(segments: DataFrame, body, columns: str) -> DataFrame:
    """body(rows of one conversation in order) -> its rows, for tables with a few numbers a segment."""

    def run(whole: pa.Table) -> pa.Table:
        rows = whole.sort_by("seg").to_pylist()
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"]} | r for r in body(rows)], pa.schema([whole.schema.field("conv_id"), *_arrow(columns)]))

    return segments.groupBy("conv_id").applyInArrow(run, f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, {columns}")


def _arrow(columns: str) -> list[pa.Field]:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [pa.field(name, types[kind]) for name, kind in (c.strip().split(" ") for c in columns.split(","))]


def _kinds(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, kinds, costs, edges and counts) of each open segment; rows seen in an earlier segment of their conversation are duplicates."""
    each = segments.select("conv_id", "seg", F.explode("firsts").alias("_f")).groupBy("conv_id", "_f.digest").agg(F.sort_array(F.collect_list(F.struct("seg", "_f.at"))).alias("_all"))
    repeats = each.where(F.size("_all") > 1).select(F.explode(F.slice("_all", F.lit(2), F.size("_all") - 1)).alias("_r")).groupBy(F.col("_r.seg").alias("seg")).agg(F.collect_list("_r.at").alias("repeats"))
    rows = segments.select("conv_id", "seg", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults").join(repeats, "seg", "left").select("conv_id", "seg", "turns", "initials", "faults", "repeats")
    columns = "kinds binary, matrix array<long>, low long, high long, turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in columns.split(",")]
        types = [pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 4]
        for b in batches:
            out = []
            for turns, initials, faults, again in zip(*(b.column(c).to_pylist() for c in ("turns", "initials", "faults", "repeats")), strict=True):
                for i in again or []:
                    faults[i] = "d"
                kinds = bytes(kind_of(r, x in ("b", "d"), x == "t") for r, x in zip(initials, faults, strict=True))
                costs = [x for row in matrix(kinds) for x in row]
                out.append((kinds, costs, *gaps_of(turns), initials[0], initials[-1], *(faults.count(x) for x in "bdt"), _illegal(initials)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], names=["conv_id", "seg", *names])

    return rows.mapInArrow(run, f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, seg long, {columns}")


def _costs_at_ends(rows: list[dict]) -> list[dict]:
    """Costs at the entry and exit of each segment, and the conversation's counts on its first one."""
    matrices = [[tuple(r["matrix"][4 * s : 4 * s + 4]) for s in range(4)] for r in rows]
    entries, exits = [BEGIN], [END]
    for m in matrices:
        entries.append(product(entries[-1], m))
    for m in reversed(matrices):
        exits.append(product_back(m, exits[-1]))
    exits.reverse()
    pairs = list(zip(rows, rows[1:], strict=False))
    known = [r for r in rows if r["turns"]]
    different = sum(r["turns"] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    whole = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    whole["illegal"] += sum(_illegal([a["last_initial"], b["first_initial"]]) for a, b in pairs)
    whole |= {"gaps": known[-1]["high"] - known[0]["low"] + 1 - different if known else 0, "cost": exits[0][START]}
    return [{"seg": r["seg"], "entry": list(entries[i]), "exit": list(exits[i + 1]), "last": i + 1 == len(rows)} | (whole if i == 0 else dict.fromkeys(_COUNTS)) for i, r in enumerate(rows)]


def _all_walks(kinds: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, seg, starts, stops, audits): the walks of each segment, one for each state that it may be entered in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [walks(k, tuple(f), tuple(x), last) for k, f, x, last in zip(*(b.column(c).to_pylist() for c in ("kinds", "entry", "exit", "last")), strict=True)]
            parts = [pa.array([[w[i] for w in ws] for ws in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], names=["conv_id", "seg", "starts", "stops", "audits"])

    rows = kinds.select("conv_id", "seg", "kinds").join(ends.select("seg", "entry", "exit", "last"), "seg").select("conv_id", "seg", "kinds", "entry", "exit", "last")
    return rows.mapInArrow(run, f"conv_id {kinds.schema['conv_id'].dataType.simpleString()}, seg long, starts array<int>, stops array<int>, audits array<string>")


def _taken(rows: list[dict]) -> list[dict]:
    """The state that the least walk enters each segment in."""
    out, state = [], START
    for r in rows:
        at = r["starts"].index(state)
        out.append({"seg": r["seg"], "state": state, "at": at})
        state = r["stops"][at]
    return out


def _repaired(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, seg, repaired) of open segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"role": r, "text": t} for r, t in edited(*row)] for row in zip(*(b.column(c).to_pylist() for c in ("roles", "texts", "audit", "state")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _ROWS)], names=["conv_id", "seg", "repaired"])

    rows = segments.select("conv_id", "seg", "roles", "texts").join(chosen.select("seg", "state", "audit"), "seg").select("conv_id", "seg", "roles", "texts", "audit", "state")
    return rows.mapInArrow(run, f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, seg long, repaired array<struct<role: string, text: string>>")


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): a hash takes its bytes in turn, so a conversation's segments pass through one task, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, any_ = None, None, False
        for b in batches:
            done = []
            for c, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if sha is None or c != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, any_ = c, hashlib.sha256(), False
                for r in rows.as_py():
                    sha.update((("\n" if any_ else "") + f"{r['role']}:{r['text']}").encode())
                    any_ = True
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], b.column(0).type), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
            last_type = b.column(0).type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last_type), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg").select("conv_id", "repaired")
    return rows.mapInArrow(run, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def _parts(rows: DataFrame, with_rows: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(solved conversations, open segments' repaired rows, their counts, their audits)."""
    found = materialize(_found(rows, with_rows), "conversations")
    segments = found.where("open")
    kinds = materialize(_kinds(segments), "segment-kinds")
    ends = materialize(_grouped(kinds.drop("kinds"), _costs_at_ends, "seg long, entry array<long>, exit array<long>, last boolean, " + ", ".join(f"{c} long" for c in _COUNTS)), "segment-ends")
    walked = materialize(_all_walks(kinds, ends), "segment-walks")
    taken = _grouped(walked.drop("audits"), _taken, "seg long, state int, at int")
    chosen = materialize(walked.join(taken.select("seg", "state", "at"), "seg").select("conv_id", "seg", "state", F.get("audits", F.col("at")).alias("audit")), "segment-audits")
    return found.where("NOT open"), _repaired(segments, chosen), ends, chosen


def _met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined to b by conv_id, null ones too."""
    return a.join(b.withColumnRenamed("conv_id", "_of"), F.col("conv_id").eqNullSafe(F.col("_of")), how).drop("_of")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, at, role, text) of the repaired conversations, in each of them by ascending (seg, at)."""
    solved, pieces, _, _ = _parts(rows, True)
    return solved.select("conv_id", "seg", "repaired").unionByName(pieces).select("conv_id", "seg", F.posexplode("repaired").alias("at", "_r")).select("conv_id", "seg", "at", "_r.role", "_r.text")


def reports(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    rows: (conv_id, turn, role, text), other columns are ignored. Rows stand by turn, null turns first; rows of one turn by
    role and then by a hash of their text. Null roles and texts are one blank, null conv_ids are one conversation, equal
    rows are duplicates of the first. conversations: those to report on (conv_id), also where rows has none of theirs:
    zeros, an empty audit and the hash of nothing. An empty table gives an empty result.
    """
    solved, pieces, ends, chosen = _parts(rows, False)
    counts = ends.where("cost IS NOT NULL").select("conv_id", *_COUNTS)
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    opened = _met(_met(counts, audits), _hashed(pieces))
    columns = [*_COUNTS, "audit", "repaired_sha256"]
    found = solved.select("conv_id", *columns).unionByName(opened.select("conv_id", *columns))
    if conversations is None:
        return found
    ids = conversations.select("conv_id").distinct()
    none = {c: F.lit(0).cast("long") for c in _COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(_digest([]))}
    return _met(ids, found, "left").select("conv_id", *(F.coalesce(c, none[c]).alias(c) for c in columns))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the crc32 of conv_id:turn: rows dropped, emptied, without sentence ends, repeated, or said by the user."""
    blank: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(blank["conv_id"], F.lit(":"), blank["turn"]).cast("binary")) % 20
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace(blank["text"], "[.!?]", "")).otherwise(blank["text"])
    role = F.when(F.col("_fate") == 4, "user").otherwise(blank["role"])
    put = rows.select("conv_id", "turn", "role", "text", fate.alias("_fate")).where("_fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.expr("explode(array_repeat(0, if(_fate = 3, 2, 1)))").alias("_copy"))
    return put.drop("_copy")


def _query(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return reports(damaged(given), given)


QUERIES = {"op11_conversation_repair": _query}
ORACLES: dict = {}
