import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from utterlake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def every_repair(rows, faults):
    """The least (cost, audit, repaired rows) over all edit strings, found by trying them: at most two inserts stand side by side in a cheapest one."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in roles)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, list(roles))
        if inserts < 2:
            for r in ("user", "assistant"):
                go(i, [*roles, (r, "")], cost + 2, audit + "I", inserts + 1)
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if faults[i] not in "bd":
                more = faults[i] == "t"
                go(i + 1, [*roles, (role, text)], cost + more, audit + "K", 0)
                for r in ("user", "assistant"):
                    go(i + 1, [*roles, (r, text)], cost + 2 + more, audit + "R", 0)

    go(0, [], 0, "", 0)
    return best


def least_repair(rows, faults):
    """(cost, audit, repaired) by dynamic programming from the end over whole strings."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    after = None
    for i in range(len(rows), -1, -1):
        best = {s: [(0, "", ())] if i == len(rows) and s in ("", "a") else [] for s in following}
        for s, to in following.items():
            if i < len(rows):
                role, text = rows[i]
                best[s] += [(c + 3, "D" + a, r) for c, a, r in after[s]]
                if faults[i] not in "bd":
                    more, first = faults[i] == "t", role[:1]
                    if first == to or (first == "s" and s == ""):
                        best[s] += [(c + more, "K" + a, ((role, text), *r)) for c, a, r in after[first]]
                    best[s] += [(c + 2 + more, "R" + a, ((full[to], text), *r)) for c, a, r in after[to]]
        for _ in range(3):
            for s, to in following.items():
                best[s] += [(c + 2, "I" + a, ((full[to], ""), *r)) for c, a, r in best[to]]
                best[s] = [min(best[s], key=lambda x: x[:2])] if best[s] else []
        after = best
    return after[""][0]


def plain_report(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        said = [(r, t) for *_, r, t in own]
        faults = []
        for i, (_, t) in enumerate(said):
            shown = re.findall(r"[^\x20\x09-\x0D]", t)
            faults.append("b" if not shown else "d" if said[i] in said[:i] else "-" if shown[-1] in ".!?" else "t")
        turns = [t for _, t, *_ in own if t is not None]
        cost, audit, fixed = least_repair(said, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in "bdt"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "why", "  ", "", None, "Fine. ", "a\x0b", "One. Two"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(most)):
            text = rng.choice(texts)
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(roles), f"{text}{rng.choice(['', turn, '.'])}" if text and rng.random() < 0.7 else text))
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_audits_are_the_least_of_all_edit_strings():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"text {i}.") for i in range(rng.randrange(5))]
        faults = [rng.choice("--bdt") for _ in rows]
        want = every_repair(rows, faults)
        kinds = bytes(C.kind_of(r, f in "bd", f == "t") for (r, _), f in zip(rows, faults, strict=True))
        (_, _, audit), *_ = C.walks(kinds, C.BEGIN, C.END, True)
        fixed = C.edited([r for r, _ in rows], [t for _, t in rows], audit)
        assert (C.backward(C.END, kinds)[0][C.START], audit, fixed) == want == (*least_repair(rows, faults)[:2], list(least_repair(rows, faults)[2]))


def test_segments_join_to_the_whole():
    """Costs and walks over any cuts are those of the uncut conversation."""
    rng = random.Random(4)
    for _ in range(300):
        kinds = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 30)))
        cuts = sorted(rng.sample(range(len(kinds) + 1), k=min(3, len(kinds))))
        parts = [kinds[a:b] for a, b in itertools.pairwise([0, *cuts, len(kinds)])]
        entries, exits = [C.BEGIN], [C.END]
        for p in parts:
            entries.append(C.product(entries[-1], C.matrix(p)))
        for p in reversed(parts):
            exits.append(C.product_back(C.matrix(p), exits[-1]))
        exits.reverse()
        state, audit = C.START, ""
        for i, p in enumerate(parts):
            ((state, part),) = [(t, a) for s, t, a in C.walks(p, entries[i], exits[i + 1], i + 1 == len(parts)) if s == state]
            audit += part
        (_, _, whole), *_ = C.walks(kinds, C.BEGIN, C.END, True)
        assert audit == whole and exits[0][C.START] == C.backward(C.END, kinds)[0][C.START]


@pytest.mark.parametrize(("rows", "chars"), [(1 << 16, 1 << 24), (3, 1 << 24), (1 << 16, 5)])
def test_reports_equal_a_plain_version(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(C, "SEGMENT_ROWS", rows)
    monkeypatch.setattr(C, "SEGMENT_CHARS", chars)
    given = random_rows(1, 60, 14)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    assert got(C.reports(C.damaged(df), df)) == plain_report(plain_damage(given), {r[0] for r in given})


def test_one_conversation_over_all_tasks(spark):
    """A conversation with most rows, repeats far apart, and its repaired rows in order."""
    rng = random.Random(9)
    given = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "Same.", " "])) for t in range(900)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(given, SCHEMA).repartition(4)
    want = plain_report(given, {7, 8})
    assert got(C.reports(df)) == want
    rows = sorted((r.conv_id, r.seg, r.at, r.role, r.text) for r in C.repaired_rows(df).collect())
    for conv, *_, digest in want:
        assert hashlib.sha256("\n".join(f"{r}:{t}" for c, _, _, r, t in rows if c == conv).encode()).hexdigest() == digest


def test_odd_rows(spark):
    given = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, None, "assistant", "x"), (1, None, "assistant", "x"), (2, 5, "user", "q" * 200000), (2, 9, "assistant", "a."), (3, -4, "system", "S."), (3, 4, "s", "S.")]
    df = spark.createDataFrame(given, SCHEMA)
    assert got(C.reports(C.damaged(df), df)) == plain_report(plain_damage(given), {r[0] for r in given})
    named = df.withColumns({c: F.lit("clash") for c in ("_fate", "_digest", "_tie", "_part", "seg", "open", "cost", "_of", "_copy")})
    assert got(C.reports(C.damaged(named), named)) == got(C.reports(C.damaged(df), df))
    empty = spark.createDataFrame([], SCHEMA)
    assert C.reports(C.damaged(empty), empty).collect() == [] and C.repaired_rows(empty).collect() == []


def test_conversations_that_lose_all_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert got(C.reports(C.damaged(df), df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_other_ids(spark):
    df = spark.createDataFrame([("b", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit) for r in C.reports(df).orderBy("conv_id").collect()] == [("a", "KK"), ("b", "KI")]
