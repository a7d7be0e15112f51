"""Conversation repair against exhaustive search and a shortest-path search, whole query against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textlab.llm import dialogue_repair as R
from textlab.llm.queries import QUERIES, damaged
from textlab.sources.tables import read_table

WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    """Fault of each (role, text): b, d, t or ''."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def shortest(initials, faults):
    """(cost, audit) by a shortest path over (rows read, place), written apart from the operator."""
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, p = heapq.heappop(heap)
        if (i, p) in done:
            continue
        if i == len(initials) and p in (0, 3):
            return cost, audit
        done.add((i, p))
        for r in "ua":
            if (p, r) in nxt:
                heapq.heappush(heap, (cost + 2, audit + "I", i, nxt[p, r]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, p))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                if (p, initials[i]) in nxt:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, nxt[p, initials[i]]))
                for r in "ua":
                    if (p, r) in nxt:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, nxt[p, r]))


def exhaustive(initials, faults):
    """Least of all audits: every choice of edits, with up to two insertions at every gap."""
    found = []
    options = [["D"] if f in ("b", "d") else ["D", "K", "R"] for f in faults]
    for edits in itertools.product(*options):
        for gaps in itertools.product(range(3), repeat=len(initials) + 1):
            for roles in itertools.product(*[["u", "a"] for x in edits if x == "R"], *[["u", "a"]] * sum(gaps)):
                take, out, cost, audit = iter(roles), "", 0, ""
                for k, e in enumerate([*edits, ""]):
                    for _ in range(gaps[k]):
                        out, audit, cost = out + next(take), audit + "I", cost + 2
                    if e:
                        audit += e
                        out += initials[k] if e == "K" else next(take) if e == "R" else ""
                        cost += {"D": 3, "K": 0, "R": 2}[e] + (e != "D" and faults[k] == "t")
                if GRAMMAR.fullmatch(out):
                    found.append((cost, audit))
    return min(found)


def test_shortest_path_is_the_exhaustive_least():
    for n in range(4):
        for initials in itertools.product("sua?", repeat=n):
            faults = [random.Random(f"{initials}").choice(["", "", "t", "d"]) for _ in initials]
            assert shortest(initials, faults) == exhaustive(initials, faults)


def coded(initials, faults):
    return [R.KINDS * ("sua".index(x) if x in "sua" else 3) + {"": 0, "t": 1, "b": 2, "d": 2}[f] for x, f in zip(initials, faults)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_charts(n):
    rng = random.Random(n)
    cases = [("".join(rng.choice("uuaas?") for _ in range(n)), [rng.choice(["", "", "", "t", "b", "d"]) for _ in range(n)]) for _ in range(200)]
    cells = R._unpacked(R.charts(np.array([coded(*c) for c in cases])), n)
    for case, cell in zip(cases, cells):
        cost, audit = R.best(cell)
        assert (cost, audit.decode()) == shortest(*case), case


def test_charts_of_charts():
    rng = random.Random(5)
    for n in (13, 40, 300):
        initials, faults = "".join(rng.choice("uas") for _ in range(n)), [rng.choice(["", "", "t", "d"]) for _ in range(n)]
        tower = R.Tower()
        for a in range(0, n, R.SPAN):
            tower.add(R._unpacked(R.charts(np.array([coded(initials[a:a + R.SPAN], faults[a:a + R.SPAN])])), len(initials[a:a + R.SPAN]))[0])
        cost, audit = R.best(tower.cells())
        assert (cost, audit.decode()) == shortest(initials, faults)


def test_all_must_go():
    assert R.best(R.deleted(5)) == (15, b"DDDDD") and R.best(R.EMPTY) == (0, b"")


def plain(conversation):
    """The expected row of one conversation: list of (turn, role, text), nulls already one space in role and text."""
    def order(r):
        return (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16])
    rows = sorted(conversation, key=order)
    faults = plain_faults([(r, t) for _, r, t in rows])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] or "?" for _, r, _ in rows]
    cost, audit = shortest(initials, faults)
    out, i, place = [], 0, 0
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for e in audit:
        need = "a" if place == 2 else "u"
        name = {"u": "user", "a": "assistant"}[need]
        if e == "I":
            out.append(f"{name}:")
            place = nxt[place, need]
            continue
        _, role, text = rows[i]
        i += 1
        if e == "R":
            out.append(f"{name}:{text}")
            place = nxt[place, need]
        elif e == "K":
            out.append(f"{role}:{text}")
            place = nxt[place, role[0]]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        def known(x): return " " if x is None else str(x)
        fate = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def check(got, rows):
    want = {c: plain(r) for c, r in plain_damage(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def query(spark, rows, tmp_path, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return QUERIES["op12_dialogue_repair"](spark, str(tmp_path)).collect()


def test_query_whole_table(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
        check(QUERIES["op12_dialogue_repair"](spark, sf).collect(), rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "usher"]), rng.choice(["a.", "b", "c!", " ", None, "", "d?\n", "e.\x0b", "x" * 50_000]))
            for c in [None, -7, 0, *range(60)] for t in [None, None, *range(rng.randint(0, 14))]]
    rows += [rows[5]] * 30 + [(900, t, "user", "same.") for t in range(40)] + [(901, 3, "user", "hi.")] * 100 + [(902, None, "user", "x")]
    check(query(spark, rows, tmp_path), rows)


def test_one_conversation_over_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t {t % 700}" + rng.choice([".", ""])) for t in range(3000)]
    rows += [(2, t, "user", "again.") for t in range(5)] + [(0, 1, "user", "q?"), (0, 2, "assistant", "a.")]
    check(query(spark, rows, tmp_path), rows)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    rows = spark.createDataFrame([(1, 1, "user", "a?", 9, "z", 8), (1, 2, "assistant", "b.", 9, "z", 8)],
                                 "conv_id long, turn long, role string, text string, conv long, id string, n long")
    parsed = R.parse(rows)
    assert [tuple(r) for r in parsed.collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]
    assert sorted(tuple(r) for r in R.repaired(rows, parsed).collect()) == [(1, 0, "user", "a?"), (1, 1, "assistant", "b.")]


def test_damage_of_one_row_is_a_function_of_its_place(spark):
    rows = [(k, t, "user", "a.b!") for k in range(30) for t in (None, 1, 2)]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = [(c, t, r, x) for c, rs in plain_damage(rows).items() for t, r, x in rs]
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in got for _ in range(r.copies)), key=str) == sorted(want, key=str)
