"""Conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from matfold.llm import conversation_repair as repair

LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, kept) by Dijkstra over (row, role initials so far as a state), the least audit first."""
    # states by the automaton of the pattern: start, s, u, a
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, kept = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (cost, audit, i, state) in done:
            continue
        done.add((cost, audit, i, state))
        for full, c in (("user", "u"), ("assistant", "a")):
            if (state, c) in legal:
                heapq.heappush(queue, (cost + 5, audit + "I", i, legal[state, c], (*kept, f"{full}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, kept))
            if bad[i] not in ("blank", "duplicate"):
                more = 5 * (bad[i] == "truncated")
                if (state, role[:1]) in legal:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, legal[state, role[:1]], (*kept, f"{role}:{text}")))
                for full, c in (("user", "u"), ("assistant", "a")):
                    if (state, c) in legal:
                        heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, legal[state, c], (*kept, f"{full}:{text}")))


def brute(conv, rows):
    bad = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, kept = cheapest(rows, bad)
    kept = [k for k in kept]
    assert LEGAL.fullmatch("".join(k[:1] for k in kept))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(bad.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pack", "2 AS n", "3 AS `place`")
    out = repair.repair_damaged(df.repartition(3))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r) for r in out.collect()}


def rows_of(rnd, convs, most):
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "dot. then", "Größe.", "x\x0b.", "　"]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", None, "", "User", "ua"]
    return [(conv, rnd.choice([t, t, t, t, None, t // 2]), rnd.choice(roles), rnd.choice([*texts, f"text {rnd.random()}.", f"text {rnd.random()}."]))
            for conv in convs for t in range(rnd.randint(1, most))]


def test_against_brute_force(spark):
    rnd = random.Random(11)
    rows = rows_of(rnd, [*range(400), None], 8)
    rows += rnd.sample(rows, 40)  # repeated rows
    got = run(spark, rows)
    want = {conv: brute(conv, r) for conv, r in damaged(rows).items()}
    for conv, turn, _, _ in rows:
        want.setdefault(conv, None)
    for conv, w in want.items():
        assert got[conv] == (w or (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), [r for r in rows if r[0] == conv]
    assert len(got) == len(want)
    assert {None, *range(400)} == set(got) and any(g[7] == "" for g in got.values()) and all(any(x in g[7] for g in got.values()) for x in "DKR")


def test_conversations_over_many_packs(spark, monkeypatch):
    monkeypatch.setattr(repair, "PACK_ROWS", 4)
    monkeypatch.setattr(repair, "PIECE", 16)
    rnd = random.Random(3)
    rows = rows_of(rnd, range(25), 24)
    assert run(spark, rows) == {conv: brute(conv, r) if r else got for conv, r, got in
                                ((c, damaged(rows).get(c), (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in range(25))}


def test_one_large_conversation(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(30000)] + [(7, 5, "user", "Again.")] * 5000 + [(8, None, "user", "x" * 2_000_000)]
    got = run(spark, rows)
    r = damaged(rows)[7]
    assert got[7][2:5] == tuple(faults(r).count(k) for k in ("blank", "duplicate", "truncated"))
    # plain dynamic programming over all rows for the cost
    bad, legal = faults(r), repair.LEGAL
    cost = [0, 1e9, 1e9, 0]

    def inserted(c):
        return [min(c[0], 1e9), c[1], min(c[2], 5 + min(c[0], c[1], c[3])), min(c[3], 5 + min(c[2], 5 + min(c[0], c[1])))]

    cost = inserted([0, 1e9, 1e9, 1e9])
    for (_, role, _), b in zip(r, bad, strict=True):
        new = [2 + c for c in cost]
        if b in ("", "truncated"):
            for q in range(4):
                if (q, role[:1]) in legal:
                    new[legal[q, role[:1]]] = min(new[legal[q, role[:1]]], cost[q] + 5 * bool(b))
                new[repair.NEXT[q]] = min(new[repair.NEXT[q]], cost[q] + 1 + 5 * bool(b))
        cost = inserted(new)
    assert got[7][6] == min(cost[0], cost[3]) and got[7][7].count("D") > 5000
    assert got[8][4] == 1 and len(got) == 2


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_tables_are_closed():
    t = repair.tables()
    assert len(t.vectors) < 100 and t.block.max() < len(t.vectors)
    with pytest.raises(KeyError):
        repair.LEGAL[1, "s"]
