"""Conversation repair by Four-Russians block tables.

The cheapest edits that bring a conversation's roles into ``(s?(ua)+)?`` are a
walk through four states (start, after system, after user, after assistant).
The cost-to-go of the four states at one place, less its minimum, is one of a
few dozen vectors, so the transition of every vector over every block of
``BLOCK`` row classes is computed once: a conversation is passed from its end to
its start by one lookup per block, and the vectors inside a block are expanded
again on the way back, when the edits are read off.  Edits are chosen from the
start, the least letter first among the cheapest, which is safe because the
vectors hold the cost of all that follows.

Rows are range-sorted by (conversation, turn) and cut into packs of bounded size,
so a conversation of any length is spread over many packs.  Only the first and
last conversation of a pack can go on in another one: such a part is reduced to
its transition of all vectors and states, and two light passes over the parts,
one from the end and one from the start, give every part the vector behind it and
the state in front of it.  What such parts keep is hashed in order, piece by
piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm.common import column_type, prepare, saved

#: Row classes of a block.
BLOCK = 3
#: Rows (a power of two) and text bytes of a pack, and characters of a piece of kept text.
PACK_ROWS, PACK_BYTES, PIECE = 1 << 12, 1 << 19, 1 << 12
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after the next user or assistant turn, and the role of that turn.
NEXT, ROLE = (2, 2, 3, 2), ("", "", "user", "assistant")
#: (state, initial) -> state of rows that may stay as they are.
LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Classes of rows that may stay: initial x cut off or not.
CLASSES = [(c, cut) for cut in (0, 1) for c in ("s", "u", "a", "")]
LEGAL_PAIRS = ("su", "ua", "au")


def _with_inserts(k: list[float]) -> list[float]:
    """Cost-to-go when turns may be inserted first."""
    u, a = min(k[2], INSERT + k[3]), min(k[3], INSERT + k[2])
    return [min(k[0], INSERT + u), min(k[1], INSERT + u), u, a]


def _options(v: tuple, row: tuple, q: int) -> list[tuple[float, str, int]]:
    """(cost-to-go, letter, next state) of the edits of one row in state q, before vector ``v``."""
    c, cut = row
    out = [(DELETE + v[q], "D", q)]
    if (q, c) in LEGAL:
        out.append((KEEP + TRUNCATED * cut + v[LEGAL[q, c]], "K", LEGAL[q, c]))
    return [*out, (REROLE + TRUNCATED * cut + v[NEXT[q]], "R", NEXT[q])]


class Tables:
    """Transitions of all cost vectors over rows and blocks; a few thousand entries whatever the data."""

    def __init__(self) -> None:
        end = tuple(_with_inserts([0, np.inf, np.inf, 0]))
        self.vectors, at = [end], {end: 0}
        step, add = [], []
        for v in self.vectors:  # grows until closed
            step.append([])
            add.append([])
            for row in CLASSES:
                new = _with_inserts([min(o[0] for o in _options(v, row, q)) for q in range(4)])
                low = min(new)
                key = tuple(x - low for x in new)
                if key not in at:
                    at[key] = len(self.vectors)
                    self.vectors.append(key)
                step[-1].append(at[key])
                add[-1].append(int(low))
        self.step, self.add = np.array(step, np.int32), np.array(add, np.int64)
        #: (vector behind, class, state) -> letters and state after the row.
        self.letters = [[[self._edits(v, row, q) for q in range(4)] for row in CLASSES] for v in self.vectors]
        self.exit = np.array([[[e[1] for e in per] for per in rows] for rows in self.letters], np.int8)
        #: state at the end -> letters of the last inserts.
        self.ending = ["", "II", "I", ""]
        # blocks: the rows of a block from the last to the first
        n, m = len(self.vectors), len(CLASSES)
        self.block, self.block_add = np.empty((n, m ** BLOCK), np.int32), np.empty((n, m ** BLOCK), np.int64)
        for code, rows in enumerate(product(range(m), repeat=BLOCK)):
            v, total = np.arange(n), np.zeros(n, np.int64)
            for r in reversed(rows):
                total, v = total + self.add[v, r], self.step[v, r]
            self.block[:, code], self.block_add[:, code] = v, total

    @staticmethod
    def _edits(v: tuple, row: tuple, q: int) -> tuple[str, int]:
        here = _with_inserts([min(o[0] for o in _options(v, row, p)) for p in range(4)])
        letters = ""
        while True:
            ways = [o for o in _options(v, row, q) if o[0] == here[q]]
            if INSERT + here[NEXT[q]] == here[q]:
                ways.append((here[q], "I", NEXT[q]))
            _, letter, q = min(ways, key=lambda o: o[1])
            letters += letter
            if letter != "I":
                return letters, q

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        """Codes of the full blocks, the last block ending with the last row."""
        head = len(rows) % BLOCK
        return rows[head:].reshape(-1, BLOCK) @ len(CLASSES) ** np.arange(BLOCK)[::-1]

    def behind(self, rows: np.ndarray, v):
        """(vector behind every row, vector before the first, its cost): blocks by lookup, then expanded.

        ``v`` is a vector number or an array of them.
        """
        head, codes = len(rows) % BLOCK, self.blocks(rows)
        out, total = [None] * len(rows), 0
        for b in range(len(codes) - 1, -1, -1):
            w = v
            for r in range(BLOCK - 1, -1, -1):
                i = head + b * BLOCK + r
                out[i] = w
                if r:
                    w = self.step[w, rows[i]]
            total, v = total + self.block_add[v, codes[b]], self.block[v, codes[b]]
        for i in range(head - 1, -1, -1):
            out[i] = v
            total, v = total + self.add[v, rows[i]], self.step[v, rows[i]]
        return out, v, total

    def reduced(self, rows: np.ndarray) -> np.ndarray:
        """Of a part of a conversation, per vector behind it: the vector before it and the state after it for each state before it."""
        every = np.arange(len(self.vectors))
        behind, left, _ = self.behind(rows, every)
        state = np.tile(np.arange(4, dtype=np.int8), (len(every), 1))
        for v, r in zip(behind, rows, strict=True):
            state = self.exit[v[:, None], r, state]
        return np.c_[left, state].astype(np.int32)


@cache
def tables() -> Tables:
    return Tables()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the damaged rows; n copies of each, none of a dropped one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    src = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"),
                               F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20)).alias("kind"))
    return src.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                      F.expr("CASE kind WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
                      F.expr("CASE kind WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END").alias("n"))


def _packs(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in order, equal ones counted, in packs; numbers of packs ascend with the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 28, 0
        held: list[list] = []

        def out() -> pa.RecordBatch:
            nonlocal number, size
            conv, turn, role, text, n = zip(*held, strict=True)
            whole = [t.rstrip(BLANKS) for t in text]
            state = [0 if not t else 1 if t[-1] not in ".!?" else 2 for t in whole]
            key = [hashlib.md5(t.encode()).digest() for t in text]
            data = {"pack": pa.array([number], pa.int64())}
            columns = {"conv": conv, "turn": turn, "role": role, "text": text, "n": n, "state": state, "key": key}
            types = dict(turn=pa.int64(), role=pa.string(), text=pa.string(), n=pa.int64(), state=pa.int8(), key=pa.binary())
            for c, x in columns.items():
                data[c] = pa.array([x], pa.list_(types.get(c, conv_type)))
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_pydict(data)

        conv_type = None
        for b in batches:
            conv_type = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and tuple(held[-1][:4]) == row[:4]:
                    held[-1][4] += row[4]
                    continue
                if held and (size + len(row[3]) > PACK_BYTES or len(held) == PACK_ROWS):
                    yield out()
                held.append(list(row))
                size += len(row[3])
        if held:
            yield out()

    ordered = (rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32)))
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    return saved(ordered.mapInArrow(run, f"pack long, conv array<{kind}>, turn array<long>, role array<string>, text array<string>, "
                                         "n array<long>, state array<tinyint>, key array<binary>"))


def _runs(conv: list) -> list[tuple[int, int]]:
    """Places (from, to) of each conversation of a pack."""
    cut = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(cut, cut[1:], strict=False))


def _symbols(role: list, n: list, state: list, first: set) -> list[int]:
    """Per row, the class of its first copy, or -1 if all copies have to go."""
    return [CLASSES.index((r[:1] if r[:1] in ("s", "u", "a") else "", int(s == 1))) if k and s and i in first else -1
            for i, (r, k, s) in enumerate(zip(role, n, state, strict=True))]


def _border_parts(packs: DataFrame, kind: str) -> DataFrame:
    """(conv_id, pack, way): the reduced first and last conversation of each pack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                pack, conv, role, n, state, first = (c[r].as_py() for c in b.columns)
                spans = _runs(conv)
                symbols = _symbols(role, n, state, set(first or ()))
                for i, j in {spans[0], spans[-1]}:
                    way = tables().reduced(np.array([x for x in symbols[i:j] if x >= 0], np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([conv[i]], b.column(1).type.value_type), pa.array([pack], pa.int64()),
                                                      pa.array([way.ravel().tolist()], pa.list_(pa.int32()))], ["conv_id", "pack", "way"])

    return packs.select("pack", "conv", "role", "n", "state", "first").mapInArrow(run, f"conv_id {kind}, pack long, way array<int>")


def _joints(parts: DataFrame, kind: str) -> DataFrame:
    """(pack, enter, behind): for conversations in several packs, the state before a part that goes on and the vector behind one that is continued."""
    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, v = object(), 0
        for b in batches:
            ids, out, exits = b.column(0).to_pylist(), [], []
            for r, c in enumerate(ids):
                more = c == conv
                conv, v = c, v if more else 0
                way = np.array(b.column(2)[r].as_py()).reshape(-1, 5)[v]
                out.append(v if more else None)
                exits.append(way[1:].tolist())
                v = int(way[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32()), pa.array(exits, pa.list_(pa.int32()))], ["conv_id", "pack", "behind", "exits"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, q = object(), 0
        for b in batches:
            out = []
            for c, exits in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                more = c == conv
                conv, q = c, q if more else 0
                out.append(q if more else None)
                q = exits[q]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.int32()), b.column(2)], ["pack", "enter", "behind"])

    back = (parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pack"))
            .mapInArrow(backward, f"conv_id {kind}, pack long, behind int, exits array<int>"))
    return (back.repartition("conv_id").sortWithinPartitions("conv_id", "pack").mapInArrow(forward, "pack long, enter int, behind int")
            .groupBy("pack").agg(F.max("enter").alias("enter"), F.max("behind").alias("behind")))


_PART = ("conv_id {0}, pack long, piece int, turns long, low long, high long, opens string, closes string, blank long, duplicate long, "
         "truncated long, illegal long, cost long, audit string, kept string, sha string")


def _part(role: list, text: list, turn: list, n: list, state: list, symbols: list[int], enter: int | None, behind: int | None) -> dict:
    """Counts, edits and kept text of a conversation, or of a part of one."""
    there = [i for i in range(len(n)) if n[i]]
    marks = [role[i][:1] for i in there]
    known = sorted({turn[i] for i in there if turn[i] is not None})
    out = {"turns": len(known), "low": known[0] if known else None, "high": known[-1] if known else None,
           "opens": marks[0] if there else None, "closes": marks[-1] if there else None,
           "blank": sum(n[i] for i in there if not state[i]),
           "duplicate": sum(n[i] - (symbols[i] >= 0) for i in there if state[i]),
           "truncated": sum(symbols[i] >= 0 and state[i] == 1 for i in there),
           "illegal": sum(n[i] - 1 for i in there) + sum(a + b not in LEGAL_PAIRS for a, b in zip(marks, marks[1:], strict=False))}
    t = tables()
    rows = np.array([s for s in symbols if s >= 0], np.int64)
    vectors, before, low = t.behind(rows, behind or 0)
    q = enter or 0
    out["cost"] = int(low) + DELETE * sum(n[i] - (symbols[i] >= 0) for i in there)
    if enter is None:  # the state costs what its place in the vector says, but for the vector behind a later part
        out["cost"] += int(t.vectors[before][0])
    audit, kept, at = [], [], 0
    for i in there:
        if symbols[i] >= 0:
            letters, end = t.letters[vectors[at]][symbols[i]][q]
            for letter in letters:
                if letter == "D":
                    continue
                name = role[i] if letter == "K" else ROLE[NEXT[q]]
                q = LEGAL[q, role[i][:1]] if letter == "K" else NEXT[q]
                kept.append(f"{name}:{'' if letter == 'I' else text[i]}")
            audit.append(letters)
            at, q = at + 1, end
        audit.append("D" * (n[i] - (symbols[i] >= 0)))
    if behind is None:
        for letter in t.ending[q]:
            q = NEXT[q]
            kept.append(f"{ROLE[q]}:")
            audit.append(letter)
    return out | {"audit": "".join(audit), "kept": "\n".join(kept)}


def _finish(parts: DataFrame, kind: str, schema: str) -> DataFrame:
    """One row per conversation: parts in order are added up and their text is hashed as it passes."""
    names = schema.replace(" string", "").replace(" long", "").split(", ")[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        conv_type = None
        done: list[dict] = []

        def close() -> None:
            if now is not None:
                gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
                done.append(now | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"] or now["hash"].hexdigest()})

        def out() -> pa.RecordBatch:
            data = {"conv_id": pa.array([d["conv_id"] for d in done], conv_type)}
            for c in names:
                data[c] = pa.array([d[c] for d in done], pa.string() if c in ("audit", "repaired_sha256") else pa.int64())
            done.clear()
            return pa.RecordBatch.from_pydict(data)

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for p in b.to_pylist():
                if now is None or p["conv_id"] != now["conv_id"]:
                    close()
                    now = p | {"audit": [], "hash": hashlib.sha256(), "empty": True, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                               "turns": 0, "low": None, "high": None, "closes": None}
                if p["piece"] == 0:
                    for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                        now[c] += p[c]
                    if p["opens"] is not None:
                        now["illegal"] += now["closes"] is not None and now["closes"] + p["opens"] not in LEGAL_PAIRS
                        now["closes"] = p["closes"]
                    if p["low"] is not None:
                        now["turns"] -= now["high"] == p["low"]
                        now["low"], now["high"] = p["low"] if now["low"] is None else now["low"], p["high"]
                    now["audit"].append(p["audit"])
                    now["sha"] = p["sha"]
                    if p["kept"] and not now["empty"]:
                        now["hash"].update(b"\n")
                if p["kept"]:
                    now["hash"].update(p["kept"].encode())
                    now["empty"] = False
            if len(done) > 1000:
                yield out()
        close()
        if done:
            yield out()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "pack", "piece").mapInArrow(run, schema.format(kind))


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, n copies): counts of faults, the cheapest edits, the hash of what they leave.

    Rows are taken by (turn, role, text), a null turn first.  Columns: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of
    ``role:text`` lines).  Roles go by their first code point; an empty role has
    none and is never legal.  A row's first fault counts.  Equal rows of one turn
    stand beside each other, all but the first are duplicates.  A conversation
    whose rows all have n = 0 has zeros, an empty audit and the hash of nothing.
    A null conv_id is a conversation like others; an empty table gives an empty
    result.  Texts are equal by md5.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = column_type(rows, "conv_id")
    packs = _packs(rows.select("conv_id", "turn", "role", "text", "n"), kind)
    bits = PACK_ROWS.bit_length() - 1
    light = (packs.select("pack", F.posexplode(F.arrays_zip("conv", "role", "key", "n")).alias("i", "x")).where("x.n > 0")
             .select("x.conv", "x.role", "x.key", (F.shiftleft("pack", bits) + F.col("i")).alias("place")))
    first = (light.groupBy("conv", "role", "key").agg(F.min("place").alias("place"))
             .groupBy(F.shiftright("place", bits).alias("pack")).agg(F.collect_list((F.col("place") % PACK_ROWS).cast("int")).alias("first")))
    first = saved(first)
    joints = _joints(_border_parts(packs.drop("text", "key").join(first, "pack", "left"), kind), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv_type = b.column(1).type.value_type
            for r in range(b.num_rows):
                pack, conv, turn, role, text, n, state, first, enter, behind = (c[r].as_py() for c in b.columns)
                spans = _runs(conv)
                symbols = _symbols(role, n, state, set(first or ()))
                out = []
                for i, j in spans:
                    before, after = enter if i == 0 else None, behind if j == len(conv) else None
                    p = _part(role[i:j], text[i:j], turn[i:j], n[i:j], state[i:j], symbols[i:j], before, after) | {"conv_id": conv[i], "pack": pack, "piece": 0}
                    kept = p["kept"]
                    if before is None and after is None:
                        out.append(p | {"kept": None, "sha": hashlib.sha256(kept.encode()).hexdigest()})
                        continue
                    out.append(p | {"kept": kept[:PIECE]})
                    out += [{"conv_id": conv[i], "pack": pack, "piece": k + 1, "kept": kept[at:at + PIECE]} for k, at in enumerate(range(PIECE, len(kept), PIECE))]
                data = {"conv_id": pa.array([p["conv_id"] for p in out], conv_type)}
                for field in _PART.split(", ")[1:]:
                    name, t = field.split()
                    data[name] = pa.array([p.get(name) for p in out], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t])
                yield pa.RecordBatch.from_pydict(data)

    joined = packs.join(first, "pack", "left").join(joints, "pack", "left")
    parts = joined.select("pack", "conv", "turn", "role", "text", "n", "state", "first", "enter", "behind").mapInArrow(run, _PART.format(kind))
    return _finish(parts, kind, "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows of a table (conv_id, turn, role, text); other columns are ignored.

    Null conv_id, turn, role and text count as one space where they are text.
    """
    return repair(damage(conversations))
