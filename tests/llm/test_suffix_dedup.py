"""Byte dedup by suffix order against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from matfold.llm import suffix_dedup as dedup


def brute(docs, window):
    raw = [(t or "").encode() for _, t in docs]
    places = defaultdict(list)
    for r, b in enumerate(raw):
        for i in range(len(b) - window + 1):
            places[b[i:i + window]].append((r, i))
    gone = [bytearray(len(b)) for b in raw]
    for at in places.values():
        if len(at) > 1:
            for r, i in at:
                gone[r][i:i + window] = b"\1" * window
    out = []
    for (doc, _), b, g in zip(docs, raw, gone, strict=True):
        spans = [(i, j) for i in range(len(b)) if g[i] and not (i and g[i - 1]) for j in [next((k for k in range(i, len(b)) if not g[k]), len(b))]]
        out.append((doc, len(b), sum(g), spans, bytes(x for x, y in zip(b, g, strict=True) if not y)))
    return out


def run(spark, docs, window, **args):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS pack", "2 AS id", "3 AS ctx").repartition(3)
    out = dedup.suffix_dedup(df, window, **args)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    return sorted(((r[0], r[1], r[2], [tuple(s) for s in r[3]], bytes(r[4])) for r in out.collect()), key=str)


def texts(rnd, n):
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(20, 200))) for _ in range(12)]
    docs = []
    for k in range(n):
        parts = [rnd.choice(base) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh \0") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 5))]
        docs.append((k if k % 17 else None, None if k % 19 == 5 else "".join(p[rnd.randint(0, 9):] for p in parts)))
    return docs + [(9000, "ab" * 200), (9001, "a" * 300), (9002, "x" + "ab" * 30), (9003, docs[3][1]), (9003, docs[3][1]), (9004, "short"), (9005, "")]


@pytest.mark.parametrize("group,window", [(1 << 20, 24), (300, 24), (300, 17)])
def test_against_brute_force(spark, monkeypatch, group, window):
    monkeypatch.setattr(dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(dedup, "SHARD_BYTES", 4096)
    monkeypatch.setattr(dedup, "PACK_BYTES", 2000)
    docs = texts(random.Random(window), 60)
    assert run(spark, docs, window) == sorted(brute(docs, window), key=str)


def test_border_of_a_passage_of_many_documents_is_split(spark, monkeypatch):
    monkeypatch.setattr(dedup, "GROUP_BYTES", 2000)
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    passage, edges = noise(150), [noise(6) for _ in range(4)]
    docs = [(k, noise(50) + rnd.choice(edges) + passage + rnd.choice(edges) + noise(50)) for k in range(80)]
    assert run(spark, docs, 60) == sorted(brute(docs, 60), key=str)


def test_first_copies_can_stay(spark, monkeypatch):
    for group in (1 << 20, 300):
        monkeypatch.setattr(dedup, "GROUP_BYTES", group)
        docs = texts(random.Random(8), 50)
        got = run(spark, docs, 24, keep_first=True)
        # every window of the input is left somewhere: windows of what is removed are in what is kept or in a kept border
        removed, every = sum(r[2] for r in got), sum(r[2] for r in brute(docs, 24))
        assert 0 < removed < every
        raw = {}
        for doc, text in docs:
            raw.setdefault((doc, len((text or "").encode())), []).append((text or "").encode())
        # of two equal long rows one keeps its bytes
        same = [r for r in got if r[0] == 9003]
        assert len(same) == 2 and same[0][1] == same[1][1] and (same[0][1] < 24 or max(s[2] for s in same) == same[0][1])
        # a unit that repeats leaves its first period
        periodic = next(r for r in got if r[0] == 9001)
        assert periodic[3] in ([(1, 300)], [(0, 300)])


def test_long_texts_and_windows(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(1_300_000))
    docs = [(1, long), (2, long[1_048_000:1_049_200]), (3, "zz" + long[5:404] + "y"), (4, "qq" + long[600_000:600_400] + "y"), (5, "a" * 399), (6, "a" * 400)]
    got = {r[0]: r for r in run(spark, docs, 400)}
    assert got[1][2] == 1600 and got[1][3] == [(600_000, 600_400), (1_048_000, 1_049_200)]
    assert got[2][2] == 1200 and got[3][2] == 0 and got[4][3] == [(2, 402)] and got[5][2] == got[6][2] == 0


def test_empty_tables(spark):
    assert run(spark, [], 400) == []
    assert run(spark, [(1, None), (None, "")], 400) == [(1, 0, 0, [], b""), (None, 0, 0, [], b"")]


def test_longest_factors():
    rnd = random.Random(1)
    for _ in range(50):
        raw = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(20, 120)))
        window = rnd.randint(4, 12)
        starts = np.arange(len(raw) - window + 1)
        place = np.array(rnd.sample(range(1000), len(starts)))
        previous, following = dedup.longest_factors(np.frombuffer(raw, np.uint8), starts, place, window)
        for i in starts:
            same = [j for j in starts if raw[j:j + window] == raw[i:i + window]]
            assert (previous[i] == window) == any(place[j] < place[i] for j in same)
            assert (following[i] == window) == any(place[j] > place[i] for j in same)


def test_packs_move_without_keys_and_are_written_in_small_pages(spark, monkeypatch):
    """What a task holds of packs: their texts and runs, not the md5 of every context, and no page of a hundred packs."""
    kept, moved = [], []
    frame, saved = type(spark.range(0)), dedup.saved
    plain = frame.mapInArrow

    def watched(self, func, schema, *args, **kwargs):
        moved.append(self.columns)
        return plain(self, func, schema, *args, **kwargs)

    def noted(df, **options):
        kept.append(saved(df, **options))
        return kept[-1]

    monkeypatch.setattr(frame, "mapInArrow", watched)
    monkeypatch.setattr(dedup, "saved", noted)
    monkeypatch.setattr(dedup, "PACK_BYTES", 1)
    rnd = random.Random(5)
    body = "".join(map(chr, rnd.choices(range(0x4E00, 0x9000), k=80_000)))
    docs = [(k, body[k * 100:] + body[:k * 100] + str(k)) for k in range(110)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = dedup.suffix_dedup(df, 400).collect()
    assert len(out) == 110 and all(r["n_removed"] == 240_000 for r in out)
    assert sum("blob" in c for c in moved) == 2 and not any({"blob", "keys"} <= set(c) for c in moved)
    footers = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept[0].inputFiles()]
    sizes = [m.row_group(g).total_byte_size for m in footers for g in range(m.num_row_groups)]
    assert sum(sizes) > 10 << 20 and max(sizes) <= 9 << 20
