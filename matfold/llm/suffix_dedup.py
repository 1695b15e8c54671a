"""Exact byte dedup by suffix order and longest previous factors.

Every string of ``window`` bytes (a window) that starts at two places is found
through the suffix order of the texts around it; the nearest suffixes before and
behind in that order which lie earlier in the corpus (previous and next smaller
positions) bound the longest previous factor of a place, the same towards later
places the longest next factor.

The order of all suffixes is never built in one piece:

1. Texts are written in packs.  The smallest hash of the ``gram``-byte strings in
   a window is its anchor; neighbouring windows with one anchor make a context.
   Equal windows have equal anchors, so they lie in contexts of one anchor.
2. Contexts are told apart by md5 and counted: all windows of one that occurs
   twice occur twice.  Only anchors with several different contexts go on, each
   context once, with its bytes.
3. The contexts of an anchor are ordered together, many anchors in one task:
   suffixes by prefix doubling, then previous and next smaller places.
4. An anchor of more than ``GROUP_BYTES`` of different contexts (the border of a
   passage that very many documents share) is split exactly: its windows by
   halves of their distance from the anchor, each half grouped by the bytes that
   all its windows have in common, equal parts counted once.  Halving ends at
   single windows, where a group holds one string.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matfold.llm import words as W
from matfold.llm.common import LONG_ROWS, lists, prepare, saved
from matfold.llm.packs import PACK_BYTES

#: Window starts that are hashed at once (positions take the lower bits of a hash).
CHUNK, LOW = 1 << 20, np.uint64((1 << 21) - 1)
#: Bytes of contexts ordered by one task, and of one anchor before it is split.
SHARD_BYTES, GROUP_BYTES = 1 << 20, 1 << 20
#: Shards that one task orders, one after the other.
TASK_SHARDS = 4

_VALUE = W.mix64(np.arange(1, 257, dtype=np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (w - size)], x[w - size:]) if size < w else x


def contexts(buf: np.ndarray, at: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The contexts of the rows ``at[i]:at[i + 1]``: first window, number of windows, anchor place, anchor hash, hash of all bytes."""
    n, w = len(buf), window - gram + 1
    room = np.repeat(at[1:], np.diff(at)) - np.arange(n) >= window
    out: dict[str, list] = {k: [] for k in ("start", "size", "place", "anchor", "hash")}
    for c in range(0, max(0, n - window + 1), CHUNK):
        part = buf[c:c + CHUNK + window - 1]
        starts = np.flatnonzero(room[c:c + len(part) - window + 1])
        if not len(starts):
            continue
        up, down = W._POWERS.get(len(part) + 1)
        pre = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[:-1], out=pre[1:])
        h = W.mix64((pre[gram:] - pre[:-gram]) * down[:len(part) - gram + 1])
        place = (_sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), w) & LOW).astype(np.int64)[starts]
        lead = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        lead = lead[np.r_[True, np.diff(lead) > 0]]
        size = np.diff(np.r_[lead, len(starts)])
        first = starts[lead]
        end = first + size + window - 1
        out["start"].append(first + c)
        out["size"].append(size)
        out["place"].append(place[lead] + c)
        out["anchor"].append(h[place[lead]])
        out["hash"].append(W.mix64((pre[end] - pre[first]) * down[first] + size.astype(np.uint64)))
    kinds = {"anchor": np.uint64, "hash": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in out.items()}


def _packs(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """Texts in packs with their contexts: ``which`` context (of ``keys``, each once) each run of windows is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for i, j, buf, at in W.slices(b.column(1), PACK_BYTES):
                found = contexts(buf, at, window, gram)
                _, first, which, n = np.unique(found["hash"], return_index=True, return_inverse=True, return_counts=True)
                raw = buf.tobytes()
                cut = [(found["start"][k], found["start"][k] + found["size"][k] + window - 1) for k in first]
                keys = pa.StructArray.from_arrays(
                    [pa.array(W.signed(found["anchor"][first]), pa.int64()), pa.array([hashlib.md5(raw[x:y]).digest() for x, y in cut], pa.binary()), pa.array(n, pa.int64())],
                    ["anchor", "ctx", "n"])
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), ids, lists(np.diff(at), np.array([j - i])), pa.array([squeeze.compress(raw)], pa.binary()),
                     pa.array([squeeze.compress(np.c_[found["start"], found["size"], found["place"], which].astype(np.int32).tobytes())], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), keys)], ["pack", "ids", "sizes", "blob", "runs", "keys"])
                number += 1

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return saved(src.mapInArrow(run, "pack long, ids array<long>, sizes array<long>, blob binary, runs binary, keys array<struct<anchor:long,ctx:binary,n:long>>"),
                 **LONG_ROWS)


def _opened(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _runs(blob: bytes) -> np.ndarray:
    return np.frombuffer(_opened(blob), np.int32).reshape(-1, 4).astype(np.int64)


_PIECE = "key long, pack long, ctx int, at long, many boolean, skip int, lead int, bytes binary"


def _pieces(packs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Contexts with their bytes, each from the first pack that has it: anchor, number there, place, other copies, anchor's distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                pack, blob, runs, send = (c[r] for c in b.columns)
                raw, runs = _opened(blob.as_py()), _runs(runs.as_py())
                _, first = np.unique(runs[:, 3], return_index=True)
                anchor, ctx, many = send.values.flatten()
                start, size, place, _ = runs[first[ctx.to_numpy()]].T
                cut = [raw[x:y] for x, y in zip(start.tolist(), (start + size + window - 1).tolist(), strict=True)]
                yield _piece_batch({"key": anchor, "pack": np.full(len(ctx), pack.as_py()), "ctx": ctx, "at": start, "many": many,
                                    "skip": np.zeros(len(ctx), np.int32), "lead": (place - start).astype(np.int32), "bytes": cut})

    return packs.join(wanted, "pack").select("pack", "blob", "runs", "send").mapInArrow(run, _PIECE)


def _piece_batch(out: dict[str, list | np.ndarray | pa.Array]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(out[f.split()[0]], kinds[f.split()[1]]) for f in _PIECE.split(", ")], list(out))


def _halves(pieces: DataFrame, window: int) -> DataFrame:
    """Each piece's windows by halves of the range of distances that its group has; the key is the bytes that all windows of a half share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in _PIECE.split(", ")} | {"sub": [], "near": [], "far": []}
            for p in b.to_pylist():
                near, far = p["near"], p["far"]  # distances near..far-1 of window starts before the anchor
                for a, z in ((near, (near + far) // 2), ((near + far) // 2, far)):
                    w0, w1 = max(0, p["lead"] - z + 1), min(len(p["bytes"]) - window, p["lead"] - a)
                    if a == z or w0 > w1:
                        continue
                    part = p["bytes"][w0:w1 + window]
                    lead = p["lead"] - w0
                    core = part[lead - a:lead - z + 1 + window]
                    out["key"].append(int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=f"{a}:{z}".encode()).digest(), "big", signed=True))
                    out["sub"].append(hashlib.blake2b(part, digest_size=16, salt=f"{lead}".encode()).digest())
                    for c, x in (("pack", p["pack"]), ("ctx", p["ctx"]), ("at", p["at"]), ("many", p["many"]), ("skip", p["skip"] + w0), ("lead", lead), ("bytes", part), ("near", a), ("far", z)):
                        out[c].append(x)
            sub, near, far = out.pop("sub"), out.pop("near"), out.pop("far")
            yield pa.RecordBatch.from_arrays([*_piece_batch(out).columns, pa.array(sub, pa.binary()), pa.array(near, pa.int32()), pa.array(far, pa.int32())],
                                             [*out, "sub", "near", "far"])

    return pieces.mapInArrow(run, _PIECE + ", sub binary, near int, far int")


def suffix_order(buf: np.ndarray, window: int) -> np.ndarray:
    """Rank of every place by its next ``window`` bytes, found by doubling from 8; bytes behind the end are 0."""
    n = len(buf)
    padded = np.r_[buf, np.zeros(8, np.uint8)]
    key = np.zeros(n, np.uint64)
    for k in range(min(8, window)):
        key = (key << np.uint64(8)) | padded[k:k + n].astype(np.uint64)
    size = min(8, window)
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if size == window:
            return rank
        step = min(size, window - size)
        behind = np.zeros(n, np.int64)
        behind[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        size += step


def _smaller_before(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common length of each entry with the nearest entry before it that has a smaller place (0: none).

    ``common[i]`` is the common length of entries i - 1 and i; found by binary
    lifting over running minima.
    """
    n = len(place)
    if not n:
        return np.zeros(0, np.int64)
    low, length = [np.r_[-1, place]], [np.r_[0, common]]  # one entry in front that is smaller than all
    while 1 << len(low) <= n:
        half = 1 << (len(low) - 1)
        # runs that would begin before the front hold the front entry's place
        low.append(np.r_[np.full(min(half, n + 1), -1), np.minimum(low[-1][half:], low[-1][:-half])])
        length.append(np.r_[np.zeros(min(half, n + 1), np.int64), np.minimum(length[-1][half:], length[-1][:-half])])
    at, best = np.arange(n), common.astype(np.int64)
    for k in range(len(low) - 1, -1, -1):
        skip = low[k][at] > place
        best = np.where(skip, np.minimum(best, length[k][at]), best)
        at = np.where(skip, at - (1 << k), at)
    return np.where(at > 0, best, 0)


def longest_factors(buf: np.ndarray, starts: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factor of the suffixes at ``starts``, as far as they reach the window (else 0).

    ``place`` orders the suffixes in the corpus; each of them has ``window`` bytes
    at least, and lengths are told up to the window.
    """
    rank = suffix_order(buf, window)[starts]
    order = np.lexsort((place, rank))
    same = np.r_[False, rank[order][1:] == rank[order][:-1]]
    # suffixes whose neighbours in the order share less than a window have no factor that long
    some = same | np.r_[same[1:], False]
    order, common = order[some], np.where(same[some], window, 0)
    previous, following = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    top = int(place.max(initial=0)) + 1

    def nearest(p: np.ndarray) -> np.ndarray:
        back = _smaller_before(p[::-1], np.r_[0, common[:0:-1]] if len(common) else common)[::-1]
        return np.maximum(_smaller_before(p, common), back)

    previous[order] = nearest(place[order])
    following[order] = nearest(top - place[order])
    return previous, following


def _factors(t: pa.Table, window: int, keep_first: bool) -> pa.Table:
    """(pack, ctx, from, to): runs of windows of the pieces of one task that occur elsewhere (earlier, if first copies stay)."""
    raw = [x.as_py() for x in t["bytes"]]
    size = np.array([len(x) for x in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    n = size - window + 1
    row = np.repeat(np.arange(len(raw)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((t["at"].to_numpy(), t["pack"].to_numpy()))
    turn = np.empty(len(raw), np.int64)
    turn[order] = np.arange(len(raw))
    top = int(n.max(initial=0)) + 1
    previous, following = longest_factors(buf, (np.cumsum(size) - size)[row] + within, turn[row] * top + within, window)
    many = t["many"].to_numpy(zero_copy_only=False)
    hit = previous >= window if keep_first else (previous >= window) | (following >= window) | many[row]
    if not keep_first:
        hit &= ~many[row]  # told already, for all copies
    place = np.flatnonzero(hit)
    cut = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(row[place]) != 0)]) if len(place) else place
    last = place[np.r_[cut[1:], len(place)][:len(cut)] - 1] if len(place) else place
    who, skip = row[place[cut]], t["skip"].to_numpy()
    return pa.table({"pack": t["pack"].take(pa.array(who)), "ctx": t["ctx"].take(pa.array(who)),
                     "from": pa.array((within[place[cut]] + skip[who]).astype(np.int32)), "to": pa.array((within[last] + 1 + skip[who]).astype(np.int32))})


_RUN = "pack long, ctx int, `from` int, `to` int"


def _ordered(pieces: DataFrame, window: int, keep_first: bool) -> DataFrame:
    shards = max(1, math.ceil((pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0) / SHARD_BYTES))
    return (pieces.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "pack", "ctx", "at", "many", "skip", "bytes")
            .repartition(math.ceil(shards / TASK_SHARDS), "shard").groupBy("shard").applyInArrow(lambda t: _factors(t, window, keep_first), _RUN))


def _duplicate_runs(pieces: DataFrame, window: int, gram: int, keep_first: bool) -> DataFrame:
    """Runs of duplicate windows of all pieces (one row per key and sub; keys with several subs)."""
    pieces = pieces.withColumns({"near": F.lit(0), "far": F.lit(window - gram + 1)})
    done = []
    while True:
        heavy = pieces.groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > GROUP_BYTES).select("key")
        heavy = saved(heavy)
        if heavy.isEmpty():
            return _union([*done, _ordered(pieces, window, keep_first)])
        done.append(_ordered(pieces.join(heavy, "key", "left_anti"), window, keep_first))
        halves = saved(_halves(pieces.join(heavy, "key", "left_semi"), window))
        subs = halves.groupBy("key", "sub").agg(F.count("*").alias("n"), F.min(F.struct("pack", "at")).alias("least"))
        keys = subs.groupBy("key").agg(F.count("*").alias("kinds"))
        known = saved(halves.join(subs, ["key", "sub"]).join(keys, "key"))
        first = F.col("least") == F.struct("pack", "at")
        # copies: all windows of a part that is there twice (of later ones, if first copies stay)
        copies = known.where(~first if keep_first else (F.col("n") > 1) & ~F.col("many"))
        done.append(copies.select("pack", "ctx", F.col("skip").alias("from"), (F.col("skip") + F.length("bytes") - window + 1).alias("to")))
        pieces = saved(known.where(first & (F.col("kinds") > 1)).withColumn("many", F.col("many") | (F.col("n") > 1)).drop("n", "least", "kinds"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suffix_dedup(docs: DataFrame, window: int = 400, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_bytes, n_removed, spans, kept).

    ``spans`` (start, end) are the runs of bytes under a window that also starts
    elsewhere in the table, in the same text included; with ``keep_first`` only
    windows that also start earlier (in the order of the packs and the rows in
    them) count, so that one copy of everything stays.  ``kept`` are the other
    bytes.  Windows are judged on the input and never cross rows.  Null and
    empty texts have no bytes, texts under the window are kept, a repeated row is
    a copy like others, ids may be null, other columns are ignored, an empty
    table gives an empty result.  Contexts are equal by md5, windows by bytes.
    """
    if window < 16:
        raise ValueError("a window has 16 bytes at least")
    prepare(docs.sparkSession)
    gram = window // 4
    packs = _packs(docs, id_col, text_col, window, gram)
    # from here on a context is its number in a pack; packs move without their keys
    held = packs.select("pack", F.posexplode("keys").alias("k", "key")).select("pack", "k", "key.*")
    # one exchange, by anchor, for the copies of a context and for the contexts of an anchor
    seen = held.repartition("anchor").groupBy("anchor", "ctx").agg(F.sum("n").alias("n"), F.min("pack").alias("owner"), F.min_by("k", "pack").alias("k"))
    known = saved(seen.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1 OR kinds > 1"))
    wanted = (known.where("kinds > 1").groupBy(F.col("owner").alias("pack"))
              .agg(F.collect_list(F.struct("anchor", F.col("k").alias("ctx"), (F.col("n") > 1).alias("many"))).alias("send")))
    pieces = saved(_pieces(packs, wanted, window))
    runs = _duplicate_runs(pieces, window, gram, keep_first)
    # contexts that occur twice are runs of all their windows
    whole = (held.join(known.where("n > 1").select("anchor", "ctx", "owner"), ["anchor", "ctx"])
             .select("pack", F.col("k").alias("ctx"), F.lit(0).alias("from"), F.lit(-1).alias("to"), (F.col("pack") == F.col("owner")).alias("own")))
    runs = runs.withColumn("own", F.lit(True)).unionByName(whole)
    runs = runs.groupBy("pack").agg(F.collect_list(F.struct("ctx", "from", "to", "own")).alias("found"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, sizes, blob, held, found = (c[r] for c in b.columns)
                yield _covered(ids.values, sizes.values, _opened(blob.as_py()), _runs(held.as_py()), found, window, keep_first)

    out = (packs.join(runs, "pack", "left").select("ids", "sizes", "blob", "runs", "found")
           .mapInArrow(cover, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"))
    return out.withColumnRenamed("id", id_col)


def _covered(ids: pa.Array, sizes: pa.Array, raw: bytes, runs: np.ndarray, found: pa.ListScalar, window: int, keep_first: bool) -> pa.RecordBatch:
    """A pack's rows; ``found``: contexts of it with runs of their windows (``to`` -1: all, in every place; ``own``: this pack has the first)."""
    at = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))].astype(np.int64)
    buf = np.frombuffer(raw, np.uint8)
    ctx, begin, stop, own = (c.to_numpy(zero_copy_only=False) for c in found.values.flatten()) if found.is_valid else (np.zeros(0, t) for t in (int, int, int, bool))
    first = np.zeros(len(runs), bool)
    first[np.unique(runs[:, 3], return_index=True)[1]] = True
    copied, stays = np.zeros((2, first.sum()), bool)
    copied[ctx[stop < 0]] = True
    stays[ctx[(stop < 0) & own]] = keep_first
    whole = copied[runs[:, 3]] & ~(stays[runs[:, 3]] & first)
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, runs[whole, 0], 1)
    np.add.at(edge, runs[whole, 0] + runs[whole, 1] + window - 1, -1)
    start = np.zeros(first.sum(), np.int64)
    start[runs[first, 3]] = runs[first, 0]
    part = stop >= 0
    np.add.at(edge, start[ctx[part]] + begin[part], 1)
    np.add.at(edge, start[ctx[part]] + stop[part] + window - 1, -1)
    gone = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    # maximal runs of removed bytes; rows end runs
    turn = np.unique(np.r_[np.flatnonzero(gone[1:] != gone[:-1]), at])
    turn = turn[turn < len(buf)]
    span = turn[gone[1:][turn]] if len(turn) else turn
    end = np.r_[turn, len(buf)][np.searchsorted(turn, span, "right")]
    row = np.searchsorted(at, span, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(span - at[row], pa.int64()), pa.array(end - at[row], pa.int64())], ["start", "end"])
    per = np.bincount(row, minlength=len(ids))
    keep = ~gone[1:-1]
    total = np.r_[0, np.cumsum(keep)]
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(total[at].astype(np.int32).tobytes()), pa.py_buffer(buf[keep].tobytes())])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(at), pa.int64()), pa.array(np.diff(at) - np.diff(total[at]), pa.int64()),
         pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), spans), kept], ["id", "n_bytes", "n_removed", "spans", "kept"])
