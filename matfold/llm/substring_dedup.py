"""Substring dedup by exact lookup of every window of words in all documents.

A word goes if it is in a window of ``window`` words that a document with a
smaller id holds too.  This takes the place of a greedy relative Lempel-Ziv
parse: a greedy factor follows one reference and can cut a duplicate span at its
border, so that all windows there have to be looked up anyway.  Runs of
windows found in one source are given as ``factors``; they are labels made
from the result and do not lead to it.

The index is built in blocks (packs) and sharded by hash:

1. anchors: of the ``shingle``-word shingles in a window the one of smallest
   hash.  Equal windows have equal anchors.  Each pack sends its distinct
   anchors to their shards; a shard answers each pack with those that another
   document has too.
2. index: windows with such an anchor go, again once per pack, to their shards
   with the smallest id that has them in the pack; a shard answers each pack
   with the windows that a smaller id of another pack has, and that id.
3. cover: each pack looks up the windows of its documents in the answers and its own rows.

A frequent passage reaches a shard once per pack, not once per document.
Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import prepare
from matfold.llm.packs import binary, pack_rows, split_by_shard, unpack

#: Words of the input per shard of the index.
SHARD_WORDS = 2_000_000


def _anchors(h: np.ndarray, room: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that fit into their document, and each one's anchor."""
    starts = np.flatnonzero(room)
    g = W.grams(h, shingle)
    at = W.sliding_min(g, window - shingle + 1)
    return starts, g[at[starts]]


def _send(number: int, keys: np.ndarray, shards: int, **columns: np.ndarray) -> pa.Table:
    """Rows (shard, pack, keys, more binary columns) of sorted keys."""
    runs = list(split_by_shard(keys, shards))
    data = {"shard": pa.array([s for s, _ in runs], pa.int64()), "pack": pa.array([number] * len(runs), pa.int64()),
            "keys": binary([keys[p] for _, p in runs])}
    return pa.table(data | {c: binary([v[p] for _, p in runs]) for c, v in columns.items()})


def _received(t: pa.Table, col: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), kind) for x in t[col]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _reply(packs: np.ndarray, keys: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row (pack, keys, more binary columns) per pack."""
    order = np.lexsort((keys, packs))
    packs, keys = packs[order], keys[order]
    cut = np.flatnonzero(np.r_[True, packs[1:] != packs[:-1]]) if len(packs) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(packs)][:len(cut)]
    data = {"pack": pa.array(packs[cut], pa.int64()), "keys": binary([keys[a:b] for a, b in zip(cut, end, strict=True)])}
    columns = {c: v[order] for c, v in columns.items()}
    return pa.table(data | {c: binary([v[a:b] for a, b in zip(cut, end, strict=True)]) for c, v in columns.items()})


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _ids(ids: pa.Array) -> np.ndarray:
    """Ids as longs; a null id counts as larger than all and is handled apart."""
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def substring_dedup(docs: DataFrame, window: int = 13, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_words, n_removed, kept, factors).

    ``kept`` are the words left, joined by one space; ``factors`` the duplicate
    spans as (start, end, source): words start..end-1, whose first window is
    also in document ``source``.  Ids are compared as longs.  Null and empty
    texts have no words; texts shorter than the window keep all; rows that
    repeat an id are not earlier than each other; rows with a null id keep
    their words and are no source; other columns are ignored; an empty table
    gives an empty result.
    """
    if not 0 < shingle <= window:
        raise ValueError("a shingle must fit into a window")
    spark = docs.sparkSession
    prepare(spark)
    packs = pack_rows(docs, id_col, text_col, W.BLANK_WORDS)
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))

    def hashed(p):
        w = W.words(p.buf, p.at, W.BLANK_WORDS)
        return w, w.hashes(), w.room(window)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in unpack(b):
                w, h, room = hashed(p)
                starts, anchor = _anchors(h, room, window, shingle)
                doc = w.owner[starts]
                order = np.argsort(anchor, kind="stable")  # rows of one anchor stay in order
                first = _runs(anchor[order])
                last = np.r_[first[1:], len(anchor)] - 1
                many = doc[order][first] < doc[order][last] if len(first) else np.zeros(0, bool)
                yield from _send(p.number, anchor[order][first], shards, many=many).to_batches()

    def shared(t: pa.Table) -> pa.Table:
        keys = _received(t, "keys", np.uint64)
        many = _received(t, "many", bool)
        number = np.repeat(t["pack"].to_numpy(), [len(x.as_py()) // 8 for x in t["keys"]])
        order = np.argsort(keys, kind="stable")
        first = _runs(keys[order])
        size = np.diff(np.r_[first, len(keys)])
        wanted = np.repeat((size > 1) | np.logical_or.reduceat(many[order], first) if len(first) else size > 1, size)
        take = order[wanted]
        return _reply(number[take], keys[take])

    def index(left: pa.Table, right: pa.Table) -> pa.Table:
        answer = np.sort(_received(right, "keys", np.uint64))
        out = []
        for p in unpack(left):
            w, h, room = hashed(p)
            starts, anchor = _anchors(h, room, window, shingle)
            doc = _ids(p.ids)[w.owner[starts]] if len(p.ids) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(answer, anchor), max(0, len(answer) - 1))
            hit = answer[at] == anchor if len(answer) else np.zeros(len(anchor), bool)
            hit &= doc != np.iinfo(np.int64).max
            keys, doc = W.grams(h, window)[starts[hit]], doc[hit]
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            first = _runs(keys)
            out.append(_send(p.number, keys[first], shards, owners=doc[first]))
        return pa.concat_tables(out) if out else _send(0, np.zeros(0, np.uint64), shards, owners=np.zeros(0, np.int64))

    def earliest(t: pa.Table) -> pa.Table:
        keys, owners = _received(t, "keys", np.uint64), _received(t, "owners", np.int64)
        number = np.repeat(t["pack"].to_numpy(), [len(x.as_py()) // 8 for x in t["keys"]])
        order = np.lexsort((owners, keys))
        first = _runs(keys[order])
        least = np.repeat(owners[order][first], np.diff(np.r_[first, len(keys)]))
        take = least < owners[order]
        return _reply(number[order][take], keys[order][take], owners=least[take])

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        given, owners = _received(right, "keys", np.uint64), _received(right, "owners", np.int64)
        order = np.argsort(given, kind="stable")
        given, owners = given[order], owners[order]
        out = [_parsed(p, *hashed(p), given, owners) for p in unpack(left)]
        return pa.concat_tables(out)

    def _parsed(p, w: W.Words, h: np.ndarray, room: np.ndarray, given: np.ndarray, owners: np.ndarray) -> pa.Table:
        never = np.iinfo(np.int64).max
        ids = _ids(p.ids)
        starts = np.flatnonzero(room)
        keys = W.grams(h, window)[starts]
        doc = ids[w.owner[starts]] if len(ids) else np.zeros(0, np.int64)
        # the pack's own rows, then the answers
        order = np.lexsort((doc, keys))
        first = _runs(keys[order])
        source = np.full(len(keys), never)
        source[order] = np.repeat(doc[order][first], np.diff(np.r_[first, len(keys)]))
        if len(given):
            at = np.minimum(np.searchsorted(given, keys), len(given) - 1)
            source = np.where(given[at] == keys, np.minimum(source, owners[at]), source)
        hit = (source < doc) & (doc != never)
        start, source = starts[hit], source[hit]
        # words under any window
        n = len(h)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
        gone = np.cumsum(cover[:n]) > 0
        # factors: windows that follow each other in one source (labels only)
        lead = np.r_[True, (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1])] if len(start) else np.zeros(0, bool)
        lead[1:] |= w.owner[start[1:]] != w.owner[start[:-1]]
        begin = np.flatnonzero(lead)
        last = np.r_[begin[1:], len(start)][:len(begin)] - 1
        row = w.owner[start[begin]]
        spans = pa.StructArray.from_arrays(
            [pa.array((start[begin] - w.row[row]).astype(np.int32)), pa.array((start[last] + window - w.row[row]).astype(np.int32)),
             pa.array(source[begin], pa.int64())], ["start", "end", "source"])
        offsets = np.zeros(len(p.ids) + 1, np.int32)
        np.cumsum(np.bincount(row, minlength=len(p.ids)), out=offsets[1:])
        removed = np.bincount(w.owner[gone], minlength=len(p.ids)).astype(np.int64)
        return pa.table({"id": p.ids, "n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed),
                         "kept": joined(w, ~gone), "factors": pa.ListArray.from_arrays(pa.array(offsets), spans)})

    by_shard = packs.mapInArrow(anchors, "shard long, pack long, keys binary, many binary")
    answers = by_shard.groupBy("shard").applyInArrow(shared, "pack long, keys binary")
    rows = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(index, "shard long, pack long, keys binary, owners binary")
    sources = rows.groupBy("shard").applyInArrow(earliest, "pack long, keys binary, owners binary")
    out = packs.groupBy("pack").cogroup(sources.groupBy("pack")).applyInArrow(
        parse, "id long, n_words long, n_removed long, kept string, factors array<struct<start:int,end:int,source:long>>")
    return out.withColumnRenamed("id", id_col)


def joined(w: W.Words, keep: np.ndarray) -> pa.Array:
    """Per row, the kept words joined by one space."""
    start, end = w.start[keep], w.end[keep]
    owner = w.owner[keep]
    buf = w.buf.copy()
    inner = np.r_[False, owner[1:] == owner[:-1]] if len(owner) else np.zeros(0, bool)
    buf[start[inner] - 1] = 0x20
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start - inner] += 1
    edge[end] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    total = np.r_[0, np.cumsum(mask)]
    offsets = total[w.at].astype(np.int32)
    return pa.StringArray.from_buffers(len(w.at) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[mask].tobytes()))
