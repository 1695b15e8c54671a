"""Packs: rows of a table in compressed batches.

Operators that look at texts more than once keep them as packs: one row per
batch of half a MB or so, with the ids, the lengths and one zstd frame of the texts.  Packs are
written to the shared folder once, so that later passes see the same batches
whatever happens to executors, and shuffle at the compressed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import lists, saved

#: Text bytes of a pack: its frame stays well under the size from which the JVM treats objects apart.
PACK_BYTES = 1 << 19

SCHEMA = "pack long, ids array<long>, sizes array<long>, n_words long, blob binary"


@dataclass
class Pack:
    number: int
    ids: pa.Array
    buf: np.ndarray
    at: np.ndarray


def pack_rows(docs: DataFrame, id_col: str, text_col: str, alphabet: W.Alphabet, slice_bytes: int = PACK_BYTES) -> DataFrame:
    """The packs of a table, written; ids are longs (null stays null), null texts empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for i, j, buf, at in W.slices(b.column(1), slice_bytes):
                n = len(W.words(buf, at, alphabet).start)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), ids, lists(np.diff(at), np.array([j - i])), pa.array([n], pa.int64()),
                     pa.array([squeeze.compress(buf.tobytes())], pa.binary())], ["pack", "ids", "sizes", "n_words", "blob"])
                number += 1

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return saved(src.mapInArrow(run, SCHEMA))


def unpack(t: pa.Table | pa.RecordBatch) -> Iterator[Pack]:
    for r in range(t.num_rows):
        ids = t["ids"][r].values
        at = np.r_[0, np.cumsum(t["sizes"][r].values.to_numpy(zero_copy_only=False))].astype(np.int64)
        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(t["blob"][r].as_py(), max_output_size=max(1, int(at[-1]))), np.uint8)
        yield Pack(t["pack"][r].as_py(), ids, buf, at)


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def split_by_shard(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of sorted 64-bit keys, the run of each of n equal ranges that has any: (range, places)."""
    edges = np.searchsorted(keys, np.array([(s << 64) // n for s in range(1, n)], np.uint64))
    for s, (a, b) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True)):
        if b > a:
            yield s, np.arange(a, b)
