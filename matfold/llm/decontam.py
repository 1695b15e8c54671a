"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item
of fewer words is one window).  A window's tokens are its shingles of up to
three words, ordered by rarity (how often documents hold them).  As a document
must contain the whole window, the necessary prefix of that order is a single
token, the rarest; a window with a shingle that no document holds is dropped.
Documents join on prefix tokens only.  A match fixes where the window would
lie: the position bound drops those that would begin before the text, the
length bound those that would end after it, and the words of what is left are
compared with the window's.

Documents are scanned twice (rarity, join).  Before the shuffles a fixed-size
bitmap drops tokens that no window has; it is a pre-filter of the exact joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import Bitmap, column_type, lists, prepare, saved

SHINGLE = 3


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; runs of different sizes never meet."""
    return W.grams(h, size) ^ W.mix64(np.array([size], np.uint64))[0]


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, m, words array<long>, key): the distinct windows of every item."""
    kind = column_type(items, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in W.slices(b.column(1)):
                w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
                h = w.hashes()
                rows, sizes, values, keys = [], [], [], []
                for r in range(j - i):
                    own = h[w.row[r]:w.row[r + 1]]
                    m = min(window, len(own))
                    if not m:
                        continue
                    key = W.grams(own, m)
                    _, first = np.unique(key, return_index=True)
                    for p in first:
                        rows.append(i + r)
                        sizes.append(m)
                        values.append(own[p:p + m])
                        keys.append(key[p])
                flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), lists(W.signed(flat), np.array(sizes, np.int64)),
                     pa.array(W.signed(np.array(keys, np.uint64)))], ["item", "m", "words", "key"])

    src = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t")).where("item is not null")
    return src.mapInArrow(run, f"item {kind}, m int, words array<long>, key long").distinct()


def _window_tokens(windows: DataFrame) -> DataFrame:
    """(m, words, key, token, at): the shingles of every distinct window, with their offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, tokens, at = [], [], []
            for r, own in enumerate(b.column(0).to_pylist()):
                t = _shingles(np.array(own, np.int64).view(np.uint64), min(SHINGLE, len(own)))
                rows.append(np.full(len(t), r))
                tokens.append(t)
                at.append(np.arange(len(t)))
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            row = pa.array(cat(rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(W.signed(cat(tokens, np.uint64))),
                                              pa.array(cat(at, np.int32))], ["words", "key", "token", "at"])

    return windows.select("words", "key").dropDuplicates(["key"]).mapInArrow(run, "words array<long>, key long, token long, at int")


def _token_counts(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """How often documents hold each token of the bitmap, added up per batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, _, buf, at in W.slices(b.column(0)):
                w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
                h = w.hashes()
                for size in range(1, SHINGLE + 1):
                    t = _shingles(h, size)
                    found.append(t[w.room(size)[:len(t)] & wanted.match(t)])
            tokens, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(tokens)), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select("t").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _scan(docs: DataFrame, wanted: Bitmap, window: int, kind: str) -> DataFrame:
    """A head row per document (head, n_words) and a row per word position whose token is wanted.

    ``around`` holds the hashes of the words from ``window - 1`` before to
    ``window - 1`` after the position, as far as the document goes; ``pos`` is
    the token's word position, ``lead`` its place in ``around``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "head", "n_words", "token", "pos", "lead", "around"]
        for b in batches:
            for i, j, buf, at in W.slices(b.column(2)):
                w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
                h, owner = w.hashes(), w.owner
                ids, th = b.column(0).slice(i, j - i), b.column(1).slice(i, j - i)
                n = w.counts
                none = pa.array(np.zeros(j - i, np.int32))
                yield pa.RecordBatch.from_arrays([ids, th, pa.array(np.ones(j - i, bool)), pa.array(n), th, none, none,
                                                  lists(np.zeros(0, np.int64), np.zeros(j - i, np.int64), pa.int64())], names)
                pos, tok = [], []
                for size in range(1, SHINGLE + 1):
                    t = _shingles(h, size)
                    p = np.flatnonzero(w.room(size)[:len(t)] & wanted.match(t))
                    pos.append(p)
                    tok.append(t[p])
                pos, tok = np.concatenate(pos), np.concatenate(tok)
                for k in range(0, len(pos), 50_000):
                    p = pos[k:k + 50_000]
                    own = owner[p]
                    lo, hi = np.maximum(p - window + 1, w.row[own]), np.minimum(p + window, w.row[own + 1])
                    size = hi - lo
                    around = h[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
                    rows = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), th.take(rows), pa.array(np.zeros(len(p), bool)), pa.array(n[own]), pa.array(W.signed(tok[k:k + 50_000])),
                         pa.array((p - w.row[own]).astype(np.int32)), pa.array((p - lo).astype(np.int32)), lists(W.signed(around), size)], names)

    return docs.mapInArrow(run, f"id {kind}, th long, head boolean, n_words long, token long, pos int, lead int, around array<long>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """Per document row: (id, n_words, n_hit, spans, items, contaminated).

    ``spans`` are the word ranges (start, end) of the occurring windows, merged;
    ``items`` the sorted ids (as strings) of items with an occurring window;
    ``n_hit`` the words inside spans.  ``with_hash`` adds the text's hash ``th``.
    Null texts have no words and no windows;
    items with a null id are left out; repeated document rows give repeated
    results and repeated items count once; other columns are ignored; empty
    tables give an empty result, respectively no hits.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("t"))
    windows = saved(item_windows(items, item_col, item_text_col, window))
    tokens = saved(_window_tokens(windows))
    counts = _token_counts(src, Bitmap(spark, tokens, "token"))
    rare = (tokens.join(counts, "token", "left").groupBy("key")
            .agg(F.min_by(F.struct("token", "at", "words"), F.struct(F.coalesce("n", F.lit(0)), F.col("token"), F.col("at"))).alias("p"),
                 F.min(F.coalesce("n", F.lit(0))).alias("least"))
            .where("least > 0").select("key", "p.*"))
    prefix = saved(rare.join(windows.select("key", "item", "m"), "key").select("token", "at", "m", "words", "item"))
    scan = _scan(src, Bitmap(spark, prefix, "token"), window, column_type(docs, id_col))
    joined = scan.join(prefix.withColumnRenamed("token", "ptoken"), F.col("token") == F.col("ptoken"), "left")
    begin = F.col("lead") - F.col("at")
    inside = (begin >= 0) & (begin + F.col("m") <= F.size("around"))
    occurs = F.when(F.col("head") | F.col("ptoken").isNull() | ~inside, False).otherwise(
        F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.greatest(F.col("m"), F.lit(0))) == F.col("words"))
    start = F.col("pos") - F.col("at")
    # a head row may meet a prefix token by chance and then stands for itself once more: count its row once
    found = (joined.withColumn("occurs", occurs).where(F.col("head") | F.col("occurs"))
             .groupBy("id", "th").agg(
                 F.max("n_words").alias("n_words"), F.sum(F.col("head").cast("long")).alias("rows"),
                 F.collect_set(F.when(F.col("occurs"), F.struct(start.alias("start"), (start + F.col("m")).alias("end")))).alias("spans"),
                 F.collect_set(F.when(F.col("occurs"), F.col("item").cast("string"))).alias("items")))
    # a span either extends the last one or begins a new one
    zero = F.array().cast("array<struct<start:int,end:int>>")
    def extend(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        meets = x["start"] <= last["end"]
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.coalesce(meets, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(x)))
    found = found.withColumn("spans", F.aggregate(F.array_sort("spans"), zero, extend))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return (found.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
            .select(F.col("id").alias(id_col), *(["th"] if with_hash else []), "n_words", n_hit.alias("n_hit"), "spans", F.array_sort("items").alias("items"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the columns of ``docs``; the hit words are cut out of contaminated texts.

    What is cut runs from the first byte of a span's first word to the last of
    its last word, separators between them included; the rest stays as it is.
    Other rows (null ids and null texts among them) stay unchanged.
    """
    found = contamination(docs, items, window, id_col, text_col, item_col, item_text_col, with_hash=True).where("contaminated")
    spans = found.select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), "spans").dropDuplicates(["__id", "__th"]).withColumnRenamed("spans", "__spans")
    hashed = docs.withColumn("__hash", F.xxhash64(F.col(text_col).cast("string")))
    joined = hashed.join(spans, (hashed[id_col] == spans["__id"]) & (F.col("__hash") == spans["__th"]), "left")
    hit = joined.where("__spans is not null")
    clean = joined.where("__spans is null")
    place = docs.columns.index(text_col)
    schema = ", ".join(f"`{c}` {'string' if c == text_col else t}" for c, t in docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, j, buf, at in W.slices(b.column(place)):
                w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
                keep = np.ones(len(buf), bool)
                for r in range(i, j):
                    for s in b.column(b.num_columns - 1)[r].as_py():
                        first = w.row[r - i]
                        keep[w.start[first + s["start"]]:w.end[first + s["end"] - 1]] = False
                out += [buf[x:y][keep[x:y]].tobytes().decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(out, pa.string()) if k == place else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    names = [F.col(f"`{c}`") for c in docs.columns]
    text = [F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return clean.select(*text).union(hit.select(*names, "__spans").mapInArrow(cut, schema))
