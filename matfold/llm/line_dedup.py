"""Line dedup by pairwise alignment.

Documents overlap where they share a run of consecutive lines of at least
``min_words`` words.  Every line has two such runs, the shortest that begins
and the shortest that ends with it; a common block of two documents with enough
words holds, for each of its lines, one of the runs that has the line in it.
Of the documents of a run the one with the smallest id is the partner of all
others, so that a run which very many documents hold gives one pair per
document and not all pairs, and no block is lost by that.

Each pair is aligned by patience diff over the line hashes: common ends are
matched, lines that are unique on both sides anchor the longest increasing
chain, and the gaps between anchors are aligned again.  Aligned common blocks
of at least ``min_words`` words are deleted from the later document.  Lines
left over that the partner has (repeated ones, and those in another order) are
then matched occurrence by occurrence, by the runs of the pair.  So a line goes
if and only if it is in a block of enough words that some earlier document has
too.

The first document with a line is never the later one of a pair for it, so
every deleted line stays in one document at least.

Pairs carry line hashes only; texts are read again for the deletion.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import column_type, lists, prepare, saved


def lines_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, row) of all lines of the rows; blank lines have 0 words.

    Row ``i`` owns the lines ``row[i]:row[i + 1]``, one more than it has line
    feeds, as ``split`` counts them.
    """
    feed = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([feed + 1, at[:-1]]), kind="stable")
    end = np.sort(np.concatenate([at[1:], feed]), kind="stable")
    row = np.r_[0, np.cumsum(1 + np.diff(np.searchsorted(feed, at)))]
    lines = W.Words(buf, at, start, end, row, W.BLANK_WORDS)
    found = W.words(buf, at, W.BLANK_WORDS)
    n = np.bincount(np.searchsorted(start, found.start, "right") - 1, minlength=len(start))
    return lines.hashes(), n, row


def runs(h: np.ndarray, n: np.ndarray, row: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end line, key) of the shortest runs of ``min_words`` words that begin or end with each line."""
    total, least = np.r_[0, np.cumsum(n)], max(1, min_words)
    line = np.arange(len(h))
    low, high = np.repeat(row[:-1], np.diff(row)), np.repeat(row[1:], np.diff(row))
    end = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    ahead, back = end <= high, (start >= low) & (n < least)  # a line of enough words is one run
    first, last = np.r_[line[ahead], start[back]], np.r_[end[ahead], line[back] + 1]
    up, down = W._POWERS.get(len(h) + 1)
    pre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=pre[1:])
    return first, last, W.mix64((pre[last] - pre[first]) * down[first] + (last - first).astype(np.uint64))


def _chain(b: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting)."""
    piles: list[int] = []
    top: list[int] = []
    back: list[int] = []
    for i, v in enumerate(b):
        p = bisect_left(piles, v)
        if p == len(piles):
            piles.append(v)
            top.append(i)
        else:
            piles[p] = v
            top[p] = i
        back.append(top[p - 1] if p else -1)
    out = []
    i = top[-1] if top else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences by patience diff, in order."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, ie, j, je = gaps.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        na, nb = Counter(a[i:ie]), Counter(b[j:je])
        at = {v: k for k, v in enumerate(a[i:ie], i) if na[v] == 1 and nb.get(v) == 1}
        both = [(at[v], k) for k, v in enumerate(b[j:je], j) if v in at]
        anchors = [both[k] for k in _chain([x for x, _ in both])]
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (ie, je)], strict=True):
            gaps.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def blocks(matched: list[tuple[int, int]], words: Sequence[int], min_words: int) -> list[int]:
    """Places in the later sequence of blocks of matches with enough words."""
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(matched):
        if run and matched[k - 1] != (i - 1, j - 1):
            if sum(words[x] for x in run) >= min_words:
                out += run
            run = []
        run.append(j)
    if run and sum(words[x] for x in run) >= min_words:
        out += run
    return out


def shared(a: Sequence[int], b: Sequence[int], words: Sequence[int], min_words: int) -> list[int]:
    """Places of ``b`` in common blocks with enough words: aligned ones, then those of the lines left over."""
    gone = set(blocks(align(a, b), words, min_words))
    held = set(a)
    if all(j in gone or v not in held for j, v in enumerate(b)):
        return sorted(gone)
    size = dict(zip(b, words, strict=True))
    both = []
    for seq in (a, b):  # a line that b has not is in no common run, whatever its words
        n = np.array([size.get(v, min_words) for v in seq], np.int64)
        both.append(runs(np.array(seq, np.int64).view(np.uint64), n, np.array([0, len(seq)]), min_words))
    hit = np.isin(both[1][2], both[0][2])
    edge = np.zeros(len(b) + 1, np.int64)
    np.add.at(edge, both[1][0][hit], 1)
    np.add.at(edge, both[1][1][hit], -1)
    return sorted(gone.union(np.flatnonzero(np.cumsum(edge) > 0).tolist()))


def deleted_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, keep array<boolean>) of the documents that lose lines; th is the text's hash."""
    kind = column_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in W.slices(b.column(2)):
                h, n, row = lines_of(buf, at)
                size = np.diff(row)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists(W.signed(h), size), lists(n.astype(np.int32), size)],
                                                 ["id", "th", "h", "n"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).where("id is not null and t is not null")
    lines = saved(src.mapInArrow(run, f"id {kind}, th long, h array<long>, n array<int>").dropDuplicates(["id", "th"]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.r_[0, np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            first, _, key = runs(b.column(2).flatten().to_numpy().view(np.uint64), b.column(3).flatten().to_numpy().astype(np.int64), row, min_words)
            owner = np.searchsorted(row, first, "right") - 1
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])][:len(key)]
            owner, key = pa.array(owner[new]), W.signed(key[new])
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), pa.array(key)], ["id", "th", "line"])

    each = lines.mapInArrow(keys, f"id {kind}, th long, line long")
    first = each.groupBy("line").agg(F.min(F.struct("id", "th")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    pairs = (each.join(first.select("line", "first"), "line").where("first.id < id")
             .select(F.col("first.id").alias("pid"), F.col("first.th").alias("pth"), "id", "th").distinct())
    partner = lines.select(F.col("id").alias("pid"), F.col("th").alias("pth"), F.col("h").alias("ph"))
    both = pairs.join(lines, ["id", "th"]).join(partner, ["pid", "pth"]).select("id", "th", "h", "n", "ph")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, size = [], []
            for h, n, ph in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                own = shared(ph, h, n, min_words)
                gone += own
                size.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in b.column(2)], pa.int32()), lists(np.array(gone, np.int32), np.array(size, np.int64))],
                                             ["id", "th", "lines", "gone"])

    found = both.mapInArrow(aligned, f"id {kind}, th long, lines int, gone array<int>")
    gone = found.select("id", "th", "lines", F.explode("gone").alias("g")).groupBy("id", "th", "lines").agg(F.collect_set("g").alias("gone"))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy()
            keep = []
            for n, g in zip(size, b.column(3), strict=True):
                k = np.ones(n, bool)
                k[g.values.to_numpy()] = False
                keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(np.concatenate(keep) if keep else np.zeros(0, bool), size.astype(np.int64), pa.bool_())], ["id", "th", "keep"])

    return gone.mapInArrow(masks, f"id {kind}, th long, keep array<boolean>")


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """The rows of ``docs`` with the columns of ``docs``, deleted lines taken out of the text.

    With ``report``: (id, n_lines, n_removed, text) instead.

    A text keeps its row when all lines go (then it is empty); null texts stay
    null (0 lines); rows with a null id stay as they are and are no partner;
    rows that repeat an id are not earlier than each other; blank lines are
    never shared alone but go with the block around them; column names of
    ``docs`` do not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    gone = deleted_lines(docs, id_col, text_col, min_words).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("keep").alias("__keep"))
    text = F.col(text_col).cast("string")
    all_ = docs.withColumn("__hash", F.xxhash64(text))
    out = all_.join(gone, (F.col(id_col) == F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.element_at("__keep", i + 1)), "\n")
    new = F.when(F.col("__keep").isNull(), text).otherwise(left)
    if report:
        n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
        removed = F.coalesce(F.size(F.filter("__keep", lambda k: ~k)), F.lit(0))
        return out.select(F.col(id_col), n.cast("long").alias("n_lines"), F.when(F.col("__keep").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"), new.alias("text"))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
