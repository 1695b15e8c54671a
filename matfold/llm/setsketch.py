"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct ``shingle``-word shingles.  Its sketch
has one register per hash function: the smallest of the elements' exponential
hash values, truncated to an exponentially spaced grid, ``floor(1 - log_b h)``.
Registers merge by maximum and two registers agree with a probability close to
the Jaccard similarity, so runs of registers make bands for candidate search.

1. Documents of equal sets are one node from here on.
2. Nodes that share a band are candidates.  In each band's bucket every node is
   first compared with two centres only, one row per node and bucket.
3. What is then left in a bucket outside its largest component is compared
   with the bucket's nodes of other components, in blocks of bounded size,
   sketch against sketch and, where that does not rule a pair out, on the full
   sets.  Only links leave a block.
4. A candidate pair is judged jointly from its two sketches: by the sizes,
   which are exact, and by the likelihood of the register comparison.  It is
   dropped where the likeliest similarity is e^``slack`` times as likely as any
   similarity that counts.  What stays is confirmed on the full sets.

Components need no link between nodes that are connected anyway, so none is
lost by the order of the comparisons.  The bands miss a pair of similarity
exactly 0.75 with a probability of about 2e-6, more similar ones less.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import column_type, filed, prepare, saved
from matfold.llm.graph import components

BANDS, ROWS = 44, 5
BASE = 1.1
RATE = 20.0
#: Nodes of a bucket per block of the exact comparison.
BLOCK = 512


@lru_cache(maxsize=1)
def _multipliers(m: int) -> np.ndarray:
    return W.mix64(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order, and where each row's begin (one more at the end)."""
    w = W.words(buf, at, W.BLANK_WORDS_LOWER)
    h, n = w.hashes(), w.counts
    g = W.grams(h, k)
    g = g[w.room(k)[:len(g)]]
    size = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence as one
        place = np.r_[0, np.cumsum(size)][short]
        g = np.insert(g, place, [W.whole(h[w.row[r]:w.row[r + 1]]) for r in short])
        size[short] = 1
    return g, np.r_[0, np.cumsum(size)]


def registers(g: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """The sketches (rows x m, uint8) of runs of elements; rows without elements get zeros."""
    size = np.diff(row)
    full = np.flatnonzero(size)
    least = np.zeros((m, len(full)), np.uint64)
    if len(full):
        t = np.empty_like(g)
        for i, a in enumerate(_multipliers(m)):
            np.multiply(g, a, out=t)
            least[i] = np.minimum.reduceat(t, row[:-1][full])
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    k = np.floor(1 - np.log(np.maximum(h, 1e-300)) / math.log(BASE))
    out = np.zeros((len(size), m), np.uint8)
    out[full] = np.clip(k, 0, 255).T
    return out


def likelihood_ratio(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    """log of (best likelihood of any similarity / best one of at least ``threshold``) per pair.

    ``x``, ``y``: registers (pairs x m); ``nx``, ``ny``: exact sizes.  Joint
    estimation: a register of x is above y's with probability p(u - v J), below
    with p(v - u J), equal otherwise, u and v being the shares of the sizes.
    """
    m = x.shape[1]
    return ratio_of_counts((x > y).sum(1), (x < y).sum(1), m, nx, ny, threshold)


def ratio_of_counts(above: np.ndarray, below: np.ndarray, m: int, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    grid = np.r_[np.linspace(0, threshold, 24, endpoint=False), np.linspace(threshold, 1, 12)][None, :]
    j = np.minimum(grid, np.minimum(u / v, v / u))
    p = lambda z: -np.log1p(-np.clip(z, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-9)
    above, below = above[:, None], below[:, None]
    ll = above * np.log(up) + below * np.log(down) + (m - above - below) * np.log(same)
    return ll.max(1) - ll[:, 24:].max(1)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, m: int) -> DataFrame:
    """(id, n, node, regs) per row; node is a hash of the set, null for empty sets."""
    kind = column_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in W.slices(b.column(1), 1 << 19):
                g, row = shingles(buf, at, shingle)
                regs = registers(g, row, m)
                n, nodes = [], []
                for r in range(j - i):
                    own = np.unique(g[row[r]:row[r + 1]])
                    n.append(len(own))
                    nodes.append(_node(own))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                     pa.array([x.tobytes() for x in regs], pa.binary())], ["id", "n", "node", "regs"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {kind}, n long, node long, regs binary")


def _node(own: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(own) else None


def _promising(pairs: DataFrame, nodes: DataFrame, num: int, den: int, slack: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches don't rule the similarity out."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                t = b.slice(i, 2000)
                x, y = (np.stack([np.frombuffer(v.as_py(), np.uint8) for v in t[c]]) for c in ("ra", "rb"))
                nx, ny = (t[c].to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                keep = likelihood_ratio(x, y, nx, ny, num / den) <= slack
                yield t.select(["a", "b"]).filter(pa.array(keep))

    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"s{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of every wanted (node, rep id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in W.slices(b.column(1)):
                g, row = shingles(buf, at, shingle)
                own = [np.unique(g[row[r]:row[r + 1]]) for r in range(j - i)]
                # a repeated id may come with another text
                fits = pa.array([_node(x) == y for x, y in zip(own, b.column(0).slice(i, j - i).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "set"]).filter(fits)

    src = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    found = src.join(wanted, src["rep"].eqNullSafe(wanted["wrep"])).select("node", "t").mapInArrow(run, "node long, set binary")
    return found.dropDuplicates(["node"])


def _cross(cells: DataFrame, m: int, num: int, den: int, slack: float) -> DataFrame:
    """Per block cell the links (a, b) of strays with nodes of other components."""
    def run(t: pa.Table) -> pa.Table:
        stray = t["stray"].to_numpy()
        node, comp, n = (t[c].to_numpy() for c in ("node", "comp", "n"))
        regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint8).reshape(len(node), m)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["set"]]
        s, r = np.flatnonzero(stray), np.flatnonzero(~stray)
        y, ny, cy = regs[r], n[r], comp[r]
        out_a, out_b = [], []
        for i in range(0, len(s), 16):
            k = s[i:i + 16]
            # J >= threshold makes registers agree about that often: half of them is many deviations below
            same = (regs[k][:, None, :] == y[None, :, :]).sum(2)
            small, large = np.minimum(n[k][:, None], ny), np.maximum(n[k][:, None], ny)
            p, q = np.nonzero((same >= m / 2) & (comp[k][:, None] != cy) & (small * den >= large * num))
            if not len(p):
                continue
            x, z = regs[k[p]], y[q]
            fine = ratio_of_counts((x > z).sum(1), (x < z).sum(1), m, n[k[p]].astype(float), ny[q].astype(float), num / den) <= slack
            p, q = p[fine], q[fine]
            for u in np.unique(p):
                own, others = sets[k[u]], r[q[p == u]]
                size = n[others]
                flat = np.concatenate([sets[o] for o in others])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(hit, np.r_[0, np.cumsum(size)[:-1]], dtype=np.int64)
                linked = others[den * common >= num * (len(own) + size - common)]
                # one link to each other component is enough
                first = np.unique(comp[linked], return_index=True)[1]
                out_a += [node[k[u]]] * len(first)
                out_b += node[linked[first]].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return cells.groupBy("key", "sblock", "mblock").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text", slack: float = 16.0) -> DataFrame:
    """Per row: (id, n_shingles, component_id, kept).

    Links texts with den * intersection >= num * union of their shingle sets.
    Texts without words (or null) are in no set and make components of their
    own; rows of one text, or that repeat, are one component; a component's id
    is its smallest document id, ``kept`` tells the rows that carry it; rows
    with a null id are kept only where no other row of their component has an id; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    m = BANDS * ROWS
    rows = saved(sketches(docs, id_col, text_col, shingle, m))
    size, elements = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = saved(filed(nodes, size))
    keys = F.array(*[F.xxhash64(F.lit(j), F.expr(f"substring(regs, {j * ROWS + 1}, {ROWS})")) for j in range(BANDS)])
    bands = nodes.select("node", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first"), F.max("node").alias("last")).where("members > 1")
    members = saved(filed(bands.join(shared, "key"), size * BANDS, 50_000))
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("rep").alias("wrep")), "node")
    sets = saved(filed(_sets(docs, id_col, text_col, wanted, shingle), elements, 1 << 19))

    # every node with its bucket's centres
    pairs = members.select(F.col("node").alias("a"), F.explode(F.array("first", "last")).alias("b")).where("a != b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comps = components(_confirmed(_promising(pairs, nodes, num, den, slack), sets, num, den), rows=size)

    # what is outside a bucket's largest component with the bucket's other components
    placed = members.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    main = (sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("total"), F.max("size").alias("most"))
            .where("most < total"))
    # members and strays have blocks of their own, so that a bucket's members are written once per BLOCK strays
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    marked = placed.join(main, "key").withColumns({"blocks": blocks(F.col("total")), "sblocks": blocks(F.col("total") - F.col("most"))})
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    one = lambda stray, s, m_: F.struct(F.lit(stray).alias("stray"), s.alias("sblock"), m_.alias("mblock"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_member = F.transform(every("sblocks"), lambda o: one(False, o, own("blocks")))
    as_stray = F.when(F.col("comp") != F.col("main"), F.transform(every("blocks"), lambda o: one(True, own("sblocks"), o))).otherwise(F.array())
    cells = marked.select("key", "node", "comp", F.explode(F.concat(as_member, as_stray)).alias("c")).select("key", "node", "comp", "c.*")
    kept = cells.groupBy("key", "sblock", "mblock").agg(F.max("stray").alias("s"), F.min("stray").alias("m")).where("s and not m").select("key", "sblock", "mblock")
    cells = cells.join(kept, ["key", "sblock", "mblock"]).join(nodes.select("node", "n", "regs"), "node").join(sets, "node")
    more = saved(filed(_cross(cells, m, num, den, slack).distinct(), size))
    if more.take(1):
        # the components so far are stars already
        comps = components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(more), rows=size)

    roots = rows.join(comps, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    least = roots.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = roots.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs``, columns unchanged, but for those that another row of their component stands for.

    The kept row of a component is the one of its smallest id; rows that repeat
    that id all stay if they have the same text and only those (a later stage
    of exact rows may drop them); rows with a null id stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
