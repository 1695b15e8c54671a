"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is a character 4-gram model (characters beyond the basic plane count
as one replacement character), trained on the whole texts of the trusted
documents but for a held-out fifth, which sets the thresholds.  Discounts
D1, D2, D3+ come from the counts of counts of each order; lower orders use
continuation counts; the last level is uniform.

Documents are dealt into batches by a hash of the id.  A batch sends its
distinct n-grams, with how often trusted documents hold them, to the shards of
the count table; counts, continuation counts and back-off weights are Spark
aggregations; each batch gets back the entries of its own n-grams and scores
its documents.  No task holds the whole model, and a frequent n-gram reaches
its shard once per batch.

A document is kept if its perplexity is at most the edge of its language: the
given quantile of the n held-out trusted documents of the language, shrunk
towards their mean plus a margin from the spread pooled over all languages (the
prediction limit, wider by 1 / n).  The quantile's own weight is n of
n + 1 / (1 - quantile).  Without held-out documents of a language the margin has
no bound, so all of its documents are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import column_type, lists, prepare, saved

ORDER = 4
BATCH_BYTES = 48 << 20
#: Of 5 parts of the trusted documents, 1 sets the thresholds.
PARTS = 5

_U16 = np.uint64(16)


class KeyIndex:
    """Dense numbers of distinct non-zero 64-bit keys: open addressing over whole arrays."""

    def __init__(self) -> None:
        self.bits, self.size = 16, 0
        self._clear()

    def _clear(self) -> None:
        self.slot = np.zeros(1 << self.bits, np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where unknown."""
        at = self._home(keys)
        held = self.slot[at]
        out = np.where(held == keys, self.number[at], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.slot[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.number[at[todo[same]]]
            todo = todo[~same & (held != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new distinct keys from ``size`` on."""
        if self.size + len(keys) > (1 << self.bits) // 3:
            old, numbers = self.slot[self.slot != 0], self.number[self.slot != 0]
            while self.size + len(keys) > (1 << self.bits) // 3:
                self.bits += 1
            self._clear()
            self._place(old, numbers)
        self._place(keys, np.arange(self.size, self.size + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = self._home(keys)
        while len(keys):
            free = self.slot[at] == 0
            self.slot[at[free]] = keys[free]
            won = self.slot[at] == keys
            self.number[at[won]] = numbers[won]
            keys, numbers, at = keys[~won], numbers[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


def char_grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-gram key of every character of the rows, with three start marks before each row; row bounds."""
    lead = (buf & 0xC0) != 0x80
    row = np.r_[0, np.cumsum(lead)][at]
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != row[-1]:  # broken UTF-8: row by row
        texts = [buf[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(at[:-1], at[1:], strict=True)]
        codes = np.frombuffer(b"".join(texts), np.uint32)
        row = np.r_[0, np.cumsum([len(t) // 4 for t in texts])].astype(np.int64)
    codes = np.where((codes > 0xFFFF) | (codes < 2), np.uint32(0xFFFD), codes)
    n = np.diff(row)
    marked = np.ones(len(codes) + 3 * len(n), np.uint64)
    place = np.arange(len(codes)) + 3 * np.repeat(np.arange(1, len(n) + 1), n)
    marked[place] = codes
    key = marked.copy()
    for back in (1, 2, 3):
        key[back:] |= marked[:-back] << np.uint64(16 * back)
    return key[place], row


def _with_lower_orders(keys: np.ndarray) -> np.ndarray:
    """The n-grams, all that their interpolation looks up, and the empty context 0."""
    out = [keys]
    now = keys
    for order in range(ORDER - 1, 0, -1):
        now = np.unique(np.concatenate([now >> _U16, now & np.uint64((1 << 16 * order) - 1)]))
        out.append(now)
    return np.unique(np.concatenate([*out, np.zeros(1, np.uint64)]))


def _packs(rows: DataFrame, kind: str, lang_kind: str) -> DataFrame:
    """One row per input batch and batch number: ids, languages, text hashes, sizes and the texts in one frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for b in batches:
            number = b.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            for run_ in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                some = b.take(pa.array(run_))
                for i, j, buf, at in W.slices(some.column(4), 4 << 20):
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), some.column(c).slice(i, j - i))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number[run_[0]]], pa.int64()), one(1), one(2), one(3), lists(np.diff(at), np.array([j - i])),
                         pa.array([squeeze.compress(buf.tobytes())], pa.binary())], ["b", "ids", "langs", "ths", "sizes", "blob"])

    return rows.mapInArrow(run, f"b long, ids array<{kind}>, langs array<{lang_kind}>, ths array<long>, sizes array<long>, blob binary")


def _texts(t: pa.Table) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    for r in range(t.num_rows):
        at = np.r_[0, np.cumsum(t["sizes"][r].values.to_numpy(zero_copy_only=False))].astype(np.int64)
        blob = zstandard.ZstdDecompressor().decompress(t["blob"][r].as_py(), max_output_size=max(1, int(at[-1])))
        yield r, t["ids"][r].values, np.frombuffer(blob, np.uint8), at


def _levels(top: DataFrame) -> tuple[list[DataFrame], int]:
    """(key, alpha, lam) parts of the model, one pair per order, from (key, c) of the highest order; vocabulary size."""
    counts = [top]
    for order in range(ORDER - 1, 0, -1):
        lower = counts[-1].select(F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("key"))
        counts.append(saved(lower.groupBy("key").agg(F.count("*").alias("c"))))
    parts = []
    for c in counts:
        n = {r["c"]: r["n"] for r in c.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts(n)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        ctx = c.withColumn("ctx", F.shiftrightunsigned("key", 16)).withColumn("d", cut)
        total = ctx.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("cut"))
        parts.append(ctx.join(total.select("ctx", "total"), "ctx").select("key", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("lam")))
        parts.append(total.select(F.col("ctx").alias("key"), F.lit(None).cast("double").alias("alpha"), (F.col("cut") / F.col("total")).alias("lam")))
    return parts, counts[-1].count() + 1


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney D1, D2, D3+ from counts of counts; 0.5, 1, 1.5 where these are too few."""
    if not all(n.get(i) for i in (1, 2, 3)):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(i - (i + 1) * y * n.get(i + 1, 0) / n[i], 0.05 * i), i - 0.05) for i in (1, 2, 3))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, th, n_chars, nats) per row of ``docs``; ``trusted`` has one column, the ids to train on.

    ``nats`` is minus the log probability of the text, 0 for empty and null
    texts; ``th`` the text's hash; without any training text every character
    has the same probability.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind, lang_kind = column_type(docs, id_col), column_type(docs, lang_col)
    text = F.col(text_col).cast("string")
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    deal = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(total / BATCH_BYTES)))).alias("b")
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text).alias("th"), text.alias("t")).select(deal, "id", "lang", "th", "t")
    packs = _packs(rows, kind, lang_kind)
    train = trusted.select(F.col(trusted.columns[0]).cast(kind).alias("id")).where("id is not null").distinct().select(deal, "id")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        index, counts = KeyIndex(), np.zeros(0, np.int64)
        wanted = right["id"].combine_chunks()
        for _, ids, buf, at in _texts(left):
            good = np.asarray(pa.compute.is_in(ids, wanted)) if len(wanted) else np.zeros(len(ids), bool)
            for i, j, some, own in _cut(buf, at):
                key, row = char_grams(some, own)
                number = index.find(key)
                new = np.unique(key[number < 0])
                if len(new):
                    index.add(new)
                    number = index.find(key)
                counts = np.r_[counts, np.zeros(index.size - len(counts), np.int64)]
                counts += np.bincount(number[np.repeat(good[i:j], np.diff(row))], minlength=index.size)
        held = index.slot != 0
        n = np.zeros(index.size, np.int64)
        n[:] = counts
        keys = np.zeros(index.size, np.uint64)
        keys[index.number[held]] = index.slot[held]
        every = _with_lower_orders(keys)
        number = np.where(every == 0, -1, index.find(every))
        at_top = np.where(number >= 0, n[np.maximum(number, 0)] if len(n) else 0, 0)
        b = left["b"][0].as_py() if left.num_rows else 0
        return pa.table({"b": pa.array(np.full(len(every) if left.num_rows else 0, b, np.int64)), "key": W.signed(every) if left.num_rows else np.zeros(0, np.int64),
                         "c": at_top if left.num_rows else np.zeros(0, np.int64)})

    sent = saved(packs.groupBy("b").cogroup(train.groupBy("b")).applyInArrow(gather, "b long, key long, c long"))
    top = saved(sent.where("c > 0").groupBy("key").agg(F.sum("c").alias("c")))
    parts, vocabulary = _levels(top)
    model = reduce(DataFrame.union, parts).groupBy("key").agg(F.max("alpha").alias("alpha"), F.max("lam").alias("lam"))
    answers = sent.select("b", "key").join(model, "key").select("b", "key", F.col("alpha").cast("float").alias("alpha"), F.col("lam").cast("float").alias("lam"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        alpha = np.nan_to_num(right["alpha"].to_numpy().astype(float))[order]
        lam = right["lam"].to_numpy().astype(float)[order]
        lam = np.where(np.isnan(lam), 1.0, lam)  # an unseen context leaves all to the lower order
        index, table = KeyIndex(), np.zeros(0)
        out = []
        for r, ids, buf, at in _texts(left):
            nats = np.zeros(len(ids))
            n = np.zeros(len(ids), np.int64)
            for i, j, some, own in _cut(buf, at):
                key, row = char_grams(some, own)
                number = index.find(key)
                new = np.unique(key[number < 0])
                if len(new):
                    index.add(new)
                    table = np.r_[table, log_probability(new, keys, alpha, lam, vocabulary)]
                    number = index.find(key)
                n[i:j] = np.diff(row)
                nats[i:j] = -np.diff(np.r_[0, np.cumsum(table[number])][row]) if len(key) else 0
            out.append(pa.table({"id": ids, "lang": left["langs"][r].values, "th": left["ths"][r].values, "n_chars": n, "nats": nats}))
        return pa.concat_tables(out) if out else left.select(["b"]).slice(0, 0)

    return packs.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, f"id {kind}, lang {lang_kind}, th long, n_chars long, nats double")


def _cut(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about 1 MB."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
        yield i, j, buf[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def log_probability(grams: np.ndarray, keys: np.ndarray, alpha: np.ndarray, lam: np.ndarray, vocabulary: int) -> np.ndarray:
    """Interpolated log probability of the last character of each 4-gram, from sorted model entries."""
    def entry(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x)), np.ones(len(x))
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[at] == x
        return np.where(hit, alpha[at], 0.0), np.where(hit, lam[at], 1.0)

    p = np.full(len(grams), 1.0 / vocabulary)
    for order in range(1, ORDER + 1):
        own = grams if order == ORDER else grams & np.uint64((1 << 16 * order) - 1)
        p = entry(own)[0] + entry(own >> _U16)[1] * p
    return np.log(np.maximum(p, 1e-12))


def student(quantile: float, df: float) -> float:
    """Quantile of Student's t (series around the normal one, close from some 3 degrees of freedom on)."""
    z = NormalDist().inv_cdf(min(max(quantile, 1e-9), 1 - 1e-9))
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)


def edges(known: DataFrame, quantile: float) -> DataFrame:
    """(key, edge) from (key, rate) of held-out trusted documents; null where no language has two of them."""
    by_key = known.groupBy("key").agg(F.percentile_approx("rate", quantile, 100000).alias("own"), F.count("*").alias("n"), F.avg("rate").alias("mean"),
                                      F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("var"))
    df, squares = by_key.agg(F.sum(F.col("n") - 1), F.sum((F.col("n") - 1) * F.col("var"))).first()
    if not df:
        return by_key.select("key", F.lit(None).cast("double").alias("edge"))
    reach = student(quantile, df) * math.sqrt(squares / df)
    weight = F.col("n") / (F.col("n") + F.lit(1 / max(1 - quantile, 1e-9)))
    return by_key.select("key", (weight * F.col("own") + (1 - weight) * (F.col("mean") + F.lit(reach) * F.sqrt(1 + 1 / F.col("n")))).alias("edge"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Per row: (id, lang, th, n_chars, perplexity, threshold, keep).

    Trusted are ids whose labels all say quality 1 and toxic 0 (or null).
    Texts without characters (or null) have a null perplexity and are kept;
    a null language is a language of its own; rows with a null id are scored
    but never trusted; repeated rows give repeated results; extra columns are
    ignored; an empty table gives an empty result.
    """
    good = ((F.col(quality_col) == 1) & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0))
    trusted = (labels.groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good"))
               .where("good = 1 and id is not null").select("id", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)) == 0).alias("held")))
    scored = saved(perplexities(docs, trusted.where("not held").select("id"), id_col, text_col, lang_col))
    scored = scored.withColumn("rate", F.when(F.col("n_chars") > 0, F.col("nats") / F.col("n_chars")))
    key = F.when(F.col("lang").isNull(), F.lit("n")).otherwise(F.concat(F.lit("l"), F.col("lang").cast("string")))
    known = scored.withColumn("key", key).join(trusted.where("held").select("id"), "id").where("rate is not null")
    out = scored.withColumn("key", key).join(edges(known, quantile), "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "th", "n_chars", F.exp("rate").alias("perplexity"), F.exp("edge").alias("threshold"),
                      F.coalesce(F.col("rate") <= F.col("edge"), F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", **columns: str) -> DataFrame:
    """The rows of ``docs``, columns unchanged, but for those that the classifier rejects."""
    bad = classify(docs, labels, quantile, id_col, text_col, lang_col, **columns).where("not keep").select(F.col(id_col).alias("__id"), F.col("th").alias("__th")).distinct()
    hashed = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(bad, (docs[id_col] == bad["__id"]) & (hashed == bad["__th"]), "left_anti")
