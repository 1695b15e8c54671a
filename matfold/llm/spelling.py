"""Spelling variants by permuterm rotations.

Words of all texts are counted, the vocabulary is numbered in code-point order,
and two words that are one edit apart are found through rotations: ``word$`` is
rotated so that the edited place comes last.  Two words that differ in one
letter share the rotation up to that last letter, and the word without the
letter is itself that shared prefix.  All rotations are range-sorted by the
prefix; a prefix has at most one word that equals it and one word per letter of
the alphabet that extends it, so a group holds 91 members whatever the corpus,
and no pairs are written: every member takes its number of neighbours and the
best of them from its group.

An insertion into a run of equal letters gives one word through several places;
only the first place of the run counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import prepare, saved

#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Longest prefix that is kept as text; the md5 stands for longer ones, so a word of length L costs L rows, not L * L bytes.
KEY_CHARS = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def _letter_runs(buf: np.ndarray) -> bytes:
    """The bytes with A-Z lower-cased and all but A-Z, a-z and U+00C0-U+00FF (lead byte C3) blank."""
    lead = buf == 0xC3
    keep = _LETTER[buf] | lead
    keep[1:] |= lead[:-1]
    return np.where(keep, _FOLD[buf], 0x20).astype(np.uint8).tobytes()


def word_counts(docs: DataFrame, min_length: int = 6, damage: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of letters of at least ``min_length`` code points.

    A run whose crc32 of ``<id>:<run>`` is a multiple of ``damage`` loses the code
    point at crc32 % length first (0: none does).  Null ids are empty texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for b in batches:
            ids = b.column(0).fill_null("").to_pylist()
            for i, j, buf, at in W.slices(b.column(1)):
                raw = _letter_runs(buf)
                for r in range(i, j):
                    found = [w for w in raw[at[r - i]:at[r - i + 1]].split() if len(w) >= min_length]
                    counts.update(found)
                    if damage:
                        seed = zlib.crc32(f"{ids[r]}:".encode())
                        for w in found:
                            h = zlib.crc32(w, seed)
                            if h % damage == 0:
                                s = w.decode()
                                k = h % len(s)
                                counts[w] -= 1
                                counts[(s[:k] + s[k + 1:]).encode()] += 1
                    if len(counts) > HELD_WORDS:
                        yield out()
        yield out()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"))
    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(f"n > 0 and char_length(word) >= {int(min_length)}"))


def neighbours(vocab: DataFrame) -> DataFrame:
    """(wid, n_near, best) of the words of ``vocab`` (wid, word, n) that have a neighbour.

    ``best`` is a struct (loss, wid): the neighbour of largest n = -loss, ties to the smallest wid.
    """
    key = "CASE WHEN char_length({0}) <= " + str(KEY_CHARS) + " THEN {0} ELSE md5({0}) END"
    whole = "concat(substring(word, i + 1), '$', substring(word, 1, i))"
    skip = "concat(substring(word, i + 2), '$', substring(word, 1, i))"
    # kinds: 0 the whole rotation, 1 one letter skipped, 2 the same but not the first place of a run of that letter
    rotations = (vocab.select("wid", "n", "word", F.expr("explode(sequence(0, char_length(word)))").alias("i"))
                 .select("wid", "n", F.expr(
                     f"inline(array(struct({key.format(whole)} AS key, 0 AS kind), struct("
                     f"CASE WHEN i < char_length(word) THEN {key.format(skip)} END AS key, "
                     "CASE WHEN i = 0 OR substring(word, i, 1) <> substring(word, i + 1, 1) THEN 1 ELSE 2 END AS kind)))"))
                 .where("key IS NOT NULL"))
    groups = (rotations.repartitionByRange("key").sortWithinPartitions("key")
              .groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("loss"), "wid", "kind"))).alias("all"))
              .where("size(all) > 1"))
    near = groups.select(F.expr(
        "inline(transform(all, x -> struct(x.wid AS wid, filter(all, y -> y.wid <> x.wid AND abs(y.kind - x.kind) < 2) AS near)))"))
    return (near.where("size(near) > 0")
            .groupBy("wid").agg(F.sum(F.size("near").cast("long")).alias("n_near"),
                                F.min(F.struct(F.col("near")[0]["loss"].alias("loss"), F.col("near")[0]["wid"].alias("wid"))).alias("best")))


def _roots(links: DataFrame) -> DataFrame:
    """(wid, root) for links (wid, to) without circles, by pointer doubling; every round halves the way."""
    at = saved(links)
    while True:
        step = at.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        moved = saved(at.join(step, "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("wid", F.col("to").alias("root"))
        at = moved.drop("moved")


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, damage: int = 199,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``min_count`` occurrences.

    ``n_near`` words are one inserted, deleted or replaced code point away; the
    most frequent of them (ties: the smallest in code-point order) is the word's
    ``form`` if it is at least ``ratio`` times as frequent, and ``root`` is the
    last word on the way of forms.  Forms get ``ratio`` times more frequent at
    each step, so the way ends.  Null and empty texts have no words, repeated
    rows count again, other columns are ignored, an empty table gives an empty
    result; a run of any length is one word (prefixes of over 64 code points are
    compared by md5).
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    prepare(docs.sparkSession)
    counts = word_counts(docs, min_length, damage, id_col, text_col).where(F.col("n") >= min_count)
    # numbers in code-point order, written once: they stand for the words in all shuffles
    vocab = saved(counts.repartitionByRange("word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id()))
    near = saved(vocab.join(neighbours(vocab), "wid", "left")
                 .select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.expr(f"CASE WHEN -best.loss >= {int(ratio)} * n THEN best END").alias("best")))
    roots = _roots(near.where("best IS NOT NULL").select("wid", F.col("best.wid").alias("to")))
    names = vocab.select(F.col("wid").alias("at"), F.col("word").alias("name"))
    return (near.join(roots, "wid", "left")
            .join(names.toDF("form_wid", "form"), F.col("best.wid") == F.col("form_wid"), "left")
            .join(names.toDF("root_wid", "root_word"), F.col("root") == F.col("root_wid"), "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("best.loss")).alias("form_n")))
