"""Token counts by rank-synchronous array merging (sentencepiece BPE).

The vocabulary file is only read for its pieces and scores; segmentation is
done here.  A text is cut into pre-tokens (a run of spaces and the word after
it; no piece crosses these cuts), distinct pre-tokens of a batch are laid out
as one ragged numpy array of symbols, and all of them are merged together: in
every step each pre-token's best-ranked adjacent pair is replaced, and the
array is compacted.  Symbols that are no piece count as their UTF-8 bytes.

Where a pre-token holds its best pair several times, all occurrences merge in
one step unless that makes a pair which ranks before it; then only the
leftmost one does, as the sequential definition demands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm.common import prepare

SPACE = "▁"
_CACHE_WORDS = 400_000
_NONE = np.int64(1) << 40


class PieceCounter:
    """Counts tokens of texts under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback):
            raise ValueError("only BPE models with identity normalisation and byte fallback are supported")
        self.prefix = norm.add_dummy_prefix
        # types: 1 normal, 4 user defined, 5 unused, 6 byte
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal) or any("\n" in p for p, _ in normal):
            raise ValueError("a piece crosses a pre-token border")
        order = sorted(range(len(normal)), key=lambda i: -normal[i][1])
        self.symbol = {normal[i][0]: r for r, i in enumerate(order)}  # piece -> rank = symbol id
        pairs = {}
        for piece, rank in self.symbol.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # symbol of every code point: a piece's, or minus the bytes it falls back to
        point = np.arange(0x110000)
        self.char_symbol = -(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype(np.int32)
        single = {ord(p): r for p, r in self.symbol.items() if len(p) == 1}
        self.char_symbol[list(single)] = list(single.values())
        self.cache: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (= merged symbol) of each pair, _NONE where the pair is no piece."""
        key = (left << 20) | right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE)

    def lengths(self, pretokens: list[str]) -> np.ndarray:
        """Number of tokens of every pre-token."""
        n = len(pretokens)
        size = np.fromiter(map(len, pretokens), np.int64, n)
        points = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        # symbols: >= 0 a piece, < 0 minus the number of bytes it falls back to
        sym = self.char_symbol[points].astype(np.int64)
        seq = np.repeat(np.arange(n), size)
        out = np.zeros(n, np.int64)
        rank = self._rank_at(sym, seq, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sym)]))
            over = (best == _NONE)[group]
            if over.any():  # finished sequences leave the array
                out += np.bincount(seq[over], np.where(sym[over] >= 0, 1, -sym[over]), n).astype(np.int64)
                keep = ~over
                sym, seq, rank, group = sym[keep], seq[keep], rank[keep], group[keep]
                if not len(sym):
                    break
            best = best[group]
            at = self._chosen(sym, seq, np.flatnonzero(rank == best), best)
            sym[at] = best[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1  # where the merged symbols are after compaction
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            touched = np.r_[at, at[at > 0] - 1]
            rank[touched] = self._rank_at(sym, seq, touched)
        return out

    def _rank_at(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each of these places."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        right = np.where((at + 1 < len(sym)) & (seq[nxt] == seq[at]), sym[nxt], -1)
        return self._ranks(sym[at], right)

    def _chosen(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the places of each sequence's best pair, those that may merge in this step."""
        # overlapping occurrences (a a a): every second one of a run, from the left
        run = np.r_[True, (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[place % 2 == 0]
        new = best[at]
        lead = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
        if lead.all():
            return at
        # pairs that arise beside a merged symbol, in any order of the merges
        end = len(sym)
        right_at = np.minimum(at + 2, end - 1)
        right = np.where((at + 2 < end) & (seq[right_at] == seq[at]), sym[right_at], -1)
        after = np.r_[(at[1:] == at[:-1] + 2) & (seq[at[1:]] == seq[at[:-1]]), False]
        left_at = np.maximum(at - 1, 0)
        left = np.where((at > 0) & (seq[left_at] == seq[at]), sym[left_at], -1)
        left = np.where(np.r_[False, after[:-1]], new, left)
        worse = (self._ranks(new, right) < new) | (self._ranks(left, new) < new)
        if worse.any():
            at = at[lead | ~np.isin(seq[at], seq[at[worse]])]
        return at

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        cache, parts, plus = self.cache, [], []
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for text in texts:
            if not text:
                parts.append([])
                plus.append(0)
                continue
            text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            lines = text.split("\n")
            own: list[str] = []
            for line in lines:
                if SPACE * 2 in line:
                    own += re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
                elif line:
                    head, *rest = line.split(SPACE)
                    if head:
                        own.append(head)
                    own += [SPACE + w for w in rest]
            parts.append(own)
            plus.append(len(lines) - 1)
        new = list({w for own in parts for w in own if w not in cache})
        for i in range(0, len(new), 50_000):
            some = new[i:i + 50_000]
            cache.update(zip(some, self.lengths(some).tolist(), strict=True))
        return [sum(map(cache.__getitem__, own)) + p for own, p in zip(parts, plus, strict=True)]


@lru_cache(maxsize=4)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """Per row: (id, n_bytes, n_tokens, over_limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    ``model_path`` must be readable on every worker (it ships with the
    installed tokenizer package, not with the data).
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for b in batches:
            out, i = [], 0
            texts = b.column(1)
            while i < len(texts):
                some = texts.slice(i, 500).to_pylist()
                out += counter.count([x or "" for x in some])
                i += 500
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())],
                                             ["__id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    rows = rows.withColumn("__b", F.coalesce(F.octet_length("__t"), F.lit(0)).cast("long"))
    out = rows.mapInArrow(run, f"__id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
