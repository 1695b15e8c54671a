"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from matfold.llm import spelling


def brute(docs, min_count=5, ratio=5, damage=199):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}

    def edits(w):
        alphabet = {c for v in words for c in v}
        yield from (w[:i] + w[i + 1:] for i in range(len(w)))
        yield from (w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in alphabet for k in (0, 1) if i + k <= len(w))

    near = {w: {v for v in edits(w) if v in words and v != w} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def run(spark, docs, **args):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    out = spelling.spelling_variants(df, **args)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()), key=lambda r: r[0])


def test_planted_variants(spark):
    text = "Letters " * 130 + "letteers " * 26 + "lettrs " * 6 + "leters " * 5 + "lettarrs " * 5 + "letteerss " * 5 + "Straßen stra÷en Naïveté Études a-b " * 5
    docs = [(1, text), (2, None), (3, ""), (None, "letters " * 5), (4, "aaaaaa " * 30 + "aaaaaaa " * 5 + "x" * 3000 + " "), *[(k, "y" * 300 + " " + "y" * 301) for k in range(10, 16)], (1, text)]
    got = run(spark, docs, damage=0)
    assert got == brute(docs, damage=0)
    assert dict((r[0], r[2]) for r in got)["leters"] == "letters" and any(r[2] != r[1] and r[1] for r in got)
    assert run(spark, docs) == brute(docs)


def test_random_words_of_few_letters(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 8))) for _ in range(300)]
    docs = [(k, " ".join(rnd.choice(words[:1 + int(300 * rnd.random() ** 3)]).upper() if rnd.random() < 0.1 else rnd.choice(words[:1 + int(300 * rnd.random() ** 3)])
                         for _ in range(rnd.randint(0, 60)))) for k in range(250)]
    assert run(spark, docs) == brute(docs)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, " ")]) == []
