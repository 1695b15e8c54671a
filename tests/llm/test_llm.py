"""The training-data operators against brute force on small tables.

The tables hold nulls, empty and long texts, repeated rows, ties and extra
columns whose names clash with those the operators use themselves.
"""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from matfold.llm import decontam, graph, html_extract, license_scan, line_dedup, mixing, quality, setsketch, substring_dedup, token_counts, topk
from matfold.llm.common import filed

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, id string, node long, key string"
P1 = " ".join(f"w{i}" for i in range(60))
P2 = " ".join(f"v{i}" for i in range(40))
L1, L2 = "the first shared line of some words", "another shared line that has words too"
TEXTS = [(1, P1), (2, P1), (3, f"start {P1} end"), (4, f"{P2}\n{L1}\n{L2}"), (5, f"x y z\n{L1}\n{L2}\nq r s"), (6, ""), (7, None),
         (8, "one two"), (9, "one  two"), (10, "ONE two"), (11, " ".join(["a b c"] * 4000)), (12, f"pre {P2} post"), (12, f"pre {P2} post"),
         (None, P1), (13, f"x y z\n{L1}\n{L2}\nq r s"), (14, "ü ß 漢字 😀 " + P1[:200]), (15, "\n\n \t\n"), (16, f"Licensed under CC BY-NC 4.0.\n\n{P2}")]
DOCS = [(d, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s3"][k % 4], -1, "x", -2, "k") for k, (d, t) in enumerate(TEXTS)]
ITEMS = [(1, " ".join(P2.split()[3:20])), (2, "one two"), (3, ""), (4, None), (5, "nowhere to be found at all in any of the texts here")]
BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def bag(rows):
    return sorted(map(repr, rows))


def test_token_counts(spark, docs, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs, path).collect()
    assert bag(map(tuple, got)) == bag((d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t in TEXTS)
    assert token_counts.token_counts(none, path).count() == 0
    odd = ["a" * 999, "ab" * 500, " " * 77, "\n" * 9, "the" * 99, "=-" * 50 + "=" * 33, "<s> x</s>", "▁ ▁a"]
    assert token_counts.PieceCounter(path).count(odd) == [len(sp.encode(t)) for t in odd]


def test_substring_dedup(docs, none):
    words = [(d, BLANK.findall(t or "")) for d, t in TEXTS]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i:i + 13])] = min(d, first.get(tuple(w[i:i + 13]), d))
    want = []
    for d, w in words:
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.substring_dedup(docs)
    assert bag((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == bag(want)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_contamination(spark, docs, none):
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    wins = defaultdict(set)
    for i, t in ITEMS:
        w = ALNUM.findall(lower(t))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            wins[tuple(w[k:k + m])].add(str(i))
    want = []
    for d, t in TEXTS:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found |= wins[tuple(w[k:k + m])]
        want.append((d, len(w), len(hit), sorted(found), bool(hit)))
    got = decontam.contamination(docs, items)
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()) == bag(want)
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    cut = decontam.remove_contamination(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    assert {r.text for r in cut.where("doc_id = 8").collect()} == {""}
    assert {r.text for r in cut.where("doc_id = 1").collect()} == {P1}


def test_near_duplicates(spark, docs, none):
    def shingles(t):
        w = BLANK.findall(lower(t))
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [shingles(t) for _, t in TEXTS]
    root = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(lambda: None)
    for (d, _), r in zip(TEXTS, root, strict=True):
        least[r] = d if least[r] is None else least[r] if d is None else min(d, least[r])
    want = [(d, len(s), least[r], d == least[r]) for (d, _), s, r in zip(TEXTS, sets, root, strict=True)]
    assert bag(map(tuple, setsketch.near_duplicates(docs).collect())) == bag(want)
    assert setsketch.near_duplicates(none).count() == 0
    kept = setsketch.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 6, 7, 8, None} and kept.where("doc_id = 2").count() == 0


def test_near_duplicates_writes_small_tables_in_few_files(spark, monkeypatch):
    """Each written file costs two processes on a local path, so they follow the rows, not the shuffle partitions."""
    kept = []

    def noted(df, **options):
        kept.append(common_saved(df, **options))
        return kept[-1]

    common_saved = setsketch.saved
    monkeypatch.setattr(setsketch, "saved", noted)
    monkeypatch.setattr(graph, "saved", noted)
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(60)) for _ in range(40)]
    docs = [(3 * k + c, t + " more" * c) for k, t in enumerate(texts) for c in range(3)]
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert bag((r.doc_id, r.component_id) for r in found) == bag((d, d - d % 3) for d, _ in docs)
    assert len(kept) > 5 and all(len(df.inputFiles()) <= 1 for df in kept)


def test_filed_has_partitions_by_rows_and_loses_none(spark):
    df = spark.range(1000).repartition(20)
    assert [filed(df, n, 100).rdd.getNumPartitions() for n in (0, 1, 100, 101, 1000, 5000)] == [1, 1, 1, 2, 10, 20]
    assert bag(r.id for r in filed(df, 250, 100).collect()) == bag(range(1000))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        n = int(2000 * (1 + j) / 2)
        shared = int(2 * n * j / (1 + j))
        a, b = both[:n], np.r_[both[:shared], both[n:2 * n - shared]]
        x, y = (setsketch.registers(s, np.array([0, len(s)]), 220) for s in (a, b))
        merged = setsketch.registers(np.r_[a, b], np.array([0, len(a) + len(b)]), 220)
        assert (np.maximum(x, y) == merged).all()
        ratio = setsketch.likelihood_ratio(x, y, np.array([float(n)]), np.array([float(n)]), 0.75)[0]
        assert (ratio > 16) == (j == 0.3)


def test_line_dedup(docs, none):
    assert line_dedup.align([1, 2, 3, 9, 4], [7, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert line_dedup.align([1, 1], [1, 1, 1]) == [(0, 0), (1, 1)]
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    got = defaultdict(set)
    for r in out.collect():
        got[r.doc_id].add(r.text)
    assert got[1] == {P1} and got[2] == {""} and got[None] == {P1} and got[7] == {None} and got[6] == {""}
    assert got[5] == {"x y z\nq r s"} and got[13] == {""} and got[12] == {f"pre {P2} post"} and got[16] == {"Licensed under CC BY-NC 4.0.\n"}
    report = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs, report=True).collect()}
    assert report[5] == (4, 2) and report[7] == (0, 0) and report[15] == (4, 0)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_repeated_and_moved_lines(spark):
    def brute(texts, least):
        lines = {d: t.split("\n") for d, t in texts}
        out = {}
        for d, b in lines.items():
            gone = set()
            for c, a in lines.items():
                for i in range(len(a)):
                    for j in range(len(b)):
                        k = 0
                        while c < d and i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                            k += 1
                        if sum(len(BLANK.findall(x)) for x in b[j:j + k]) >= least:
                            gone |= set(range(j, j + k))
            out[d] = "\n".join(x for j, x in enumerate(b) if j not in gone)
        return out
    head, foot = "the header that every page of it has", "and a footer line of the same kind"
    texts = [(1, f"{head}\nfirst\n{head}\n{foot}"), (2, f"{foot}\nsecond\n{head}\nsecond part\n{head}"), (3, f"{L2}\nx\n{L1}"), (4, f"{L1}\ny\n{L2}\nz\n{L2}"),
             (5, "a b"), (6, "c d e"), (7, "p\na b\nc d e\n\nq"), (8, "r\na b\nc d e\n\ns")]
    rng = np.random.default_rng(5)
    pool = [head, foot, "", " ", "one", "two words", "now three words", "four words in it", "k", "m"]
    texts += [(100 + i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 12)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute(texts, 5)
    assert got[2] == "second\nsecond part" and got[4] == "y\nz" and got[8] == "r\ns"


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and bag(map(tuple, rows)) == bag(map(tuple, mixing.mix(docs).collect()))
    size = defaultdict(int)
    for (_, t), d in zip(TEXTS, DOCS, strict=True):
        size[d[3]] += len(BLANK.findall(t or ""))
    targets = {r.source: r.target for r in rows}
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, float(sum(size.values()))
    for _ in range(200):
        level = (lo + hi) / 2
        if sum(min(3 * size[s], level * weight[s]) for s in size) < sum(size.values()):
            lo = level
        else:
            hi = level
    for s in size:
        assert targets[s] == pytest.approx(min(3 * size[s], hi * weight[s]))
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert all((r.position is None) == (r.copies == 0) and r.positions == sorted(r.positions) for r in rows)
    assert mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, "w " * int(n), f"s{i % 5}" if i % 7 else None) for i, n in enumerate(np.r_[rnd.integers(1, 60, 400), [2000, 900, 1500]])]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert plan == mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == r.copies
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3, (s, t, taken[s])  # sizes of 1 to 60 are there to fill with


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vec = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 10]) for i in range(300)]
    vec += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [0.0] * 4), (None, [1.0] * 4), (305, [float("inf")] * 4)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    fine = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in vec if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in [i for i in fine if i % 50 == 0]:
        best = sorted((-int(fine[q] @ fine[c]), c) for c in fine if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = topk.exact_top_k(df, df.where("vec_id % 50 = 0"))
    assert bag(map(tuple, got.collect())) == bag(want)
    assert topk.exact_top_k(df.limit(0), df).count() == 0 and topk.exact_top_k(df, df.limit(0)).count() == 0
    # the bound ends the walk early where the lists are steep
    steep = np.zeros((4096, 4), np.int64)
    steep[:, 0] = np.arange(4096) ** 2
    assert topk.threshold_top(steep, np.arange(4096), np.array([[1, 0, 0, 0]]), np.array([-1]), 5)[3] < 200


def test_license_scan(docs, none):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[16].license == "CC-BY-NC-4.0" and got[16].dice == 1.0 and got[16].matches[0].first_line == 0
    assert got[7].n_units == 0 and got[6].n_units == 0 and got[15].n_units == 0 and got[1].license is None
    known = license_scan.Templates(license_scan.default_templates(), 0.9)
    for name, text in license_scan.default_templates():
        words = ALNUM.findall(lower(text))
        own = {tuple(words[i:i + 2]) for i in range(len(words) - 1)}
        assert known.best(np.unique(_bigrams(text)))[1] == 1.0 and len(np.unique(_bigrams(text))) == len(own), name
    assert license_scan.license_scan(none).count() == 0


def test_license_scan_inside_documents(spark):
    templates = license_scan.default_templates()
    cut = {name: re.sub(r"(?<=[.:]) ", "\n\n", text) for name, text in license_scan.TEXTS.items()}
    texts = [(name, f"{P1}\n\n{text}\n\n{P2}") for name, text in cut.items()]
    texts += [("MIT", "Copyright 2020 Foo Inc. Released under the MIT License. See the file for details.")]
    texts += [(name, f"{P1} {text} {P2}") for name, text in license_scan.BODIES + license_scan.HEADERS]
    noted = " ".join(x if k % 18 else f"{x}\n\nnote{k}" for k, x in enumerate(license_scan.TEXTS["MIT"].split()))
    texts += [("MIT", noted), (None, P1)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    sets = [(n, {tuple(w[i:i + 2]) for i in range(len(w) - 1)}, len(w)) for n, w in ((n, ALNUM.findall(lower(t))) for n, t in templates)]
    for r in license_scan.license_scan(df).collect():
        name, text = texts[r.doc_id]
        assert r.license == name and (name is None or r.dice > 0.9), (r.doc_id, name, r.license, r.dice)
        words = ALNUM.findall(lower(text))
        best = 0.0
        for _, own, size in sets:
            for i in range(len(words) - size + 1):
                win = {tuple(words[j:j + 2]) for j in range(i, i + size - 1)}
                best = max(best, 2 * len(win & own) / (len(win) + len(own)))
        assert (r.dice or 0.0) >= (best if best >= 0.9 else 0.0) - 1e-12


def _bigrams(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    return license_scan.bigrams(buf, np.array([0, len(buf)]))[0]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(d, 1, 0 if d != 4 else 1) for d in (1, 2, 3, 4, 5, 12, 13)] + [(8, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(TEXTS)
    by = {r.doc_id: r for r in out}
    assert by[7].perplexity is None and by[7].keep and by[6].perplexity is None
    assert by[14].perplexity > by[2].perplexity
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(TEXTS)
    # the probabilities of the next character add up to one
    counts = spark.createDataFrame([(int(k), 3 + i) for i, k in enumerate(np.unique(quality.char_grams(np.frombuffer(P1.encode(), np.uint8), np.array([0, len(P1)]))[0]).view(np.int64))], "key long, c long")
    parts, vocabulary = quality._levels(counts)
    model = parts[0]
    for p in parts[1:]:
        model = model.union(p)
    table = model.groupBy("key").agg({"alpha": "max", "lam": "max"}).toDF("key", *["x", "y"]).toPandas()
    alpha, lam = ("x", "y") if "alpha" in model.groupBy("key").agg({"alpha": "max", "lam": "max"}).columns[1] else ("y", "x")
    keys = table.key.to_numpy().view(np.uint64)
    order = np.argsort(keys)
    a, m = np.nan_to_num(table[alpha].to_numpy(float))[order], table[lam].to_numpy(float)[order]
    context = np.uint64((ord("w") << 48) | (ord("1") << 32) | (ord("0") << 16))
    letters = sorted(set(P1))
    p = np.exp(quality.log_probability(np.array([context | np.uint64(ord(c)) for c in letters]), keys[order], a, np.where(np.isnan(m), 1, m), vocabulary))
    assert 0.9 < p.sum() <= 1.0 + 1e-9


def test_quality_of_thin_languages(spark):
    rng = np.random.default_rng(6)
    size = {"l0": 3000, **{f"l{i}": 1 + i % 3 for i in range(1, 61)}}
    level = {k: 1 + rng.random() for k in size}
    known = spark.createDataFrame([(k, float(x)) for k, n in size.items() for x in level[k] + 0.1 * rng.normal(size=n)], "key string, rate double")
    edge = {r.key: r.edge for r in quality.edges(known, 0.998).collect()}
    lost = np.mean([(level[k] + 0.1 * rng.normal(size=100) > edge[k]).mean() for k in size])
    assert lost < 0.02 and all(edge[k] < level[k] + 1 for k in size)
    assert abs(edge["l0"] - level["l0"] - 0.288) < 0.05
    assert quality.edges(known.where("key = 'l1'").limit(1), 0.998).first().edge is None
    words = [f"word{i}" for i in range(50)]
    text = lambda: " ".join(words[k] for k in rng.integers(0, 50, 30))
    rows = [(i, text(), "en") for i in range(200)] + [(1000 + i, "".join(chr(0x4E00 + k) for k in rng.integers(0, 900, 60)), "zz" if i % 2 else None) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(rows + [(999, "@#~ " * 30, "en")], "doc_id long, text string, lang string"), labels).collect()
    assert all(r.keep for r in out if r.lang != "en") and [r.keep for r in out if r.doc_id == 999] == [False]


PAGE = ("<html><head><title>t</title><script>var x='</p>';</script></head><body><header class=top><a href=/>Home</a></header><nav><ul><li><a href=/a>menu</a></li></ul></nav>"
        "<div class=\"ad\">Buy this now.</div><article><h1>Title  of&nbsp;it</h1><p><b>First &amp; {0}<br>second.<p>Para {0}</p></article><div class='comments'><p>nice post</p></div><footer>&copy; us</footer>")


def test_html_extraction(spark):
    text = "some longer sentence of the story, which goes on. And on it goes for a while."
    rows = [(i, f"u{i}", PAGE.format(f"{i} " + text * (1 + i % 4)), "x") for i in range(40)] + [(90, None, None, "x"), (91, "u", "", "x"), (92, "u", "no markup <at all", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i in range(40):
        t = f"{i} " + text * (1 + i % 4)
        assert got[i].text == f"Title of it First & {t} second. Para {t}" and got[i].n_chars == len(got[i].text)
    assert got[90].text == "" and got[91].text == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_extraction_of_open_heads_and_forms(spark):
    text = "some longer sentence of the story, which goes on. And on it goes for a while."
    asked = '<form action="/s"><label>Search the site</label><input name="q"><button>Go</button></form>'
    pages = []
    for i in range(60):
        page = PAGE.format(f"{i} " + text * (1 + i % 4))
        pages.append([page, page.replace("</head>", ""), page.replace("</head><body>", ""), page.replace("<body>", '<body><form method="post"><input type="hidden">').replace("</footer>", "</footer></form>"),
                      page.replace("<article>", '<form action="#"><article>'), page.replace("<article>", asked + "<article>"), page.replace("</article>", asked + "</article>")][i % 7])
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        t = f"{r.page_id} " + text * (1 + r.page_id % 4)
        assert r.text == f"Title of it First & {t} second. Para {t}", (r.page_id % 7, r.text)
    d = html_extract.parse("<html><head><title>t</title>text <b>of</b> the body<p>more")
    assert [t for _, t in d.blocks] == ["text of the body", "more"]


def test_html_training_sample_is_of_distinct_pages(spark, monkeypatch):
    page = PAGE.format("some longer sentence of the story, which goes on. ")
    rows = [(i, "u", page if i % 2 else page.replace("Home", f"Home {i % 5}")) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    trained = []
    monkeypatch.setattr(html_extract, "saved", lambda nodes: trained.append(nodes.count()) or nodes)
    html_extract.train(df, "page_id", "html", 4, 2, 2)
    html_extract.train(df.dropDuplicates(["html"]), "page_id", "html", 4, 2, 2)
    html_extract.train(df.where("page_id = 1"), "page_id", "html", 4, 2, 2)
    assert trained[0] == trained[1] and 3 * trained[2] < trained[0] < 5 * trained[2]
    with pytest.warns(UserWarning, match="no model"):
        html_extract.train(spark.createDataFrame([(1, "u", "only text")], "page_id long, url string, html string"), "page_id", "html", 4, 2, 2)


def test_decoding_has_no_contradictions():
    d = html_extract.parse(PAGE.format("x"))
    keep = html_extract.decode(d, np.random.default_rng(3).normal(size=len(d.tag)))
    assert all(keep[p] for p, k in zip(d.parent[1:], keep[1:], strict=True) if k)


def test_trees_are_read_as_fitted(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(r.tolist(), float(r[0] * r[1] > 0.1)) for r in x], "a array<double>, label double").select("a", array_to_vector("a").alias("features"), "label")
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    want = [r.p[1] for r in model.transform(df).select("a", vector_to_array("probability").alias("p")).collect()]
    own = html_extract.Trees(html_extract.read_trees(model.toDebugString)).log_odds(np.array([r.a for r in df.collect()]))
    assert np.allclose(want, 1 / (1 + np.exp(-own)))


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0.6 * docs.count() <= out.count() <= docs.count()


def test_substring_dedup_without_duplicates(spark):
    clean = " ".join(f"w{k}" for k in range(40))
    for docs, removed in (([(1, clean), (2, " ".join(f"v{k}" for k in range(40)))], [0, 0]),  # no shared anchor at all
                          ([(1, clean), (2, clean)], [0, 40]), ([(1, "short")], [0])):  # one pack
        out = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
        assert [r.n_removed for r in out] == removed
    # several shards, one of them with nothing to tell
    shards, substring_dedup.SHARD_WORDS = substring_dedup.SHARD_WORDS, 20
    try:
        out = substring_dedup.substring_dedup(spark.createDataFrame([(1, clean), (2, clean), (3, "a b")], "doc_id long, text string").repartition(3))
        assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(1, 0), (2, 40), (3, 0)]
    finally:
        substring_dedup.SHARD_WORDS = shards


def test_html_parser_is_linear_on_broken_pages():
    import time
    for page in ("<div " * 200_000, "<div a='x' " * 90_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><b>" * 80_000 + "<hr>" * 40_000,
                 "<title>" + "</title " * 100_000, "<a '" * 200_001 + ">", "<div>" * 150_000):
        start = time.perf_counter()
        html_extract.parse(page)
        assert time.perf_counter() - start < 20, page[:12]
    d = html_extract.parse("<p>a <b>b <div>c</b> d</div> e <x 'f' >g")
    assert [t for _, t in d.blocks] == ["a b", "c d", "e", "g"]
    assert [t for _, t in html_extract.parse("<title>x <!-- y</title><p>z <br>1 < 2").blocks] == ["z 1 < 2"]
