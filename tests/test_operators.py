"""Operators on tiny frames: null keys, empty tables, ties, and brute-force
equivalence of the scale-oriented strategies."""

import itertools
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matfold.operators import agg, dedup, filters, fuzzy, joins, knn, prep, schema, setops
from matfold.plans import polymers


def test_keep_first_null_keys_and_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 9), (4, None, 1), (5, "b", 2)],
                               "k int, name string, v int")
    out = sorted(tuple(r) for r in dedup.keep_first(df, ["name"], ["k"]).collect())
    assert out == [(1, "a", 5), (3, None, 9), (5, "b", 2)]
    again = dedup.keep_first(dedup.keep_first(df, ["name"], ["k"]), ["name"], ["k"])
    assert again.count() == 3  # idempotent


def test_first_nonblank_and_conditional_min(spark):
    df = spark.createDataFrame([("x", 1, " ", 5.0, True), ("x", 2, "U2", None, True), ("x", 3, "U3", 1.0, False),
                                ("y", 1, None, 2.0, False), ("z", 1, "", None, False)],
                               "g string, o int, u string, v double, h boolean")
    got = {r[0]: (r[1], r[2]) for r in df.groupBy("g").agg(
        agg.first_nonblank("u", F.col("o")), agg.conditional_min("v", "h")).collect()}
    assert got == {"x": ("U2", 5.0), "y": ("", 2.0), "z": ("", None)}


def test_null_counts(spark):
    df = spark.createDataFrame([(None, 1), (None, None), ("a", 3)], "a string, b int")
    got = {r["column"]: r["missing"] for r in agg.null_counts(df).collect()}
    assert got == {"a": 2, "b": 1}


def _contains_bruteforce(texts, names):
    names = [n.strip().upper() for n in names if n and n.strip()]
    if not names:
        return [True] * len(texts)
    return [t is not None and any(n in t.upper() for n in names) for t in texts]


def test_contains_any(spark):
    texts = ["MCF-7 wt", "hela s3", None, "NATION_12 cells", "xyz", "Nation_1"]
    names = ["MCF-7", "HELA", "NATION_1", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    dim = spark.createDataFrame([(n,) for n in names], "n string")
    want = _contains_bruteforce(texts, names)
    out = joins.contains_any(df, "t", dim, "n")
    assert [r[1] for r in sorted(out.select("i", "is_match").collect())] == want
    empty = dim.where(F.lit(False))
    assert all(r[0] for r in joins.contains_any(df, "t", empty, "n").select("is_match").collect())


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _best(probes, cands, cutoff, metric):
    out = {}
    for p in set(probes):
        scored = []
        for c in set(cands):
            if metric == "ratio":
                s = SequenceMatcher(None, c, p).ratio()
            else:
                s = 1 - _lev(p, c) / max(len(p), len(c), 1)
            if s >= cutoff - 1e-12:
                scored.append((s, c))
        if scored:
            s, c = max(scored)
            out[p] = (c, s)
    return out


def test_fuzzy_matches_bruteforce(spark):
    rnd = random.Random(7)
    alpha = "abcde"
    base = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    cands = base + ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    probes = [s[:-1] + rnd.choice(alpha) if len(s) > 1 and rnd.random() < .5 else s for s in base] + ["", "zz"]
    cands = cands + [""]
    P = spark.createDataFrame([(p,) for p in probes], "p string")
    C = spark.createDataFrame([(c,) for c in cands], "c string")
    for metric, cutoff in (("levenshtein", 0.75), ("ratio", 0.75), ("ratio", 0.6), ("levenshtein", 0.6)):
        got = {r[0]: (r[1], r[2]) for r in fuzzy.fuzzy_best_match(P, "p", C, "c", cutoff, metric).collect()}
        want = _best([p for p in probes if p is not None], cands, cutoff, metric)
        if metric == "levenshtein":
            want.pop("", None)
            got.pop("", None)
        assert set(got) == set(want), (metric, cutoff, set(got) ^ set(want))
        for k in want:
            assert got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]), (metric, k)


def test_filters_spec(spark):
    df = spark.createDataFrame([("Steel A", 10.0, "x"), ("steel b", None, "y"), ("Brass", 30.0, None),
                                ("Iron", 5.0, "x")], "name string, val double, cat string")
    out, missing = filters.apply_filters(df, {"free_text": "STEEL", "val": {"min": "1", "max": 20},
                                              "cat": {"values": ["x", "y"]}, "nope": 1})
    assert missing == ["nope"] and [r[0] for r in out.collect()] == ["Steel A"]
    keep, _ = filters.apply_filters(df, {"val": {"min": 1}}, keep_missing=True)
    assert keep.count() == 4
    assert filters.apply_filters(df, {"free_text": ""})[0].count() == 4
    nums = spark.createDataFrame([(1.0,)], "v double")
    assert filters.apply_filters(nums, {"free_text": "x"})[0].count() == 0
    assert filters.apply_filters(df, {"cat": {"values": []}})[0].count() == 4


def test_polymer_unified_matches_literal_outer_merge(spark):
    named = pd.DataFrame({"ord": [1, 2, 3, 4, 5], "name": ["pa", None, "pa", "pb", None],
                          "SMILES": ["C", "CC", "CCC", None, "O"], "Tg": ["350", "20", "10", None, None],
                          "Density": ["1.0", None, "1.2", "0.9", "1.1"]})
    classes = pd.DataFrame({"ord": [1, 2, 3, 4], "Polymer_Class": ["k1", "k2", "k3", "k4"],
                            "Tg": ["350", "350", "500", None]})
    got = polymers.polymer_unified(spark.createDataFrame(named), spark.createDataFrame(classes))
    got = {r["Polymer"]: (r["Polymer_Class"], r["SMILES"], None if r["Tg_C"] is None else round(r["Tg_C"], 6))
           for r in got.collect()}
    # literal pandas semantics: outer merge on Tg (null matches null, sorted), keep first per name
    b = named.assign(Tg_C=pd.to_numeric(named.Tg)).rename(columns={"name": "Polymer"})
    a = classes.assign(Tg_C=pd.to_numeric(classes.Tg))
    for f in (a, b):
        f.loc[f.Tg_C > 300, "Tg_C"] -= 273.15
    m = pd.merge(b[["Polymer", "SMILES", "Tg_C"]], a[["Polymer_Class", "Tg_C"]], on="Tg_C", how="outer")
    m["Polymer"] = m["Polymer"].fillna("Unknown Polymer")
    m = m.drop_duplicates(subset=["Polymer"])
    want = {r.Polymer: (None if pd.isna(r.Polymer_Class) else r.Polymer_Class,
                        None if pd.isna(r.SMILES) else r.SMILES,
                        None if pd.isna(r.Tg_C) else round(r.Tg_C, 6)) for r in m.itertuples()}
    assert got == want


def test_stratified_split_exact_counts(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1000)] + [(5000, "c")],
                               "k long, c string")
    out = prep.stratified_split(df, "k", "c", 0.8, buckets_bits=4)
    counts = {(r[0], r[1]): r[2] for r in out.groupBy("c", "split").count().collect()}
    assert counts[("a", "train")] == math.floor(666 * 0.8)
    assert counts[("b", "train")] == math.floor(334 * 0.8)
    assert ("c", "train") not in counts
    assert out.count() == 1001


def test_codes_and_auc(spark):
    df = spark.createDataFrame([(3, "z"), (1, "y"), (2, "z"), (4, None), (5, "a")], "o int, v string")
    got = {r[0]: r[2] for r in prep.first_appearance_codes(df, "v", "o").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: -1, 5: 2}
    coded, labels = prep.alphabetical_codes(df, "v")
    assert sorted(map(tuple, labels.collect())) == [("a", 0), ("y", 1), ("z", 2)]
    assert {r[0]: r[2] for r in coded.collect()} == {3: 2, 1: 1, 2: 2, 4: -1, 5: 0}
    assert {r["o"]: r["back"] for r in prep.decode_labels(coded, "code", labels, "back").collect()} == {3: "z", 1: "y", 2: "z", 4: None, 5: "a"}
    assert {r[0]: r[2] for r in prep.encode_labels(spark.createDataFrame([(1, "new"), (2, "y")], "o int, v string"), "v", labels).collect()} == {1: -1, 2: 1}
    ys = [1, 0, 1, 1, 0, 0, 1, 0]
    ss = [0.9, 0.1, 0.5, 0.5, 0.5, 0.2, 0.8, 0.9]
    sdf = spark.createDataFrame(list(zip(ys, ss)), "y int, s double")
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(prep.auc(sdf, "y", "s").first()["auc"], want)


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 5))
    y = rng.integers(0, 3, 60).astype(float)
    train = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(40)], "id long, v array<double>, y double")
    test = spark.createDataFrame([(i, X[i].tolist()) for i in range(40, 60)], "id long, v array<double>")
    for chunk in (1000, 7):
        got = {r[0]: r[1] for r in knn.knn_regress(train, test, "id", "v", "y", k=3, block_rows=chunk).collect()}
        for i in range(40, 60):
            d = ((X[:40] - X[i]) ** 2).sum(axis=1)
            nn = sorted(range(40), key=lambda j: (d[j], j))[:3]
            assert math.isclose(got[i], y[nn].mean()), (chunk, i)


def test_schema_operators(spark):
    df = spark.createDataFrame([(1.0, None, "x", "1", None), (3.0, 5.0, "y", "z", None)],
                               "`a` double, `a.1` double, s string, m string, n string")
    merged = schema.merge_duplicate_numeric(df)
    assert merged.columns == ["a", "s", "m", "n"]
    assert [r[0] for r in merged.collect()] == [1.0, 4.0]
    coerced = schema.auto_coerce(merged)
    assert dict(coerced.dtypes)["m"] == "double" and dict(coerced.dtypes)["s"] == "string"
    assert "n" not in schema.drop_all_null_columns(df).columns
    weird = spark.createDataFrame([(1,)], "` x\ny  z %` int")
    assert schema.sql_safe_columns(schema.normalize_columns(weird)).columns == ["x_y_z_pct"]
    assert schema.resolve_alias(["Name ", "CC50 (mM)"], ["CC50"], r"CC50|IC50") == "CC50 (mM)"


def test_setops(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, b double")
    s = setops.stack([a, b])
    assert s.columns == ["k", "a", "b"] and s.count() == 3
    assert setops.union_distinct([a, a]).count() == 1
    assert setops.except_by_key(b, a, ["k"]).count() == 0


def test_symbol_rename_and_argmax(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)],
                               "`Iron (Fe)` double, `Tensile Strength: Ultimate (UTS) (psi)` double, "
                               "`Liquidus Temp` double, ` Other ` double")
    assert schema.rename_by_symbol(df).columns == ["Fe", "UTS", "Liquidus", "Other"]
    p = spark.createDataFrame([([0.1, 0.7, 0.2],), ([0.5, 0.2, 0.3],)], "p array<double>")
    idx, best = dedup.argmax_class("p")
    assert [tuple(r) for r in p.select(idx, best).collect()] == [(1, 0.7), (0, 0.5)]
    renamed = schema.rename_present(df, {"Iron (Fe)": "Fe", "missing": "x"})
    assert renamed.columns[0] == "Fe"
    added = schema.add_missing_columns(renamed, ["Fe", "Cr"], "double")
    assert added.columns[-1] == "Cr" and added.first()["Cr"] is None


def test_training_join_fuzzy_modes(spark):
    from matfold.plans.joins import unified_training
    chem = spark.createDataFrame([("Alpha Salt", 1.0), ("Betaine X", 2.0), ("zzz", 3.0)], "Name string, v double")
    bio = spark.createDataFrame([("ALPHA SALT", 0), ("BETAINE Y", 1)], "Clean_Name string, label int")
    corr = spark.createDataFrame([("ALPHA SALT", 0.9)], "Clean_Name string, corr_score_mean double")
    exact = unified_training(chem, bio, corr)
    assert sorted(r["Name"] for r in exact.collect()) == ["Alpha Salt"]
    more = unified_training(chem, bio, corr, fuzzy="unmatched")
    got = sorted((r["Name"], r["Clean_Name"]) for r in more.collect())
    assert got == [("Alpha Salt", "ALPHA SALT"), ("Betaine X", "BETAINE Y")]
    none_exact = chem.where(F.col("Name") != "Alpha Salt")
    only = unified_training(none_exact, bio.where(F.col("label") == 1), corr, fuzzy="only_if_empty")
    assert [r["Name"] for r in only.collect()] == ["Betaine X"]


def test_hot_key_results_stay_whole(spark):
    """One key holding a third of the rows: results are complete and exact."""
    n = 3000
    rows = [(i, "HOT" if i % 3 == 0 else f"k{i % 97}", float(i % 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "o long, k string, v double")
    firsts = {r["k"]: r["o"] for r in dedup.keep_first(df, ["k"], ["o"]).collect()}
    assert firsts["HOT"] == 0 and len(firsts) == 1 + len({i % 97 for i in range(n) if i % 3})
    stats = {r[0]: r[1] for r in df.groupBy("k").agg(F.count(F.lit(1))).collect()}
    assert stats["HOT"] == n // 3
    split = prep.stratified_split(df, "o", "k", 0.8, buckets_bits=8)
    hot = split.where(F.col("k") == "HOT").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in hot}["train"] == math.floor(1000 * 0.8)


def test_grouped_medians(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in (("a", 7), ("b", 10), (None, 4), ("c", 1), ("e", 2)):
        rows += [(k, float(v), float(w)) for v, w in zip(rng.integers(-3, 3, n), rng.normal(0, 1e-3, n))]
    rows += [("d", None, 2.5), ("f", -0.0, 1e308), ("f", 0.0, -1e308), ("f", 5e-324, 1.0)]
    rows += [("hot", float(i), float(1.0 + i * 2.0 ** -52)) for i in rng.permutation(3000)]  # equal but for the last bits
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    got = {r["k"]: (r["v"], r["w"]) for r in agg.grouped_medians(df, "k", ["v", "w"]).collect()}
    for k in {r[0] for r in rows}:
        for i in (1, 2):
            values = [r[i] for r in rows if r[0] == k and r[i] is not None]
            assert got[k][i - 1] == (float(np.median(values)) if values else None), (k, i)
    assert agg.grouped_medians(df.limit(0), "k", ["v", "w"]).count() == 0


def test_dense_codes_and_running_totals_over_many_partitions(spark):
    from matfold.operators import ordered
    n = 5000
    df = spark.createDataFrame([((i * 7919) % n, i % 5) for i in range(n)], "k long, w int").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(r["k"] == r["code"] for r in ordered.dense_codes(df, ["k"]).collect())
        got = {r["k"]: r["before"] for r in ordered.running_total(df, "k", "w", "before").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    total = 0
    for k, w in sorted((r["k"], r["w"]) for r in df.collect()):
        assert got[k] == total
        total += w
    assert ordered.dense_codes(df.limit(0), ["k"]).count() == 0


def test_stratified_split_is_the_first_by_hash_and_key(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(3000)] + [(9000, "one"), (9001, "two"), (9002, "two")]
    df = spark.createDataFrame(rows, "k long, c string")
    got = {r["k"]: r["split"] for r in prep.stratified_split(df, "k", "c", 0.8).collect()}
    import hashlib
    for c in {r[1] for r in rows}:
        mine = sorted((k for k, x in rows if x == c), key=lambda k: (int(hashlib.md5(f"{k}42".encode()).hexdigest()[:8], 16), k))
        assert [got[k] for k in mine] == ["train"] * math.floor(len(mine) * 0.8) + ["test"] * (len(mine) - math.floor(len(mine) * 0.8))


def test_header_strip_and_units(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Rate (mm/yr) ` int, `PROPERTY: UTS (MPa)` int, `Grain size (μm)` int")
    assert schema.strip_header(df).columns == ["Rate (mm/yr)", "PROPERTY: UTS (MPa)", "Grain size (μm)"]
    assert schema.strip_header(df, underscore=True).columns[0] == "Rate_(mm/yr)"
    assert schema.normalize_columns(df, strip_units=True).columns == ["Rate_(mm_yr)", "UTS", "Grain_size_um"]


def test_knn_keeps_the_order_of_ids_on_equal_distances(spark):
    train = spark.createDataFrame([(i, [1.0, 2.0], float(i)) for i in range(500)], "id long, v array<double>, y double")
    test = spark.createDataFrame([(1000, [0.0, 0.0])], "id long, v array<double>")
    for block in (4096, 64):
        assert [r[1] for r in knn.knn_regress(train, test, "id", "v", "y", k=7, block_rows=block).collect()] == [3.0]


def test_metrics_of_empty_and_incomplete_tables(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, None)], "y double, p double")
    from matfold.operators import prep
    assert prep.regression_metrics(df, "y", "p").first()["n"] == 2
    assert prep.regression_metrics(df.limit(0), "y", "p").first()["n"] == 0


def test_domain_specs_and_levels(spark):
    from matfold.plans.search import domain_search, domain_spec
    assert domain_spec("polymers", density_min=1, density_max="2", name="", tg_min=None) == {"Density": {"min": 1, "max": "2"}}
    assert domain_spec("high_entropy", free_text="Ti", HV_min=3) == {"free_text": "Ti", "HV": {"min": 3}}
    with pytest.raises(ValueError):
        domain_spec("corrosion", colour="red")
    df = spark.createDataFrame([(1, " Low"), (2, ""), (3, None), (4, "HIGH")], "i int, Cytotoxicity_Level string")
    found = lambda *levels: sorted(r[0] for r in domain_search(df, "cytotoxicity", level=list(levels))[0].collect())
    assert found("low") == [1] and found("unknown") == [2, 3] and found("high", "low") == [1, 4]
    assert domain_search(df, "cytotoxicity", cas="1-2-3")[1] == ["CAS"]
    assert domain_search(df.limit(0), "cytotoxicity", level="low")[0].count() == 0


def test_value_lists_on_numbers_match_their_text(spark):
    from matfold.operators.filters import apply_filters
    df = spark.createDataFrame([(1,), (7,), (None,), (-3,)], "v int")
    got = lambda vals: sorted(r[0] for r in apply_filters(df, {"v": {"values": vals}})[0].collect())
    assert got(["7", 1]) == [1, 7] and got(["-3", "x"]) == [-3] and got(["07", "7.0"]) == []


def test_strip_takes_unicode_blanks(spark):
    from matfold.functions.text import py_strip
    texts = ["\u00a0a b\u00a0", "\u3000x\u2009", "\x1c\x85y ", "\u200bz", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", py_strip("t")).collect())]
    assert got == [t if t is None else t.strip() for t in texts]


def test_difflib_blocking_loses_no_pair(spark):
    """Brute force over short keys with repeats, for cutoffs with and without a bigram bound."""
    import random
    from difflib import SequenceMatcher
    rnd = random.Random(6)
    keys = lambda n: ["".join(rnd.choice("aabc1") for _ in range(rnd.randint(0, 8))) for _ in range(n)]
    probes, cands = keys(120) + ["aaaaaaaa", "abcabcabcabc"], keys(120) + ["aaaaaaa", "abcabcabxabc"]
    P, C = (spark.createDataFrame([(k,) for k in side], "key string").distinct() for side in (probes, cands))
    for cutoff in (0.6, 0.75, 0.8, 0.95):
        got = {tuple(r) for r in fuzzy.candidate_pairs(P, C, "ratio", cutoff).collect()}
        want = {(p, c) for p in set(probes) for c in set(cands) if p and c and SequenceMatcher(None, c, p).ratio() >= cutoff - 1e-12}
        assert want <= got, (cutoff, sorted(want - got)[:5])
        best = {r[0]: (r[1], r[2]) for r in fuzzy.fuzzy_best_match(P, "key", C, "key", cutoff).collect()}
        score = lambda p, c: SequenceMatcher(None, c, p).ratio()
        for p in set(probes):
            top = max(((score(p, c), c) for c in set(cands)), default=(0, ""))
            assert best.get(p) == ((top[1], top[0]) if top[0] >= cutoff - 1e-12 else None)


def test_difflib_pairs_grow_slower_than_the_product(spark):
    import random
    pairs = []
    for n in (300, 1200):
        rnd = random.Random(n)
        probes = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(8, 16))) for _ in range(n)]
        cands = [k[:3] + rnd.choice("xyz") + k[4:] for k in probes]
        P, C = (spark.createDataFrame([(k,) for k in side], "key string").distinct() for side in (probes, cands))
        pairs.append(fuzzy.candidate_pairs(P, C, "ratio", 0.8).count())
    assert pairs[0] >= 300 and pairs[1] < 5 * pairs[0]  # the product grows 16 times


def test_knn_visits_few_cells_and_keeps_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (12, 3))
    rows = [(int(i), [float(x) for x in centres[i % 12] + rng.integers(0, 3, 3)], float(i)) for i in range(1200)]
    train = spark.createDataFrame(rows, "id long, v array<double>, y double").repartition(4)
    test = spark.createDataFrame([(10_000 + i, [float(x) for x in centres[i % 12] + rng.integers(0, 3, 3)]) for i in range(60)] + [(20_000, None)], "id long, v array<double>")
    visited = []
    search = knn._search
    monkeypatch.setattr(knn, "_search", lambda t, v, *a: (visited.append(v), search(t, v, *a))[1])
    got = {}
    for r in knn.knn_candidates(train, test, "id", "v", "y", k=5, block_rows=40, pivot_rows=50).collect():
        got.setdefault(r["test_id"], []).append((r["dist"], r["train_id"]))
    for q, v in ((r["id"], r["v"]) for r in test.collect() if r["v"]):
        want = sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), i) for i, x, _ in rows)[:5]
        assert sorted(got[q]) == want
    assert 20_000 not in got
    assert sum(v.count() for v in visited) < 60 * 24 / 3  # of 24 cells a query sees a few
    few = knn.knn_candidates(train.limit(2), test, "id", "v", "y", k=5, block_rows=40, pivot_rows=1)
    assert few.count() == 120 and knn.knn_candidates(train.limit(0), test, "id", "v", "y").count() == 0


def test_stats_and_first_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(str(k) if k else None, None if v > 8 else float(v) / 7, [None, " ", "U1", "U2", "U3"][u], int(a), int(b))
            for k, v, u, a, b in zip(rng.integers(0, 4, 400), rng.integers(0, 11, 400), rng.integers(0, 5, 400), rng.permutation(400) // 2, rng.permutation(400))]
    rows += [("lone", 0.5, None, 1, 1), ("none", None, "x", 10 ** 13, 9_999)]
    df = spark.createDataFrame(rows, "k string, v double, u string, a long, b long").repartition(5)
    order = agg.packed_order("a", "b", digits=(14, 10))
    got = {r["k"]: r for r in agg.stats_and_first(df, "k", "v", "s", "u", order).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        values = [r[1] for r in mine if r[1] is not None]
        named = sorted((r[3], r[4], r[2]) for r in mine if r[2] and r[2].strip())
        g = got[k]
        assert g["data_points"] == len(values) and g["u"] == (named[0][2] if named else "")
        assert g["s_min"] == (min(values) if values else None)
        assert math.isclose(g["s_var"], np.var(values, ddof=1) if len(values) > 1 else 0.0, abs_tol=1e-12)
        assert (g["s_mean"] is None) == (not values) and (not values or math.isclose(g["s_mean"], np.mean(values)))
    plan = agg.stats_and_first(df, "k", "v", "s", "u", order)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("HashAggregate")  # only the small second step sorts
    with pytest.raises(Exception, match="more than 2 digits"):
        df.select(agg.packed_order("a", "b", digits=(2, 10))).collect()


def test_keep_first_of_repeated_rows(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "a", "y"), (5, "b", None), (4, "b", None)], "o long, k string, v string")
    for repeats in (False, True):
        assert sorted(map(tuple, dedup.keep_first(df, ["k"], ["o"], repeats=repeats).collect())) == [(1, "a", "y"), (4, "b", None)]


def test_fuzzy_merge_joins_through_the_best_match(spark):
    left = spark.createDataFrame([("titanum", 1), ("steel", 2), (None, 3)], "n string, a int")
    right = spark.createDataFrame([("titanium", "x"), ("steel", "y"), ("steal", "z")], "m string, b string")
    got = sorted((r["n"], r["a"], r["b"]) for r in fuzzy.fuzzy_merge(left, right, "n", "m", 0.8).collect())
    assert got == [("steel", 2, "y"), ("titanum", 1, "x")]


def test_filters_on_computed_columns_keep_their_rows(spark):
    df = spark.createDataFrame([(i, f"{i} mm") for i in range(20)], "k int, t string").select("k", F.regexp_extract("t", r"\d+", 0).cast("int").alias("n"))
    out = filters.where_computed(df, (F.col("n") > 3) & (F.col("n") < 9))
    assert out.columns == ["k", "n"] and sorted(r["k"] for r in out.collect()) == [4, 5, 6, 7, 8]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
