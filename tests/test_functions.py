"""Scalar column functions: literal rows covering every branch and quirk."""

import math

import pytest
from pyspark.sql import functions as F

from matfold.functions import chem, parse, rules, score, text


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v"))).collect())]


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


CC50_CASES = [
    ("0.0022", 0.0022), ("12", 12.0), (">100", 100.0), ("<0.75", 0.75), ("1-10", 1.0),
    ("0.5–2.0", 0.5), ("12 (SD 3)", 12.0), ("1,200", 1200.0), ("2.7e-07", 2.7e-07),
    ("-5", 5.0), ("n.d.", None), (None, None), ("", None), ("  ", None), ("3—4", 3.0),
]


def test_parse_cc50(spark):
    got = apply(spark, parse.parse_cc50, [c for c, _ in CC50_CASES])
    for (raw, want), g in zip(CC50_CASES, got):
        assert close(g, want), (raw, g, want)


def test_parse_cc50_scientific_quirk_kept_on_request(spark):
    got = apply(spark, lambda c: parse.parse_cc50(c, fix_scientific=False), ["2.7e-07"])
    assert got == [2.7]


EXTRACT_CASES = [("12", 12.0), ("1,5", 1.5), ("1-3", 2.0), (">100", None), ("2.7e-07", 2.7e-07),
                 ("5 mM", 5.0), (None, None), ("", None), ("abc", None), ("1-x", 1.0)]


def test_extract_float(spark):
    got = apply(spark, parse.extract_float, [c for c, _ in EXTRACT_CASES])
    for (raw, want), g in zip(EXTRACT_CASES, got):
        assert close(g, want), (raw, g, want)


RATE_CASES = [("D (Poor)", None), ("0.05 max", 0.05), ("2 mils", 2 * 0.0254), ("3 inch", 3 * 0.0254),
              ('4"', 4 * 0.0254), ("0", 0.0), ("-1", -1.0), ("25 C", None), ("", None), (None, None),
              ("Ti-6Al", -6.0)]


def test_parse_rate(spark):
    got = apply(spark, parse.parse_rate, [c for c, _ in RATE_CASES])
    for (raw, want), g in zip(RATE_CASES, got):
        assert close(g, want), (raw, g, want)


def test_parse_rate_mils_unit(spark):
    assert close(apply(spark, lambda c: parse.parse_rate(c, unit="mils"), ["2"])[0], 0.0508)


def test_rating_and_row_score(spark):
    got = apply(spark, score.rating_score, ["A (Resistant)", "B", "c (questionable)", "D", "E", "F", "0.1", None])
    assert got == [1.0, 0.75, 0.5, 0.25, 0.125, 0.0, None, None]
    rs = apply(spark, score.rate_score, [0.0, 9.0, -3.0, None], dtype="double")
    assert close(rs[0], 1.0) and close(rs[1], 0.5) and close(rs[2], 1.0) and rs[3] is None


def test_clean_names(spark):
    vals = ["ASTM A36, hot rolled", " iso: 316L ", "isotropic steel", None, "Ti-6Al-4V (grade 5)", "a\tb\nc"]
    assert apply(spark, text.make_clean_name, vals) == [
        "A36 HOT ROLLED", "316L", "TROPIC STEEL", "", "TI-6AL-4V (GRADE 5)", "A B C"]
    assert apply(spark, text.clean_name_basic, ["ASTM a.b", None]) == ["ASTM A B", ""]
    assert apply(spark, text.normalize_name, ["Ti-6Al 4V", None]) == ["ti6al4v", None]
    assert apply(spark, text.upper_strip, ["  pe \n", None]) == ["PE", None]


def test_prefer_standard(spark):
    df = spark.createDataFrame([(" din ", "x"), (None, "JIS SM570"), ("", "ABSORB 1"), (None, "plain")],
                               "s string, m string")
    got = [r[0] for r in df.select(text.prefer_standard("s", "m")).collect()]
    assert got == ["DIN", "JIS", "BS", "UNKNOWN"]


@pytest.mark.parametrize("name,want", [
    ("MUNTZ METAL", "COPPER_ALLOY"), ("C28000", "COPPER_ALLOY"), ("NODULAR CAST IRON", "NODULAR_CAST_IRON"),
    ("GG-20", "GRAY_CAST_IRON"), ("GGG-50", "NODULAR_CAST_IRON"), ("9SMN28", "FREE_CUTTING_STEEL"),
    ("CK45", "CARBON_STEEL"), ("34CR4", "ALLOY_STEEL"), ("SUS304", "STAINLESS_STEEL"),
    ("SUH1", "HEAT_RESISTANT_STEEL"), ("S45C", "CARBON_STEEL"), ("SS400", "STEEL"),
    ("GRADE 360", "STEEL"), ("BRASS TUBE", "BRASS"), ("ALUMINIUM", "ALUMINUM"),
    ("TITANIUM", "TITANIUM"), ("CERAMIC", "CERAMIC"), ("HELLO", "UNKNOWN"), ("DIN", "STEEL"),
])
def test_material_type(spark, name, want):
    assert apply(spark, rules.material_type, [name]) == [want]


def test_toxicity_and_weights(spark):
    assert apply(spark, score.toxicity_score, ["0.1", "1", "10", "100", "101", ">5", None]) == \
        [0.1, 0.3, 0.6, 0.8, 0.95, 0.5, 0.5]
    assert apply(spark, score.cell_line_weight, ["HeLa S3", "rat liver", "cho", None]) == [1.0, 0.7, 0.5, 0.5]
    assert apply(spark, score.method_weight, ["MTT assay", "wst-8", "x", None]) == [1.0, 0.8, 0.6, 0.6]


def test_corrosion_compat_quirk_and_strict(spark):
    vals = ["A (Resistant)", "0.05 max", "C (Questionable)", "0.005", "2", None, "zzz"]
    assert apply(spark, score.corrosion_compat_score, vals) == [0.9, 0.9, 0.9, 0.9, 0.1, 0.5, 0.5]
    strict = apply(spark, lambda c: score.corrosion_compat_score(c, strict=True), vals)
    assert strict == [0.9, 0.5, 0.4, 0.9, 0.1, 0.5, 0.5]


def test_labels_and_bands(spark):
    assert apply(spark, score.label_from_cc50, [1.0, 10.0, 5.0, None], dtype="double") == [0, 1, -1, -1]
    assert apply(spark, score.flexibility_score, [36.9, 37.0, 60.0, 100.0, None], dtype="double") == \
        [0.9, 0.7, 0.4, 0.2, 0.2]
    assert apply(spark, score.rigidity_class, [-1.0, 0.0, 100.0, 100.5, None], dtype="double") == \
        ["Flexible", "Semi-rigid", "Semi-rigid", "Rigid", "Unknown"]


def test_formula_weight_and_structures(spark):
    got = apply(spark, chem.formula_weight, ["H2O", "CO2", "Xx2", "", None])
    assert close(got[0], 2 * 1.008 + 15.999) and close(got[1], 12.011 + 2 * 15.999)
    assert got[2:] == [None, None, None]
    probs = apply(spark, chem.structure_problem, ["CCO", "C1CC(C", "c1ccccc1", "C1CC", "", "C C"])
    assert probs == [None, "unbalanced parentheses", None, "unpaired ring closure", "blank", "illegal character"]
    probs = apply(spark, chem.structure_problem, [")(", "C]C[", "C%12CC%21", "C%12CC%12", "C%1", "[C@H2](C)C", "[nH]1cccc1", "C[]", "C1CC1(", "C%01CC1", "C0CC0", "C%10%11C%11%10"])
    assert probs == ["unbalanced parentheses", "unbalanced brackets", "unpaired ring closure", None, "unpaired ring closure", None, None,
                     "unbalanced brackets", "unbalanced parentheses", None, None, None]
    assert apply(spark, chem.first_component, ["CCO.[Na+];x", None]) == ["CCO", None]


def test_to_number_guards(spark):
    assert apply(spark, parse.to_number, ["1d", " 12 ", "nan", "inf", "1e3", "", None]) == \
        [None, 12.0, None, None, 1000.0, None, None]


def test_small_helpers(spark):
    from matfold.functions import units
    assert apply(spark, score.prob_label, [0.2, 0.5, 0.7], dtype="double") == [0, 0, 1]
    assert apply(spark, score.toxicity_verdict, [0.9, 0.1], dtype="double") == ["likely cytotoxic", "likely non-toxic"]
    assert apply(spark, score.modulus_band, [5.0, 69.9, 150.0, 250.0, None], dtype="double") == [
        "soft polymeric or elastomeric material", "light alloys or composites", "strong metallic alloy",
        "ceramic or high-stiffness material", None]
    assert close(apply(spark, score.inverse_log10, [2.0], dtype="double")[0], 100.0)
    assert apply(spark, text.level_norm, [" High ", "", None]) == ["high", "unknown", "unknown"]
    assert apply(spark, parse.strip_suffix_int, ["250 max", "12", "1.5", None]) == [250, 12, None, None]
    assert apply(spark, units.kelvin_to_celsius_if_high, [300.0, 373.15, None], dtype="double")[:2] == [300.0, 100.0]
    import hashlib
    assert apply(spark, text.surrogate_id, ["A36"])[0] == hashlib.md5(b"A36").hexdigest().upper()
