"""Scores, bands and labels (Column -> Column)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of
from matfold.functions.parse import NUMERIC_RE, parse_rate
from matfold.functions.text import py_strip

# --- fixed values ---------------------------------------------------------
# Letter rating -> points (higher is better); score = points / 4.
LETTER_POINTS = {"A": 4.0, "B": 3.0, "C": 2.0, "D": 1.0, "E": 0.5, "F": 0.0}
# Label thresholds in mM: <= toxic is 0, >= biocompatible is 1, else -1.
TOXIC_MM = 1.0
BIOCOMPATIBLE_MM = 10.0
# Concentration bands (upper bound inclusive, score) for toxicity.
TOXICITY_BANDS = [(0.1, 0.1), (1.0, 0.3), (10.0, 0.6), (100.0, 0.8)]
TOXICITY_ABOVE = 0.95
TOXICITY_UNKNOWN = 0.5
# Human-relevance of cell lines (substring tests on upper-cased text).
HUMAN_CELL_LINES = ["HEK293", "HELA", "HEPG2", "MCF-7"]
ANIMAL_WORDS = ["MOUSE", "RAT"]
CELL_WEIGHTS = (1.0, 0.7, 0.5)  # human, animal, other (also null)
# Method reliability (substring tests on upper-cased text).
HIGH_RELIABILITY = ["MTT", "MTS", "ALAMARBLUE", "PRESTOBLUE", "CELLTITER-GLO"]
MEDIUM_RELIABILITY = ["LDH", "NRU", "SRB", "WST-1", "WST-8"]
METHOD_WEIGHTS = (1.0, 0.8, 0.6)  # high, medium, other (also null)
# Composite cytotoxicity weights: toxicity, cell line, method.
COMPOSITE_WEIGHTS = (0.6, 0.3, 0.1)
# Corrosion compatibility: word groups checked in order, then rate bands.
CORROSION_WORDS = [(["A", "RESISTANT"], 0.9), (["B", "GOOD"], 0.7),
                   (["C", "QUESTIONABLE"], 0.4), (["D", "POOR"], 0.1)]
CORROSION_RATE_BANDS = [(0.01, 0.9), (0.1, 0.7), (0.5, 0.5), (1.0, 0.3)]
CORROSION_RATE_ABOVE = 0.1
CORROSION_UNKNOWN = 0.5
# Environments of biological relevance (case-insensitive substrings).
BIO_ENVIRONMENTS = ["saline", "phosphate", "blood", "serum", "water", "NaCl",
                    "ringer", "lactate", "physiological"]
# Flexibility by glass transition (deg C): (upper bound exclusive, score).
FLEXIBILITY_BANDS = [(37.0, 0.9), (60.0, 0.7), (100.0, 0.4)]
FLEXIBILITY_ABOVE = 0.2
# Rigidity class by Tg (deg C).
RIGIDITY = ("Flexible", "Semi-rigid", "Rigid", "Unknown")
# Young's modulus bands (GPa): (upper bound exclusive, text).
MODULUS_BANDS = [(10.0, "soft polymeric or elastomeric material"),
                 (70.0, "light alloys or composites"),
                 (200.0, "strong metallic alloy")]
MODULUS_ABOVE = "ceramic or high-stiffness material"
# Verdict of the toxicity classifier.
VERDICTS = ("likely cytotoxic", "likely non-toxic")
# --------------------------------------------------------------------------


def _any_contains(text: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | (F.instr(text, w) > 0)
    return cond


def rating_letter(c: ColumnLike) -> Column:
    """The first lone letter A-F of the upper-cased text, or null."""
    return F.nullif(F.regexp_extract(F.upper(col_of(c)), r"\b([A-F])\b", 1), F.lit(""))


def rating_score(*columns: ColumnLike) -> Column:
    """Letter rating -> 0..1 (A=1, B=.75, C=.5, D=.25, E=.125, F=0), of the first column that has a letter."""
    # one lookup in a literal map; a CASE would search the text again in every branch
    points = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v / 4.0)) for k, v in LETTER_POINTS.items()))
    return F.try_element_at(points, F.coalesce(*[rating_letter(c) for c in columns]))


def rate_score(rate_mm: ColumnLike) -> Column:
    """mm/yr -> 0..1: 1/(1+log10(max(r,0)+1)); null stays null.

    The explicit null guard matters: greatest(null, 0) is 0, which would
    score an unknown rate as perfect.
    """
    r = col_of(rate_mm)
    return F.when(r.isNotNull(), 1.0 / (1.0 + F.log10(F.greatest(r, F.lit(0.0)) + 1.0)))


def corrosion_row_score(rate_mm_text: ColumnLike, rate_mils_text: ColumnLike,
                        mils_unit: str = "text") -> Column:
    """Score of one record: numeric rate if any column has one, else rating."""
    rate = F.coalesce(parse_rate(rate_mm_text), parse_rate(rate_mils_text, unit=mils_unit))
    return F.coalesce(rate_score(rate), rating_score(rate_mm_text, rate_mils_text))


def toxicity_score(c: ColumnLike) -> Column:
    """Concentration value -> banded toxicity score; unparseable -> 0.5."""
    s = py_strip(col_of(c).cast("string"))
    x = F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))
    out = None
    for hi, score in TOXICITY_BANDS:
        out = (F.when(x <= hi, F.lit(score)) if out is None else out.when(x <= hi, F.lit(score)))
    return F.when(x.isNull(), F.lit(TOXICITY_UNKNOWN)).otherwise(out.otherwise(F.lit(TOXICITY_ABOVE)))


def cell_line_weight(c: ColumnLike) -> Column:
    up = F.upper(col_of(c))
    human, animal, other = CELL_WEIGHTS
    return (F.when(up.isNull(), F.lit(other))
            .when(_any_contains(up, HUMAN_CELL_LINES), F.lit(human))
            .when(_any_contains(up, ANIMAL_WORDS), F.lit(animal))
            .otherwise(F.lit(other)))


def method_weight(c: ColumnLike) -> Column:
    up = F.upper(col_of(c))
    high, med, other = METHOD_WEIGHTS
    return (F.when(up.isNull(), F.lit(other))
            .when(_any_contains(up, HIGH_RELIABILITY), F.lit(high))
            .when(_any_contains(up, MEDIUM_RELIABILITY), F.lit(med))
            .otherwise(F.lit(other)))


def composite_score(tox: ColumnLike, cell: ColumnLike, method: ColumnLike) -> Column:
    a, b, c = COMPOSITE_WEIGHTS
    return col_of(tox) * a + col_of(cell) * b + col_of(method) * c


def label_from_cc50(c: ColumnLike) -> Column:
    """<= 1 mM -> 0 (toxic), >= 10 mM -> 1 (biocompatible), else/null -> -1."""
    x = col_of(c)
    return (F.when(x <= TOXIC_MM, F.lit(0))
            .when(x >= BIOCOMPATIBLE_MM, F.lit(1))
            .otherwise(F.lit(-1)))


def is_bio_environment(c: ColumnLike) -> Column:
    """Case-insensitive match of any biological environment keyword."""
    return F.coalesce(col_of(c).rlike("(?i)" + "|".join(BIO_ENVIRONMENTS)), F.lit(False))


def corrosion_compat_score(c: ColumnLike, strict: bool = False) -> Column:
    """Rating text or mm/yr rate -> compatibility 0..1; null -> 0.5.

    ``strict=False`` reproduces the substring test (any text holding the
    letter A scores 0.9, so '0.05 max' does); ``strict=True`` matches the
    letters and words as whole words only.
    """
    raw = col_of(c).cast("string")
    up = F.upper(raw)
    out = F.when(raw.isNull(), F.lit(CORROSION_UNKNOWN))
    for words, score in CORROSION_WORDS:
        if strict:
            cond = up.rlike(r"\b(" + "|".join(words) + r")\b")
        else:
            cond = _any_contains(up, words)
        out = out.when(cond, F.lit(score))
    s = py_strip(raw)
    rate = F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))
    banded = None
    for hi, score in CORROSION_RATE_BANDS:
        banded = (F.when(rate < hi, F.lit(score)) if banded is None
                  else banded.when(rate < hi, F.lit(score)))
    banded = banded.otherwise(F.lit(CORROSION_RATE_ABOVE))
    return out.when(rate.isNull(), F.lit(CORROSION_UNKNOWN)).otherwise(banded)


def flexibility_score(tg_c: ColumnLike) -> Column:
    """Tg bands 37/60/100 -> 0.9/0.7/0.4, else (null too) 0.2."""
    t = col_of(tg_c)
    out = None
    for hi, score in FLEXIBILITY_BANDS:
        out = F.when(t < hi, F.lit(score)) if out is None else out.when(t < hi, F.lit(score))
    return out.otherwise(F.lit(FLEXIBILITY_ABOVE))


def rigidity_class(tg_c: ColumnLike) -> Column:
    t = col_of(tg_c)
    flexible, semi, rigid, unknown = RIGIDITY
    return (F.when(t.isNull(), F.lit(unknown)).when(t < 0, F.lit(flexible))
            .when(t <= 100, F.lit(semi)).otherwise(F.lit(rigid)))


def log10_target(c: ColumnLike) -> Column:
    """log10 of a positive concentration; null for <= 0 (guarded)."""
    x = col_of(c)
    return F.when(x > 0, F.log10(x))


def toxic_flag(c: ColumnLike, threshold: float = TOXIC_MM) -> Column:
    x = col_of(c)
    return F.when(x.isNotNull(), (x < threshold).cast("int"))


def inverse_log10(c: ColumnLike) -> Column:
    return F.pow(F.lit(10.0), col_of(c))


def prob_label(p: ColumnLike, cut: float = 0.5) -> Column:
    return (col_of(p) > cut).cast("int")


def modulus_band(e_gpa: ColumnLike) -> Column:
    e = col_of(e_gpa)
    out = None
    for hi, text in MODULUS_BANDS:
        out = F.when(e < hi, F.lit(text)) if out is None else out.when(e < hi, F.lit(text))
    return F.when(e.isNotNull(), out.otherwise(F.lit(MODULUS_ABOVE)))


def toxicity_verdict(p: ColumnLike, cut: float = 0.5) -> Column:
    toxic, safe = VERDICTS
    return F.when(col_of(p) > cut, F.lit(toxic)).otherwise(F.lit(safe))
