"""Structure-string and formula helpers (Column -> Column).

No chemistry toolkit is used: structure strings are handled as text.
Formula weights are computed from the empirical formula with a fixed table
of standard atomic weights; validity checks are syntax rules only.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of
from matfold.functions.text import is_blank, py_strip

# --- fixed values ---------------------------------------------------------
# Standard atomic weights (g/mol) of the elements accepted in formulas.
ATOMIC_WEIGHTS = {
    "H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06,
    "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Ti": 47.867, "Cr": 51.996, "Mn": 54.938,
    "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Br": 79.904,
    "Mo": 95.95, "Ag": 107.87, "Sn": 118.71, "I": 126.90, "W": 183.84, "Au": 196.97,
}
# The twenty amino-acid letters used for sequence composition.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
# Characters allowed in a structure string.
STRUCTURE_CHARS = r"^[A-Za-z0-9@+\-\[\]\(\)=#$:/\\%.*]+$"
# --------------------------------------------------------------------------

FORMULA_TOKEN = r"([A-Z][a-z]?)(\d*)"


def formula_weight(c: ColumnLike) -> Column:
    """Molecular weight from an empirical formula such as 'C19H38BrNO3'.

    Null for a blank formula, an unknown element or leftover characters.
    """
    f = col_of(c)
    syms = F.regexp_extract_all(f, F.lit(FORMULA_TOKEN), 1)
    cnts = F.regexp_extract_all(f, F.lit(FORMULA_TOKEN), 2)
    weights = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ATOMIC_WEIGHTS.items()))
    terms = F.zip_with(syms, cnts, lambda s, n: F.try_element_at(weights, s) *
                       F.when(n == "", F.lit(1.0)).otherwise(n.cast("double")))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    covered = F.regexp_replace(f, FORMULA_TOKEN, "") == ""
    return F.when(~is_blank(f) & covered, total)


def first_component(c: ColumnLike) -> Column:
    """Part before the first ';', then before the first '.' (main component)."""
    s = py_strip(col_of(c))
    return F.substring_index(F.substring_index(s, ";", 1), ".", 1)


def clean_placeholders(c: ColumnLike, star: str = "") -> Column:
    """Replace '*' attachment points by ``star`` and drop empty '()'."""
    return F.replace(F.replace(col_of(c), F.lit("*"), F.lit(star)), F.lit("()"), F.lit(""))


def letter_frequencies(c: ColumnLike, letters: str = AMINO_ACIDS) -> list[Column]:
    """Frequency of each letter in the upper-cased text / max(len, 1)."""
    s = F.upper(F.coalesce(col_of(c), F.lit("")))
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    return [((F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))) / n).alias(f"aa_{ch}")
            for ch in letters]


#: Parts of a structure string: a two-digit ring label, a bracket atom, any other character.
STRUCTURE_TOKEN = r"(%[0-9][0-9]|\[[^\[\]]*\]|.)"


def structure_problem(c: ColumnLike) -> Column:
    """Reason a structure string is rejected, or null when it passes.

    Syntax rules only: blank, illegal characters, then one fold over the string's
    parts with the depth of branches and the open ring labels as its state.  A
    branch must not close before it opens, a square bracket must enclose an atom
    (nothing inside it counts), and each ring label - a digit, or ``%`` and two
    digits - must be closed.
    """
    s = py_strip(col_of(c))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("early"), F.lit(False).alias("square"), F.array().cast("array<int>").alias("rings"))

    def step(state: Column, x: Column) -> Column:
        depth = state["depth"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        label = F.when(x.rlike("^[0-9]$"), x.cast("int")).when(x == "%", -1).when(x.startswith("%"), F.substring(x, 2, 2).cast("int"))
        rings = state["rings"]
        return F.struct(depth.alias("depth"), (state["early"] | (depth < 0)).alias("early"), (state["square"] | x.isin("[", "]", "[]")).alias("square"),
                        F.when(label.isNull(), rings).when(F.array_contains(rings, label), F.array_remove(rings, label))
                        .otherwise(F.array_append(rings, label)).alias("rings"))

    end = F.aggregate(F.regexp_extract_all(s, F.lit(STRUCTURE_TOKEN), F.lit(1)), start, step, lambda state: F.when(
        state["early"] | (state["depth"] != 0), F.lit("unbalanced parentheses"))
        .when(state["square"], F.lit("unbalanced brackets"))
        .when(F.size(state["rings"]) > 0, F.lit("unpaired ring closure")))
    return (F.when(is_blank(s), F.lit("blank"))
            .when(~s.rlike(STRUCTURE_CHARS), F.lit("illegal character"))
            .otherwise(end))
