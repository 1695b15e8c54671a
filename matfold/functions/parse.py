"""Measurement-text parsing (Column -> Column).

Every parser is a native expression: regexp_extract / split / try_cast, no
Python per row.  ``try_cast`` alone is not enough: Spark accepts '1d' and
'1f' as numbers and parses 'nan'/'inf', so a numeric pattern guards it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of
from matfold.functions.text import is_blank, py_strip

# --- fixed values ---------------------------------------------------------
# First number in a text, sign included (a hyphen counts as a minus sign).
NUMBER_RE = r"[-+]?\d*\.?\d+|\d+"
# A whole value that is a plain decimal number, optionally in e-notation.
NUMERIC_RE = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
# A whole value in scientific notation (2.7e-07).
SCIENTIFIC_RE = r"^[-+]?(\d+\.?\d*|\.\d+)[eE][-+]?\d+$"
# Unit words that mark a rate as mils per year.
MILS_RE = r'(?i)mil|inch|"'
MILS_TO_MM = 0.0254
# --------------------------------------------------------------------------


def to_number(c: ColumnLike) -> Column:
    """``pd.to_numeric(errors='coerce')``: number or null, never NaN/inf."""
    s = py_strip(col_of(c).cast("string"))
    return F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))


def first_number(c: ColumnLike) -> Column:
    """First signed number found in the text, or null."""
    return F.nullif(F.regexp_extract(col_of(c), NUMBER_RE, 0), F.lit("")).try_cast("double")


def strip_to_number(c: ColumnLike) -> Column:
    """Drop every character but digits, '.', '-' then coerce (rate columns)."""
    s = F.regexp_replace(col_of(c).cast("string"), r"[^0-9.\-]+", "")
    return F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))


def parse_cc50(c: ColumnLike, fix_scientific: bool = True) -> Column:
    """Concentration text (mM) -> number.

    Rules, in order: blank -> null; parenthesised remarks and commas dropped;
    en/em dashes become '-'; a leading '>' or '<' keeps the number; a range
    keeps its lower bound; otherwise the first number.  A leading minus is
    lost on the range rule ('-5' -> 5).  With ``fix_scientific`` a value in
    e-notation is read whole (the range rule would turn 2.7e-07 into 2.7).
    """
    v = py_strip(col_of(c))
    v = F.regexp_replace(v, r"[,\s]*\(.+?\)", "")
    v = F.regexp_replace(v, ",", "")
    v = F.translate(v, "–—", "--")
    first_part = F.try_element_at(
        F.filter(F.split(v, "-"), lambda p: F.trim(p) != ""), F.lit(1))
    parsed = (
        F.when(v.startswith(">") | v.startswith("<"), first_number(v))
        .when(F.instr(v, "-") > 0, first_number(first_part))
        .otherwise(first_number(v))
    )
    if fix_scientific:
        parsed = F.when(v.rlike(SCIENTIFIC_RE), v.try_cast("double")).otherwise(parsed)
    return F.when(~is_blank(col_of(c)), parsed)


def extract_float(c: ColumnLike, fix_scientific: bool = True) -> Column:
    """Loose float reader used for modelling tables.

    Decimal comma -> dot, first blank-separated token, a range 'a-b' gives
    the mean of its numeric parts, anything else must be a whole number
    ('>100' -> null).  With ``fix_scientific`` '2.7e-07' is read whole
    instead of as the range '2.7e' / '07'.
    """
    s = F.regexp_replace(py_strip(col_of(c).cast("string")), ",", ".")
    tok = F.try_element_at(F.split(s, r"\s+"), F.lit(1))
    parts = F.filter(F.split(tok, "-"), lambda p: p.rlike(r"^(\d+\.?\d*|\.\d+)$"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p.cast("double"))
    ranged = F.when(F.size(parts) > 0, total / F.size(parts))
    out = (F.when(F.instr(tok, "-") > 0, ranged)
           .otherwise(F.when(tok.rlike(NUMERIC_RE), tok.try_cast("double"))))
    if fix_scientific:
        out = F.when(tok.rlike(SCIENTIFIC_RE), tok.try_cast("double")).otherwise(out)
    return out


def parse_rate(c: ColumnLike, unit: str = "text") -> Column:
    """Corrosion rate text -> mm/yr.

    A letter rating (a lone A-F) or blank gives null; otherwise the first
    number.  ``unit='text'`` converts only when the text names mils, inch or
    '"'; ``unit='mils'`` treats every number as mils (for the mils column).
    """
    return parse_stripped_rate(py_strip(col_of(c)), unit)


def parse_stripped_rate(s: Column, unit: str = "text") -> Column:
    """``parse_rate`` of a text that is stripped already.

    Every part of it appears once: the generated code of a scan that parses
    several columns must stay under the size the JVM still compiles.
    """
    if unit not in ("text", "mils"):
        raise ValueError(f"unit must be 'text' or 'mils', got {unit!r}")
    factor = F.lit(MILS_TO_MM) if unit == "mils" else F.when(s.rlike(MILS_RE), F.lit(MILS_TO_MM)).otherwise(F.lit(1.0))
    # a blank text has no number
    return F.when(~F.upper(s).rlike(r"\b[A-F]\b"), first_number(s) * factor)


def strip_suffix_int(c: ColumnLike, suffix: str = " max") -> Column:
    """'250 max' -> 250 (integer), otherwise an integer parse or null."""
    s = F.replace(col_of(c).cast("string"), F.lit(suffix), F.lit(""))
    s = py_strip(s)
    return F.when(s.rlike(r"^[-+]?\d+$"), s.try_cast("int"))
