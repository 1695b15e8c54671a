"""Name and text normalisation (Column -> Column).

All functions are pure column expressions; Catalyst keeps them inside
whole-stage codegen and they work on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of

# --- fixed values ---------------------------------------------------------
# Standards bodies recognised as a leading token of a material name.
STANDARD_PREFIXES = ["ANSI", "ISO", "DIN", "ASTM", "BS", "SAE", "GB", "JIS", "GOST"]
# Tokens tried, in this order, when choosing the standard of a material.
STANDARD_TOKENS = ["ANSI", "ASTM", "ISO", "DIN", "BS", "SAE", "GB", "JIS", "GOST", "NF"]
# Characters kept by the clean-name rule (everything else becomes a blank).
CLEAN_NAME_DROP = r"[^A-Z0-9\-\+\(\)\/ ]+"
# Whitespace as stripped by Python's str.strip, Unicode blanks included.
WHITESPACE = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# --------------------------------------------------------------------------

_PREFIX_RE = r"(?i)^\s*(" + "|".join(STANDARD_PREFIXES) + r")[\s,:-]*"


def py_strip(c: ColumnLike) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does.

    Spark's ``trim`` only removes blanks; tabs and newlines must go too.
    ``btrim`` with the whitespace set is a plain character scan (no regex).
    """
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def collapse_ws(c: ColumnLike) -> Column:
    """Collapse runs of whitespace to one blank and strip the ends."""
    return py_strip(F.regexp_replace(col_of(c), r"\s+", " "))


def normalize_whitespace(c: ColumnLike) -> Column:
    """Null-safe whitespace collapse: null becomes ''."""
    return collapse_ws(F.coalesce(col_of(c), F.lit("")))


def is_blank(c: ColumnLike) -> Column:
    """True when the value is null or only whitespace."""
    c = col_of(c)
    return c.isNull() | (py_strip(c) == "")


def normalize_name(c: ColumnLike) -> Column:
    """Lower-case and keep only a-z0-9; null stays null (join key form)."""
    return F.regexp_replace(F.lower(col_of(c)), r"[^a-z0-9]+", "")


def clean_name_basic(c: ColumnLike) -> Column:
    """Upper-case, replace disallowed characters by blanks, collapse.

    Null becomes '' (the value is filled before cleaning).
    """
    up = F.upper(F.coalesce(col_of(c), F.lit("")))
    # One pass: a run of disallowed characters and/or whitespace becomes one
    # blank, which equals "replace disallowed runs, then collapse whitespace".
    fused = CLEAN_NAME_DROP.replace(" ]", "]")
    return F.btrim(F.regexp_replace(up, fused, " "), F.lit(" "))


def make_clean_name(c: ColumnLike) -> Column:
    """Merge-friendly material name.

    Drops a leading standards-body token (case-insensitive, no word boundary:
    ``ISOTROPIC`` loses ``ISO`` as in the original rule), turns commas into
    blanks, upper-cases, keeps ``A-Z0-9-+()/`` and collapses blanks.
    """
    s = py_strip(F.coalesce(col_of(c), F.lit("")))
    s = F.regexp_replace(s, _PREFIX_RE, "")
    s = F.regexp_replace(s, ",", " ")
    return clean_name_basic(s)


def upper_strip(c: ColumnLike) -> Column:
    """``strip().upper()``; null stays null (the original turned it into 'NAN')."""
    return F.upper(py_strip(col_of(c)))


def prefer_standard(std: ColumnLike, material: ColumnLike) -> Column:
    """Standard of a material row.

    1. the explicit standard column when non-blank (stripped, upper-cased);
    2. a leading standards token of the material text;
    3. the first token of ``STANDARD_TOKENS`` found anywhere in the text
       (plain substring, so 'BS' is found inside 'ABSORB');
    4. 'UNKNOWN'.
    """
    std = col_of(std)
    mat = F.coalesce(col_of(material), F.lit(""))
    explicit = F.when(~is_blank(std), F.upper(py_strip(std)))
    lead = F.nullif(
        F.upper(F.regexp_extract(mat, r"(?i)^(" + "|".join(STANDARD_TOKENS) + r")\b", 1)),
        F.lit(""),
    )
    up = F.upper(mat)
    anywhere = None
    for tok in STANDARD_TOKENS:
        cond = F.instr(up, tok) > 0
        anywhere = F.when(cond, F.lit(tok)) if anywhere is None else anywhere.when(cond, F.lit(tok))
    return F.coalesce(explicit, lead, anywhere.otherwise(F.lit("UNKNOWN")))


def level_norm(c: ColumnLike, unknown: str = "unknown") -> Column:
    """Blank or null -> ``unknown``; otherwise stripped and lower-cased."""
    c = col_of(c)
    return F.when(is_blank(c), F.lit(unknown)).otherwise(F.lower(py_strip(c)))


def concat_blank(*cols: ColumnLike) -> Column:
    """Join columns with a blank, nulls as empty strings."""
    return F.concat_ws(" ", *[F.coalesce(col_of(c).cast("string"), F.lit("")) for c in cols])


def surrogate_id(c: ColumnLike) -> Column:
    """Upper-case MD5 hex of the (clean) name."""
    return F.upper(F.md5(F.coalesce(col_of(c), F.lit(""))))
