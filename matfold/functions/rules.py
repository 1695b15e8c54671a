"""Material-type classifier: an ordered rule table compiled into one CASE.

The rules are data; ``material_type`` turns them into a single ``CASE WHEN
rlike ...`` expression, first match wins.  Patterns are written without
look-around or back-references so that Java regex and RE2 agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of

# --- fixed values ---------------------------------------------------------
# Ordered (pattern, type) rules applied to the upper-cased material name.
# Two quirks are kept on purpose: the mixed-case alternatives 'MnC' and 'Cr'
# can never match upper-cased text, and the aluminium rule bounds only one
# side of each spelling.
MATERIAL_TYPE_RULES = [
    (r"\bMUNTZ METAL\b", "COPPER_ALLOY"),
    (r"\bLEADED MUNTZ METAL\b", "COPPER_ALLOY"),
    (r"\bC\d{3,5}\b", "COPPER_ALLOY"),
    (r"\bNODULAR CAST IRON\b", "NODULAR_CAST_IRON"),
    (r"\bMALLEABLE CAST IRON\b", "MALLEABLE_CAST_IRON"),
    (r"\bGRAY CAST IRON\b", "GRAY_CAST_IRON"),
    (r"\bCAST IRON\b", "CAST_IRON"),
    (r"\bGGG\b", "NODULAR_CAST_IRON"),
    (r"\bGG\b", "GRAY_CAST_IRON"),
    (r"\bGTS\b", "CAST_IRON"),
    (r"\b(9SMN28|10S2O|35S20)\b", "FREE_CUTTING_STEEL"),
    (r"\b(HI|HII)\b", "STEEL"),
    (r"\b(UST1303|UST34-2|RST37-2)\b", "STEEL"),
    (r"\b(CK|CF)\d+\b", "CARBON_STEEL"),
    (r"\b(\d+MN\d+|\d+CR\d+|\d+MO\d+)\b", "ALLOY_STEEL"),
    (r"\b(\d+CRMO\d+|\d+CRV\d+)\b", "ALLOY_STEEL"),
    (r"\b(\d+CRNIMO\d+|\d+NI\d+)\b", "ALLOY_STEEL"),
    (r"\b(WTST\d+)\b", "STEEL"),
    (r"\b(SUM22|SMN433|SCR430|SCR435|SCR440|SMNC420)\b", "ALLOY_STEEL"),
    (r"\b(SNCM815|SNCM447|SNCM630)\b", "ALLOY_STEEL"),
    (r"\bS(NC|CM|UP|MnC|Cr)\d+", "ALLOY_STEEL"),
    (r"\bSUS\d+", "STAINLESS_STEEL"),
    (r"\bSUH\d+", "HEAT_RESISTANT_STEEL"),
    (r"\bS\d+C\b", "CARBON_STEEL"),
    (r"\bSS\d+\b", "STEEL"),
    (r"\bSTKM\d+", "STEEL"),
    (r"\bSM\d+\b", "STEEL"),
    (r"\b(\d+[A-Z]\d+|\d+M\d+)\b", "STEEL"),
    (r"\bGRADE\s+\d+\b", "STEEL"),
    (r"\b(\d+[A-Z]\d+)\b", "STEEL"),
    (r"\b(\d+S\d+)\b", "STAINLESS_STEEL"),
    (r"\b(CR\d+GP|CR\d+PL|CEW\d+BK|CFS\d+NBK)\b", "STEEL"),
    (r"\b(\d+[A-Z])\b", "STEEL"),
    (r"\b1[01]\d{4}\b", "STEEL"),
    (r"\b4[012]\d{4}\b", "STEEL"),
    (r"\b([XZ]\w+\d+)\b", "STEEL"),
    (r"\b(\d+[A-Z]+\d+)\b", "STEEL"),
    (r"\b([A-Z]\d+)\b", "STEEL"),
    (r"\b(\d+[CDMNS]+\d+)\b", "ALLOY_STEEL"),
    (r"\b(ST|UST|RST|CK|CF|SMN|SCR|SNCM)\w*\b", "STEEL"),
    (r"\bBRASS\b", "BRASS"),
    (r"\bBRONZE\b", "BRONZE"),
    (r"\bCOPPER-NICKEL\b", "COPPER_NICKEL"),
    (r"\bCOPPER\b", "COPPER"),
    (r"\bMAGNESIUM\b", "MAGNESIUM"),
    (r"\bALUMINUM|ALUMINIUM\b", "ALUMINUM"),
    (r"\bTITANIUM\b", "TITANIUM"),
    (r"\bNICKEL\b", "NICKEL"),
    (r"\bSTAINLESS\b", "STAINLESS_STEEL"),
    (r"\bSTEEL\b", "STEEL"),
    (r"\bALLOY\b", "ALLOY"),
    (r"\bPEROVSKITE\b", "PEROVSKITE"),
    (r"\bCERAMIC\b", "CERAMIC"),
    (r"\bPOLYMER\b", "POLYMER"),
]
# Fallback heuristics, tried after the table, in this order.
MATERIAL_TYPE_HEURISTICS = [
    (r"\bC\d{3,5}\b", "COPPER_ALLOY"),
    (r"\b(\d+CR|\d+NI|\d+MO|\d+V|\d+MN|\d+SI|\d+W|\d+CO)\b", "ALLOY_STEEL"),
    (r"^\d+[A-Z]|[A-Z]+\d+", "STEEL"),
    (r"^(DIN|BS|CSN|NF|JIS|ISO|ASTM)\b", "STEEL"),
]
UNKNOWN_TYPE = "UNKNOWN"
# --------------------------------------------------------------------------


def _merged_rules() -> list[tuple[str, str]]:
    """The rules in order, neighbours of one label as one pattern: fewer branches keep the generated code small enough to be compiled."""
    out: list[tuple[str, str]] = []
    for pattern, label in MATERIAL_TYPE_RULES + MATERIAL_TYPE_HEURISTICS:
        if out and out[-1][1] == label:
            out[-1] = (f"{out[-1][0]}|(?:{pattern})", label)
        else:
            out.append((f"(?:{pattern})", label))
    return out


def material_type(name: ColumnLike) -> Column:
    """Material type of a name: first matching rule, else 'UNKNOWN'."""
    up = F.upper(F.coalesce(col_of(name), F.lit("")))
    expr = None
    for pattern, label in _merged_rules():
        cond = up.rlike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(UNKNOWN_TYPE))


def material_type_sql(name_sql: str) -> str:
    """The same classifier as a portable SQL CASE (used by the DuckDB oracle)."""
    up = f"upper(coalesce({name_sql}, ''))"
    parts = ["CASE"]
    for pattern, label in MATERIAL_TYPE_RULES + MATERIAL_TYPE_HEURISTICS:
        parts.append(f" WHEN regexp_matches({up}, '{pattern}') THEN '{label}'")
    parts.append(f" ELSE '{UNKNOWN_TYPE}' END")
    return "".join(parts)
