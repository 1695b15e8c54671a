"""SQL fragments for the DuckDB oracle.

These restate, in DuckDB SQL, the semantics the Spark column functions
implement, so that the oracle is an independent check: regexp_replace needs
the 'g' flag to be global in DuckDB, case-insensitivity is the 'i' option,
and regexp_matches is a partial match like Spark's rlike.
"""

from __future__ import annotations

from matfold.functions.parse import MILS_RE, NUMBER_RE, NUMERIC_RE, SCIENTIFIC_RE
from matfold.functions.text import STANDARD_PREFIXES, STANDARD_TOKENS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def clean_basic(x: str) -> str:
    up = f"upper(coalesce({x}, ''))"
    s = f"regexp_replace({up}, '[^A-Z0-9\\-\\+\\(\\)\\/ ]+', ' ', 'g')"
    return strip(f"regexp_replace({s}, '\\s+', ' ', 'g')")


def clean_name(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    s = f"regexp_replace({s}, '^\\s*({'|'.join(STANDARD_PREFIXES)})[\\s,:-]*', '', 'i')"
    s = f"replace({s}, ',', ' ')"
    return clean_basic(s)


def norm_name(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def first_number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, {q(NUMBER_RE)}, 0), '') AS DOUBLE)"


def to_number(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    return f"(CASE WHEN regexp_matches({s}, {q(NUMERIC_RE)}) THEN TRY_CAST({s} AS DOUBLE) END)"


def parse_rate(x: str, unit: str = "text") -> str:
    s = strip(x)
    num = first_number(s)
    if unit == "mils":
        scaled = f"{num} * 0.0254"
    else:
        scaled = f"(CASE WHEN regexp_matches({s}, {q(MILS_RE.replace('(?i)', ''))}, 'i') THEN {num} * 0.0254 ELSE {num} END)"
    return (f"(CASE WHEN {blank(s)} THEN NULL "
            f"WHEN regexp_matches(upper({s}), '\\b([A-F])\\b') THEN NULL ELSE {scaled} END)")


def rating_score(x: str) -> str:
    letter = f"nullif(regexp_extract(upper({x}), '\\b([A-F])\\b', 1), '')"
    return (f"(CASE {letter} WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.5 "
            f"WHEN 'D' THEN 0.25 WHEN 'E' THEN 0.125 WHEN 'F' THEN 0.0 END)")


def rate_score(r: str) -> str:
    return f"(CASE WHEN {r} IS NOT NULL THEN 1.0 / (1.0 + log10(greatest({r}, 0.0) + 1.0)) END)"


def corrosion_row_score(mm: str, mils: str) -> str:
    rate = f"coalesce({parse_rate(mm)}, {parse_rate(mils)})"
    rating = f"coalesce({rating_score(mm)}, {rating_score(mils)})"
    return f"coalesce({rate_score(rate)}, {rating})"


def parse_cc50(x: str, fix_scientific: bool = True) -> str:
    v = strip(x)
    v = f"regexp_replace({v}, '[,\\s]*\\(.+?\\)', '', 'g')"
    v = f"replace({v}, ',', '')"
    v = f"replace(replace({v}, '–', '-'), '—', '-')"
    first_part = f"list_filter(string_split({v}, '-'), lambda p: trim(p) <> '')[1]"
    parsed = (f"CASE WHEN starts_with({v}, '>') OR starts_with({v}, '<') THEN {first_number(v)} "
              f"WHEN strpos({v}, '-') > 0 THEN {first_number(first_part)} "
              f"ELSE {first_number(v)} END")
    if fix_scientific:
        parsed = (f"CASE WHEN regexp_matches({v}, {q(SCIENTIFIC_RE)}) THEN TRY_CAST({v} AS DOUBLE) "
                  f"ELSE {parsed} END")
    return f"(CASE WHEN NOT {blank(x)} THEN {parsed} END)"


def label_from_cc50(x: str) -> str:
    return f"(CASE WHEN {x} <= 1.0 THEN 0 WHEN {x} >= 10.0 THEN 1 ELSE -1 END)"


def prefer_standard(std: str, mat: str) -> str:
    m = f"coalesce({mat}, '')"
    lead = (f"nullif(upper(regexp_extract({m}, '^({'|'.join(STANDARD_TOKENS)})\\b', 1, 'i')), '')")
    anywhere = "CASE " + " ".join(
        f"WHEN strpos(upper({m}), '{t}') > 0 THEN '{t}'" for t in STANDARD_TOKENS) + " ELSE 'UNKNOWN' END"
    explicit = f"CASE WHEN NOT {blank(std)} THEN upper({strip(std)}) END"
    return f"coalesce({explicit}, {lead}, {anywhere})"


def r6(x: str) -> str:
    return f"round({x}, 6)"
