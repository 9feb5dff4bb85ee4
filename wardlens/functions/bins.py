"""Bin specs: continuous column -> label, first matching rule wins.

A spec is a sequence of (operator, edge, label).  It compiles to one CASE
expression; values matching no rule (and NULL) get a NULL label, so every
indicator derived from it is 0.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, float, str]

_OPS = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): donor stratification rules and
# labels, in the reference's order.  Decisions where the literal text is
# unreachable or leaks values: age starts with "< 15" (the text has "> 15"),
# BMI 35 goes to the top bin (the text leaves it out).
# ---------------------------------------------------------------------------
DONOR_AGE: Sequence[Rule] = (
    ("<", 15, "dAgeSub15"), ("<", 20, "dAge15_19"), ("<", 25, "dAge20_24"), ("<", 31, "dAge25_30"),
    ("<", 45, "dAge30_44ref"), ("<", 55, "dAge45_54"), ("<", 60, "dAge55_59"), ("<", 65, "dAge60_64"),
    ("<", 70, "dAge65_69"), ("<", 76, "dAge70_75"), (">", 75, "dAge75plus"))
DONOR_AGE_COMPAT: Sequence[Rule] = ((">", 15, "dAgeSub15"),) + tuple(DONOR_AGE[1:])
DONOR_BMI: Sequence[Rule] = (
    ("<=", 20, "dBMIsub20"), ("<", 30, "dBMI20_29ref"), ("<", 35, "dBMI30_34"), (">=", 35, "dBMI35plus"))
DONOR_CREATININE: Sequence[Rule] = (
    ("<", 1.5, "dCreatSub15"), ("<", 2, "dCreat15_19"), ("<", 5, "dCreat20_49"), (">=", 5, "dCreat50plus"))
DONOR_HEIGHT: Sequence[Rule] = (
    ("<", 160, "dHeightSub160cm"), ("<", 183, "dHeight160_182cmRef"), (">", 182, "dHeight182cmPlus"))
DONOR_AST: Sequence[Rule] = (
    ("<", 50, "dASTSub50Ref"), ("<", 100, "dAST50_99"), ("<", 200, "dAST100_199"), ("<", 500, "dAST200_499"),
    (">=", 500, "dAST500Plus"))
DONOR_ALT: Sequence[Rule] = (
    ("<", 50, "dALTSub50Ref"), ("<", 100, "dALT50_99"), ("<", 200, "dALT100_199"), ("<", 500, "dALT200_499"),
    (">=", 500, "dALT500Plus"))
DONOR_BILIRUBIN: Sequence[Rule] = (
    ("<", 1, "dBiliSub10Ref"), ("<", 2, "dBili10_19"), ("<", 3, "dBili20_29"), ("<", 4, "dBili30_39"),
    ("<", 5, "dBili40_49"), ("<", 10, "dBili50_99"), (">=", 10, "dBili100Plus"))

# source column, label column, spec
DONOR_BINS: Sequence[tuple[str, str, Sequence[Rule]]] = (
    ("age_don", "donor_age_categories", DONOR_AGE),
    ("bmi_don", "donor_bmi_categories", DONOR_BMI),
    ("creat_don", "donor_creatinine_categories", DONOR_CREATININE),
    ("hgt_cm_don_calc", "donor_height_categories", DONOR_HEIGHT),
    ("sgot_don", "donor_AST_categories", DONOR_AST),
    ("sgpt_don", "donor_ALT_categories", DONOR_ALT),
    ("tbili_don", "donor_bilirubin_categories", DONOR_BILIRUBIN),
)

# The substring each indicator of the reference searches for
# in its label (used only by the compat_substring option).
COMPAT_SUBSTRINGS: dict[str, str] = {
    "dAgeSub15": "sub15", "dAge15_19": "19", "dAge20_24": "24", "dAge25_30": "30", "dAge30_44ref": "44",
    "dAge45_54": "54", "dAge55_59": "59", "dAge60_64": "64", "dAge65_69": "69", "dAge70_75": "70_75",
    "dAge75plus": "75plus",
    "dBMIsub20": "sub20", "dBMI20_29ref": "29", "dBMI30_34": "34", "dBMI35plus": "35",
    "dCreatSub15": "Sub15", "dCreat15_19": "19", "dCreat20_49": "49", "dCreat50plus": "50",
    "dHeightSub160cm": "Sub160", "dHeight160_182cmRef": "160_182", "dHeight182cmPlus": "182cmPlus",
    "dASTSub50Ref": "50Ref", "dAST50_99": "99", "dAST100_199": "199", "dAST200_499": "499", "dAST500Plus": "500",
    "dALTSub50Ref": "50Ref", "dALT50_99": "99", "dALT100_199": "199", "dALT200_499": "499", "dALT500Plus": "500",
    "dBiliSub10Ref": "10Ref", "dBili10_19": "19", "dBili20_29": "29", "dBili30_39": "39", "dBili40_49": "49",
    "dBili50_99": "99", "dBili100Plus": "100",
}


def bin_label(c: Column, spec: Sequence[Rule]) -> Column:
    expr = F.lit(None).cast("string")
    for op, edge, label in reversed(list(spec)):
        expr = F.when(_OPS[op](c, F.lit(edge)), label).otherwise(expr)
    return expr


def sql_bin_label(c: str, spec: Sequence[Rule]) -> str:
    arms = " ".join(f"when {c} {op} {edge} then '{label}'" for op, edge, label in spec)
    return f"case {arms} else cast(null as varchar) end"
