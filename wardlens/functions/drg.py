"""MS-DRG number -> body-system category (AAPC major diagnostic categories)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): inclusive MS-DRG number ranges and
# their category labels, in the reference's order; first match wins.
# ---------------------------------------------------------------------------
DRG_CATEGORIES: tuple[tuple[tuple[tuple[int, int], ...], str], ...] = (
    (((1, 19),), "Solid Organ transplant, ECMO, Tracheostomy, Bone Marrow Transplant, Immunotherapies"),
    (((20, 103),), "Nervous System"),
    (((113, 125),), "Eye"),
    (((135, 159),), "Ear, Nose, Mouth, Throat"),
    (((163, 208),), "Respiratory System"),
    (((212, 320),), "Circulatory System"),
    (((321, 399),), "Digestive System"),
    (((405, 446),), "Hepatobiliary System, Pancreas"),
    (((453, 566),), "MSK, Connective Tissue"),
    (((570, 607),), "Skin, Subcutaneous Tissue, Breast"),
    (((614, 645),), "Endocrine, Nutritional, Metabolic Diseases & Disorders"),
    (((650, 700),), "Kidney, Urinary Tract"),
    (((707, 730),), "Male Reproductive System"),
    (((734, 761),), "Female Reproductive System"),
    (((789, 795),), "Newborns, Other Neonates with Conditions Originating in Perinatal Period"),
    (((799, 804), (808, 816)), "Blood, Blood-forming Organs, Immunologic Disorders"),
    (((820, 830), (834, 849)), "Myeloproliferative Diseases/Disorders, Poorly Differentiated Neoplasms"),
    (((768, 788), (796, 798), (805, 807), (817, 819), (831, 833)), "Pregnancy, Childbirth, Puerperium"),
    (((853, 872),), "Infectious/Parasitic Disease, Systemic/Unspecified Sites"),
    (((876, 887),), "Mental Diseases & Disorders"),
    (((894, 897),), "Alcohol/Drug Abuse, Alcohol/Drug Induced Organic Mental Disorders"),
    (((901, 923),), "Injuries, Poisonings, Toxic Effects of Drugs"),
    (((927, 935),), "Burns"),
    (((939, 951),), "Factors Influencing Health Status, Other Contacts with Health Services"),
    (((955, 965),), "Multiple Significant Trauma"),
    (((969, 977),), "Human Immunodeficiency Virus Infections"),
    (((981, 989),), "OR Procedure Unrelated to Principal Diagnosis w/ or w/o CCMCC"),
    (((998, 998),), "Principal Diagnosis Invalid as Discharge Diagnosis"),
)
UNGROUPABLE = "Ungroupable"


def drg_number(code: Column) -> Column:
    """Numeric MS-DRG; NULL (not an error) for non-numeric codes."""
    return code.cast("string").try_cast("int")


def mdc_group(code: Column) -> Column:
    """Category label of an MS-DRG code, 'Ungroupable' outside all ranges.

    Compiled to one CASE expression (no join), evaluated in generated code.
    """
    n = drg_number(code)
    expr = F.lit(UNGROUPABLE)
    for ranges, label in reversed(DRG_CATEGORIES):
        cond = None
        for lo, hi in ranges:
            c = n.between(lo, hi)
            cond = c if cond is None else cond | c
        expr = F.when(cond, label).otherwise(expr)
    return expr


def category_ranges() -> list[tuple[int, int, str]]:
    """The categories as rows ``lo, hi, label`` of a range table."""
    return [(lo, hi, label) for ranges, label in DRG_CATEGORIES for lo, hi in ranges]


def sql_mdc_group(code_sql: str) -> str:
    n = f"try_cast({code_sql} as int)"
    arms = []
    for ranges, label in DRG_CATEGORIES:
        cond = " or ".join(f"{n} between {lo} and {hi}" for lo, hi in ranges)
        arms.append(f"when {cond} then '{label}'")
    return "case " + " ".join(arms) + f" else '{UNGROUPABLE}' end"
