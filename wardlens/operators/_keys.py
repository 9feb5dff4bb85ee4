"""Join keys between billing lines and their cost rows (1 : 0..1).

Lines and costs are joined on the encounter plus the line identity, so the
join shares the encounter clustering of the rest of the plan.  When the
line identity is available as numeric parts (``rk_*``) those are used
instead of the text row id, avoiding string building and hashing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NUMERIC_ROW_KEY = ("rk_line", "rk_part", "rk_cents")


def cost_join_keys(lines: DataFrame, costs: DataFrame) -> list[str]:
    lc, cc = set(lines.columns), set(costs.columns)
    if {"encounter_id", *NUMERIC_ROW_KEY} <= lc and {"encounter_id", *NUMERIC_ROW_KEY} <= cc:
        return ["encounter_id", *NUMERIC_ROW_KEY]
    if "encounter_id" in cc:
        return ["encounter_id", "row_id"]
    return ["row_id"]


def line_key_columns(lines: DataFrame, costs: DataFrame) -> list[str]:
    return [c for c in cost_join_keys(lines, costs) if c != "encounter_id"]


def join_costs(lines: DataFrame, costs: DataFrame, how: str = "left") -> DataFrame:
    keys = cost_join_keys(lines, costs)
    return lines.join(costs.select(*keys, "unit_cost"), keys, how)
