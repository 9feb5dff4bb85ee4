"""Physical-plan checks: the shapes the design relies on."""

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_adjacency_has_no_single_partition_exchange(spark):
    for name in ("row_index", "code_rank"):
        assert "SinglePartition" not in _plan(queries()[name](spark, SF))


def test_worklist_is_top_k(spark):
    assert "TakeOrderedAndProject" in _plan(queries()["ent_worklist"](spark, SF))


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = queries()["opp_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "l_linestatus" not in plan
    assert "GreaterThan(l_discount,0.0)" in plan


def test_encounters_meet_lines_before_costs(spark):
    import re
    for name in ("qvi_group", "control_group", "ent_bill"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        cost_join = re.search(r"\n(\W*)Join (LeftOuter|Inner), .*rk_cents", plan)
        left = plan[cost_join.end():]
        # the encounter filter sits in the subtree below the join with the costs
        below = [line for line in left.splitlines() if line.strip()]
        depth = len(cost_join.group(1))
        inner = []
        for line in below[1:]:
            if len(re.match(r"\W*", line).group()) <= depth:
                break
            inner.append(line)
        assert any("o_orderdate" in x and "Filter" in x for x in inner), (name, plan)


def test_contingency_has_no_window(spark):
    from wardlens.operators.contingency import contingency
    df = spark.createDataFrame([("a", "u"), ("b", "v")], "x string, y string")
    assert "Window" not in _plan(contingency(df, "x", "y"))


def test_nullaware_anti_join_not_used(spark):
    assert "BroadcastNestedLoopJoin" not in _plan(queries()["enc_clean"](spark, SF))
