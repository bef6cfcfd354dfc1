"""What the plans must and must not hold."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
PYTHON = {n for n in entry.queries() if n.startswith("udf_")} | {"agg_14_per_group_function"}


def plan(df, mode="formatted"):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n not in PYTHON and not n.startswith(("str_", "join_17", "join_18"))))
def test_core_queries_stay_on_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for node in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin LeftOuter"):
        assert node not in text, node


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["src_03_scan"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_shipdate" in text and "GreaterThan(l_discount,0.05)" in text
    schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert all(c in schema for c in ("l_quantity", "l_discount", "l_returnflag", "l_shipdate")) and "l_partkey" not in schema


def test_top_n_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["win_11_top_per_hour"](spark, FOLDER))


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["set_09_top_k"](spark, FOLDER))


def test_no_sketch_for_each_value(spark):
    """A sketch of an approximate count takes kilobytes; one beside a distinct count was kept for every (type, user)."""
    text = plan(entry.queries()["agg_04_approx_distinct"](spark, FOLDER), "simple")
    sketches = [line for line in text.splitlines() if "approx_count_distinct" in line]
    assert sketches and not any("user_id" in line.partition("functions=")[0] for line in sketches)
    assert any("user_id" in line and "functions=[]" in line for line in text.splitlines())
