import pytest

from sextant.operators import parsing
from sextant.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ONCE = ["parsed_call_edges", "parsed_dead_code", "parsed_never_called", "parsed_untested", "text_callers", "context_bundles"]


@pytest.mark.parametrize("name", ONCE)
def test_files_are_dealt_out_and_parsed_once(name, spark):
    """What a query returns reads what was parsed; it holds no parser, nor joins that a wrong estimate could broadcast."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution()
    assert "run(path" not in plan.optimizedPlan().toString() and "BroadcastHashJoin" not in plan.executedPlan().toString()


def test_calls_of_a_name_that_every_file_has(spark):
    """2,000 files define and call `go`: pairs by the name alone would be 4 million each way."""
    n = 2000
    rows = [(f"f{i}::go#function", f"f{i}", "go", "function", ["go", f"x{i}"]) for i in range(n)]
    rows += [(f"f{i}::x{i}#function", f"f{i}", f"x{i}", "function", ["go"]) for i in range(n)]
    found = spark.createDataFrame(rows, "id string, file string, name string, kind string, call_references array<string>").repartition(8)
    linked = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(n - 1)], "src string, dst string")
    out = parsing.calls(found, linked)
    assert out.groupBy("resolution").count().orderBy("resolution").collect() == [("ast_inferred", 2 * (n - 1)), ("ast_resolved", 2 * n)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("dst" in line or "src" in line for line in plan.splitlines() if "Join Inner" in line)
