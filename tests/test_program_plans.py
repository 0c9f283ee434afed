import pytest

from traceloom.plans import catalogue

EXPLODED = ["cfg_shapes", "cfg_prompt_text", "cfg_blocks", "cfg_json", "cfg_edges", "cfg_lines", "ast_functions", "test_input_literals"]


@pytest.mark.parametrize("name", EXPLODED)
def test_programs_are_parsed_once_and_not_before_they_are_distinct(spark, tmp_path, name):
    spark.createDataFrame([(i, 1 + i % 3) for i in range(9)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    calls = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert len(calls) == 1
    assert any("Aggregate [" in line for line in plan[calls[0] :])
