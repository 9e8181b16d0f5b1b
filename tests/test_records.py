"""Rows, indicators and questions of tables."""

from folioforge.operators import records


def test_questions_in_tables_are_not_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, "data", False, "绿地率 30"), ("t", 1, "data", False, "停车 绿地"), ("u", 0, "data", False, "绿地")], "table_id string, row_index int, row_type string, low_fidelity boolean, search_text string")
    asked = spark.createDataFrame([("t", 1, "绿地率"), ("u", 2, "停车")], "table_id string, question_id int, question string")
    for name, df in (("rows", rows), ("asked", asked)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = records.rows_in_table(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/rows"), ["table_id"])
    assert [(r.question_id, r.row_index, r.rank) for r in found.orderBy("rank").collect()] == [(1, 0, 1), (1, 1, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_indicators_of_wide_tables(spark):
    import time

    names = ["设施名称", *[f"面积{i}（平方米）" for i in range(39)]]
    cells = [["幼儿园", *[f"不少于{i} 平方米" for i in range(38)], "30%"]] * 5 + [["说明", *["无"] * 39], ["", *["1-2"] * 39]]
    tables = spark.createDataFrame([("d", 1, "表1 配置指标", names, cells)], "doc_id string, table_id int, title string, headers array<string>, rows array<array<string>>")
    began = time.time()
    found = records.indicators(records.structured_rows(tables)).orderBy("row_index").collect()
    assert time.time() - began < 30
    assert [(r.row_index, r.item, len(r["values"]), r.unit) for r in found] == [*[(i, "幼儿园", 39, "平方米") for i in range(5)], (6, "1-2", 39, "平方米")]
    last = found[0]["values"][-1]
    assert (last.kind, last.value, last.unit, found[0]["values"][3].min) == ("percentage", 30.0, "%", 3.0)
    assert found[-1]["values"][0].kind == "range"
