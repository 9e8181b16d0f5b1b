from pyspark.sql import functions as F

from folioforge.functions import repairs as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def test_cell_texts(spark):
    assert one(spark, P.reordered(F.lit("0万.9人6"))) == "0.96万人"
    assert one(spark, P.cell_text(F.lit("绿 地 率 不低于 30 % 。 岁 6 以下"))) == "绿地率不低于30%。 6岁以下"
    assert one(spark, P.cell_text(F.lit(None).cast("string"))) is None


def test_numbers_split_over_lines(spark):
    assert one(spark, P.merged_numbers(texts("14\t12", "00\t00"))) == ["1400\t1200"]
    assert one(spark, P.merged_numbers(texts("1400", "123"))) == ["1400", "123"]
    assert one(spark, P.merged_numbers(texts("", "1"))) == ["", "1"]
    assert one(spark, P.merged_numbers(texts())) == []


def test_fields(spark):
    assert one(spark, P.field_by_header(texts("面积", "名称", "名称2"), texts("1", " ", " 甲 "), "名称")) == "甲"
    assert one(spark, P.field_by_header(texts("面积"), texts("1"), "名称")) is None
    found = one(spark, P.cells_of_columns(texts("名称", "其他"), texts("甲", "— 12"), texts("名称#2", "面积")))
    assert [tuple(x) for x in found] == [("名称#2", "甲")]
    assert [one(spark, P.is_page_fragment(F.lit(x))) for x in ("— 12 —", "12", "-12345", "-7", "3-4")] == [True, False, False, True, False]


def test_candidates(spark):
    grid = lambda *rows: F.array(*[texts(*r) for r in rows])
    assert one(spark, P.is_candidate(grid(["甲", "1"], ["乙", "2"])))
    assert not one(spark, P.is_candidate(grid(["一段", ""], ["正文", ""], ["没有", "1"])))
    assert not one(spark, P.is_candidate(grid(["甲", "1"])))
    assert not one(spark, P.is_candidate(grid(["第一章......", "1"], ["第二章......", "2"])))


def test_blocks_and_notes(spark):
    found = one(spark, P.table_blocks(F.lit("表"), texts("a|b", "c"), F.array(texts("1", ""))))
    assert [tuple(x) for x in found] == [("table", "| a\\|b | c |\n| --- | --- |\n| 1 |   |", "表\n| a\\|b | c |\n| --- | --- |\n| 1 |   |"), ("table_row", "1\t", "1")]
    assert one(spark, P.object_text(F.lit("t"), F.lit(""), texts("h"), texts("v"))) == "t h：v"
    assert one(spark, P.answer_diagnostics(F.lit(" "), F.lit(""), F.lit("x"), texts())) is None
    assert one(spark, P.answer_diagnostics(F.lit(""), F.lit("a"), F.lit("b"), texts())).replaced
    assert [one(spark, P.evaluation_account(F.lit(x))) for x in (" u ", " ", None)] == ["u", None, None]
