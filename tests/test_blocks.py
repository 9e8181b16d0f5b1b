"""Lines, rows and logical tables on literal cases."""

import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.operators import tables
from folioforge.sources.docx import read_docx_documents


def test_headings(spark):
    lines = {"第一章 总则": ("chapter", 2, "总则"), "第3条 用地": ("article", 4, "用地"), "3.0.1 规定": ("clause-dot3", 4, "规定"), "1.2 范围": ("num-dot2", 5, "范围"), "（1）甲": ("paren-num", 7, "甲"), "正文": None, "第一章\t1": None, "1. " + "长" * 41: None, "第二条 " + "长" * 60: ("article", 4, "长" * 60)}
    rows = spark.createDataFrame([(k,) for k in lines], "t string").select("t", B.heading(F.col("t")).alias("h")).collect()
    assert {r.t: r.h and (r.h.pattern, r.h.level, r.h.text) for r in rows} == lines


@pytest.mark.parametrize(("f", "text", "expected"), [(B.is_caption, "续表3.0.3 指标", True), (B.is_caption, "表格", False), (B.is_continued, " 续表1", True), (B.is_page_fragment, "— 12 —", True), (B.is_page_fragment, "12-15", False), (B.is_page_fragment, "12", False), (B.category, "审查报批", "流程指引"), (B.category, "FAQ", "FAQ"), (B.category, "x", "其他")])
def test_lines(spark, f, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x == expected


def test_rows(spark):
    one = spark.range(1)
    fields = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("c"), F.lit(""))
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(B.row_sentence(F.array(*map(F.lit, "abc")), fields)) == "a：1。b：2"
    assert get(B.markdown_row(F.array(F.lit("x|y"), F.lit("p\nq"), F.lit(None).cast("string")))) == "| x\\|y | p q |  |"
    assert get(B.page_span(F.lit(2), F.lit(4))) == [2, 3, 4] and get(B.page_span(F.lit(0), F.lit(4))) == []
    assert get(B.relevance(F.lit(0.3))) == "中" and get(B.answer_overlap(F.lit("绿地率30%"), F.lit("绿地率 30"))) == 1.0
    assert get(B.is_clean(F.lit(False), F.lit("shown"), F.array())) and not get(B.is_clean(F.lit(False), F.lit("shown"), F.array(F.lit("w"))))
    grid = get(tables.grid_statistics(F.array(F.array(F.lit("a"), F.lit("")), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("d"), F.lit(""))))) 
    assert (grid.columns, round(grid.fill, 4), round(grid.stable, 4)) == (1, 0.6667, 0.6667)


def test_continued_tables(spark):
    parts = [("d", 1, 1, 1, "表1 指标", ["a", "b"]), ("d", 2, 2, 2, "续表1 指标", ["a", "b"]), ("d", 3, 3, 3, None, ["A", "b："]), ("d", 4, 3, 3, "表2", ["a", "b"]), ("d", 5, 9, 9, None, ["a", "b"]), ("e", 1, 1, 1, None, ["x"])]
    rows = spark.createDataFrame(parts, "doc_id string, seq int, page_start int, page_end int, title string, headers array<string>")
    assert [r.table_no for r in tables.continued_tables(rows).orderBy("doc_id", "seq").collect()] == [1, 1, 1, 2, 3, 1]


def test_continued_rows_binding_and_slices(spark):
    rows = spark.createDataFrame([("t", 1, "A1", "x"), ("t", 2, "", "y"), ("t", 3, "A2", "z"), ("t", 4, None, "w")], "t string, i int, code string, content string")
    assert sorted(tuple(r) for r in tables.continued_rows(rows, ["t"], "i", "code", "content").select("code", "content").collect()) == [("A1", "xy"), ("A2", "zw")]
    chunks = spark.createDataFrame([("d", "t", "c1", 2, "k"), ("d", "t", "c2", None, "幼儿园 用地"), ("d", "t", "c3", None, "none")], "doc_id string, table_id string, chunk_id string, source_row_index int, row_key string")
    cells = spark.createDataFrame([("d", "t", 1, "幼儿园"), ("d", "t", 2, "小学"), ("d", "t", 3, "用地")], "doc_id string, table_id string, row_index int, key string")
    assert {r.chunk_id: r.row_index for r in tables.bound_chunks(chunks, cells).collect()} == {"c1": 2, "c2": 1, "c3": None}
    numbered = tables.numbered_rows(spark.createDataFrame([("t", 1, "幼儿园"), ("t", 2, "小计"), ("t", 3, "注：")], "t string, i int, k string"), ["t"], "i", "k")
    assert [(r.row_number, r.row_type) for r in numbered.orderBy("i").collect()] == [(0, "data"), (1, "summary"), (2, "note")]
    slices = spark.createDataFrame([(1, 0.9), (1, 0.6), (1, 0.5), (2, 0.4)], "q int, s double")
    assert sorted(r.s for r in tables.strong_slices(slices, "q", "s").collect()) == [0.6, 0.9]


def test_docx(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as file:
        file.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"no")
    assert {r.file_name: r.text for r in read_docx_documents(spark, str(tmp_path)).collect()} == {"a.docx": "one\ttwo\n", "b.docx": None}
