"""Records, answers and geometry on small documents."""

from pyspark.sql import functions as F

from folioforge.operators import answers, geometry, objects

BLOCKS = [
    ("d", 0, 1, 1, "第一章 总则"),
    ("d", 1, 1, None, "发布日期：2023年6月1日 实施日期：2023年9月"),
    ("d", 2, 1, None, "第1条 建设用地应当符合规划。不得擅自改变。"),
    ("d", 3, 2, None, "改变用途的，依照规定办理。"),
    ("d", 4, 2, 2, "术语"),
    ("d", 5, 2, None, "容积率是指建筑面积与用地面积之比。"),
    ("d", 6, 3, None, "绿地"),
    ("d", 7, 3, 1, "办理流程"),
    ("d", 8, 4, None, "1. 提交图纸和说明书"),
    ("d", 9, 9, None, "本标准代替《旧版配置标准》，旧版同时废止。"),
    ("d", 10, 9, None, "编制依据见城乡规划法"),
    ("d", 11, 9, None, "2) 问题清单"),
]
SCHEMA = "doc_id string, block_index int, page int, level int, text string"


def test_records(spark):
    found = objects.extracted(spark.createDataFrame(BLOCKS, SCHEMA)).collect()
    by = {}
    for r in found:
        by.setdefault(r.object_type, []).append(r)
    clause = by["clause"][0]
    assert len(by["clause"]) == 1 and clause.title == "第1条" and clause.content.endswith("依照规定办理。") and (clause.page_start, clause.page_end) == (1, 2)
    # the term is as long as it can be, and a colon defines too
    assert sorted((r.title, r.confidence) for r in by["definition"]) == [("发布日期", 0.88), ("容积率是", 0.88), ("绿地", 0.62)]
    assert {r.title for r in by["requirement"]} >= {"shall", "forbidden"}
    assert sorted(r.first_block for r in by["procedure_step"]) == [8, 9, 10, 11]
    assert [r.first_block for r in by["drawing"]] == [8] and [(r.first_block, r.title) for r in by["deliverable"]] == [(11, "2) 问题清单")]
    assert [(r.first_block, r.confidence) for r in by["checklist_item"]] == [(11, 0.68)] and [(r.first_block, r.title) for r in by["reference"]] == [(10, "办理流程")]
    assert {r.title for r in by["plain_section"]} >= {"第一章 总则", "第一章 总则 > 术语"}
    assert len({r.object_id for r in found}) == len(found)


def test_version(spark):
    found = objects.version_info(spark.createDataFrame(BLOCKS, SCHEMA)).first()
    assert (found.publish_date, found.effective_date, found.status, found.supersedes) == ("2023-06-01", "2023-09-01", "current", ["旧版配置标准"])


def test_chunks(spark):
    made = objects.extracted(spark.createDataFrame([("d", 0, 1, None, "第1条 " + "规定内容。" * 500)], SCHEMA))
    rows = objects.chunks(made).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) > 2 and max(len(r.content) for r in rows) < 1000
    assert sum(r.prev_chunk_id is None for r in rows) == 1


def test_answers(spark):
    rows = spark.createDataFrame([(1, 1, "The same text here"), (1, 2, "the SAME  text here"), (1, 3, "text here and more"), (1, 4, "it has the same text here inside"), (1, 5, "ab")], "q int, rank int, text string")
    assert answers.citations(rows, "q", "rank", "text").first().citations == ["The same text here", "text here and more", "ab"]
    one = spark.createDataFrame([("how large is the park", "It is old; The park is large! The end.")], "q string, t string")
    assert one.select(answers.core_sentence(F.col("q"), F.col("t")).alias("x")).first().x == "The park is large!"
    assert one.select(answers.values_ok(F.col("t"), F.array(F.lit("old")), F.array(F.lit("new"))).alias("x")).first().x
    chunks = spark.createDataFrame([("a", "p", None, "b"), ("b", "p", "a", None), ("p", None, None, None)], "chunk_id string, parent_chunk_id string, prev_chunk_id string, next_chunk_id string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "question_id int, chunk_id string, rank int")
    assert {(r.chunk_id, r.rank, r.way) for r in answers.expanded(hits, chunks).collect()} == {("a", 1, 0), ("p", 1, 1), ("b", 1, 3)}


def test_geometry(spark):
    item = lambda t, x, y: ("d", 1, t, float(x), float(y), 5.0 * len(t), 10.0)
    items = spark.createDataFrame([item("b", 5, 10), item("a", 0, 11), item("c", 100, 10), item("d", 0, 40), item("e", 101, 41)], "doc_id string, page int, text string, x double, y double, width double, height double")
    assert sorted((r.row, r.segment, r.text) for r in geometry.visual_rows(items).collect()) == [(0, 0, "ab"), (0, 1, "c"), (1, 0, "d"), (1, 1, "e")]
    assert sorted((r.centre, r.n) for r in geometry.column_centres(items).collect()) == [(1.67, 3), (100.5, 2)]
    frame = [(0, 0, 100, 0), (0, 50, 100, 50), (0, 0, 0, 50), (100, 0, 100, 50)]
    inner = [(0, 25, 100, 25), (50, 0, 50, 50), (300, 0, 400, 0)]
    small = [(x0 / 2, y0 / 2, x1 / 2, y1 / 2) for x0, y0, x1, y1 in frame + inner[:2]]
    rows = [("d", page, *map(float, x)) for page, lines in ((1, frame + inner), (2, frame), (3, small)) for x in lines]
    grid = geometry.line_grids(spark.createDataFrame(rows, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [tuple(r)[1:] for r in grid] == [(1, 0.0, 0.0, 100.0, 50.0, 3, 3)]
