"""Literal cases of the access, search, table, source and streaming operators."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import access, evaluation, gates, search, tables
from folioforge.sources import tables as sources
from folioforge.streaming import feedback

DOCUMENT = "struct<project_id:string,project_owner_id:string,category:string,accessible_user_ids:array<string>,permission_level:int>"
USER = "struct<id:string,role:string,project_ids:array<string>,owned_project_ids:array<string>>"


@pytest.mark.parametrize(
    ("document", "user", "seen"),
    [
        ((None, None, "x", None, 1), ("u", "employee", [], []), True),
        ((None, None, "x", None, 3), ("u", "employee", [], []), False),
        ((None, None, "x", None, None), ("u", "employee", [], []), True),
        (("p", None, "x", None, 1), ("u", "employee", ["p"], []), True),
        (("p", None, "x", [], 1), ("u", "employee", ["p"], []), False),  # an empty list is not an absent one
        (("p", None, "x", ["u"], 1), ("u", "employee", [], []), True),
        (("p", "o", "x", None, 1), ("m", "manager", [], ["p"]), False),  # owned by another
        (("p", None, "x", [], 1), ("m", "manager", [], ["p"]), True),
        ((None, "m", "x", None, 1), ("m", "manager", [], []), True),
        ((None, None, "项目资料", None, 1), ("u", "employee", [], []), False),
        (("p", "o", "x", [], 9), ("a", "admin", [], []), True),
        ((None, None, "x", None, 1), ("g", "guest", [], []), False),
        ((None, None, "x", None, 1), (None, None, None, None), False),
    ],
)
def test_access(spark, document, user, seen):
    row = spark.createDataFrame([(document, user)], f"document {DOCUMENT}, user {USER}")
    assert row.select(access.may_view().alias("x")).first().x is seen


def test_searchable(spark):
    rows = spark.createDataFrame([(True, "indexed", "北京市"), (True, "indexed", "通用"), (False, "indexed", "北京"), (True, "failed", "北京"), (None, "indexed", "北京"), (True, "indexed", "上海")], "enabled boolean, status string, city string")
    assert [r.x for r in rows.select(access.searchable(F.col("city"), F.lit("北京")).alias("x")).collect()] == [True, True, False, False, False, False]


def test_no_access(spark):
    cases = [((0, 1, True, True, 1.0, 0.1), False), ((1, 0, False, False, 0.0, 0.0), True), ((1, 1, True, False, 1.4, 0.42), True), ((1, 1, True, True, 0.3, 0.42), False), ((1, 1, False, False, 0.9, 0.1), False)]
    for case, hidden in cases:
        assert spark.range(1).select(gates.no_access(*map(F.lit, case)).alias("x")).first().x is hidden


def test_merge(spark):
    one, two, three = (spark.createDataFrame(rows, "id long, score double") for rows in ([(1, 0.5)], [(1, 0.9), (2, 0.4)], [(2, -0.1), (3, 0.7)]))
    found = {r.id: (r.keyword_score, r.vector_score, r.source) for r in search.merged(one, two, three, "id").collect()}
    assert found == {1: (0.9, 0.0, "hybrid"), 2: (0.4, -0.1, "hybrid"), 3: (0.0, 0.7, "vector")}


def test_budget_passes_over_what_does_not_fit(spark):
    sizes = [5, 5, 5, 5, 5, 90, 30, 60, 1]
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate(sizes)], "q string, at int, size int")
    assert sorted(r.at for r in search.within_budget(rows, "q", "at", "size", 5, 100).collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_passages_by_anchor_and_by_broadcast(spark, monkeypatch):
    passages = spark.createDataFrame([(1, "ne two three four five six sev"), (2, "short one"), (3, "a b c d e f g")], "item_id long, passage string")
    rows = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, "a short one. a b c d e f g"), (3, "one two three four five")], "doc_id long, text string")
    rows = rows.union(spark.createDataFrame([(None, "a short one without key"), (4, None)], rows.schema))
    expected = {(1, 1), (2, 2), (2, 3)}
    assert set(map(tuple, search.containing(rows, passages, "doc_id", "text", "item_id", "passage").collect())) == expected
    monkeypatch.setattr(search, "BROADCAST_PASSAGES", 1)
    assert set(map(tuple, search.containing(rows, passages, "doc_id", "text", "item_id", "passage").collect())) == expected


def test_sections(spark):
    blocks = [(1, 1, "A"), (2, None, "x"), (3, 2, "B"), (4, 3, "C"), (5, 2, "D"), (6, None, "y"), (7, 1, "E"), (8, 3, "F")]
    rows = spark.createDataFrame([("d", *b) for b in blocks], "doc string, at int, level int, title string")
    found = {r.at: r.section_path for r in tables.section_paths(rows, "doc", "at", "level", "title").collect()}
    assert found == {1: "A", 2: "A", 3: "A > B", 4: "A > B > C", 5: "A > D", 6: "A > D", 7: "E", 8: "E > F"}


def test_packing(spark):
    sentences = ["a" * 500, "b" * 500, "c" * 100, "d" * 50]
    rows = spark.createDataFrame([(1, sentences), (2, [])], "id int, s array<string>")
    found = [(r.part, r.content) for r in tables.packed_sentences(rows, "id", F.col("s")).orderBy("part").collect()]
    assert found == [(0, " ".join(sentences[:2])), (1, " ".join(sentences[2:]))]


def test_item_scores(spark):
    cases = [((True, True, True, False, False, None), 2), ((True, False, True, False, False, None), 0), ((False, True, True, True, True, 1.0), 0), ((False, False, True, True, False, None), 1), ((False, False, True, False, False, None), 1), ((False, False, True, False, False, 0.5), 2)]
    for case, score in cases:
        columns = [F.lit(c) if c is not None else F.lit(None).cast("double") for c in case]
        assert spark.range(1).select(evaluation.item_score(*columns).alias("x")).first().x == score


def test_plain_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n[[page:3]]\n\ntwo\r\nthree", encoding="utf-8")
    (tmp_path / "b.bin").write_text("no")
    found = sources.text_blocks(sources.read_plain_documents(spark, str(tmp_path))).orderBy("block_index").collect()
    assert [(r.block_index, r.page, r.text) for r in found] == [(0, 1, "one"), (3, 3, "two"), (4, 3, "three")]


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('编号,标准答案,问题,正确文件\n1,"是,的",为何？,a.pdf\n2,,,b.pdf\n', encoding="utf-8")
    assert [tuple(r) for r in sources.read_questions(spark, str(tmp_path / "q.csv")).collect()] == [("1", "为何？", "是,的", "a.pdf")]


def test_feedback_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def put(name, *rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("target_id", "type", "user_id", "submitted_at"), r, strict=True))) for r in rows))

    put("1.json", ("t1", "up", "u", "2024-01-01T10:00:00Z"), ("t2", "up", "u", "2024-01-01T10:00:00Z"), ("t1", "down", "u", "2024-01-01T11:00:00Z"))
    for _ in range(2):
        feedback.upsert(feedback.read_feedback(spark, str(landing)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        put("2.json", ("t2", "down", "v", "2024-01-02T10:00:00Z"))
    found = {r.target_id: (r.type, r.user_id) for r in spark.read.parquet(str(tmp_path / "out/version=1")).collect()}
    assert found == {"t1": ("down", "u"), "t2": ("down", "v")}


def test_many_passages_of_all_lengths(spark, monkeypatch):
    """Beyond what is broadcast: short passages in blocks, long ones by their inner words."""
    words = [f"w{i % 13}" for i in range(400)]
    texts = [(i, " ".join(words[i * 7 : i * 7 + 30])) for i in range(40)] + [(100, None), (101, "")]
    passages = [(i, " ".join(words[i : i + 1 + i % 9])) for i in range(120)] + [(500, "w1"), (501, "3 w"), (502, ""), (503, None), (504, "w1")]
    expected = sorted((k, p) for k, t in texts for p, x in passages if t and x and x in t)
    monkeypatch.setattr(search, "BROADCAST_PASSAGES", 3)
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    rows, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(passages, "item long, passage string")
    assert sorted(map(tuple, search.containing(rows, asked, "id", "text", "item", "passage").collect())) == expected


def test_runs_with_gaps(spark):
    """Two foreign lines are bridged, three are not; a run is held to the width of its first line; a block of two wide lines is none."""
    cases = [([3, 1, 1, 3, 3], [(0, 5, 3)]), ([3, 1, 1, 1, 3, 3, 3], [(4, 7, 3)]), ([3, 3, 3, 1, 1], [(0, 5, 3)]), ([3, 4, 2, 5, 5, 5], [(0, 3, 3), (3, 6, 3)]), ([3, 4, 5, 5], []), ([1, 1], []), ([], []), ([2, 2, 1, 2, 1, 1, 2, 1, 1, 1], [(0, 9, 4)])]
    rows = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "i int, w array<int>")
    found = {r.i: [tuple(x) for x in r.runs] for r in rows.select("i", tables.bridged_runs(F.col("w")).alias("runs")).collect()}
    assert found == dict(enumerate(runs for _, runs in cases))
