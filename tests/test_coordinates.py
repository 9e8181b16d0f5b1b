import pytest

from folioforge.operators import coordinates

ITEM = "page long, at long, text string, x double, y double, width double, height double"
LINE = "page long, x0 double, y0 double, x1 double, y1 double"
REGION = "page long, region int, x0 double, y0 double, x1 double, y1 double, title string"


def items_of(spark, *pages):
    rows = []
    for page, items in enumerate(pages):
        for at, (text, x, y, *width) in enumerate(items):
            rows.append((page, at, text, float(x), float(y), float(width[0] if width else 5 * len(text)), 10.0))
    return spark.createDataFrame(rows, ITEM)


def lines_of(spark, *boxes, page=0):
    return spark.createDataFrame([(page, *map(float, b)) for b in boxes], LINE)


def cross(xs, ys):
    """Lines of a grid."""
    return [(xs[0], y, xs[-1], y) for y in ys] + [(x, ys[0], x, ys[-1]) for x in xs]


PROSE = [("Table 1 indicator table", 10, 10), ("Name", 10, 30), ("Area", 100, 30), ("Scale", 200, 30), ("Property room", 10, 50), ("150", 100, 50), ("one per project", 200, 50), ("Clinic", 10, 70), ("1700", 100, 70), ("one per community", 200, 70), ("This is a normal paragraph, not a table.", 10, 120), ("- 12 -", 260, 760)]
CHINESE = [("表：重点地区管控内容一览表", 10, 10, 120), ("区域", 10, 30), ("要求", 100, 30), ("代码", 200, 30), ("A", 10, 50), ("控制", 100, 50), ("01", 200, 50), ("B", 10, 70), ("优化", 100, 70), ("02", 200, 70)]
BELOW = [("Railway station", 10, 30, 60), ("FAR", 100, 30, 20), ("Scale", 170, 30, 30), ("National hub", 10, 50, 60), ("0.2", 100, 50, 20), ("1000m", 170, 50, 30), ("Regional hub", 10, 70, 60), ("0.1", 100, 70, 20), ("500m", 170, 70, 30), ("表：铁路客站周边一体化范围一览表", 10, 95, 150)]
WRAPPED = [("1", 10, 30), ("Residential", 60, 30, 50), ("0701 housing land controls at least half of construction land", 160, 30, 220), ("including compatible community service facilities and local road access", 160, 48, 240), ("with detailed implementation requirements determined by the district", 160, 66, 240), ("2", 10, 90), ("Commercial", 60, 90, 50), ("0902 business land controls at least half of construction land", 160, 90, 220), ("3", 10, 115), ("Industrial", 60, 115, 50), ("1001 industrial land controls at least half of construction land", 160, 115, 220)]
MULTILINE = [("Name", 10, 30), ("Requirement", 100, 30), ("Code", 220, 30), ("Property room", 10, 50), ("near main entrance", 100, 50), ("R1", 220, 50), ("and accessible", 100, 62), ("- 13 -", 220, 62), ("shared-service room", 100, 80), ("R2", 220, 80)]
SPARSE = [("No", 10, 30), ("Type", 60, 30), ("Requirement", 150, 30), ("1", 10, 50), ("Residential", 60, 50), ("0701 housing land", 150, 62), ("controls at least half", 150, 74), ("2", 10, 95), ("Commercial", 60, 95), ("0902 business land", 150, 95)]
CODES = [("Table 2 code table", 10, 10), ("Code", 10, 30), ("Name", 100, 30), ("A21", 10, 50), ("Library", 100, 50), ("A22", 10, 70), ("Culture center", 100, 70)]
NEEDS = [("Table 3 requirements", 10, 10), ("Name", 10, 30), ("Requirement", 100, 30), ("Room", 10, 50), ("Near entrance", 100, 50), ("Hall", 10, 70), ("Shared access", 100, 70)]


def test_regions(spark):
    pages = [PROSE, CHINESE, BELOW, WRAPPED, MULTILINE, SPARSE, CODES, NEEDS]
    found = {}
    for r in coordinates.regions(items_of(spark, *pages), ["page"]).collect():
        found.setdefault(r.page, []).append(r)
    assert {page: [r.title for r in rows] for page, rows in found.items()} == {0: ["Table 1 indicator table"], 1: ["表：重点地区管控内容一览表"], 2: ["表：铁路客站周边一体化范围一览表"], 3: [None], 4: [None], 5: [None], 6: ["Table 2 code table"], 7: ["Table 3 requirements"]}
    assert found[0][0].confidence >= 0.5


@pytest.fixture(scope="module")
def no_lines(spark):
    return spark.createDataFrame([], LINE)


def test_grids_of_regions(spark, no_lines):
    items = items_of(spark, MULTILINE, SPARSE, CODES, NEEDS)
    found = {r.page: (r.grid, r.warnings, r.source) for r in coordinates.table_grids(coordinates.regions(items, ["page"]), items, no_lines, ["page"]).collect()}
    assert found[0][0] == [["Name", "Requirement", "Code"], ["Property room", "near main entrance and accessible", "R1"], ["", "shared-service room", "R2"]]
    assert set(found[0][1]) >= {"rowspan_filled", "page_footer_removed"}
    assert found[1][0] == [["No", "Type", "Requirement"], ["1", "Residential", "0701 housing land controls at least half"], ["2", "Commercial", "0902 business land"]]
    assert found[2][0] == [["Code", "Name"], ["A21", "Library"], ["A22", "Culture center"]]
    assert found[3] == ([["Name", "Requirement"], ["Room", "Near entrance"], ["Hall", "Shared access"]], [], "text")


def test_cell_pieces_in_reading_order(spark, no_lines):
    items = items_of(spark, [("Name", 10, 30), ("Value", 100, 30), ("托幼", 10, 50), ("人6", 130, 50, 15), ("0万.", 100, 50, 20), ("9", 122, 50, 8), ("以下", 130, 66, 20), ("岁", 100, 66, 10), ("6", 112, 66, 8)])
    region = spark.createDataFrame([(0, 0, 5.0, 25.0, 180.0, 85.0, None)], REGION)
    assert [r.grid for r in coordinates.table_grids(region, items, no_lines, ["page"]).collect()] == [[["Name", "Value"], ["托幼", "0.96万人 6岁以下"]]]


def test_boundaries(spark):
    lines = lines_of(spark, *cross([10, 60, 110], [10, 40, 70]))
    box = lambda *b: spark.createDataFrame([(0, 0, *map(float, b), None)], REGION)
    found = coordinates.boundaries(lines, box(8, 8, 112, 72), ["page"]).first()
    assert (found.xs, found.ys) == ([10, 60, 110], [10, 40, 70])
    wider = coordinates.boundaries(lines, box(0, 8, 130, 90), ["page"]).first()
    assert (wider.xs, wider.ys) == ([0, 10, 60, 110, 130], [10, 40, 70, 90])
    frame = lines_of(spark, (0, 0, 600, 0), (0, 0, 0, 800), (5, 5, 500, 500), (10, 40, 110, 40))
    assert coordinates.boundaries(frame, box(8, 8, 112, 72), ["page"]).collect() == []


def test_line_grids(spark):
    region = spark.createDataFrame([(0, 0, 10.0, 10.0, 210.0, 70.0, None)], REGION)
    marks = items_of(spark, [("Name", 15, 20, 30), ("● ○ ●", 65, 20, 130), ("Road", 15, 50, 30), ("○ ● ○", 65, 50, 130)])
    found = coordinates.table_grids(region, marks, lines_of(spark, *cross([10, 60, 110, 160, 210], [10, 40, 70])), ["page"]).first()
    assert (found.grid, found.source) == ([["Name", "●", "○", "●"], ["Road", "○", "●", "○"]], "lines")
    region = spark.createDataFrame([(0, 0, 10.0, 10.0, 260.0, 100.0, None)], REGION)
    ghost = items_of(spark, [("Name", 15, 20, 30), ("Value", 85, 20, 30), ("ghost", 145, 20, 30), ("Note", 205, 20, 30), ("A", 15, 50, 30), ("1", 85, 50, 30), ("ok", 205, 50, 30), ("B", 15, 80, 30), ("2", 85, 80, 30), ("ok", 205, 80, 30)])
    found = coordinates.table_grids(region, ghost, lines_of(spark, *cross([10, 80, 140, 200, 260], [10, 40, 70, 100])), ["page"]).first()
    assert found.grid == [["Name", "Value", "Note"], ["A", "1", "ok"], ["B", "2", "ok"]]


def test_empty_pages(spark, no_lines):
    none = items_of(spark, [("x", 1, 1)]).limit(0)
    assert coordinates.regions(none, ["page"]).collect() == []
    assert coordinates.table_grids(spark.createDataFrame([], REGION), none, no_lines, ["page"]).collect() == []


def test_texts_of_cells(spark):
    """Lines by their tops, blanks between words only, a glyph on a border in both cells, one outside in none."""
    row = lambda text, x, y, width=5: [(0, c, x + width * i, y, x + width * (i + 1), y + 8.0) for i, c in enumerate(text)]
    glyphs = row("FAR", 10.0, 10.0) + row("2.5", 30.0, 10.5) + row("上限", 10.0, 22.0) + row("值", 24.0, 22.0) + row("50", 130.0, 10.0) + row("%", 148.0, 10.0) + row("x", 98.0, 40.0) + row("far", 900.0, 900.0) + [(0, "", 12.0, 12.0, 13.0, 20.0)]
    cells = [(0, 1, 0.0, 0.0, 100.0, 60.0), (0, 2, 101.0, 0.0, 200.0, 60.0), (0, 3, 200.0, 0.0, 150.0, 60.0), (1, 1, 0.0, 0.0, 1000.0, 1000.0)]
    found = coordinates.cell_texts(spark.createDataFrame(glyphs, "page int, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(cells, "page int, cell int, x0 double, y0 double, x1 double, y1 double"), ["page"])
    assert {r.cell: (r.lines, r.text) for r in found.collect()} == {1: (["FAR 2.5", "上限值", "x"], "FAR 2.5上限值x"), 2: (["x", "50%"][1:] + ["x"], "50%x")}
