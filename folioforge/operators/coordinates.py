"""Tables out of positioned text and drawn lines: visual rows, segments, regions, grids.

items: the columns of ``by`` (which name a page), at (their order), text, x, y, width, height. lines: by, x0, y0, x1, y1. regions:
by, region, x0, y0, x1, y1 and title (or null).

What has to be read in order (rows with a running mean, spans of rows, the merging of continuation rows) is one fold over
the items or rows of a page or region, some hundred; all else are windows, groups and joins by page. What several steps read is written once to the shared
folder. Cells of a grid are texts, empty ones "".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import cells as C
from folioforge.functions import repairs
from folioforge.operators import grids
from folioforge.sources.tables import shared_table

#: What makes a line the title of a table.
TITLE = (
    "(?i)^\\s*(?:Table\\s*\\d+|附表\\s*\\d+|续表|表\\s*[\\d\\u4e00-\\u9fa5]*\\s*[:：]?.*(?:表|一览|结构|面积|明细|统计)|.*(?:配置指标表|配置要求表|代码表|分类表|一览表|结构表|面积表|策略表))"
)
#: How far, in points, things lie apart that still belong together.
ROW_HEIGHTS, LEAST_ROW, GAP_HEIGHTS, LEAST_GAP, NEAR_COLUMN, EDGE, LINE_EDGE, AWAY = 0.7, 6.0, 1.2, 8.0, 24, 2, 3, 4
#: Width of a tabular row, longest line that goes on, sparse rows below and above, rows between title and table, most columns.
TABULAR_WIDTH, LONGEST_LINE, SPARSE_BELOW, SPARSE_ABOVE, TO_TABLE, TO_TABLE_ABOVE, MOST_COLUMNS, TITLE_WORTH = 60, 90, 3, 2, 7, 4, 24, 0.2
MARK = "^[●○]$"
GRID = "array<array<string>>"


def is_title(text: Column) -> Column:
    return text.rlike(TITLE)


def joined(texts: Column) -> Column:
    """Texts with one blank between them."""
    return F.trim(F.regexp_replace(F.array_join(F.filter(texts, lambda t: t != ""), " "), "\\s+", " "))


def visual_rows(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """items with row, from 0 down the page: an item joins the row above while it lies within 0.7 mean heights (6 at least) of its mean."""
    page = F.array_sort(F.collect_list(F.struct("y", "x", "at", "text", "width", "height")))
    pages = items.groupBy(*by).agg(page.alias("items"), F.greatest(F.avg("height") * ROW_HEIGHTS, F.lit(LEAST_ROW)).alias("tolerance"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def add(state: Column, item: Column) -> Column:
        near = (state["row"] >= 0) & (F.abs(item["y"] - state["mean"]) <= F.col("tolerance"))
        row, n = F.when(near, state["row"]).otherwise(state["row"] + 1), F.when(near, state["n"] + 1).otherwise(F.lit(1))
        mean = F.when(near, (state["mean"] * state["n"] + item["y"]) / (state["n"] + 1)).otherwise(item["y"])
        return F.struct(row.alias("row"), mean.alias("mean"), n.alias("n"), F.concat(state["out"], F.array(row)).alias("out"))

    rows = pages.withColumn("rows", F.aggregate("items", start, add, lambda s: s["out"]))
    return rows.select(*by, F.inline(F.arrays_zip("items", "rows"))).select(*by, F.col("rows").alias("row"), "items.*")


def segments(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, row, segment, text, x, y, width, height: items of a row in runs that no gap above 1.2 mean heights (8 at least) cuts."""
    line = Window.partitionBy(*by, "row")
    order = line.orderBy("x", "y", "at")
    reach = F.max(F.col("x") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("x") - reach > F.greatest(F.avg("height").over(line) * GAP_HEIGHTS, F.lit(LEAST_GAP)), F.lit(False))
    cut_rows = rows.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("x", "y", "at", "text")))
    found = cut_rows.groupBy(*by, "row", "segment").agg(parts.alias("parts"), F.max(F.col("x") + F.col("width")).alias("end"), F.max("height").alias("height"))
    first = F.col("parts")[0]
    return found.select(*by, "row", "segment", joined(F.col("parts.text")).alias("text"), first["x"].alias("x"), first["y"].alias("y"), (F.col("end") - first["x"]).alias("width"), "height")


def column_centres(parts: DataFrame, by: Sequence[str], least: int = 2) -> DataFrame:
    """by and columns: where at least ``least`` segments begin, as whole numbers."""
    pages = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("x").cast("double"))).alias("xs"), F.greatest(F.avg("height") * 0.75, F.lit(LEAST_ROW)).alias("tolerance"))
    return pages.select(*by, grids.column_starts(F.col("xs"), F.col("tolerance"), least).alias("columns"))


def nearest(x: Column, columns: Column) -> Column:
    """The place, from 0, of the nearest column within 24; the first of equals, else null."""
    best = F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(x - c).alias("away"), i.alias("place"))))
    return F.when(best["away"] <= NEAR_COLUMN, best["place"])


def merged_rows(rows: Column, like_regions: bool = False) -> Column:
    """Rows of cells; a row with fewer than two cells, or than half the columns, goes into the row before if that has these cells or ends left of them."""
    filled = lambda row: F.size(F.filter(row, lambda c: c != ""))

    def fits(before: Column, row: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(before, lambda c, i: F.when(c != "", i))), F.lit(-1))
        return F.forall(F.arrays_zip(before.alias("a"), row.alias("b"), F.sequence(F.lit(0), F.size(row) - 1).alias("i")), lambda z: (z["b"] == "") | (z["a"] != "") | (z["i"] > last))

    def add(done: Column, row: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        sparse = (filled(row) > 0) & (filled(row) < F.greatest(F.lit(2.0), F.size(row) / 2))
        goes = before.isNotNull() & sparse & fits(before, row) & (F.lit(like_regions) | (filled(before) > 0))
        mended = F.zip_with(before, row, lambda a, b: joined(F.array(a, b)))
        return F.when(goes, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(mended))).otherwise(F.concat(done, F.array(row)))

    return F.aggregate(rows, F.array().cast(GRID), add)


def row_cells(parts: DataFrame, columns: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and rows: the cells of each row, from the top down, in their nearest columns. A region without columns has one."""
    placed = parts.join(columns, list(by)).withColumn("col", nearest(F.col("x"), F.col("columns")))
    cells = placed.groupBy(*by, "row", "col").agg(joined(F.array_sort(F.collect_list(F.struct("segment", "text"))).getField("text")).alias("text"), F.first("columns").alias("columns"))
    lines = cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "text")))).alias("cells"), F.greatest(F.size(F.first("columns")), F.lit(1)).alias("n"))
    row = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit("")))
    return lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", row.alias("cells")))).getField("cells").alias("rows"))


def inside(items: DataFrame, regions: DataFrame, by: Sequence[str]) -> DataFrame:
    """items with the region (and its title) that they lie in, two points wider on all sides."""
    boxes = regions.select(*by, "region", "title", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    found = items.join(boxes, list(by))
    return found.where(F.col("x").between(F.col("bx0") - EDGE, F.col("bx1") + EDGE) & F.col("y").between(F.col("by0") - EDGE, F.col("by1") + EDGE)).drop("bx0", "by0", "bx1", "by1")


def boundaries(lines: DataFrame, regions: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, region, xs and ys: where drawn lines cut a region into columns and rows; regions with fewer than two lines in a direction are left out.

    Lines count from three points around the region on, but not frames of the page. Lines within two points are one. The
    edges of the region close the grid where no line is within four points.
    """
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    usable = ~((wide > 250) & (high > 250)) & ~((F.col("x0") <= 1) & (F.col("y0") <= 1))
    boxes = regions.select(*by, "region", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    near = (F.col("x1") >= F.col("bx0") - LINE_EDGE) & (F.col("x0") <= F.col("bx1") + LINE_EDGE) & (F.col("y1") >= F.col("by0") - LINE_EDGE) & (F.col("y0") <= F.col("by1") + LINE_EDGE)
    found = lines.where(usable).withColumn("flat", wide >= high).join(boxes, list(by)).where(near)
    places = lambda flat, a, b: F.array_sort(F.collect_list(F.when(F.col("flat") == flat, (F.col(a) + F.col(b)) / 2)))
    both = found.groupBy(*by, "region", "bx0", "by0", "bx1", "by1").agg(places(False, "x0", "x1").alias("xs"), places(True, "y0", "y1").alias("ys")).where((F.size("xs") >= 2) & (F.size("ys") >= 2))

    def closed(values: Column, low: Column, high: Column) -> Column:
        kept = F.filter(grids.column_starts(values, F.lit(2.0), 1), lambda v: v.between(low - LINE_EDGE, high + LINE_EDGE))
        first = F.when(F.abs(kept[0] - low) > AWAY, F.array(F.floor(low + 0.5))).otherwise(F.array().cast("array<bigint>"))
        last = F.when(F.abs(F.element_at(kept, -1) - high) > AWAY, F.array(F.floor(high + 0.5))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(kept) > 0, F.concat(first, kept, last)).otherwise(kept)

    cut = both.select(*by, "region", closed(F.col("xs"), F.col("bx0"), F.col("bx1")).alias("xs"), closed(F.col("ys"), F.col("by0"), F.col("by1")).alias("ys"))
    return cut.where((F.size("xs") >= 2) & (F.size("ys") >= 2))


def interval(value: Column, bounds: Column) -> Column:
    """The place, from 0, of the first interval between neighbouring bounds that holds value, two points wider at both ends; else null."""
    holds = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: value.between(a - EDGE, b + EDGE))
    place = F.array_position(holds, True)
    return F.when(place > 0, (place - 1).cast("int"))


def line_cells(items: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, region and grid: texts in the cells that lines cut, by the centre of each; a run of marks is dealt out over the columns that it spans.

    items: those inside a region (with region and title).
    """
    key = [*by, "region"]
    rows = items.where(~F.coalesce(F.trim("text") == F.trim("title"), F.lit(False))).join(bounds, key)
    tokens = F.filter(F.split(F.trim("text"), "\\s+"), lambda t: t != "")
    row = interval(F.col("y") + F.col("height") / 2, F.col("ys"))
    first, last = interval(F.col("x") + 1, F.col("xs")), interval(F.col("x") + F.col("width") - 1, F.col("xs"))
    marks = (F.size("tokens") >= 2) & F.forall("tokens", lambda t: t.rlike(MARK)) & F.col("r").isNotNull() & F.coalesce(F.col("last") >= F.col("first"), F.lit(False))
    rows = rows.withColumn("tokens", tokens).withColumn("r", row).withColumn("first", first).withColumn("last", last)
    span, n = F.col("last") - F.col("first"), F.size("tokens")
    spread = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("piece"), (F.col("first") + F.when(n == span + 1, i).otherwise(F.least(span, F.floor(i * span / (n - 1) + 0.5).cast("int")))).alias("c")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.col("text").alias("piece"), interval(F.col("x") + F.col("width") / 2, F.col("xs")).alias("c")))
    pieces = rows.select(*key, "xs", "ys", "at", "r", F.inline(F.when(marks, spread).otherwise(one))).where("r is not null and c is not null")
    cells = pieces.groupBy(*key, "r", "c").agg(joined(F.array_sort(F.collect_list(F.struct("at", "i", "piece"))).getField("piece")).alias("text"))
    maps = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c").alias("place"), "text"))).alias("cells"))
    grid = F.transform(F.sequence(F.lit(0), F.size("ys") - 2), lambda r: F.transform(F.sequence(F.lit(0), F.size("xs") - 2), lambda c: F.coalesce(F.try_element_at("cells", F.struct(r.alias("r"), c.alias("c"))), F.lit(""))))
    return maps.join(bounds, key).select(*key, grid.alias("grid"))


def table_grids(regions: DataFrame, items: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, region, grid, source (lines or text) and warnings of each region with text: the better of its grid of lines and its grid of text.

    Page numbers and the title's own row are left out. Cells are mended, empty edges and sparse columns go.
    """
    key = [*by, "region"]
    own = inside(items, regions, by).withColumn("page_mark", B.is_page_fragment(F.col("text")))
    marked = own.groupBy(*key).agg(F.max("page_mark").alias("marked"))
    kept = own.where("not page_mark").drop("page_mark")
    rows = shared_table(visual_rows(kept, key))
    titles = regions.select(*key, F.trim("title").alias("title"))
    line = Window.partitionBy(*key, "row").orderBy("x", "y", "at", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = rows.withColumn("line", F.trim(F.array_join(F.collect_list("text").over(line), " "))).join(titles, key).where("title is null or line <> title").drop("title", "line")
    parts = shared_table(segments(named, key))
    text = row_cells(parts, column_centres(parts, key), key).withColumn("text", merged_rows(F.col("rows")))
    below = F.exists(F.sequence(F.lit(2), F.greatest(F.size("text"), F.lit(2))), lambda i: F.exists(F.arrays_zip(F.try_element_at("text", i).alias("a"), F.try_element_at("text", i - 1).alias("b")), lambda z: (z["a"] == "") & (z["b"] != "")))
    text = text.withColumn("spanned", F.coalesce(below, F.lit(False))).withColumn("text", F.filter("text", lambda r: F.exists(r, lambda c: c != "")))
    drawn = line_cells(kept, boundaries(lines, regions, by), by).withColumnRenamed("grid", "drawn")
    both = marked.join(text.drop("rows"), key, "left").join(drawn, key, "left").withColumns({c: F.coalesce(c, F.array().cast(GRID)) for c in ("text", "drawn")})
    both = shared_table(both.select(*key, "marked", "spanned", "text", "drawn"))
    both = shared_table(grids.trimmed_grids(grids.trimmed_grids(both, "text"), "drawn"))
    mended = lambda grid: F.transform(grid, lambda r: F.transform(r, repairs.reordered))
    chosen = grids.chosen_grids(both.withColumns({c: mended(F.col(c)) for c in ("text", "drawn")}), "drawn", "text")
    by_lines = F.col("choice") == "lines"
    warnings = F.array(F.when(by_lines, "line_grid"), F.when(F.col("marked"), "page_footer_removed"), F.when(~by_lines & F.col("spanned"), "rowspan_filled"), F.when(F.col("skipped"), "line_grid_skipped"))
    return chosen.select(*key, F.when(by_lines, F.col("drawn")).otherwise(F.col("text")).alias("grid"), F.col("choice").alias("source"), F.array_compact(warnings).alias("warnings")).where(F.size("grid") > 0)


# --- regions -----------------------------------------------------------------------------------------------------


def page_lines(items: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A row a visual row (row, text, tabular, title, goes_on, box) and the segments of all rows."""
    rows = visual_rows(items, by)
    parts = segments(rows, by)
    texts = F.array_sort(F.collect_list(F.struct("x", "y", "at", "text")))
    box = F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    lines = rows.groupBy(*by, "row").agg(F.trim(F.array_join(texts.getField("text"), " ")).alias("text"), box.alias("box"))
    lines = lines.join(parts.groupBy(*by, "row").agg(F.count("*").alias("n")), [*by, "row"])
    title = is_title(F.col("text"))
    wide = (F.col("box.x1") - F.col("box.x0")) >= TABULAR_WIDTH
    goes_on = (F.col("text") != "") & ~title & (F.length("text") <= LONGEST_LINE)
    return lines.select(*by, "row", "text", ((F.col("n") >= 2) & wide).alias("tabular"), title.alias("title"), goes_on.alias("goes_on"), "box"), parts


def _reach(rows: Column, first: Column, step: int, sparse: int, stops: bool = True) -> Column:
    """The row behind the last one of a table that is read from ``first`` on, down (step 1) or up (-1): tabular rows, and sparse rows in between, so many in a row at most."""
    n = F.size(rows)
    order = F.when(first.between(0, n - 1), F.sequence(first, n - 1 if step > 0 else F.lit(0), F.lit(step))).otherwise(F.array().cast("array<int>"))
    at = lambda i: rows[i.cast("int")]
    start = F.struct(F.lit(False).alias("over"), F.lit(0).alias("gap"), first.cast("int").alias("end"))

    def add(state: Column, i: Column) -> Column:
        row, near = at(i), F.coalesce(F.when((i + step).between(0, n - 1), at(i + step)["tabular"]), F.lit(False))
        bridged = (state["gap"] < sparse) & (near | row["goes_on"])
        goes = ~state["over"] & ~(F.lit(stops) & row["title"]) & (row["tabular"] | bridged)
        gap = F.when(row["tabular"], 0).otherwise(state["gap"] + 1)
        on = F.struct(F.lit(False).alias("over"), gap.alias("gap"), (i + step).cast("int").alias("end"))
        return F.when(goes, on).otherwise(F.struct(F.lit(True).alias("over"), state["gap"].alias("gap"), state["end"].alias("end")))

    return F.aggregate(order, start, add, lambda s: s["end"])


def _tabular(rows: Column, start: Column, end: Column) -> Column:
    return F.size(F.filter(rows, lambda r, i: (i >= start) & (i < end) & r["tabular"]))


def _taken(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the column name, where value isn't null; a generator, as a filter or expression on a plain column would take value anew at each mention."""
    return rows.select("*", F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))


def titled_spans(pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, title_row, below, first and end: rows of tables below (from up to six lines after it) and above (four) each title. pages: by, rows."""
    rows = F.col("rows")
    n = F.size("rows")
    titles = pages.select(*by, "rows", F.explode(F.filter(F.transform("rows", lambda r, i: F.when(r["title"], i)), lambda i: i.isNotNull())).alias("title_row"))
    t = F.col("title_row")
    place = lambda low, high, best: best(F.transform("rows", lambda r, i: F.when(r["tabular"] & i.between(low, high), i)))
    down = _taken(titles.withColumn("below", F.lit(True)), "first", place(t + 1, t + TO_TABLE, F.array_min))
    down = _taken(down, "end", _reach(rows, F.col("first") + 1, 1, SPARSE_BELOW))
    last = F.coalesce(place(t - TO_TABLE_ABOVE - 1, t - 1, F.array_max) + 1, F.greatest(t - TO_TABLE_ABOVE, F.lit(0)))
    up = _taken(titles.withColumn("below", F.lit(False)), "end", last)
    up = _taken(up, "first", _reach(rows, F.col("end") - 1, -1, SPARSE_ABOVE) + 1)
    found = down.unionByName(up).where(_tabular(rows, F.col("first"), F.col("end")) >= 2)
    return found.select(*by, "title_row", "below", "first", "end")


def untitled_spans(pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, first and end: runs of rows in several columns that begin outside of other regions. pages: by, rows (with tabular for several columns), used (rows of regions)."""
    n = F.size("rows")
    start = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("gap"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        i, row = x["i"], x["row"]
        open_ = state["first"] >= 0
        near = F.coalesce(F.when(i + 1 < n, F.col("rows")[(i + 1).cast("int")]["tabular"]), F.lit(False))
        goes = row["tabular"] | ((state["gap"] < SPARSE_BELOW) & (near | row["goes_on"]))
        begins = ~open_ & row["tabular"] & ~F.array_contains("used", i)
        ended = F.concat(state["spans"], F.array(F.struct(state["first"].alias("first"), i.alias("end"))))
        return F.struct(
            F.when(open_ & goes, state["first"]).when(begins, i).otherwise(-1).alias("first"),
            F.when(open_ & goes & ~row["tabular"], state["gap"] + 1).otherwise(0).alias("gap"),
            F.when(open_ & ~goes, ended).otherwise(state["spans"]).alias("spans"),
        )

    numbered = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.alias("row")))
    closed = F.aggregate(numbered, start, add, lambda s: F.when(s["first"] >= 0, F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), n.alias("end"))))).otherwise(s["spans"]))
    found = pages.select(*by, "rows", F.inline(closed))
    return found.where(_tabular(F.col("rows"), F.col("first"), F.col("end")) >= 3).select(*by, "first", "end")


def _kept(spans: DataFrame, lines: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """spans (by, title_row or null, below, first, end) that are tables by their confidence, with box, title, score and reasons."""
    key = [*by, "title_row", "below", "first", "end"]
    spans = spans.withColumn("span", F.concat_ws("-", F.coalesce(F.col("title_row"), F.lit(-1)), "below", "first"))
    own = [*by, "span"]
    held = parts.join(spans.select(*own, "first", "end"), list(by)).where("row >= first and row < end").drop("first", "end")
    columns = column_centres(held, own).where(F.size("columns").between(2, MOST_COLUMNS))
    judged = row_cells(held, columns, own).select(*own, C.table_confidence(merged_rows(F.col("rows"), True)).alias("c"))
    boxes = lines.join(spans, list(by)).where("(row >= first and row < end) or row = title_row")
    side = {f: getattr(F, "min" if f.endswith("0") else "max")(F.col(f"box.{f}")).alias(f) for f in ("x0", "y0", "x1", "y1")}
    boxed = boxes.groupBy(*own).agg(*side.values(), F.max(F.when(F.col("row") == F.col("title_row"), F.col("text"))).alias("title"))
    rows = spans.join(judged, own).join(boxed, own)
    titled = F.col("title_row").isNotNull()
    score = F.least(F.lit(1.0), F.col("c.score") + F.when(titled, TITLE_WORTH).otherwise(0.0))
    no_grid = ~F.array_contains("c.negatives", "looks_like_prose_grid")
    table = no_grid & ((F.size("c.candidates") > 0) | F.array_contains("c.reasons", "stable_2d_grid") | (score >= 0.3))
    kept = rows.where(table & (titled | (F.size("c.candidates") > 0) | (F.col("c.score") >= 0.5)))
    reasons = F.when(titled, F.concat("c.reasons", F.array(F.lit("table_title")))).otherwise(F.col("c.reasons"))
    return kept.select(*key, "x0", "y0", "x1", "y1", "title", F.round(score, 6).alias("confidence"), reasons.alias("reasons"))


def regions(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, region (from 0), x0, y0, x1, y1, title, continued, confidence and reasons of the tables of each page: around titles, then elsewhere."""
    lines, parts = map(shared_table, page_lines(items, by))
    page = F.array_sort(F.collect_list(F.struct("row", "tabular", "title", "goes_on")))
    pages = lines.groupBy(*by).agg(page.alias("rows"))
    titled = shared_table(_kept(shared_table(titled_spans(pages, by)), lines, parts, by))
    used = titled.groupBy(*by).agg(F.flatten(F.collect_list(F.concat(F.array("title_row"), F.sequence(F.col("first"), F.col("end") - 1)))).alias("used"))
    columns = column_centres(parts, by, 3).where(F.size("columns").between(2, MOST_COLUMNS))
    spread = parts.join(columns, list(by)).groupBy(*by, "row").agg((F.count_distinct(nearest(F.col("x"), F.col("columns"))) >= 2).alias("several"))
    several = lines.join(spread, [*by, "row"]).drop("tabular").withColumnRenamed("several", "tabular").groupBy(*by).agg(page.alias("rows"))
    open_ = several.join(used, list(by), "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    alone = untitled_spans(open_, by).withColumn("title_row", F.lit(None).cast("int")).withColumn("below", F.lit(True))
    found = titled.unionByName(_kept(shared_table(alone), lines, parts, by))
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last("title_row"), F.desc("below"), "first")
    continued = F.coalesce(F.contains("title", F.lit("续表")), F.lit(False))
    return found.withColumn("region", F.row_number().over(order) - 1).select(*by, "region", "x0", "y0", "x1", "y1", "title", continued.alias("continued"), "confidence", "reasons")


# --- glyphs ------------------------------------------------------------------------------------------------------

#: How far a glyph's centre may lie outside of its cell, what parts lines and words, and marks that no blank stands before or after.
PAD, LINE_HEIGHTS, LEAST_LINE, WORD_WIDTHS, LEAST_WORD = 0.8, 0.92, 6.0, 0.55, 2.2
NO_BLANK_BEFORE, NO_BLANK_AFTER = "，。；：、,.!?;:%)]}）】》", "([({（【《"
#: Points of a square that glyphs and cells meet in.
SQUARE = 64


def glyphs_in_cells(glyphs: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, cell and the glyph's columns for each cell that holds its centre. glyphs: by, text, x0, y0, x1, y1; cells: by, cell, x0, y0, x1, y1.

    A glyph is in one square of the page and meets the cells that reach into it, so the work grows with the glyphs.
    """
    square = lambda v: F.floor(v / SQUARE)
    spread = lambda low, high: F.explode(F.sequence(square(F.col(low) - PAD), square(F.col(high) + PAD)))
    boxes = cells.where("x1 >= x0 and y1 >= y0").select(*by, "cell", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    boxes = boxes.withColumn("sx", spread("bx0", "bx1")).withColumn("sy", spread("by0", "by1"))
    middle = glyphs.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    found = middle.withColumn("sx", square(F.col("cx"))).withColumn("sy", square(F.col("cy"))).join(boxes, [*by, "sx", "sy"])
    inside_ = F.col("cx").between(F.col("bx0") - PAD, F.col("bx1") + PAD) & F.col("cy").between(F.col("by0") - PAD, F.col("by1") + PAD)
    return found.where(inside_).select(*by, "cell", "text", "x0", "y0", "x1", "y1")


def cell_texts(glyphs: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, cell, lines (their texts, from the top down) and text (mended) of each cell with glyphs.

    A glyph begins a new line where its top is more than 0.92 mean heights (6 at least) below that line's first; a blank goes
    where a gap is above 0.55 mean widths of the line (2.2 at least), but not beside Chinese characters and marks.
    """
    key = [*by, "cell"]
    held = F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "text")))
    whole = glyphs_in_cells(glyphs, cells, by).groupBy(*key).agg(held.alias("glyphs"), F.greatest(F.avg(F.greatest(F.col("y1") - F.col("y0"), F.lit(0.1))) * LINE_HEIGHTS, F.lit(LEAST_LINE)).alias("tolerance"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.array().cast("array<int>").alias("out"))

    def add(state: Column, g: Column) -> Column:
        same = (state["line"] >= 0) & (F.abs(g["y0"] - state["top"]) <= F.col("tolerance"))
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, state["top"]).otherwise(g["y0"]).alias("top"), F.concat(state["out"], F.array(line)).alias("out"))

    rows = whole.withColumn("lines", F.aggregate("glyphs", start, add, lambda s: s["out"]))
    rows = rows.select(*key, F.inline(F.arrays_zip("glyphs", "lines"))).select(*key, F.col("lines").alias("line"), "glyphs.*")
    width = F.avg(F.greatest(F.col("x1") - F.col("x0"), F.lit(0.1))).over(Window.partitionBy(*key, "line"))
    order = Window.partitionBy(*key, "line").orderBy("x0", "y0", "text")
    rows = rows.withColumn("width", width).where(F.coalesce("text", F.lit("")) != "")
    end, before = F.lag("x1").over(order), F.substring(F.lag("text").over(order), -1, 1)
    own = F.substring("text", 1, 1)
    marks = lambda c, listed: F.contains(F.lit(listed), c)
    chinese = lambda c: c.rlike("[一-鿿]")
    close = marks(own, NO_BLANK_BEFORE) | marks(before, NO_BLANK_AFTER) | chinese(own) | chinese(before) | (before.rlike("[0-9]") & own.isin("%", "％"))
    blank = F.coalesce((F.col("x0") - end > F.greatest(F.col("width") * WORD_WIDTHS, F.lit(LEAST_WORD))) & ~close, F.lit(False))
    pieces = rows.withColumn("piece", F.concat(F.when(blank, " ").otherwise(""), "text"))
    lines = pieces.groupBy(*key, "line").agg(F.trim(F.array_join(F.array_sort(F.collect_list(F.struct("x0", "y0", "text", "piece"))).getField("piece"), "")).alias("text"))
    found = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).getField("text").alias("lines"))
    return found.withColumn("text", repairs.cell_text(F.array_join("lines", "")))
