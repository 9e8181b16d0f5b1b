"""Contexts for answers: records and rows of tables as text, blocks of a prompt, and blocks of pages put together from two readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.rules import trimmed
from folioforge.functions.text import exact_key

#: Headers that come first where a table is wide, and the boosts of the keys of each kind of record.
IMPORTANT = "代码|编号|名称|类别|层级|指标|面积|数量|要求|内容|说明|服务规模|服务半径"
KEY_BOOSTS = {
    "regulation_clause": {"clause_no": 3.0, "clause_title": 1.6}, "structured_table": {"table_no": 2.8, "table_title": 2.2}, "structured_table_row": {"table_no": 2.2, "table_title": 1.3, "row_key": 2.6},
    "classification_code": {"code": 3.2, "name": 2.6, "parent_code": 1.3}, "indicator_item": {"item_name": 2.8, "indicator_name": 1.7}, "definition": {"term": 2.8}, "deliverable_requirement": {"item_title": 2.4},
    "drawing_requirement": {"drawing_name": 2.4}, "checklist_item": {"list_name": 1.5, "item_title": 2.4},
}
TITLE_BOOST, KEYWORD_BOOST, ALIAS_BOOST = 1.4, 1.2, 1.5
#: What table cells read as prose look like, and what clauses do.
FRAGMENT_UNITS, CLAUSE_LIKE = "平方米|千人指标|规模性指标|用地面积|建筑面积|服务规模", "(?:[0-9]+\\.[0-9]+(?:\\.[0-9]+)?|第[一二三四五六七八九十百千零〇0-9]+条)\\s*[一-龥]"
SALVAGED = "(?:[0-9]+\\.[0-9]+(?:\\.[0-9]+)?|第[一二三四五六七八九十百千零〇0-9]+条)[^。；]{4,140}[。；]"
WATERMARKS = "(?i)^(?:机密|内部使用|草稿|仅供内部|验收|DRAFT|CONFIDENTIAL|PROPRIETARY|FOR INTERNAL USE|公章|防伪|已失效|样本|示意|非正式|试用版)$"


def _lines(*parts: Column | str) -> Column:
    """The parts that are neither null nor empty, a line each."""
    each = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*each), lambda x: x.isNotNull() & (x != "")), "\n")


def _named(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


def clause_context(number: Column, level: Column, section: Column, first: Column, last: Column, content: Column) -> Column:
    pages = F.when(first > 0, F.concat(F.lit("来源页码：第"), first.cast("string"), F.lit("-"), F.coalesce(last, first).cast("string"), F.lit("页")))
    return _lines(F.concat(F.lit("条文："), number), F.concat(F.lit("约束等级："), F.coalesce(level, F.lit("unknown"))), _named("章节：", section), pages, content)


def indicator_context(item: Column, name: Column, values: Column, unit: Column, level: Column, scale: Column, table: Column) -> Column:
    shown = F.array_join(F.filter(values, lambda v: v != ""), "；")
    return _lines(F.concat(F.lit("指标对象："), item), _named("指标名称：", name), _named("指标值：", shown), _named("单位：", unit), _named("适用层级：", level), _named("服务规模：", scale), _named("来源表格：", table))


def deliverable_context(item: Column, kind: Column, mandatory: Column, stage: Column, text: Column, section: Column) -> Column:
    must = F.when(mandatory, "是否必选：是").when(~mandatory, "是否必选：否")
    return _lines(F.concat(F.lit("成果项："), item), _named("成果类型：", kind), must, _named("阶段：", stage), F.concat(F.lit("要求："), text), _named("来源章节：", section))


def prompt_block(index: Column, file_name: Column, section: Column, article: Column, page: Column, structured: Column, content: Column) -> Column:
    """One piece of context: where it is from, what is known about it, and its text without page marks and runs of blanks."""
    meta = F.array(F.concat(F.lit("片段["), index.cast("string"), F.lit("]")), F.concat(F.lit("文件："), file_name), _named("章节：", section), _named("条款：", article), F.concat(F.lit("页码：第"), page.cast("string"), F.lit("页")))
    clean = content
    for pattern, other in (("—[0-9]+—", ""), ("\\[\\[page:[0-9]+\\]\\]", ""), ("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n")):
        clean = F.regexp_replace(clean, pattern, other)
    known = F.coalesce(F.concat(F.lit("\nstructured_metadata:\n"), F.nullif(structured, F.lit(""))), F.lit(""))
    return F.concat(F.array_join(F.filter(meta, lambda m: m.isNotNull()), " | "), known, F.lit("\n原文："), trimmed(clean))


def table_subsets(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, rows and text: the rows of each table as Markdown, with eight columns at most, those that matter first.

    rows: by, row_index, names (headers in order), fields, table_no, table_title, page_start, page_end.
    """
    item = F.struct("names", F.map_entries("fields").alias("entries"), "table_no", "table_title", "page_start", "page_end")
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("row_index", item.alias("x")))).alias("r"))
    first = F.get(F.col("r"), F.lit(0))["x"]
    filled = lambda r: F.filter(F.array_distinct(r["x"]["names"]), lambda n: F.exists(r["x"]["entries"], lambda e: e["key"] == n))
    every = F.array_distinct(F.flatten(F.transform("r", filled)))
    weighty = F.filter(every, lambda h: h.rlike(IMPORTANT))
    headers = F.when(F.size(every) <= 8, every).otherwise(F.slice(F.when(F.size(weighty) > 0, weighty).otherwise(every), 1, 8))
    title = F.array_join(F.filter(F.array(F.concat(F.lit("表"), first["table_no"]), first["table_title"]), lambda x: x.isNotNull()), " ")
    pages = F.when((first["page_start"] > 0) & (first["page_end"] > 0), F.concat(F.lit("（第"), first["page_start"].cast("string"), F.lit("-"), first["page_end"].cast("string"), F.lit("页）"))).otherwise("")
    cell = lambda r, h: F.coalesce(F.get(F.transform(F.filter(r["x"]["entries"], lambda e: e["key"] == h), lambda e: trimmed(F.regexp_replace(F.replace(e["value"], F.lit("|"), F.lit("\\|")), "\\n", " "))), F.lit(0)), F.lit(""))
    with_headers = grouped.withColumn("headers", headers)
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform("r", lambda r: row(F.transform("headers", lambda h: cell(r, h))))
    head = F.concat(F.lit("### "), F.when(title != "", title).otherwise("表格子集"), pages)
    text = F.concat_ws("\n", head, row(F.col("headers")), row(F.transform("headers", lambda h: F.lit("---"))), F.array_join(body, "\n"))
    return with_headers.select(*by, F.size("r").alias("rows"), text.alias("text"))


def object_keys(objects: DataFrame) -> DataFrame:
    """object_id, field, normal_key and boost of each record's exact keys: title, keywords, aliases, and those of its kind.

    objects: object_id, object_type, title, keywords, aliases and the columns of KEY_BOOSTS that there are.
    """
    none = F.array().cast("array<string>")
    entry = lambda field, boost: (lambda key: F.struct(F.lit(field).alias("field"), key.alias("key"), F.lit(boost).alias("boost")))
    found = [F.array(entry("title", TITLE_BOOST)(F.col("title"))), F.transform(F.coalesce("keywords", none), entry("keyword", KEYWORD_BOOST)), F.transform(F.coalesce("aliases", none), entry("alias", ALIAS_BOOST))]
    for kind, fields in KEY_BOOSTS.items():
        own = [F.when(F.col("object_type") == kind, entry(name, boost)(F.col(name))) for name, boost in fields.items() if name in objects.columns]
        found += [F.array(x) for x in own]
    rows = objects.select("object_id", F.explode(F.filter(F.concat(*found), lambda e: e.isNotNull() & (trimmed(e["key"]) != ""))).alias("e"))
    return rows.select("object_id", "e.field", exact_key(F.col("e.key")).alias("normal_key"), "e.boost").distinct()


def is_fragment(text: Column) -> Column:
    """Whether a text reads like cells of a table in a row: long numbers, marks in clusters, or units among numbers."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return text.rlike("[0-9]{5,}") | text.rlike("([、，/／·]\\s+){3,}") | ((count(FRAGMENT_UNITS) >= 3) & (count("[0-9]") >= 8))


def without_fragments(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks (doc_id, page, text) but for fragments, other than clauses, on pages that have a table (doc_id, page)."""
    pages = tables.select("doc_id", "page", F.lit(True).alias("has_table")).distinct()
    rows = blocks.join(pages, ["doc_id", "page"], "left")
    gone = F.coalesce("has_table", F.lit(False)) & is_fragment(F.col("text")) & ~F.col("text").rlike(CLAUSE_LIKE)
    return rows.where(~gone).drop("has_table")


def salvaged(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page and text of clauses in the raw text of pages with tables (doc_id, page, text) that no block holds yet.

    A clause is known if its first 16 characters stand in a block of its document; each counts where it first occurs. Blocks
    are only compared with clauses of their own document.
    """
    each = pages.select("doc_id", "page", F.explode(F.regexp_extract_all("text", F.lit(SALVAGED), F.lit(0))).alias("s"))
    each = each.select("doc_id", "page", trimmed(F.regexp_replace("s", "\\s+", " ")).alias("s")).where((F.length("s") >= 10) & ~is_fragment(F.col("s")))
    first = each.groupBy("doc_id", "s").agg(F.min("page").alias("page"))
    known = first.join(blocks.select("doc_id", "text"), "doc_id").where(F.contains("text", F.substring("s", 1, 16))).select("doc_id", "s").distinct()
    return first.join(known, ["doc_id", "s"], "left_anti").select("doc_id", "page", F.col("s").alias("text"))


def in_page_order(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of both readers (doc_id, page, i, text) with their place in the document: by page, texts before tables, then as they were."""
    both = texts.withColumn("lane", F.lit(0)).unionByName(tables.withColumn("lane", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "lane", "i")))


def without_watermarks(items: DataFrame) -> DataFrame:
    """items (doc_id, page, text, b, c, height) but for watermarks: their words, another rotation than the page's, or short and very high.

    A page's rotation is the upper median of its items', from counts by value; its height the mean of items that are turned alike.
    """
    page = ["doc_id", "page"]
    shown = items.where(trimmed(F.col("text")) != "")

    def median(name: str) -> DataFrame:
        counts = shown.groupBy(*page, name).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*page)
        upto = counts.withColumn("upto", F.sum("n").over(w.orderBy(name))).withColumn("all", F.sum("n").over(w))
        return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*page).agg(F.min(name).alias(f"main_{name}"))

    turned = median("b").join(median("c"), page)
    upright = shown.join(turned, page).where(F.abs(F.col("b") - F.col("main_b")) < 3).groupBy(*page).agg(F.avg("height").alias("mean"))
    rows = items.join(turned, page, "left").join(upright, page, "left")
    main_b, main_c, mean = F.coalesce("main_b", F.lit(0.0)), F.coalesce("main_c", F.lit(0.0)), F.coalesce("mean", F.lit(10.0))
    limit = F.greatest(mean * 0.8, F.lit(3.0))
    text = trimmed(F.coalesce("text", F.lit("")))
    mark = text.rlike(WATERMARKS) | (F.abs(F.col("b") - main_b) > limit) | (F.abs(F.col("c") - main_c) > limit) | ((mean > 0) & (F.col("height") > 4 * mean) & (F.length(text) <= 6))
    return rows.where(~mark).select(*items.columns)


def titled_regions(regions: DataFrame, captions: DataFrame, reach: float = 90.0) -> DataFrame:
    """regions (doc_id, page, region, y0, y1) with the nearest caption (doc_id, page, seq, y, bottom, text) within reach; ties to the first."""
    both = regions.join(captions, ["doc_id", "page"], "left")
    above, below = F.col("y0") - F.col("bottom"), F.col("y") - F.col("y1")
    distance = F.when(F.col("y") < F.col("y0"), above).when(F.col("y") > F.col("y1"), below).otherwise(F.least(F.abs(F.col("y") - F.col("y0")), F.abs(F.col("y") - F.col("y1"))))
    near = F.when(distance <= reach, F.struct(distance.alias("d"), F.col("seq"), F.col("text")))
    return both.groupBy("doc_id", "page", "region").agg(F.min(near)["text"].alias("title"))


def chosen_reader(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """by, and whether the first of two sets of tables (see records.table_set) is kept: four fifths of the other's tables, rows and width, and not much emptier."""
    a, b = first.alias("a"), second.alias("b")
    enough = [F.col(f"a.{c}") >= 0.8 * F.col(f"b.{c}") for c in ("tables", "total_rows", "widest")]
    return a.join(b, by).select(by, (enough[0] & enough[1] & enough[2] & (F.col("a.empty_cell_rate") <= F.col("b.empty_cell_rate") + 0.15)).alias("keep_first"), (F.col("a.total_rows") - F.col("b.total_rows")).alias("more_rows"))
