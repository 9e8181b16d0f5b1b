"""Records out of tables: rows with fields, indicators, quality of tables and rows, search inside a table, slices, preferred evidence.

Tables are rows of doc_id, table_id, title, headers and rows (arrays); everything is an expression over one table, so nothing
but look-ups by table is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import cells as C
from folioforge.functions import evidence as E
from folioforge.functions import rules as R
from folioforge.functions.text import search_tokens
from folioforge.operators.tables import row_fields


def structured_rows(tables: DataFrame) -> DataFrame:
    """A record for each row of a table: row_index, row_key, fields, content, and type, confidence, number and title of its table."""
    names = F.transform(C.flat_headers(F.col("headers")), lambda h: h["name"])
    typed = tables.withColumn("names", names).withColumn("class", C.table_class(F.col("title"), F.col("headers"), F.col("rows")))
    rows = typed.select("doc_id", "table_id", "title", "names", "class", F.posexplode("rows").alias("row_index", "row"))
    rows = rows.withColumn("fields", row_fields(F.col("names"), F.col("row"))).withColumn("row_key", C.row_key(F.col("row"), F.col("names")))
    return rows.select(
        "doc_id", "table_id", "row_index", "row_key", "names", "fields", B.row_sentence(F.array_distinct("names"), F.col("fields")).alias("content"), C.table_number(F.col("title")).alias("table_no"), C.table_title(F.col("title")).alias("table_title"),
        F.col("class.table_type").alias("table_type"), F.col("class.confidence").alias("confidence"),
    )


def table_texts(rows: DataFrame) -> DataFrame:
    """doc_id, table_id, parent and summary: a table's head as text, and its head, size and first twelve keys. rows: of ``structured_rows``."""
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("row_key") != "", F.struct("row_index", "row_key")))), lambda x: x["row_key"])
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("table_title", "table_no", "table_type", "names")]
    found = rows.groupBy("doc_id", "table_id").agg(*same, F.count("*").alias("n"), keys.alias("keys"))
    head = F.concat(F.lit("表头："), F.array_join("names", " | "))
    parent = F.concat_ws("\n", "table_title", F.concat(F.lit("表号："), F.col("table_no")), F.concat(F.lit("表格类型："), F.col("table_type")), head)
    first = F.when(F.size("keys") > 0, F.concat(F.lit("主要行："), F.array_join(F.slice("keys", 1, 12), "；")))
    summary = F.concat_ws("\n", "table_title", F.concat(F.lit("表格摘要：共"), F.col("n").cast("string"), F.lit("行")), head, first)
    return found.select("doc_id", "table_id", parent.alias("parent"), summary.alias("summary"))


def indicators(rows: DataFrame) -> DataFrame:
    """Rows of ``structured_rows`` with a number under a header that may hold one: item, level, service scale, values, unit, confidence."""
    named = lambda pattern: F.get(F.filter("names", lambda n: n.rlike(pattern) & F.map_contains_key("fields", n)), F.lit(0))
    field = lambda pattern: F.try_element_at("fields", named(pattern))
    filled = F.filter(F.array_distinct("names"), lambda n: F.map_contains_key("fields", n))
    cells = F.transform(filled, lambda n: F.struct(n.alias("header"), C.normal_cell(F.try_element_at("fields", n), n).alias("cell")))

    def counts(x):
        cell = x["cell"]
        return (x["header"].rlike(C.INDICATOR_HEADER) | (cell["kind"] != "text")) & (cell["value"].isNotNull() | cell["min"].isNotNull() | cell["max"].isNotNull())

    fits = (F.col("table_type") == "indicator_table") | F.exists("names", lambda n: n.rlike(C.INDICATOR_HEADER))
    values = F.transform(F.filter(cells, counts), lambda x: x["cell"])
    item = F.coalesce(field(C.ITEM_HEADER), F.nullif("row_key", F.lit("")))
    # a generator, as a filter would take values anew and be carried below the columns that it needs
    found = F.filter(F.array(F.struct(item.alias("item"), F.when(fits, values).alias("values"))), lambda x: (F.size(x["values"]) > 0) & x["item"].isNotNull())
    found = rows.select(*rows.columns, F.inline(found))
    return found.select(
        "doc_id", "table_id", "row_index", "item", field(C.LEVEL_HEADER).alias("level"), field(C.CATEGORY_HEADER).alias("category"), field(C.SCALE_HEADER).alias("service_scale"), named(C.INDICATOR_HEADER).alias("indicator"), "values",
        F.get(F.filter(F.transform("values", lambda v: v["unit"]), lambda u: u.isNotNull()), F.lit(0)).alias("unit"), F.when(F.col("table_type") == "indicator_table", 0.88).otherwise(0.68).alias("confidence"),
    )


def row_quality(rows: DataFrame, cells: str = "cells", content: str = "content") -> DataFrame:
    """rows with low_fidelity, warnings and categories, from each of their cells (an array) and their text."""
    each = F.transform(F.filter(F.concat(F.col(cells), F.array(content)), lambda t: R.trimmed(t) != ""), lambda t: R.evidence_quality(F.lit("table_row"), t))
    gathered = lambda name: F.array_distinct(F.flatten(F.transform("quality", lambda q: q[name])))
    out = rows.withColumn("quality", each).withColumn("warnings", gathered("warnings")).withColumn("categories", gathered("categories"))
    return out.withColumn("low_fidelity", F.size("warnings") > 0).drop("quality")


def suppressed_tables(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, rows and suppressed: whether a table isn't shown because one of its rows is flagged."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("low_fidelity").alias("flagged"), F.bool_or("low_fidelity").alias("suppressed"))


def parse_quality(tables: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares over all tables of a group: rows, headers, empty headers, missing titles, flagged cells and tables."""
    empty = F.size(F.filter("headers", lambda h: R.trimmed(h) == ""))
    flagged = F.size(F.filter(F.flatten("rows"), lambda c: F.size(R.evidence_quality(F.lit("table_row"), c)["warnings"]) > 0))
    scrambled = F.size(F.filter(F.flatten("rows"), lambda c: R.evidence_quality(F.lit("table_row"), c)["blocks_answer"]))
    untitled = F.coalesce(R.trimmed(F.col("title")) == "", F.lit(True))
    sums = tables.select(*by, F.size("rows").alias("r"), F.size("headers").alias("h"), empty.alias("e"), untitled.alias("u"), flagged.alias("f"), scrambled.alias("s"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return sums.groupBy(*by).agg(
        F.count("*").alias("tables"), F.sum("r").alias("rows"), F.sum("h").alias("header_cells"), F.sum("e").alias("empty_headers"), share(F.sum("e"), F.sum("h")).alias("empty_header_ratio"), F.count_if("u").alias("untitled"),
        share(F.count_if("u"), F.count("*")).alias("untitled_ratio"), F.sum("f").alias("flagged_cells"), F.count_if(F.col("f") > 0).alias("flagged_tables"), F.sum("s").alias("scrambled_cells"),
    )


def table_set(tables: DataFrame, by: list[str]) -> DataFrame:
    """tables, rows, widest effective table, share of empty cells and tables without headers of each set of tables."""
    columns = F.array_max(F.transform("rows", F.size))
    filled = lambda c: F.size(F.filter("rows", lambda r: R.trimmed(F.coalesce(F.get(r, c), F.lit(""))) != ""))
    places = F.sequence(F.lit(0), columns - 1)
    effective = F.size(F.filter(places, lambda c: filled(c) >= 2))
    full = F.aggregate(F.transform(places, filled), F.lit(0), lambda t, x: t + x)
    headless = F.exists(F.get(F.col("rows"), F.lit(0)), lambda c: R.trimmed(c) == "")
    sums = tables.select(*by, F.size("rows").alias("r"), effective.alias("e"), (columns * F.size("rows")).alias("cells"), full.alias("full"), headless.alias("m"))
    return sums.groupBy(*by).agg(
        F.count("*").alias("tables"), F.sum("r").alias("total_rows"), F.max("e").alias("widest"), F.round(1 - F.sum("full") / F.sum("cells"), 4).alias("empty_cell_rate"), F.count_if("m").alias("headless")
    )


def rows_in_table(questions: DataFrame, rows: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """The rows of a table that share most tokens with the question about it, counting repeats; ties in row order.

    questions: by, question_id, question. rows: by, row_index, row_type, low_fidelity, search_text. Joined by table.
    """
    asked = questions.withColumn("asked", F.array_distinct(search_tokens(F.col("question"))))
    open_rows = rows.where((F.col("row_type") == "data") & ~F.col("low_fidelity")).withColumn("tokens", search_tokens(F.col("search_text")))
    score = F.size(F.filter("tokens", lambda t: F.array_contains("asked", t)))
    # a few bytes of a file are a whole question here: what looks small enough to broadcast isn't
    scored = asked.join(open_rows.hint("merge"), by).withColumn("score", score).where("score > 0")
    order = Window.partitionBy("question_id", *by).orderBy(F.desc("score"), "row_index")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("question_id", *by, "row_index", "score", "rank")


def significant_slices(hits: DataFrame, question: str, table: list[str], share: float = 0.6) -> DataFrame:
    """question, table and the rows hit, in order of rank: hits of at least ``share`` of the best score of the question."""
    best = hits.groupBy(question).agg(F.max("score").alias("best"))
    strong = hits.join(best, question).where(F.col("score") >= share * F.col("best"))
    first = strong.groupBy(question, *table, "row_id").agg(F.min("rank").alias("rank"))
    order = F.array_sort(F.collect_list(F.struct("rank", "row_id")))
    return first.groupBy(question, *table).agg(F.transform(order, lambda x: x["row_id"]).alias("row_ids"), F.min("rank").alias("first_rank"))


def preferred(citations: DataFrame, question: str = "question_id") -> DataFrame:
    """citations (question_id, rank, question, chunk_type, excerpt, review) that are kept, with their place.

    Clean deliverables alone where drawings are asked for; else, where a clean structured excerpt answers the question, the
    clean ones, by scale if services are asked for; else all.
    """
    lines = E.useful_lines(F.col("excerpt"), F.col("review"))
    rows = citations.withColumn("lines", lines).withColumn("clean", ~F.col("review"))
    rows = rows.withColumn("answers", (F.size("lines") >= 2) & (E.evidence_score(F.col("lines"), F.col("question")) > 0)).withColumn("deliverable", F.col("clean") & (F.col("chunk_type") == "deliverable"))
    every = Window.partitionBy(question)
    any_ = lambda c: F.max(F.col(c).cast("int")).over(every) == 1
    drawings = R.trimmed(F.col("question")).rlike(E.DRAWINGS) & any_("deliverable")
    only_clean = any_("answers") & any_("clean")
    rows = rows.withColumn("keep", F.when(drawings, F.col("deliverable")).when(only_clean, F.col("clean")).otherwise(True)).withColumn("by_scale", ~drawings & only_clean & R.trimmed(F.col("question")).rlike(E.SERVICE))
    order = Window.partitionBy(question).orderBy(F.when(F.col("by_scale"), E.order_value(F.col("lines"))).otherwise(0.0), "rank")
    return rows.where("keep").withColumn("place", F.row_number().over(order)).drop("lines", "clean", "answers", "deliverable", "keep", "by_scale")


def cleaned_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, block_index, type, heading_pattern, text) without contents pages, running headers and footers, and page numbers.

    A page with four text blocks or more, half of them ending in leaders and a number, is a contents page. A short text on
    three pages or more, and on three tenths of a document's pages, is a header or footer, unless it is a heading by pattern.
    """
    textual = F.col("type").isin("paragraph", "list_item", "heading")
    leaders = textual & F.col("text").rlike("[.．·…]{3,}\\s*[0-9]{1,4}\\s*$")
    pages = blocks.groupBy("doc_id", "page").agg(F.count_if(textual).alias("n"), F.count_if(leaders).alias("led"))
    contents = pages.select("doc_id", "page", ((F.col("n") >= 4) & (F.col("led") >= 0.5 * F.col("n"))).alias("contents"))
    short = R.trimmed(F.col("text"))
    running = F.col("type").isin("paragraph", "heading") & F.length(short).between(1, 30)
    seen = blocks.where(running).groupBy("doc_id", short.alias("short")).agg(F.countDistinct("page").alias("on"))
    repeated = seen.join(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id").where("on >= 3 and on / pages >= 0.3").select("doc_id", "short", F.lit(True).alias("repeated"))
    rows = blocks.withColumn("short", short).join(contents, ["doc_id", "page"]).join(repeated, ["doc_id", "short"], "left")
    number = short.rlike("^[—\\-－\\s]*[0-9]{1,4}[—\\-－\\s]*$|^第?\\s*[0-9]{1,4}\\s*页$")
    is_running = F.coalesce("repeated", F.lit(False)) & F.col("type").isin("paragraph", "heading")
    exempt = (F.col("type") == "heading") & F.col("heading_pattern").isNotNull()
    dropped = (F.col("contents") & (F.col("type") != "image_page")) | F.when(is_running, ~exempt).otherwise(F.col("type").isin("paragraph", "list_item") & number)
    return rows.where(~F.coalesce(dropped, F.lit(False))).select(*blocks.columns)


def recovered(citations: DataFrame) -> DataFrame:
    """question_id and conclusion: what the fields of a question's citations say by themselves, else null.

    citations: question_id, rank, question, excerpt, review; a question has a few. A question for the scale of a service is
    answered by all rows that state one, in the order of their sizes, if they differ; one row of a category answers nothing.
    Otherwise the lines of the excerpt that fits best answer, if any of them is asked for.
    """
    rows = citations.withColumn("lines", E.useful_lines(F.col("excerpt"), F.col("review")))
    line = lambda pattern: F.get(F.filter("lines", lambda x: x.rlike(pattern)), F.lit(0))
    rows = rows.withColumn("scale", line("^服务规模：")).withColumn("score", E.evidence_score(F.col("lines"), F.col("question")))
    states = F.col("scale").isNotNull()
    text = F.concat_ws("，", line(E.ORDERING), "scale")
    meta = F.filter("lines", lambda x: x.rlike("^(?:指标对象|来源表格|设施名称)："))
    chosen = F.struct((-F.col("score")).alias("below"), "rank", E.as_conclusion(E.chosen_lines(F.col("lines"), F.col("question"))).alias("conclusion"))
    found = rows.groupBy("question_id").agg(
        F.first("question").alias("asked"),
        F.array_sort(F.collect_list(F.when(states, F.struct(E.order_value(F.col("lines")).alias("value"), "rank", text.alias("text"))))).alias("scales"),
        F.min_by(F.when(states, meta), F.when(states, F.col("rank"))).alias("meta"),
        F.max(states & F.exists("lines", lambda x: x.rlike("^列[0-9]+：[ABC]类$"))).alias("category"),
        F.min(F.when(F.size("lines") >= 2, chosen)).alias("best"),
    )
    asks, n, texts = R.trimmed(F.col("asked")).rlike(E.SERVICE), F.size("scales"), F.array_distinct(F.transform("scales", lambda x: x["text"]))
    all_ = F.when(asks & (n > 1) & (F.size(texts) > 1), E.as_conclusion(F.concat("meta", texts)))
    alone = asks & (n == 1) & F.col("category")
    best = F.when((R.trimmed(F.col("asked")) == "") | (F.col("best.below") < 0), F.col("best.conclusion"))
    return found.select("question_id", F.coalesce(all_, F.when(~alone, best)).alias("conclusion"))
