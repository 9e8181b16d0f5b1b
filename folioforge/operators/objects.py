"""Typed records out of document blocks: sections, clauses, definitions, requirements, steps, versions, and their chunks.

Blocks have doc_id, block_index, page, level (of headings, else null) and text. All extractors are expressions and
windows per document; each returns doc_id, object_type, first_block, page_start, page_end, title, content, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as T
from folioforge.functions.vectors import stable_id
from folioforge.operators.tables import section_paths

COLUMNS = ["doc_id", "object_type", "first_block", "page_start", "page_end", "title", "content", "confidence"]
#: What marks each kind of record.
CLAUSE = "^\\s*(第[0-9一二三四五六七八九十百]+条|[0-9]+(?:\\.[0-9]+){1,3})\\s*"
DEFINITION = "^(?:本(?:标准|办法|规定|指南|导则)所称)?\\s*([^，。：:\\s]{2,30})\\s*(?:是指|指|是|包括|：|:)(.+)$"
DEFINITION_HEADING = "术语|名词解释|定义|用词说明|统计口径"
DELIVERABLE = "成果要求|成果|附件|数据库|附表|清单|编制内容|应包括|至少包括|必选|选做|▲"
DRAWING = "图纸要求|图纸目录|图纸|图则|导则|比例尺"
CHECK = "清单|任务|问题|需求|项目|政策|事项|材料"
PROCEDURE = "流程|程序|步骤|阶段|办理|审查|审批|报审|操作"
STEP = "^\\s*(?:第?[一二三四五六七八九十0-9]+步|步骤[一二三四五六七八九十0-9]+|[0-9]+[、.．])"
BASIS = "编制依据|依据|引用标准|相关规范|上位规划|法律法规"


def record(kind: str | Column, title: Column, content: Column, confidence: float | Column) -> list[Column]:
    return [
        "doc_id",
        (F.lit(kind) if isinstance(kind, str) else kind).alias("object_type"),
        F.col("block_index").alias("first_block"),
        F.col("page").alias("page_start"),
        F.coalesce(F.col("page_end"), F.col("page")).alias("page_end"),
        title.alias("title"),
        content.alias("content"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"),
    ]


def with_sections(blocks: DataFrame) -> DataFrame:
    """blocks with section_path, the latest heading and an empty page_end."""
    w = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    out = section_paths(blocks, "doc_id", "block_index", "level", "text")
    return out.withColumn("heading", F.last(F.when(F.col("level").isNotNull(), F.col("text")), ignorenulls=True).over(w)).withColumn("page_end", F.lit(None).cast("int"))


def plain_sections(blocks: DataFrame, least: int = 8) -> DataFrame:
    """Paragraphs of one section joined by line, in order."""
    body = blocks.where("level is null").groupBy("doc_id", "section_path").agg(F.array_sort(F.collect_list(F.struct("block_index", "page", "text"))).alias("parts"))
    content = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    rows = body.select("doc_id", F.col("parts")[0]["block_index"].alias("block_index"), F.array_min(F.transform("parts", lambda p: p["page"])).alias("page"), F.array_max(F.transform("parts", lambda p: p["page"])).alias("page_end"), "section_path", content.alias("content"))
    return rows.where(F.length(F.trim(F.regexp_replace("content", "\n", ""))) >= least).select(*record("plain_section", F.col("section_path"), F.col("content"), 0.55))


def clauses(blocks: DataFrame) -> DataFrame:
    """From a clause mark to the next mark or heading; the mark's own text begins the body."""
    w = Window.partitionBy("doc_id").orderBy("block_index")
    marked = blocks.withColumn("mark", F.nullif(F.regexp_extract("text", CLAUSE, 1), F.lit("")))
    starts = (F.col("mark").isNotNull() | F.col("level").isNotNull()).cast("int")
    grouped = marked.withColumn("run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("block_index", "page", "text"))).alias("parts"), F.max("mark").alias("mark"), F.max("level").alias("level"))
    parts = parts.where("mark is not null and level is null")
    content = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    rows = parts.select("doc_id", "mark", F.col("parts")[0]["block_index"].alias("block_index"), F.col("parts")[0]["page"].alias("page"), F.element_at("parts", -1)["page"].alias("page_end"), content.alias("content"))
    return rows.select(*record("clause", F.col("mark"), F.col("content"), 0.9))


def definitions(blocks: DataFrame) -> DataFrame:
    """A defining sentence anywhere, or any paragraph below a heading of terms."""
    found = F.regexp_extract("text", DEFINITION, 1)
    title = F.when(found != "", R.trimmed(found)).otherwise(R.section_term(F.col("text")))
    rows = blocks.where("level is null").withColumn("found", (found != "") & (R.trimmed(F.regexp_extract("text", DEFINITION, 2)) != "")).withColumn("term", title)
    rows = rows.where(F.col("found") | ((found == "") & F.coalesce(F.col("heading").rlike(DEFINITION_HEADING), F.lit(False)))).where((F.col("term") != "") & (F.length("term") <= 40))
    return rows.select(*record("definition", F.col("term"), F.col("text"), F.when(F.col("found"), 0.88).otherwise(0.62)))


def requirements(blocks: DataFrame) -> DataFrame:
    """A record for each sentence that states an obligation."""
    rows = blocks.where("level is null").select("doc_id", "block_index", "page", "page_end", F.explode(T.sentences(F.col("text"))).alias("text"))
    rows = rows.withColumn("rule", R.requirement_level(F.col("text"))).where("rule <> 'unknown'")
    return rows.select(*record("requirement", F.col("rule"), F.col("text"), 0.8))


def deliverables(blocks: DataFrame) -> DataFrame:
    """Paragraphs that name a drawing, else those that name another thing to hand in."""
    text, drawing = F.col("text"), F.col("text").rlike(DRAWING)
    title = F.when(drawing, F.substring("text", 1, 40)).otherwise(F.coalesce(R.item_name(text), F.substring("text", 1, 40)))
    rows = blocks.where("level is null").where(drawing | text.rlike(DELIVERABLE))
    return rows.select(*record(F.when(drawing, "drawing").otherwise("deliverable"), title, text, F.when(drawing, 0.74).otherwise(0.72)))


def checklist_items(blocks: DataFrame) -> DataFrame:
    """List items that speak of tasks or papers, or whose section does."""
    own = F.col("text").rlike(CHECK)
    bare = F.regexp_replace("text", "^\\s*[0-9]+[、.．]\\s*", "")
    rows = blocks.where("level is null").where(T.list_mark(F.col("text")).isNotNull() & (own | F.col("section_path").rlike(CHECK)))
    return rows.select(*record("checklist_item", F.substring(F.when(own, F.col("text")).otherwise(bare), 1, 40), F.col("text"), F.when(own, 0.68).otherwise(0.72)))


def procedure_steps(blocks: DataFrame) -> DataFrame:
    """Paragraphs of a section about a procedure; elsewhere those that speak of one and begin like a step."""
    fits = F.col("section_path").rlike(PROCEDURE) | (F.col("text").rlike(PROCEDURE) & F.col("text").rlike(STEP))
    return blocks.where("level is null").where(fits).select(*record("procedure_step", F.substring("text", 1, 40), F.col("text"), 0.64))


def references(blocks: DataFrame) -> DataFrame:
    """Paragraphs that name what the document is based on, or whose section does; titled by the section."""
    fits = F.col("section_path").rlike(BASIS) | F.col("text").rlike(BASIS)
    return blocks.where("level is null").where(fits).select(*record("reference", F.col("heading"), F.col("text"), 0.68))


def version_info(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """doc_id, publish_date, effective_date, status and supersedes, from the first pages; what it replaces from all."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), "\n")
    early = blocks.where(F.col("page") <= pages).groupBy("doc_id").agg(text.alias("text"))
    date = lambda names: F.nullif(F.regexp_extract("text", f"(?:{names})(?:日期)?[：:]?\\s*([0-9]{{4}}[年./-][0-9]{{1,2}}(?:[月./-][0-9]{{0,2}}日?)?)", 1), F.lit(""))
    status = F.when(F.col("text").rlike("废止日期|已废止|repealed"), "repealed").when(F.col("text").rlike("征求意见|draft"), "draft").when(F.col("text").rlike("实施|施行|发布|effective"), "current").otherwise("unknown")
    head = early.select("doc_id", T.normal_date(date("发布|Published")).alias("publish_date"), T.normal_date(date("实施|施行|Effective")).alias("effective_date"), status.alias("status"))
    replaced = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:代替|替代|supersedes)[^《]*《([^》]+)》"), F.lit(1))).alias("name")).groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("supersedes"))
    return head.join(replaced, "doc_id", "left")


def extracted(blocks: DataFrame) -> DataFrame:
    """All records of the blocks with an id that depends on type and content; overlaps between kinds are kept."""
    rows = with_sections(blocks)
    parts = [
        clauses(rows),
        definitions(rows),
        requirements(rows),
        deliverables(rows),
        checklist_items(rows),
        procedure_steps(rows),
        references(rows),
        plain_sections(rows),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("object_id", stable_id(F.col("object_type"), F.col("doc_id").cast("string"), F.col("title"), F.substring("content", 1, 200)))


def chunks(objects: DataFrame, target: int = 900) -> DataFrame:
    """Retrieval chunks: records as they are, long ones in parts by sentence, empty ones dropped; neighbours linked."""
    from folioforge.operators.tables import packed_sentences

    long = F.length("content") > target + 300
    rows = objects.where(F.length("content") > 0).withColumn("key", F.struct("doc_id", "object_id", "first_block"))
    parts = packed_sentences(rows.where(long).select("key", T.sentences(F.col("content")).alias("s")), "key", F.col("s"), target)
    whole = rows.where(~long).select("key", F.lit(0).alias("part"), "content")
    out = whole.unionByName(parts).select("key.*", "part", "content")
    w = Window.partitionBy("doc_id").orderBy("first_block", "object_id", "part")
    name = F.concat_ws("#", "object_id", "first_block", "part")
    return out.withColumn("chunk_id", name).withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))
