"""Column functions that pick, order and render evidence for a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.rules import trimmed

#: What a question asks for, and the lines that answer it.
MARK = "【结构化指标项】"
DETAILED = "业务用房|辅助空间|比例|不低于|不少于|不小于|急救|A级|B级|病床|床位|每张床|15分钟|步行|可达|科室|隔离|留观"
GENERAL = "一般规模|一般.*面积|面积.*一般|多少面积|多大面积|多少.*(?:平方米|平米)|建筑面积|用地面积|规模"
SERVICE, THOUSAND, DRAWINGS = "服务规模|多少处|几处", "千人", "图纸|图则|成果|提交|说明文件|说明书|附件|数据库|材料"
ALWAYS, DETAIL_LINES, SCALE_LINES = "^(?:指标对象|来源表格|设施名称)：", "配置要求|详细配置要求", "一般规模|建筑面积|用地面积|规模性指标"
DETAIL_TERMS = ["业务用房", "辅助空间", "比例", "不低于", "不少于", "不小于", "急救", "A级", "B级", "病床", "床位", "15分钟", "步行", "可达", "科室", "隔离", "留观"]
DETAIL_PREFIX = "详细配置要求："
ORDERING = "办学规模|一般规模|规模性指标"
#: Who is asked for, what the lines hold, and what that is worth.
SCORES = [
    ("detailed", "详细配置要求", 8), ("detailed", "配置要求表", 2), ("detailed", "规模性指标\\.一般规模", -4), ("general", "规模性指标\\.一般规模", 5), ("general", "建筑面积|用地面积", 2), ("general", "配置指标表", 1),
    ("general", "配置要求表", -1), ("usual", "一般规模", 4), ("thousand", "千人指标", 8), ("service", "服务规模", 8), ("near", "详细配置要求|指标使用说明", 4),
]
NOTICE = "该回答仅适用于当前知识库已收录文件及对应城市。如具体地块规划条件、已批控规图则或更新文件另有规定，应以具体文件为准。"
REFUSAL = ["当前知识库未检索到该问题的明确条文依据，因此无法给出确定结论。", "请补充对应城市技术规定、控规导则、专项标准、已批控规图则或具体地块规划条件后再查询。"]


def asked_for(question: Column) -> dict[str, Column]:
    q = trimmed(question)
    detailed, thousand, service = q.rlike(DETAILED), q.rlike(THOUSAND), q.rlike(SERVICE)
    return {"detailed": detailed, "thousand": thousand, "service": service, "general": q.rlike(GENERAL) & ~detailed & ~thousand & ~service, "usual": q.rlike("一般"), "near": q.rlike("15分钟|步行|可达|85%|比例|使用说明")}


def useful_lines(excerpt: Column, review: Column) -> Column:
    """The fields of a structured excerpt, a line each; none of one that has to be reviewed."""
    text = trimmed(F.coalesce(excerpt, F.lit("")))
    lines = F.filter(F.transform(F.split(text, "\\r?\\n"), trimmed), lambda s: (s != "") & ~s.rlike("^【结构化") & F.contains(s, F.lit("：")))
    return F.when(~review & F.startswith(text, F.lit(MARK)), lines).otherwise(F.array().cast("array<string>"))


def evidence_score(lines: Column, question: Column) -> Column:
    asks, text = asked_for(question), F.array_join(lines, "\n")
    return sum((F.when(asks[a] & text.rlike(p), w).otherwise(0) for a, p, w in SCORES), F.lit(0))


def focused(line: Column, question: Column) -> Column:
    """A line of detailed requirements with only the sentences that hold what is asked for, if there are any."""
    terms = F.filter(F.array(*[F.lit(t) for t in DETAIL_TERMS]), lambda t: F.contains(question, t) | ((t == "病床") & F.contains(question, F.lit("每张床"))))
    sentences = F.regexp_extract_all(F.substring(line, len(DETAIL_PREFIX) + 1, 100_000), F.lit("(?:[0-9]+\\.)?[^。；;]+[。；;]?"), F.lit(0))
    hits = F.filter(sentences, lambda s: F.exists(terms, lambda t: F.contains(s, t)))
    return F.when(F.startswith(line, F.lit(DETAIL_PREFIX)) & (F.size(hits) > 0), F.concat(F.lit(DETAIL_PREFIX), F.array_join(hits, ""))).otherwise(line)


def chosen_lines(lines: Column, question: Column) -> Column:
    """The lines that a question needs: what names the object, and what it asks for; all if it asks for nothing known."""
    asks = asked_for(question)
    wanted = F.when(asks["detailed"], DETAIL_LINES).when(asks["thousand"], "千人指标").when(asks["service"], "服务规模").when(asks["general"], SCALE_LINES)
    keep = F.filter(lines, lambda s: s.rlike(ALWAYS) | F.regexp_like(s, wanted))
    none = (trimmed(question) == "") | wanted.isNull() | (F.size(keep) == 0)
    return F.when(none, lines).otherwise(F.transform(keep, lambda s: focused(s, trimmed(question))))


def as_conclusion(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda s: trimmed(F.regexp_replace(s, "[。；;]\\s*$", ""))), lambda s: s != ""), "。")


def order_value(lines: Column) -> Column:
    """The first number of the line that orders rows of one object, else infinity."""
    line = F.get(F.filter(lines, lambda s: s.rlike(ORDERING)), F.lit(0))
    return F.coalesce(F.nullif(F.regexp_extract(line, "[0-9]+(?:\\.[0-9]+)?", 0), F.lit("")).cast("double"), F.lit(float("inf")))


def category_order(category: Column) -> Column:
    return F.when(trimmed(category) == "A类", 1.0).when(trimmed(category) == "B类", 2.0).when(trimmed(category) == "C类", 3.0).otherwise(float("inf"))


def answer_text(conclusion: Column, citations: Column) -> Column:
    """The answer: conclusion, evidence (citations: file_name, section, article, page, excerpt) and notice."""
    n = F.size(citations)

    def one(c: Column, i: Column) -> Column:
        place = F.array_join(F.filter(F.array(c["section"], c["article"]), lambda x: x.isNotNull() & (x != "")), " ｜ ")
        head = F.when(n > 1, F.concat(F.lit("· 依据"), (i + 1).cast("string"), F.lit("："))).otherwise("·")
        page = F.coalesce(F.concat(F.lit("第"), c["page"].cast("string"), F.lit("页")), F.lit("—"))
        return F.concat_ws("\n", head, F.concat(F.lit("  - 文件："), c["file_name"]), F.concat(F.lit("  - 章节 / 条款："), F.when(place != "", place).otherwise("—")), F.concat(F.lit("  - 页码："), page), F.concat(F.lit("  - 原文片段："), c["excerpt"]))

    return F.concat_ws("\n", F.lit("【结论】"), conclusion, F.lit(""), F.lit("【依据】"), F.array_join(F.transform(citations, one), "\n"), F.lit(""), F.lit("【注意】"), F.lit(NOTICE))


def refusal_text(reason: Column) -> Column:
    return F.concat_ws("\n", F.lit("【无法确定】"), F.lit(REFUSAL[0]), F.lit(""), F.lit("【原因】"), reason, F.lit(""), F.lit("【建议】"), F.lit(REFUSAL[1]))
