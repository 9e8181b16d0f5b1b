"""Column functions over lines of a document: headings, captions, page fragments, categories, rendered rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import squeezed

#: Heading patterns in order with their level, captions, and the categories of file types.
CHINESE = "零一二三四五六七八九十百千"
HEADINGS = [
    ("part", 1, f"^\\s*第[{CHINESE}]+部\\s*分"),
    ("volume", 1, f"^\\s*第[{CHINESE}]+篇(?:章)?"),
    ("chapter", 2, f"^\\s*第[{CHINESE}]+章"),
    ("section", 3, f"^\\s*第[{CHINESE}]+节"),
    ("article", 4, f"^\\s*第[{CHINESE}0-9]+条"),
    ("clause-dot3", 4, "^\\s*[0-9]+(?:\\.[0-9]+){2,}(?![.0-9])"),
    ("cn-dun", 5, f"^\\s*[{CHINESE}]+[、．.]"),
    ("num-dot2", 5, "^\\s*[0-9]+\\.[0-9]+(?![.0-9])"),
    ("num-dun", 6, "^\\s*[0-9]+[、．.](?![0-9])"),
    ("paren-num", 7, "^\\s*[（(]\\s*[0-9]+\\s*[)）]"),
    ("circle-num", 7, "^\\s*[①-⑳]"),
]
CAPTION = "^\\s*(?:续表|附表|表)\\s*[A-Za-z]?[0-9０-９]+(?:[—\\-－.．][A-Za-z0-9０-９]+)*"
CONTINUED = "^\\s*续表"
OWN_CATEGORY = ["项目资料", "规划法规", "技术标准", "设计指引", "成果要求", "企业制度", "流程指引", "FAQ", "IT与行政", "财务与报销"]
CATEGORIES = {"审查报批": "流程指引", "图纸图则": "设计指引", "技术规定": "技术标准", "用地分类": "规划法规", "控规导则": "规划法规", "停车标准": "技术标准", "公共服务设施标准": "技术标准"}
LONGEST_HEADING = 40


def heading(line: Column) -> Column:
    """pattern, level, mark and text of a heading, else null.

    The first pattern that fits decides; from level 5 on a long rest makes the line a list item. Lines with tabs are rows.
    """
    out = F.lit(None).cast("struct<pattern:string,level:int,mark:string,text:string>")
    for name, level, pattern in reversed(HEADINGS):
        rest = squeezed(F.regexp_replace(line, pattern, ""))
        found = F.struct(F.lit(name).alias("pattern"), F.lit(level).alias("level"), squeezed(F.regexp_extract(line, pattern, 0)).alias("mark"), rest.alias("text"))
        if level >= 5:
            found = F.when(F.length(rest) <= LONGEST_HEADING, found)
        out = F.when(line.rlike(pattern), found).otherwise(out)
    return F.when(~F.contains(squeezed_tabs(line), F.lit("\t")), out)


def squeezed_tabs(line: Column) -> Column:
    """The line without blanks at its ends; tabs inside stay."""
    return F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")


def is_caption(line: Column) -> Column:
    return line.rlike(CAPTION)


def is_continued(line: Column) -> Column:
    return line.rlike(CONTINUED)


def is_page_fragment(value: Column) -> Column:
    """One to four digits with a dash at either end."""
    text = squeezed_tabs(F.coalesce(value, F.lit("")))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return text.rlike("^[0-9\\s—\\-－]+$") & digits.between(1, 4) & text.rlike("^[—\\-－]|[—\\-－]$")


def category(file_type: Column) -> Column:
    out = F.when(file_type.isin(*OWN_CATEGORY), file_type)
    for name, value in CATEGORIES.items():
        out = out.when(file_type == name, value)
    return out.otherwise("其他")


def label(name: Column, role: Column) -> Column:
    return F.concat_ws(" · ", name, role)


def row_sentence(headers: Column, fields: Column) -> Column:
    """A row in prose: its fields in the order of the headers."""
    shown = F.filter(headers, lambda h: F.coalesce(F.try_element_at(fields, h) != "", F.lit(False)))
    return F.array_join(F.transform(shown, lambda h: F.concat(h, F.lit("："), F.try_element_at(fields, h))), "。")


def markdown_row(cells: Column) -> Column:
    escaped = F.transform(cells, lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\\r?\\n", " "))
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def page_span(first: Column, last: Column) -> Column:
    """Pages from first to last; 0 counts as missing."""
    a, b = F.nullif(first, F.lit(0)), F.nullif(last, F.lit(0))
    return F.when(a.isNotNull(), F.sequence(a, F.greatest(F.coalesce(b, a), a))).otherwise(F.array().cast("array<int>"))


def relevance(score: Column) -> Column:
    return F.when(score >= 0.45, "高").when(score >= 0.25, "中").otherwise("低")


def is_clean(low_fidelity: Column, policy: Column, warnings: Column) -> Column:
    """Whether a citation can be shown as it is."""
    return ~F.coalesce(low_fidelity, F.lit(False)) & ~F.coalesce(policy == "source_page", F.lit(False)) & (F.coalesce(F.size(warnings), F.lit(0)) <= 0)


def answer_overlap(answer: Column, expected: Column) -> Column:
    """Share of the expected answer's numbers, codes and Han pairs that the answer contains; null if it has none."""
    han = F.regexp_extract_all(expected, F.lit("[\\u4e00-\\u9fa5]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    pieces = F.array_distinct(F.concat(F.regexp_extract_all(expected, F.lit("[A-Za-z]?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), pairs))
    return F.when(F.size(pieces) > 0, F.size(F.filter(pieces, lambda p: F.contains(answer, p))) / F.size(pieces))
