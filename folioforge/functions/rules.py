"""Column functions over single texts: levels of obligation, terms, kinds of deliverables, versions, evidence quality, conclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rules in order, the first that fits decides.
REQUIREMENT_LEVELS = [("不得|禁止|严禁|不应", "forbidden"), ("必须", "must"), ("应当|应", "shall"), ("宜|原则上应", "should"), ("可|参照|结合实际", "may"), ("鼓励", "encouraged")]
CLAUSE_LEVELS = [("必须|严禁|不得|不应", "must"), ("应当|应", "shall"), ("宜|原则上", "should"), ("可|参照|结合实际", "may"), ("说明|解释|备注", "informative")]
DELIVERABLES = [("图纸|图则", "drawing"), ("表|附表", "table"), ("清单", "list"), ("数据库", "database"), ("附件", "appendix"), ("文本|说明书|报告", "text")]
MANDATORY = [("必选|必须|应包括|至少包括|▲", "true"), ("选做|可", "false")]
STATUSES = [
    ("征求意见|征求意见稿", "draft"),
    ("内部资料|内部使用", "internal"),
    ("本(?:标准|办法|规定|指南|导则|文件|通知)(?:自[^。；;]{0,20})?(?:废止|停止执行)|(?:废止|停止执行)本(?:标准|办法|规定|指南|导则|文件|通知)", "superseded"),
    ("引用的[^。；;]{0,20}(?:废止|停止执行)|历史参考|旧标准已废止", "possibly_superseded"),
    ("试行|暂行|参考|指南|导则", "reference"),
    ("发布|实施|施行|现行", "current"),
]
#: What adds to the confidence in a source.
CONFIDENCE = [("发布|实施|施行", 0.2), ("发布日期|实施日期|施行日期", 0.2), ("编号|文号|标准号", 0.15), ("发布单位|发布机关|主编单位", 0.1)]
#: Words of the keywords of a chunk, and characters that no pair of them may hold.
CHUNK_TERMS = ["容积率", "建筑密度", "绿地率", "建筑高度", "限高", "停车", "配建", "居住用地", "商业用地", "商务金融用地", "公共服务设施", "用地分类", "二类居住用地", "一类居住用地", "日照", "间距"]
STOP_CHARACTERS = "的是在和与及或等为应不可其该以对中上下之了也而并"
CODE, MEASURE, ARTICLE = "[A-Za-z][0-9]{1,2}", "[0-9]+(?:\\.[0-9]+)?\\s*(?:%|％|平方米|米|个|户)", "第[一二三四五六七八九十百零0-9]+条"
#: Signs of badly read tables, once article and dotted numbers are gone.
STABLE_NUMBERS = ["第[0-9]+条", "[0-9]+\\.[0-9]+(?:\\.[0-9]+)?"]
NORMAL_RIGHT = "个分秒米人户处座班张条项类级层年月日%％㎡平至到"
CORRUPT_NUMBER = "[0-9]+万\\.[0-9]+人[0-9]+"
GLUED = "[一-龥][0-9]{1,3}\\s+[0-9]?[一-龥]|含\\s*[0-9]+[一-龥]|[0-9]+\\)\\s*万"
NOISE = ["[、，,]\\s*[0-9]+\\s*[、，,]", "[0-9]\\s+[0-9]\\s*,\\s*[0-9]+", "[0-9]+\\.\\s*[、，,]", "[0-9]+\\.\\s*、", "[、，,]\\s*[、，,]\\s*[0-9]+%"]
CHECKED_TYPES = ["table_full", "table_row", "indicator", "requirement"]
#: Texts that replace conclusions.
REVIEW_TABLE = "已找到相关原文位置，但表格提取存在疑似数值或单位乱序，系统不直接引用解析出的具体数值。请以引用的原文页面为准。"
REVIEW_PAGE = "已定位到相关原文位置，但自动提炼结果存在不完整或抽取噪声风险，系统不直接提炼为确定结论。请打开引用的原文页面核对后使用。"
REVIEW_QUOTES = "已检索到相关依据，但自动提炼结果不完整，系统不直接输出半截结论。请结合下方引用原文核对。"
SOURCE_PAGE = "已定位到相关原文页面；当前自动提取片段存在阅读顺序噪声，建议切换到“原文页面”核对。"
#: Why a conclusion is incomplete.
INCOMPLETE = [("^$", "empty_conclusion"), ("[，,、；;：:]$", "dangling_separator"), ("(?:和|及|或|以及|包括|其中|原则上|不低于|不少于|为)$", "dangling_connector"), ("(?:^|[^0-9])[0-9]+(?:\\.[0-9]+)?$", "dangling_number")]
SECTIONS = "结论|依据|注意|无法确定|原因|建议"
#: How an answer that refuses begins.
REFUSALS = [
    "没有.{0,20}依据", "知识库.{0,20}(?:没有|未包含|不包含|无法)", "无法.{0,10}(?:回答|作答|给出)", "未.{0,10}(?:检索到|找到).{0,20}(?:依据|条文|内容)", "片段.{0,20}(?:没有|不包含|未包含)",
    "(?:未|没有|无法|查无).{0,12}(?:找到|检索到|查到|包含|提及|涉及|给出).{0,30}(?:要求|规定|标准|数值|指标|条文|内容|依据|信息|说明)",
]
#: The field that a column of an imported question list is.
IMPORT_FIELDS = [
    ("标准答案|参考答案|正确答案|standardanswer", "standardAnswer"), ("答案来源|来源|出处|依据|引用文件|正确文件|来源文件|source|reference|file", "correctFile"),
    ("问题|题目|提问|试题|question|^问$", "question"), ("序号|编号|题号|序列|^no$|^index$|^id$|^序$", "seq"), ("答案|answer", "standardAnswer"),
]
#: Names that stand for files.
FILE_ALIASES = [("停车", "停车配建"), ("报销|财务|企业制度", "财务报销"), ("IT与行政|设计软件|账号|软件", "IT|账号|软件|行政"), ("建筑方案报审|报审资料", "建筑方案报审"), ("片区控规优化", "片区控规优化"), ("产业园", "产业园城市设计"), ("(?i)TOD", "TOD")]


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = "unknown") -> Column:
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def requirement_level(text: Column) -> Column:
    return first_rule(text, REQUIREMENT_LEVELS)


def clause_level(text: Column) -> Column:
    return first_rule(text, CLAUSE_LEVELS)


def deliverable_type(text: Column) -> Column:
    return first_rule(text, DELIVERABLES)


def is_mandatory(text: Column) -> Column:
    """True, false, or null where nothing says so."""
    return first_rule(text, MANDATORY, None).cast("boolean")


def version_status(text: Column) -> Column:
    return first_rule(text, STATUSES)


def source_confidence(text: Column) -> Column:
    return F.least(F.lit(0.9), sum((F.when(text.rlike(p), w).otherwise(0.0) for p, w in CONFIDENCE), F.lit(0.35)))


def term_of(text: Column) -> Column:
    """What a defining line defines, else its beginning."""
    found = F.regexp_extract(text, "^([^：:，。\\s]{2,20})\\s*(?:[：:]|是指|指|是)", 1)
    return F.when(found != "", found).otherwise(F.substring(text, 1, 12))


def section_term(text: Column) -> Column:
    """The term of a paragraph that stands in a section of definitions."""
    return F.substring(trimmed(F.element_at(F.split(text, "[：:，,。]"), 1)), 1, 20)


def item_name(text: Column) -> Column:
    return F.nullif(trimmed(F.regexp_extract(text, "^([^：:，,。；;]{2,30})", 1)), F.lit(""))


def chunk_keywords(text: Column, most: int = 40) -> Column:
    """Codes, measures, articles, known terms and pairs of Han characters without stop characters; the first ``most`` distinct ones."""

    def every(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def pairs(run: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.filter(each, lambda p: (F.length(p) == 2) & ~p.rlike(f"[{STOP_CHARACTERS}]"))

    terms = F.filter(F.array(*[F.lit(t) for t in CHUNK_TERMS]), lambda t: F.contains(text, t))
    found = F.concat(F.transform(every(CODE), F.upper), F.transform(every(MEASURE), lambda m: F.regexp_replace(m, "\\s+", "")), every(ARTICLE), terms, F.flatten(F.transform(every("[一-龥]+"), pairs)))
    return F.slice(F.array_distinct(found), 1, most)


def evidence_quality(chunk_type: Column, text: Column) -> Column:
    """warnings, categories, blocks_answer and policy of a piece of evidence; only kinds that come from tables are looked at."""
    bare = text
    for pattern in STABLE_NUMBERS:
        bare = F.regexp_replace(bare, pattern, "")
    # a digit between Han characters or a Han character between digits, with what is usual there left out
    inside = F.exists(F.regexp_extract_all(bare, F.lit("[一-龥][0-9][一-龥]"), F.lit(0)), lambda x: ~F.substring(x, 3, 1).rlike(f"[{NORMAL_RIGHT}]"))
    between = F.exists(F.regexp_extract_all(bare, F.lit("[0-9][一-龥][0-9]"), F.lit(0)), lambda x: ~F.substring(x, 2, 1).rlike("[至到]"))
    corrupt, glued = bare.rlike(CORRUPT_NUMBER), bare.rlike(GLUED)
    noisy = inside | between
    for pattern in NOISE:
        noisy = noisy | bare.rlike(pattern)
    looked = F.coalesce(chunk_type.isin(*CHECKED_TYPES), F.lit(False))
    found = [F.when(corrupt, "numeric_value_corruption"), F.when(glued, "table_text_glue"), F.when(~corrupt & noisy, "reading_order_noise")]
    categories = F.when(looked, F.filter(F.array(*found), lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>"))
    any_ = F.size(categories) > 0
    blocks = F.array_contains(categories, "numeric_value_corruption")
    warnings = F.when(blocks, F.array(F.lit("scrambled_numeric_unit"))).when(any_, F.array(F.lit("noisy_extraction_text"))).otherwise(F.array().cast("array<string>"))
    return F.struct(warnings.alias("warnings"), categories.alias("categories"), blocks.alias("blocks_answer"), F.when(any_, "source_page_required").otherwise("show_extracted_text").alias("policy"))


def needs_review(low_fidelity: Column, policy: Column, warnings: Column) -> Column:
    return F.coalesce(low_fidelity, F.lit(False)) | F.coalesce(policy == "source_page_required", F.lit(False)) | (F.coalesce(F.size(warnings), F.lit(0)) > 0)


def low_fidelity_answer(conclusion: Column, review: Column) -> Column:
    return F.when(review, REVIEW_TABLE).otherwise(conclusion)


def sanitised_conclusion(text: Column) -> Column:
    """A conclusion without internal marks: the original behind them, or what a nested section of conclusions says."""
    original = F.regexp_extract(text, "(?s)\\n原文[：:]\\n?(.+)", 1)
    bare = F.regexp_replace(text, "【结构化[^】]+】", "")
    chosen = F.when(text.rlike("(?U)^\\s*【结构化") & (original != ""), original).otherwise(bare)
    plain = trimmed(F.regexp_replace(chosen, "\\n{3,}", "\n\n"))
    nested = F.regexp_extract(plain, f"(?s)【结论】(.*?)(?:【(?:{SECTIONS})】|$)", 1)
    return F.when(F.contains(plain, F.lit("【结论】")), trimmed(nested)).otherwise(plain)


def incomplete_reasons(text: Column) -> Column:
    short = trimmed(text)
    return F.filter(F.array(*[F.when(short.rlike(p), r) for p, r in INCOMPLETE]), lambda r: r.isNotNull())


def final_conclusion(text: Column, review: Column) -> Column:
    """The sanitised text, or a fixed one where it is incomplete."""
    clean = sanitised_conclusion(text)
    return F.when(F.size(incomplete_reasons(clean)) == 0, clean).when(review, REVIEW_PAGE).otherwise(REVIEW_QUOTES)


def refuses(text: Column) -> Column:
    """Whether the first sentence of an answer, or its first 80 characters, refuses to answer."""
    short = trimmed(text)
    lead = F.substring(F.element_at(F.split(short, "[。\\n]"), 1), 1, 80)
    return F.startswith(short, F.lit("抱歉")) | lead.rlike("|".join(REFUSALS))


def clean_excerpt(text: Column) -> Column:
    """Without page marks and runs of empty lines."""
    out = text
    for pattern in ("—[0-9]+—", "\\[\\[page:[0-9]+\\]\\]", "【第[0-9]+页】"):
        out = F.regexp_replace(out, pattern, "")
    return trimmed(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def import_field(header: Column) -> Column:
    """Which field a header names, else null; spaces and marks don't count."""
    plain = F.regexp_replace(F.lower(trimmed(header)), "[\\s:：()（）.。、_\\-]", "")
    return F.when(plain != "", first_rule(plain, IMPORT_FIELDS, None))


def file_key(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(trimmed(F.coalesce(name, F.lit("")))), "\\.(?:pdf|docx?|txt|md|markdown)$", "")
    return F.regexp_replace(bare, "[《》【】\\s]", "")


def file_fits(file_name: Column, expected: Column) -> Column:
    """Whether a file is the expected one: by name either way, by a title in brackets, or by an alias."""
    own, target = file_key(file_name), file_key(expected)
    title = file_key(F.regexp_extract(expected, "《([^》]+)》", 1))
    by_name = (target != "") & (F.contains(own, target) | F.contains(target, own))
    by_title = (F.length(title) >= 4) & F.contains(own, title)
    by_alias = F.lit(False)
    for pattern, key in FILE_ALIASES:
        by_alias = by_alias | (expected.rlike(pattern) & file_name.rlike(key))
    return F.coalesce((own != "") & (by_name | by_title | by_alias), F.lit(False))


def yes_no(value: Column) -> Column:
    return F.when(value, "是").when(~value, "否").otherwise("")


def duration_text(ms: Column) -> Column:
    """Milliseconds below a second, else seconds to one place."""
    return F.when(ms.isNull(), "").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", F.floor((ms + 50) / 100) / 10))


def split_long(text: Column, hard: int = 1200) -> Column:
    """A text in pieces of at most ``hard`` characters, cut behind sentences where possible."""
    none = F.array().cast("array<string>")

    def closed(state: Column) -> Column:
        return F.when(trimmed(state["now"]) != "", F.concat(state["done"], F.array(trimmed(state["now"])))).otherwise(state["done"])

    def add(state: Column, s: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / hard).cast("int")), lambda i: trimmed(F.substring(s, i * hard + 1, F.lit(hard))))
        huge = F.struct(F.concat(closed(state), F.filter(cuts, lambda c: c != "")).alias("done"), F.lit("").alias("now"))
        full = F.struct(closed(state).alias("done"), s.alias("now"))
        more = F.struct(state["done"].alias("done"), F.concat(state["now"], s).alias("now"))
        return F.when(F.length(s) > hard, huge).when((F.length(state["now"]) + F.length(s) > hard) & (state["now"] != ""), full).otherwise(more)

    start = F.struct(none.alias("done"), F.lit("").alias("now"))
    pieces = F.aggregate(F.filter(F.split(text, "(?<=[。；;！!])"), lambda s: s != ""), start, add, closed)
    return F.when(F.length(text) <= hard, F.array(text)).otherwise(pieces)


def packed_section(paragraphs: Column, target: int = 900, overlap: int = 100, least: int = 30) -> Column:
    """The paragraphs of one section in pieces of about ``target`` characters, each with the end of the one before; short rests are dropped."""
    none = F.array().cast("array<string>")

    def closed(state: Column) -> Column:
        content = trimmed(F.concat(state["carry"], state["now"]))
        fits = F.length(content) >= least
        return F.struct(
            F.when(fits, F.concat(state["done"], F.array(content))).otherwise(state["done"]).alias("done"), F.lit("").alias("now"), F.when(fits, F.substring(content, -overlap, overlap)).otherwise(state["carry"]).alias("carry")
        )

    def add(state: Column, p: Column) -> Column:
        full = (F.length(state["now"]) + F.length(p) > target) & (state["now"] != "")
        after = closed(state)
        return F.struct(
            F.when(full, after["done"]).otherwise(state["done"]).alias("done"), F.when(full, p).otherwise(F.concat(state["now"], p)).alias("now"), F.when(full, after["carry"]).otherwise(state["carry"]).alias("carry")
        )

    start = F.struct(none.alias("done"), F.lit("").alias("now"), F.lit("").alias("carry"))
    contents = F.aggregate(paragraphs, start, add, lambda s: closed(s)["done"])
    return F.flatten(F.transform(contents, lambda c: split_long(c)))


def squeezed_header(header: Column) -> Column:
    """A header for comparisons: without brackets, spaces and marks, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(header, "[（(][^）)]*[）)]", ""), "[\\s\\-—－/、，,。．.:：|]+", ""))


