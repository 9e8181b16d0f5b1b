"""What a question asks for: keywords, phrases, signals, scope and the size of its result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and word lists that decide results.
NUMBER_WITH_UNIT = "(?:\\d+(?:\\.\\d+)?|[零一二三四五六七八九十百千万点]+)\\s*(?:%|％|平方米|米|个|户|辆)"
LAND_USE = "[A-Za-z]\\d{1,2}|[一二三四]类居住用地|商业用地|商务金融用地|工业用地|公共服务设施用地"
ARTICLE = "第[一二三四五六七八九十百零0-9]+条"
KEYWORD_NUMBER = "\\d+(?:\\.\\d+)?\\s*(?:%|％|平方米|米|个|户)?"
KEYWORD_TERMS = [
    "容积率", "建筑密度", "绿地率", "建筑高度", "限高", "停车", "配建", "居住用地", "二类居住用地", "一类居住用地", "商业用地", "商务金融用地", "公共服务设施", "用地分类", "日照", "间距", "定义", "区别", "标准", "办公建筑",
    "商业建筑", "住宅", "旧区改建", "集中绿地", "道路红线", "红线宽度", "道路宽度", "退线", "建筑退线", "退距", "引导性指标", "控制性指标", "强制性指标", "主导功能", "主导用地", "幼儿园", "小学", "中学", "社区卫生",
    "服务半径", "配置指标", "林木覆盖率", "覆盖率", "绿化覆盖", "H9", "H类", "A类", "B类", "R类", "划分", "设置", "规定", "要求", "不应", "不得", "宜", "应当",
]
PHRASE_BREAKERS = [
    "是什么", "什么", "多少", "如何", "怎样", "怎么", "哪些", "哪个", "几个", "请问", "不低于", "不高于", "不应", "不得", "低于", "高于", "大于", "小于", "达到", "以上", "以下", "之间", "区别", "定义",
    "的", "是", "在", "和", "与", "及", "或", "为", "其", "该", "以", "对", "了", "也", "并", "有", "吗", "呢", "应", "宜", "可", "请",
]
DOMAIN_TERMS = [
    "容积率", "建筑密度", "绿地率", "建筑高度", "建筑面积", "用地面积", "用地规模", "建筑规模", "千人指标", "服务规模", "一般规模", "服务半径", "服务内容", "配置指标", "配建指标", "控制指标", "配置要求", "管控要求", "停车位",
    "配建", "居住用地", "二类居住用地", "一类居住用地", "商业用地", "商务金融用地", "工业用地", "公共服务设施", "日照", "间距", "退线", "道路红线", "红线宽度", "用地分类", "类别代码", "用地代码", "图书展览用地", "物业服务用房",
    "社区卫生服务中心", "幼儿园", "养老", "停车场", "比例尺", "格式要求",
]
SIGNALS = {
    "code": "代码|编码|编号|[A-Za-z]\\d{1,4}",
    "table_no": "表\\s*[A-Za-z]?\\d|附表|哪.*表",
    "clause": "第[零一二三四五六七八九十百千0-9]+条|\\d+(?:\\.\\d+){1,}|条文|条款",
    "definition": "定义|是什么|是指|所称|术语|含义",
    "indicator": "指标|面积|数量|规模|服务半径|容积率|绿地率|密度|高度|多少",
    "configuration": "配置|配建|设置|标准|控制要求",
    "deliverable": "成果|提交|编制内容|包括哪些",
    "drawing": "图纸|图则|图纸目录|比例尺",
    "attachment": "附件|附表|数据库|材料",
    "obligation": "必须|应当|应|不得|禁止|严禁|宜|可|允许|能否|是否",
    "procedure": "流程|程序|步骤|怎么办|如何办理|阶段",
    "checklist": "清单|事项|任务|问题清单|项目清单|政策清单",
    "numeric": "\\d|不小于|不少于|不低于|不大于|不超过|以上|以下|区间|范围",
}
OUT_OF_SCOPE = [
    (
        "提示词注入/越权",
        "(?i)忽略(以上|之前|前面|上述|所有|先前).{0,12}(设定|设置|指令|规则|提示|要求|限制)|(系统|你的|内部).{0,4}(提示词|prompt|指令|设定|规则).{0,10}(发|输出|打印|展示|告诉|给我|复述|原样)|"
        "原样(发|输出|打印|返回|复述|给).{0,8}(提示词|系统|指令|设定)|(没有|无|不受).{0,2}限制的\\s*ai|越狱|开发者模式|dan\\s*模式|jailbreak|扮演.{0,8}(不受限|无限制|没有限制|没有任何限制)",
    ),
    ("指标组合可行性判断", "是否可行|能否(实现|满足)|组合.*(可行|合理)|可不可行"),
    ("审批结论判断", "批不批|能不能(通过|批)|能否(通过|获批|批准)|会不会(通过|获批|批准)|是否(合规|合法|通过|获批|批准)|审批(能否|能不能|会不会|结论|结果会)"),
    ("法律意见", "法律意见|是否违法|法律责任|起诉|诉讼"),
    ("投资测算", "投资(测算|估算|回报|收益|分析)|(成本|造价|收益|回报|利润)(测算|估算|核算|分析)|经济测算|回报率|测算.{0,6}(投资|成本|造价|收益|利润)"),
    ("CAD/GIS解析", "(?i)cad|dwg|gis|shp|图纸解析|读取图|解析图"),
    (
        "地块规划条件查询",
        "(?:该|某|本|这|那|我)[^，。？类种些市省区县镇乡]{0,3}(?:地块|宗地|用地)[^，。？]{0,25}(?:容积率|建筑密度|限高|规划条件|规划指标)|"
        "(?:容积率|建筑密度|限高|规划条件).{0,30}(?:控规图则|经批准图则|已批图则).{0,15}(?:确定|设定|规定|为准)",
    ),
    ("开发强度指标(控规逐地块确定)", "(用地|住宅|商业|商务|工业|公建)[^，。？]{0,8}(容积率|建筑密度|建筑高度|限高)[^，。？]{0,6}(上限|最大值?|最高值?|是多少|为多少|多少)"),
]
WANTS_NUMBER = "多少|上限|下限|最高|最低|不低于|不高于|不少于|不超过|不大于|百分之|比例|几个|多大|面积是|规模是"
COUNT_ANSWER = "(?:\\d+|[零一二三四五六七八九十百千万]+)\\s*[^\\s，。、；:：]{0,2}?(?:类|项|种|级|处|步)"
TYPE_PRIORITY = {
    "table_row": 1.0, "code": 1.0, "indicator": 0.9, "clause": 0.8, "definition": 0.75, "requirement": 0.6, "list_item": 0.55, "deliverable": 0.5,
    "procedure": 0.5, "clause_explanation": 0.45, "table_full": 0.4, "explanation": 0.35, "section": 0.3, "note": 0.2, "figure": 0.1, "image_page": 0.0,
}
_HAN_RUN = "[\\u4e00-\\u9fa5]+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _held(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def asks(question: Column, signal: str) -> Column:
    return F.trim(question).rlike(SIGNALS[signal])


def keywords(question: Column) -> Column:
    """Distinct codes, numbers with units, article numbers, known terms and pairs inside runs of Han characters, in that order."""
    numbers = F.transform(_all(question, KEYWORD_NUMBER), lambda n: F.regexp_replace(n, "\\s+", ""))

    def pairs(run: Column) -> Column:
        n = F.length(run)
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(
        F.concat(F.transform(_all(question, "[A-Za-z]\\d{1,2}"), lambda c: F.upper(c)), numbers, _all(question, ARTICLE), _held(question, KEYWORD_TERMS), F.flatten(F.transform(_all(question, _HAN_RUN), pairs)))
    )


def phrases(question: Column) -> Column:
    """Distinct strong phrases of two characters or more: domain terms, codes, articles, and Han runs between function words."""
    breakers = "|".join(sorted(PHRASE_BREAKERS, key=len, reverse=True))
    runs = _all(F.regexp_replace(question, breakers, " "), _HAN_RUN)
    found = F.concat(_held(question, DOMAIN_TERMS), F.transform(_all(question, "[A-Za-z]\\d{1,3}"), lambda c: F.upper(c)), _all(question, ARTICLE), runs)
    return F.array_distinct(F.filter(found, lambda p: F.length(p) >= 2))


def has_number(text: Column) -> Column:
    return text.rlike(NUMBER_WITH_UNIT)


def land_uses(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, LAND_USE), lambda u: F.upper(u)))


def scope(question: Column) -> Column:
    """The first reason why a question is out of scope, else null."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(OUT_OF_SCOPE):
        out = F.when(question.rlike(pattern), reason).otherwise(out)
    return out


def number_missing(question: Column, texts: Column, cells: Column) -> Column:
    """Whether a number is asked for and neither a measured value, a count nor a digit in a cell is in the evidence."""
    return question.rlike(WANTS_NUMBER) & ~F.exists(texts, lambda t: t.rlike(NUMBER_WITH_UNIT) | t.rlike(COUNT_ANSWER)) & ~F.exists(cells, lambda c: c.rlike("\\d"))


def result_size(question: Column) -> Column:
    """How many results a question gets, by the first signal that fits."""
    any_of = lambda *names: asks(question, names[0]) if len(names) == 1 else asks(question, names[0]) | any_of(*names[1:])
    return (
        F.when(any_of("deliverable", "checklist", "attachment"), 30).when(asks(question, "table_no"), 20).when(asks(question, "indicator"), 12)
        .when(any_of("obligation", "configuration"), 10).when(asks(question, "clause"), 8).otherwise(5)
    )


def type_priority(chunk_type: Column) -> Column:
    out = F.lit(0.3)
    for name, value in TYPE_PRIORITY.items():
        out = F.when(chunk_type == name, value).otherwise(out)
    return out


def intent_score(question: Column, chunk_type: Column, object_type: Column, content: Column, level: Column) -> Column:
    """How well a chunk's kind answers what is asked, 1 at most."""
    kind = F.coalesce(object_type, F.lit(""))
    rules = [
        ("code", (chunk_type == "code") | (kind == "classification_code"), 1.0),
        ("definition", chunk_type == "definition", 1.0),
        ("indicator", (chunk_type == "indicator") | (kind == "indicator_item"), 1.0),
        ("configuration", kind.rlike("indicator|requirement|structured_table_row"), 0.8),
        ("obligation", kind.rlike("requirement|regulation_clause"), 0.9),
        ("deliverable", kind.rlike("deliverable_requirement|drawing_requirement"), 1.0),
        ("drawing", kind == "drawing_requirement", 1.0),
        ("procedure", kind == "procedure_step", 1.0),
        ("checklist", kind == "checklist_item", 1.0),
        ("clause", chunk_type == "clause", 0.9),
        ("numeric", has_number(content), 0.4),
        ("obligation", F.coalesce(level != "unknown", F.lit(False)) & (level != ""), 0.4),
    ]
    total = sum((F.when(asks(question, s) & F.coalesce(c, F.lit(False)), w).otherwise(0.0) for s, c, w in rules), F.lit(0.0))
    return F.least(F.lit(1.0), total)
