"""Column functions over headers, cells and whole tables (arrays of rows of cells)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.rules import squeezed_header, trimmed
from folioforge.functions.text import let

#: The key of a header, by what it holds.
HEADER_KEYS = [
    ("代码|编号", "code"), ("名称|设施|项目|事项|图纸", "name"), ("类别|分类", "category"), ("层级|等级", "level"), ("内容|说明|范围|含义|定义", "description"), ("建筑面积", "building_area"), ("用地面积", "land_area"),
    ("服务半径", "service_radius"), ("服务规模", "service_scale"), ("数量|规模", "scale"), ("单位", "unit"), ("要求", "requirement"), ("阶段", "stage"),
]
UNIT_LIKE = "米|平方米|%|％|处|户|座|个|人|元|份|m²|㎡|/"
STRONG_NAMES, WEAK_NAMES, NUMBERS_ONLY = "名称|设施|术语|代码|对象|项目", "指标|类别|用地|分类|管控", "^[0-9\\s\\-—–./%()（）]+$"
LEAF_ONLY = "服务规模"
#: What speaks for each type of table, and the shape of a code.
CANDIDATES = [
    ("indicator_table", "配置指标|控制指标|规模性指标|千人指标|配建|建筑面积|用地面积|服务规模|一般规模|容积率|建筑高度|建筑规模"),
    ("requirement_table", "配置要求|布局要求|布局引导|管控要求|技术要求|审查要求|详细配置要求|使用说明|要求内容"),
    ("code_table", "类别代码|用地代码|用地分类|主类|中类|小类|类别名称"),
    ("deliverable_table", "成果|图纸|附表|附件|清单|数据库|比例尺|格式要求|提交材料|申报材料|图面要素"),
    ("legend_table", "(?i)图例|图面要素|rgb|颜色|符号|线型"),
]
CODE_CELL = "^[A-Za-z][0-9]{1,3}$|^[0-9]{4,6}$"
SIGNALS = [
    ("classification_code_table", 3, "代码|类别代码|分类代码|编号"), ("classification_code_table", 2, "名称|类别名称|项目名称"), ("classification_code_table", 2, "内容|含义|说明|范围|定义"),
    ("indicator_table", 3, "指标|规模|配置|标准|控制要求"), ("indicator_table", 2, "面积|数量|比例|服务半径|服务规模|人口|户数|容积率|绿地率|高度|密度|单位"), ("requirement_table", 3, "要求|详细配置要求|布局引导|使用说明|管控"),
    ("deliverable_table", 4, "成果名称|图纸名称|成果类型|图纸目录|成果要求|图纸要求"), ("deliverable_table", 3, "成果|图纸|附件|数据库|附表|图则|导则|编制内容"), ("checklist_table", 3, "清单|任务|问题|项目|政策|事项"),
    ("comparison_table", 2, "现状|规划|对比|变化|调整"), ("statistics_table", 2, "统计|合计|小计|比例|汇总"),
]
CODE_SHAPE = "^[A-Za-z][0-9]{1,4}$|^[0-9]{2,8}$|^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+$"
CELL_UNIT = "平方米|米|户|人|%|％|处|个|—|-|~|～"
#: The ladder of types for tables put together from chunks.
CODE_TITLE, CODE_HEADER, CODE_KEY = "用地分类|类别代码|用途分类|分类和代码|代码表", "类别代码|用地代码|主类|中类|小类|代码分类", "(?:^|[\\s、，,])(?:[A-Za-z][0-9]{1,3}|[0-9]{4,6})(?:$|[\\s、，,])"
TITLE_LADDER = [
    ("requirement_table", "配置要求|布局要求|布局引导|管控要求|技术要求|审查要求|使用说明", "配置要求|详细配置要求|管控要求|要求内容"),
    ("deliverable_table", "成果要求|图纸要求|图纸目录|附表|附件|清单|数据库|提交要求|申报材料|审查材料", "成果名称|图纸名称|主要内容|图纸要素|比例尺|格式要求|材料名称"),
    ("legend_table", None, "(?i)图例|颜色|rgb|图面要素|符号|线型"),
    ("indicator_table", "指标表|配置指标|配建指标|规模指标|控制指标", "建筑面积|用地面积|千人指标|服务规模|一般规模|容积率|建筑高度|建筑规模|层级"),
]
#: Units, comparisons and qualifying words of cells.
UNITS = "(?i)(平方米/处|平方米|平方千米|公顷|千米|公里|米|m2|㎡|%|％|万人|人|户|处|个|项|辆|层)"
COMPARISONS = [("不小于|不少于|不低于|大于等于|≥|>=", ">="), ("不大于|不超过|不高于|小于等于|≤|<=", "<="), ("大于|超过|>", ">"), ("小于|低于|<", "<")]
QUALIFIERS = ["原则上", "宜", "可", "应", "应当", "必须", "不得", "不应", "不少于", "不低于", "不小于", "不大于", "不超过", "每千人", "每处", "每个项目", "每个社区", "每个街道"]
#: Number and title of a table, and which headers hold what.
TABLE_NUMBER = "^\\s*(?:续表|表|附表)\\s*([A-Za-z]?[0-9]+(?:[—\\-－.．][A-Za-z0-9]+)*)"
INDICATOR_HEADER = "指标|规模|面积|数量|比例|服务半径|服务规模|人口|户数|容积率|绿地率|高度|密度|单位"
ITEM_HEADER, LEVEL_HEADER, CATEGORY_HEADER, SCALE_HEADER = "设施名称|项目名称|指标名称|事项名称|名称|对象", "层级|等级|级别|类别|分类", "类别|分类", "服务规模|服务范围|服务半径"
#: The columns of each type of table that are always shown.
SHOWN = {
    "indicator_table": "层级|编号|名称|对象|服务规模", "requirement_table": "名称|对象|要求类型|配置要求类型|详细配置要求", "code_table": "代码|名称|上级|父|内容|类别",
    "deliverable_table": "名称|内容|格式|备注|要素", "legend_table": "要素|图例|颜色|要求", "generic_table": "名称|对象|编号",
}
KEY_COLUMNS = "名称|代码|类别|对象|要素|项目|编号"
_CELL = "struct<raw:string,kind:string,min:double,max:double,value:double,unit:string,comparator:string,qualifiers:array<string>>"


def _any(array: Column, pattern: str) -> Column:
    return F.exists(array, lambda x: x.rlike(pattern))


def _unit_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, UNITS, 1), F.lit(""))


def bracketed(header: Column) -> Column:
    """What stands in brackets at the end of a header."""
    return F.nullif(trimmed(F.regexp_extract(header, "[（(]([^）)]+)[）)]\\s*$", 1)), F.lit(""))


def header_unit(header: Column) -> Column:
    """The brackets at the end where they look like a unit."""
    inner = bracketed(header)
    return F.when(inner.rlike(UNIT_LIKE), inner)


def continuation_key(header: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(header, "[（(][^）)]*[）)]", ""), "[\\s\\-—–、，,。；;:：/]+", ""))


def machine_key(header: Column, index: Column) -> Column:
    """A short Latin key: by what the header holds, by its own letters, else by its place (from 0)."""
    ascii_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(header), "[（(][^）)]*[）)]", ""), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(ascii_ != "", ascii_).otherwise(F.concat(F.lit("col_"), (index + 1).cast("string")))
    for pattern, key in reversed(HEADER_KEYS):
        out = F.when(header.rlike(pattern), key).otherwise(out)
    return out


def numbered(names: Column, mark: str) -> Column:
    """The names, with ``mark`` and a count behind those that came before."""
    before = lambda own, x, i: F.size(F.filter(F.slice(own, F.lit(1), i), lambda y: y == x))
    return let(names, lambda own: F.transform(own, lambda x, i: F.concat(x, F.when(F.array_position(own, x) - 1 < i, F.concat(F.lit(mark), (before(own, x, i) + 1).cast("string"))).otherwise(""))))


def flat_headers(headers: Column) -> Column:
    """name, key, path and unit of each header; a header's path are its parts between dashes."""
    clean = F.transform(headers, lambda h, i: trimmed(F.regexp_replace(F.when(h != "", h).otherwise(F.concat(F.lit("列"), (i + 1).cast("string"))), "\\s+", " ")))
    parts = lambda c: F.filter(F.transform(F.split(c, "[—–-]+"), trimmed), lambda p: p != "")
    whole = F.transform(clean, lambda c: let(parts(c), lambda p: F.struct(c.alias("c"), F.when(F.size(p) > 0, p).otherwise(F.array(c)).alias("p"))))

    def flat(w: Column) -> Column:
        names = F.transform(w, lambda x: F.array_join(x["p"], "."))
        keys = numbered(F.transform(names, machine_key), "_")
        return F.transform(F.arrays_zip(w.alias("w"), names.alias("n"), keys.alias("k")), lambda x: F.struct(x["n"].alias("name"), x["k"].alias("key"), x["w"]["p"].alias("path"), bracketed(x["w"]["c"]).alias("unit")))

    return let(whole, flat)


def is_data_row(row: Column) -> Column:
    """Whether a row holds values behind its first cell, or a cell too long for a header."""
    def value(c: Column) -> Column:
        t = trimmed(c)
        return (t != "") & (t.rlike("^[-—–~～/]+$") | (t.rlike("[0-9]") & (F.length(F.regexp_replace(t, "[^一-龥]", "")) <= 2)))

    long = F.exists(row, lambda c: F.length(trimmed(c)) > 20)
    return long | F.exists(F.slice(row, 2, 100_000), value) | ((F.size(row) == 1) & value(F.element_at(row, 1)))


def header_row_count(rows: Column) -> Column:
    """How many of the first three rows are headers: those before the first row of data, one at least."""
    first = F.array_position(F.transform(F.slice(rows, 1, 3), is_data_row), True)
    return F.greatest(F.lit(1), F.when(first > 0, first - 1).otherwise(F.least(F.size(rows), F.lit(3)))).cast("int")


def merged_headers(rows: Column) -> Column:
    """One header a column out of header rows: an empty cell takes the one to its left where a lower row has text; equal parts count once."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda row, c: trimmed(F.coalesce(F.get(row, c), F.lit("")))

    def filled(row: Column, r: Column) -> Column:
        lower = lambda c: F.exists(F.slice(rows, r + 2, F.lit(100_000)), lambda below: cell(below, c) != "")
        left = lambda c: F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(F.sequence(F.lit(0), c), lambda j: cell(row, j)), lambda v: v != "")), -1)
        return F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.when((cell(row, c) != "") | lower(c), left(c)).otherwise(""))

    spread = F.transform(rows, filled)
    paths = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.array_distinct(F.filter(F.transform(spread, lambda row: F.get(row, c)), lambda v: v != "")))
    return F.transform(paths, lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == LEAF_ONLY), F.lit(LEAF_ONLY)).otherwise(F.array_join(p, "-")))


def row_key(row: Column, headers: Column) -> Column:
    """A row's name: from a strongly or weakly naming column, else its first cell that isn't a number, else its first cell."""
    both = F.transform(F.arrays_zip(F.transform(row, trimmed).alias("c"), headers.alias("h")), lambda x: x)

    def first(pattern: str) -> Column:
        return F.get(F.filter(both, lambda x: x["h"].rlike(pattern) & (x["c"] != "") & ~x["c"].rlike(NUMBERS_ONLY)), F.lit(0))["c"]

    cells = F.filter(F.transform(row, trimmed), lambda c: c != "")
    return F.coalesce(first(STRONG_NAMES), first(WEAK_NAMES), F.get(F.filter(cells, lambda c: ~c.rlike(NUMBERS_ONLY)), F.lit(0)), F.get(cells, F.lit(0)), F.lit(""))


def table_confidence(rows: Column) -> Column:
    """score, reasons, negatives, candidates and keep: whether an array of rows is a table."""
    counts = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: trimmed(c) != "")))
    often = lambda n: F.size(F.filter(counts, lambda x: x == n))
    kinds = F.array_distinct(F.filter(counts, lambda n: n >= 1))
    most = F.array_max(F.transform(kinds, often))
    modal = F.coalesce(F.get(F.filter(kinds, lambda n: often(n) == most), F.lit(0)), F.lit(1))
    n = F.size(rows)
    stability = F.when(n > 0, F.size(F.filter(counts, lambda x: F.abs(x - modal) <= 1)) / n).otherwise(0.0)
    cells = F.filter(F.transform(F.flatten(rows), trimmed), lambda c: c != "")
    text = F.array_join(cells, "")
    first = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
    empty_share = F.when(F.size(first) > 0, F.size(F.filter(first, lambda c: trimmed(c) == "")) / F.size(first)).otherwise(0.0)
    prose = F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^，。；：、,.!?！？]", "")) / F.length(text)).otherwise(0.0)
    mean = F.when(F.size(cells) > 0, F.length(text) / F.size(cells)).otherwise(0.0)
    surface = F.array_join(cells, " ")
    named = [F.when(surface.rlike(p), t) for t, p in CANDIDATES]
    coded = F.when(F.size(F.filter(cells, lambda c: c.rlike(CODE_CELL))) >= 2, "code_table")
    candidates = F.array_distinct(F.filter(F.array(*named, coded), lambda c: c.isNotNull()))
    stable = (n >= 3) & (modal >= 2) & (stability >= 0.6)
    known, short = F.size(candidates) > 0, F.exists(cells, lambda c: F.length(c) <= 12)
    raw = sum((F.when(c, w).otherwise(0.0) for c, w in ((stable, 0.4), (n >= 3, 0.1), (modal >= 3, 0.1), (known, 0.3), (short, 0.1))), F.lit(0.0))
    prose_grid = (empty_share > 1 / 3) & (mean >= 24) & (prose >= 0.035)
    loose = (modal < 2) & ~known
    score = F.when(prose_grid, F.least(raw, F.lit(0.2))).otherwise(raw)
    score = F.round(F.when(loose, F.least(score, F.lit(0.15))).otherwise(score), 3)
    listed = lambda *pairs: F.filter(F.array(*[F.when(c, v) for c, v in pairs]), lambda x: x.isNotNull())
    reasons = listed((stable, "stable_2d_grid"), (modal >= 3, "multi_column"), (known, F.concat(F.lit("table_type:"), F.array_join(candidates, "|"))), (short, "has_short_labels"))
    negatives = listed(
        (~stable, "no_stable_grid"), (n < 3, "too_few_rows"), (modal < 2, "single_column"), (~known, "no_table_type_signal"), (empty_share > 1 / 3, "empty_header_ratio"), (prose >= 0.035, "prose_density"),
        (prose_grid, "looks_like_prose_grid"), (loose, "looks_like_prose"),
    )
    keep = ~prose_grid & (known | stable | (score >= 0.3))
    return F.struct(score.alias("score"), reasons.alias("reasons"), negatives.alias("negatives"), candidates.alias("candidates"), keep.alias("keep"))


def table_class(title: Column, headers: Column, rows: Column, section: Column | None = None) -> Column:
    """table_type and confidence by summed weights; ties go to the type that a signal named first."""
    parts = F.concat(F.array(title), section if section is not None else F.array().cast("array<string>"), headers, F.flatten(F.slice(rows, 1, 5)))
    surface = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")
    names = list(dict.fromkeys(t for t, *_ in SIGNALS))
    own = {t: sum((F.when(surface.rlike(p), w).otherwise(0) for s, w, p in SIGNALS if s == t), F.lit(0)) for t in names}
    paired = _any(headers, "代码|编号") & _any(headers, "名称")
    coded = F.exists(F.flatten(rows), lambda c: trimmed(c).rlike(CODE_SHAPE))
    measured = F.size(F.filter(F.flatten(rows), lambda c: c.rlike("[0-9]") & c.rlike(CELL_UNIT))) >= 2
    code, indicator = names[0], names[1]
    late = own[indicator] == 0
    total = {**own, code: F.when(paired & coded, own[code] + 3).otherwise(0), indicator: own[indicator] + F.when(measured, 2).otherwise(0)}
    order = {t: F.when(late, len(names)).otherwise(i) if t == indicator else F.lit(i) for i, t in enumerate(names)}
    ranked = F.array_sort(F.array(*[F.struct((-total[t]).alias("score"), order[t].cast("int").alias("place"), F.lit(t).alias("type")) for t in names]))
    best = F.element_at(ranked, 1)
    found = best["score"] < 0
    return F.struct(F.when(found, best["type"]).otherwise("unknown_table").alias("table_type"), F.when(found, F.round(F.least(F.lit(0.95), 0.45 - best["score"] * 0.08), 6)).otherwise(0.35).alias("confidence"))


def rag_table_type(title: Column, headers: Column, keys: Column) -> Column:
    """The type of a table put together from chunks: code, requirement, deliverable, legend, indicator, else generic."""
    t, h = F.coalesce(title, F.lit("")), F.array_join(headers, " ")
    out = F.when((t.rlike(CODE_TITLE) | h.rlike(CODE_HEADER)) & keys.rlike(CODE_KEY), "code_table")
    for name, by_title, by_header in TITLE_LADDER:
        out = out.when(h.rlike(by_header) | (t.rlike(by_title) if by_title else F.lit(False)), name)
    return out.otherwise("generic_table")


def normal_cell(raw: Column, header: Column) -> Column:
    """kind, bounds, value, unit, comparator and qualifiers of a cell; a number after a hyphen keeps the hyphen as its sign."""
    text = trimmed(F.regexp_replace(F.coalesce(raw, F.lit("")), "\\s+", " "))

    def read(x: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(x["text"], F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), lambda n: n.cast("double"))
        comparator = F.lit("unknown")
        for pattern, sign in reversed(COMPARISONS):
            comparator = F.when(x["text"].rlike(pattern), sign).otherwise(comparator)
        unit = F.coalesce(_unit_in(x["text"]), _unit_in(header))
        return F.struct(x["raw"].alias("raw"), x["text"].alias("text"), numbers.alias("numbers"), comparator.alias("comparator"), unit.alias("unit"))

    return let(let(F.struct(raw.alias("raw"), text.alias("text")), read), _normal)


def _normal(x: Column) -> Column:
    text, numbers, comparator, unit = (x[c] for c in ("text", "numbers", "comparator", "unit"))
    qualifiers = F.filter(F.array(*[F.lit(q) for q in QUALIFIERS]), lambda q: F.contains(text, q))
    percent = F.coalesce(unit.isin("%", "％"), F.lit(False))
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    none = F.lit(None).cast("double")

    def made(kind: Column | str, low: Column = none, high: Column = none, value: Column = none, sign: Column | str = "unknown", with_unit: bool = True, with_words: bool = True) -> Column:
        kind, sign = (F.lit(v) if isinstance(v, str) else v for v in (kind, sign))
        words = qualifiers if with_words else F.lit(None).cast("array<string>")
        return F.struct(x["raw"].alias("raw"), kind.alias("kind"), low.alias("min"), high.alias("max"), value.alias("value"), (unit if with_unit else F.lit(None).cast("string")).alias("unit"), sign.alias("comparator"), words.alias("qualifiers")).cast(_CELL)

    number = F.when(percent, "percentage").otherwise("number")
    return (
        F.when(text == "", made("empty", with_unit=False, with_words=False))
        .when(text.rlike("^[-—–~～/\\\\]*$"), made("not_applicable", with_unit=False, with_words=False))
        .when((F.size(numbers) >= 2) & text.rlike("[-—–~～至到]"), made(F.when(percent, "percentage").otherwise("range"), first, second, sign="range"))
        .when((F.size(numbers) >= 1) & (comparator == ">="), made(number, low=first, sign=comparator))
        .when((F.size(numbers) >= 1) & (comparator == "<="), made(number, high=first, sign=comparator))
        .when(F.size(numbers) >= 1, made(number, value=first, sign=F.when(comparator.isin(">", "<"), comparator).otherwise("=")))
        .otherwise(made("text"))
    )


def normal_fields(fields: Column) -> Column:
    """A map of fields with every cell normalised, its header as context."""
    return F.transform_values(fields, lambda header, raw: normal_cell(raw, header))


def table_number(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, TABLE_NUMBER, 1), F.lit(""))


def table_title(title: Column) -> Column:
    """The title behind the number; the whole one where nothing is left."""
    rest = trimmed(F.regexp_replace(title, TABLE_NUMBER, ""))
    return F.nullif(F.when(rest != "", rest).otherwise(trimmed(title)), F.lit(""))


def shown_columns(question: Column, table_type: Column, headers: Column, keys: Column, rows: Column) -> Column:
    """Places (from 0) of the columns of a table that a question needs: those that name rows, that it asks for, and the type's own; all if less than two.

    keys: the names of the chosen rows; rows: their cells.
    """
    asked = squeezed_header(question)
    default = F.lit(SHOWN["generic_table"])
    for name, pattern in SHOWN.items():
        default = F.when(table_type == name, F.lit(pattern)).otherwise(default)

    def needed(h: Column, i: Column) -> Column:
        plain = squeezed_header(h)
        holds = F.exists(rows, lambda r: F.coalesce(F.array_contains(F.filter(keys, lambda k: k != ""), trimmed(F.get(r, i))), F.lit(False)))
        parts = F.filter(F.transform(F.split(F.regexp_replace(h, "[（(][^）)]*[）)]", ""), "-"), trimmed), lambda p: p != "")
        named = (plain != "") & (F.contains(asked, plain) | F.contains(plain, asked) | F.exists(parts, lambda p: F.contains(question, p)))
        return h.rlike(KEY_COLUMNS) | holds | named | F.regexp_like(h, default)

    every = F.sequence(F.lit(0), F.size(headers) - 1)
    chosen = F.filter(F.transform(headers, lambda h, i: F.when(needed(h, i), i)), lambda i: i.isNotNull())
    return F.when((F.size(headers) <= 2) | (F.size(chosen) < 2), every).otherwise(chosen)


def citation_text(document: Column, title: Column, first: Column, last: Column) -> Column:
    """Document, table and its page or pages."""
    page = F.when(first == last, F.concat(F.lit("第"), first.cast("string"), F.lit("页"))).otherwise(F.concat(F.lit("第"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("页")))
    page = F.when(first.isNotNull() & (last > 0), page)
    return F.array_join(F.filter(F.array(document, title, page), lambda p: p.isNotNull() & (p != "")), " ")
