"""Queries over headers, cells, tables and evidence. Each key of ``part`` stands for a table (or a citation) whose text is chosen
and filled by the key, so that every branch occurs at every size; cells are parted by ``|``, rows by ``//``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import cells as C
from folioforge.functions import evidence as E
from folioforge.functions import rules as R
from folioforge.operators import records
from folioforge.plans.common import ladder, register, sample, table
from folioforge.plans.regulations import _BARE, _NOISY

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

TITLES = ["表3-1 公共设施配置指标表", "表2 用地分类代码", "附表1 成果要求", "续表 4 管控要求", "", "任务清单", "现状统计", "图例", "表5"]
HEADERS = [
    "设施名称|层级|建筑面积（平方米/处）|服务规模", "类别代码|类别名称|内容", "成果名称|格式要求|备注", "项目|管控要求", "|列二", "事项|责任", "现状|规划|合计", "图面要素|颜色", "指标—最低|数量(个)|Name A|其他",
]
ROWS = [
    "幼儿园|社区级|{n}-4500|每1万人1处//小学|街道级|≥{n}平方米|服务规模：0万.9人6//合计||100|", "A1|行政办公|机关用地//R{n}|住宅|居住//续写行||内容", "总平面图|1:{n}|必选//说明书|文本|", "退线|不应小于{n}米//绿地|宜设置",
    "这是一段很长的文字，用来说明为什么它不是表格，而是正文，内容。|{n}", "问题{n}|某部门//任务|某处//事项|", "1|2|3//{n}|5|9//4|5|6", "道路红线|红//绿线|含 {n}层绿", "—|{n}%|x|//10|超过{n}户|y|-",
]


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda text, by: F.split(F.expr(sample("p_partkey", text)), by)
    rows = F.transform(split(ROWS, "//"), lambda r: F.split(r, "\\|"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(sample("p_partkey", TITLES)).alias("title"), split(HEADERS, "\\|").alias("headers"), rows.alias("rows"))


_TABLES = f"""tables as (select p_partkey, p_size, {sample('p_partkey', TITLES)} as title, string_split({sample('p_partkey', HEADERS)}, '|') as headers,
    list_transform(string_split({sample('p_partkey', ROWS)}, '//'), lambda r: string_split(r, '|')) as rows from part)"""
_BRACKET = "nullif(trim(regexp_extract({h}, '[（(]([^）)]+)[）)]\\s*$', 1)), '')"
_CANON = "lower(regexp_replace(regexp_replace({h}, '[（(][^）)]*[）)]', '', 'g'), '[\\s\\-—－/、，,。．.:：|]+', '', 'g'))"
_MACHINE = "case " + " ".join(f"when regexp_matches({{h}}, '{p}') then '{k}'" for p, k in C.HEADER_KEYS) + " else coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower({h}), '[（(][^）)]*[）)]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), concat('col_', i)) end"


@query(
    f"""with {_TABLES}, h as (select p_partkey, unnest(headers) as h, generate_subscripts(headers, 1) as i from tables)
    select p_partkey, i as place, {_CANON.format(h='h')} as canonical, lower(regexp_replace(regexp_replace(h, '[（(][^）)]*[）)]', '', 'g'), '[\\s\\-—–、，,。；;:：/]+', '', 'g')) as continuation,
    case when regexp_matches({_BRACKET.format(h='h')}, '{C.UNIT_LIKE}') then {_BRACKET.format(h='h')} end as unit, {_MACHINE.format(h='h')} as key from h"""
)
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, units and machine keys of headers."""
    rows = _tables(spark, sf_dir).select("p_partkey", F.posexplode("headers").alias("i", "h"))
    h = F.col("h")
    return rows.select("p_partkey", (F.col("i") + 1).cast("long").alias("place"), R.squeezed_header(h).alias("canonical"), C.continuation_key(h).alias("continuation"), C.header_unit(h).alias("unit"), C.machine_key(h, F.col("i")).alias("key"))


_FLAT = f"""flat as (select p_partkey, list_transform(headers, lambda h, i: trim(regexp_replace(case when h <> '' then h else concat('列', i) end, '\\s+', ' ', 'g'))) as clean from tables),
    path as (select p_partkey, clean, list_transform(clean, lambda c: list_filter(list_transform(regexp_split_to_array(c, '[—–-]+'), lambda x: trim(x)), lambda x: x <> '')) as paths from flat),
    named as (select p_partkey, clean, paths, list_transform(paths, lambda x, i: case when len(x) > 0 then array_to_string(x, '.') else clean[i] end) as names from path)"""


@query(
    f"""with {_TABLES}, {_FLAT}, k as (select p_partkey, unnest(clean) as c, unnest(names) as name, unnest(paths) as p, generate_subscripts(names, 1) as i from named),
    b as (select *, {_MACHINE.format(h='name')} as base from k), n as (select *, row_number() over (partition by p_partkey, base order by i) as seen from b)
    select p_partkey, i as place, name, case when seen = 1 then base else concat(base, '_', seen) end as key, case when len(p) > 0 then array_to_string(p, '>') else c end as path, {_BRACKET.format(h='c')} as unit from n"""
)
def header_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables(spark, sf_dir).select("p_partkey", F.posexplode(C.flat_headers(F.col("headers"))).alias("i", "x"))
    return rows.select("p_partkey", (F.col("i") + 1).cast("long").alias("place"), "x.name", "x.key", F.array_join("x.path", ">").alias("path"), "x.unit")


HEADS = ["名称||面积//|设施|建筑|用地//幼儿园|甲|{n}|2", "类别|规模||服务规模//代码|一般规模|服务规模|//A{n}|1|2|3", "甲|乙//丙|丁//戊|己//庚|辛", "项目|说明//退线|这是一个超过二十个字的长单元格用来表示正文数据而不是表头", "{n}", "名称|数量//x|{n}", "名||//||尾"]
_ALL = f"select p_partkey, list_transform(string_split({sample('p_partkey', HEADS)}, '//'), lambda r: string_split(r, '|')) as rows from part"
_VALUE = "(trim({c}) <> '' and (regexp_matches(trim({c}), '^[-—–~～/]+$') or (regexp_matches({c}, '[0-9]') and length(regexp_replace({c}, '[^一-龥]', '', 'g')) <= 2)))"


@query(
    f"""with t as ({_ALL}), d as (select *, list_transform(list_slice(rows, 1, 3), lambda r: len(list_filter(r, lambda c, i: length(trim(c)) > 20 or ((i > 1 or len(r) = 1) and {_VALUE.format(c='c')}))) > 0) as data from t),
    n as (select *, greatest(1, coalesce(list_position(data, true) - 1, least(len(rows), 3))) as n from d),
    c as (select p_partkey, n, list_slice(rows, 1, n) as h, unnest(range(1, list_max(list_transform(list_slice(rows, 1, n), lambda r: len(r))) + 1)) as col from n),
    f as (select p_partkey, n, col, list_distinct(list_filter(list_transform(h, lambda r, k: case when coalesce(trim(r[col]), '') <> '' or len(list_filter(list_slice(h, k + 1, 100), lambda b: coalesce(trim(b[col]), '') <> '')) > 0
        then coalesce(list_filter(list_transform(range(1, col + 1), lambda j: trim(r[j])), lambda v: v <> '')[-1], '') else '' end), lambda v: v <> '')) as d,
        list_filter(list_transform(h, lambda r, k: case when coalesce(trim(r[col]), '') <> '' or len(list_filter(list_slice(h, k + 1, 100), lambda b: coalesce(trim(b[col]), '') <> '')) > 0
        then coalesce(list_filter(list_transform(range(1, col + 1), lambda j: trim(r[j])), lambda v: v <> '')[-1], '') else '' end), lambda v: v <> '') as p from c),
    o as (select p_partkey, n, col, list_filter(p, lambda v, i: list_position(p, v) = i) as p from f)
    select p_partkey, n as header_rows, string_agg(case when len(p) > 1 and p[-1] = '服务规模' then p[-1] else array_to_string(p, '-') end, '|' order by col) as headers from o group by p_partkey, n"""
)
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a table are headers, and the merged ones with parents spread over the columns they span."""
    rows = F.transform(F.split(F.expr(sample("p_partkey", HEADS)), "//"), lambda r: F.split(r, "\\|"))
    found = table(spark, sf_dir, "part").select("p_partkey", rows.alias("rows")).withColumn("n", C.header_row_count(F.col("rows")))
    return found.select("p_partkey", F.col("n").cast("long").alias("header_rows"), F.array_join(C.merged_headers(F.slice("rows", F.lit(1), F.col("n"))), "|").alias("headers"))


_KEY = """coalesce(list_filter(list_transform(headers, lambda h, i: case when regexp_matches(h, '{strong}') and trim(r[i]) <> '' and not regexp_matches(trim(r[i]), '{numbers}') then trim(r[i]) end), lambda x: x is not null)[1],
    list_filter(list_transform(headers, lambda h, i: case when regexp_matches(h, '{weak}') and trim(r[i]) <> '' and not regexp_matches(trim(r[i]), '{numbers}') then trim(r[i]) end), lambda x: x is not null)[1],
    list_filter(r, lambda c: trim(c) <> '' and not regexp_matches(trim(c), '{numbers}'))[1], list_filter(r, lambda c: trim(c) <> '')[1], '')""".format(strong=C.STRONG_NAMES, weak=C.WEAK_NAMES, numbers=C.NUMBERS_ONLY)


@query(f"with {_TABLES}, r as (select p_partkey, headers, unnest(rows) as r, generate_subscripts(rows, 1) - 1 as row_index from tables) select p_partkey, row_index, {_KEY} as row_key from r")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables(spark, sf_dir).select("p_partkey", "headers", F.posexplode("rows").alias("row_index", "r"))
    return rows.select("p_partkey", F.col("row_index").cast("long").alias("row_index"), C.row_key(F.col("r"), F.col("headers")).alias("row_key"))


_KINDS = "[" + ", ".join(f"case when regexp_matches(array_to_string(cells, ' '), '{p}') then '{t}' end" for t, p in C.CANDIDATES) + f", case when len(list_filter(cells, lambda c: regexp_matches(c, '{C.CODE_CELL}'))) >= 2 then 'code_table' end]"


@query(
    f"""with {_TABLES}, a as (select p_partkey, list_prepend(headers, rows) as m from tables),
    b as (select *, list_transform(m, lambda r: len(list_filter(r, lambda c: trim(c) <> ''))) as counts, list_filter(list_transform(flatten(m), lambda c: trim(c)), lambda c: c <> '') as cells, array_to_string(list_filter(list_transform(flatten(m), lambda c: trim(c)), lambda c: c <> ''), '') as text from a),
    f as (select *, list_transform(counts, lambda n: case when n >= 1 then len(list_filter(counts, lambda x: x = n)) else 0 end) as often from b),
    c as (select *, coalesce(counts[list_position(often, nullif(list_max(often), 0))], 1) as modal, {_KINDS} as k0 from f),
    d as (select *, len(list_filter(counts, lambda x: abs(x - modal) <= 1)) / len(m) as stability, list_filter(k0, lambda x, i: x is not null and list_position(k0, x) = i) as kinds, len(list_filter(m[1], lambda c: trim(c) = '')) / len(m[1]) as empty,
        length(regexp_replace(text, '[^，。；：、,.!?！？]', '', 'g')) / greatest(length(text), 1) as prose, length(text) / greatest(len(cells), 1) as mean from c),
    e as (select *, len(m) >= 3 and modal >= 2 and stability >= 0.6 as stable, len(kinds) > 0 as known, len(list_filter(cells, lambda c: length(c) <= 12)) > 0 as short, empty > 1 / 3 and mean >= 24 and prose >= 0.035 as grid from d),
    s as (select *, (case when stable then 0.4 else 0 end + case when len(m) >= 3 then 0.1 else 0 end + case when modal >= 3 then 0.1 else 0 end + case when known then 0.3 else 0 end + case when short then 0.1 else 0 end)::double as raw, modal < 2 and not known as loose from e),
    g as (select *, round(least(raw, case when grid then 0.2 else 9 end, case when loose then 0.15 else 9 end)::double, 3) as score from s)
    select p_partkey, score, array_to_string(kinds, '|') as candidates, concat_ws(',', case when stable then 'stable_2d_grid' end, case when modal >= 3 then 'multi_column' end, case when known then 'table_type:' || array_to_string(kinds, '|') end, case when short then 'has_short_labels' end) as reasons,
    concat_ws(',', case when not stable then 'no_stable_grid' end, case when len(m) < 3 then 'too_few_rows' end, case when modal < 2 then 'single_column' end, case when not known then 'no_table_type_signal' end, case when empty > 1 / 3 then 'empty_header_ratio' end, case when prose >= 0.035 then 'prose_density' end,
    case when grid then 'looks_like_prose_grid' end, case when loose then 'looks_like_prose' end) as negatives, not grid and (known or stable or score >= 0.3) as keep from g"""
)
def table_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables(spark, sf_dir).select("p_partkey", C.table_confidence(F.concat(F.array("headers"), F.col("rows"))).alias("c"))
    return rows.select("p_partkey", "c.score", F.array_join("c.candidates", "|").alias("candidates"), F.array_join("c.reasons", ",").alias("reasons"), F.array_join("c.negatives", ",").alias("negatives"), "c.keep")


_NAMES = list(dict.fromkeys(t for t, *_ in C.SIGNALS))
_WEIGHTS = ", ".join("(" + " + ".join(f"case when regexp_matches(surface, '{p}') then {w} else 0 end" for t, w, p in C.SIGNALS if t == name) + f") as w{i}" for i, name in enumerate(_NAMES))
_CLASS = f"""surf as (select *, concat_ws(' ', nullif(title, ''), nullif(array_to_string(list_filter(headers, lambda h: h <> ''), ' '), ''), array_to_string(list_filter(flatten(list_slice(rows, 1, 5)), lambda c: c <> ''), ' ')) as surface from tables),
    weigh as (select *, {_WEIGHTS}, len(list_filter(headers, lambda h: regexp_matches(h, '代码|编号'))) > 0 and len(list_filter(headers, lambda h: regexp_matches(h, '名称'))) > 0 as paired,
      len(list_filter(flatten(rows), lambda c: regexp_matches(trim(c), '{C.CODE_SHAPE}'))) > 0 as coded, len(list_filter(flatten(rows), lambda c: regexp_matches(c, '[0-9]') and regexp_matches(c, '{C.CELL_UNIT}'))) >= 2 as measured from surf),
    vote as (select *, unnest([{', '.join(f"'{n}'" for n in _NAMES)}]) as type, unnest([case when paired and coded then w0 + 3 else 0 end, w1 + case when measured then 2 else 0 end, {', '.join(f'w{i}' for i in range(2, len(_NAMES)))}]) as total,
      unnest([0, case when w1 = 0 then 99 else 1 end, {', '.join(str(i) for i in range(2, len(_NAMES)))}]) as place from weigh),
    class as (select p_partkey, coalesce(arg_max(type, total * 1000 - place) filter (total > 0), 'unknown_table') as table_type, case when max(total) > 0 then round(least(0.95, 0.45 + max(total) * 0.08)::double, 6) else 0.35 end as confidence from vote group by p_partkey)"""
_KEYS_TEXT = "array_to_string(list_transform(rows, lambda r: r[1]), ' ')"
_LADDER = f"case when (regexp_matches(title, '{C.CODE_TITLE}') or regexp_matches(h, '{C.CODE_HEADER}')) and regexp_matches(k, '{C.CODE_KEY}') then 'code_table' " + " ".join(
    f"when regexp_matches(h, '{bh}')" + (f" or regexp_matches(title, '{bt}')" if bt else "") + f" then '{n}'" for n, bt, bh in C.TITLE_LADDER
) + " else 'generic_table' end"


@query(f"with {_TABLES}, {_CLASS}, h as (select p_partkey, title, array_to_string(headers, ' ') as h, {_KEYS_TEXT} as k from tables) select p_partkey, table_type, confidence, {_LADDER} as chunk_type from class join h using (p_partkey)")
def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a table by weighted votes, and by the ladder for tables put together from chunks."""
    rows = _tables(spark, sf_dir)
    found = rows.select("p_partkey", C.table_class(F.col("title"), F.col("headers"), F.col("rows")).alias("c"), C.rag_table_type(F.col("title"), F.col("headers"), F.array_join(F.transform("rows", lambda r: F.get(r, F.lit(0))), " ")).alias("chunk_type"))
    return found.select("p_partkey", "c.table_type", "c.confidence", "chunk_type")


_CELLTEXT = "trim(regexp_replace(coalesce({r}, ''), '\\s+', ' ', 'g'))"
_UNIT_SQL = "nullif(regexp_extract({x}, '" + C.UNITS + "', 1), '')"
_NORMAL = f"""select *, case when t = '' then 'empty' when dash then 'not_applicable' when ranged then case when pct then 'percentage' else 'range' end when len(x) >= 1 then case when pct then 'percentage' else 'number' end else 'text' end as kind,
    case when t = '' or dash then null when ranged then x[1] when cmp = '>=' then x[1] end as low, case when t = '' or dash then null when ranged then x[2] when cmp = '<=' then x[1] end as high, case when t <> '' and not dash and not ranged and cmp not in ('>=', '<=') then x[1] end as value,
    case when t <> '' and not dash then u end as unit, case when t = '' or dash then 'unknown' when ranged then 'range' when len(x) = 0 then 'unknown' when cmp = 'unknown' then '=' else cmp end as comparator,
    case when t <> '' and not dash then array_to_string(list_filter({C.QUALIFIERS}, lambda q: contains(t, q)), ',') end as qualifiers
    from (select *, regexp_matches(t, '^[-—–~～/\\\\]*$') and t <> '' as dash, len(x) >= 2 and regexp_matches(t, '[-—–~～至到]') and not regexp_matches(t, '^[-—–~～/\\\\]*$') as ranged, coalesce(u in ('%', '％'), false) as pct, {ladder('t', C.COMPARISONS)} as cmp
      from (select *, list_transform(regexp_extract_all(t, '-?[0-9]+(?:\\.[0-9]+)?'), lambda v: cast(v as double)) as x, coalesce({_UNIT_SQL.format(x='t')}, {_UNIT_SQL.format(x='h')}) as u from (select *, {_CELLTEXT.format(r='raw')} as t from ("""


@query(f"with {_TABLES}, c as (select p_partkey, headers, unnest(rows) as r, generate_subscripts(rows, 1) - 1 as row_index from tables), d as (select p_partkey, row_index, unnest(headers) as h, unnest(r) as raw, generate_subscripts(headers, 1) as place from c) select p_partkey, row_index, place, kind, low, high, value, unit, comparator, qualifiers from ({_NORMAL}select * from d where h is not null and raw is not null)))))")
def normal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell normalised with its header as context."""
    rows = _tables(spark, sf_dir).select("p_partkey", "headers", F.posexplode("rows").alias("row_index", "r"))
    each = rows.select("p_partkey", "row_index", F.posexplode(F.arrays_zip(F.col("headers").alias("h"), F.col("r").alias("raw"))).alias("i", "x")).where("x.h is not null and x.raw is not null")
    found = each.select("p_partkey", F.col("row_index").cast("long").alias("row_index"), (F.col("i") + 1).cast("long").alias("place"), C.normal_cell(F.col("x.raw"), F.col("x.h")).alias("c"))
    return found.select("p_partkey", "row_index", "place", "c.kind", F.col("c.min").alias("low"), F.col("c.max").alias("high"), "c.value", "c.unit", "c.comparator", F.array_join("c.qualifiers", ",").alias("qualifiers"))


_TITLE_REST = f"trim(regexp_replace(title, '{C.TABLE_NUMBER}', ''))"
_STRUCT = f"""{_TABLES}, {_CLASS}, {_FLAT}, r as (select p_partkey, title, named.names as headers, unnest(rows) as r, generate_subscripts(rows, 1) - 1 as row_index from tables join named using (p_partkey)),
    srow as (select p_partkey, row_index, headers as names, r, {_KEY} as row_key, list_filter(list_transform(headers, lambda h, i: case when trim(r[i]) <> '' then concat(h, '：', trim(r[i])) end), lambda x: x is not null) as f,
      nullif(regexp_extract(title, '{C.TABLE_NUMBER}', 1), '') as table_no, nullif(case when {_TITLE_REST} <> '' then {_TITLE_REST} else trim(title) end, '') as table_title from r)"""


@query(f"with {_STRUCT} select p_partkey, row_index, row_key, array_to_string(f, '。') as content, table_no, table_title, table_type, confidence from srow join class using (p_partkey)")
def table_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each row of each table."""
    rows = records.structured_rows(_as_tables(spark, sf_dir))
    return rows.select(F.col("doc_id").alias("p_partkey"), F.col("row_index").cast("long").alias("row_index"), "row_key", "content", "table_no", "table_title", "table_type", "confidence")


def _as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).withColumn("doc_id", F.col("p_partkey")).withColumn("table_id", F.col("p_size"))


def _first_header(pattern: str) -> str:
    return f"list_filter(names, lambda h, i: regexp_matches(h, '{pattern}') and trim(r[i]) <> '')[1]"


def _field(pattern: str) -> str:
    return f"trim(r[list_position(names, {_first_header(pattern)})])"


@query(
    f"""with {_STRUCT}, fits as (select srow.*, table_type from srow join class using (p_partkey) where table_type = 'indicator_table' or len(list_filter(names, lambda h: regexp_matches(h, '{C.INDICATOR_HEADER}'))) > 0),
    cell as (select p_partkey, row_index, unnest(names) as h, unnest(r) as raw, generate_subscripts(names, 1) as place from fits), val as ({_NORMAL}select * from cell where h is not null and trim(raw) <> '' and place <= 99))))),
    kept as (select p_partkey, row_index, count(*) as n_values, sum(coalesce(low, 0) + coalesce(high, 0) + coalesce(value, 0)) as total, arg_min(unit, place) filter (unit is not null) as unit from val where (regexp_matches(h, '{C.INDICATOR_HEADER}') or kind <> 'text') and (low is not null or high is not null or value is not null) group by all)
    select p_partkey, row_index, coalesce({_field(C.ITEM_HEADER)}, nullif(row_key, '')) as item, {_field(C.LEVEL_HEADER)} as level, {_field(C.CATEGORY_HEADER)} as category, {_field(C.SCALE_HEADER)} as service_scale, {_first_header(C.INDICATOR_HEADER)} as indicator, n_values, round(total, 4) as total, unit,
    cast(case when table_type = 'indicator_table' then 0.88 else 0.68 end as double) as confidence from fits join kept using (p_partkey, row_index) where coalesce({_field(C.ITEM_HEADER)}, nullif(row_key, '')) is not null"""
)
def indicator_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of rows that hold numbers under fitting headers."""
    found = records.indicators(records.structured_rows(_as_tables(spark, sf_dir)))
    sums = F.aggregate("values", F.lit(0.0), lambda t, v: t + F.coalesce(v["min"], F.lit(0.0)) + F.coalesce(v["max"], F.lit(0.0)) + F.coalesce(v["value"], F.lit(0.0)))
    return found.select(F.col("doc_id").alias("p_partkey"), F.col("row_index").cast("long").alias("row_index"), "item", "level", "category", "service_scale", "indicator", F.size("values").cast("long").alias("n_values"), F.round(sums, 4).alias("total"), "unit", "confidence")


_FLAGS = f"select *, regexp_matches(b, '{R.CORRUPT_NUMBER}') as corrupt, regexp_matches(b, '{R.GLUED}') as glued, {_NOISY} as noisy from (select *, {_BARE} as b from "


@query(
    f"""with {_TABLES}, c as (select p_partkey, generate_subscripts(rows, 1) as row, unnest(rows) as r from tables), d as (select p_partkey, row, unnest(r) as t from c), q as ({_FLAGS} d)),
    s as (select p_partkey, count(*) filter (corrupt or glued or noisy) as f, count(*) filter (corrupt) as s from q group by p_partkey)
    select p_size, count(*) as tables, cast(sum(len(rows)) as bigint) as rows, cast(sum(len(headers)) as bigint) as header_cells, cast(sum(len(list_filter(headers, lambda h: trim(h) = ''))) as bigint) as empty_headers, round(sum(len(list_filter(headers, lambda h: trim(h) = ''))) / sum(len(headers)), 4) as empty_header_ratio,
    count(*) filter (trim(title) = '') as untitled, round(count(*) filter (trim(title) = '') / count(*), 4) as untitled_ratio, cast(sum(f) as bigint) as flagged_cells, count(*) filter (f > 0) as flagged_tables, cast(sum(s) as bigint) as scrambled_cells from tables join s using (p_partkey) group by p_size"""
)
def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_quality(_tables(spark, sf_dir), ["p_size"])


@query(
    f"""with {_TABLES}, w as (select *, list_max(list_transform(rows, lambda r: len(r))) as cols from tables), e as (select *, list_transform(range(1, cols + 1), lambda c: len(list_filter(rows, lambda r: coalesce(trim(r[c]), '') <> ''))) as filled from w)
    select p_size, count(*) as tables, cast(sum(len(rows)) as bigint) as total_rows, max(len(list_filter(filled, lambda x: x >= 2))) as widest, round(1 - sum(list_sum(filled)) / sum(cols * len(rows)), 4) as empty_cell_rate, count(*) filter (len(list_filter(rows[1], lambda c: trim(c) = '')) > 0) as headless from e group by p_size"""
)
def table_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.table_set(_tables(spark, sf_dir), ["p_size"])


@query(
    f"""with {_TABLES}, c as (select p_partkey, generate_subscripts(rows, 1) - 1 as row_index, unnest(rows) as r from tables), d as (select p_partkey, row_index, unnest(list_append(r, array_to_string(r, '。'))) as t from c), q as ({_FLAGS} (select * from d where trim(t) <> ''))),
    w as (select p_partkey, row_index, bool_or(corrupt) as corrupt, bool_or((glued or noisy) and not corrupt) as noise, bool_or(corrupt or glued or noisy) as flagged from q group by all)
    select p_partkey, count(*) as rows, count(*) filter (flagged) as flagged, bool_or(flagged) as suppressed, count(*) filter (corrupt) as scrambled, count(*) filter (noise) as noisy from w group by p_partkey"""
)
def row_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows of each table, and whether the table is suppressed."""
    rows = _tables(spark, sf_dir).select("p_partkey", F.posexplode("rows").alias("row_index", "cells")).withColumn("content", F.array_join("cells", "。"))
    found = records.row_quality(rows)
    kinds = found.groupBy("p_partkey").agg(F.count_if(F.array_contains("warnings", "scrambled_numeric_unit")).alias("scrambled"), F.count_if(F.array_contains("warnings", "noisy_extraction_text")).alias("noisy"))
    return records.suppressed_tables(found, ["p_partkey"]).join(kinds, "p_partkey")


_TOKENS = "list_concat(regexp_extract_all(lower({x}), '[a-z]+[0-9]+|[0-9]+(?:[.\\-~][0-9]+)*|[a-z]{{2,}}'), list_transform(regexp_extract_all({x}, '[A-Za-z][0-9]{{1,3}}'), lambda c: upper(c)), regexp_extract_all({x}, '[一二三四五六七八九十百0-9]+(?:\\.[0-9]+)+'), regexp_extract_all({x}, '第[一二三四五六七八九十百零0-9]+条'), regexp_extract_all({x}, '[一-龥]'), list_transform(range(1, len(regexp_extract_all({x}, '[一-龥]'))), lambda i: concat(regexp_extract_all({x}, '[一-龥]')[i], regexp_extract_all({x}, '[一-龥]')[i + 1])))"
ASKED = ["幼儿园的服务规模", "R{n}住宅用地", "总平面图比例", "绿地退线要求", "问题{n}由哪个部门负责", "规划合计"]


@query(
    f"""with {_TABLES}, q as (select p_partkey, {sample('p_partkey + p_size', ASKED)} as q from part), r as (select p_partkey, generate_subscripts(rows, 1) - 1 as row_index, array_to_string(unnest(rows), ' ') as s from tables),
    t as (select p_partkey, row_index, len(list_filter({_TOKENS.format(x='s')}, lambda x: list_contains({_TOKENS.format(x='q')}, x))) as score from r join q using (p_partkey) where not regexp_matches(s, '^合计'))
    select p_partkey, row_index, score, row_number() over (partition by p_partkey order by score desc, row_index) as rank from t where score > 0 qualify rank <= 8"""
)
def in_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a table that share most with the question about it."""
    rows = _tables(spark, sf_dir).select("p_partkey", F.posexplode("rows").alias("row_index", "r"))
    text = F.array_join("r", " ")
    rows = rows.select("p_partkey", "row_index", text.alias("search_text"), F.when(text.rlike("^合计"), "summary").otherwise("data").alias("row_type"), F.lit(False).alias("low_fidelity"))
    asked = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("question_id"), F.expr(sample("p_partkey + p_size", ASKED)).alias("question"))
    found = records.rows_in_table(asked, rows, ["p_partkey"])
    return found.select("p_partkey", F.col("row_index").cast("long").alias("row_index"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


_DEFAULTS = "case chunk_type " + " ".join(f"when '{k}' then '{v}'" for k, v in C.SHOWN.items()) + " end"


@query(
    f"""with {_TABLES}, q as (select p_partkey, {sample('p_partkey + p_size', ASKED)} as q from part), h as (select p_partkey, title, headers, rows, array_to_string(headers, ' ') as h, {_KEYS_TEXT} as k from tables), y as (select *, {_LADDER} as chunk_type from h),
    z as (select *, {_DEFAULTS} as shown, list_filter(list_transform(rows, lambda r: trim(r[1])), lambda x: x <> '') as keys, {_CANON.format(h='q')} as cq from y join q using (p_partkey)),
    s as (select *, list_filter(list_transform(headers, lambda h, i: case when regexp_matches(h, '{C.KEY_COLUMNS}') or len(list_filter(rows, lambda r: list_contains(keys, trim(r[i])))) > 0 or ({_CANON.format(h='h')} <> '' and (contains(cq, {_CANON.format(h='h')}) or contains({_CANON.format(h='h')}, cq)
      or len(list_filter(string_split(regexp_replace(h, '[（(][^）)]*[）)]', '', 'g'), '-'), lambda p: trim(p) <> '' and contains(q, trim(p)))) > 0)) or regexp_matches(h, shown) then i - 1 end), lambda i: i is not null) as chosen from z)
    select p_partkey, array_to_string(case when len(headers) <= 2 or len(chosen) < 2 then range(0, len(headers)) else chosen end, ',') as columns,
    concat_ws(' ', nullif(title, ''), case when p_partkey % 3 = 0 and p_partkey > 0 then concat('第', p_partkey, '页') when p_partkey % 3 = 1 then concat('第', p_partkey, '-', p_partkey + 2, '页') end) as citation from s"""
)
def relevant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table that a question needs, and how the table is cited."""
    first = F.array_join(F.transform("rows", lambda r: F.get(r, F.lit(0))), " ")
    keys = F.transform("rows", lambda r: R.trimmed(F.get(r, F.lit(0))))
    rows = _tables(spark, sf_dir).withColumn("q", F.expr(sample("p_partkey + p_size", ASKED))).withColumn("type", C.rag_table_type(F.col("title"), F.col("headers"), first))
    chosen = C.shown_columns(F.col("q"), F.col("type"), F.col("headers"), keys, F.col("rows"))
    key, rest = F.col("p_partkey"), F.col("p_partkey") % 3
    cited = C.citation_text(F.lit(None).cast("string"), F.col("title"), F.when(rest < 2, key), F.when(rest == 0, key).when(rest == 1, key + 2))
    return rows.select("p_partkey", F.array_join(F.transform(chosen, lambda i: i.cast("string")), ",").alias("columns"), cited.alias("citation"))


@query(
    """with h as (select l_orderkey % 500 as q, l_suppkey as doc, l_returnflag as t, l_linenumber as row_id, l_extendedprice as score, l_orderkey * 10 + l_linenumber as rank from lineitem),
    s as (select h.* from h join (select q, max(score) as best from h group by q) using (q) where score >= 0.6 * best), f as (select q, doc, t, row_id, min(rank) as rank from s group by all)
    select q, doc, t, string_agg(cast(row_id as varchar), ',' order by rank, row_id) as row_ids, min(rank) as first_rank from f group by all"""
)
def slice_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows hit, table by table, of hits that come near the best one of their question."""
    hits = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("q"), F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("t"), F.col("l_linenumber").alias("row_id"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    found = records.significant_slices(hits, "q", ["doc", "t"])
    return found.select("q", "doc", "t", F.array_join(F.transform("row_ids", lambda r: r.cast("string")), ",").alias("row_ids"), "first_rank")


EXCERPTS = [
    "【结构化指标项】\n设施名称：社区医院\n规模性指标.一般规模：建筑面积{n}平方米\n服务规模：每{n}万人1处。\n原文", "【结构化指标项】\n指标对象：诊所\n详细配置要求：1.业务用房不低于{n}%。2.辅助空间应独立；3.设床位{n}张。\n千人指标：{n}；", "普通原文{n}",
    "【结构化指标项】\n来源表格：配置要求表\n一般规模：{n}平方米", "", "【结构化指标项】\n办学规模：{n}班\n服务规模：2处",
]
EVIDENCE_QUESTIONS = ["社区医院业务用房比例不低于多少", "一般规模是多少平方米", "千人指标是多少", "服务规模要求几处", "每张床的要求", "今天", "", "需要提交哪些图纸"]
_ROWS = f"select p_partkey, p_size, {sample('p_partkey', EXCERPTS)} as x, {sample('p_partkey + p_size', EVIDENCE_QUESTIONS)} as q, p_partkey % 11 = 0 as review from part"
_LINES = f"select *, case when not review and starts_with(trim(x), '{E.MARK}') then list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(s)), lambda s: s <> '' and not regexp_matches(s, '^【结构化') and contains(s, '：')) else [] end as lines from ({_ROWS})"
_WANTS = f"select *, regexp_matches(q, '{E.DETAILED}') as detailed, regexp_matches(q, '{E.THOUSAND}') as thousand, regexp_matches(q, '{E.SERVICE}') as service, regexp_matches(q, '一般') as usual, regexp_matches(q, '15分钟|步行|可达|85%|比例|使用说明') as near, regexp_matches(q, '{E.GENERAL}') and not regexp_matches(q, '{E.DETAILED}|{E.THOUSAND}|{E.SERVICE}') as general, array_to_string(lines, chr(10)) as txt from ({_LINES})"
_SCORE = " + ".join(f"case when {a} and regexp_matches(txt, '{p}') then {w} else 0 end" for a, p, w in E.SCORES)
_TERMS = f"list_filter({E.DETAIL_TERMS}, lambda t: contains(q, t) or (t = '病床' and contains(q, '每张床')))"
_SENTENCES = f"list_filter(regexp_extract_all(substring(s, {len(E.DETAIL_PREFIX) + 1}), '(?:[0-9]+\\.)?[^。；;]+[。；;]?'), lambda p: len(list_filter({_TERMS}, lambda t: contains(p, t))) > 0)"
_WANTED = f"case when detailed then '{E.DETAIL_LINES}' when thousand then '千人指标' when service then '服务规模' when general then '{E.SCALE_LINES}' end"


@query(
    f"""with w as ({_WANTS}), k as (select *, {_SCORE} as score, case when q <> '' then {_WANTED} end as wanted from w), m as (select *, list_filter(lines, lambda s: regexp_matches(s, '{E.ALWAYS}') or regexp_matches(s, wanted)) as kept from k),
    f as (select *, case when wanted is null or len(kept) = 0 then lines else list_transform(kept, lambda s: case when starts_with(s, '{E.DETAIL_PREFIX}') and len({_SENTENCES}) > 0 then concat('{E.DETAIL_PREFIX}', array_to_string({_SENTENCES}, '')) else s end) end as chosen from m)
    select p_partkey, score, array_to_string(list_filter(list_transform(chosen, lambda s: trim(regexp_replace(s, '[。；;]\\s*$', ''))), lambda s: s <> ''), '。') as conclusion,
    coalesce(cast(nullif(regexp_extract(list_filter(lines, lambda s: regexp_matches(s, '{E.ORDERING}'))[1], '[0-9]+(?:\\.[0-9]+)?'), '') as double), 1e9) as order_value from f"""
)
def structured_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well structured excerpts answer a question, the lines that do, and the value that orders them."""
    lines = E.useful_lines(F.col("x"), F.col("review"))
    rows = _evidence(spark, sf_dir).withColumn("lines", lines)
    return rows.select("p_partkey", E.evidence_score(F.col("lines"), F.col("q")).cast("long").alias("score"), E.as_conclusion(E.chosen_lines(F.col("lines"), F.col("q"))).alias("conclusion"), F.least(E.order_value(F.col("lines")), F.lit(1e9)).alias("order_value"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(sample("p_partkey", EXCERPTS)).alias("x"), F.expr(sample("p_partkey + p_size", EVIDENCE_QUESTIONS)).alias("q"), (F.col("p_partkey") % 11 == 0).alias("review"))


@query(
    f"""with w as (select *, p_size * 1000 + p_partkey % 40 as question_id, {sample('p_size + p_partkey % 40', EVIDENCE_QUESTIONS)} as q2, case when p_partkey % 5 = 0 then 'deliverable' else 'indicator' end as chunk_type from ({_LINES})),
    k as (select * replace (q2 as q), array_to_string(lines, chr(10)) as txt, regexp_matches(q2, '{E.DETAILED}') as detailed, regexp_matches(q2, '{E.THOUSAND}') as thousand, regexp_matches(q2, '{E.SERVICE}') as service, regexp_matches(q2, '一般') as usual, regexp_matches(q2, '15分钟|步行|可达|85%|比例|使用说明') as near,
      regexp_matches(q2, '{E.GENERAL}') and not regexp_matches(q2, '{E.DETAILED}|{E.THOUSAND}|{E.SERVICE}') as general from w),
    s as (select *, len(lines) >= 2 and ({_SCORE}) > 0 as answers, not review and chunk_type = 'deliverable' as deliv from k),
    a as (select *, regexp_matches(q, '{E.DRAWINGS}') and bool_or(deliv) over p as drawings, bool_or(answers) over p and bool_or(not review) over p as only_clean from s window p as (partition by question_id)),
    b as (select *, coalesce(cast(nullif(regexp_extract(list_filter(lines, lambda x: regexp_matches(x, '{E.ORDERING}'))[1], '[0-9]+(?:\\.[0-9]+)?'), '') as double), 'inf'::double) as v from a where case when drawings then deliv when only_clean then not review else true end)
    select question_id, p_partkey, row_number() over (partition by question_id order by case when not drawings and only_clean and regexp_matches(q, '{E.SERVICE}') then v else 0 end, p_partkey) as place from b"""
)
def preferred_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which citations of a question are kept, and in which order."""
    rows = _evidence(spark, sf_dir).withColumn("question", F.expr(sample("p_size + p_partkey % 40", EVIDENCE_QUESTIONS)))
    citations = rows.select((F.col("p_size") * 1000 + F.col("p_partkey") % 40).alias("question_id"), F.col("p_partkey").alias("rank"), "question", F.when(F.col("p_partkey") % 5 == 0, "deliverable").otherwise("indicator").alias("chunk_type"), F.col("x").alias("excerpt"), "review")
    return records.preferred(citations).select("question_id", F.col("rank").alias("p_partkey"), F.col("place").cast("long").alias("place"))


@query(
    f"""with c as (select o_custkey as question_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as n, concat('文件', o_orderkey) as file_name, case when o_orderkey % 3 > 0 then concat('第', o_orderkey % 9, '章') end as section, case when o_orderkey % 4 > 1 then concat('第', o_orderkey % 50, '条') end as article, case when o_orderkey % 5 > 0 then o_orderkey % 100 end as page, o_orderstatus as excerpt from orders),
    e as (select question_id, string_agg(concat(case when n > 1 then concat('· 依据', i, '：') else '·' end, chr(10), '  - 文件：', file_name, chr(10), '  - 章节 / 条款：', coalesce(nullif(concat_ws(' ｜ ', section, article), ''), '—'), chr(10), '  - 页码：', case when page is null then '—' else concat('第', page, '页') end, chr(10), '  - 原文片段：', excerpt), chr(10) order by i) as t from c group by all)
    select question_id, case when question_id % 7 = 0 then concat('【无法确定】', chr(10), '{E.REFUSAL[0]}', chr(10), chr(10), '【原因】', chr(10), '未检索到', chr(10), chr(10), '【建议】', chr(10), '{E.REFUSAL[1]}')
    else concat('【结论】', chr(10), concat('结论', question_id), chr(10), chr(10), '【依据】', chr(10), t, chr(10), chr(10), '【注意】', chr(10), '{E.NOTICE}') end as answer from e"""
)
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their numbered evidence, and refusals."""
    key = F.col("o_orderkey")
    part = lambda a, rest, b: F.concat(F.lit(a), (key % rest).cast("string"), F.lit(b))
    one = F.struct(key.alias("k"), F.concat(F.lit("文件"), key.cast("string")).alias("file_name"), F.when(key % 3 > 0, part("第", 9, "章")).alias("section"), F.when(key % 4 > 1, part("第", 50, "条")).alias("article"), F.when(key % 5 > 0, key % 100).alias("page"), F.col("o_orderstatus").alias("excerpt"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question_id")).agg(F.array_sort(F.collect_list(one)).alias("citations"))
    text = E.answer_text(F.concat(F.lit("结论"), F.col("question_id").cast("string")), F.col("citations"))
    return rows.select("question_id", F.when(F.col("question_id") % 7 == 0, E.refusal_text(F.lit("未检索到"))).otherwise(text).alias("answer"))


_BLOCK = """select l_suppkey as doc_id, l_linenumber as page, l_orderkey as block_index, case l_returnflag when 'A' then 'heading' when 'N' then case when l_orderkey % 7 = 0 then 'list_item' else 'paragraph' end else case when l_orderkey % 11 = 0 then 'image_page' else 'paragraph' end end as type,
    case when l_orderkey % 2 = 0 then 'chapter' end as heading_pattern, case when l_linenumber = 1 and l_orderkey % 5 < 3 then concat('第', l_orderkey % 20, '章 总则 ...... ', l_orderkey % 90) when l_orderkey % 5 = 3 then '某市规划导则' when l_orderkey % 5 = 4 then concat('— ', l_linenumber, ' —') else concat('正文第', l_orderkey, '段') end as text from lineitem"""


@query(
    f"""with b as (select distinct * from ({_BLOCK})), p as (select doc_id, page, count(*) filter (type <> 'image_page') as n, count(*) filter (type <> 'image_page' and regexp_matches(text, '[.．·…]{{3,}}\\s*[0-9]{{1,4}}\\s*$')) as led from b group by all),
    r as (select doc_id, text, count(distinct page) as n from b where type in ('paragraph', 'heading') and length(trim(text)) between 1 and 30 group by all), g as (select doc_id, count(*) as pages from p group by all),
    x as (select r.doc_id, r.text from r join g using (doc_id) where r.n >= 3 and r.n / pages >= 0.3)
    select b.doc_id, b.page, b.type, count(*) as kept from b join p using (doc_id, page) left join x on x.doc_id = b.doc_id and x.text = b.text where not (n >= 4 and led >= 0.5 * n and type <> 'image_page')
    and (case when x.text is not null and type in ('paragraph', 'heading') then type = 'heading' and heading_pattern is not null else not (type in ('paragraph', 'list_item') and regexp_matches(trim(b.text), '^[—\\-－\\s]*[0-9]{{1,4}}[—\\-－\\s]*$|^第?\\s*[0-9]{{1,4}}\\s*页$')) end) group by all"""
)
def clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without contents pages, running headers and footers, and page numbers, counted by page and type."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    blocks = spark.sql(_BLOCK).distinct()
    return records.cleaned_blocks(blocks).groupBy("doc_id", "page", "type").agg(F.count("*").alias("kept"))
