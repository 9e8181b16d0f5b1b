"""Queries of records out of blocks and of grids and regions of a page. Turns of ``conversations`` stand for blocks and lines of
an order for the rows or boxes of a page; their keys choose texts and places, as in ``regulations``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import evidence as E
from folioforge.functions import rules as R
from folioforge.operators import grids, objects, records
from folioforge.plans.common import ladder, register, sample, table
from folioforge.plans.tabular import _SCORE, _SENTENCES, _STRUCT, _WANTED, EVIDENCE_QUESTIONS, _as_tables

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

HEADS = ["术语和定义", "办理流程", "任务清单", "编制依据", "总则", "成果要求{n}", "用词说明"]
LINES = [
    "容积率是指建筑面积与用地面积之比{n}", "本办法所称停车位：供{n}辆车使用", "提交材料：总平面图纸{n}份", "附件与数据库，必选", "1. 问题清单{n}", "2) 其他说明{n}", "（3）办理材料", "第一步 受理{n}", "步骤2 审批后办理",
    "依据城乡规划法第{n}条编制", "绿地", "应当公示{n}日。不得占用绿地；可调整", "第{n}条 建设用地应当符合规划", "1、核对项目阶段", "", "plain words {n}", "3. 次序{n}",
]
KINDS = ["definition", "drawing", "deliverable", "checklist_item", "procedure_step", "reference", "requirement"]
_BLOCKS = f"""b as (select conv_id, turn, case turn % 5 when 0 then 1 when 3 then 2 end as level, case when turn % 5 in (0, 3) then {sample('conv_id * 3 + turn', HEADS)} else {sample('conv_id * 5 + turn', LINES)} end as x from conversations),
    s as (select *, last_value(case when level = 1 then x end ignore nulls) over w as h1, last_value(case level when 1 then '' when 2 then x end ignore nulls) over w as h2, last_value(case when level is not null then x end ignore nulls) over w as heading
      from b window w as (partition by conv_id order by turn rows between unbounded preceding and current row)),
    p as (select *, concat_ws(' > ', h1, nullif(h2, '')) as path, regexp_matches(x, '{objects.DEFINITION}') as defines, regexp_matches(x, '{objects.DRAWING}') as drawing, regexp_matches(x, '{objects.CHECK}') as checks,
      regexp_matches(x, '^\\s*([一二三四五六七八九十]+、|[0-9]+[.)]|[（(][0-9一二三四五六七八九十]+[)）]|[①-⑳]|[-•·])') as listed from s where level is null)"""
_NAME = "nullif(trim(regexp_extract(x, '^([^：:，,。；;]{2,30})', 1)), '')"
_RECORDS = f"""{_BLOCKS}, records as (
    select conv_id, turn, 'definition' as object_type, case when defines then regexp_extract(x, '{objects.DEFINITION}', 1) else substring(trim(regexp_extract(x, '^[^：:，,。]*')), 1, 20) end as title, case when defines then 0.88 else 0.62 end as confidence, x from p
      where defines or (coalesce(regexp_matches(heading, '{objects.DEFINITION_HEADING}'), false) and substring(trim(regexp_extract(x, '^[^：:，,。]*')), 1, 20) <> '')
    union all select conv_id, turn, case when drawing then 'drawing' else 'deliverable' end, case when drawing then substring(x, 1, 40) else coalesce({_NAME}, substring(x, 1, 40)) end, case when drawing then 0.74 else 0.72 end, x from p where drawing or regexp_matches(x, '{objects.DELIVERABLE}')
    union all select conv_id, turn, 'checklist_item', substring(case when checks then x else regexp_replace(x, '^\\s*[0-9]+[、.．]\\s*', '') end, 1, 40), case when checks then 0.68 else 0.72 end, x from p where listed and (checks or regexp_matches(path, '{objects.CHECK}'))
    union all select conv_id, turn, 'procedure_step', substring(x, 1, 40), 0.64, x from p where regexp_matches(path, '{objects.PROCEDURE}') or (regexp_matches(x, '{objects.PROCEDURE}') and regexp_matches(x, '{objects.STEP}'))
    union all select conv_id, turn, 'reference', heading, 0.68, x from p where regexp_matches(path, '{objects.BASIS}') or regexp_matches(x, '{objects.BASIS}')
    union all select * from (select conv_id, turn, 'requirement', {ladder('x', R.REQUIREMENT_LEVELS)} as title, 0.8, x from (select conv_id, turn, unnest(regexp_extract_all(x, '[^。；;！？!?]+[。；;！？!?]?')) as x from p)) where title <> 'unknown')"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("turn") % 5
    text = F.when(key.isin(0, 3), F.expr(sample("conv_id * 3 + turn", HEADS))).otherwise(F.expr(sample("conv_id * 5 + turn", LINES)))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_index"), F.lit(1).alias("page"), F.when(key == 0, 1).when(key == 3, 2).alias("level"), text.alias("text"))
    return objects.with_sections(rows)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects.extracted(_blocks(spark, sf_dir).drop("section_path", "heading", "page_end"))
    return found.where(F.col("object_type").isin(KINDS)).withColumnRenamed("doc_id", "conv_id").withColumnRenamed("first_block", "turn")


@query(f"with {_RECORDS} select conv_id, turn, object_type, title, cast(confidence as double) as confidence, x as content from records")
def block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, drawings, deliverables, checklists, steps, references and requirements of blocks, with their sections."""
    return _records(spark, sf_dir).select("conv_id", "turn", "object_type", "title", "confidence", "content")


@query(
    f"""with {_BLOCKS}, m as (select *, nullif(regexp_extract(x, '{objects.CLAUSE}', 1), '') as mark from b),
    r as (select *, sum(case when mark is not null or level is not null then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and current row) as run from m)
    select conv_id, max(mark) as mark, min(turn) as turn, string_agg(x, chr(10) order by turn) as content from r group by conv_id, run having max(mark) is not null and max(level) is null"""
)
def clause_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with all that follows up to the next mark or heading."""
    return objects.clauses(_blocks(spark, sf_dir)).select(F.col("doc_id").alias("conv_id"), F.col("title").alias("mark"), F.col("first_block").alias("turn"), "content")


@query(f"with {_RECORDS} select conv_id, {', '.join(f'''count(*) filter (object_type = '{k}') as {k}''' for k in KINDS)}, count(*) as total from records group by conv_id")
def object_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each kind a document has."""
    counts = _records(spark, sf_dir).groupBy("conv_id").pivot("object_type", KINDS).count().na.fill(0)
    return counts.withColumn("total", sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0])))


@query(f"with {_RECORDS}, n as (select *, row_number() over (partition by object_type order by conv_id, turn, x) as place from records) select object_type, place, conv_id, turn, title from n where place <= 5")
def object_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five records of each kind, as a report shows them."""
    w = Window.partitionBy("object_type").orderBy("conv_id", "turn", "content")
    return _records(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 5").select("object_type", F.col("place").cast("long").alias("place"), "conv_id", "turn", "title")


@query(
    f"""with {_STRUCT} select p_partkey, concat_ws(chr(10), any_value(table_title), '表号：' || any_value(table_no), '表格类型：' || any_value(table_type), '表头：' || array_to_string(any_value(names), ' | ')) as parent,
    concat_ws(chr(10), any_value(table_title), '表格摘要：共' || count(*) || '行', '表头：' || array_to_string(any_value(names), ' | '), '主要行：' || nullif(array_to_string(list_slice(list(row_key order by row_index) filter (row_key <> ''), 1, 12), '；'), '')) as summary
    from srow join class using (p_partkey) group by p_partkey"""
)
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed for a whole table: its head, and a summary with the keys of its first rows."""
    return records.table_texts(records.structured_rows(_as_tables(spark, sf_dir))).select(F.col("doc_id").alias("p_partkey"), "parent", "summary")


GRIDS = ["|||//|甲|{n}|//|乙||3//|丙||", "a|b|c//1||3//4||6//|x|", "||//|", "甲|乙//1|2", "1||||||||9//2|b|||||||9//3|b|||||||9//4|b|||||||9//5||c||||||9//6||||||||9//7||||||||9//8|x|||y||z|u|9", "一|二|三|四//||{n}|//1||3|4", "x"]
_GRID = "list_transform(string_split({x}, '//'), lambda r: string_split(r, '|'))"
_WIDE = "list_max(list_transform({g}, lambda r: len(r)))"


def _used(grid: str, wide: str) -> str:
    return f"list_transform(range(1, {wide} + 1), lambda i: len(list_filter({grid}, lambda r: coalesce(r[i], '') <> '')))"


@query(
    f"""with t as (select p_partkey, {_GRID.format(x=sample('p_partkey', GRIDS))} as g from part), e as (select p_partkey, list_transform(g, lambda r: list_transform(range(1, {_WIDE.format(g='g')} + 1), lambda i: coalesce(r[i], ''))) as g from t),
    rows_ as (select p_partkey, g, list_filter(range(1, len(g) + 1), lambda i: len(list_filter(g[i], lambda c: c <> '')) > 0) as full_ from e), b as (select p_partkey, case when len(full_) > 0 then list_slice(g, full_[1], full_[-1]) else [] end as g from rows_),
    cols as (select p_partkey, g, list_filter(range(1, coalesce({_WIDE.format(g='g')}, 0) + 1), lambda i: len(list_filter(g, lambda r: r[i] <> '')) > 0) as used from b), c as (select p_partkey, list_transform(g, lambda r: list_slice(r, used[1], used[-1])) as g from cols),
    k as (select p_partkey, g, len(g) as n, coalesce({_WIDE.format(g='g')}, 0) as wide, {_used('g', f"coalesce({_WIDE.format(g='g')}, 0)")} as used from c),
    l as (select *, list_filter(range(1, wide + 1), lambda i: used[i] >= case when n >= 8 and wide >= 8 then greatest(3, ceil(n * 0.25)) else 2 end) as keep from k)
    select p_partkey, array_to_string(list_transform(g, lambda r: array_to_string(case when wide > 2 and n >= 3 and len(keep) >= 2 then list_transform(keep, lambda i: r[i]) else r end, '|')), '//') as grid from l"""
)
def trimmed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids without empty edges and sparse columns."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.split(F.expr(sample("p_partkey", GRIDS)), "//"), lambda r: F.split(r, "\\|")).alias("grid"))
    return grids.trimmed_grids(rows, "grid").select("p_partkey", F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "//").alias("grid"))


@query(
    f"""with t as (select p_partkey, case when p_partkey % 11 = 0 then [] else {_GRID.format(x=sample('p_partkey', GRIDS))} end as a, case when p_partkey % 13 = 0 then [] else {_GRID.format(x=sample('p_partkey // 7', GRIDS))} end as b from part),
    u as (select p_partkey, len(a) as an, len(b) as bn, {_used('a', f"coalesce({_WIDE.format(g='a')}, 0)")} as au, {_used('b', f"coalesce({_WIDE.format(g='b')}, 0)")} as bu from t),
    f as (select p_partkey, an, bn, len(list_filter(au, lambda n: n >= 2)) as ac, len(list_filter(bu, lambda n: n >= 2)) as bc, coalesce(list_sum(au) / nullif(an * len(au), 0), 0) as af, coalesce(list_sum(bu) / nullif(bn * len(bu), 0), 0) as bf from u),
    h as (select *, ac >= bc + 2 or (an >= bn * 1.4 and ac >= bc) as finer from f), i as (select *, an > 0 and bn > 0 and not finer and af + 0.12 < bf and ac <= bc + 1 as skipped from h)
    select p_partkey, case when an = 0 then 'text' when bn = 0 or finer then 'lines' when skipped or ac < bc then 'text' else 'lines' end as choice, skipped, ac as line_columns, round(af, 6) as line_fill from i"""
)
def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two grids of one region: from its lines or from its text."""
    grid = lambda key: F.transform(F.split(F.expr(sample(key, GRIDS)), "//"), lambda r: F.split(r, "\\|"))
    none = F.array().cast("array<array<string>>")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, none).otherwise(grid("p_partkey")).alias("a"), F.when(F.col("p_partkey") % 13 == 0, none).otherwise(grid("p_partkey div 7")).alias("b"))
    own = grids.figures(F.col("a"))
    return grids.chosen_grids(rows, "a", "b").select("p_partkey", "choice", "skipped", own["columns"].cast("long").alias("line_columns"), F.round(own["fill"], 6).alias("line_fill"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_BOX = {"y0": "l_suppkey % 40", "x0": "l_partkey % 60", "y1": "l_suppkey % 40 + 10 + l_linenumber * 5", "x1": "l_partkey % 60 + 10 + l_quantity"}
_DUCK_BOX = "{" + ", ".join(f"'{k}': cast({v} as double)" for k, v in _BOX.items()) + "}"
_SIDE = "greatest(0, least({a}.{h}, {b}.{h}) - greatest({a}.{l}, {b}.{l}))"
_AREA = "({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0)"
_OVERLAP = f"{_SIDE.format(a='k', b='e[1]', l='x0', h='x1')} * {_SIDE.format(a='k', b='e[1]', l='y0', h='y1')} / least({_AREA.format(a='k')}, {_AREA.format(a='e[1]')})"
_KEPT = "list_reduce(list_prepend({first}, list_transform({second}, lambda x: [x])), lambda kept, e: case when len(list_filter(kept, lambda k: " + _OVERLAP + " > {most})) > 0 then kept else list_concat(kept, e) end)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(*[F.expr(v).cast("double").alias(k) for k, v in _BOX.items()])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_returnflag", "l_extendedprice", *_ORDER, box.alias("box"))


@query(
    f"""with b as (select *, l_orderkey as page, {_DUCK_BOX} as box from lineitem), g as (select page, coalesce(list(box order by {', '.join(_ORDER)}) filter (l_returnflag <> 'N'), []) as a, coalesce(list(box order by {', '.join(_ORDER)}) filter (l_returnflag = 'N'), []) as s from b group by page),
    m as (select page, unnest({_KEPT.format(first='a', second='s', most=grids.SAME_REGION)}) as r from g) select page, row_number() over (partition by page order by r.y0, r.x0, r.y1, r.x1) as place, r.y0 as y0, r.x0 as x0, r.y1 as y1, r.x1 as x1 from m"""
)
def joined_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions found from lines with those from text that they don't cover, from the top down."""
    part = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct(*_ORDER, "box")))), lambda x: x["box"])
    pages = _boxes(spark, sf_dir).groupBy("page").agg(part(F.col("l_returnflag") != "N").alias("a"), part(F.col("l_returnflag") == "N").alias("s"))
    found = pages.select("page", F.posexplode(F.array_sort(grids.joined_regions(F.col("a"), F.col("s")))).alias("place", "r"))
    return found.select("page", (F.col("place") + 1).cast("long").alias("place"), "r.*")


@query(
    f"""with b as (select *, l_orderkey as page, {_DUCK_BOX} as box from lineitem), g as (select page, list(box order by l_extendedprice desc, {', '.join(_ORDER)}) as s from b group by page),
    m as (select page, {_KEPT.format(first='[]', second='s', most=grids.SAME_CANDIDATE)} as kept from g), u as (select page, unnest(kept) as r, generate_subscripts(kept, 1) as place from m) select page, place, r.y0 as y0, r.x0 as x0, r.y1 as y1, r.x1 as x1 from u"""
)
def best_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions by score, without those that overlap a better one."""
    candidate = F.struct((-F.col("l_extendedprice")).alias("score"), *_ORDER, "box")
    pages = _boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(candidate).alias("found"))
    return pages.select("page", F.posexplode(grids.best_regions(F.col("found"))).alias("place", "r")).select("page", (F.col("place") + 1).cast("long").alias("place"), "r.*")


_Y = "l_linenumber * 12 + 50 * (l_linenumber {div} (2 + l_orderkey % 3))"


@query(
    f"""with r as (select l_orderkey as page, cast({_Y.format(div='//')} as double) as y, cast({_Y.format(div='//')} + 10 + l_orderkey % 3 as double) as bottom from lineitem), o as (select *, row_number() over (partition by page order by y) - 1 as i from r),
    g as (select page, count(*) as n, greatest(avg(bottom - y) * {grids.GAP_HEIGHTS}, {grids.LEAST_GAP}) as least_, list({{'y': y, 'bottom': bottom, 'i': i, 'start': cast(0 as bigint), 'cuts': []::bigint[]}} order by i) as rows_ from o group by page),
    c as (select page, n, list_reduce(rows_, lambda a, b: case when b.y - a.bottom >= least_ and b.i - a.start >= 2 and n - b.i >= 2 then {{'y': b.y, 'bottom': b.bottom, 'i': b.i, 'start': b.i, 'cuts': list_append(a.cuts, b.i)}}
      else {{'y': b.y, 'bottom': b.bottom, 'i': b.i, 'start': a.start, 'cuts': a.cuts}} end).cuts as cuts from g), d as (select page, n, list_prepend(cast(0 as bigint), case when n >= 6 then cuts else [] end) as starts from c),
    u as (select page, n, starts, unnest(starts) as first, generate_subscripts(starts, 1) as k from d) select page, first, coalesce(starts[k + 1], n) - first as rows from u"""
)
def gap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page in parts that wide gaps separate."""
    y = F.expr(_Y.format(div="div")).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(y.alias("y"), (y + 10 + F.col("l_orderkey") % 3).alias("bottom")).alias("r"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return pages.select("page", F.explode(grids.gap_spans(F.col("rows"))).alias("s")).select("page", F.col("s.first").cast("long").alias("first"), F.col("s.rows").cast("long").alias("rows"))


@query(
    """with g as (select l_orderkey as page, greatest(avg(8 + l_linenumber) * 0.75, 6) as tolerance, list(cast(l_partkey % 60 as double) order by l_partkey % 60) as xs from lineitem group by 1),
    c as (select page, list_reduce(list_transform(xs, lambda x: [{'total': x, 'n': 1}]), lambda k, x: case when abs(x[1].total - k[-1].total / k[-1].n) <= tolerance then list_append(list_slice(k, 1, len(k) - 1), {'total': k[-1].total + x[1].total, 'n': k[-1].n + 1}) else list_concat(k, x) end) as c from g)
    select page, array_to_string(list_transform(list_filter(c, lambda x: x.n >= 2), lambda x: cast(floor(x.total / x.n + 0.5) as bigint)), ',') as starts from c"""
)
def column_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where columns begin that several items of a page share."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.greatest(F.avg(8 + F.col("l_linenumber")) * 0.75, F.lit(6.0)).alias("tolerance"), F.array_sort(F.collect_list((F.col("l_partkey") % 60).cast("double"))).alias("xs"))
    return rows.select("page", F.array_join(grids.column_starts(F.col("xs"), F.col("tolerance")).cast("array<string>"), ",").alias("starts"))


EXCERPTS = [
    f"{E.MARK}\n指标对象：小学{{n}}\n一般规模：{{n}}班\n服务规模：每1.2万人1处；\n列1：A类", f"{E.MARK}\n指标对象：小学\n来源表格：表3\n办学规模：24班\n服务规模：每2万人1处。", f"{E.MARK}\n指标对象：小学\n千人指标：{{n}}平方米", "普通文字：{n}",
    f"{E.MARK}\n一般规模：3000平方米\n指标对象：医院", f"{E.MARK}\n服务规模：每1.2万人1处", f"{E.MARK}\n指标对象：医院\n详细配置要求：业务用房比例不低于85%。其他；急救通道",
]
_JOINED = "array_to_string(list_filter(list_transform({x}, lambda s: trim(regexp_replace(s, '[。；;]\\s*$', ''))), lambda s: s <> ''), '。')"


@query(
    f"""with r as (select p_partkey, p_partkey // 3 as question_id, {sample('p_partkey', EXCERPTS)} as x, {sample('p_partkey // 3', EVIDENCE_QUESTIONS)} as q, p_partkey % 11 = 0 as review from part),
    w as (select *, case when not review and starts_with(trim(x), '{E.MARK}') then list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(s)), lambda s: s <> '' and not regexp_matches(s, '^【结构化') and contains(s, '：')) else [] end as lines from r),
    k as (select *, array_to_string(lines, chr(10)) as txt, regexp_matches(q, '{E.DETAILED}') as detailed, regexp_matches(q, '{E.THOUSAND}') as thousand, regexp_matches(q, '{E.SERVICE}') as service, regexp_matches(q, '一般') as usual, regexp_matches(q, '15分钟|步行|可达|85%|比例|使用说明') as near,
      regexp_matches(q, '{E.GENERAL}') and not regexp_matches(q, '{E.DETAILED}|{E.THOUSAND}|{E.SERVICE}') as general from w),
    m as (select *, {_SCORE} as score, case when q <> '' then {_WANTED} end as wanted from k), n as (select *, list_filter(lines, lambda s: regexp_matches(s, '{E.ALWAYS}') or regexp_matches(s, wanted)) as kept from m),
    f as (select *, case when wanted is null or len(kept) = 0 then lines else list_transform(kept, lambda s: case when starts_with(s, '{E.DETAIL_PREFIX}') and len({_SENTENCES}) > 0 then concat('{E.DETAIL_PREFIX}', array_to_string({_SENTENCES}, '')) else s end) end as chosen from n),
    c as (select *, {_JOINED.format(x='chosen')} as conclusion, list_filter(lines, lambda s: starts_with(s, '服务规模：'))[1] as scale, list_filter(lines, lambda s: regexp_matches(s, '{E.ORDERING}'))[1] as size_line from f),
    v as (select *, coalesce(cast(nullif(regexp_extract(size_line, '[0-9]+(?:\\.[0-9]+)?'), '') as double), 1e300) as v from c),
    g as (select question_id, any_value(q) as q, count(scale) as n, list(concat_ws('，', size_line, scale) order by v, p_partkey) filter (scale is not null) as texts, arg_min(list_filter(lines, lambda s: regexp_matches(s, '^(?:指标对象|来源表格|设施名称)：')), p_partkey) filter (scale is not null) as meta,
      bool_or(scale is not null and len(list_filter(lines, lambda s: regexp_matches(s, '^列[0-9]+：[ABC]类$'))) > 0) as category, first({{'score': score, 'conclusion': conclusion}} order by score desc, p_partkey) filter (len(lines) >= 2) as best from v group by question_id),
    u as (select *, regexp_matches(q, '{E.SERVICE}') as asks, list_filter(texts, lambda x, i: list_position(texts, x) = i) as distinct_ from g)
    select question_id, case when asks and n > 1 and len(distinct_) > 1 then {_JOINED.format(x='list_concat(meta, distinct_)')} when asks and n = 1 and category then null when q = '' or best.score > 0 then best.conclusion end as conclusion from u"""
)
def recovered_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conclusions out of the fields of structured excerpts, where an answer of its own is missing."""
    key = F.col("p_partkey")
    excerpt, question = F.expr(sample("p_partkey", EXCERPTS)), F.expr(sample("p_partkey div 3", EVIDENCE_QUESTIONS))
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 3").alias("question_id"), key.alias("rank"), question.alias("question"), excerpt.alias("excerpt"), (key % 11 == 0).alias("review"))
    return records.recovered(rows)
