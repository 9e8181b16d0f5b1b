"""Queries of contexts, pages and channels; keys of the tables choose texts as in ``regulations``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.operators import context, records, tables
from folioforge.plans.common import register, sample, table
from folioforge.plans.tabular import _STRUCT, _TABLES, _as_tables, _tables
from folioforge.sources.tables import text_blocks as blocks_of

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

_IMPORTANT = context.IMPORTANT


@query(
    f"""with {_STRUCT}, n as (select p_partkey, row_index, r, names, table_no, table_title, list_filter(names, lambda h, i: trim(r[i]) <> '') as filled from srow),
    g as (select p_partkey, list_distinct(flatten(list(filled))) as every, flatten(list(filled order by row_index)) as seq from n group by p_partkey), h as (select p_partkey, list_filter(seq, lambda x, i: list_position(seq, x) = i) as every from g),
    k as (select p_partkey, case when len(every) <= 8 then every when len(list_filter(every, lambda x: regexp_matches(x, '{_IMPORTANT}'))) > 0 then list_slice(list_filter(every, lambda x: regexp_matches(x, '{_IMPORTANT}')), 1, 8) else list_slice(every, 1, 8) end as headers from h),
    b as (select n.p_partkey, row_index, headers, table_no, table_title, '| ' || array_to_string(list_transform(headers, lambda x: coalesce(trim(replace(r[list_position(names, x)], '|', '\\|')), '')), ' | ') || ' |' as line from n join k using (p_partkey))
    select p_partkey, count(*) as rows, '### ' || coalesce(nullif(concat_ws(' ', '表' || any_value(table_no), any_value(table_title)), ''), '表格子集') || case when p_partkey > 0 then concat('（第', p_partkey, '-', p_partkey + 1, '页）') else '' end || chr(10) || '| ' || array_to_string(any_value(headers), ' | ') || ' |' || chr(10) ||
    '| ' || array_to_string(list_transform(any_value(headers), lambda x: '---'), ' | ') || ' |' || chr(10) || string_agg(line, chr(10) order by row_index) as text from b group by p_partkey"""
)
def table_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables as Markdown for an answer."""
    rows = records.structured_rows(_as_tables(spark, sf_dir)).withColumn("page_start", F.col("doc_id")).withColumn("page_end", F.col("doc_id") + 1)
    return context.table_subsets(rows, ["doc_id"]).select(F.col("doc_id").alias("p_partkey"), F.col("rows").cast("long").alias("rows"), "text")


@query(
    """select p_partkey, concat_ws(chr(10), concat('条文：第', p_size, '条'), concat('约束等级：', case when p_partkey % 3 = 0 then 'must' else 'unknown' end), case when p_partkey % 2 = 0 then concat('章节：', p_brand) end, case when p_size % 2 = 0 then concat('来源页码：第', p_size, '-', case when p_size % 3 = 0 then p_size + 1 else p_size end, '页') end, p_name) as clause,
    concat_ws(chr(10), concat('指标对象：', p_name), case when p_partkey % 2 = 0 then '指标名称：面积' end, concat('指标值：', p_size, '；', p_brand), case when p_partkey % 5 > 0 then '单位：米' end, concat('服务规模：', p_type)) as indicator,
    concat_ws(chr(10), concat('成果项：', p_name), '成果类型：drawing', case p_partkey % 3 when 0 then '是否必选：是' when 1 then '是否必选：否' end, concat('要求：', p_type)) as deliverable,
    concat(concat_ws(' | ', concat('片段[', p_size, ']'), concat('文件：', p_brand), case when p_partkey % 2 = 0 then concat('章节：', p_type) end, case when p_partkey % 3 = 0 then '条款：第1条' end, case when p_size % 2 = 0 then concat('页码：第', p_size, '页') end), case when p_partkey % 4 = 0 then concat(chr(10), 'structured_metadata:', chr(10), p_name) else '' end, chr(10), '原文：甲 乙', chr(10), chr(10), '丙') as prompt from part"""
)
def record_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses, indicators and deliverables as context, and the blocks of a prompt."""
    key, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    text = F.lit("—3—甲  \t乙[[page:2]]\n\n\n\n丙 ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        context.clause_context(F.concat(F.lit("第"), size.cast("string"), F.lit("条")), F.when(key % 3 == 0, "must"), F.when(key % 2 == 0, F.col("p_brand")), F.when(size % 2 == 0, size), F.when(size % 3 == 0, size + 1), F.col("p_name")).alias("clause"),
        context.indicator_context(F.col("p_name"), F.when(key % 2 == 0, "面积"), F.array(size.cast("string"), F.lit(""), F.col("p_brand")), F.when(key % 5 > 0, "米"), none, F.col("p_type"), F.lit("")).alias("indicator"),
        context.deliverable_context(F.col("p_name"), F.lit("drawing"), F.when(key % 3 == 0, True).when(key % 3 == 1, False), none, F.col("p_type"), none).alias("deliverable"),
        context.prompt_block(size, F.col("p_brand"), F.when(key % 2 == 0, F.col("p_type")), F.when(key % 3 == 0, "第1条"), F.when(size % 2 == 0, size), F.when(key % 4 == 0, F.col("p_name")), text).alias("prompt"),
    )


_KINDS = ["classification_code", "indicator_item", "definition", "regulation_clause", "plain_section"]


@query(
    f"""with o as (select p_partkey as object_id, {sample('p_partkey', _KINDS)} as t, p_name as title, p_brand as code, p_type as name, p_type as term, p_name as item_name, case when p_size % 2 = 0 then concat('第', p_size, '条') end as clause_no from part),
    k as (select object_id, 'title' as field, title as key, 1.4 as boost from o union all select object_id, 'keyword', code, 1.2 from o union all select object_id, 'alias', name, 1.5 from o union all select object_id, 'code', code, 3.2 from o where t = 'classification_code' union all select object_id, 'name', name, 2.6 from o where t = 'classification_code'
      union all select object_id, 'item_name', item_name, 2.8 from o where t = 'indicator_item' union all select object_id, 'term', term, 2.8 from o where t = 'definition' union all select object_id, 'clause_no', clause_no, 3.0 from o where t = 'regulation_clause')
    select distinct object_id, field, lower(regexp_replace(key, '\\s+', '', 'g')) as normal_key, cast(boost as double) as boost from k where trim(key) <> ''"""
)
def object_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact keys of records by their kind."""
    objects = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("object_id"), F.expr(sample("p_partkey", _KINDS)).alias("object_type"), F.col("p_name").alias("title"), F.array("p_brand", "p_brand").alias("keywords"), F.array("p_type", F.lit(" ")).alias("aliases"),
        F.col("p_brand").alias("code"), F.col("p_type").alias("name"), F.col("p_type").alias("term"), F.col("p_name").alias("item_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("第"), F.col("p_size").cast("string"), F.lit("条"))).alias("clause_no"),
    )
    return context.object_keys(objects)


PIECES = ["建筑面积{n}平方米", "数值123456连写", "甲、 乙、 丙、 丁", "建筑面积12平方米用地面积345平方米服务规模678", "3.0.1 总则12345说明", "第{n}条 规定停车位应当配建并且满足要求。", "说明文字{n}", "2.1 应当按照标准设置各类设施{n}处；"]
_GONE = f"(regexp_matches(t, '[0-9]{{5,}}') or regexp_matches(t, '([、，/／·]\\s+){{3,}}') or (len(regexp_extract_all(t, '{context.FRAGMENT_UNITS}')) >= 3 and len(regexp_extract_all(t, '[0-9]')) >= 8))"
_PIECE = f"select l_suppkey as doc_id, l_linenumber as page, l_orderkey as i, {sample('l_partkey', PIECES)} as t from lineitem"
_PAGES = "select distinct l_suppkey as doc_id, l_linenumber as page from lineitem where l_suppkey % 3 = l_linenumber % 3"


@query(f"with b as ({_PIECE}), p as ({_PAGES}) select doc_id, page, t as text, count(*) as n from b left join (select *, true as has from p) p using (doc_id, page) where not (coalesce(has, false) and {_GONE} and not regexp_matches(t, '{context.CLAUSE_LIKE}')) group by all")
def table_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that stay on pages with tables."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    kept = context.without_fragments(spark.sql(_PIECE).withColumnRenamed("t", "text"), spark.sql(_PAGES))
    return kept.groupBy("doc_id", "page", "text").agg(F.count("*").alias("n"))


@query(
    f"""with b as ({_PIECE}), p as ({_PAGES}), raw as (select doc_id, page, string_agg(t, ' ' order by i, t) as text from b join p using (doc_id, page) group by all), e as (select doc_id, page, trim(regexp_replace(unnest(regexp_extract_all(text, '{context.SALVAGED}')), '\\s+', ' ', 'g')) as t from raw),
    f as (select doc_id, t, min(page) as page from e where length(t) >= 10 and not {_GONE} group by all), o as (select doc_id, t as known from b where page <= 2) select doc_id, page, f.t as text from f where not exists (select 1 from o where o.doc_id = f.doc_id and contains(known, substring(f.t, 1, 16)))"""
)
def salvaged_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses in the raw text of pages with tables that the blocks lack."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    blocks, pages = spark.sql(_PIECE), spark.sql(_PAGES)
    parts = F.array_sort(F.collect_list(F.struct("i", "t")))
    raw = blocks.join(pages, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))
    return context.salvaged(raw, blocks.where("page <= 2").select("doc_id", F.col("t").alias("text")).distinct())


@query("select l_suppkey as doc_id, l_linenumber as page, l_orderkey as i, case when l_returnflag = 'A' then 1 else 0 end as lane, row_number() over (partition by l_suppkey order by l_linenumber, case when l_returnflag = 'A' then 1 else 0 end, l_orderkey * 100000 + l_partkey) as place from lineitem")
def page_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two readers in page order, texts before tables."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("order"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("i"))
    found = context.in_page_order(rows.where("l_returnflag <> 'A'"), rows.where("l_returnflag = 'A'"))
    return found.select("doc_id", "page", F.col("order").alias("i"), "lane", F.col("place").cast("long").alias("place"))


@query(
    """with i as (select l_suppkey as doc_id, l_linenumber as page, case l_partkey % 9 when 0 then '草稿' when 1 then 'Draft' when 2 then '' else concat('text', l_partkey % 50) end as text, case when l_partkey % 7 = 0 then 9.0 else l_tax * 10 end as b, l_discount * 10 as c, case when l_partkey % 11 = 0 then 100.0 else l_quantity / 5 + 5 end as h from lineitem),
    s as (select * from i where trim(text) <> ''), m as (select doc_id, page, list_sort(list(b))[cast(floor(count(*) / 2) as bigint) + 1] as mb, list_sort(list(c))[cast(floor(count(*) / 2) as bigint) + 1] as mc from s group by all), a as (select doc_id, page, avg(h) as mean from s join m using (doc_id, page) where abs(b - mb) < 3 group by all),
    k as (select i.*, coalesce(mb, 0) as mb, coalesce(mc, 0) as mc, coalesce(mean, 10) as mean from i left join m using (doc_id, page) left join a using (doc_id, page))
    select doc_id, page, text, count(*) as n from k where not (regexp_matches(trim(text), '""" + context.WATERMARKS + """') or abs(b - mb) > greatest(mean * 0.8, 3) or abs(c - mc) > greatest(mean * 0.8, 3) or (mean > 0 and h > 4 * mean and length(trim(text)) <= 6)) group by all"""
)
def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items without watermarks."""
    part = F.col("l_partkey")
    text = F.when(part % 9 == 0, "草稿").when(part % 9 == 1, "Draft").when(part % 9 == 2, "").otherwise(F.concat(F.lit("text"), (part % 50).cast("string")))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text"), F.when(part % 7 == 0, 9.0).otherwise(F.col("l_tax") * 10).alias("b"), (F.col("l_discount") * 10).alias("c"), F.when(part % 11 == 0, 100.0).otherwise(F.col("l_quantity") / 5 + 5).alias("height")
    )
    return context.without_watermarks(items).groupBy("doc_id", "page", "text").agg(F.count("*").alias("n"))


@query(
    """with r as (select o_custkey as doc_id, o_orderkey % 3 as page, o_orderkey as region, floor(o_totalprice) % 700 as y0, floor(o_totalprice) % 700 + 60 as y1 from orders), c as (select l_suppkey * 10 + l_linenumber as doc_id, l_orderkey % 3 as page, l_orderkey as seq, l_partkey % 700 as y, l_partkey % 700 + 12 as bottom, concat('表', l_partkey) as text from lineitem where l_returnflag = 'R'),
    d as (select r.doc_id, r.page, region, case when y < y0 then y0 - bottom when y > y1 then y - y1 else least(abs(y - y0), abs(y - y1)) end as d, seq, text from r left join c on r.doc_id = c.doc_id and r.page = c.page)
    select doc_id, page, region, arg_min(text, row(d, seq, text)) filter (d <= 90) as title from d group by all"""
)
def nearby_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest caption of each region of a page."""
    y = F.floor("o_totalprice") % 700
    regions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("page"), F.col("o_orderkey").alias("region"), y.alias("y0"), (y + 60).alias("y1"))
    at = F.col("l_partkey") % 700
    captions = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("doc_id"), (F.col("l_orderkey") % 3).alias("page"), F.col("l_orderkey").alias("seq"), at.alias("y"), (at + 12).alias("bottom"), F.concat(F.lit("表"), F.col("l_partkey").cast("string")).alias("text"))
    return context.titled_regions(regions, captions)


def _set_sql(where: str) -> str:
    return f"""select p_size, count(*) as tables, sum(len(rows)) as total_rows, max(len(list_filter(filled, lambda x: x >= 2))) as widest, round(1 - sum(list_sum(filled)) / sum(cols * len(rows)), 4) as empty from (select *, list_transform(range(1, cols + 1), lambda c: len(list_filter(rows, lambda r: coalesce(trim(r[c]), '') <> ''))) as filled from
      (select *, list_max(list_transform(rows, lambda r: len(r))) as cols from tables)) where {where} group by p_size"""


@query(f"with {_TABLES}, a as ({_set_sql('p_partkey % 2 = 0')}), b as ({_set_sql('p_partkey % 2 = 1')}) select p_size, a.tables >= 0.8 * b.tables and a.total_rows >= 0.8 * b.total_rows and a.widest >= 0.8 * b.widest and a.empty <= b.empty + 0.15 as keep_first, cast(a.total_rows - b.total_rows as bigint) as more_rows from a join b using (p_size)")
def reader_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two readers of tables is kept: even keys against odd ones."""
    rows = _tables(spark, sf_dir)
    return context.chosen_reader(records.table_set(rows.where("p_partkey % 2 = 0"), ["p_size"]), records.table_set(rows.where("p_partkey % 2 = 1"), ["p_size"]), "p_size")


@query("with s as (select l_suppkey as q, 10 + l_suppkey % 3 * 5 as k, l_returnflag as channel, l_extendedprice as score, l_orderkey * 10 + l_linenumber as id, l_partkey from lineitem), r as (select *, row_number() over (partition by q, channel order by score desc, id, l_partkey) as rank from s) select q, channel, id, rank from r where rank <= 2 * k")
def channel_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many of each channel's best as the question gets."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), (10 + F.col("l_suppkey") % 3 * 5).alias("k"), F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey")
    w = Window.partitionBy("q", "channel").orderBy(F.desc("score"), "id", "l_partkey")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 2 * F.col("k")).select("q", "channel", "id", "rank")


RAW_LINES = ["[[T]]A\tB  C", "  [[page:{n}]] 第{n}条", "a\t\tb   c ", "plain {n}", ""]


@query(f"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(t, '[[T]]', ''), '\\[\\[page:[0-9]+\\]\\]', '', 'g'), '\\t', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) as line from (select p_partkey, {sample('p_partkey', RAW_LINES)} as t from part)")
def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without marks, tabs and runs of blanks."""
    t = F.expr(sample("p_partkey", RAW_LINES))
    for pattern, other in (("\\[\\[T\\]\\]", ""), ("\\[\\[page:[0-9]+\\]\\]", ""), ("\\t", " "), ("\\s{2,}", " ")):
        t = F.regexp_replace(t, pattern, other)
    return table(spark, sf_dir, "part").select("p_partkey", R.trimmed(t).alias("line"))


@query(
    """with l as (select doc_id, unnest(string_split(concat('first', chr(10), '[[page:', doc_id % 5 + 2, ']]', chr(10), text), chr(10))) as line, generate_subscripts(string_split(concat('first', chr(10), '[[page:', doc_id % 5 + 2, ']]', chr(10), text), chr(10)), 1) - 1 as i from documents where text is not null)
    select doc_id, case when i = 0 then 1 else doc_id % 5 + 2 end as page, count(*) as blocks, cast(sum(length(trim(regexp_replace(line, '\\r$', '')))) as bigint) as chars from l where i <> 1 and trim(regexp_replace(line, '\\r$', '')) <> '' group by all"""
)
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of plain text, with pages set by marks."""
    text = F.concat(F.lit("first\n[[page:"), (F.col("doc_id") % 5 + 2).cast("string"), F.lit("]]\n"), F.col("text"))
    rows = blocks_of(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("text")), "doc_id")
    return rows.groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query(
    """with p as (select o_custkey as doc_id, o_orderkey as seq, o_orderkey % 4 as gap, row_number() over (partition by o_custkey order by o_orderkey) as n, case o_orderkey % 5 when 0 then '续表 1' when 1 then '表1 甲' when 2 then '' when 3 then '表2 乙' else '表1 甲' end as title, case when o_orderstatus = 'P' then 'a|b' else 'a|b|c' end as h from orders),
    q as (select *, sum(case when gap = 0 then 3 else 1 end) over (partition by doc_id order by seq) as page from p), b as (select *, lag(page) over w as bp, lag(title) over w as bt, lag(h) over w as bh from q window w as (partition by doc_id order by seq)),
    c as (select *, case when bp is not null and page <= bp + 1 and h = bh and (title like '续表%' or (title <> '' and regexp_replace(title, '^\\s*续表', '表') = regexp_replace(bt, '^\\s*续表', '表')) or title = '') then 0 else 1 end as new from b)
    select doc_id, seq, sum(new) over (partition by doc_id order by seq) as table_no from c"""
)
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of tables that go on over pages."""
    key = F.col("o_orderkey")
    w = Window.partitionBy("doc_id").orderBy("seq")
    title = F.when(key % 5 == 0, "续表 1").when(key % 5 == 2, "").when(key % 5 == 3, "表2 乙").otherwise("表1 甲")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("seq"), F.when(key % 4 == 0, 3).otherwise(1).alias("step"), title.alias("title"), F.split(F.when(F.col("o_orderstatus") == "P", "a|b").otherwise("a|b|c"), "\\|").alias("headers"))
    paged = rows.withColumn("page_start", F.sum("step").over(w)).withColumn("page_end", F.col("page_start"))
    return tables.continued_tables(paged, least=0.75).select("doc_id", "seq", "table_no")


@query("select o_orderkey, coalesce(a.p_brand, b.p_brand) as brand from (select o_orderkey, case when o_orderkey % 3 > 0 then o_custkey % 50 + 1 end as doc, o_orderkey % 30 as tab from orders) q left join (select p_size as doc, p_partkey % 30 as tab, min(p_brand) as p_brand from part group by all) a on q.doc = a.doc and q.tab = a.tab left join (select p_partkey % 30 as tab, arg_min(p_brand, row(p_size, p_brand)) as p_brand from part group by all) b on q.doc is null and q.tab = b.tab")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by document and number; without a document the first that has the number."""
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc"), (F.col("p_partkey") % 30).alias("tab"), "p_brand")
    own = parts.groupBy("doc", "tab").agg(F.min("p_brand").alias("own"))
    first = parts.groupBy("tab").agg(F.min(F.struct("doc", "p_brand"))["p_brand"].alias("first"))
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 > 0, F.col("o_custkey") % 50 + 1).alias("doc"), (key % 30).alias("tab"))
    return asked.join(own, ["doc", "tab"], "left").join(first, "tab", "left").select("o_orderkey", F.when(F.col("doc").isNull(), F.col("first")).otherwise(F.col("own")).alias("brand"))
