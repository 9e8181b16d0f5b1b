"""Queries over mended cells, fields and table candidates, plain sections, and what an answer or evaluation run says about itself.
Each key of ``part`` stands for a cell or table whose text is chosen and filled by the key, as in ``tabular``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import repairs as P
from folioforge.operators import access, objects
from folioforge.plans.common import register, sample, table
from folioforge.plans.relations import _access
from folioforge.plans.tabular import _TABLES, _tables

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

CELLS = [
    "服务 {n} 万 . 3 人 2 左右", "万 {n} . 5 人", "{n}万 1 . 人 4", "岁 {n} 以下 儿童", "{n} - 岁 6", "绿 地 率  不 低 于 {n} % 。", "（ {n} 处 ） ， 其他", "比例{n}%以。上", "先说明；应符合要求{n}.。", " plain text {n} ", "",
]
LINES = ["14\t{n}//00\t5//x\t1", "{n}//1//23//456", "a\tb//1\t2\t3//4\t5\t6", "1234\t1//567\t2", "//12//3", "(1\t2//)\t%", "10 \t 20//0\t0//0\t0"]
FIELDS = ["名称#2|面积|备注#1", "面积|其他", "名称#1|规模", "甲|乙|丙"]
VALUES = ["幼儿园|{n}|— 12", "— {n} —|15-|-7-", "A{n}|{n}-{n}|-12345", " - |—|12"]
KEYS = ["名称|面积|备注", "名称|面积|甲", "名称|面积|名称#1", "面积|规模|甲"]
GRIDS = ["第一章 ........ {n}|1//第二章|2", "甲|{n}//乙|3//丙|", "一段|//正文|//没有|{n}|", "甲|乙", "|//|", "一|二|三//1|{n}|//|4|5//·····|x|y", "总则....|1|2|3|4//附则|2|3|4|{n}"]
NOTES = ["结论{n}| 结论{n} |结论{n}|", "||显示{n}|", "|清洗{n}|显示|", " |  ||无依据,降级", "||依据{n}|", "|同 |同|"]
ACCOUNTS = [" user{n} ", "", "   ", "admin", "u {n}"]


def _parts(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(sample("p_partkey", texts)).alias("x"))


def _duck(texts: list[str]) -> str:
    """The texts by key in DuckDB, with tabs written as such."""
    return f"select p_partkey, {sample('p_partkey', texts)} as x from part"


def _replaced(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, value in rules:
        text = f"regexp_replace({text}, '{pattern}', '{value}', 'g')"
    return text


_ORDER = [(p, v.replace("$", "\\")) for p, v in P.ORDER_REPAIRS]
_CELL = [
    (r"[ \t\r\f\x0B]+", " "), *[(r"([一-鿿])\s+([一-鿿])", r"\1\2")] * 2, *[(r"([0-9])\s+([一-鿿%％])", r"\1\2"), (r"([一-鿿])\s+([0-9])", r"\1\2")] * 2,
    (r"\s+([，。；：、,.!?;:%％）)])", r"\1"), (r"([（(])\s+", r"\1"), (r"([%％])([一-鿿])。", r"\1。\2"), (r"([。；])([一-鿿][^。；]*?)([0-9]{1,2}[.．])。$", r"\1\3\2。"), *_ORDER,
]


@query(f"with t as ({_duck(CELLS)}) select p_partkey, {_replaced('x', _ORDER)} as reordered, trim({_replaced('x', _CELL)}) as cell from t")
def cell_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrambled cell texts put right, by the short and the long list of rewrites."""
    return _parts(spark, sf_dir, CELLS).select("p_partkey", P.reordered(F.col("x")).alias("reordered"), P.cell_text(F.col("x")).alias("cell"))


_FITS = r"""regexp_extract(a, '[^\n]*$') <> '' and len(string_split(b, chr(9))) = len(string_split(regexp_extract(a, '[^\n]*$'), chr(9)))
    and len(list_filter(string_split(b, chr(9)), lambda c: not regexp_matches(trim(c), '{piece}') or length(trim(c)) > 3)) = 0
    and len(list_filter(list_zip(string_split(regexp_extract(a, '[^\n]*$'), chr(9)), string_split(b, chr(9))), lambda z: length(trim(z[1])) + length(trim(z[2])) > 6)) = 0""".replace("{piece}", P.NUMBER_PIECE)


@query(
    rf"""with t as ({_duck(LINES)}) select p_partkey, list_reduce(string_split(x, '//'), lambda a, b: case when {_FITS}
      then concat(regexp_replace(a, '[^\n]*$', ''), array_to_string(list_transform(list_zip(string_split(regexp_extract(a, '[^\n]*$'), chr(9)), string_split(b, chr(9))), lambda z: concat(rtrim(z[1]), trim(z[2]))), chr(9)))
      else concat(a, chr(10), b) end) as lines from t"""
)
def number_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page in which numbers that were split over two lines are one again."""
    return _parts(spark, sf_dir, LINES).select("p_partkey", F.array_join(P.merged_numbers(F.split("x", "//")), "\n").alias("lines"))


NAMES = "名称|事项|指标"


@query(
    f"""with {_TABLES}, r as (select p_partkey, headers, unnest(rows) as r, generate_subscripts(rows, 1) - 1 as row_index from tables)
    select p_partkey, row_index, list_filter(list_transform(headers, lambda h, i: case when regexp_matches(h, '{NAMES}') and trim(coalesce(r[i], '')) <> '' then trim(r[i]) end), lambda x: x is not null)[1] as name from r"""
)
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of a row whose header fits."""
    rows = _tables(spark, sf_dir).select("p_partkey", "headers", F.posexplode("rows").alias("row_index", "r"))
    return rows.select("p_partkey", F.col("row_index").cast("long").alias("row_index"), P.field_by_header(F.col("headers"), F.col("r"), NAMES).alias("name"))


@query(
    f"""with t as (select p_partkey, string_split({sample('p_partkey div 4', FIELDS).replace(' div ', ' // ')}, '|') as columns, string_split({sample('p_partkey', VALUES)}, '|') as v, string_split({sample('p_partkey div 16', KEYS).replace(' div ', ' // ')}, '|') as k from part),
    c as (select p_partkey, k, unnest(columns) as c, generate_subscripts(columns, 1) as i, v, columns from t),
    p as (select p_partkey, c as "column", coalesce(v[list_position(k, regexp_replace(c, '#[0-9]+$', ''))], v[i]) as cell, k, columns from c),
    f as (select p_partkey, unnest(k) as k, unnest(v) as v, list_transform(columns, lambda c: regexp_replace(c, '#[0-9]+$', '')) as bases from t),
    u as (select p_partkey, "column", cell from p where not (list_contains(k, "column") and not list_contains(list_transform(columns, lambda c: regexp_replace(c, '#[0-9]+$', '')), "column")) union all select p_partkey, k, v from f where not list_contains(bases, k))
    select p_partkey, "column", cell from u where cell is not null and not (regexp_matches(trim(cell), '{P.PAGE_MARK}') and length(regexp_replace(cell, '[^0-9]', '', 'g')) between 1 and 4 and regexp_matches(trim(cell), '^[—\\-－]|[—\\-－]$'))"""
)
def column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields placed under the columns of their table, by name or by place, without the rests of page numbers."""
    texts = [F.split(F.expr(sample(key, x)), "\\|").alias(name) for name, key, x in (("columns", "p_partkey div 4", FIELDS), ("v", "p_partkey", VALUES), ("k", "p_partkey div 16", KEYS))]
    rows = table(spark, sf_dir, "part").select("p_partkey", *texts)
    return rows.select("p_partkey", F.explode(P.cells_of_columns(F.col("k"), F.col("v"), F.col("columns"))).alias("x")).select("p_partkey", "x.column", "x.cell")


@query(
    f"""with t as (select p_partkey, list_transform(string_split(x, '//'), lambda r: string_split(r, '|')) as rows from ({_duck(GRIDS)})),
    s as (select p_partkey, len(rows) as n, list_max(list_transform(rows, lambda r: len(r))) as wide, list_filter(flatten(rows), lambda c: trim(c) <> '') as cells, rows from t),
    e as (select *, len(list_filter(range(1, wide + 1), lambda i: len(list_filter(rows, lambda r: coalesce(trim(r[i]), '') <> '')) >= 2)) as effective from s)
    select p_partkey, effective, n between 2 and 300 and wide between 2 and 40 and effective >= 2 and not (len(cells) > 0 and len(list_filter(cells, lambda c: regexp_matches(c, '{P.DOT_LEADER}'))) >= 0.2 * len(cells)) as candidate from e"""
)
def table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which grids have the shape of a table and aren't tables of contents."""
    grid = F.transform(F.split("x", "//"), lambda r: F.split(r, "\\|"))
    rows = _parts(spark, sf_dir, GRIDS).select("p_partkey", grid.alias("rows"))
    return rows.select("p_partkey", P.effective_columns(F.col("rows")).cast("long").alias("effective"), P.is_candidate(F.col("rows")).alias("candidate"))


_MARK = "coalesce(nullif(trim(replace(coalesce({c}, ''), '|', '\\|')), ''), ' ')"


@query(
    f"""with {_TABLES}, m as (select *, concat('| ', array_to_string(list_transform(headers, lambda h: {_MARK.format(c='h')}), ' | '), ' |', chr(10), '| ', array_to_string(list_transform(headers, lambda h: '---'), ' | '), ' |', chr(10),
      array_to_string(list_transform(rows, lambda r: concat('| ', array_to_string(list_transform(headers, lambda h, i: {_MARK.format(c='r[i]')}), ' | '), ' |')), chr(10))) as md from tables)
    select p_partkey, 0 as place, 'table' as type, md as raw, case when title <> '' then concat(title, chr(10), md) else md end as text from m
    union all select p_partkey, i, 'table_row', array_to_string(r, chr(9)), array_to_string(list_filter(r, lambda c: c <> ''), ' ') from (select p_partkey, unnest(rows) as r, generate_subscripts(rows, 1) as i from tables)"""
)
def table_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table as one block in Markdown and one block a row."""
    blocks = P.table_blocks(F.col("title"), F.col("headers"), F.col("rows"))
    return _tables(spark, sf_dir).select("p_partkey", F.posexplode(blocks).alias("place", "x")).select("p_partkey", F.col("place").cast("long").alias("place"), "x.type", "x.raw", "x.text")


@query(
    f"""with {_TABLES} select p_partkey, array_to_string(list_filter(list_concat([title, array_to_string(rows[1], ' ')], list_transform(list_zip(list_slice(headers, 1, least(len(headers), len(rows[1]))), list_slice(rows[1], 1, least(len(headers), len(rows[1])))), lambda z: concat(z[1], '：', z[2]))), lambda x: x <> ''), ' ') as text from tables"""
)
def object_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a record that evaluation searches: title, content and fields."""
    first = F.col("rows")[0]
    both = F.least(F.size("headers"), F.size(first))
    text = P.object_text(F.col("title"), F.array_join(first, " "), F.slice("headers", F.lit(1), both), F.slice(first, F.lit(1), both))
    return _tables(spark, sf_dir).select("p_partkey", text.alias("text"))


@query(
    f"""with t as (select p_partkey, string_split(x, '|') as x from ({_duck(NOTES)})), v as (select p_partkey, trim(x[1]) as r, trim(x[2]) as c, trim(x[3]) as s, case when x[4] = '' then 0 else len(string_split(x[4], ',')) end as n from t),
    w as (select *, c <> '' and c <> s as replaced from v) select p_partkey, r as raw, c as clean, s as shown, n as reasons, replaced from w where r <> '' or replaced or n > 0"""
)
def answer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was changed between an answer's raw and displayed conclusion; answers without a change have no row."""
    x = lambda i: F.split("x", "\\|")[i]
    reasons = F.when(x(3) == "", F.array().cast("array<string>")).otherwise(F.split(x(3), ","))
    told = _parts(spark, sf_dir, NOTES).select("p_partkey", P.answer_diagnostics(x(0), x(1), x(2), reasons).alias("d")).where("d is not null")
    return told.select("p_partkey", "d.raw", "d.clean", "d.shown", F.size("d.reasons").cast("long").alias("reasons"), "d.replaced")


@query(f"with t as ({_duck(ACCOUNTS)}) select nullif(trim(x), '') as account, count(*) as questions from t group by 1")
def evaluation_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, ACCOUNTS).groupBy(P.evaluation_account(F.col("x")).alias("account")).agg(F.count("*").alias("questions"))


@query(
    """with b as (select conv_id, turn, turn // 4 as page, role = 'user' and turn % 3 = 0 as head, coalesce(text, '') as text from conversations),
    s as (select *, coalesce(last_value(case when head then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), '') as section from b)
    select conv_id, section, min(turn) as first_block, min(page) as page_start, max(page) as page_end, md5(string_agg(text, chr(10) order by turn)) as content from s where not head group by conv_id, section having length(trim(string_agg(text, '' order by turn))) >= 8"""
)
def plain_section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs grouped by section: turns of a conversation as blocks, some of the user's as headings."""
    head = (F.col("role") == "user") & (F.col("turn") % 3 == 0)
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_index"), F.expr("turn div 4").alias("page"), F.when(head, 1).alias("level"), F.coalesce("text", F.lit("")).alias("text"))
    found = objects.plain_sections(objects.with_sections(blocks))
    return found.select(F.col("doc_id").alias("conv_id"), F.col("title").alias("section"), "first_block", "page_start", "page_end", F.md5("content").alias("content"))


@query("""with d as (select o_orderkey as k, o_orderstatus = 'F' as enabled, c_nationkey as nation, case when o_orderkey % 4 > 0 then cast(o_custkey as varchar) end as pid, case when o_orderkey % 5 = 0 then 'u2' end as owner,
      o_orderkey % 3 as listed, o_orderkey % 5 as level from orders join customer on o_custkey = c_custkey),
    u as (select * from (values ('u1', 2, ['1','2','3'], []::varchar[]), ('u2', 3, ['4'], ['5','6']), ('u3', 9, []::varchar[], []::varchar[])) t(id, most, member, owned)),
    v as (select id, enabled, case when most = 9 then true when pid is not null or owner is not null then
      (coalesce(owner = id, false) or (listed = 1 and id = 'u1') or (pid is not null and listed = 2 and list_contains(member, pid)) or (pid is not null and owner is null and list_contains(owned, pid)))
      else level <= most end as ok from d, u)
    select id as user_id, count(*) as managed, count(*) filter (enabled) as searchable from v where ok group by 1""")
def management_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user sees in management: the access rule alone, so that documents that search passes over are listed too."""
    enabled = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("enabled"))
    seen = _access(spark, sf_dir).where(access.may_view()).join(enabled, "o_orderkey")
    return seen.groupBy(F.col("user.id").alias("user_id")).agg(F.count("*").alias("managed"), F.count_if("enabled").alias("searchable"))
