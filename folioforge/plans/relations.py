"""Queries over rows and events: access, tables, sequences, evaluation, feedback."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.operators import access, evaluation, tables
from folioforge.plans.common import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents (project: the customer), and a few users; user and document as structs."""
    orders = table(spark, sf_dir, "orders")
    listed = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("u1")))
    document = F.struct(
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey").cast("string")).alias("project_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("u2")).alias("project_owner_id"),
        F.lit("other").alias("category"),
        listed.alias("accessible_user_ids"),
        (F.col("o_orderkey") % 5).cast("int").alias("permission_level"),
    )
    nation = table(spark, sf_dir, "customer").groupBy("c_custkey").agg(F.first("c_nationkey").alias("nation"))
    rows = orders.join(nation, orders["o_custkey"] == nation["c_custkey"]).select("o_orderkey", "nation", document.alias("document"))
    users = spark.createDataFrame([("u1", "employee", ["1", "2", "3"], []), ("u2", "manager", ["4"], ["5", "6"]), ("u3", "admin", [], []), ("u4", "guest", ["1"], [])], "id string, role string, project_ids array<string>, owned_project_ids array<string>")
    return rows.crossJoin(F.broadcast(users.select(F.struct("*").alias("user"))))  # four users


@query("""with d as (select o_orderkey as k, c_nationkey as nation, case when o_orderkey % 4 > 0 then cast(o_custkey as varchar) end as pid, case when o_orderkey % 5 = 0 then 'u2' end as owner,
      o_orderkey % 3 as listed, o_orderkey % 5 as level from orders join customer on o_custkey = c_custkey),
    u as (select * from (values ('u1', 'employee', 2, ['1','2','3'], []::varchar[]), ('u2', 'manager', 3, ['4'], ['5','6']), ('u3', 'admin', 4, []::varchar[], []::varchar[]), ('u4', 'guest', null, ['1'], []::varchar[])) t(id, role, most, member, owned)),
    v as (select nation, id, case when most is null then false when role = 'admin' then true when pid is not null or owner is not null then
      (coalesce(owner = id, false) or (listed = 1 and id = 'u1') or (pid is not null and listed = 2 and list_contains(member, pid)) or (pid is not null and owner is null and list_contains(owned, pid)))
      else level <= most end as ok from d, u)
    select nation, id as user_id, count(*) filter (ok) as accessible, count(*) filter (not ok) as denied from v group by all""")
def acl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = access.may_view()
    return _access(spark, sf_dir).groupBy("nation", F.col("user.id").alias("user_id")).agg(F.count_if(ok).alias("accessible"), F.count_if(~ok).alias("denied"))


@query("""select id as user_id, count(*) as manageable from (select o_orderkey as k, case when o_orderkey % 4 > 0 then cast(o_custkey as varchar) end as pid, case when o_orderkey % 5 = 0 then 'u2' end as owner from orders join customer on o_custkey = c_custkey),
    (values ('u2', 'manager', ['5','6']), ('u3', 'admin', []::varchar[])) t(id, role, owned) where role = 'admin' or owner = id or (owner is null and list_contains(owned, pid)) group by id""")
def acl_manage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _access(spark, sf_dir).where(access.may_manage()).groupBy(F.col("user.id").alias("user_id")).agg(F.count("*").alias("manageable"))


@query("select conv_id, turn, role, lag(turn) over w as prev_id, lead(turn) over w as next_id from conversations window w as (partition by conv_id order by turn)")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chained(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "turn")


@query("select c.conv_id, c.turn, concat(substring(p.text, 1, 40), ': ', c.role) as titled from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 and p.text is not null where p.text is not null union all select c.conv_id, c.turn, c.role from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 where p.text is null")
def parent_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the beginning of its parent; a self-join on both keys."""
    rows = table(spark, sf_dir, "conversations")
    parents = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.substring("text", 1, 40).alias("head"))
    return rows.join(parents, ["conv_id", "turn"], "left").select("conv_id", "turn", F.concat_ws(": ", "head", "role").alias("titled"))


@query("select a.l_orderkey, a.l_linenumber, count(b.l_linenumber) as siblings, min(b.l_linenumber) as first_sibling from lineitem a left join lineitem b on a.l_orderkey = b.l_orderkey and a.l_returnflag = b.l_returnflag and a.l_linenumber <> b.l_linenumber group by all")
def sibling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many siblings a row has and the first of them, from counts by group; no pairs are made."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    groups = rows.groupBy("l_orderkey", "l_returnflag").agg(F.sum("n").alias("all"), F.min("l_linenumber").alias("first"))
    joined = rows.join(groups, ["l_orderkey", "l_returnflag"])
    second = joined.where("l_linenumber > first").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("second"))
    other = F.when(F.col("l_linenumber") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return joined.join(second, ["l_orderkey", "l_returnflag"], "left").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("n") * (F.col("all") - F.col("n"))).alias("siblings"), F.min(other).alias("first_sibling"))


@query("""with h as (select conv_id, turn, case when role = 'user' then text when turn % 3 = 0 then '' end as v from conversations)
    select conv_id, turn, length(coalesce(v, last_value(nullif(v, '') ignore nulls) over (partition by conv_id order by turn rows unbounded preceding))) as filled from h""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("role") == "user", F.col("text")).when(F.col("turn") % 3 == 0, "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("v"))
    return tables.filled_down(rows, ["conv_id"], "turn", "v").select("conv_id", "turn", F.length("v").cast("long").alias("filled"))


@query("""with b as (select l_orderkey, l_linenumber, case when l_linenumber = 1 then 1 when l_quantity > 40 then 2 when l_quantity > 30 then 3 end as lv, concat('h', l_linenumber) as t from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag from lineitem group by all)),
    w as (select *, max(case when lv = 1 then l_linenumber end) over w as a1, max(case when lv = 2 then l_linenumber end) over w as a2, max(case when lv = 3 then l_linenumber end) over w as a3,
      max(case when lv < 2 then l_linenumber end) over w as e2, max(case when lv < 3 then l_linenumber end) over w as e3 from b window w as (partition by l_orderkey order by l_linenumber rows unbounded preceding))
    select l_orderkey, l_linenumber, concat_ws(' > ', case when a1 is not null then concat('h', a1) end, case when a2 is not null and (e2 is null or a2 > e2) then concat('h', a2) end, case when a3 is not null and (e3 is null or a3 > e3) then concat('h', a3) end) as section_path from w""")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading stack: lines of an order as blocks, their quantity as heading level."""
    level = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 30, 3)
    blocks = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", level.alias("level"), F.concat(F.lit("h"), "l_linenumber").alias("title"))
    return tables.section_paths(blocks, "l_orderkey", "l_linenumber", "level", "title", 3).select("l_orderkey", "l_linenumber", "section_path")


@query("""with m as (select l_orderkey, l_linenumber, l_quantity > 20 as i, lag(l_quantity > 20) over (partition by l_orderkey order by l_linenumber) as b from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag from lineitem group by all)),
    n as (select *, sum(case when i and not coalesce(b, false) then 1 else 0 end) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) as r from m)
    select l_orderkey, min(l_linenumber) as first, max(l_linenumber) as last, count(*) as n from n where i group by l_orderkey, r""")
def row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.runs(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", F.col("l_quantity") > 20)


_RUN = "case when s.first >= 0 and s.wide >= 3 then list_append(s.runs, {'first': s.first, 'behind': %s, 'wide': s.wide}) else s.runs end"


@query(
    f"""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda t: len(string_split(t, ', '))) as w from documents where text is not null),
    f as (select doc_id, w, list_reduce(list_prepend({{'first': -1, 'base': 0, 'gap': 0, 'wide': 0, 'i': 0, 'runs': []::struct(first bigint, behind bigint, wide bigint)[]}}, list_transform(w, lambda n, i: {{'first': -1, 'base': n, 'gap': 0, 'wide': 0, 'i': i - 1, 'runs': []::struct(first bigint, behind bigint, wide bigint)[]}})), lambda s, x:
      case when s.first >= 0 and x.base > 1 and abs(x.base - s.base) <= 1 then {{'first': s.first, 'base': s.base, 'gap': 0, 'wide': s.wide + 1, 'i': x.i, 'runs': s.runs}} when s.first >= 0 and x.base <= 1 and s.gap < 2 then {{'first': s.first, 'base': s.base, 'gap': s.gap + 1, 'wide': s.wide, 'i': x.i, 'runs': s.runs}}
      else {{'first': case when x.base > 1 then x.i else -1 end, 'base': x.base, 'gap': 0, 'wide': case when x.base > 1 then 1 else 0 end, 'i': x.i, 'runs': {_RUN % 'x.i'}}} end) as s from l),
    r as (select doc_id, unnest({_RUN % 'len(w)'}) as r from f) select doc_id, r.first as first, r.behind as behind, r.wide as wide from r"""
)
def bridged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines with commas in all documents, with up to two lines without inside."""
    widths = F.transform(F.split("text", "\n"), lambda t: F.size(F.split(t, ", ")))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.inline(tables.bridged_runs(widths)))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("first", "behind", "wide")])


@query("select l_orderkey, count(*) as n_rows, count(*) filter (l_discount > 0.08) as n_flagged, min(l_linenumber) as first_row, max(l_linenumber) as last_row, round(1 - least(0.5, 0.1 * count(*) filter (l_discount > 0.08)), 4) as confidence from lineitem group by l_orderkey".replace("round(1 - least(0.5, 0.1 * count(*) filter (l_discount > 0.08)), 4)", "round(cast(1 - least(0.5, 0.1 * count(*) filter (l_discount > 0.08)) as double), 4)"))
def table_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grouped_tables(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_discount") > 0.08).withColumn("confidence", F.col("confidence").cast("double"))


@query("select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as row_in_slice from lineitem qualify row_in_slice <= 20")
def table_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("at"))
    return tables.slices(rows, ["l_partkey"], "at").select("l_partkey", "l_orderkey", "l_linenumber", F.col("row_in_slice").cast("long").alias("row_in_slice"))


_VOTES = [("code", "(?i)brand", 2.0), ("indicator", "[0-9]", 1.5), ("indicator", "(?i)steel|brass", 1.0), ("legend", "(?i)small|medium", 1.5)]


@query("""with s as (select p_partkey, concat_ws(' ', p_name, p_brand, p_type) as t from part), v as (select p_partkey, case when regexp_matches(t, '(?i)brand') then 2.0 else 0 end as code,
    (case when regexp_matches(t, '[0-9]') then 1.5 else 0 end + case when regexp_matches(t, '(?i)steel|brass') then 1.0 else 0 end) as indicator, case when regexp_matches(t, '(?i)small|medium') then 1.5 else 0 end as legend from s)
    select p_partkey, case when greatest(code, indicator, legend) = 0 then 'generic' when code >= greatest(indicator, legend) then 'code' when indicator >= legend then 'indicator' else 'legend' end as type, cast(greatest(code, indicator, legend) as double) as weight from v""")
def column_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.weighted_type(table(spark, sf_dir, "part"), "p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type"), _VOTES)


_CELL = "case p_partkey % 5 when 0 then concat(p_size, '-', p_size + 10, ' mm') when 1 then concat('>= ', p_size) when 2 then concat(p_size, '.5 kg') when 3 then '-' else p_brand end"


@query(f"""with c as (select p_partkey, trim({_CELL}) as t from part), n as (select *, list_transform(regexp_extract_all(t, '-?[0-9]+(\\.[0-9]+)?'), lambda x: cast(x as double)) as x from c),
    k as (select *, case when t in ('', '-', '—', '/') then 'absent' when len(x) >= 2 and regexp_matches(t, '[-~～—至]') then 'range' when len(x) >= 1 and regexp_matches(t, '≥|>=') then 'at_least' when len(x) >= 1 then 'number' else 'text' end as kind from n)
    select p_partkey, kind, case when kind in ('range', 'at_least') then x[1] end as low, case when kind = 'range' then x[2] end as high, case when kind = 'number' then x[1] end as value,
    nullif(regexp_extract(t, '[0-9]\\s*(%|[a-zA-Z]+)\\s*$', 1), '') as unit from k""")
def cell_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", V.cell_value(F.expr(_CELL)).alias("c"))
    return rows.select("p_partkey", "c.kind", F.col("c.min").alias("low"), F.col("c.max").alias("high"), "c.value", "c.unit")


@query("select p_partkey, string_agg(concat(k, '=', v), '; ' order by k) as fields from (select p_partkey, unnest(['name', 'brand', 'size']) as k, unnest([trim(p_name), trim(p_brand), case when p_size > 10 then cast(p_size as varchar) else '' end]) as v from part) where v <> '' group by p_partkey")
def row_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header to cell maps; a repeated header takes its last cell."""
    headers = F.array(*[F.lit(h) for h in ("name", "brand", "brand", "size")])
    cells = F.array("p_name", F.lit("first"), "p_brand", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(" "))
    pairs = F.transform(F.array_sort(F.map_entries(tables.row_fields(headers, cells))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(pairs, "; ").alias("fields"))


@query("with c as (select distinct p_size, p_brand, cast(p_partkey as varchar) as code from part) select a.p_size, a.code, max_by(b.code, length(b.code)) as parent_code from c a left join c b on a.p_size = b.p_size and length(b.code) < length(a.code) and starts_with(a.code, b.code) group by all")
def parent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "part").select("p_size", F.col("p_partkey").cast("string").alias("code")).distinct()
    return tables.parent_codes(codes, "p_size", "code").select("p_size", "code", "parent_code")


@query("select count(*) as total, count(*) filter (toxic = 0) as kept, round(avg(quality), 2) as mean_quality, count(*) filter (quality = 1 and toxic = 0) as passed from labels")
def eval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 0).alias("kept"), F.round(F.avg("quality"), 2).alias("mean_quality"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))


@query("""select source, round(count(*) filter (quality = 1) / nullif(count(quality), 0), 4) as quality_rate, round(count(*) filter (toxic = 0) / nullif(count(toxic), 0), 4) as clean_rate,
    round(count(*) filter (quality = 1 and toxic = 1) / nullif(count(*) filter (toxic = 1), 0), 4) as toxic_quality from documents left join labels using (doc_id) group by source""")
def ratio_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return rows.groupBy("source").agg(
        evaluation.ratio(F.col("quality").isNotNull(), good).alias("quality_rate"), evaluation.ratio(F.col("toxic").isNotNull(), clean).alias("clean_rate"), evaluation.ratio(F.col("toxic") == 1, good).alias("toxic_quality")
    )


@query("""select doc_id, case when toxic = 1 then case when quality = 0 then 2 else 0 end when quality = 0 or n_chars < 100 then 0 when lang = 'en' then case when n_chars > 1000 then 2 else 1 end when n_chars % 2 = 0 then 1 else case when n_chars % 10 / 10.0 >= 0.5 then 2 else 1 end end as score from documents join labels using (doc_id)""")
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    overlap = F.when(F.col("n_chars") % 2 == 1, F.col("n_chars") % 10 / 10.0)
    refused = F.col("quality") == 0
    score = evaluation.item_score(F.col("toxic") == 1, refused, F.col("n_chars") >= 100, F.col("lang") == "en", F.col("n_chars") > 1000, overlap)
    return rows.select("doc_id", score.alias("score"))


@query("select trim(event_type) as reason, count(*) as n from events where trim(event_type) <> '' group by 1 order by n desc, reason limit 5")
def error_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.most_frequent(table(spark, sf_dir, "events"), "event_type")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by user_id".replace("(ts, event_id)", "row(ts, event_id)"))
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return evaluation.latest(rows, "user_id", "at", "event_type", "ts")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, regexp_matches(props, '[0-9]') as has_digit from events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.col("props").rlike("[0-9]").alias("has_digit"))


@query("""select o_orderkey, round(least(case o_orderstatus when 'F' then 1.0 when 'O' then 0.35 else 0.55 end + least(greatest(date_diff('day', date '2000-01-01', cast(o_orderdate as date)) / 36500.0, 0), 0.2), 1.0), 6) as priority from orders""".replace("round(least(", "round(cast(least(").replace(", 1.0), 6)", ", 1.0) as double), 6)"))
def version_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "current").when(F.col("o_orderstatus") == "O", "draft").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(V.recency(status, F.to_date("o_orderdate")), 6).alias("priority"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, concat('第', o_orderkey % 90 + 1, '条') as clause from orders")
def date_and_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates out of prose, and article numbers at the beginning of a text."""
    prose = F.concat(F.lit("于"), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("起施行"))
    clause = F.concat(F.lit(" 第"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("条 总则"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normal_date(prose).alias("iso"), T.article_number(clause).alias("clause"))


@query("select l_orderkey, l_linenumber, case when l_quantity < 10 then 0 when l_quantity < 25 then 1 when l_quantity < 40 then 2 else 3 end as band, (select 1) as one from lineitem".replace(", (select 1) as one", ""))
def range_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point in interval: the first of a few bounded intervals that holds the value, by a sorted array instead of a range join."""
    bounds = F.array(*[F.lit(float(b)) for b in (10, 25, 40)])
    band = F.size(F.filter(bounds, lambda b: b <= F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", band.alias("band"))


@query("""select p_partkey, [5, 20, 35, 50][k] as nearest from (select p_partkey, case when abs(p_size - 5) <= abs(p_size - 20) then 1 when abs(p_size - 20) <= abs(p_size - 35) then 2 when abs(p_size - 35) <= abs(p_size - 50) then 3 else 4 end as k from part) join part using (p_partkey) where abs(p_size - [5, 20, 35, 50][k]) <= 6""")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a table's columns within a tolerance, ties to the one further left."""
    columns = F.array(*[F.lit(c) for c in (5, 20, 35, 50)])
    best = F.element_at(F.array_sort(F.transform(columns, lambda c, i: F.struct(F.abs(F.col("p_size") - c).alias("gap"), i.alias("i"), c.alias("at")))), 1)
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).where("b.gap <= 6").select("p_partkey", F.col("b.at").alias("nearest"))


@query("with t as (select l_orderkey, l_returnflag as k, min(l_linenumber) as first_line from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag from lineitem group by all) group by all) select l_orderkey, string_agg(k, ',' order by first_line) as headers from t group by l_orderkey")
def header_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.create_map("l_returnflag", F.col("l_quantity").cast("string")).alias("fields"))
    return tables.headers_in_order(rows, ["l_orderkey"], "l_linenumber", "fields").select("l_orderkey", F.array_join("headers", ",").alias("headers"))


@query("""select o_custkey, count(*) as pages, count(*) filter (o_totalprice > 200000) as leader, count(*) >= 4 and count(*) filter (o_totalprice > 200000) * 2 >= count(*) as is_toc from orders group by o_custkey""")
def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with enough members of which half at least carry a mark (contents pages by their dot leaders)."""
    mark = F.col("o_totalprice") > 200000
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("pages"), F.count_if(mark).alias("leader"), ((F.count("*") >= 4) & (F.count_if(mark) * 2 >= F.count("*"))).alias("is_toc"))


@query("select o_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as upper_median from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey".replace("list_sort(list(l_quantity))[count(*) // 2 + 1]", "list_sort(list(l_quantity))[cast(floor(count(*) / 2) as bigint) + 1]"))
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of the two middle values, not their mean, from counts by value."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_quantity").agg(F.count("*").alias("n"))
    counts = counts.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    upto = F.sum("n").over(Window.partitionBy("o_orderkey").orderBy("l_quantity"))
    every = F.sum("n").over(Window.partitionBy("o_orderkey"))
    return counts.withColumn("upto", upto).withColumn("every", every).where(F.col("upto") > F.floor(F.col("every") / 2)).groupBy("o_orderkey").agg(F.min("l_quantity").alias("upper_median"))


@query("select coalesce(nullif(o_orderpriority, ''), 'unknown') as value, count(*) as n from orders group by 1")
def debug_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(F.nullif("o_orderpriority", F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


@query("select p_partkey, p_name, case when r = 1 then p_brand else concat(p_brand, '#', r) end as unique_name from (select *, row_number() over (partition by p_brand, p_size order by p_partkey) as r from part)")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").withColumn("r", n).select("p_partkey", "p_name", F.when(F.col("r") == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("#"), "r")).alias("unique_name"))
