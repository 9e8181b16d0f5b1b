"""Queries over positioned text and drawn lines."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import coordinates
from folioforge.plans.common import register, sample, table

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

#: Texts of items; eight orders make a page, an order a row or two, a line item an item.
TEXTS = ["名称", "面积 {n}", "- 12 -", "A{n}", "● ○ ●", "配套设施  说明", "Scale", "○ ●", "{n}", "room"]
_ITEM = {"page": "l_orderkey {div} 8", "seq": "l_orderkey * 8 + l_linenumber", "x": "10 + 90 * (l_linenumber % 4) + l_partkey % 5", "y": "30 + 16 * (l_orderkey % 8) + l_suppkey % 4 + 7 * (l_linenumber {div} 4)", "height": "8 + l_linenumber % 3"}
_BOX = {"x0": "5", "y0": "20 + page % 7", "x1": "300 + page % 70", "y1": "150 - page % 5"}
_LINE = {"x0": "case when l_linenumber % 2 = 0 then l_partkey % 30 else 12 * (l_partkey % 10) end", "y0": "case when l_linenumber % 2 = 0 then 10 * (l_suppkey % 12) + l_partkey % 3 else l_suppkey % 40 end", "x1": "case when l_linenumber % 2 = 0 then l_partkey % 30 + 20 + l_quantity else 12 * (l_partkey % 10) + l_partkey % 2 end", "y1": "case when l_linenumber % 2 = 0 then 10 * (l_suppkey % 12) + l_partkey % 3 else l_suppkey % 40 + 15 + l_quantity end"}
_EDGES = {"x0": "page % 20", "y0": "page % 9 + 5", "x1": "100 + page % 13", "y1": "80 + page % 11"}


def _sql(fields: dict[str, str], div: str) -> str:
    return ", ".join(f"cast({v.format(div=div)} as {'bigint' if k in ('page', 'seq') else 'double'}) as {k}" for k, v in fields.items())


def _clusters(xs: str, tolerance: str) -> str:
    """DuckDB: clusters of a sorted list that isn't empty."""
    one = "[{'total': x, 'n': 1}]"
    return f"list_reduce(list_transform({xs}, lambda x: {one}), lambda k, x: case when abs(x[1].total - k[-1].total / k[-1].n) <= {tolerance} then list_append(list_slice(k, 1, len(k) - 1), {{'total': k[-1].total + x[1].total, 'n': k[-1].n + 1}}) else list_concat(k, x) end)"


def _centres(xs: str, tolerance: str, least: int) -> str:
    return f"list_transform(list_filter({_clusters(xs, tolerance)}, lambda c: c.n >= {least}), lambda c: cast(floor(c.total / c.n + 0.5) as bigint))"


def _closed(values: str, low: str, high: str) -> str:
    kept = f"list_filter({values}, lambda v: v between {low} - 3 and {high} + 3)"
    return f"case when len({kept}) = 0 then [] else list_concat(case when abs(({kept})[1] - {low}) > 4 then [cast(floor({low} + 0.5) as bigint)] else [] end, {kept}, case when abs(({kept})[-1] - {high}) > 4 then [cast(floor({high} + 0.5) as bigint)] else [] end) end"


def _bounds_sql(lines: str, regions: str) -> str:
    """DuckDB: CTE cut (page, xs, ys) of tables of lines and regions with one region a page."""
    return f"""usable as (select l.*, abs(l.x1 - l.x0) >= abs(l.y1 - l.y0) as flat, r.x0 as bx0, r.y0 as by0, r.x1 as bx1, r.y1 as by1 from {lines} l join {regions} r using (page)
      where not (abs(l.x1 - l.x0) > 250 and abs(l.y1 - l.y0) > 250) and not (l.x0 <= 1 and l.y0 <= 1) and l.x1 >= r.x0 - 3 and l.x0 <= r.x1 + 3 and l.y1 >= r.y0 - 3 and l.y0 <= r.y1 + 3),
    places as (select page, bx0, by0, bx1, by1, list((x0 + x1) / 2 order by (x0 + x1) / 2) filter (not flat) as xs, list((y0 + y1) / 2 order by (y0 + y1) / 2) filter (flat) as ys from usable group by all),
    centred as (select page, bx0, by0, bx1, by1, {_centres('xs', '2', 1)} as xs, {_centres('ys', '2', 1)} as ys from places where len(xs) >= 2 and len(ys) >= 2),
    cut as (select * from (select page, {_closed('xs', 'bx0', 'bx1')} as xs, {_closed('ys', 'by0', 'by1')} as ys from centred) where len(xs) >= 2 and len(ys) >= 2)"""


@query(f"with lines_ as (select {_sql({'page': 'l_orderkey {div} 8', **_LINE}, '//')} from lineitem), regions_ as (select page, {_sql(_EDGES, '//')} from (select distinct page from lines_)), {_bounds_sql('lines_', 'regions_')} select page, array_to_string(xs, ',') as xs, array_to_string(ys, ',') as ys from cut")
def line_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rows that drawn lines make of each page's region."""
    fields = {"page": "l_orderkey {div} 8", **_LINE}
    lines = table(spark, sf_dir, "lineitem").selectExpr(*[f"cast({v.format(div='div')} as {'bigint' if k == 'page' else 'double'}) as {k}" for k, v in fields.items()])
    regions = lines.select("page").distinct().selectExpr("page", "0 as region", *[f"cast({v} as double) as {k}" for k, v in _EDGES.items()])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return coordinates.boundaries(lines, regions, ["page"]).select("page", text("xs"), text("ys"))


def _fold_rows(source: str) -> str:
    """DuckDB: CTE numbered: the items of a table with the row of each."""
    return f"""pages_ as (select page, greatest(avg(height) * 0.7, 6) as tolerance, list({{'y': y, 'x': x, 'seq': seq, 'text': text, 'width': width, 'height': height}} order by y, x, seq, text) as items from {source} group by page),
    folded as (select page, items, list_reduce(list_prepend({{'row': -1, 'mean': 0.0::double, 'n': 0, 'out': []::integer[]}}, list_transform(items, lambda i: {{'row': -1, 'mean': i.y, 'n': 0, 'out': []::integer[]}})), lambda s, i:
      case when s.row >= 0 and abs(i.mean - s.mean) <= tolerance then {{'row': s.row, 'mean': (s.mean * s.n + i.mean) / (s.n + 1), 'n': s.n + 1, 'out': list_append(s.out, s.row)}} else {{'row': s.row + 1, 'mean': i.mean, 'n': 1, 'out': list_append(s.out, s.row + 1)}} end).out as rows_ from pages_),
    opened as (select page, unnest(items) as i, unnest(rows_) as row from folded), numbered as (select page, row, i.y as y, i.x as x, i.seq as seq, i.text as text, i.width as width, i.height as height from opened)"""


def _joined(texts: str) -> str:
    return f"trim(regexp_replace(array_to_string(list_filter({texts}, lambda t: t <> ''), ' '), '\\s+', ' ', 'g'))"


_PARTS = f"""cuts as (select *, case when x - max(x + width) over (partition by page, row order by x, y, seq rows between unbounded preceding and 1 preceding) > greatest(avg(height) over (partition by page, row) * 1.2, 8) then 1 else 0 end as cut from numbered),
    runs as (select *, sum(cut) over (partition by page, row order by x, y, seq rows unbounded preceding) as segment from cuts),
    parts as (select page, row, segment, {_joined('list(text order by x, y, seq, text)')} as text, min(x) as x, max(height) as height from runs group by page, row, segment)"""


def _wide(g: str) -> str:
    return f"coalesce(list_max(list_transform({g}, lambda r: len(r))), 0)"


def _used(g: str) -> str:
    return f"list_transform(range(1, {_wide(g)} + 1), lambda i: len(list_filter({g}, lambda r: r[i] <> '')))"


def _trimmed(name: str, source: str, g: str) -> str:
    """DuckDB: CTE name: source with g without empty edges and sparse columns."""
    a, b, c = f"{name}_a", f"{name}_b", f"{name}_c"
    keep = f"list_filter(range(1, {_wide(g)} + 1), lambda i: ({_used(g)})[i] >= case when len({g}) >= 8 and {_wide(g)} >= 8 then greatest(3, ceil(len({g}) * 0.25)) else 2 end)"
    return f"""{a} as (select *, list_filter(range(1, len({g}) + 1), lambda i: len(list_filter({g}[i], lambda c: c <> '')) > 0) as full_ from {source}), {b} as (select * exclude (full_) replace (case when len(full_) > 0 then list_slice({g}, full_[1], full_[-1]) else [] end as {g}) from {a}),
    {c} as (select * exclude (some_) replace (list_transform({g}, lambda r: list_slice(r, some_[1], some_[-1])) as {g}) from (select *, list_filter(range(1, {_wide(g)} + 1), lambda i: len(list_filter({g}, lambda r: r[i] <> '')) > 0) as some_ from {b})),
    {name} as (select * replace (case when {_wide(g)} > 2 and len({g}) >= 3 and len({keep}) >= 2 then list_transform({g}, lambda r: list_transform({keep}, lambda i: r[i])) else {g} end as {g}) from {c})"""


def _interval(value: str, bounds: str) -> str:
    return f"list_position(list_transform(range(1, len({bounds})), lambda i: {value} between {bounds}[i] - 2 and {bounds}[i + 1] + 2), true)"


_MERGED = """list_reduce(list_transform(rows_, lambda r: [r]), lambda k, r: case when len(list_filter(r[1], lambda c: c <> '')) > 0 and len(list_filter(r[1], lambda c: c <> '')) < greatest(2, len(r[1]) / 2) and len(list_filter(k[-1], lambda c: c <> '')) > 0
      and len(list_filter(range(1, len(r[1]) + 1), lambda i: r[1][i] <> '' and k[-1][i] = '' and len(list_filter(list_slice(k[-1], i, 1000), lambda c: c <> '')) > 0)) = 0
      then list_append(list_slice(k, 1, len(k) - 1), list_transform(range(1, len(r[1]) + 1), lambda i: """ + _joined("[k[-1][i], r[1][i]]") + ")) else list_concat(k, r) end)"
_STATS = "len({g}) as {p}n, len(list_filter({u}, lambda n: n >= 2)) as {p}c, coalesce(list_sum({u}) / nullif(len({g}) * len({u}), 0), 0) as {p}f"
_MARKED = "len(tokens) >= 2 and len(list_filter(tokens, lambda t: not regexp_matches(t, '^[●○]$'))) = 0 and r > 0 and first > 0 and last >= first"


@query(
    f"""with items_ as (select {_sql(_ITEM, '//')}, {sample('l_partkey', TEXTS)} as text from lineitem), sized as (select *, cast(5 * length(text) as double) as width from items_),
    regions_ as (select page, case when page % 4 = 0 then 'Scale' end as title, {_sql(_BOX, '//')} from (select distinct page from items_)),
    lines_ as (select page, v as x0, 20.0 as y0, v as x1, 155.0 as y1 from regions_, (select unnest([5.0, 95.0, 185.0, 275.0, 365.0]) as v) where page % 3 = 0 union all select page, 5.0, v, 365.0, v from regions_, (select unnest([27.0, 43.0, 59.0, 75.0, 91.0, 107.0, 123.0, 139.0, 155.0]) as v) where page % 3 = 0),
    own as (select s.*, title, regexp_matches(trim(text), '^[0-9\\s—\\-－]+$') and length(regexp_replace(text, '[^0-9]', '', 'g')) between 1 and 4 and regexp_matches(trim(text), '^[—\\-－]|[—\\-－]$') as mark from sized s join regions_ r using (page) where s.x between r.x0 - 2 and r.x1 + 2 and s.y between r.y0 - 2 and r.y1 + 2),
    marked as (select page, bool_or(mark) as marked from own group by page), kept as (select * from own where not mark), {_fold_rows('kept')},
    named as (select n.*, title, trim(string_agg(text, ' ') over (partition by page, row order by x, y, seq rows between unbounded preceding and unbounded following)) as line from numbered n join regions_ using (page)),
    {_PARTS.replace('from numbered', "from named where title is null or line <> title")},
    cols as (select page, {_centres('xs', 'tolerance', 2)} as columns from (select page, list(x order by x) as xs, greatest(avg(height) * 0.75, 6) as tolerance from parts group by page)),
    placed as (select p.*, columns, list_transform(columns, lambda c: abs(x - c)) as away from parts p join cols using (page)), put as (select *, case when list_min(away) <= 24 then list_position(away, list_min(away)) end as col from placed),
    cells as (select page, row, col, any_value(columns) as columns, {_joined('list(text order by segment)')} as text from put group by page, row, col),
    grid_rows as (select page, row, greatest(len(any_value(columns)), 1) as n, coalesce(list(col order by col) filter (col is not null), []) as cs, coalesce(list(text order by col) filter (col is not null), []) as ts from cells group by page, row),
    grids_ as (select page, list(list_transform(range(1, n + 1), lambda i: coalesce(ts[list_position(cs, i)], '')) order by row) as rows_ from grid_rows group by page), merged as (select page, {_MERGED} as m from grids_),
    texts as (select page, len(list_filter(range(2, len(m) + 1), lambda i: len(list_filter(range(1, len(m[i]) + 1), lambda j: m[i][j] = '' and m[i - 1][j] <> '')) > 0)) > 0 as spanned, list_filter(m, lambda r: len(list_filter(r, lambda c: c <> '')) > 0) as t from merged),
    {_bounds_sql('lines_', 'regions_')},
    asked as (select k.*, xs, ys, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '') as tokens, {_interval('(y + height / 2)', 'ys')} as r, {_interval('(x + 1)', 'xs')} as first, {_interval('(x + width - 1)', 'xs')} as last, {_interval('(x + width / 2)', 'xs')} as mid from kept k join cut using (page) where title is null or trim(text) <> trim(title)),
    dealt as (select page, seq, r, unnest(case when {_MARKED} then list_transform(tokens, lambda t, i: {{'i': i - 1, 'piece': t, 'c': first + case when len(tokens) = last - first + 1 then i - 1 else least(last - first, cast(floor((i - 1) * (last - first) / (len(tokens) - 1) + 0.5) as bigint)) end}}) else [{{'i': 0, 'piece': text, 'c': mid}}] end) as p from asked),
    boxes as (select page, r, p.c as c, {_joined('list(p.piece order by seq, p.i, p.piece)')} as text from dealt where r > 0 and p.c > 0 group by all), filled as (select page, list(r * 1000 + c) as ks, list(text) as ts from boxes group by page),
    drawn as (select page, list_transform(range(1, len(ys)), lambda r: list_transform(range(1, len(xs)), lambda c: coalesce(ts[list_position(ks, r * 1000 + c)], ''))) as d from filled join cut using (page)),
    both_ as (select page, marked, coalesce(spanned, false) as spanned, coalesce(t, []) as t, coalesce(d, []) as d from marked left join texts using (page) left join drawn using (page)), {_trimmed('tt', 'both_', 't')}, {_trimmed('dd', 'tt', 'd')},
    stats as (select *, {_STATS.format(g='d', u=_used('d'), p='a')}, {_STATS.format(g='t', u=_used('t'), p='b')} from dd), judged as (select *, ac >= bc + 2 or (an >= bn * 1.4 and ac >= bc) as finer from stats),
    skips as (select *, an > 0 and bn > 0 and not finer and af + 0.12 < bf and ac <= bc + 1 as skipped from judged), chosen as (select *, case when an = 0 then 'text' when bn = 0 or finer then 'lines' when skipped or ac < bc then 'text' else 'lines' end as source from skips)
    select page, source, array_to_string(list_transform(case when source = 'lines' then d else t end, lambda r: array_to_string(r, '|')), '//') as grid,
      concat_ws(',', case when source = 'lines' then 'line_grid' end, case when marked then 'page_footer_removed' end, case when source = 'text' and spanned then 'rowspan_filled' end, case when skipped then 'line_grid_skipped' end) as warnings from chosen where len(case when source = 'lines' then d else t end) > 0"""
)
def item_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of each page out of its positioned texts and, on some pages, lines."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"cast({v.format(div='div')} as {'bigint' if k in ('page', 'seq') else 'double'}) as {k}" for k, v in _ITEM.items()], f"{sample('l_partkey', TEXTS)} as text").withColumnRenamed("seq", "at")
    items = rows.withColumn("width", (5 * F.length("text")).cast("double"))
    regions = items.select("page").distinct().selectExpr("page", "0 as region", "case when page % 4 = 0 then 'Scale' end as title", *[f"cast({v} as double) as {k}" for k, v in _BOX.items()])
    drawn = regions.where("page % 3 = 0").select("page")
    down = drawn.select("page", F.explode(F.array(*[F.lit(v) for v in (5.0, 95.0, 185.0, 275.0, 365.0)])).alias("x0")).select("page", "x0", F.lit(20.0).alias("y0"), F.col("x0").alias("x1"), F.lit(155.0).alias("y1"))
    across = drawn.select("page", F.explode(F.array(*[F.lit(27.0 + 16 * i) for i in range(9)])).alias("y0")).select("page", F.lit(5.0).alias("x0"), "y0", F.lit(365.0).alias("x1"), F.col("y0").alias("y1"))
    found = coordinates.table_grids(regions, items, down.unionByName(across), ["page"])
    return found.select("page", "source", F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "//").alias("grid"), F.array_join("warnings", ",").alias("warnings"))


_FLAGS = {"tabular": "l_partkey % 3 > 0", "title": "l_suppkey % 11 = 0", "goes_on": "l_quantity > 10"}


def _reach_sql(first: str, order: str, step: int, sparse: int) -> str:
    state = "{{'o': false, 'gap': 0, 'e': {x}}}".format
    near = "coalesce(rows_[x.e + 2].t, false)" if step > 0 else "(x.e > 0 and rows_[greatest(x.e, 1)].t)"
    return f"""list_reduce(list_prepend({state(x=first)}, list_transform({order}, lambda i: {state(x='i')})), lambda s, x: case when not s.o and not rows_[x.e + 1].h and (rows_[x.e + 1].t or (s.gap < {sparse} and ({near} or rows_[x.e + 1].g)))
      then {{'o': false, 'gap': case when rows_[x.e + 1].t then 0 else s.gap + 1 end, 'e': x.e + {step}}} else {{'o': true, 'gap': s.gap, 'e': s.e}} end).e"""


_COUNT = "len(list_filter(range(first, e), lambda i: rows_[i + 1].t))"
_ALONE = """list_reduce(list_prepend({'first': -1, 'gap': 0, 'i': -1, 'spans': []::struct(f bigint, e bigint)[]}, list_transform(range(0, n), lambda i: {'first': -1, 'gap': 0, 'i': i, 'spans': []::struct(f bigint, e bigint)[]})), lambda s, x:
      case when s.first >= 0 and (rows_[x.i + 1].t or (s.gap < 3 and (coalesce(rows_[x.i + 2].t, false) or rows_[x.i + 1].g))) then {'first': s.first, 'gap': case when rows_[x.i + 1].t then 0 else s.gap + 1 end, 'i': x.i, 'spans': s.spans}
      when s.first >= 0 then {'first': -1, 'gap': 0, 'i': x.i, 'spans': list_append(s.spans, {'f': s.first, 'e': x.i})} when rows_[x.i + 1].t and not list_contains(used, x.i) then {'first': x.i, 'gap': 0, 'i': x.i, 'spans': s.spans} else {'first': -1, 'gap': 0, 'i': x.i, 'spans': s.spans} end)"""


@query(
    f"""with p as (select l_orderkey // 8 as page, {', '.join(f'{v} as {k}' for k, v in _FLAGS.items())}, row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as row from lineitem),
    r as (select page, count(*) as n, list({{'t': tabular, 'h': title, 'g': goes_on}} order by row) as rows_, list(row order by row) filter (row % 5 = 2) as used from p group by page),
    t as (select *, unnest(range(0, n)) as t from r), titles as (select * from t where rows_[t + 1].h),
    down as (select *, list_min(list_filter(range(t + 1, least(t + 8, n)), lambda i: rows_[i + 1].t)) as first from titles), ends as (select page, rows_, t, first, {_reach_sql('first + 1', 'range(first + 1, n)', 1, 3)} as e from down where first is not null),
    up as (select *, coalesce(list_max(list_filter(range(greatest(t - 5, 0), t), lambda i: rows_[i + 1].t)) + 1, greatest(t - 4, 0)) as e from titles), starts as (select page, rows_, t, {_reach_sql('e - 1', 'list_reverse(range(0, e))', -1, 2)} + 1 as first, e from up),
    a as (select page, n, rows_, {_ALONE} as s from r), alone as (select page, rows_, unnest(case when s.first >= 0 then list_append(s.spans, {{'f': s.first, 'e': n}}) else s.spans end) as x from a), spans as (select page, rows_, x.f as first, x.e as e from alone)
    select page, 'below' as kind, t as title_row, first, e as behind from ends where {_COUNT} >= 2 union all select page, 'above', t, first, e from starts where {_COUNT} >= 2 union all select page, 'alone', null, first, e from spans where {_COUNT} >= 3"""
)
def region_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables below and above titles, and elsewhere: spans that a few sparse rows don't end."""
    from pyspark.sql import Window

    order = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("page", F.expr("l_orderkey div 8")).withColumns({k: F.expr(v) for k, v in _FLAGS.items()}).withColumn("row", F.row_number().over(order) - 1)
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row", "tabular", "title", "goes_on"))).alias("rows"), F.array_compact(F.collect_list(F.when(F.col("row") % 5 == 2, F.col("row")))).alias("used"))
    titled = coordinates.titled_spans(pages, ["page"]).withColumn("kind", F.when(F.col("below"), "below").otherwise("above"))
    alone = coordinates.untitled_spans(pages, ["page"]).withColumn("kind", F.lit("alone")).withColumn("title_row", F.lit(None).cast("int"))
    found = titled.drop("below").unionByName(alone)
    return found.select("page", "kind", F.col("title_row").cast("long").alias("title_row"), F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("behind"))


GLYPHS = ["规", "a", "1", "，", "（", "%", "B", "", "米", "7", "c"]
_GLYPH = {"x0": "l_partkey % 190", "y0": "9 * (l_suppkey % 19) + l_quantity / 25", "x1": "l_partkey % 190 + 3 + l_linenumber % 4", "y1": "9 * (l_suppkey % 19) + l_quantity / 25 + 7 + l_linenumber % 3"}
_CELLS = {"x0": "48 * (cell % 4)", "y0": "60 * (cell {div} 4)", "x1": "48 * (cell % 4) + 46 + page % 4", "y1": "60 * (cell {div} 4) + 58 + page % 3"}


@query(
    f"""with g as (select l_orderkey // 32 as page, {_sql(_GLYPH, '//')}, {sample('l_partkey // 3', GLYPHS)} as text from lineitem), c as (select page, cell, {_sql(_CELLS, '//')} from (select distinct page, unnest(range(0, 12)) as cell from g)),
    held as (select g.page, cell, g.x0, g.y0, g.x1, g.y1, text from g join c on g.page = c.page and (g.x0 + g.x1) / 2 between c.x0 - 0.8 and c.x1 + 0.8 and (g.y0 + g.y1) / 2 between c.y0 - 0.8 and c.y1 + 0.8),
    w as (select page, cell, greatest(avg(greatest(y1 - y0, 0.1)) * 0.92, 6) as tolerance, list({{'y0': y0, 'x0': x0, 'x1': x1, 'text': text}} order by y0, x0, x1, text) as gs from held group by page, cell),
    f as (select page, cell, gs, list_reduce(list_prepend({{'line': -1, 'top': 0.0::double, 'out': []::integer[]}}, list_transform(gs, lambda i: {{'line': -1, 'top': i.y0, 'out': []::integer[]}})), lambda s, i:
      case when s.line >= 0 and abs(i.top - s.top) <= tolerance then {{'line': s.line, 'top': s.top, 'out': list_append(s.out, s.line)}} else {{'line': s.line + 1, 'top': i.top, 'out': list_append(s.out, s.line + 1)}} end).out as ls from w),
    u as (select page, cell, unnest(gs) as g, unnest(ls) as line from f), z as (select page, cell, line, g.x0 as x0, g.y0 as y0, g.x1 as x1, g.text as text, avg(greatest(g.x1 - g.x0, 0.1)) over (partition by page, cell, line) as width from u),
    p as (select *, lag(x1) over o as e, right(lag(text) over o, 1) as b, left(text, 1) as a from z where text <> '' window o as (partition by page, cell, line order by x0, y0, text)),
    q as (select *, case when e is not null and x0 - e > greatest(width * 0.55, 2.2) and not contains('{coordinates.NO_BLANK_BEFORE}', a) and not contains('{coordinates.NO_BLANK_AFTER}', b) and not regexp_matches(a, '[一-鿿]') and not regexp_matches(b, '[一-鿿]') and not (regexp_matches(b, '[0-9]') and a in ('%', '％')) then concat(' ', text) else text end as piece from p),
    l as (select page, cell, line, trim(string_agg(piece, '' order by x0, y0, text)) as text from q group by page, cell, line) select page, cell, count(*) as n_lines, string_agg(text, '//' order by line) as lines from l group by page, cell"""
)
def cell_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of cells out of single glyphs, by lines."""
    glyphs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 32 as page", *[f"cast({v} as double) as {k}" for k, v in _GLYPH.items()], f"{sample('l_partkey div 3', GLYPHS)} as text")
    cells = glyphs.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("cell")).selectExpr("page", "cell", *[f"cast({v.format(div='div')} as double) as {k}" for k, v in _CELLS.items()])
    found = coordinates.cell_texts(glyphs, cells, ["page"])
    return found.select("page", F.col("cell").cast("long").alias("cell"), F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "//").alias("lines"))
