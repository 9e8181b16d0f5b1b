"""Queries of evaluation, document rules, blocks and page geometry; keys of the tables choose texts as in ``regulations``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import rules as R
from folioforge.functions import vectors as V
from folioforge.operators import access, answers, documents, evaluation, gates, tables
from folioforge.plans.common import ORDERED, register, sample, table
from folioforge.plans.regulations import _KEY

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

FILES = ["停车配建指标.pdf", "甲市标准.pdf", "制度汇编.docx", "乙导则.md"]
TARGETS = ["停车标准", "《甲市标准》", "—", "", "丙", "乙导则"]
STANDARDS = ["—", "停车位每100平方米配建1个", "容积率2.5", "", "A1用地规模"]
REPLIES = ["停车位每100平方米配建1个，容积率2.5", "无", "用地规模为3公顷，禁用9", "A1"]
_ITEMS = f"""select o_orderkey as item_id, o_orderstatus = 'F' and o_orderkey % 3 = 0 as should_refuse, o_orderkey % 7 <> 0 as answered, {sample('o_orderkey', REPLIES)} as answer, {sample('o_orderkey + 1', TARGETS)} as file,
    case when o_orderkey % 5 = 0 then concat('第', cast(o_orderkey % 4 as string), '条') else '—' end as article, case when o_orderkey % 3 = 0 then cast(o_orderkey % 9 as string) when o_orderkey % 3 = 1 then '' else '—' end as page, {sample('o_orderkey + 2', STANDARDS)} as standard_answer, o_orderkey % 11 as rest, o_orderpriority from orders"""
_HITS = f"select l_orderkey as item_id, {sample('l_partkey', FILES)} as file_name, concat('第', cast(l_partkey % 4 as string), '条') as article_no, l_linenumber as page_number, {sample('l_suppkey', REPLIES)} as text, l_returnflag = 'N' as cited from lineitem"
_TOKENS = "case when {s} <> '—' then list_concat(regexp_extract_all({s}, '[0-9]+(?:\\.[0-9]+)?'), list_transform(regexp_extract_all({s}, '[A-Za-z][0-9]{{1,2}}'), lambda x: upper(x)), flatten(list_transform(regexp_extract_all({s}, '[一-龥]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))) else [] end"
_OVER = "(len(tokens) > 0 and len(list_filter(tokens, lambda t: contains({x}, t))) >= 0.5 * len(tokens))"
_FITS = (
    "own <> '' and ((target <> '' and (contains(own, target) or contains(target, own))) or (length(title) >= 4 and contains(own, title)) or " + " or ".join(f"(regexp_matches(file, '{p}') and regexp_matches(file_name, '{k}'))" for p, k in R.FILE_ALIASES) + ")"
)
_JUDGED = f"""i0 as (select *, {_TOKENS.format(s='standard_answer')} as t0, case when rest < 3 then ['1'] when rest < 6 then ['2.5', '3'] else [] end as expected, ['9'] as forbidden from ({_ITEMS})), i as (select *, {ORDERED.format(x='t0')} as tokens from i0),
    h as (select h.*, i.file, i.article, i.page, i.tokens, {_KEY.format(x='h.file_name')} as own, {_KEY.format(x='i.file')} as target, {_KEY.format(x="regexp_extract(i.file, '《([^》]+)》', 1)")} as title from ({_HITS}) h join i using (item_id)),
    m as (select item_id, bool_or(hit) as hit, bool_or(hit and cited) as ok from (select *, ({_FITS}) and ((article not in ('', '—') and article_no = article) or (page not in ('', '—') and abs(page_number - try_cast(page as double)) <= 1) or {_OVER.format(x='text')} or (article in ('', '—') and page in ('', '—'))) as hit from h) group by item_id),
    j as (select i.*, file not in ('', '—') as aimed, case when file not in ('', '—') then coalesce(hit, false) end as in_top, case when not should_refuse and answered and file not in ('', '—') then coalesce(ok, false) end as citation_correct, case when should_refuse then not answered end as refused_correctly,
      list_filter(expected, lambda v: not contains(answer, v)) as missing, list_filter(forbidden, lambda v: contains(answer, v)) as wrong from i left join m using (item_id)),
    g as (select *, len(expected) > 0 and (len(missing) > 0 or len(wrong) > 0) as failed from j),
    judged as (select *, case when should_refuse then case when answered then 0 else 2 end when not answered or failed then 0 when aimed then case when citation_correct then 2 else 1 end when {_OVER.format(x='answer')} then 2 else 1 end as score,
      case when should_refuse then case when answered then '应拒答却作答' else '' end when not answered then '召回不足 / 误拒答' when failed then concat_ws('；', case when len(missing) > 0 then '缺少数值：' || array_to_string(missing, '、') end, case when len(wrong) > 0 then '出现禁用值：' || array_to_string(wrong, '、') end)
      when aimed then case when citation_correct then '' else '引用未命中标准条文' end when {_OVER.format(x='answer')} then '' when len(tokens) > 0 then '回答与标准答案重叠不足' else '缺少标注（标准答案/正确文件），无法自动核对' end as error from g)"""


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "lineitem")
    lists = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    items = spark.sql(_ITEMS).withColumn("expected", F.when(F.col("rest") < 3, lists("1")).when(F.col("rest") < 6, lists("2.5", "3")).otherwise(lists())).withColumn("forbidden", lists("9"))
    return evaluation.judged_items(items, spark.sql(_HITS))


@query(f"with {_JUDGED} select item_id, in_top, citation_correct, refused_correctly, score, error from judged")
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question bank judged in one plan: targets, citations, refusals, value assertions and overlap."""
    return _judged(spark, sf_dir).select("item_id", "in_top", "citation_correct", "refused_correctly", "score", "error")


@query(f"with {_JUDGED} select o_orderpriority, count(*) as total, count(*) filter (in_top) as in_top, count(*) filter (citation_correct) as citations, count(*) filter (refused_correctly) as refusals, round(avg(score), 2) as mean_score from judged group by o_orderpriority")
def evaluation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.statistics(_judged(spark, sf_dir), "o_orderpriority")


@query(f"with {_JUDGED} select error as reason, count(*) as n from judged where error <> '' group by error order by n desc, reason limit 5")
def evaluation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent reasons for lost points."""
    return evaluation.most_frequent(_judged(spark, sf_dir), "error")


OBJECTS = ["A{n}", "幼儿园", "容积率", "R2", "停车位 {n}", "绿地 率"]
TYPES = ["classification_code", "indicator_item", "definition", "requirement"]
_GOLDEN = "(values (1, ['幼儿园'], ['indicator_item']), (2, ['A1用地'], ['classification_code']), (3, ['绿地率不低于'], ['definition', 'plain']), (4, ['没有'], ['x']), (5, ['停车位'], ['clause'])) q(question_id, keywords, expected)"


@query(
    f"""with o as (select p_partkey as seq, {sample('p_size + p_partkey', TYPES)} as object_type, lower(regexp_replace({sample('p_partkey', OBJECTS)}, '\\s+', '', 'g')) as key from part),
    f as (select question_id, seq, object_type, row_number() over (partition by question_id order by seq) as r from o join {_GOLDEN} on len(list_filter(keywords, lambda w: contains(key, lower(w)) or contains(lower(w), key))) > 0), t as (select question_id, string_agg(object_type, ',' order by r) as kinds, list(object_type) as l from f where r <= 5 group by all)
    select q.question_id, coalesce(kinds, '') as kinds, coalesce(len(list_intersect(l, expected)) > 0, false) as hit from {_GOLDEN} left join t using (question_id)"""
)
def golden_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions against the objects of the table by exact keys."""
    rows = [(1, ["幼儿园"], ["indicator_item"]), (2, ["A1用地"], ["classification_code"]), (3, ["绿地率不低于"], ["definition", "plain"]), (4, ["没有"], ["x"]), (5, ["停车位"], ["clause"])]
    questions = spark.createDataFrame(rows, "question_id int, keywords array<string>, expected array<string>")
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.expr(sample("p_size + p_partkey", TYPES)).alias("object_type"), F.expr(sample("p_partkey", OBJECTS)).alias("key"))
    return evaluation.golden_objects(questions, objects).select("question_id", F.array_join("kinds", ",").alias("kinds"), "hit")


_VALUES = "(values (1, ['停车', '100'], ['1个', '2个'], ['9']), (2, ['用地'], ['3公顷'], ['禁用9']), (3, ['没有'], ['1'], [])) q(question_id, keywords, vals, forbidden)"


@query(
    f"""with o as (select p_partkey, {sample('p_size + p_partkey', TYPES)} as object_type, {sample('p_partkey', REPLIES)} as text from part), f as (select question_id, vals, forbidden, text from o join {_VALUES} on object_type in ('indicator_item', 'requirement') and len(list_filter(keywords, lambda w: not contains(text, w))) = 0),
    s as (select question_id, count(*) as matches, list_distinct(flatten(list(list_filter(vals, lambda v: contains(text, v))))) as have, list_distinct(flatten(list(list_filter(forbidden, lambda v: contains(text, v))))) as wrong from f group by all)
    select q.question_id, coalesce(matches, 0) as matches, array_to_string(list_sort(list_filter(vals, lambda v: not list_contains(coalesce(have, []), v))), ',') as missing, array_to_string(list_sort(coalesce(wrong, [])), ',') as forbidden,
    len(list_filter(vals, lambda v: not list_contains(coalesce(have, []), v))) = 0 and len(coalesce(wrong, [])) = 0 as pass from {_VALUES} left join s using (question_id)"""
)
def golden_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions for numbers: which values the matching objects hold."""
    kinds = ["indicator_item", "requirement"]
    rows = [(1, ["停车", "100"], kinds, ["1个", "2个"], ["9"]), (2, ["用地"], kinds, ["3公顷"], ["禁用9"]), (3, ["没有"], kinds, ["1"], [])]
    questions = spark.createDataFrame(rows, "question_id int, keywords array<string>, expected array<string>, values array<string>, forbidden array<string>")
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.expr(sample("p_size + p_partkey", TYPES)).alias("object_type"), F.expr(sample("p_partkey", REPLIES)).alias("text"))
    found = evaluation.golden_values(questions, objects)
    return found.select("question_id", "matches", F.array_join("missing", ",").alias("missing"), F.array_join("forbidden", ",").alias("forbidden"), "pass")


KINDS_OF_FILES = ["规划法规", " FAQ ", "未知类型", "停车标准", ""]
DATES = ["2023-06-01", "2023/06/01", "", "2023-6-1"]


@query(
    f"""select p_partkey, case when trim(ft) in ({', '.join(f"'{t}'" for t in documents.FILE_TYPES)}) then trim(ft) else '其他' end as kept_type, case when p_size % 5 in (2, 3) then p_size % 5 else 1 end as kept_level, case when regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then d end as kept_date,
    case when p_partkey % 3 = 0 then concat('u', p_size) end as owner_id from (select *, {sample('p_partkey', KINDS_OF_FILES)} as ft, {sample('p_partkey + p_size', DATES)} as d from part)"""
)
def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(sample("p_partkey", KINDS_OF_FILES)).alias("file_type"), (F.col("p_size") % 5).alias("permission_level"), F.expr(sample("p_partkey + p_size", DATES)).alias("effective_date"),
        F.when(F.col("p_partkey") % 3 == 0, "manager").otherwise("admin").alias("role"), F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("user_id"),
    )
    return documents.uploaded(rows).select("p_partkey", "kept_type", "kept_level", "kept_date", "owner_id")


@query(
    """with p as (select p_partkey, case when p_partkey % 3 = 0 then ['u1', 'x', 'u2'] when p_partkey % 3 = 1 then [] end as patch_ids, case when p_size % 2 = 0 then ['u3'] end as ids, case p_size % 4 when 0 then '' when 1 then 'u2' when 2 then 'nobody' end as patch_owner, case when p_partkey % 5 > 0 then 'u4' end as owner_id from part),
    c as (select *, case when patch_ids is not null then list_filter(patch_ids, lambda i: i in ('u1', 'u2', 'u3', 'u4')) else ids end as chosen, nullif(case when patch_owner = '' or patch_owner in ('u1', 'u2', 'u3', 'u4') then patch_owner else owner_id end, '') as owner from p)
    select p_partkey, case when owner is null then array_to_string(chosen, ',') when list_contains(coalesce(chosen, []), owner) then array_to_string(chosen, ',') else array_to_string(list_append(coalesce(chosen, []), owner), ',') end as access from c"""
)
def access_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access lists after patches: unknown users left out, the owner always in."""
    key, size = F.col("p_partkey"), F.col("p_size")
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 3 == 0, texts("u1", "x", "u2")).when(key % 3 == 1, texts()).alias("patch_ids"), F.when(size % 2 == 0, texts("u3")).alias("ids"),
        F.when(size % 4 == 0, "").when(size % 4 == 1, "u2").when(size % 4 == 2, "nobody").alias("patch_owner"), F.when(key % 5 > 0, "u4").alias("owner_id"),
    )
    return rows.select("p_partkey", F.array_join(documents.patched_access(["u1", "u2", "u3", "u4"]), ",").alias("access"))


@query("select 'documents' as kind, count(*) as n from documents where doc_id not in (select doc_id from labels where toxic = 1) union all select 'labels', count(*) from labels where doc_id not in (select doc_id from labels where toxic = 1)")
def removed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deleted with all that hangs on them."""
    labels = table(spark, sf_dir, "labels")
    kept = documents.removed(table(spark, sf_dir, "documents").select("doc_id"), labels.where("toxic = 1"), labels)
    counts = [df.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, df in zip(("documents", "labels"), kept, strict=True)]
    return counts[0].unionByName(counts[1])


OBJECT_KINDS = [*documents.CHUNK_TYPES, "plain_section", "reference_basis"]


@query(
    f"""select p_partkey, case o {' '.join(f"when '{k}' then '{v}'" for k, v in documents.CHUNK_TYPES.items())} else 'section' end as chunk_type, case when o = 'plain_section' then 'fallback' when o = 'structured_table' then 'parent' else 'atomic' end as chunk_role,
    case p_size % 3 when 0 then 2 else 5 end as pages from (select *, {sample('p_partkey', OBJECT_KINDS)} as o from part)"""
)
def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and role of a record's chunk, and how many pages of the service a role sees."""
    role = F.when(F.col("p_size") % 3 == 0, "employee").when(F.col("p_size") % 3 == 1, "admin").otherwise("developer")
    seen = sum((F.when(documents.sees_page(role, F.lit(kind)), 1).otherwise(0) for _, kind in documents.PAGES), F.lit(0))
    kind = F.expr(sample("p_partkey", OBJECT_KINDS))
    return table(spark, sf_dir, "part").select("p_partkey", documents.chunk_type(kind).alias("chunk_type"), documents.chunk_role(kind).alias("chunk_role"), seen.alias("pages"))


@query(
    f"""with h as (select o_custkey as q, o_orderkey as rank, o_orderkey % 300 as doc_id, concat('hit', o_orderkey % 7) as file_name, o_orderstatus <> 'F' as ok from orders), n as (select h.*, coalesce(d.source, file_name) as name from h left join (select doc_id, source from documents where doc_id < 250) d using (doc_id)),
    f as (select q, ok, name, min(rank) as rank, count(*) as n from n group by all), s as (select q, coalesce(sum(n) filter (ok), 0)::bigint as a, coalesce(sum(n) filter (not ok), 0)::bigint as d, coalesce(string_agg(name, ',' order by rank) filter (ok), '') as an, coalesce(string_agg(name, ',' order by rank) filter (not ok), '') as dn from f group by q)
    select q, a as accessible_hits, d as denied_hits, an as accessible_documents, dn as denied_documents, case when d > 0 and a = 0 then '{documents.RISKS[0]}' when d > 0 then '{documents.RISKS[1]}' when a = 0 then '{documents.RISKS[2]}' else '{documents.RISKS[3]}' end as risk from s"""
)
def search_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search hit on both sides of the access rules, by document name."""
    key = F.col("o_orderkey")
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), key.alias("rank"), (key % 300).alias("doc_id"), F.concat(F.lit("hit"), (key % 7).cast("string")).alias("file_name"), (F.col("o_orderstatus") != "F").alias("accessible"))
    names = table(spark, sf_dir, "documents").where("doc_id < 250").select("doc_id", F.col("source").alias("file_name"))
    found = documents.search_summary(hits, names, "q")
    return found.withColumn("accessible_documents", F.array_join("accessible_documents", ",")).withColumn("denied_documents", F.array_join("denied_documents", ","))


CITIES = ["北京市", "上海", "通用", "", "未知", "北京"]


@query(
    f"""with d as (select p_partkey, {sample('p_partkey', CITIES)} as city, {sample('p_partkey + p_size', CITIES)} as asked, p_size % 4 > 0 as enabled, case when p_size % 3 > 0 then 'indexed' else 'pending' end as status, {sample('p_partkey', KINDS_OF_FILES)} as ft from part),
    c as (select *, regexp_replace(trim(city), '市$', '') as a, regexp_replace(trim(asked), '市$', '') as b from d)
    select p_partkey, (a in ('', '未知', '通用', '全国', '不限') or b in ('', '未知', '通用', '全国', '不限') or a = b) as city_fits, enabled and status = 'indexed' and (a in ('', '未知', '通用', '全国', '不限') or b in ('', '未知', '通用', '全国', '不限') or a = b) as searchable,
    case ft when '规划法规' then '规划法规' when '停车标准' then '技术标准' else '其他' end as category, concat(p_partkey, ' · ', status) as label from c"""
)
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a question may search, their category and label."""
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(sample("p_partkey", CITIES)).alias("city"), F.expr(sample("p_partkey + p_size", CITIES)).alias("asked"), (F.col("p_size") % 4 > 0).alias("enabled"),
        F.when(F.col("p_size") % 3 > 0, "indexed").otherwise("pending").alias("status"), F.expr(sample("p_partkey", KINDS_OF_FILES)).alias("ft"),
    )
    return rows.select(
        "p_partkey", access.city_fits(F.col("city"), F.col("asked")).alias("city_fits"), access.searchable(F.col("city"), F.col("asked")).alias("searchable"), B.category(F.col("ft")).alias("category"), B.label(F.col("p_partkey").cast("string"), F.col("status")).alias("label")
    )


@query("select o_orderkey, u.role, coalesce(u.role in ('admin', 'manager'), false) as known from (select o_orderkey, concat('u', o_custkey % 5) as user_id from orders) left join (values ('u1', 'admin'), ('u2', 'manager'), ('u3', 'employee')) u(id, role) on user_id = id")
def resolved_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by id; unknown ones have no role, so every rule denies them."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")).alias("user_id"))
    users = spark.createDataFrame([("u1", "admin"), ("u2", "manager"), ("u3", "employee")], "id string, role string")
    return access.resolved_users(asked, F.broadcast(users)).select("o_orderkey", "role", F.coalesce(F.col("role").isin("admin", "manager"), F.lit(False)).alias("known"))


@query(
    """select l_orderkey, l_linenumber, l_quantity, case when l_discount >= 0.07 then '高' when l_discount >= 0.04 then '中' else '低' end as relevance, case when l_linenumber % 3 = 0 then '' else array_to_string(range(l_linenumber, greatest(l_linenumber, cast(l_quantity / 10 as int)) + 1), ',') end as pages,
    not (l_returnflag = 'R' or l_linestatus = 'F') and l_linenumber % 5 > 0 as clean, concat('| ', replace(concat(l_returnflag, '|', l_linestatus), '|', '\\|'), ' |  |') as markdown from lineitem""".replace("l_discount >= 0.07", "l_discount * 5 >= 0.45").replace("l_discount >= 0.04", "l_discount * 5 >= 0.25").replace("cast(l_quantity / 10 as int)", "cast(floor(l_quantity / 10) as int)")
)
def hit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of relevance, spans of pages, clean citations and rows as Markdown."""
    line = F.col("l_linenumber")
    pages = B.page_span(F.when(line % 3 > 0, line), F.floor(F.col("l_quantity") / 10).cast("int"))
    warnings = F.when(line % 5 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    clean = B.is_clean(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "source_page"), warnings)
    cells = F.array(F.concat("l_returnflag", F.lit("|"), "l_linestatus"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", B.relevance(F.col("l_discount") * 5).alias("relevance"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), clean.alias("clean"), B.markdown_row(cells).alias("markdown")
    )


@query(
    """with g as (select l_suppkey as q, count(*) filter (l_returnflag = 'R') as denied, count(*) filter (l_returnflag = 'A') as ok, coalesce(max(l_discount) filter (l_returnflag = 'R'), 0) as ds, coalesce(max(l_discount) filter (l_returnflag = 'A'), 0) as s from lineitem where l_linenumber = 7 or l_returnflag = 'N' group by all)
    select q, case when denied = 0 then false when ok = 0 then true else ds > 0.05 and (not s > 0.05 or ds > s) end as no_access, case when ok = 0 then 'no_results' when s < 0.1 and s < 0.1 then 'weak' when q % 2 = 0 and q % 4 > 0 then 'no_number' end as refusal from g"""
)
def answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question is refused for want of evidence or of access."""
    side = lambda f: F.col("l_returnflag") == f
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 7 or l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("q")).agg(
        F.count_if(side("R")).alias("denied"), F.count_if(side("A")).alias("ok"), F.coalesce(F.max(F.when(side("R"), F.col("l_discount"))), F.lit(0.0)).alias("ds"), F.coalesce(F.max(F.when(side("A"), F.col("l_discount"))), F.lit(0.0)).alias("s")
    )
    hidden = gates.no_access(F.col("denied"), F.col("ok"), F.col("ds") > 0.05, F.col("s") > 0.05, F.col("ds"), F.col("s"))
    return rows.select("q", hidden.alias("no_access"), gates.evidence_missing(F.col("ok"), F.col("s"), F.col("q") % 2 == 0, F.col("q") % 4 == 0).alias("refusal"))


@query(
    """with l as (select distinct l_suppkey as question_id, l_partkey as chunk_id, l_orderkey * 10 + l_linenumber as rank from lineitem), c as (select p_partkey as chunk_id, case when p_partkey % 4 > 0 then p_partkey - p_partkey % 4 end as parent, lag(p_partkey) over w as prev, lead(p_partkey) over w as next from part window w as (partition by p_size order by p_partkey)),
    e as (select question_id, rank, unnest([l.chunk_id, parent, prev, next]) as chunk_id, unnest([0, 1, 2, 3]) as way from l join c using (chunk_id)) select question_id, chunk_id, min(rank) as rank, arg_min(way, rank * 10 + way) as way from e where chunk_id is not null group by all"""
)
def expanded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their neighbours and parents."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_size").orderBy("p_partkey")
    key = F.col("p_partkey")
    chunks = table(spark, sf_dir, "part").select(key.alias("chunk_id"), F.when(key % 4 > 0, key - key % 4).alias("parent_chunk_id"), F.lag(key).over(w).alias("prev_chunk_id"), F.lead(key).over(w).alias("next_chunk_id"))
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return answers.expanded(hits, chunks)


@query("""with r as (select l_orderkey, l_linenumber, max(l_quantity) as q, min(l_returnflag) as f from lineitem group by all) select l_orderkey, l_linenumber, case when f = 'A' then 'summary' when f = 'R' then 'note' else 'data' end as row_type, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as row_number from r""")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    rows = rows.withColumn("key", F.when(F.col("f") == "A", "合计").when(F.col("f") == "R", "注：见表").otherwise("幼儿园"))
    return tables.numbered_rows(rows, ["l_orderkey"], "l_linenumber", "key").select("l_orderkey", "l_linenumber", "row_type", F.col("row_number").cast("long").alias("row_number"))


@query(
    """with r as (select l_orderkey, l_linenumber, case when min(l_returnflag) <> 'N' or l_linenumber = 1 then concat('A', l_linenumber) else '' end as code, concat('c', l_linenumber) as content from lineitem group by l_orderkey, l_linenumber),
    g as (select *, count(*) filter (code <> '') over (partition by l_orderkey order by l_linenumber) as run from r) select l_orderkey, max(code) as code, min(l_linenumber) as l_linenumber, string_agg(content, '' order by l_linenumber) as content from g group by l_orderkey, run"""
)
def continued_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a code go to the row before them."""
    line = F.col("l_linenumber").cast("string")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    rows = rows.select("l_orderkey", "l_linenumber", F.when((F.col("f") != "N") | (F.col("l_linenumber") == 1), F.concat(F.lit("A"), line)).otherwise("").alias("code"), F.concat(F.lit("c"), line).alias("content"))
    return tables.continued_rows(rows, ["l_orderkey"], "l_linenumber", "code", "content")


@query("with s as (select l_orderkey, l_linenumber, l_discount * 10 as support from lineitem), b as (select *, max(support) over (partition by l_orderkey) as best from s) select l_orderkey, l_linenumber, round(support, 6) as support from b where best >= 0.5 and support >= 0.6 * best")
def strong_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("support"))
    return tables.strong_slices(rows, "l_orderkey", "support").select("l_orderkey", "l_linenumber", F.round("support", 6).alias("support"))


@query(
    """with c as (select l_suppkey as doc_id, l_returnflag as table_id, l_orderkey * 10 + l_linenumber as chunk_id, case when l_quantity > 25 then l_linenumber end as src, concat('k', l_linenumber % 4, '-', l_orderkey) as row_key from lineitem), r as (select distinct l_suppkey as doc_id, l_returnflag as table_id, l_linenumber as row_index from lineitem where l_linenumber < 6),
    d as (select c.*, r.row_index as own from c left join r on c.doc_id = r.doc_id and c.table_id = r.table_id and c.src = r.row_index), k as (select d.doc_id, d.table_id, chunk_id, min(r.row_index) as by_key from d join r on d.doc_id = r.doc_id and d.table_id = r.table_id and contains(row_key, concat('k', r.row_index, '-')) where own is null group by all)
    select doc_id, table_id, chunk_id, coalesce(own, by_key) as row_index from d left join k using (doc_id, table_id, chunk_id)"""
)
def bound_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks bound to rows of their table, by their own row or by its key."""
    lines = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    chunks = lines.select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("table_id"), (F.col("l_orderkey") * 10 + line).alias("chunk_id"), F.when(F.col("l_quantity") > 25, line).alias("source_row_index"), F.concat(F.lit("k"), (line % 4).cast("string"), F.lit("-"), F.col("l_orderkey").cast("string")).alias("row_key"))
    rows = lines.where("l_linenumber < 6").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("table_id"), line.alias("row_index"), F.concat(F.lit("k"), line.cast("string"), F.lit("-")).alias("key")).distinct()
    return tables.bound_chunks(chunks, rows).select("doc_id", "table_id", "chunk_id", "row_index")


@query("select p_partkey, concat('table-', k) as object_id from (select p_partkey, lower(to_base(h, 36)) as k from (select p_partkey, list_reduce(list_prepend(2166136261, list_transform(string_split(concat(p_brand, '|', p_name), ''), lambda c: cast(ord(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as h from part))")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that follow from content: a hash in base 36."""
    return table(spark, sf_dir, "part").select("p_partkey", V.stable_id(F.lit("table"), F.col("p_brand"), F.col("p_name")).alias("object_id"))


@query(
    """with p as (select l_suppkey as page, l_quantity as x, l_tax * 100 as y from lineitem), b as (select distinct page, floor(x / 10) * 10 as x0, floor(x / 10) * 10 + 10 as x1 from p where x % 10 < 6), i as (select page, x0, x1, row_number() over (partition by page order by x0) - 1 as i from b)
    select p.page, x, y, count(*) as points, min(i) as cell from (select page, x, y, row_number() over (partition by page, x, y order by 1) as n from p) p left join i on p.page = i.page and x between x0 - 2 and x1 + 2 group by p.page, x, y, n""".replace("count(*) as points, min(i) as cell", "n, min(i) as cell")
)
def cell_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a page's intervals, two units wider at both ends, that holds a point: intervals are joined by page as one array."""
    from pyspark.sql import Window

    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    low = F.floor(F.col("x") / 10) * 10
    bounds = points.where("x % 10 < 6").select("page", low.cast("double").alias("x0")).distinct().groupBy("page").agg(F.array_sort(F.collect_list("x0")).alias("lows"))
    holds = F.array_position(F.transform("lows", lambda a: F.col("x").between(a - 2, a + 12)), True)
    numbered = points.withColumn("n", F.row_number().over(Window.partitionBy("page", "x", "y").orderBy(F.lit(1))).cast("long"))
    return numbered.join(bounds, "page", "left").select("page", "x", "y", "n", F.when(holds > 0, holds - 1).cast("long").alias("cell"))
