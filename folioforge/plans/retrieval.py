"""Queries over a stored inverted index: all questions of a table at once."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import questions as Q
from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.operators import retrieval, search
from folioforge.plans.common import register, sample, table
from folioforge.sources.tables import shared_table

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

ASKS = ["", "服务规模和用地面积是多少？", "需要提交哪些图纸和说明文件？", "居住用地代码是什么", "第12条的规定", "A{n}停车位配建标准不低于多少", "规划流程和步骤", "附表 3.2 的清单"]
TITLES = ["居住公共服务设施配置指标", "规划图纸成果要求", "用地分类代码表", "停车场配建标准 A{n}", "物业服务用房第12条", "notes {n}"]
ENDS = ["容积率不高于{n}%", "用地代码 A12，居住用地", "商业用地每处{n}平方米", "无", "R2 二类居住用地"]
TYPES = ["table_row", "indicator", "clause", "deliverable", "code", "section", "definition", "note", "other"]
OBJECTS = ["indicator_item", "drawing_requirement", "plain_section", "regulation_clause", "", "classification_code", "procedure_step", "checklist_item"]
ROLES, LEVELS, STATUSES = ["atomic", "summary", "fallback", "other"], ["must", "unknown", "", "should"], ["current", "superseded", "draft", "", "reference"]
KEYS = ["停车位", "A{n}", "居住用地代码", "图纸", "nothing"]
CITIES, ASKED_CITIES = ["en市", "fr", "de", "es市"], ["en", "fr市", "de", ""]


def _chunk_fields(div: str) -> dict[str, str]:
    """SQL of a chunk's columns for documents, in Spark and in DuckDB (div: whole division)."""
    return {
        "title": sample("doc_id", TITLES), "ending": sample("doc_id", ENDS), "chunk_type": sample("doc_id", TYPES), "object_type": f"nullif({sample(f'doc_id {div} 3', OBJECTS)}, '')", "role": sample(f"doc_id {div} 2", ROLES),
        "level": sample(f"doc_id {div} 5", LEVELS), "status": f"nullif({sample(f'doc_id {div} 7', STATUSES)}, '')", "one_key": sample(f"doc_id {div} 4", KEYS), "city": sample("doc_id", CITIES), "placed": "doc_id % 3 > 0",
        "days": "case when doc_id % 4 > 0 then doc_id * 37 % 9500 end",
    }


_HAN = "regexp_extract_all({x}, '[一-龥]')"
_NEXT = "list_transform(range(1, len({h})), lambda i: concat({h}[i], {h}[i + 1]))"


def _tokens(x: str) -> str:
    h = _HAN.format(x=x)
    return f"list_concat(regexp_extract_all(lower({x}), '{T.RUNS}'), list_transform(regexp_extract_all({x}, '{T.CODES}'), lambda c: upper(c)), regexp_extract_all({x}, '{T.DOTTED}'), regexp_extract_all({x}, '{T.ARTICLES}'), {h}, {_NEXT.format(h=h)})"


_RUN_PAIRS = "flatten(list_transform(regexp_extract_all(q, '[一-龥]+'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
_KEYWORDS = (
    f"list_concat(list_transform(regexp_extract_all(q, '[A-Za-z][0-9]{{1,2}}'), lambda x: upper(x)), list_transform(regexp_extract_all(q, '{Q.KEYWORD_NUMBER}'), lambda x: regexp_replace(x, '\\s+', '', 'g')), "
    f"regexp_extract_all(q, '{Q.ARTICLE}'), list_filter({Q.KEYWORD_TERMS}, lambda x: contains(q, x)), {_RUN_PAIRS})"
)
_BREAKERS = "|".join(sorted(Q.PHRASE_BREAKERS, key=len, reverse=True))
_PHRASES = (
    f"list_distinct(list_filter(list_concat(list_filter({Q.DOMAIN_TERMS}, lambda x: contains(q, x)), list_transform(regexp_extract_all(q, '[A-Za-z][0-9]{{1,3}}'), lambda x: upper(x)), regexp_extract_all(q, '{Q.ARTICLE}'), "
    f"regexp_extract_all(regexp_replace(q, '{_BREAKERS}', ' ', 'g'), '[一-龥]+')), lambda x: length(x) >= 2))"
)
_ASKS = {k: f"regexp_matches(trim(q), '{p}')" for k, p in Q.SIGNALS.items()}
_SIZE = f"case when {_ASKS['deliverable']} or {_ASKS['checklist']} or {_ASKS['attachment']} then 30 when {_ASKS['table_no']} then 20 when {_ASKS['indicator']} then 12 when {_ASKS['obligation']} or {_ASKS['configuration']} then 10 when {_ASKS['clause']} then 8 else 5 end"
def _uses(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{Q.LAND_USE}'), lambda u: upper(u))"


_COLUMNS = ", ".join(f"{sql} as {name}" for name, sql in _chunk_fields("//").items())
_NUMERIC = f"regexp_matches(content, '{Q.NUMBER_WITH_UNIT}')"


def _intent_sql() -> str:
    kind = "coalesce(object_type, '')"
    rules = [
        ("code", f"chunk_type = 'code' or {kind} = 'classification_code'", 1.0), ("definition", "chunk_type = 'definition'", 1.0), ("indicator", f"chunk_type = 'indicator' or {kind} = 'indicator_item'", 1.0),
        ("configuration", f"regexp_matches({kind}, 'indicator|requirement|structured_table_row')", 0.8), ("obligation", f"regexp_matches({kind}, 'requirement|regulation_clause')", 0.9),
        ("deliverable", f"{kind} in ('deliverable_requirement', 'drawing_requirement')", 1.0), ("drawing", f"{kind} = 'drawing_requirement'", 1.0), ("procedure", f"{kind} = 'procedure_step'", 1.0), ("checklist", f"{kind} = 'checklist_item'", 1.0),
        ("clause", "chunk_type = 'clause'", 0.9), ("numeric", _NUMERIC, 0.4), ("obligation", "level not in ('', 'unknown')", 0.4),
    ]
    return "least(1, " + " + ".join(f"case when {_ASKS[s]} and ({test}) then {worth} else 0 end" for s, test, worth in rules) + ")"


_STATUS = "case " + " ".join(f"when status = '{s}' then {w}" for s, w in V.STATUS_WORTH.items()) + " else 0.55 end"
_VERSION = f"case when status is null and days is null then 0.35 else least(1, {_STATUS} + coalesce(least(greatest(days / 36500.0, 0), 0.2), 0)) end"
_PRIORITY = "case " + " ".join(f"when chunk_type = '{t}' then {w}" for t, w in Q.TYPE_PRIORITY.items()) + " else 0.3 end"

_ROWS = f"""
    with raw as (select d.doc_id, case when quality = 1 then 'accessible' else 'denied' end as side, text, case when d.doc_id % 9 = 0 then cast(list_slice(embedding, 1, 32) as double[]) else cast(embedding as double[]) end as v, {_COLUMNS.replace('doc_id', 'd.doc_id')}
      from documents d join labels l on l.doc_id = d.doc_id left join embeddings e on e.vec_id = d.doc_id),
    chunks as (select *, concat(text, ' ', ending) as content, concat(title, ' ', text, ' ', ending) as hay from raw),
    questions as (select item_id, b.text, concat(b.text, ' ', {sample('item_id', ASKS)}) as q, nullif({sample('item_id // 2', ASKED_CITIES)}, '') as asked_city,
      case when item_id % 5 = 0 then null when item_id % 7 = 3 then cast(list_slice(embedding, 1, 32) as double[]) else cast(embedding as double[]) end as v from benchmark b left join embeddings e on e.vec_id = item_id),
    sized as (select *, {_SIZE} as k from questions)"""
_LEXICAL = f"""{_ROWS},
    tok as (select doc_id, side, {_tokens('hay')} as t from chunks), len as (select doc_id, side, t, len(t) as length from tok), stat as (select side, count(*) as n, avg(length) as mean from len group by side),
    tf as (select doc_id, side, length, term, count(*) as f from (select doc_id, side, length, unnest(t) as term from len) group by all), df as (select side, term, count(*) as df from tf group by all),
    asked as (select item_id, k, unnest(list_distinct(list_filter(list_concat({_tokens('q')}, {_KEYWORDS}), lambda x: x <> '' and not regexp_matches(x, '^[一-龥]$')))) as term from sized),
    lex as (select item_id, side, doc_id, any_value(k) as k, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / mean))), {retrieval.PLACES}) as s from asked join tf using (term) join df using (side, term) join stat using (side) group by item_id, side, doc_id)"""
_CHANNELS = f"""{_LEXICAL},
    words as (select item_id, side, doc_id, 1 as channel, s / max(s) over (partition by item_id, side) as score, row_number() over (partition by item_id, side order by s desc, doc_id) as rank, k from lex),
    sims as (select item_id, side, doc_id, 2 as channel, round(list_inner_product(c.v, z.v), {retrieval.PLACES}) as score, k from sized z join chunks c on len(c.v) = len(z.v)),
    vec as (select item_id, side, doc_id, channel, score, row_number() over (partition by item_id, side order by score desc, doc_id) as rank, k from sims),
    exact as (select item_id, side, doc_id, 0 as channel, 1.0 as score, row_number() over (partition by item_id, side order by doc_id) as rank, k from chunks c join sized z on contains(c.text, z.text)),
    found as (select * from words where rank <= {retrieval.DEPTH} * k union all select * from vec where rank <= {retrieval.DEPTH} * k union all select * from exact where rank <= {retrieval.DEPTH} * k)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.expr(f"concat(text, ' ', {sample('item_id', ASKS)})").alias("question"), F.expr(f"nullif({sample('item_id div 2', ASKED_CITIES)}, '')").alias("city"))
    key = F.col("question_id")
    return asked.join(vectors, "question_id", "left").withColumn("vector", F.when(key % 5 != 0, F.when(key % 7 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))).drop("embedding")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with access rules as chunks: all columns that retrieval reads."""
    rules = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "accessible").otherwise("denied").alias("side"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(rules, "doc_id").join(vectors, "doc_id", "left")
    rows = rows.withColumn("vector", F.when(F.col("doc_id") % 9 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector"))).withColumns({name: F.expr(sql) for name, sql in _chunk_fields("div").items()})
    content = F.concat_ws(" ", "text", "ending")
    return rows.select(
        F.col("doc_id").alias("key"), "side", "vector", "text", content.alias("content"), F.concat_ws(" ", "title", content).alias("hay"), "title", F.array("one_key").alias("exact_keys"), "city", "placed", "chunk_type", "object_type", "level", "role", "status",
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("days").cast("int")).alias("effective"),
    )


def _index(chunks: DataFrame) -> retrieval.Index:
    return retrieval.build_index(chunks, "key", T.search_tokens(F.col("hay")), F.col("side"))


def _passages(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact hits: chunks that hold the question's text."""
    found = search.containing(chunks.select("key", "text"), questions.select("question_id", F.col("text").alias("passage")), "key", "text", "question_id", "passage")
    return found.join(chunks.select("key", "side"), "key").withColumn("boost", F.lit(1.0))


@query(f"{_LEXICAL} select item_id as question_id, side, doc_id, round(s, 6) as score, row_number() over (partition by item_id, side order by s desc, doc_id) as rank from lex qualify rank <= k")
def batch_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of all questions in each side by the inverted index."""
    chunks = _chunks(spark, sf_dir)
    asked = retrieval.question_terms(_questions(spark, sf_dir), Q.result_size(F.col("question")))
    found = retrieval.lexical(asked, _index(chunks))
    return found.select("question_id", "side", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_RETRIEVED = f"""{_CHANNELS},
    merged as (select item_id, side, doc_id, coalesce(max(score) filter (channel < 2), 0) as keyword_score, coalesce(max(score) filter (channel = 2), 0) as vector_score, case when count(*) > 1 then 'hybrid' else ['exact', 'lexical', 'vector'][min(channel) + 1] end as source from found group by item_id, side, doc_id),
    facts as (select m.*, q, k, {_PHRASES} as phrases, asked_city, content, hay, title, one_key, city, placed, chunk_type, object_type, role, length(content) as length, len(list_intersect({_tokens('hay')}, {_KEYWORDS})) > 0 and source <> 'vector' as matched, {_uses('q')} as asked_uses,
      len(list_filter({_uses('q')}, lambda u: contains(upper(content), u))) > 0 as covers, regexp_matches(content, '{Q.COUNT_ANSWER}') as counted,
      {_NUMERIC} as numeric_, len(list_intersect({_uses('q')}, {_uses('content')})) > 0 as land, {_PRIORITY} as priority, {_intent_sql()} as intent, {_VERSION} as version from merged m join sized using (item_id) join chunks using (side, doc_id)),
    hits as (select *, list_filter(phrases, lambda p: contains(hay, p)) as hits, list_filter(phrases, lambda p: length(p) >= 3 and contains(title, p)) as title_hits, count(*) over w as n, coalesce(bool_or(object_type is not null and object_type <> 'plain_section') over w, false) as structured from facts window w as (partition by item_id, side)),
    dfs as (select item_id, side, phrase, count(*) as df from (select item_id, side, unnest(hits) as phrase from hits) group by all),
    idfs as (select item_id, side, phrase, ln(1 + (n + 1) / (coalesce(df, 0) + 0.5)) as idf from (select distinct item_id, side, n, unnest(phrases) as phrase from hits) left join dfs using (item_id, side, phrase)),
    maps as (select item_id, side, map(list(phrase), list(idf)) as idf, sum(idf) as total from idfs group by item_id, side),
    worth as (select h.*, coalesce(list_sum(list_transform(hits, lambda p: idf[p])) / total, 0) as share, coalesce(list_sum(list_transform(title_hits, lambda p: idf[p])) / total, 0) as title_share from hits h left join maps using (item_id, side)),
    scored as (select *, round(0.28 * keyword_score + 0.3 * greatest(vector_score, 0) + case when source = 'exact' then 0.32 else 0 end + 0.45 * share * least(1, 180 / greatest(length, 180)) + 0.28 * least(1, title_share) + case when length(one_key) >= 3 and contains(q, one_key) then 0.22 else 0 end
      + case when asked_city is null then 0.04 when regexp_replace(trim(city), '市$', '') = regexp_replace(trim(asked_city), '市$', '') then 0.08 else 0 end + case when numeric_ then 0.07 else 0 end + case when land then 0.1 else 0 end + case when placed then 0.05 else 0 end + 0.12 * priority + 0.18 * intent + 0.16 * version
      + case role when 'atomic' then 0.04 when 'summary' then -0.02 when 'fallback' then -0.08 else 0 end + case when structured and coalesce(object_type, '') = 'plain_section' then -0.22 else 0 end, 4) as score from worth),
    ranked as (select *, row_number() over (partition by item_id, side order by score desc, doc_id) as rank from scored qualify rank <= k)"""


@query(f"{_RETRIEVED} select item_id as question_id, side, rank, doc_id, score, round(keyword_score, 6) as keyword_score, round(vector_score, 6) as vector_score, source from ranked")
def batch_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions of a table over both sides: exact, lexical and vector channels, merged and re-ranked with all facts."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    found = retrieval.retrieve(questions, chunks, _index(chunks), _passages(questions, chunks))
    return found.select("question_id", "side", F.col("rank").cast("long").alias("rank"), F.col("key").alias("doc_id"), "score", F.round("keyword_score", 6).alias("keyword_score"), F.round("vector_score", 6).alias("vector_score"), "source")


@query(
    f"""{_CHANNELS}, given as (select item_id, count(*) filter (channel = 0) as n_exact, count(*) filter (channel = 1) as n_lexical, count(*) filter (channel = 2) as n_vector from found where side = 'accessible' group by item_id),
    fits as (select item_id, count(*) filter (len(c.v) = len(z.v)) as fit, count(*) filter (c.v is not null and (z.v is null or len(c.v) <> len(z.v))) as unfit, count(*) filter (c.v is null) as without from sized z, chunks c group by item_id),
    rows_ as (select item_id, v, coalesce(n_exact, 0) as n_exact, coalesce(n_lexical, 0) as n_lexical, coalesce(n_vector, 0) as n_vector, fit, unfit, without from sized left join given using (item_id) left join fits using (item_id))
    select item_id as question_id, concat_ws(',', case when n_exact > 0 then 'exact' end, case when n_lexical > 0 then 'lexical' end, case when n_vector > 0 then 'vector' end) as channels, n_exact, n_lexical, n_vector, fit, unfit, without,
      case when v is null then 'no_question_vector' when fit = 0 then 'no_fitting_rows' when unfit + without > 0 then 'rows_set_aside' end as degraded from rows_"""
)
def retrieval_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which channels took part for each question, and the rows whose vectors were set aside."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    found = retrieval.channels(questions, chunks, _index(chunks), _passages(questions, chunks))
    return retrieval.debugged(found, questions, chunks)


_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^。；;！!？?]*[。；;！!？?]|[^。；;！!？?]+$'), lambda x: regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')), lambda x: x <> '')"
_STRONG = "(source in ('exact', 'hybrid') or keyword_score >= 0.2 or matched)"


@query(
    f"""{_RETRIEVED}, sides as (select item_id, count(*) filter (side = 'accessible') as a, count(*) filter (side = 'denied') as d, max(score) filter (side = 'accessible' and rank = 1) as a_score, max(score) filter (side = 'denied' and rank = 1) as d_score,
      bool_or({_STRONG}) filter (side = 'accessible' and rank = 1) as a_strong, bool_or({_STRONG}) filter (side = 'denied' and rank = 1) as d_strong,
      bool_or(covers) filter (side = 'accessible' and rank <= 5) as covered, bool_or(numeric_ or counted) filter (side = 'accessible' and rank <= 5) as number from ranked group by item_id),
    verdicts as (select item_id, q, case when coalesce(d, 0) = 0 then false when a = 0 then true else d_strong and (not a_strong or d_score > a_score) end as no_access,
      case when coalesce(a, 0) = 0 then 'no_results' when a_score < 0.1 then 'weak' when len({_uses('q')}) > 0 and not covered then 'no_land_use' when regexp_matches(q, '{Q.WANTS_NUMBER}') and not number then 'no_number' end as refusal from sized left join sides using (item_id)),
    cited as (select item_id, rank, doc_id, score from ranked where side = 'accessible' and rank <= 5)
    select v.item_id as question_id, no_access, refusal, rank, c.doc_id, score, {_SENTENCES.replace('text', 'd.text')}[1] as excerpt from verdicts v left join cited c on c.item_id = v.item_id and refusal is null and not no_access left join documents d on d.doc_id = c.doc_id"""
)
def pipeline_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve, re-rank, gate and cite for all questions; one that is refused has no citations."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    found = shared_table(retrieval.retrieve(questions, chunks, _index(chunks), _passages(questions, chunks)))
    verdicts = retrieval.gated(found, questions)
    cited = found.where("side = 'accessible' and rank <= 5").select("question_id", "key", "rank", "score")
    texts = chunks.select("key", F.get(T.sentences(F.col("text")), F.lit(0)).alias("excerpt")).join(cited.select("key").distinct(), "key", "left_semi")
    shown = cited.join(verdicts.where("refusal is null and not no_access").select("question_id"), "question_id", "left_semi").join(texts, "key")
    rows = verdicts.join(shown, "question_id", "left")
    return rows.select("question_id", "no_access", "refusal", F.col("rank").cast("long").alias("rank"), F.col("key").alias("doc_id"), "score", "excerpt")
