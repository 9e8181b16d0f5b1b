"""Queries over texts: search channels, tokens, sentences, quality and version rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.operators import access, search, tables
from folioforge.plans.common import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

TERMS = ["the", "license", "que", "that"]
PHRASES = ["the ", "license", "general public", "la ", "und ", "nowhere to be found"]
_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _bm25_sql(side: str = "", source: str = "documents d") -> str:
    by, on = (", side", " using (side)") if side else ("", " on true")
    return f"""
    with tok as (select doc_id{side}, list_concat(regexp_extract_all(lower(text), '[a-z]+[0-9]+|[0-9]+(?:[.\\-~][0-9]+)*|[a-z]{{2,}}'), list_transform(regexp_extract_all(text, '[A-Za-z][0-9]{{1,3}}'), lambda c: upper(c)), regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)+')) as t from {source}),
    len as (select doc_id{by}, t, len(t) as length from tok),
    stat as (select {'side, ' if side else ''}count(*) as n, avg(length) as mean from len {'group by side' if side else ''}),
    tf as (select doc_id{by}, length, q.term, len(list_filter(t, lambda x: x = q.term)) as f
           from len, (select unnest([{_TERM_LIST}]) as term) q),
    df as (select {'side, ' if side else ''}term, count(*) as df from tf where f > 0 group by all),
    sc as (select doc_id{by}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / mean))) as score
           from tf join df using (term{by}) join stat{on} where f > 0 group by all)
    """


@query(_bm25_sql() + "select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from sc qualify rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.bm25(table(spark, sf_dir, "documents"), TERMS)
    return search.top(scores, "score", "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_bm25_sql(", case when quality = 1 then 'accessible' else 'denied' end as side", "documents d join labels l using (doc_id)") + "select doc_id, side, round(score, 6) as score from sc")
def bm25_acl_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and scores separately for each side; documents without rules are dropped."""
    rules = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("allowed"))
    sides = access.split_by_access(table(spark, sf_dir, "documents"), rules, "doc_id")
    return search.bm25(sides, TERMS, side="side").select("doc_id", "side", F.round("score", 6).alias("score"))


_SIMILAR = """
    with q as (select cast(embedding as double[]) as e from embeddings where vec_id = 0),
    s as (select vec_id, list_inner_product(cast(embedding as double[]), q.e) as sim from embeddings, q where len(embedding) = len(q.e))
"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.col("embedding").alias("asked"))  # one row
    return vectors.crossJoin(F.broadcast(asked)).where(F.size("embedding") == F.size("asked")).select("vec_id", V.dot(F.col("embedding"), F.col("asked")).alias("sim"))


@query(_SIMILAR + "select vec_id, round(sim, 6) as sim, row_number() over (order by sim desc, vec_id) as rank from s qualify rank <= 15")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_similar(spark, sf_dir), "sim", "vec_id", 15).select("vec_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(
    _bm25_sql()
    + """, q as (select cast(embedding as double[]) as e from embeddings where vec_id = 0),
    vec as (select vec_id as doc_id, list_inner_product(cast(embedding as double[]), q.e) as score from embeddings, q),
    ex as (select d.doc_id, sum(1.0) as boosts from documents d, benchmark b where contains(d.text, b.text) group by all),
    exs as (select doc_id, least(boosts / greatest((select max(boosts) from ex), 1.0), 1.0) as score from ex),
    lex as (select doc_id, score / (select max(score) from sc) as score from sc),
    u as (select doc_id, 0 as channel, score from exs union all select doc_id, 1, score from lex union all select doc_id, 2, score from vec)
    select doc_id, round(coalesce(max(score) filter (channel < 2), 0), 6) as keyword_score, round(coalesce(max(score) filter (channel = 2), 0), 6) as vector_score,
      case when count(*) > 1 then 'hybrid' else ['exact', 'lexical', 'vector'][min(channel) + 1] end as source from u group by doc_id"""
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = search.bm25(documents, TERMS)
    lexical = scores.crossJoin(F.broadcast(scores.agg(F.max("score").alias("most")))).select("doc_id", (F.col("score") / F.col("most")).alias("score"))
    vector = _similar(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("sim").alias("score"))
    merged = search.merged(search.exact_scores(_passages(spark, sf_dir).withColumn("boost", F.lit(1.0)), "doc_id", "boost"), lexical, vector, "doc_id")
    return merged.select("doc_id", F.round("keyword_score", 6).alias("keyword_score"), F.round("vector_score", 6).alias("vector_score"), "source")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return search.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), passages, "doc_id", "text", "item_id", "passage")


@query("select d.doc_id, count(*) as n_passages, min(b.item_id) as first_item from documents d join benchmark b on contains(d.text, b.text) group by d.doc_id")
def exact_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_passages"), F.min("item_id").alias("first_item"))


_PHRASE_LIST = ", ".join(f"'{p}'" for p in PHRASES)


@query(f"""select phrase, cast(sum(case when contains(lower(text), phrase) then 1 else 0 end) as bigint) as df,
    round(ln(1 + (count(*) + 1) / (sum(case when contains(lower(text), phrase) then 1 else 0 end) + 0.5)), 6) as idf
    from documents, (select unnest([{_PHRASE_LIST}]) as phrase) group by phrase""")
def phrase_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_idf(table(spark, sf_dir, "documents"), PHRASES).select("phrase", "df", F.round("idf", 6).alias("idf"))


@query("""select replace(lower(regexp_replace(v, '\\s+', '', 'g')), '', '') as normal_key, p_partkey, field, boost from (
    select p_partkey, 'p_name' as field, p_name as v, 3.2 as boost from part union all select p_partkey, 'p_brand', p_brand, 1.6 from part
    union all select p_partkey, 'p_type', p_type, 1.1 from part) where length(regexp_replace(v, '\\s+', '', 'g')) >= 2""".replace("replace(lower(regexp_replace(v, '\\s+', '', 'g')), '', '')", "lower(regexp_replace(v, '\\s+', '', 'g'))").replace("3.2 as", "cast(3.2 as double) as").replace("p_brand, 1.6", "p_brand, cast(1.6 as double)").replace("p_type, 1.1", "p_type, cast(1.1 as double)"))
def exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_entries(table(spark, sf_dir, "part"), "p_partkey", {"p_name": 3.2, "p_brand": 1.6, "p_type": 1.1})


@query("""with l as (select distinct doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents)
    select line, count(distinct doc_id) as documents from l where length(line) between 1 and 30 group by line having count(distinct doc_id) >= 3""")
def line_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


_FLAGS = {"has_email": "@[a-z]", "has_number": "[0-9]{5}", "has_table": r" \| ", "has_license": "(License|Copyright)", "has_symbols": "[$%&*#]{3}"}


@query("select source, lang, count(*) as n, " + ", ".join(f"bool_or(regexp_matches(text, '{p}')) as {k}, count(*) filter (regexp_matches(text, '{p}')) as n_{k}" for k, p in _FLAGS.items()) + " from documents group by source, lang")
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [f for k, p in _FLAGS.items() for f in (F.bool_or(F.col("text").rlike(p)).alias(k), F.count_if(F.col("text").rlike(p)).alias(f"n_{k}"))]
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), *flags)


@query("""with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ('the', 'and')) as w from documents),
    e as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from t), f as (select doc_id, word, min(pos) as pos from e group by all)
    select doc_id, string_agg(word, ' ' order by pos) as keywords, count(*) as n from (select *, row_number() over (partition by doc_id order by pos) as r from f) where r <= 40 group by doc_id""")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.keywords(F.col("text"), ["the", "and"]).alias("w")).where(F.size("w") > 0)
    return words.select("doc_id", F.array_join("w", " ").alias("keywords"), F.size("w").cast("long").alias("n"))


@query("""select conv_id, turn, len(s) as n_sentences, s[1] as first_sentence from (select conv_id, turn,
    list_filter(list_transform(regexp_extract_all(text, '[^。；;！!？?]*[。；;！!？?]|[^。；;！!？?]+$'), lambda x: regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')), lambda x: x <> '') as s from conversations where text is not null) where len(s) > 0""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("n_sentences"), F.element_at("s", 1).alias("first_sentence"))


_PAIRS = """with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations),"""


@query(_PAIRS + """ t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(before), '[a-z0-9]+')) as b from p where before is not null and text is not null)
    select conv_id, turn, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) else 0.0 end as jaccard from t""")
def jaccard_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null and text is not null")
    return rows.select("conv_id", "turn", F.round(T.jaccard(T.words(F.col("text")), T.words(F.col("before"))), 6).alias("jaccard"))


@query(_PAIRS + r""" t as (select conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as a, regexp_replace(lower(before), '[^\p{L}\p{N}]+', '', 'g') as b from p where before is not null and text is not null),
    g as (select conv_id, turn, list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) as a, list_distinct(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) as b from t)
    select conv_id, turn, case when len(a) > 0 then round(len(list_intersect(a, b)) / len(a), 6) else 0.0 end as support from g""")
def support_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null and text is not null")
    return rows.select("conv_id", "turn", F.round(T.support(F.col("text"), F.col("before")), 6).alias("support"))


@query(r"""select min(doc_id) as doc_id, count(*) as copies from (select doc_id, regexp_replace(lower(text), '[ \t\n\r\f\v]+', '', 'g') as k from documents) group by k""")
def dedupe_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates after normalisation, by digest: the texts themselves aren't shuffled."""
    key = F.sha2(F.lower(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", "")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("""select page_id, length(t) as n_chars, t as text from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as t from pages)""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "pages").select("page_id", T.markup_stripped(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


@query("select source, count(*) as questions, cast(sum(greatest(ceil(length(text) / 2), 1)) as bigint) as tokens from documents group by source")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.greatest(F.ceil(F.length("text") / 2), F.lit(1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("questions"), F.sum(tokens).cast("long").alias("tokens"))


@query("select doc_id, lang, source, n_chars, length(text) as total_chars from documents")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the heavy one, with its length."""
    rows = table(spark, sf_dir, "documents")
    return rows.withColumn("total_chars", F.length("text").cast("long")).drop("text")


@query("""select doc_id, lang, source, 'new' as origin from documents where doc_id in (select doc_id from labels) union all
    select d.doc_id, d.lang, d.source, 'old' from documents d where d.doc_id not in (select doc_id from labels)""")
def replace_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.sources.tables import replaced

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return replaced(rows.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), "doc_id")


@query("select doc_id, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def append_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.sources.tables import appended

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return appended(labels, table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality")), "doc_id")


_FNV = "list_reduce(list_prepend(2166136261, list_transform(string_split({x}, ''), lambda c: cast(ord(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query("select p_partkey, " + _FNV.format(x="p_name") + " as hash from part")
def name_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.fnv1a(F.col("p_name")).alias("hash"))


@query()
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of all conversation turns; held against plain code in the tests."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), T.embedding_tokens(F.col("text")).alias("tokens"))
    return V.hashed_embeddings(rows, "row_id", "tokens").select("row_id", "bucket", F.round("weight", 6).alias("weight"))


@query("""with s as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents qualify rank <= 30),
    r as (select source, 1::bigint as rank, 1::bigint as kept, n_chars as total, true as keep from s where rank = 1 union all
      select s.source, s.rank, r.kept + case when r.kept < 5 or r.total + s.n_chars <= 40000 then 1 else 0 end, r.total + case when r.kept < 5 or r.total + s.n_chars <= 40000 then s.n_chars else 0 end,
      r.kept < 5 or r.total + s.n_chars <= 40000 from s join r on s.source = r.source and s.rank = r.rank + 1)
    select source, rank, doc_id, n_chars from s join r using (source, rank) where keep""".replace("with s as", "with recursive s as"))
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty longest documents of a source, greedily put into a budget."""
    best = search.ranked(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars")), "n_chars", "doc_id", 30, by=["source"])
    kept = search.within_budget(best, "source", "rank", "n_chars", budget=40_000)
    return kept.select("source", F.col("rank").cast("long").alias("rank"), "doc_id", "n_chars")


@query()
def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document in pieces of about 900 characters with overlap; held against plain code in the tests."""
    pieces = R.packed_section(F.split("text", "\n"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(pieces).alias("part", "content"))
    return rows.select("doc_id", "part", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))
