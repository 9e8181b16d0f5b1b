"""Answers out of ranked hits: excerpts, citations, value assertions, expansion over links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import exact_key, sentences, words


def core_sentence(question: Column, text: Column) -> Column:
    """The sentence with the most of the question's words; the first of equals."""
    asked = F.array_distinct(words(question))
    scored = F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(words(s), asked)).alias("hits"), (-i).alias("at"), s.alias("s")))
    return F.element_at(F.sort_array(scored, asc=False), 1)["s"]


def citations(hits: DataFrame, by: str, rank: str, text: str, most: int = 5, contained: int = 10) -> DataFrame:
    """by and citations: ranked texts without those whose normal form equals or (from ``contained`` characters) lies in an earlier one, or the other way round."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(text).alias("text"), exact_key(F.col(text)).alias("key"))))
    kind = f"array<struct<rank:{hits.schema[rank].dataType.simpleString()},text:string,key:string>>"

    def same(a: Column, b: Column) -> Column:
        inside = (F.least(F.length(a), F.length(b)) >= contained) & (F.contains(a, b) | F.contains(b, a))
        return (a == b) | inside

    def add(kept: Column, x: Column) -> Column:
        skip = (F.size(kept) >= most) | F.exists(kept, lambda k: same(k["key"], x["key"]))
        return F.when(skip, kept).otherwise(F.concat(kept, F.array(x)))

    folded = F.aggregate(items, F.array().cast(kind), add, lambda k: F.transform(k, lambda x: x["text"]))
    return hits.groupBy(by).agg(folded.alias("citations"))


def values_ok(answer: Column, expected: Column, forbidden: Column) -> Column:
    """All expected values are in the answer and no forbidden one."""
    return F.forall(F.coalesce(expected, F.array().cast("array<string>")), lambda v: F.contains(answer, v)) & ~F.exists(F.coalesce(forbidden, F.array().cast("array<string>")), lambda v: F.contains(answer, v))


def expanded(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id and chunk_id of hits, their neighbours and parents, once each, with the best rank and the way they came."""
    links = hits.join(chunks.select("chunk_id", "parent_chunk_id", "prev_chunk_id", "next_chunk_id"), "chunk_id")
    each = F.explode(F.array(*[F.struct(F.col(c).alias("chunk_id"), F.lit(i).alias("way")) for i, c in enumerate(("chunk_id", "parent_chunk_id", "prev_chunk_id", "next_chunk_id"))]))
    rows = links.select("question_id", "rank", each.alias("x")).select("question_id", "rank", "x.*").where("chunk_id is not null")
    return rows.groupBy("question_id", "chunk_id").agg(F.min(F.struct("rank", "way")).alias("m")).select("question_id", "chunk_id", "m.rank", "m.way")
