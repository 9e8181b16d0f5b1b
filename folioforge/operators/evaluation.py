"""Evaluation of answers: statistics, ratio cards, frequent errors, item scores, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.rules import file_fits, trimmed
from folioforge.functions.text import exact_key


def ratio(scope: Column, passed: Column) -> Column:
    """Passed among those in scope, to four places; null if nothing is in scope."""
    return F.round(F.try_divide(F.count_if(scope & passed), F.nullif(F.count_if(scope), F.lit(0))), 4)


def item_score(should_refuse: Column, refused: Column, values_ok: Column, has_target: Column, citation_ok: Column, overlap: Column) -> Column:
    """2, 1 or 0 for an answer."""
    return (
        F.when(should_refuse, F.when(refused, 2).otherwise(0))
        .when(refused | ~values_ok, 0)
        .when(has_target, F.when(citation_ok, 2).otherwise(1))
        .when(overlap.isNull(), 1)
        .otherwise(F.when(overlap >= 0.5, 2).otherwise(1))
    )


def most_frequent(rows: DataFrame, reason: str, k: int = 5) -> DataFrame:
    """The k most frequent trimmed reasons; ties in order of text. Each task keeps k rows at most."""
    trimmed = F.trim(F.col(reason))
    counts = rows.where(trimmed != "").groupBy(trimmed.alias("reason")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(k)


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The columns of the last row of each key: an aggregate, not a sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("x")).select(key, "x.*")


def overlap_tokens(answer: Column) -> Column:
    """Numbers, codes and pairs of Han characters of a standard answer; none if it is missing."""
    every = lambda p: F.regexp_extract_all(answer, F.lit(p), F.lit(0))
    pairs = F.flatten(F.transform(every("[一-龥]{2,}"), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    found = F.array_distinct(F.concat(every("[0-9]+(?:\\.[0-9]+)?"), F.transform(every("[A-Za-z][0-9]{1,2}"), F.upper), pairs))
    return F.when(answer != "—", found).otherwise(F.array().cast("array<string>"))


def overlaps(tokens: Column, text: Column) -> Column:
    return (F.size(tokens) > 0) & (F.size(F.filter(tokens, lambda t: F.contains(text, t))) >= 0.5 * F.size(tokens))


def hits_target(file_ok: Column, article: Column, page: Column, text: Column, item: dict[str, Column]) -> Column:
    """Whether a hit is what an item asks for: its file, and its article, its page within one, or half of the standard answer; the file alone if nothing else is given."""
    has_article = F.coalesce(~item["article"].isin("", "—"), F.lit(False))
    has_page = F.coalesce(~item["page"].isin("", "—"), F.lit(False))
    near = F.abs(page - item["page"].try_cast("double")) <= 1
    at = (has_article & F.coalesce(trimmed(article) == trimmed(item["article"]), F.lit(False))) | (has_page & F.coalesce(near, F.lit(False))) | overlaps(item["tokens"], text) | (~has_article & ~has_page)
    return file_ok & at


def missing_values(answer: Column, expected: Column) -> Column:
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda v: ~F.contains(answer, v))


def forbidden_values(answer: Column, forbidden: Column) -> Column:
    return F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda v: F.contains(answer, v))


def judged_items(items: DataFrame, hits: DataFrame) -> DataFrame:
    """items with in_top, citation_correct, refused_correctly, score and error; a batch of questions in one plan.

    items: item_id, should_refuse, answered, answer, file, article, page, standard_answer, expected, forbidden.
    hits: item_id, file_name, article_no, page_number, text, cited (whether the answer cites the hit).
    """
    asked = items.withColumn("tokens", overlap_tokens(F.coalesce("standard_answer", F.lit(""))))
    target = {"article": F.col("article"), "page": F.col("page"), "tokens": F.col("tokens")}
    found = hits.join(asked.select("item_id", "file", "article", "page", "tokens"), "item_id")
    found = found.withColumn("hit", hits_target(file_fits(F.col("file_name"), F.col("file")), F.col("article_no"), F.col("page_number"), F.col("text"), target))
    sums = found.groupBy("item_id").agg(F.bool_or("hit").alias("hit"), F.bool_or(F.col("hit") & F.col("cited")).alias("cited"))
    rows = asked.join(sums, "item_id", "left")
    has_target = F.coalesce(~F.col("file").isin("", "—"), F.lit(False))
    rows = rows.withColumn("in_top", F.when(has_target, F.coalesce("hit", F.lit(False))))
    rows = rows.withColumn("citation_correct", F.when(~F.col("should_refuse") & F.col("answered") & has_target, F.coalesce("cited", F.lit(False)))).withColumn("refused_correctly", F.when(F.col("should_refuse"), ~F.col("answered")))
    missing, wrong = missing_values(F.col("answer"), F.col("expected")), forbidden_values(F.col("answer"), F.col("forbidden"))
    asserted = F.coalesce(F.size("expected"), F.lit(0)) > 0
    failed = asserted & ((F.size(missing) > 0) | (F.size(wrong) > 0))
    overlapping = overlaps(F.col("tokens"), F.col("answer"))
    verdict = [  # the first that fits: score, and what went wrong
        (F.col("should_refuse") & ~F.col("answered"), 2, F.lit("")),
        (F.col("should_refuse"), 0, F.lit("应拒答却作答")),
        (~F.col("answered"), 0, F.lit("召回不足 / 误拒答")),
        (failed, 0, F.concat_ws("；", F.when(F.size(missing) > 0, F.concat(F.lit("缺少数值："), F.array_join(missing, "、"))), F.when(F.size(wrong) > 0, F.concat(F.lit("出现禁用值："), F.array_join(wrong, "、"))))),
        (has_target & F.coalesce("citation_correct", F.lit(False)), 2, F.lit("")),
        (has_target, 1, F.lit("引用未命中标准条文")),
        (overlapping, 2, F.lit("")),
        (F.size("tokens") > 0, 1, F.lit("回答与标准答案重叠不足")),
    ]
    score, error = F.lit(1), F.lit("缺少标注（标准答案/正确文件），无法自动核对")
    for fits, points, reason in reversed(verdict):
        score, error = F.when(fits, points).otherwise(score), F.when(fits, reason).otherwise(error)
    return rows.withColumn("score", score).withColumn("error", error).drop("tokens", "hit", "cited")


def statistics(items: DataFrame, *by: str) -> DataFrame:
    """total, hits, right citations, right refusals and the mean score, to two places, of judged items."""
    return items.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("in_top").alias("in_top"), F.count_if("citation_correct").alias("citations"), F.count_if("refused_correctly").alias("refusals"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("mean_score")
    )


def golden_objects(questions: DataFrame, objects: DataFrame, k: int = 5) -> DataFrame:
    """question_id, the kinds of the first k objects whose key and one of the keywords contain one another, and whether an expected kind is among them.

    questions: question_id, keywords, expected (a few hundred at most); objects: seq, object_type, key.
    """
    fits = F.exists("keywords", lambda w: F.contains(exact_key(F.col("key")), exact_key(w)) | F.contains(exact_key(w), exact_key(F.col("key"))))
    found = objects.join(F.broadcast(questions), fits & (F.length(exact_key(F.col("key"))) > 0))
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("seq"))).where(F.col("rank") <= k)
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("rank", "object_type"))), lambda x: x["object_type"])
    seen = top.groupBy("question_id").agg(kinds.alias("kinds"))
    return questions.join(seen, "question_id", "left").select("question_id", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce(F.arrays_overlap("kinds", "expected"), F.lit(False)).alias("hit"))


def golden_values(questions: DataFrame, objects: DataFrame) -> DataFrame:
    """question_id, matches, missing and forbidden: objects of an expected kind whose text holds all keywords, and the values in them.

    questions: question_id, keywords, expected (kinds), values, forbidden; objects: object_id, object_type, text.
    """
    fits = F.array_contains("expected", F.col("object_type")) & F.forall("keywords", lambda w: F.contains(exact_key(F.col("text")), exact_key(w)))
    found = objects.join(F.broadcast(questions), fits)
    # of each text only which values it holds is gathered
    held = lambda c: F.array_distinct(F.flatten(F.collect_list(F.filter(c, lambda v: F.contains("text", v)))))
    seen = found.groupBy("question_id").agg(F.count("*").alias("matches"), held("values").alias("have"), held("forbidden").alias("wrong"))
    rows = questions.join(seen, "question_id", "left")
    none = F.array().cast("array<string>")
    missing = F.array_except("values", F.coalesce("have", none))
    wrong = F.coalesce("wrong", none)
    return rows.select("question_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.array_sort(missing).alias("missing"), F.array_sort(wrong).alias("forbidden"), ((F.size(missing) == 0) & (F.size(wrong) == 0)).alias("pass"))
