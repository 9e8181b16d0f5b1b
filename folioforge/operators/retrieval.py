"""Retrieval for a whole table of questions: a stored inverted index, three channels, their merge and the full re-ranking.

The index is written once and serves any number of questions. Postings hold what a term adds to a BM25 score but for the
term's rarity, in blocks of BLOCK from the highest down; a block knows its largest value. For each question a floor follows
from the index alone: the k-th largest posting of any one of its terms, as a document scores that much at least. Terms that
all together stay below the floor (and below what the k-th best row has by the LEAD weightiest terms) can't bring a document up to it, so only documents of the other terms are candidates
(from blocks that can reach the floor with the best of all other terms), and the weak terms are added for these only.

Texts never travel but for the candidates of the re-ranking. Sides of the access rules (or any groups that don't see each
other) have statistics of their own. A key names one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import questions as Q
from folioforge.functions import vectors as V
from folioforge.functions.text import HAN, search_tokens
from folioforge.operators import gates, search
from folioforge.sources.tables import shared_table

#: Postings of a block, postings of a term that are sorted at a time, and the largest values kept for each term.
BLOCK, SPLIT, TOPS, TOP_PARTS = 128, 1 << 16, 128, 16
#: Bounds are doubles: room for their rounding. Questions with vectors that are compared at a time.
ROOM, QUESTIONS = 1 - 1e-9, 4096
#: Terms of a question, the weightiest, whose sums set its floor.
LEAD = 8
#: Scores are rounded to so many places, so that equal rows tie whatever the order in which parts are added.
PLACES = 9
#: Each channel gives this many times the size of a question's result to the merge.
DEPTH = 4


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # side, term, top, entries (part, key)
    terms: DataFrame  # side, term, df, idf, tops
    flat: DataFrame  # side, term, key, part


def build_index(rows: DataFrame, key: str, tokens: Column, side: Column | None = None) -> Index:
    """The index of rows by their tokens, with repeats. A row without tokens counts for the mean length."""
    side = (F.lit("all") if side is None else side).alias("side")
    own = rows.select(F.col(key).alias("key"), side, tokens.alias("tokens")).select("key", "side", F.size("tokens").alias("length"), F.posexplode_outer("tokens").alias("pos", "term"))
    first = F.sum(F.coalesce((F.col("pos") == 0).cast("int"), F.lit(1)))
    counts = shared_table(own.groupBy("side", "term", "key", "length").agg(F.count("pos").alias("f"), first.alias("first")))
    stats = counts.groupBy("side").agg(F.sum("first").alias("rows"), (F.sum(F.col("first") * F.col("length")) / F.sum("first")).alias("mean"))  # a row a side
    length = search.K1 * (1 - search.B + search.B * F.col("length") / F.col("mean"))
    flat = counts.where("term is not null").join(F.broadcast(stats), "side").select("side", "term", "key", (F.col("f") * (search.K1 + 1) / (F.col("f") + length)).alias("part"))
    flat = shared_table(flat)
    frequency = flat.groupBy("side", "term").agg(F.count("*").alias("df"))
    parts = flat.join(frequency, ["side", "term"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("df") / SPLIT)))
    place = F.row_number().over(Window.partitionBy("side", "term", "salt").orderBy(F.desc("part"), "key")) - 1
    blocks = parts.withColumn("block", F.floor(place / BLOCK)).groupBy("side", "term", "salt", "block")
    postings = shared_table(blocks.agg(F.max("part").alias("top"), F.sort_array(F.collect_list(F.struct("part", "key")), asc=False).alias("entries")))
    # the largest of some parts of a frequent term: a lower bound is all that floors need
    largest = postings.where((F.col("block") == 0) & (F.col("salt") < TOP_PARTS)).groupBy("side", "term").agg(F.flatten(F.collect_list(F.col("entries.part"))).alias("x"), F.max("top").alias("most"))
    most = postings.where("block = 0").groupBy("side", "term").agg(F.max("top").alias("upper"))
    tops = largest.join(most, ["side", "term"]).select("side", "term", "upper", F.slice(F.sort_array("x", asc=False), 1, TOPS).alias("tops"))
    idf = F.ln(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = frequency.join(F.broadcast(stats), "side").join(tops, ["side", "term"]).select("side", "term", "df", idf.alias("idf"), "upper", "tops")
    return Index(postings, shared_table(terms), flat)


def lexical(asked: DataFrame, index: Index) -> DataFrame:
    """question_id, side, key and score of the k best rows of each question and side. asked: question_id, term, k (TOPS at most); a row a term."""
    group, w = ["question_id", "side"], Window.partitionBy("question_id", "side")
    q = asked.join(index.terms, "term").withColumn("upper", F.col("idf") * F.col("upper"))
    q = q.withColumn("floor", F.coalesce(F.max(F.col("idf") * F.try_element_at("tops", F.col("k"))).over(w), F.lit(0.0)))
    q = shared_table(q.withColumn("place", F.row_number().over(w.orderBy(F.desc("upper"), "term"))).drop("tops"))

    def kth(sums: DataFrame) -> DataFrame:
        return search.ranked(sums, "given", "key", F.col("k"), by=group, name="at").where(F.col("at") == F.col("k")).select(*group, F.col("given").alias("reached"))

    def parts(terms: DataFrame) -> DataFrame:
        found = terms.select(*group, "k", "idf", "entries").select(*group, "k", "idf", F.explode("entries").alias("e"))
        return found.groupBy(*group, F.col("e.key").alias("key")).agg(F.sum(F.col("idf") * F.col("e.part")).alias("given"), F.first("k").alias("k"))

    # what the weightiest terms alone give to the k-th best row is a better floor
    lead = kth(parts(q.where(F.col("place") <= LEAD).join(index.postings, ["side", "term"])))
    q = q.join(lead, group, "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", F.lit(0.0))) * ROOM).drop("reached", "place")
    below = F.sum("upper").over(w.orderBy("upper", "term").rowsBetween(Window.unboundedPreceding, 0))
    q = q.withColumn("strong", below >= F.col("floor")).withColumn("rest", F.coalesce(F.sum(F.when(~F.col("strong"), F.col("upper"))).over(w), F.lit(0.0)))
    q = shared_table(q.withColumn("others", F.sum("upper").over(w) - F.col("upper")))
    near = q.where("strong").join(index.postings, ["side", "term"]).where(F.col("idf") * F.col("top") + F.col("others") >= F.col("floor"))
    found = shared_table(parts(near))
    bounds = q.groupBy(*group).agg(F.first("floor").alias("floor"), F.first("rest").alias("rest")).join(kth(found), group, "left")
    found = found.join(bounds, group).where(F.col("given") + F.col("rest") >= F.greatest("floor", F.coalesce("reached", F.lit(0.0)) * ROOM))
    found = shared_table(found.select(*group, "key", "k", "given"))
    weak = found.select(*group, "key").join(q.where("not strong").select(*group, "term", "idf"), group)
    more = weak.join(index.flat, ["side", "term", "key"]).groupBy(*group, "key").agg(F.sum(F.col("idf") * F.col("part")).alias("more"))
    scores = found.join(more, [*group, "key"], "left").withColumn("score", F.round(F.col("given") + F.coalesce("more", F.lit(0.0)), PLACES))
    return search.ranked(scores, "score", "key", F.col("k"), by=group).select(*group, "key", "score", "rank")


def similar(asked: DataFrame, rows: DataFrame, key: str, vector: str, side: Column | None = None) -> DataFrame:
    """question_id, side, key and score (inner product) of the k best rows of each question and side.

    asked: question_id, vector, k. Null vectors, and rows whose dimension isn't the question's, take no part (see
    ``fitness``). Questions are compared in blocks with all rows; a task keeps the k best of each.
    """
    rows = rows.select(F.col(key).alias("key"), (F.lit("all") if side is None else side).alias("side"), F.col(vector).alias("vector")).where("vector is not null")
    out, held = None, []

    def add(block: list) -> None:
        nonlocal out
        found = _similar(rows, block)
        out = found if out is None else out.unionByName(found)

    for row in asked.where("vector is not null").select("question_id", "vector", "k").toLocalIterator():
        held.append(row)
        if len(held) == QUESTIONS:
            add(held)
            held = []
    if held or out is None:
        add(held)
    return search.ranked(out, "score", "key", F.col("k"), by=["question_id", "side"]).select("question_id", "side", "key", "score", "rank")


def _similar(rows: DataFrame, questions: list) -> DataFrame:
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast([(r[0], [float(x) for x in r[1]], int(r[2])) for r in questions])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        best: dict[tuple[int, str], list] = {}
        by_size: dict[int, list[int]] = {}
        for i, (_, vector, _) in enumerate(shared.value):
            by_size.setdefault(len(vector), []).append(i)
        for batch in batches:
            keys, sides, vectors = (batch.column(i).to_pylist() for i in range(3))
            for size, places in by_size.items():
                asked = np.array([shared.value[i][1] for i in places])
                for side in set(sides):
                    own = [j for j, v in enumerate(vectors) if sides[j] == side and len(v) == size and None not in v]
                    if not own:
                        continue
                    scores = asked @ np.array([vectors[j] for j in own], float).T
                    for i, line in zip(places, scores, strict=True):
                        k = shared.value[i][2]
                        chosen = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k]) if len(line) > k else range(len(line))
                        kept = best.setdefault((i, side), [])
                        kept += [(-round(float(line[j]), PLACES), keys[own[j]]) for j in chosen]
                        kept.sort()
                        del kept[k:]
        found = [(shared.value[i][0], side, key, -score, shared.value[i][2]) for (i, side), kept in best.items() for score, key in kept]
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(["question_id", "side", "key", "score", "k"], zip(*found, strict=True), strict=True)), schema=schema)

    schema = pa.schema([("question_id", pa.int64()), ("side", pa.string()), ("key", pa.int64()), ("score", pa.float64()), ("k", pa.int64())])
    return rows.select(F.col("key").cast("long").alias("key"), "side", "vector").mapInArrow(run, "question_id long, side string, key long, score double, k long")


def fitness(asked: DataFrame, rows: DataFrame, vector: str) -> DataFrame:
    """question_id, fit, unfit and without: rows whose vector the question can be compared with, whose vector has another dimension (or nulls inside), and those without one. A question without vector fits none."""
    unfit = F.exists(F.col(vector), lambda x: x.isNull())
    sizes = rows.select(F.when(F.col(vector).isNull(), -1).when(unfit, -2).otherwise(F.size(vector)).alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    pairs = asked.select("question_id", F.coalesce(F.size("vector"), F.lit(-3)).alias("own")).crossJoin(F.broadcast(sizes))  # a row for each dimension in use
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    fit = (F.col("size") == F.col("own")) & (F.col("own") >= 0)
    return pairs.groupBy("question_id").agg(count(fit).alias("fit"), count(~fit & (F.col("size") != -1)).alias("unfit"), count(F.col("size") == -1).alias("without"))


def question_terms(questions: DataFrame, k: Column) -> DataFrame:
    """question_id, term and k: tokens and keywords of a question but for single Han characters."""
    own = F.array_distinct(F.filter(F.concat(search_tokens(F.col("question")), Q.keywords(F.col("question"))), lambda t: (t != "") & ~t.rlike(f"^{HAN}$")))
    return questions.select("question_id", k.alias("k"), F.explode(own).alias("term"))


def channels(questions: DataFrame, chunks: DataFrame, index: Index, exact: DataFrame | None = None) -> DataFrame:
    """question_id, side, key, channel (0 exact, 1 lexical, 2 vector), score and rank: each channel's best DEPTH times the size of a result.

    questions: question_id, question, vector; chunks: key, side, vector; exact: question_id, side, key, boost. Exact and
    lexical scores are shares of the question's largest in the side.
    """
    k = Q.result_size(F.col("question")) * DEPTH
    words = lexical(question_terms(questions, k), index)
    most = Window.partitionBy("question_id", "side")
    found = words.withColumn("score", F.col("score") / F.max("score").over(most)).withColumn("channel", F.lit(1))
    near = similar(questions.select("question_id", "vector", k.alias("k")), chunks, "key", "vector", F.col("side"))
    found = found.unionByName(near.withColumn("channel", F.lit(2)))
    if exact is not None:
        sums = exact.groupBy("question_id", "side", "key").agg(F.sum("boost").alias("boosts"))
        scores = sums.withColumn("score", F.least(F.col("boosts") / F.greatest(F.max("boosts").over(most), F.lit(1.0)), F.lit(1.0)))
        sized = scores.join(questions.select("question_id", k.alias("k")), "question_id")
        found = found.unionByName(search.ranked(sized, "score", "key", F.col("k"), by=["question_id", "side"]).select("question_id", "side", "key", "score", "rank").withColumn("channel", F.lit(0)))
    return found


def merged(found: DataFrame) -> DataFrame:
    """question_id, side, key, keyword_score, vector_score and source of the rows of ``channels``."""
    names = F.array(F.lit("exact"), F.lit("lexical"), F.lit("vector"))
    every = found.groupBy("question_id", "side", "key").agg(
        F.max(F.when(F.col("channel") < 2, F.col("score"))).alias("keyword"), F.max(F.when(F.col("channel") == 2, F.col("score"))).alias("vector"), F.count("*").alias("n"), F.min("channel").alias("first")
    )
    source = F.when(F.col("n") > 1, "hybrid").otherwise(F.element_at(names, F.col("first") + 1))
    return every.select("question_id", "side", "key", F.coalesce("keyword", F.lit(0.0)).alias("keyword_score"), F.coalesce("vector", F.lit(0.0)).alias("vector_score"), source.alias("source"))


def reranked(candidates: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates with score (to four places), length, rank and what gates ask for (matched, covers, numeric, counted), the size of the question's result at most of each question and side.

    questions: question_id, question, city; chunks: key, content, hay (all that is searched), title, exact_keys, city, placed,
    chunk_type, object_type, level, role, status, effective. The rarity of a phrase is that among the candidates.
    """
    asked = questions.select("question_id", "question", F.col("city").alias("asked_city"), Q.phrases(F.col("question")).alias("phrases"), Q.land_uses(F.col("question")).alias("asked_uses"))
    read = ["key", "content", "hay", "title", "exact_keys", F.col("city").alias("own_city"), "placed", "chunk_type", "object_type", "level", "role", "status", "effective"]
    own = chunks.select(*read).join(candidates.select("key").distinct(), "key", "left_semi")
    rows = candidates.join(asked, "question_id").join(own, "key")
    same_city = F.coalesce(F.regexp_replace(F.trim("own_city"), "市$", "") == F.regexp_replace(F.trim("asked_city"), "市$", ""), F.lit(False))
    kind = F.col("object_type")
    facts = {
        "hits": F.filter("phrases", lambda p: F.contains("hay", p)),
        "title_hits": F.filter("phrases", lambda p: (F.length(p) >= 3) & F.contains("title", p)),
        "exact_key": F.exists(F.filter("exact_keys", lambda x: F.length(x) >= 3), lambda x: F.contains("question", x)),
        "city_match": same_city & F.col("asked_city").isNotNull(),
        "city_open": F.col("asked_city").isNull(),
        "numeric": Q.has_number(F.col("content")),
        "land_use": F.arrays_overlap("asked_uses", Q.land_uses(F.col("content"))),
        "priority": Q.type_priority(F.col("chunk_type")),
        "intent": Q.intent_score(F.col("question"), F.col("chunk_type"), kind, F.col("content"), F.col("level")),
        "version": V.recency(F.col("status"), F.col("effective")),
        "structured": kind.isNotNull() & (kind != "plain_section"),
        "plain_kind": F.coalesce(kind == "plain_section", F.lit(False)),
        "length": F.length("content"),
        "k": Q.result_size(F.col("question")),
        "matched": (F.col("source") != "vector") & F.arrays_overlap(search_tokens(F.col("hay")), Q.keywords(F.col("question"))),
        "covers": F.exists("asked_uses", lambda u: F.contains(F.upper("content"), u)),
        "counted": F.col("content").rlike(Q.COUNT_ANSWER),
    }
    names = [*candidates.columns, "phrases", *facts, "placed", "role"]
    rows = shared_table(rows.withColumns(facts).select(*names))  # no texts from here on
    group = ["question_id", "side"]
    w = Window.partitionBy(*group)
    counts = rows.select(*group, F.explode("hits").alias("phrase")).groupBy(*group, "phrase").agg(F.count("*").alias("df"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.first("phrases").alias("phrases"))
    weights = sizes.select(*group, "n", F.explode("phrases").alias("phrase")).join(counts, [*group, "phrase"], "left")
    weights = weights.withColumn("idf", F.ln(1 + (F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 0.5))).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("phrase", "idf"))).alias("idf"), F.sum("idf").alias("all_idf"))
    rows = rows.join(weights, group, "left")
    worth = lambda hits: F.coalesce(F.try_divide(F.aggregate(hits, F.lit(0.0), lambda a, p: a + F.col("idf")[p]), F.col("all_idf")), F.lit(0.0))
    flags = {c: F.col(c) for c in ("exact_key", "city_match", "city_open", "numeric", "land_use", "placed", "priority", "intent", "version", "role")}
    score = search.rerank_score(F.col("keyword_score"), F.col("vector_score"), F.col("source"), F.col("length"), worth(F.col("hits")), worth(F.col("title_hits")), plain=F.col("plain_kind") & F.max("structured").over(w), **flags)
    return search.ranked(rows.withColumn("score", score), "score", "key", F.col("k"), by=group).select(*candidates.columns, "score", "length", "rank", "matched", "covers", "numeric", "counted")


def retrieve(questions: DataFrame, chunks: DataFrame, index: Index, exact: DataFrame | None = None) -> DataFrame:
    """question_id, side, rank, key, score, keyword_score, vector_score, source and length of each question's result in each side.

    The columns are those that ``channels`` and ``reranked`` ask for.
    """
    return reranked(merged(shared_table(channels(questions, chunks, index, exact))), questions, chunks)


def gated(results: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, no_access and refusal (a reason or null) of each question, by the best rows of both sides; results: of ``retrieve``."""
    first = F.when(F.col("rank") == 1, F.struct("score", ((F.col("source").isin("exact", "hybrid")) | (F.col("keyword_score") >= gates.STRONG_SHARE) | F.col("matched")).alias("strong")))
    near = (F.col("side") == "accessible") & (F.col("rank") <= gates.EVIDENCE_WINDOW)
    both = results.groupBy("question_id").agg(
        *[F.max(F.when(F.col("side") == side, first)).alias(side) for side in ("accessible", "denied")],
        F.coalesce(F.max(F.when(near, F.col("covers"))), F.lit(False)).alias("covered"),
        F.coalesce(F.max(F.when(near, F.col("numeric") | F.col("counted"))), F.lit(False)).alias("number"),
    )
    n = lambda side: F.col(side).isNotNull().cast("int")
    score, strong = (lambda side: F.coalesce(F.col(f"{side}.score"), F.lit(0.0))), (lambda side: F.coalesce(F.col(f"{side}.strong"), F.lit(False)))
    hidden = gates.no_access(n("denied"), n("accessible"), strong("denied"), strong("accessible"), score("denied"), score("accessible"))
    rows = questions.select("question_id", "question").join(both, "question_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("covered", "number")})
    missing = F.when((F.size(Q.land_uses(F.col("question"))) > 0) & ~F.col("covered"), "no_land_use")
    weak = F.when(n("accessible") == 0, "no_results").when(score("accessible") < gates.EVIDENCE_LEAST, "weak")
    return rows.select("question_id", hidden.alias("no_access"), F.coalesce(weak, missing, F.when(F.col("question").rlike(Q.WANTS_NUMBER) & ~F.col("number"), "no_number")).alias("refusal"))


def debugged(found: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a question: which channels took part, how many rows each gave to the accessible side, and rows whose vectors were set aside.

    found: rows of ``channels``.
    """
    given = found.where("side = 'accessible'").groupBy("question_id").agg(*[F.count(F.when(F.col("channel") == i, 1)).alias(f"n_{name}") for i, name in enumerate(("exact", "lexical", "vector"))])
    rows = questions.select("question_id", "vector").join(given, "question_id", "left").join(fitness(questions, chunks, "vector"), "question_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_exact", "n_lexical", "n_vector", "fit", "unfit", "without")}
    took = F.array_compact(F.array(*[F.when(n[f"n_{c}"] > 0, c) for c in ("exact", "lexical", "vector")]))
    degraded = F.when(F.col("vector").isNull(), "no_question_vector").when(n["fit"] == 0, "no_fitting_rows").when(n["unfit"] + n["without"] > 0, "rows_set_aside")
    return rows.select("question_id", F.array_join(took, ",").alias("channels"), *[c.alias(name) for name, c in n.items()], degraded.alias("degraded"))
