"""Lexical, exact and vector channels, their merge, re-ranking, cut-offs and context budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import exact_key, search_tokens

K1, B = 1.5, 0.75
#: Passages up to this many are looked for all at once; more are found by a key of inner words.
BROADCAST_PASSAGES = 2_000
#: Bytes of passages that are broadcast at a time.
BLOCK_BYTES = 1 << 20


def bm25(rows: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text", side: str | None = None) -> DataFrame:
    """key, score (and side) of rows with a score above 0.

    Only counts of the asked terms leave the scan: term frequencies are taken inside each row, document frequencies and
    the mean length are one small aggregate a side, which is joined back by broadcast.
    """
    terms = list(dict.fromkeys(terms))
    by = [side] if side else []
    tokens = search_tokens(F.col(text))

    def times(term: str) -> Column:
        return F.size(F.filter("tokens", lambda t: t == term))

    counted = rows.select(key, *by, tokens.alias("tokens")).select(
        key, *by, F.size("tokens").alias("length"), *[times(w).alias(f"f{i}") for i, w in enumerate(terms)]
    ).persist()  # a few numbers a row, read by the statistics and by the scores
    stats = counted.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("length").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.join(F.broadcast(stats), by) if by else counted.crossJoin(F.broadcast(stats))  # one row, or one a side

    def part(i: int) -> Column:
        f, df = F.col(f"f{i}").cast("double"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("rows") - df + 0.5) / (df + 0.5))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(0.0)

    return joined.select(key, *by, sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score")).where("score > 0")


def ranked(rows: DataFrame, score: str, key: str, k: int | Column, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """The k rows with the highest score of each group, ties to the smaller key."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def top(rows: DataFrame, score: str, key: str, k: int, name: str = "rank") -> DataFrame:
    """The k rows with the highest score of all, ranked; each task keeps k rows at most."""
    cut = rows.orderBy(F.desc(score), key).limit(k)
    return cut.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), key)))


def merged(exact: DataFrame, lexical: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """One row a key: the larger of the exact and lexical scores, the vector score, and the channel (hybrid if several).

    Each input has key and score, at most one row a key.
    """
    parts = [df.select(key, F.lit(i).alias("channel"), "score") for i, df in enumerate((exact, lexical, vector))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(key).agg(
        F.max(F.when(F.col("channel") < 2, F.col("score"))).alias("keyword"), F.max(F.when(F.col("channel") == 2, F.col("score"))).alias("vector"), F.count("*").alias("channels"), F.min("channel").alias("first")
    )
    names = F.array(F.lit("exact"), F.lit("lexical"), F.lit("vector"))
    source = F.when(F.col("channels") > 1, "hybrid").otherwise(F.element_at(names, F.col("first") + 1))
    return every.select(key, F.coalesce("keyword", F.lit(0.0)).alias("keyword_score"), F.coalesce("vector", F.lit(0.0)).alias("vector_score"), source.alias("source"))


def containing(rows: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """key and passage_key of all rows whose text contains a passage; the key names one row, and a row without key is never found.

    Few passages are looked for all at once, in one go over each text. Many are matched by the four words after their first
    one, which stand whole between blanks in any text that contains the passage: keys and these words are joined, texts only
    for what they find. Passages too short for that are looked for like few ones, in blocks of BLOCK_BYTES.
    """
    rows = rows.where(F.col(key).isNotNull())
    passages = passages.where(F.length(passage) > 0).select(passage_key, passage)
    count, size = passages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(passage)), F.lit(0))).first()
    if count <= BROADCAST_PASSAGES and size <= BLOCK_BYTES:
        return _each_of(rows, passages, key, text, passage_key, passage)
    pieces = F.split(passage, " ")
    short, long = passages.where(F.size(pieces) < 6), passages.where(F.size(pieces) >= 6)
    anchored = long.select(passage_key, F.concat_ws(" ", F.slice(pieces, 2, 4)).alias("anchor"))
    own = F.split(text, " ")
    starts = F.when(F.size(own) >= 4, F.sequence(F.lit(1), F.size(own) - 3)).otherwise(F.array().cast("array<int>"))
    anchors = rows.select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(own, i, 4))))).alias("anchor"))
    likely = anchors.join(anchored, "anchor").select(key, passage_key).distinct()
    found = likely.join(rows.select(key, text), key).join(long, passage_key).where(F.contains(text, F.col(passage))).select(key, passage_key)
    parts = short.agg(F.coalesce(F.ceil(F.sum(F.octet_length(passage)) / BLOCK_BYTES), F.lit(0)).cast("int")).first()[0]
    for part in range(parts):
        found = found.unionByName(_each_of(rows, short.where(F.pmod(F.xxhash64(passage_key), F.lit(parts)) == part), key, text, passage_key, passage))
    return found


def _each_of(rows: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """key and passage_key of rows that contain a passage, all passages looked for in one go over each text."""
    import pyarrow as pa

    known = [(r[0], r[1]) for r in passages.select(passage_key, passage).collect()]  # about BLOCK_BYTES
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kinds = rows.schema[key].dataType.simpleString(), passages.schema[passage_key].dataType.simpleString()

    def run(batches):
        import ahocorasick

        same: dict[str, list] = {}
        for name, value in shared.value:
            same.setdefault(value, []).append(name)
        machine = ahocorasick.Automaton()
        for value, names in same.items():
            machine.add_word(value, names)
        machine.make_automaton()
        for batch in batches:
            out = [(k, name) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for names in {id(n): n for _, n in machine.iter(t or "")}.values() for name in names]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], [key, passage_key])

    from pyspark.sql.pandas.types import to_arrow_type

    types = to_arrow_type(rows.schema[key].dataType), to_arrow_type(passages.schema[passage_key].dataType)
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kinds[0]}, `{passage_key}` {kinds[1]}")


def exact_scores(hits: DataFrame, key: str, boost: str) -> DataFrame:
    """key and score: summed boosts over the largest sum, or over 1 if that is less."""
    sums = hits.groupBy(key).agg(F.sum(boost).alias("boosts"))
    most = sums.agg(F.greatest(F.max("boosts"), F.lit(1.0)).alias("most"))
    return sums.crossJoin(F.broadcast(most)).select(key, F.least(F.col("boosts") / F.col("most"), F.lit(1.0)).alias("score"))


def exact_entries(rows: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """normal_key, key, field and boost of each distinct field value of two characters or more."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"), F.lit(boost).alias("boost")) for name, boost in fields.items()]))
    rows = rows.select(key, each.alias("e")).select(exact_key(F.col("e.value")).alias("normal_key"), key, "e.field", "e.boost")
    return rows.where(F.length("normal_key") >= 2).distinct()


def phrase_idf(rows: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """phrase, df and idf among rows; one pass, one number a phrase."""
    text = F.lower(F.col(text))
    counts = rows.agg(F.count("*").alias("rows"), *[F.sum(F.contains(text, F.lit(p)).cast("long")).alias(f"df{i}") for i, p in enumerate(phrases)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.coalesce(f"df{i}", F.lit(0)).alias("df")) for i, p in enumerate(phrases)]))
    return counts.select("rows", each.alias("p")).select("p.phrase", "p.df", F.ln(1 + (F.col("rows") + 1) / (F.col("p.df") + 0.5)).alias("idf"))


def within_budget(rows: DataFrame, by: str, order: str, size: str, least: int = 5, budget: int = 12_000) -> DataFrame:
    """Rows in order that are among the first ``least`` kept or still fit the budget; one that doesn't is passed over.

    The fold is per group, over order and size alone.
    """
    items = F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>").alias("kept"))

    def add(state: Column, x: Column) -> Column:
        keep = (state["n"] < least) | (state["total"] + x["size"] <= budget)
        return F.struct(
            (state["n"] + keep.cast("long")).alias("n"),
            (state["total"] + F.when(keep, x["size"]).otherwise(0)).alias("total"),
            F.when(keep, F.concat(state["kept"], F.array(x[order]))).otherwise(state["kept"]).alias("kept"),
        )

    kept = rows.groupBy(by).agg(F.aggregate(items, start, add, lambda s: s["kept"]).alias("kept"))
    return rows.join(kept.select(by, F.explode("kept").alias(order)), [by, order])


def rerank_score(keyword: Column, vector: Column, source: Column, length: Column, phrase_share: Column, title_share: Column, **facts: Column) -> Column:
    """Weighted score of a candidate whose content has ``length`` characters, to four places.

    facts (all optional): exact_key, city_match, city_open, numeric, land_use, placed, plain (flags); priority, intent, version
    (0 to 1); role (atomic, summary or fallback).
    """
    flag = lambda name, worth: F.when(facts[name], worth).otherwise(0.0) if name in facts else F.lit(0.0)
    share = lambda name, worth: worth * facts[name] if name in facts else F.lit(0.0)
    role = facts.get("role", F.lit(None).cast("string"))
    total = (
        0.28 * keyword
        + 0.30 * F.greatest(vector, F.lit(0.0))
        + F.when(source == "exact", 0.32).otherwise(0.0)
        + 0.45 * phrase_share * F.least(F.lit(1.0), 180 / F.greatest(length, F.lit(180)))
        + 0.28 * F.least(F.lit(1.0), title_share)
        + flag("exact_key", 0.22)
        + F.when(facts.get("city_match", F.lit(False)), 0.08).when(facts.get("city_open", F.lit(False)), 0.04).otherwise(0.0)
        + flag("numeric", 0.07)
        + flag("land_use", 0.10)
        + flag("placed", 0.05)
        + share("priority", 0.12)
        + share("intent", 0.18)
        + share("version", 0.16)
        + F.when(role == "atomic", 0.04).when(role == "summary", -0.02).when(role == "fallback", -0.08).otherwise(0.0)
        + flag("plain", -0.22)
    )
    return F.round(total, 4)
