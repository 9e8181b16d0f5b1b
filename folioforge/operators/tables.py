"""Tables made of rows: grouping, slices, fields, column types, quality, and sequence operators over rows and blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let


def grouped_tables(rows: DataFrame, table: Sequence[str], order: str, low: Column) -> DataFrame:
    """One row a table: rows, flagged rows, first and last place, and confidence (less 0.1 a flagged row, 0.5 at most)."""
    flagged = F.sum(low.cast("long"))
    confidence = F.round(1 - F.least(F.lit(0.5), 0.1 * flagged), 4)
    return rows.groupBy(*table).agg(F.count("*").alias("n_rows"), flagged.alias("n_flagged"), F.min(order).alias("first_row"), F.max(order).alias("last_row"), confidence.alias("confidence"))


def slices(rows: DataFrame, table: Sequence[str], order: str, most: int = 20) -> DataFrame:
    """The first ``most`` rows of each table in their own order."""
    return rows.withColumn("row_in_slice", F.row_number().over(Window.partitionBy(*table).orderBy(order))).where(F.col("row_in_slice") <= most)


def row_fields(headers: Column, cells: Column) -> Column:
    """Header to trimmed cell, blanks left out; of equal headers the last counts."""
    pairs = F.filter(F.arrays_zip(headers.alias("h"), F.transform(cells, lambda c: F.trim(c)).alias("c")), lambda p: p["h"].isNotNull() & p["c"].isNotNull() & (p["c"] != ""))
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["h"] == p["h"]))
    return let(let(pairs, last), lambda kept: F.map_from_arrays(F.transform(kept, lambda p: p["h"]), F.transform(kept, lambda p: p["c"])))


def headers_in_order(rows: DataFrame, table: Sequence[str], order: str, fields: str) -> DataFrame:
    """Union of the rows' field names by table, in the order of first use."""
    keys = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.map_keys(fields).alias("keys")))), lambda x: x["keys"]))
    return rows.groupBy(*table).agg(F.array_distinct(keys).alias("headers"))


def weighted_type(rows: DataFrame, key: str, text: Column, votes: Sequence[tuple[str, str, float]]) -> DataFrame:
    """key, type and weight: the type with the most weight of fitting patterns, ties to the one named first."""
    kinds = list(dict.fromkeys(v[0] for v in votes))
    sums = {k: sum((F.when(text.rlike(p), w).otherwise(0.0) for n, p, w in votes if n == k), F.lit(0.0)) for k in kinds}
    best = F.greatest(*sums.values(), F.lit(0.0))
    kind = F.coalesce(*[F.when((s == best) & (best > 0), F.lit(k)) for k, s in sums.items()], F.lit("generic"))
    return rows.select(key, kind.alias("type"), best.alias("weight"))


def filled_down(rows: DataFrame, by: Sequence[str], order: str, column: str) -> DataFrame:
    """Nulls of a column take the last value above them that is neither null nor empty; empty values stay."""
    above = F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(column, F.coalesce(F.col(column), above))


def section_paths(blocks: DataFrame, by: str, order: str, level: str, title: str, levels: int = 4) -> DataFrame:
    """blocks with ``section_path``: at each level the last heading that no later heading of a higher level ends."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for n in range(1, levels + 1):
        head = F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(title).alias("title")))
        ends = F.max(F.when(F.col(level) < n, F.col(order))).over(w)
        out = out.withColumn(f"__head{n}", F.last(head, ignorenulls=True).over(w)).withColumn(f"__end{n}", ends)
    parts = [F.when(F.col(f"__end{n}").isNull() | (F.col(f"__head{n}.at") > F.col(f"__end{n}")), F.col(f"__head{n}.title")) for n in range(1, levels + 1)]
    return out.withColumn("section_path", F.concat_ws(" > ", *parts)).drop(*[f"__{x}{n}" for x in ("head", "end") for n in range(1, levels + 1)])


def chained(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """rows with the keys of the ones before and after."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def runs(rows: DataFrame, by: str, order: str, inside: Column) -> DataFrame:
    """Islands of neighbouring rows where ``inside`` holds: by, first, last, n."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("__in", F.coalesce(inside, F.lit(False)))
    marked = marked.withColumn("__new", (F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__in")
    return marked.groupBy(by, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")


def bridged_runs(widths: Column, bridge: int = 2, least: int = 3) -> Column:
    """first (from 0), behind and wide of each run of lines with several cells. widths: cells of each line.

    A run is held to the width of its first line, one more or less; up to ``bridge`` lines of one cell in a row belong to it,
    also at its end. A line of another width ends it and may begin the next. Runs with fewer than ``least`` wide lines are none.
    """
    run = "struct<first:int,behind:int,wide:int>"
    start = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("base"), F.lit(0).alias("gap"), F.lit(0).alias("wide"), F.array().cast(f"array<{run}>").alias("runs"))

    def ended(s: Column, i: Column) -> Column:
        whole = F.struct(s["first"].alias("first"), i.cast("int").alias("behind"), s["wide"].alias("wide"))
        return F.when((s["first"] >= 0) & (s["wide"] >= least), F.concat(s["runs"], F.array(whole))).otherwise(s["runs"])

    def add(s: Column, x: Column) -> Column:
        several = x["n"] > 1
        more = (s["first"] >= 0) & several & (F.abs(x["n"] - s["base"]) <= 1)
        bridged = (s["first"] >= 0) & ~several & (s["gap"] < bridge)
        stays = more | bridged
        return F.struct(
            F.when(stays, s["first"]).when(several, x["i"]).otherwise(-1).alias("first"),
            F.when(stays, s["base"]).otherwise(x["n"]).alias("base"),
            F.when(bridged, s["gap"] + 1).otherwise(0).alias("gap"),
            F.when(more, s["wide"] + 1).when(bridged, s["wide"]).otherwise(several.cast("int")).alias("wide"),
            F.when(stays, s["runs"]).otherwise(ended(s, x["i"])).alias("runs"),
        )

    numbered = F.transform(widths, lambda n, i: F.struct(n.cast("int").alias("n"), i.alias("i")))
    return F.aggregate(numbered, start, add, lambda s: ended(s, F.size(widths)))


def repeated_lines(documents: DataFrame, key: str, text: str, least: int = 3, longest: int = 30) -> DataFrame:
    """line and documents: short lines that stand in ``least`` documents at least."""
    lines = documents.select(key, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))).alias("line")).where((F.length("line") > 0) & (F.length("line") <= longest))
    return lines.groupBy("line").agg(F.countDistinct(key).alias("documents")).where(F.col("documents") >= least)


def parent_codes(codes: DataFrame, by: str, code: str) -> DataFrame:
    """codes with ``parent_code``: the longest proper prefix that is a code of the same table."""
    own = codes.select(by, code).distinct()
    prefixes = own.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1))), lambda n: F.substring(code, F.lit(1), n)))).where(F.col("prefix") != F.col(code))
    found = prefixes.join(own.select(by, F.col(code).alias("prefix")), [by, "prefix"]).groupBy(by, code).agg(F.max_by("prefix", F.length("prefix")).alias("parent_code"))
    return codes.join(found, [by, code], "left")


def packed_sentences(rows: DataFrame, key: str, sentences: str, target: int = 900) -> DataFrame:
    """key, part and content: sentences packed in order into parts that close once they reach ``target`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, s: Column) -> Column:
        joined = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit(" "), s))
        full = F.length(joined) >= target
        return F.struct(F.when(full, F.concat(state["done"], F.array(joined))).otherwise(state["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    parts = F.aggregate(sentences, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return rows.select(key, F.posexplode(parts).alias("part", "content"))


def continued_tables(parts: DataFrame, least: float = 0.75) -> DataFrame:
    """parts with ``table_no``: parts of one logical table share the number of their first.

    parts: doc_id, seq, page_start, page_end, title, headers. A part goes on with the one before if it is on the same or the
    next page, has as many columns, and has a continuation title, the same title, or no title and similar headers.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.lag(F.struct("page_end", "title", "headers")).over(w)
    bare = lambda t: F.regexp_replace(t, "^\\s*续(?=表)|[（(]续[)）]", "")
    names = lambda h: F.array_distinct(F.filter(F.transform(h, lambda x: F.lower(F.regexp_replace(x, "(?U)[\\s（）()：:，,]+", ""))), lambda x: x != ""))
    marked = parts.withColumn("__before", before)
    mine, theirs = names(F.col("headers")), names(F.col("__before.headers"))
    alike = F.when((F.size(mine) > 0) & (F.size(theirs) > 0), F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))).otherwise(0.0)
    title = F.coalesce("title", F.lit(""))
    continued = title.rlike("续表|[（(]续[)）]")
    same = (title != "") & F.coalesce(bare(title) == bare(F.col("__before.title")), F.lit(False))
    goes_on = (F.col("page_start") <= F.col("__before.page_end") + 1) & (F.size("headers") == F.size("__before.headers")) & (continued | same | (((title == "") | continued) & (alike >= least)))
    number = F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("table_no", number).drop("__before")


def continued_rows(rows: DataFrame, table: Sequence[str], order: str, code: str, content: str) -> DataFrame:
    """Rows without a code are appended to the content of the row before them that has one."""
    w = Window.partitionBy(*table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    has = F.coalesce(F.col(code) != "", F.lit(False))
    grouped = rows.withColumn("__row", F.sum(has.cast("int")).over(w)).groupBy(*table, "__row")
    parts = F.array_sort(F.collect_list(F.struct(order, content)))
    return grouped.agg(F.max(code).alias(code), F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p[content]), "").alias(content)).drop("__row")


def grid_statistics(matrix: Column) -> Column:
    """columns used twice or more, fill rate, and the share of rows with the most frequent width (its first of equals)."""
    widths = F.transform(matrix, lambda r: F.size(F.filter(r, lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))))
    width = F.array_max(F.transform(matrix, lambda r: F.size(r)))
    used = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.size(F.filter(matrix, lambda r: F.coalesce(F.trim(F.try_element_at(r, i)) != "", F.lit(False)))))
    filled = F.aggregate(widths, F.lit(0), lambda a, b: a + b)
    common = F.array_max(F.transform(widths, lambda n: F.size(F.filter(widths, lambda m: m == n))))
    cells = F.aggregate(F.transform(matrix, lambda r: F.size(r)), F.lit(0), lambda a, b: a + b)
    return F.struct(F.size(F.filter(used, lambda n: n >= 2)).alias("columns"), F.try_divide(filled, cells).alias("fill"), F.try_divide(common, F.size(matrix)).alias("stable"))


def bound_chunks(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """chunks with row_index: by their own source row, else the first row of their table whose key lies in theirs.

    chunks: doc_id, table_id, chunk_id, source_row_index, row_key; rows: doc_id, table_id, row_index, key.
    """
    direct = rows.select("doc_id", "table_id", F.col("row_index").alias("source_row_index"), F.lit(True).alias("known"))
    marked = chunks.join(direct, ["doc_id", "table_id", "source_row_index"], "left")
    open_ = marked.where("known is null").select("doc_id", "table_id", "chunk_id", "row_key")
    fits = open_.join(rows, ["doc_id", "table_id"]).where((F.length("key") > 0) & F.contains("row_key", "key"))
    first = fits.groupBy("doc_id", "table_id", "chunk_id").agg(F.min("row_index").alias("by_key"))
    out = marked.join(first, ["doc_id", "table_id", "chunk_id"], "left")
    return out.withColumn("row_index", F.when(F.col("known"), F.col("source_row_index")).otherwise(F.col("by_key"))).drop("known", "by_key")


def numbered_rows(rows: DataFrame, table: Sequence[str], order: str, key: str) -> DataFrame:
    """rows with row_type (summary, note or data, by how the key begins) and row_number from 0 in their table."""
    kind = F.when(F.col(key).rlike("^\\s*(?:小计|合计|总计|subtotal|total)"), "summary").when(F.col(key).rlike("^\\s*(?:注|备注|说明|note)"), "note").otherwise("data")
    return rows.withColumn("row_type", kind).withColumn("row_number", F.row_number().over(Window.partitionBy(*table).orderBy(order)) - 1)


def strong_slices(slices: DataFrame, question: str, support: str, least: float = 0.5, share: float = 0.6) -> DataFrame:
    """Slices with at least ``share`` of their question's best support; none if that is below ``least``."""
    best = F.max(support).over(Window.partitionBy(question))
    return slices.withColumn("__best", best).where((F.col("__best") >= least) & (F.col(support) >= share * F.col("__best"))).drop("__best")
