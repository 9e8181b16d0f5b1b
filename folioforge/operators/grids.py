"""Grids, boxes and rows of a page as expressions over arrays.

A grid is an array of rows of cells; a box is a struct of y0, x0, y1 and x1, so that boxes sort from the top down, then from
the left. A page holds a few hundred cells or boxes; each function works within one page and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<y0:double,x0:double,y1:double,x1:double>"
#: Shares of the smaller box above which two boxes are one region, and what separates tables in one region.
SAME_REGION, SAME_CANDIDATE, LEAST_GAP, GAP_HEIGHTS = 0.6, 0.5, 36.0, 3.2


def _filled(cell: Column) -> Column:
    return F.coalesce(cell != "", F.lit(False))


def _places(n: Column) -> Column:
    """1 to n; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def padded(rows: Column) -> Column:
    """Rows of one width, with empty cells at the end."""
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), _width(rows) - F.size(r))))


def used_cells(rows: Column) -> Column:
    """How many filled cells each column has."""
    return F.transform(_places(_width(rows)), lambda i: F.size(F.filter(rows, lambda r: _filled(F.try_element_at(r, i)))))


def _inner(items: Column, inside: Column) -> Column:
    """items from the first to the last place where ``inside``, an array of flags, is true."""
    first, behind = F.array_position(inside, True), F.array_position(F.reverse(inside), True)
    length = (F.size(inside) - behind - first + 2).cast("int")
    return F.when(first > 0, F.slice(items, F.greatest(first, F.lit(1)).cast("int"), F.greatest(length, F.lit(0)))).otherwise(F.slice(items, 1, 0))


def trimmed_grids(rows: DataFrame, grid: str) -> DataFrame:
    """rows with the column ``grid`` padded, without empty edges, then without sparse columns.

    Of grids with three columns and three rows or more, columns with fewer than two filled cells go (of eight by eight or
    more: fewer than three or a quarter), unless fewer than two columns would stay.
    """
    out = rows.withColumn("__even", padded(F.col(grid)))
    out = out.withColumn("__body", _inner(F.col("__even"), F.transform("__even", lambda r: F.exists(r, _filled))))
    out = out.withColumn("__used", F.transform(used_cells(F.col("__body")), lambda n: n > 0))
    out = out.withColumn("__grid", F.transform("__body", lambda r: _inner(r, F.col("__used"))))
    out = out.withColumn("__used", used_cells(F.col("__grid")))
    n, columns = F.size("__grid"), F.size("__used")
    least = F.when((n >= 8) & (columns >= 8), F.greatest(F.lit(3), F.ceil(n * 0.25))).otherwise(2)
    out = out.withColumn("__keep", F.filter(_places(columns), lambda i: F.element_at("__used", i) >= least))
    narrow = F.transform("__grid", lambda r: F.transform("__keep", lambda i: F.element_at(r, i)))
    fits = (columns > 2) & (n >= 3) & (F.size("__keep") >= 2)
    return out.withColumn(grid, F.when(fits, narrow).otherwise(F.col("__grid"))).drop("__even", "__body", "__used", "__grid", "__keep")


def figures(grid: Column) -> Column:
    """rows, columns with two filled cells or more, and the share of filled cells."""
    used = used_cells(grid)
    total = F.aggregate(used, F.lit(0), lambda a, b: a + b)
    return F.struct(F.size(grid).alias("rows"), F.size(F.filter(used, lambda n: n >= 2)).alias("columns"), F.coalesce(F.try_divide(total, F.size(grid) * F.size(used)), F.lit(0.0)).alias("fill"))


def chosen_grids(rows: DataFrame, lines: str, text: str) -> DataFrame:
    """rows with ``choice``, lines or text, and ``skipped``: whether the grid of lines fell behind for its empty cells."""
    out = rows.withColumn("__a", figures(F.col(lines))).withColumn("__b", figures(F.col(text)))
    a, b = (lambda name: F.col(f"__a.{name}")), (lambda name: F.col(f"__b.{name}"))
    empty = (a("rows") == 0) | (b("rows") == 0)
    finer = (a("columns") >= b("columns") + 2) | ((a("rows") >= b("rows") * 1.4) & (a("columns") >= b("columns")))
    hollow = ~empty & ~finer & (a("fill") + 0.12 < b("fill")) & (a("columns") <= b("columns") + 1)
    choice = F.when(a("rows") == 0, "text").when((b("rows") == 0) | finer, "lines").when(hollow | (a("columns") < b("columns")), "text").otherwise("lines")
    return out.withColumn("choice", choice).withColumn("skipped", hollow).drop("__a", "__b")


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller box that two boxes have in common."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    area = lambda box: (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, side("x0", "x1") * side("y0", "y1") / smaller).otherwise(0.0)


def joined_regions(first: Column, second: Column, most: float = SAME_REGION) -> Column:
    """All boxes of first, then each of second in order that no kept box covers by more than ``most``."""
    return F.aggregate(second, first, lambda kept, box: F.when(F.exists(kept, lambda k: overlap(k, box) > most), kept).otherwise(F.concat(kept, F.array(box))))


def best_regions(candidates: Column) -> Column:
    """Boxes of candidates (structs that sort from the best down, with a field ``box``) that no better kept one covers, or lies in, by half."""
    return joined_regions(F.array().cast(f"array<{BOX}>"), F.transform(F.array_sort(candidates), lambda c: c["box"]), SAME_CANDIDATE)


def gap_spans(rows: Column) -> Column:
    """First row (from 0) and number of rows of each part that a wide gap separates. rows: structs of y and bottom, from the top down.

    A gap has 3.2 mean heights and 36 points or more, and two rows on both sides of it; fewer than six rows are one part.
    """
    n = F.size(rows)
    height = F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["bottom"] - r["y"]) / n
    least = F.greatest(height * GAP_HEIGHTS, F.lit(LEAST_GAP))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(None).cast("double").alias("bottom"), F.array().cast("array<int>").alias("cuts"))

    def add(state: Column, r: Column) -> Column:
        cut = F.coalesce((r["y"] - state["bottom"] >= least) & (state["i"] - state["start"] >= 2) & (n - state["i"] >= 2), F.lit(False))
        cuts = F.when(cut, F.concat(state["cuts"], F.array(state["i"]))).otherwise(state["cuts"])
        return F.struct((state["i"] + 1).alias("i"), F.when(cut, state["i"]).otherwise(state["start"]).alias("start"), r["bottom"].alias("bottom"), cuts.alias("cuts"))

    cuts = F.when(n >= 6, F.aggregate(rows, start, add, lambda s: s["cuts"])).otherwise(F.array().cast("array<int>"))
    both = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("first"), F.concat(cuts, F.array(n)).alias("end"))
    return F.transform(both, lambda s: F.struct(s["first"].alias("first"), (s["end"] - s["first"]).alias("rows")))


def column_starts(xs: Column, tolerance: Column, least: int = 2) -> Column:
    """Whole centres of the clusters of sorted numbers, each within tolerance of the mean of its cluster so far, with ``least`` members."""

    def add(state: Column, x: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        near = F.coalesce(F.abs(x - last["total"] / last["n"]) <= tolerance, F.lit(False))
        grown = F.concat(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))), F.array(F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))))
        return F.when(near, grown).otherwise(F.concat(state, F.array(F.struct(x.alias("total"), F.lit(1).alias("n")))))

    found = F.aggregate(xs, F.array().cast("array<struct<total:double,n:int>>"), add)
    return F.transform(F.filter(found, lambda c: c["n"] >= least), lambda c: F.floor(c["total"] / c["n"] + 0.5))
