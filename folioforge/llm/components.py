"""Connected components by alternating large and small stars, all in distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import dropped, hot_bound, lookup, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for each long id in links, the smallest id that it is connected with.

    Links may repeat and come in either order; a link of an id with itself, or with null, counts for nothing. Each round
    links every node to the least of its neighbours, first the larger neighbours, then the smaller ones, until nothing
    changes; the rounds grow with the logarithm of the longest path. Every round is written to the shared folder.
    Nodes with very many links are few and looked up by broadcast (see common.lookup); most rounds have none.
    """

    def told(left: DataFrame, nearest: DataFrame) -> DataFrame:
        """left with what nearest, a stored table, has of its u."""
        most = nearest.agg(F.max("n")).first()[0] or 0
        return lookup(left, nearest, "u", "n", bound) if most > bound else left.join(nearest.drop("n"), "u")

    now = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    bound = hot_bound(2 * state[0])
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count("*").alias("n")))
        large = stored(told(both, near).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        nearest = stored(large.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")))
        moved = told(large, nearest).where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = stored(moved.unionByName(nearest.select("u", F.col("least").alias("v"))).distinct())
        dropped(now, near, large, nearest)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
