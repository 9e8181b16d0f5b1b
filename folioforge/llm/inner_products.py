"""Exact top-k search by inner product.

Candidates are sorted by descending length and packed into blocks. Vectors are rotated by the eigenvectors of their
second moments (the right singular vectors of all vectors), so that the first few rotated components hold most of every
product; what the rest can add is bounded by the product of the remaining lengths (Cauchy-Schwarz). The k-th best score of
each query starts from the LONGEST candidates, which are scored first: blocks whose longest vector can't reach it for any
query of a block of queries are never paired with that block. A pair of blocks meets in one task, in pieces of descending
length; a piece is left out where even its longest vector can't reach a query's k-th best score so far, and single
candidates where the partial sum plus the bound can't. Survivors are scored exactly.

A vector's components become floor(scale * x), whole numbers of any size; those that leave the range of a double become
its largest value. Scores are exact integers, by doubles where no sum can reach 2**53, by 64-bit integers below 2**62,
else by Python's; they are held to the range of a long, and bounds that overflow leave nothing out.

Defined results: vectors that are null or empty, hold null or non-finite components, or have a null id take no part; nor
do vectors of another dimension than the query's. Rows with the query's id are all the query's own. Repeated rows of a
candidate count each; a query that is repeated unchanged is answered once. Ties go to the smaller id.

Scale: blocks hold up to BLOCK_BYTES of vectors and travel once a pair of blocks on the side of the queries, once in all on
the side of the candidates. What is broadcast is LONGEST vectors, a rotation a dimension, and a row for each dimension and
level of length (an eighth of a doubling).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored
from folioforge.llm.embeddings import usable

QUERIES, PIECE, LONGEST, ENERGY = 512, 512, 2048, 0.8
#: The largest block of candidates; of how many vectors follows from their dimension.
BLOCK_BYTES = 8 << 20
EXACT, LARGEST = 2.0**53, 1.7976931348623157e308
#: Longer vectors would overflow the sums of squares; they are scored without bounds.
MEASURED = 1e150


def scaled(vectors: DataFrame, scale: float, key: str, column: str) -> DataFrame:
    """id, vector (whole numbers as doubles), dim and length (at most MEASURED) of the vectors that take part."""
    rows = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.greatest(F.least(x * scale, F.lit(LARGEST)), F.lit(-LARGEST))))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("id", "vector", F.size("vector").alias("dim"), F.least(F.sqrt(squares), F.lit(MEASURED)).alias("length"))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The vectors of rows of one dimension."""
    column = batch.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(batch), -1)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: eigenvectors of the second moments by descending value. The sums have dim x dim numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, fit = batch.column("dim").to_numpy(), batch.column("length").to_numpy() < MEASURED
            for dim in np.unique(dims[fit]).tolist():
                x = _matrix(batch.filter(pa.array(fit & (dims == dim))))
                sums[dim] = sums.get(dim, 0) + x.T @ x
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(sums), pa.int32()), "at": pa.array([list(range(d * d)) for d in sums], pa.list_(pa.int32())), "value": pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))})

    parts = rows.select("dim", "length", "vector").mapInArrow(add, "dim int, at array<int>, value array<double>")
    cells = parts.select("dim", F.explode(F.arrays_zip("at", "value")).alias("x")).groupBy("dim", "x.at").agg(F.sum("x.value").alias("value"))
    out = {}
    found = cells.toPandas()
    for dim, part in found.groupby("dim"):
        moments = np.zeros(dim * dim)
        moments[part["at"].to_numpy()] = part["value"].to_numpy()
        moments = moments.reshape(dim, dim)
        values, vectors = np.linalg.eigh((moments + moments.T) / 2)
        out[int(dim)] = vectors[:, ::-1], values[::-1]
    return out


def level_of(length: Column) -> Column:
    """A number that grows with the length, eight to a doubling; the lengths of a level are below ``2 ** ((level + 1) / 8)``."""
    return F.floor(F.log2(F.greatest(length, F.lit(1e-9))) * 8).cast("int")


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of neighbouring rows of one dimension: dim, length (the longest), ids, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                size = max(PIECE, BLOCK_BYTES // (8 * dim))
                for start in range(0, len(own), size):
                    part = own.slice(start, size)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([dim], pa.int32()),
                            "length": pa.array([part.column("length").to_numpy().max()]),
                            "ids": pa.array([part.column("id").to_numpy().tobytes()], pa.binary()),
                            "vectors": pa.array([_matrix(part).tobytes()], pa.binary()),
                        }
                    )

    return rows.mapInArrow(run, "dim int, length double, ids binary, vectors binary")


def asked_blocks(queries: DataFrame, seeds: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Blocks of queries: dim, reach (the least length that can matter to one of them), ids, vectors, floors.

    A query's floor is the k-th best score among the seeds, which so many candidates reach.
    """
    shared = queries.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_dims = np.array([len(v) for _, v in shared.value])
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                at = np.flatnonzero(seed_dims == dim)
                s_ids = np.array([shared.value[i][0] for i in at], np.int64)
                s = np.array([shared.value[i][1] for i in at]).reshape(-1, dim)
                for start in range(0, len(own), QUERIES):
                    part = own.slice(start, QUERIES)
                    ids, x, length = part.column("id").to_numpy(), _matrix(part), part.column("length").to_numpy()
                    floors = np.full(len(x), -np.inf)
                    for i in range(len(x)):
                        others = s[s_ids != ids[i]]
                        if len(others) >= k:
                            floors[i] = float(np.sort(exact_scores(x[i], others))[-k])
                    # a candidate of length l adds l times the query's length at most
                    least = np.where((floors > 0) & (length < MEASURED), floors * (1 - 1e-9) / np.maximum(length, 1e-300), 0.0)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([dim], pa.int32()),
                            "reach": pa.array([float(least.min())]),
                            "ids": pa.array([ids.tobytes()], pa.binary()),
                            "vectors": pa.array([x.tobytes()], pa.binary()),
                            "floors": pa.array([floors.tobytes()], pa.binary()),
                        }
                    )

    return queries.mapInArrow(run, "dim int, reach double, ids binary, vectors binary, floors binary")


def exact_scores(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with the rows of x."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.sqrt(query @ query) * np.sqrt((x * x).sum(1).max(initial=0))
    if bound < EXACT:
        return (x @ query).astype(np.int64)
    if bound < 2.0**62 and max(abs(query).max(initial=0), abs(x).max(initial=0)) < 2.0**62:
        return x.astype(np.int64) @ query.astype(np.int64)
    own = [int(a) for a in query.tolist()]
    whole = [sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in x.tolist()]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores.astype(np.float64) if len(scores) and abs(scores).max() < EXACT else [-int(s) for s in scores]))[:k]


def scan(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, floor: np.ndarray, rotation: tuple, k: int) -> list[tuple[int, int, int]]:
    """(query position, id, score) of up to k best candidates for each query; floor: scores that at least k candidates reach."""
    axes, values = rotation
    head = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), ENERGY)) + 1
    floor = floor.copy()
    top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    # a bound that overflows is infinite or no number: only what is surely below a floor is left out
    with np.errstate(over="ignore", invalid="ignore"):
        qr, cr = q @ axes, c @ axes
        q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
        q_length, c_length = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
        order = np.argsort(-c_length, kind="stable")
        for start in range(0, len(order), PIECE):
            piece = order[start : start + PIECE]
            slack = 1e-9 * q_length * c_length[piece[0]] + 1e-6
            alive = np.flatnonzero(~(q_length * c_length[piece[0]] + slack < floor))
            if not len(alive):
                break
            partial = qr[alive, :head] @ cr[piece, :head].T + np.outer(q_rest[alive], c_rest[piece]) + slack[alive, None]
            open_to = ~(partial < floor[alive, None]) & (q_ids[alive, None] != c_ids[piece][None, :])
            for row in np.flatnonzero(open_to.any(1)):
                i, at = alive[row], piece[open_to[row]]
                ids, scores = np.concatenate((top[i][0], c_ids[at])), np.concatenate((top[i][1], exact_scores(q[i], c[at])))
                keep = best(ids, scores, k)
                top[i] = ids[keep], scores[keep]
                if len(keep) == k:
                    floor[i] = max(floor[i], float(scores[keep[-1]]))
    return [(i, int(a), int(s)) for i, (ids, scores) in enumerate(top) for a, s in zip(ids, scores, strict=True)]


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest scores for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors.select(key, column), scale, key, column))
    rotation = rotations(rows)
    longest = rows.orderBy(F.desc("length"), "id").limit(LONGEST).collect()  # LONGEST rows at most
    queries = rows.where(F.expr(is_query.replace(key, "id"))).dropDuplicates(["id", "vector"])
    ordered = rows.repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")
    blocks = stored(packed(ordered).withColumn("block", F.monotonically_increasing_id()).withColumn("level", level_of(F.col("length"))))
    asked = stored(asked_blocks(queries.sortWithinPartitions("dim", "id"), [(r.id, r.vector) for r in longest], k))
    # a key for about each block: its dimension, level of length, and one of as many salts as the level has blocks
    levels = blocks.groupBy("dim", "level").agg(F.count("*").alias("salts"), F.max("length").alias("most"))
    keyed = blocks.join(F.broadcast(levels.drop("most")), ["dim", "level"]).withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")))
    pairs = asked.join(F.broadcast(levels), "dim").where("most >= reach").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1L)")))
    at = F.xxhash64("dim", "level", "salt").alias("key")
    none = F.lit(None).cast("binary")
    sides = keyed.select(at, F.lit(0).alias("side"), "dim", "ids", "vectors", none.alias("floors")).unionByName(pairs.select(at, F.lit(1).alias("side"), "dim", "ids", "vectors", "floors"))
    shared = spark.sparkContext.broadcast(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                r = {name: batch.column(name)[i].as_py() for name in ("key", "side", "dim", "ids", "vectors", "floors")}
                dim = r["dim"]
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
                if r["side"] == 0:
                    held = [*(held if key == r["key"] else []), (dim, ids, x)]
                    key = r["key"]
                    continue
                if key != r["key"]:
                    continue
                floors = np.frombuffer(r["floors"], np.float64)
                axes = shared.value.get(dim) or (np.eye(dim), np.ones(dim))
                for _, c_ids, c in (h for h in held if h[0] == dim):
                    found = scan(ids, x, c_ids, c, floors, axes, k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": pa.array([int(ids[i]) for i, _, _ in found], pa.int64()),
                            "print": pa.array([int.from_bytes(blake2b(x[i].tobytes(), digest_size=7).digest()) for i, _, _ in found], pa.int64()),
                            "vec_id": pa.array([a for _, a, _ in found], pa.int64()),
                            "score": pa.array([s for _, _, s in found], pa.int64()),
                        }
                    )

    found = sides.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "query_id long, print long, vec_id long, score long")
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
