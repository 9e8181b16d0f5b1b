"""Near-duplicate vectors by random-hyperplane sign hashing, confirmed by exact cosine.

Vectors are compared with others of the same label and dimension. Equal vectors form a class, counted once. A table
hashes a vector to the signs of its products with ``bits`` random hyperplanes; there are as many tables as a pair at the
threshold needs to meet in one of them but for MISSED. Vectors of one bucket are compared exactly, in double precision.
Vectors travel packed, as they were given. A pair counts in the first table where it meets, so links are counted without writing out the pairs of a group; a bucket
passes on each vector's number of links and the root of its part of the bucket, which joins into components.

Defined results: a vector that is null, zero, or holds null or non-finite components, or has a null label or id, is
linked with nothing. Repeated rows are vectors of their own and link with each other. A null id has a null component and
is kept. Other columns are not read.

Scale: the hyperplanes follow the largest label, so that buckets stay small. Buckets with a large share of all rows are
few; they are cut into blocks of BLOCK vectors that are compared block by block in different tasks, and every task works
on BLOCK by BLOCK products at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import hot_bound, lookup, stored
from folioforge.llm.components import components

BLOCK, BUCKET, MISSED, MOST_BITS = 1024, 256, 1e-6, 24
#: Room for rounding where products of whole blocks are compared with the threshold, before the exact comparison.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def tables_for(bits: int, least: float) -> int:
    together = (1 - acos(least) / pi) ** bits
    return ceil(log(MISSED) / log(1 - together))


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, tables]).standard_normal((dim, bits * tables))


def _rows_of(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binaries of one length as the rows of a matrix, without a Python object a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def hashed(classes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """classes with codes (the bucket of each table), code_bytes (the same, packed) and the vector packed as ``kind``."""
    small = "u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            ends = batch.column("vector").offsets.to_numpy()
            values = batch.column("vector").flatten().to_numpy()
            dims = np.diff(ends)
            codes = np.zeros((len(batch), tables), np.int32)
            packed: list[bytes] = [b""] * len(batch)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = values[(ends[at] - ends[0])[:, None] + np.arange(dim)]
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, bits, tables)
                codes[at] = ((x @ planes[dim]).reshape(len(at), tables, bits) >= 0) @ weights
                for i, row in zip(at.tolist(), x.astype(kind), strict=True):
                    packed[i] = row.tobytes()
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            columns = [*(batch.column(c) for c in ("class", "label", "rep", "copies")), pa.array(dims.astype(np.int32)), pa.array(packed, pa.binary()), each, pa.array([c.tobytes() for c in codes.astype(small)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "label", "rep", "copies", "dim", "vector", "codes", "code_bytes"])

    return classes.mapInArrow(run, "class string, label int, rep long, copies long, dim int, vector binary, codes array<int>, code_bytes binary")


def _joined(table: int, x: np.ndarray, y: np.ndarray, norms: tuple, codes: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs that meet in no earlier table."""
    i, j = np.nonzero(x @ y.T >= (least - SLACK) * np.outer(*norms))
    near = (x[i] * y[j]).sum(1) / (norms[0][i] * norms[1][j]) >= least
    first = ~(codes[0][i, :table] == codes[1][j, :table]).any(1) if table else np.ones(len(i), bool)
    return i[near & first], j[near & first]


def compared(rows: DataFrame, least: float, kind: str) -> DataFrame:
    """class, links, rep, root: what each bucket (or pair of blocks) adds to each of its vectors."""

    def bucket(table: int, part: pa.Table) -> pa.Table | None:
        n = len(part)
        x = _rows_of(part["vector"], kind).astype(np.float64)
        codes, copies, block = _rows_of(part["code_bytes"], f"<u{len(part['code_bytes'][0].as_py()) // part['tables'][0].as_py()}"), part["copies"].to_numpy(), part["block"].to_numpy()
        norm = np.sqrt((x * x).sum(1))
        one, two = part["one"][0].as_py(), part["two"][0].as_py()
        links, root = np.zeros(n, np.int64), np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, n, BLOCK):
            for b in range(a, n, BLOCK):
                s, t = slice(a, a + BLOCK), slice(b, b + BLOCK)
                i, j = _joined(table, x[s], x[t], (norm[s], norm[t]), (codes[s], codes[t]), least)
                i, j = i + a, j + b
                fits = (i < j) & (((block[i] == one) & (block[j] == two)) | ((block[i] == two) & (block[j] == one)))
                i, j = i[fits], j[fits]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                if len(i):
                    # a vector's edge to the least it links with, and those of the least's others: enough to join them
                    found.append((i, j))
                if sum(len(f[0]) for f in found) > 4_000_000:
                    found = [_forest(found, root)]
        if not found:
            return None
        _forest(found, root)
        hit = np.flatnonzero(links > 0)
        rep = part["rep"].to_numpy()
        return pa.table({"class": part["class"].combine_chunks().take(pa.array(hit)), "links": links[hit], "rep": rep[hit], "root": rep[root[hit]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key = part["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            out = [r for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 and (r := bucket(part["table"][a].as_py(), part.slice(a, b - a))) is not None]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            changes = np.flatnonzero(np.diff(held["key"].to_numpy()))
            if len(changes):
                yield from done(held.slice(0, int(changes[-1]) + 1))
                held = held.slice(int(changes[-1]) + 1)
        if held is not None:
            yield from done(held)

    return rows.mapInArrow(run, "class string, links long, rep long, root long")


def _forest(found: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry the least position along the pairs until root names the parts they join; the pairs that stand for it."""
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        for side in (root[i], root[j], i, j):
            np.minimum.at(root, side, least)
        root[:] = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(root)))
    return root[own], own


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row. vectors: vec_id, embedding, label."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    key = F.concat(F.hex(F.xxhash64("label", "vector")), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), "vector", "label")))
    rows = stored(rows.withColumn("class", F.when(fit, F.when(squares > 0, key))))
    valid = rows.where("class is not null")
    classes = valid.groupBy("class").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stored(classes)
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = min(MOST_BITS, max(3, round(log2(max(largest / BUCKET, 1)))))
    tables = tables_for(bits, least)
    # vectors travel as they were given: floats are doubles without loss
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    coded = stored(hashed(classes.select("class", "label", "rep", "copies", "vector"), bits, tables, kind))
    buckets = coded.select("*", F.posexplode("codes").alias("table", "code")).withColumn("bucket", F.xxhash64("label", "dim", "table", "code")).drop("code", "codes", "label")
    # few buckets can hold a large share of the rows: they are cut into blocks
    bound = hot_bound(classes.count() * tables, 4096, BLOCK)
    large = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = buckets.join(F.broadcast(large), "bucket", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("class"), F.col("blocks"))).otherwise(0).cast("int"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", F.explode(pairs)).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    dealt = dealt.withColumn("key", F.xxhash64("bucket", "one", "two")).select("key", "table", F.lit(tables).alias("tables"), "class", "rep", "copies", "vector", "code_bytes", "block", "one", "two")
    found = stored(compared(dealt.repartition("key").sortWithinPartitions("key"), least, kind))
    joined = components(found.select("rep", "root"), "rep", "root")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    told = classes.select("class", "rep", "copies").join(links, "class", "left").join(joined, F.col("rep") == F.col("node"), "left")
    told = told.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "copies")
    linked = lookup(valid.select("vec_id", "class"), told, "class", "copies", hot_bound(rows.count()))
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
