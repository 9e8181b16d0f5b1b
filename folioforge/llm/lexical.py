"""Ranked lexical search by norm buckets of impact vectors.

A document's impact vector has, for each term that some query asks for, the whole number that the term adds to a score;
a query is the vector of ones over its terms, so a score is their inner product. Documents are ordered by the length of
their vectors and read in buckets. Cauchy-Schwarz bounds a score by the product of both lengths, so a bucket whose
longest vector can't reach a query's floor, the lowest score among its best so far, is passed over with all shorter ones.
Inside a bucket coordinates bound it: those of the query's terms that together, at the most that any document of the bucket
has, stay below the floor can't lift a document alone, so it needs another one. What the others give is added up, and the
remainder is bounded by these sums and by the lengths of both remainders. What survives is scored in whole numbers. The longest vectors are searched first, which sets floors for
all tasks; the least length that a floor leaves is a filter on the scan of the others.

Defined results: a null or empty text has no terms; such documents aren't counted and are never found. Repeated rows are
documents of their own. Rows with a null key count, and come last among equal scores. A query without terms finds nothing;
queries that share an id are answered each. Other columns are not read.

Scale: queries are a stated set and are answered in blocks of MOST_PAIRS pairs of query and term; a block's terms are what
is broadcast. A block reads the texts once. Only terms and counts of documents are written and dealt out, in an order that
splits equal lengths. Every task keeps the best of each query, and these are cut again in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored
from folioforge.llm.hashing import mixed

#: Pairs of query and term in a block, documents in a bucket, and the share of documents that sets the first floors.
MOST_PAIRS, BUCKET, FIRST = 1 << 18, 1024, 64
PARTS = 64
#: Lengths and bounds are doubles: room for their rounding.
ROOM = 1 + 1e-9

_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters past ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_LOWERED).split()


def blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries (id, distinct terms) in blocks of about MOST_PAIRS terms; the driver holds one block."""
    held, size = [], 0
    for row in items.toLocalIterator():
        terms = sorted(set(terms_of(row.text)))
        if terms:
            held.append((row.id, terms))
            size += len(terms)
        if size >= MOST_PAIRS:
            yield held
            held, size = [], 0
    if held:
        yield held


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """A row for each document with terms: key, n, salt, terms (int32) and counts (int32) of the vocabulary; and a row for each term and task: term, df (term -1: documents, -2: all terms)."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        df, documents, length, done = np.zeros(len(number), np.int64), 0, 0, TaskContext.get().partitionId() << 33
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("salt", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("term", pa.int32()), ("df", pa.int64())])

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                kept, sizes, terms, counts = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    if not words:
                        continue
                    found = [(number[w], c) for w, c in Counter(words).items() if w in number]
                    own = np.array(found, np.int32).reshape(-1, 2)
                    own = own[own[:, 0].argsort()]
                    df[own[:, 0]] += 1
                    documents, length = documents + 1, length + len(words)
                    if len(own):
                        kept.append(i)
                        sizes.append(len(words))
                        terms.append(own[:, 0].tobytes())
                        counts.append(own[:, 1].tobytes())
                salt = mixed(np.arange(done, done + len(kept)).astype(np.uint64), 70).view(np.int64)
                done += len(kept)
                yield rows(key=part.column(0).take(pa.array(kept, pa.int64())).cast(pa.int64()), n=pa.array(sizes, pa.int64()), salt=pa.array(salt), terms=pa.array(terms, pa.binary()), counts=pa.array(counts, pa.binary()))
        seen = np.flatnonzero(df)
        yield rows(term=pa.array([*seen.tolist(), -1, -2], pa.int32()), df=pa.array([*df[seen].tolist(), documents, length], pa.int64()))

    return docs.mapInArrow(run, "key long, n long, salt long, terms binary, counts binary, term int, df long")


class Weights:
    """Impacts of the terms of a block over the whole corpus."""

    def __init__(self, vocabulary: int, df: dict[int, int]) -> None:
        self.documents, self.length = df.get(-1, 0), df.get(-2, 0)
        self.weight = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(vocabulary)], np.int64)

    def impacts(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What each term adds. n: terms of each document; sizes: how many of terms and counts are a document's."""
        m = 50 + np.array([50 * x * self.documents // self.length for x in n.tolist()], np.int64)
        tf = counts.astype(np.int64)
        return self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)))


def _unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.column("n").to_numpy()
    data = batch.column("terms").to_pylist()
    sizes = np.array([len(x) // 4 for x in data], np.int64)
    return n, sizes, np.frombuffer(b"".join(data), np.int32), np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32)


def by_length(rows: DataFrame, weights: Weights) -> DataFrame:
    """rows of ``vectors`` with the length of their impact vectors, ordered by it, longest first."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, terms, counts = _unpacked(batch)
            squares = shared.value.impacts(n, sizes, terms, counts).astype(float) ** 2
            length = np.sqrt(np.add.reduceat(squares, np.cumsum(sizes) - sizes)) * ROOM if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], [*batch.schema.names, "length"])

    full = rows.mapInArrow(run, "key long, n long, salt long, terms binary, counts binary, length double").where("length > 0")
    return full.repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(F.desc("length"), "salt")


class Best:
    """The first ``most`` documents of a query so far, and its floor: scores below it don't matter."""

    def __init__(self, most: int, floor: int) -> None:
        self.most, self.floor = most, floor
        self.score, self.key, self.unset = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, key: np.ndarray, unset: np.ndarray) -> None:
        self.score, self.key, self.unset = np.append(self.score, score), np.append(self.key, key), np.append(self.unset, unset)
        if len(self.score) > self.most:
            order = np.lexsort((self.key, self.unset, -self.score))[: self.most]
            self.score, self.key, self.unset = self.score[order], self.key[order], self.unset[order]
            self.floor = max(self.floor, int(self.score[-1]))


class Bucket:
    """Documents of neighbouring lengths, with the coordinates of each and of each term."""

    def __init__(self, table: pa.Table, weights: Weights) -> None:
        n, self.sizes, self.terms, counts = _unpacked(table)
        self.impact = weights.impacts(n, self.sizes, self.terms, counts)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.length = table.column("length").to_numpy()
        self.unset = table.column("key").is_null().to_numpy(zero_copy_only=False)
        self.key = table.column("key").fill_null(0).to_numpy()
        doc = np.repeat(np.arange(len(n)), self.sizes)
        order = np.argsort(self.terms, kind="stable")
        self.doc, self.of_term = doc[order], self.impact[order]
        self.term, self.start = np.unique(self.terms[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))
        self.most = np.maximum.reduceat(self.of_term, self.start)

    def survivors(self, query: np.ndarray, floor: int) -> np.ndarray:
        """Positions of documents that may score at least floor."""
        at = np.minimum(np.searchsorted(self.term, query), len(self.term) - 1)
        held = at[self.term[at] == query]
        held = held[np.argsort(self.most[held], kind="stable")]
        below = np.cumsum(self.most[held])
        rest = int(np.searchsorted(below, floor))  # what these coordinates give together stays below the floor
        if rest == len(held):
            return np.zeros(0, np.int64)
        given, square = np.zeros(len(self.length), np.int64), np.zeros(len(self.length))
        for a, b in zip(self.start[held[rest:]], self.end[held[rest:]], strict=True):
            given[self.doc[a:b]] += self.of_term[a:b]  # a document has a term once
            square[self.doc[a:b]] += self.of_term[a:b].astype(float) ** 2
        near = np.flatnonzero((given > 0) & (math.sqrt(len(held)) * ROOM * self.length >= floor))
        left = math.sqrt(rest) * np.sqrt(np.maximum(self.length[near] ** 2 * ROOM - square[near], 0)) * ROOM
        return near[given[near] + np.minimum(left, below[rest - 1] if rest else 0) >= floor]

    def scores(self, places: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of the documents at places; asked: which terms the query has."""
        sizes = self.sizes[places]
        entries = np.repeat(self.at[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(np.where(asked[self.terms[entries]], self.impact[entries], 0), np.cumsum(sizes) - sizes)


def searched(rows: DataFrame, queries: list[np.ndarray], ids: list[int], weights: Weights, floors: list[int], most: int) -> DataFrame:
    """query (its place in the block), id, part, key and score: each task's best of each query, none below the floors."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, floors = shared.value
        best = [Best(most, floor) for floor in floors]
        asked = np.zeros(len(weights.weight), bool)
        for batch in batches:
            for start in range(0, len(batch), BUCKET):
                table = batch.slice(start, BUCKET)
                longest, bucket = table.column("length")[0].as_py(), None
                for q, (query, own) in enumerate(zip(queries, best, strict=True)):
                    if math.sqrt(len(query)) * longest * ROOM < own.floor:
                        continue
                    bucket = bucket or Bucket(table, weights)
                    places = bucket.survivors(query, own.floor)
                    if not len(places):
                        continue
                    asked[query] = True
                    score = bucket.scores(places, asked)
                    asked[query] = False
                    good = np.flatnonzero(score >= max(own.floor, 1))
                    if len(good):
                        own.add(score[good], bucket.key[places[good]], bucket.unset[places[good]])
        part = TaskContext.get().partitionId() % PARTS
        for q, own in enumerate(best):
            if len(own.score):
                size = len(own.score)
                yield pa.RecordBatch.from_arrays([pa.array([q] * size, pa.int32()), pa.array([part] * size, pa.int32()), pa.array(own.key, mask=own.unset), pa.array(own.score)], ["query", "part", "key", "score"])

    return rows.select("key", "n", "terms", "counts", "length").mapInArrow(run, "query int, part int, key long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """rank of the first rows of each query, cut by part before."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    for by in (["query", "part"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
    return found


def _answered(docs: DataFrame, block: list[tuple[int, list[bytes]]], most: int) -> DataFrame:
    """item_id, rank, doc_id and score of one block of queries. docs: key, text."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, terms in block for w in terms})
    number = {w: i for i, w in enumerate(vocabulary)}
    queries = [np.array([number[w] for w in terms], np.int32) for _, terms in block]
    every = stored(vectors(docs, vocabulary))
    counts = every.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term of the block
    weights = Weights(len(vocabulary), dict(zip(counts["term"].to_pylist(), counts["df"].to_pylist(), strict=True)))
    rows = every.where("terms is not null").select("key", "n", "salt", "terms", "counts")
    index = stored(by_length(rows, weights))
    ids = [id_ for id_, _ in block]
    cut = (index.approxQuantile("length", [1 - 1 / FIRST], 0.001) or [0.0])[0]
    first = stored(_first(searched(index.where(F.col("length") >= cut), queries, ids, weights, [0] * len(block), most), most))
    reached = {r.query: r.score for r in first.where(F.col("rank") == most).select("query", "score").collect()}  # a row a query
    floors = [reached.get(q, 0) for q in range(len(block))]
    least = min(floor / math.sqrt(len(query)) for query, floor in zip(queries, floors, strict=True)) / ROOM
    others = searched(index.where((F.col("length") < cut) & (F.col("length") >= least)), queries, ids, weights, floors, most)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
    found = _first(first.select("query", "part", "key", "score").unionByName(others), most)
    return found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", most: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of each query's first documents. docs: key, text; items: item, text."""
    docs = docs.select(F.col(key).cast("long").alias("key"), "text")
    answers = [_answered(docs, block, most) for block in blocks(items.select(F.col(item).cast("long").alias("id"), "text"))]
    if not answers:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
