import math

import numpy as np
import pytest

from folioforge.llm import catalog, embeddings, inner_products

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, component string"


def fit(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def expected_links(rows, least=0.93):
    near = [[] for _ in rows]
    for i, (a, v, label) in enumerate(rows):
        for j, (b, w, other) in enumerate(rows[:i]):
            if label is not None and label == other and None not in (a, b) and fit(v) and fit(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x.any() and y.any() and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    near[i].append(j)
                    near[j].append(i)
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            for j in others:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    return sorted(((r[0], len(near[i]), root[i], r[0] is None or r[0] == root[i]) for i, r in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_links_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = catalog.op1_embedding_dedup(spark, SF)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows_of(found) == expected_links(rows)


@pytest.fixture(scope="module")
def odd_vectors():
    dice = np.random.default_rng(4)
    vector = lambda: dice.standard_normal(16).astype(np.float32).tolist()
    base, rows = vector(), []
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] * 16, 0), (4, [None] * 16, 0), (5, [], 0), (None, base, 0), (6, base, None), (7, [float("inf"), *base[1:]], 0), (8, base[:8], 0)]
    rows += [(10, base, 0), (11, base, 0), (11, base, 0), (12, [3 * x for x in base], 0), (13, base, 1), (14, [-x for x in base], 0)]
    rows += [(100 + i, (np.array(base) + dice.standard_normal(16) * 0.25).astype(np.float32).tolist(), 0) for i in range(60)]
    return rows + [(200 + i, vector(), i % 2) for i in range(60)]


def test_links_of_odd_rows(spark, odd_vectors, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "x") for r in odd_vectors], SCHEMA)
    assert rows_of(embeddings.near_vectors(df)) == expected_links(odd_vectors)
    assert embeddings.near_vectors(df.limit(0)).collect() == []
    monkeypatch.setattr(embeddings, "BLOCK", 7)  # large buckets in blocks
    monkeypatch.setattr(embeddings, "hot_bound", lambda *_: 8)
    assert rows_of(embeddings.near_vectors(df)) == expected_links(odd_vectors)


def expected_top(rows, every, k=5):
    parts = [(a, [math.floor(256 * float(x)) for x in v]) for a, v, *_ in rows if a is not None and fit(v)]
    out = []
    for a, v in {(a, tuple(v)) for a, v in parts if a % every == 0}:
        scores = sorted((-max(min(sum(x * y for x, y in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), b) for b, w in parts if b != a and len(w) == len(v))
        out += [(a, rank, b, min(-s, 2**63 - 1)) for rank, (s, b) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = catalog.op3_exact_top_k(spark, SF)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == expected_top(rows, 50)


def test_top_of_odd_rows(spark, odd_vectors):
    rows = [*odd_vectors, (300, [2.5e6] * 16, 0), (301, [2.4e6] * 16, 0), (302, [-3.0] * 16, 0), (310, [1e30] * 16, 0), (400, [1.0, 2.0], 0), (401, [1.0, -2.0], 0), (402, [1e8, 1.0], 0), (403, [2.0**60, -(2.0**60)], 0), (404, [3e38, 1e-3], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, inner_products.top_k(df, "vec_id % 10 = 0").collect())) == expected_top(rows, 10)
    assert inner_products.top_k(df.limit(0), "vec_id % 10 = 0").collect() == []


def test_large_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e8, 1.0]), (3, [0.5, 0.5]), (4, [-1e300, 1e300]), (5, [1e308, 1e308]), (10, [1e9, -1e9]), (20, [0.0, 0.0]), (30, [1e200, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in inner_products.top_k(df, "vec_id % 10 = 0 or vec_id = 1").collect()}
    assert found[1, 1] == (4, 2**63 - 1) and found[1, 2] == (5, 2**63 - 1) and found[1, 3] == (30, 2**63 - 1) and found[1, 4] == (2, 256 * 25_600_000_000 + 512 * 256)
    assert len([q for q, _ in found if q == 20]) == 5 and found[20, 1] == (1, 0)


def test_blocks_of_other_lengths(spark, monkeypatch):
    dice = np.random.default_rng(6)
    rows = [(i, (dice.standard_normal(8) * 2.0 ** dice.integers(-6, 6)).tolist()) for i in range(1500)]
    monkeypatch.setattr(inner_products, "BLOCK_BYTES", 64)
    monkeypatch.setattr(inner_products, "PIECE", 40)
    monkeypatch.setattr(inner_products, "LONGEST", 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, inner_products.top_k(df, "vec_id % 50 = 0").collect())) == expected_top(rows, 50)


def test_pruning_keeps_the_best():
    dice = np.random.default_rng(8)
    c = np.floor(dice.standard_normal((3000, 12)) * np.geomspace(300, 3, 12) * dice.exponential(1, (3000, 1)))
    q, ids = c[:40], np.arange(3000)
    axes = np.linalg.eigh(c.T @ c)
    found = inner_products.scan(ids[:40], q, ids, c, np.full(40, -np.inf), (axes[1][:, ::-1], axes[0][::-1]), 5)
    for i in range(40):
        scores = (c @ q[i]).astype(int)
        expected = sorted((-s, a) for a, s in zip(ids, scores, strict=True) if a != i)[:5]
        assert [(-s, a) for p, a, s in found if p == i] == expected
