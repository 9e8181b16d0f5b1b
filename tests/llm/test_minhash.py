import importlib
import random

import pytest

from folioforge.llm import catalog, minhash
from folioforge.llm.components import components

SF = "/root/testdata/sf0.001"


def sets_of(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows, percent):
    sets = [(key, sets_of(text)) for key, text in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = roots({key for key, _ in sets if key is not None}, links)
    return sorted(((key, len(x), root.get(key), key is None or key == root[key]) for key, x in sets), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = catalog.op7_minhash_dedup(spark, SF)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(found) == expected([(r.doc_id, r.text) for r in docs.collect()], 85)


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(2)
    words = [f"w{n}" for n in range(500)]
    line = lambda n: " ".join(dice.choices(words, k=n))
    base, rows = line(200).split(), [(1, None), (2, ""), (3, "a b c"), (4, "A  B\nc"), (5, "a b c d"), (6, line(50)), (6, line(60)), (None, "a b c"), (None, None)]
    for i in range(120):  # a crowded region: copies with a few words changed
        copy = list(base)
        for _ in range(dice.randint(0, 3)):
            copy[dice.randrange(200)] = dice.choice(words)
        rows.append((100 + i, " ".join(copy)))
    rows += [(300 + i % 3, rows[5][1]) for i in range(9)] + [(400, "x y " * 30000), (401, "x y " * 25000)]
    return rows


def test_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in odd_rows], "doc_id long, text string, class string, n int, __row string, row_of_key string")
    assert rows_of(minhash.near_duplicates(docs, 80)) == expected(odd_rows, 80)
    assert minhash.near_duplicates(docs.limit(0), 80).collect() == []
    kept = minhash.deduplicated(docs, 80)
    assert kept.columns == docs.columns and {(r["class"], r.n, r["__row"], r.row_of_key) for r in kept.collect()} == {("x", 1, "y", "z")}
    root = {r[0]: r[2] for r in expected(odd_rows, 80)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*{k for k, v in root.items() if k == v and k is not None}, None, None], key=str)


def test_large_regions_go_deeper(spark, odd_rows, monkeypatch):
    """With the crowded region taken for a large one, components don't change."""
    monkeypatch.setattr(minhash, "hot_bound", lambda *_: 60)
    monkeypatch.setattr(minhash, "SALTS", 2)
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    assert rows_of(minhash.near_duplicates(docs, 80)) == expected(odd_rows, 80)


def test_single_bridges_to_split_regions(spark, monkeypatch):
    """Documents with one link, to one member of a region that is split into parts, join its component."""
    monkeypatch.setattr(minhash, "hot_bound", lambda *_: 60)
    monkeypatch.setattr(minhash, "SALTS", 4096)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    dice = random.Random(5)
    base = [f"b{n}" for n in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in dice.sample(range(150), 2):
            copy[at] = f"c{i}"
        rows.append((i, " ".join(copy)))
    for i in range(8):  # near the end of one copy, three more words differ
        copy = rows[i][1].split()
        copy[155] = copy[165] = copy[175] = f"d{i}"
        rows.append((1000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minhash.near_duplicates(docs, 85)) == expected(rows, 85)


def test_plans_stay_small(spark, odd_rows, monkeypatch):
    """Joins repeated in each branch of a look-up, and broadcasts for nodes with many links where there are none, filled the driver."""
    joins, hints = [], []
    stored = minhash.stored

    def seen(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join "))
        hints.append(plan.count("strategy=broadcast"))
        return stored(df)

    monkeypatch.setattr(minhash, "stored", seen)
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    assert rows_of(minhash.near_duplicates(docs, 80)) == expected(odd_rows, 80)
    assert max(joins) <= 7
    hints.clear()
    monkeypatch.setattr(importlib.import_module("folioforge.llm.components"), "stored", seen)
    components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    assert len(hints) > 3 and sum(hints) == 0


def test_components(spark):
    dice = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(dice.randrange(200, 300), dice.randrange(200, 300)) for _ in range(70)] + [(5, 5), (7, None)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    nodes = {n for a, b in links if b is not None and a != b for n in (a, b)}
    assert {r.node: r.component for r in found.collect()} == roots(nodes, [x for x in links if x[1] is not None]) and found.count() == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
