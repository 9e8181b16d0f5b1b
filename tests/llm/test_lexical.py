import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import catalog, lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, most=50):
    counted = [(key, Counter(terms_of(text))) for key, text in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c, n in counted:
            m = 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(found, key=lambda x: x[:3])[:most])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert rows_of(catalog.op12_lexical_search(spark, SF)) == expected([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(12)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "和", "A", "a", "_", "\x00", "9"]
    line = lambda n: dice.choice(["_", " ", "\n", "-"]).join(dice.choices(words, k=n))
    docs = [(i, line(dice.randrange(1, 60))) for i in range(300)]
    docs += [(None, line(30)), (None, line(5)), (301, None), (302, ""), (303, " -_. "), (304, "w1 " * 50_000), (-5, "w1"), (305, "same text here")]
    docs += [(400 + i, "w1 w2 w3 copies of one text") for i in range(150)] + [(None, "w1 w2 w3 copies of one text")] * 3 + [(7, "w4 w5")] * 4
    items = [(i, line(dice.randrange(1, 12))) for i in range(30)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 W1 w2 w3"), (94, line(300)), (94, "w4"), (95, "é É")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, odd_rows, monkeypatch, small):
    """Also with several blocks of queries, small buckets ."""
    if small:
        for name, value in {"MOST_PAIRS": 40, "BUCKET": 7, "FIRST": 4, "PARTS": 3}.items():
            monkeypatch.setattr(lexical, name, value)
    docs, items = odd_rows
    table = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, length int, score string").repartition(5)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert rows_of(lexical.search(table, asked)) == expected(docs, items)
    assert rows_of(lexical.search(table, asked, most=3)) == expected(docs, items, 3)
    assert lexical.search(table.limit(0), asked).collect() == []
    assert lexical.search(table, asked.limit(0)).collect() == []
    assert lexical.search(table.where("doc_id = 305"), asked.where("item_id = 92")).collect() == []


def test_bounds_keep_every_document_that_reaches_the_floor():
    dice = np.random.default_rng(3)
    weights = lexical.Weights(40, {-1: 500, -2: 20_000, **{t: int(dice.integers(1, 400)) for t in range(40)}})
    terms = [np.sort(dice.choice(40, dice.integers(1, 20), replace=False)).astype(np.int32) for _ in range(200)]
    counts = [dice.integers(1, 9, len(t)).astype(np.int32) for t in terms]
    n = dice.integers(10, 300, 200)
    impacts = [weights.impacts(n[i : i + 1], np.array([len(t)]), t, c) for i, (t, c) in enumerate(zip(terms, counts, strict=True))]
    length = np.array([math.sqrt((x.astype(float) ** 2).sum()) for x in impacts]) * lexical.ROOM
    order = np.argsort(-length)
    table = pa.table({"key": pa.array(range(200)), "n": n[order], "terms": [terms[i].tobytes() for i in order], "counts": [counts[i].tobytes() for i in order], "length": length[order]})
    bucket = lexical.Bucket(table, weights)
    pruned = 0
    for _ in range(50):
        query = np.sort(dice.choice(40, 12, replace=False)).astype(np.int32)
        asked = np.isin(np.arange(40), query)
        scores = bucket.scores(np.arange(200), asked)
        assert scores.tolist() == [int(impacts[i][np.isin(terms[i], query)].sum()) for i in order]
        floor = int(np.sort(scores)[-10])
        found = bucket.survivors(query, floor)
        assert set(bucket.survivors(query, 1)) == set(np.flatnonzero(scores >= 1))
        assert set(np.flatnonzero(scores >= floor)) <= set(found)
        pruned += 200 - len(found)
    assert pruned > 50 * 50  # of 200 vectors, a quarter at least on average
