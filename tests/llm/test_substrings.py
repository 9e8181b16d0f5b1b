import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import catalog, substrings

SF = "/root/testdata/sf0.001"


def expected(rows, window=35):
    texts = [(text or "").encode().split() for _, text in rows]
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (key, _), words in zip(rows, texts, strict=True):
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(catalog.op5_substring_dedup(spark, SF)) == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(5)
    words = [str(n) for n in range(60)]
    line = lambda n: " ".join(dice.choices(words, k=n))
    passage, loop = line(50), line(20)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line(34)), (5, passage), (6, f"{line(9)} x {passage}\t{line(9)}"), (7, loop + " " + loop + " " + loop), (8, line(35)), (8, line(35))]
    rows += [(None, line(80)), (9, "same " * 20000), (10, line(300)), (11, rows[3][1]), (12, passage.replace(" ", "\n\n"))]
    rows += [(13, line(100))] * 3 + [(100 + i, line(40)) for i in range(50)]
    return rows


def test_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(*r, 0, "x") for r in odd_rows], "doc_id long, text string, n_words int, spans string")
    assert rows_of(substrings.digests(docs)) == expected(odd_rows)
    assert substrings.digests(docs.limit(0)).collect() == []
    alone = [(1, "a b " * 300), (2, "c " + " ".join(map(str, range(90))))]
    assert rows_of(substrings.digests(spark.createDataFrame(alone, "doc_id long, text string"))) == expected(alone)
    assert rows_of(substrings.digests(spark.createDataFrame(alone[1:], "doc_id long, text string"))) == expected(alone[1:])


def test_frequent_windows_in_salted_groups(spark, odd_rows, monkeypatch):
    """With every window salted, results don't change."""
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    made = substrings.joined_bits

    def all_hot(rows, size):
        bits, _, pieces = made(rows, size)
        return bits, [np.flatnonzero(np.unpackbits(x)).astype(np.uint32) for x in bits], pieces

    monkeypatch.setattr(substrings, "joined_bits", all_hot)
    assert rows_of(substrings.digests(docs)) == expected(odd_rows)


def test_windows_of_a_frequent_minimiser_travel_alone(spark, odd_rows, monkeypatch):
    """Hundreds of different repeated windows around one sentence, all their minimisers taken for frequent."""
    dice = random.Random(8)
    sentence = " ".join(f"s{i}" for i in range(9))
    rows = [(1000 + i, " ".join([f"a{dice.randrange(50)}" for _ in range(20)] + [sentence] + [f"b{dice.randrange(50)}" for _ in range(20)])) for i in range(60)]
    rows = [*odd_rows, *rows, *[(k + 5000, t) for k, t in rows[:40]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "PIECE_LEAST", 0)
    monkeypatch.setattr(substrings, "PIECE_SHARE", 1 << 60)
    assert rows_of(substrings.digests(docs)) == expected(rows)


def test_packing():
    cells = np.sort(np.random.default_rng(0).integers(0, 1 << 22, 5000).astype(np.uint32))
    for part in (cells, cells[:3], np.array([0, 0, 255, 510, 4000000], np.uint32), np.repeat(cells[:9], 40)):
        assert (substrings.unpacked(substrings.packed(part)) == part).all()
