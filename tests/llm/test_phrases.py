import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioforge.llm import catalog, phrases

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=30, most=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und" if lang is None else lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        found = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = rows_of(catalog.op11_collocations(spark, SF))
    assert found and found == expected([(r.lang, r.text) for r in docs])


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(11)
    words = [*"abcdefghij", "É", "é", "-", "x" * 300, "和", "\x1c"]
    line = lambda n: "".join(dice.choice(words) + dice.choice([" ", " ", " ", "\t", ".", "\n", "  "]) for _ in range(n))
    rows = [(None, line(900)), ("und", line(900)), ("fr", ""), ("fr", None), ("", line(500)), ("en", "A b " * 3000), ("en", line(4000)), ("en", "one"), ("de", ". , ;")]
    return rows + [("es", "The end of it. the END of it")] * 40 + [(f"l{i}", line(200)) for i in range(20)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, odd_rows, monkeypatch, small):
    """Also with few words broadcast, small buffers and many ranges."""
    if small:
        for name, value in {"MOST_WORDS": 5, "GRAMS_HELD": 100, "RANGE_ENTRIES": 64, "WORDS_HELD": 3, "STRETCH": 50, "MOST_CELLS": 12}.items():
            monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame([(*r, 1, "x") for r in odd_rows], "lang string, text string, doc_id int, w0 string").repartition(5)
    assert rows_of(phrases.collocations(docs)) == expected(odd_rows)
    assert rows_of(phrases.collocations(docs, least=2, most=7)) == expected(odd_rows, 2, 7)
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs.where("lang = 'de'")).collect() == []


@pytest.mark.parametrize(("n", "width", "ranges"), [(2, 1, 0), (2, 17, 3), (3, 17, 5), (4, 16, 2), (4, 32, 7), (3, 32, 0)])
def test_filters_lose_nothing(n, width, ranges):
    dice = np.random.default_rng(n * width)
    layout = phrases.Layout(n, width, ranges)
    ids = [dice.integers(0, 1 << width, 5000).astype(np.int64) for _ in range(n)]
    assert all((a == b.astype(np.int64)).all() for a, b in zip(ids, layout.restored(*layout.permuted(ids)), strict=True))
    left, right = layout.permuted(ids)
    left &= phrases._mask(layout.low_bits)
    counts = dice.integers(1, 400, len(left))
    halves = [phrases.Filter(layout, *phrases.summed(layout, left[s], right[s], counts[s])) for s in (slice(0, 3000), slice(2000, 5000))]
    again = [phrases.Filter.unpacked(layout, f.packed()) for f in halves]
    for a, b in zip(halves, again, strict=True):
        assert all((getattr(a, x) == getattr(b, x)).all() for x in ("left", "right", "counts"))
    whole = phrases.Filter.merged(again)
    wanted = Counter()
    for s in (slice(0, 3000), slice(2000, 5000)):
        for key, c in zip(zip(left[s].tolist(), right[s].tolist(), strict=True), counts[s].tolist(), strict=True):
            wanted[key] += c
    assert dict(zip(zip(whole.left.tolist(), whole.right.tolist(), strict=True), whole.counts.tolist(), strict=True)) == wanted
