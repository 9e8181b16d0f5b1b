import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import pytest

from folioforge.llm import catalog, ppm

SF = "/root/testdata/sf0.001"


class Plain:
    """The model, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for symbols in texts:
            for i in range(ppm.ORDER, len(symbols)):
                for k in range(order + 1):
                    self.after[symbols[i - k : i]][symbols[i]] += 1

    def p(self, context, symbol):
        seen = self.after.get(context)
        lower = (lambda s: self.p(context[1:], s)) if context else (lambda s: 1 / 256)
        if not seen:
            return lower(symbol)
        whole = 2 * sum(seen.values())
        if symbol in seen:
            return (2 * seen[symbol] - 1) / whole
        return len(seen) / whole * lower(symbol) / (1 - sum(map(lower, seen)))

    def score(self, symbols):
        return sum(log10(self.p(symbols[i - self.order : i], symbols[i])) for i in range(ppm.ORDER, len(symbols)))


def symbols_of(text):
    return bytes([ppm.START] * ppm.ORDER) + b" ".join((text or "").encode().lower().split()) + bytes([ppm.END])


def in_training(doc_id, folds=10):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != 0


def checked(rows, found, order=ppm.ORDER):
    train = [t for i, t in rows if in_training(i)]
    counts = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    plain = Plain([symbols_of(t) for t in train], order)
    expected = []
    for doc_id, text in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        expected.append((doc_id, not in_training(doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, plain.score(symbols_of(text)) if len(text or "") < 3000 else None))
    order_of = lambda r: str(r[:5])
    rows_ = sorted(map(tuple, found.collect()), key=order_of)
    for a, b in zip(rows_, sorted(expected, key=order_of), strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and (b[6] is None or isclose(a[6], b[6], rel_tol=1e-4, abs_tol=1e-4)), (a, b)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = catalog.op9_ppm_score(spark, SF)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    checked([(r.doc_id, r.text) for r in docs.collect()], found)
    bits, symbols = found.where("held_out").join(docs, "doc_id").selectExpr("-sum(score) / log10(2)", "sum(octet_length(text) + 1)").first()
    assert bits / symbols < 2.5


@pytest.fixture(scope="module")
def odd_rows():
    return [(1, None), (2, ""), (3, "The the THE été"), (4, "a " * 50000), (5, "x" * 2000), (None, "the end"), (7, "the end"), (7, "the end"), (8, "\t the\v漢字 🙂"), (9, "unseen"), (10, "the end")] + [(i, f"the {i} end") for i in range(20, 60)]


def test_odd_rows(spark, odd_rows, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in odd_rows], "doc_id long, text string, key string, score double")
    checked(odd_rows, ppm.scored_by_folds(docs))
    assert ppm.scored_by_folds(docs.limit(0)).collect() == []
    assert {r.train_tokens for r in ppm.scored(docs, docs.limit(0)).collect()} == {0}
    monkeypatch.setattr(ppm, "FREQUENT", 5)  # nearly all words are joined
    monkeypatch.setattr(ppm, "MOST_ENTRIES", 120)  # a lower order
    found = ppm.scored_by_folds(docs)
    checked(odd_rows, found, order=ppm.model_of(ppm.counted(docs.where("crc32(cast(doc_id as string)) % 10 <> 0").select("text")))[0])


def test_order_holds_at_every_size(spark, odd_rows, monkeypatch):
    """Scores are those of the full order when few sequences, or none, may be broadcast, and contexts come in portions."""
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    for most in (120, 0):
        monkeypatch.setattr(ppm, "MOST_ENTRIES", most)
        monkeypatch.setattr(ppm, "ROWS_HELD", 1)
        checked(odd_rows, ppm.scored_by_folds(docs))


def test_probabilities_sum_to_one():
    text = [b"abracadabra", b"banana band"]
    gram = ppm.grams(*ppm.stream([[t] for t in text]))
    keys, counts = np.unique(gram, return_counts=True)
    model = ppm.Model(ppm.ORDER, *ppm.trie(keys, counts, ppm.ORDER))
    for context in (b"cabra", b"anana", b"zzzzz", b"\xfe" * 5, b"xxana"):
        number = int.from_bytes(context) << 8
        assert isclose((10 ** model.symbol_scores(np.arange(number, number + 256, dtype=np.uint64))).sum(), 1, rel_tol=1e-5)
