from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from folioforge.llm import catalog, mixing

SF = "/root/testdata/sf0.001"


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] or not sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else share[s] for s in order}
        full |= over


def by_source(rows):
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    return sizes, taken, target


def report(docs):
    found = mixing.mix_report(docs)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot"]
    return found


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    found = catalog.op8_source_mix(spark, SF)
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.size == len(r.text.encode().split()) for r in rows)
    sizes, taken, target = by_source(rows)
    expected = expected_targets(sizes)
    for source in sizes:
        assert target[source] == pytest.approx(expected[source]) and abs(taken[source] - target[source]) <= 8 * mixing.SHORTEST
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert sorted(found.collect()) == sorted(report(docs.repartition(5)).collect())


def by_hand(rows, block, slots):
    """taken and slots of each document by slots, ranks and blocks, one word at a time."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    target = expected_targets(sizes)
    order = sorted(target, key=lambda s: (s is None, (s or "").encode()))
    shares, at = [], 0.0
    for s in order:
        at += target[s] / sum(target.values())
        shares.append((s, at))
    of_source = defaultdict(list)
    for slot in range(slots):
        point = ((slot + 0.5) * mixing.GOLDEN) % 1
        found = next((i for i, (_, high) in enumerate(shares) if point < high), len(shares) - 1)
        of_source[order[found]].append(slot)
    taken, used, copies = Counter(), defaultdict(set), []
    for place, s in enumerate(order):
        stream = [(i, k == 0) for i, r in sorted(((i, r) for i, r in enumerate(rows) if r.source == s and r.size), key=lambda x: x[1].mix_start) for k in range(r.size)]
        given = of_source[s]
        want = -int(-round(target[s], 6) // 1)
        words = min(max(min(want, (len(given) + mixing.CLOSING) * block), (len(given) - mixing.CLOSING) * block), 3 * len(stream))
        for w in range(words):
            slot = given[w // block] if w // block < len(given) else slots + place * mixing.CLOSING + w // block - len(given)
            i, first = stream[w % len(stream)]
            taken[i] += 1
            used[i].add(slot)
            if first:
                copies.append((slot, w, i))
    return taken, used, [i for _, _, i in sorted(copies)]


@pytest.mark.parametrize("sizes", [{"a": [40, 7, 0, 130], "b": [500], "c": [9, 9, 9]}, {"p": [300] * 20, None: [1000], "q": [17] * 9, "r": [3]}])
def test_rows_follow_the_schedule(spark, monkeypatch, sizes):
    """What is taken of each document, in which slots and in which order, in the mode that the query uses; another schedule takes something else."""
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)], "doc_id long, source string, size long")
    block, total = mixing.SHORTEST, sum(map(sum, sizes.values()))
    rows, parts = mixing.taken_words(docs, ["doc_id", "size"])
    rows = rows.collect()
    taken, used, _ = by_hand(rows, block, round(total / block))
    for i, r in enumerate(rows):
        assert r.taken == taken[i] and (not used[i] or (r.mix_slots.first, r.mix_slots.last) == (min(used[i]), max(used[i])))
    lengths = {r.mix_slot: r.n for r in parts.groupBy("mix_slot").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()}
    assert sum(lengths.values()) == sum(taken.values()) and sum(n != block for n in lengths.values()) <= (mixing.CLOSING + 1) * len(sizes)
    empty = spark.createDataFrame([], "mix_slot long, mix_key string, mix_rank long")
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: empty)
    without = mixing.taken_words(docs, ["doc_id", "size"])[0].agg(F.sum("taken")).first()[0]
    assert without <= mixing.CLOSING * block * len(sizes) and (total < 2000 or without < sum(taken.values()) / 2)


def test_mix_is_in_slot_order(spark):
    sizes = {"a": [40, 7, 130], "b": [500, 30], None: [60] * 8}
    texts = [(i, s, " ".join([f"w{i}"] * n)) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    inner = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mix_text"))
    rows = mixing.taken_words(inner, ["doc_id", "size", "mix_text"])[0].collect()
    _, _, copies = by_hand(rows, mixing.SHORTEST, round(sum(r.size for r in rows) / mixing.SHORTEST))
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == [rows[i].doc_id for i in copies]


def test_small_sources_reach_their_targets(spark, monkeypatch):
    """With blocks that are longer than a source's target, as in a large corpus."""
    monkeypatch.setattr(mixing, "SHORTEST", 4096)
    rows = [(i, "w " * 2000, "ab"[i % 2]) for i in range(40)] + [(100, "x " * 300, None), (101, "y " * 7, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, taken, target = by_source(report(docs).join(docs.select("doc_id", "source"), "doc_id").collect())
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and min(taken.values()) > 0
    assert {100, 101} <= {r.doc_id for r in mixing.mixed(docs).collect()}


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 300:03}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(report(docs).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCES", 10)
    assert sorted(report(docs).collect()) == few
    _, taken, target = by_source(report(docs).join(docs.select("doc_id", "source"), "doc_id").collect())
    assert len(target) == 300 and all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 90000, "a"), (None, "y y y", "é"), (4, "z", "Z"), (4, "z", "Z"), (5, None, "empty")] + [(6, "same words here", "z")] * 4
    docs = spark.createDataFrame([(*r, 1, 2.0, "k") for r in rows], "doc_id long, text string, source string, size int, target double, mix_key string")
    found = report(docs).collect()
    assert len(found) == len(rows) and sum(r.size for r in found) == sum(len((t or "").split()) for _, t, _ in rows)
    assert {r.target for r in found if r.doc_id in (2, 5)} == {0.0}
    assert report(docs.limit(0)).collect() == [] and {r.taken for r in report(docs.where("doc_id = 1")).collect()} == {0}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {3, None, 4, 6}


def test_floor_of_targets():
    assert floor(sum(expected_targets({"a": 10, "b": 1000, None: 0}).values())) == 1010
