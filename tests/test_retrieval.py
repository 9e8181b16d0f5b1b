import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.operators import retrieval, search

CHUNK = "key long, side string, vector array<double>, content string, hay string, title string, exact_keys array<string>, city string, placed boolean, chunk_type string, object_type string, level string, role string, status string, effective date"


def chunk(key, content, title="source.pdf", city="北京", chunk_type="clause", object_type=None, row_key=None, side="accessible", vector=None, placed=False):
    return key, side, vector, content, f"{title} {content} {row_key or ''}", title, [row_key] if row_key else [], city, placed, chunk_type, object_type, None, None, None, None


def test_drawings_come_before_generic_rows(spark):
    """A question about drawings ranks a drawing requirement above an indicator row."""
    rows = [
        chunk(1, "列1：说明。综合考虑出生人口变化趋势各年龄组占居住人口比例延续号文的核算标准。", "北京市居住公共服务设施配置指标京政发〔2025〕25号.pdf", chunk_type="indicator", object_type="indicator_item", row_key="说明"),
        chunk(2, "规划图纸包括现状分析图纸和规划分析图纸，分为必选和可选，也可根据项目区位条件和自身情况增补其他论证图纸。", "全-规划综合实施方案指南2022.12 最终最新.pdf", chunk_type="deliverable", object_type="drawing_requirement", placed=True),
    ]
    questions = spark.createDataFrame([(1, "片区控规优化项目需要提交哪些图纸和说明文件？", "北京")], "question_id long, question string, city string")
    candidates = spark.createDataFrame([(1, "accessible", k, 1.0, 0.0, "lexical") for k in (1, 2)], "question_id long, side string, key long, keyword_score double, vector_score double, source string")
    found = retrieval.reranked(candidates, questions, spark.createDataFrame(rows, CHUNK)).orderBy("rank").collect()
    assert [r.key for r in found] == [2, 1]


def brute(docs, asked):
    """The k best of each question by BM25, one side."""
    lengths = [len(words) for _, words in docs]
    mean, df = sum(lengths) / len(docs), Counter(t for _, words in docs for t in set(words))
    out = set()
    for question, terms, k in asked:
        scores = []
        for key, words in docs:
            f = Counter(words)
            total = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f[t] * (search.K1 + 1) / (f[t] + search.K1 * (1 - search.B + search.B * len(words) / mean)) for t in set(terms) if f[t])
            if total > 0:
                scores.append((-round(total, retrieval.PLACES), key))
        out |= {(question, key, i + 1, -s) for i, (s, key) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_index_finds_the_best(spark, monkeypatch, small):
    """Rare and common terms, copies, empty texts; also with small blocks, so that floors and bounds cut."""
    if small:
        for name, value in {"BLOCK": 3, "SPLIT": 20, "TOP_PARTS": 2}.items():
            monkeypatch.setattr(retrieval, name, value)
    dice = random.Random(4)
    word = lambda: f"w{min(int(dice.expovariate(0.12)), 80)}"
    docs = [(i, [word() for _ in range(dice.randrange(0, 40))]) for i in range(300)] + [(1000 + i, ["w1", "w30", "w30", "x"]) for i in range(30)]
    asked = [(q, [word() for _ in range(dice.randrange(1, 9))], dice.choice([1, 5, 20])) for q in range(40)] + [(90, ["absent"], 5), (91, ["x"], 7)]
    rows = spark.createDataFrame(docs, "id long, words array<string>").repartition(4)
    terms = spark.createDataFrame([(q, t, k) for q, own, k in asked for t in set(own)], "question_id long, term string, k int")
    found = retrieval.lexical(terms, retrieval.build_index(rows, "id", F.col("words"))).collect()
    assert {(r.question_id, r.key, r["rank"], r.score) for r in found} == brute(docs, asked)


def test_unfit_vectors_are_set_aside(spark):
    rows = [chunk(1, "a", vector=[1.0, 0.0]), chunk(2, "b", vector=[0.5, 0.5]), chunk(3, "c", vector=[1.0, 2.0, 3.0]), chunk(4, "d"), chunk(5, "e", vector=[None, 1.0]), chunk(6, "f", vector=[2.0, 0.0], side="denied")]
    chunks = spark.createDataFrame(rows, CHUNK)
    questions = spark.createDataFrame([(1, [1.0, 1.0], 2), (2, [1.0, 0.0, 0.0], 5), (3, None, 5), (4, [1.0] * 7, 5)], "question_id long, vector array<double>, k int")
    found = {(r.question_id, r.side, r.key, r.score) for r in retrieval.similar(questions, chunks, "key", "vector", F.col("side")).collect()}
    assert found == {(1, "accessible", 1, 1.0), (1, "accessible", 2, 1.0), (1, "denied", 6, 2.0), (2, "accessible", 3, 1.0)}
    fit = {r.question_id: (r.fit, r.unfit, r.without) for r in retrieval.fitness(questions, chunks, "vector").collect()}
    assert fit == {1: (3, 2, 1), 2: (1, 4, 1), 3: (0, 5, 1), 4: (0, 5, 1)}


def test_retrieval_without_vectors(spark):
    """The vector channel is empty: the others go on, and the report says so."""
    chunks = spark.createDataFrame([chunk(1, "绿地率不低于30%"), chunk(2, "建筑高度不大于24米", side="denied")], CHUNK)
    questions = spark.createDataFrame([(1, "绿地率是多少？", None, None), (2, "完全无关abc", None, None)], "question_id long, question string, city string, vector array<double>")
    index = retrieval.build_index(chunks, "key", retrieval.search_tokens(F.col("hay")), F.col("side"))
    found = retrieval.channels(questions, chunks, index)
    told = {r.question_id: (r.channels, r.degraded) for r in retrieval.debugged(found, questions, chunks).collect()}
    assert told == {1: ("lexical", "no_question_vector"), 2: ("", "no_question_vector")}
    results = retrieval.retrieve(questions, chunks, index)
    assert [(r.question_id, r.side, r.key) for r in results.where("side = 'accessible'").collect()] == [(1, "accessible", 1)]
    verdicts = {r.question_id: (r.no_access, r.refusal) for r in retrieval.gated(results, questions).collect()}
    assert verdicts == {1: (False, None), 2: (False, "no_results")}
