import base64
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from folioforge.llm import catalog

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        assert docs.columns == columns or name == "bpe"
    read = spark.read.parquet(f"{SF}/documents.parquet")
    clean = read.where("text rlike '[A-Za-z]'").count()
    assert kept[0].count() >= 0.98 * clean and kept[1].count() == kept[2].count() < kept[0].count()
    assert kept[2].where("text like '%@%.com %'").count() == 0
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(catalog.VOCABULARY), "rb"))}
    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [(r.doc_id, r.text) for r in kept[3].collect()]
    expected = sorted((i, len(peer.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in kept[4].collect()) == expected
    assert sorted(map(tuple, catalog.pipeline(spark, SF).collect())) == sorted(map(tuple, kept[4].collect()))


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_bpe_keeps_one_python_worker_a_task(spark):
    """Two Python steps in one task leave two workers for each core, which hold memory while later stages run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.encode(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
