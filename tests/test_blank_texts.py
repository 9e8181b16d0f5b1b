"""Answers over documents without a sentence."""

import os

import pyarrow.parquet as pq

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_answers_of_blank_documents(spark, tmp_path):
    for name in os.listdir(SF):
        (tmp_path / name).symlink_to(f"{SF}/{name}")
    documents = pq.read_table(f"{SF}/documents.parquet")
    place = documents.column_names.index("text")
    (tmp_path / "documents.parquet").unlink()
    pq.write_table(documents.set_column(place, "text", [[" \n"] * len(documents)]), tmp_path / "documents.parquet")
    rows = entry.queries()["pipeline_answer"](spark, str(tmp_path)).collect()
    cited = [r for r in rows if r.doc_id is not None]
    assert cited and all(r.excerpt is None for r in cited)
