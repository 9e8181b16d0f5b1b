import gzip
import hashlib
import io
import os

import pytest

from folioforge.llm import catalog, warc

SF = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(rows, least=100):
    bodies = [(r[0], (r[-1] or "").encode()) for r in rows]
    first = {}
    for key, body in bodies:
        if key is not None and len(body) >= least:
            first[body] = min(key, first.get(body, key))
    out = []
    for key, body in bodies:
        revisit = body in first and (key is None or key > first[body])
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert rows_of(catalog.op13_warc(spark, SF)) == expected([(r.page_id, r.html) for r in pages])


@pytest.fixture(scope="module")
def odd_rows():
    copy = "copied page é " * 20
    rows = [(1, "http://a/x y", None), (2, None, ""), (3, "http://a\r\nEvil: 1", "<p>\r\n\r\nWARC/1.1\r\n"), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "y" * 100), (7, "v", "y" * 100)]
    rows += [(None, "n", copy), (None, None, "only without a key " * 9), (None, "m", "only without a key " * 9), (-7, "neg", "z" * 500), (2**62, "big", "z" * 500), (9, "q", "same row " * 30), (9, "q", "same row " * 30)]
    return rows + [(1000 + i, f"http://c/{i}", copy) for i in range(200)] + [(2000 + i, f"http://d/é{i}", f"page {i} " * (i % 40)) for i in range(300)] + [(5000, "long", "é\n" * 400_000)]


def table(spark, rows, parts):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, place string, shard int").repartition(parts)


def contents(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.endswith(".gz")}


def test_odd_rows(spark, odd_rows, tmp_path):
    assert rows_of(warc.round_trip(table(spark, odd_rows, 3))) == expected(odd_rows)
    assert warc.round_trip(table(spark, odd_rows, 3).limit(0)).collect() == []
    folders = [f"{tmp_path}/{i}" for i in range(2)]
    for parts, folder in zip((2, 7), folders, strict=True):
        warc.write(table(spark, odd_rows, parts), f"file://{folder}", shard_bytes=60_000, roll=700)
    first, second = map(contents, folders)
    assert first == second and len(first) > 20  # the same files, byte by byte, whatever the partitions
    assert not any(n.startswith(("_temporary", "_manifest")) for n in os.listdir(folders[0]))
    back = warc.read(spark, f"file://{folders[0]}")
    assert rows_of(back) == expected(odd_rows)
    texts = {r.page_id: r.html for r in back.collect() if r.record_type == "response" and r.page_id is not None}
    assert texts[5000] == odd_rows[-1][2] and texts[3] == odd_rows[2][2] and texts[1] == ""
    assert {r.url for r in back.where("page_id in (1, 2, 3)").collect()} == {"http://a/x%20y", None, "http://a%0D%0AEvil:%201"}


def test_files_are_archives_in_order(spark, odd_rows, tmp_path):
    warc.write(table(spark, odd_rows, 4), f"file://{tmp_path}/w", shard_bytes=100_000, roll=2_000)
    keys = []
    for name, data in contents(f"{tmp_path}/w").items():
        size = sum(1 for _ in warc.parsed(io.BytesIO(gzip.decompress(data))))
        found = spark.read.parquet(f"file://{tmp_path}/w/manifest").where(f"name = '{name}'").first()
        assert (found["size"], found["records"], found["sha256"]) == (len(data), size, hashlib.sha256(data).hexdigest())
        keys += [fields.get("key-id") for fields, _ in warc.parsed(io.BytesIO(gzip.decompress(data)))]
    numbers = [int(k) for k in keys if k is not None]
    assert numbers == sorted(numbers) and all(k is None for k in keys[len(numbers) :])


def test_commit_is_whole_and_once(spark, odd_rows, tmp_path, monkeypatch):
    """A writer stopped before its manifest leaves nothing to read, and can run again; a changed byte is found."""
    folder = f"file://{tmp_path}/w"
    with monkeypatch.context() as stopped:
        stopped.setattr(warc, "commit", lambda rows, folder: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            warc.write(table(spark, odd_rows, 2), folder)
    assert not os.path.exists(f"{tmp_path}/w/manifest") and not contents(f"{tmp_path}/w")
    warc.write(table(spark, odd_rows, 2), folder)
    assert rows_of(warc.read(spark, folder)) == expected(odd_rows)
    with pytest.raises(FileExistsError):
        warc.write(table(spark, odd_rows, 2), folder)
    name, data = next(iter(contents(f"{tmp_path}/w").items()))
    plain = gzip.decompress(data).replace(b"copied page", b"copied PAGE", 1)
    with open(f"{tmp_path}/w/{name}", "wb") as out:
        out.write(gzip.compress(plain))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, folder).collect()
