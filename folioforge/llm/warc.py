"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Records are sorted by key (null last), then payload digest and address, and cut into shards at bounds that follow from a
sample of keys by hash, so reruns cut alike. A shard is written by one task, a gzip member a record, into files that roll
once their compressed size reaches a bound. All headers are made anew: record ids from key and digest, one fixed date,
block and payload digests, lengths. Of records with equal payloads of at least ``least`` bytes, the one with the smallest
key is a response and the others are revisits of it, without payload.

Commit: a task writes under a temporary name of its own and hands on a row of the manifest a file. Only rows of tasks that
ended well reach the manifest; their files are renamed, the manifest is put in place last, and readers open what it
names. A lost task is run again under other temporary names; a writer that was stopped can be run again into the same
folder, since names and bytes are the same. A folder that has a manifest is never written again.

Defined results: a null payload is empty. Rows that share the smallest key of a payload are responses each; a row with a
null key revisits a record with a key if there is one, else it is a response. Repeated rows are written each. A null
address has no header; blanks and control characters in one are percent-encoded. Other columns are not read. An empty
table gives an empty manifest.

Scale: payloads are shuffled once, to their shards. What revisits refer to is found on digests alone and travels beside the
pages. Digests with very many rows are looked up by broadcast (see ``lookup``).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import hot_bound, lookup, shared_folder, stored

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a shard: total / SHARDS between these bounds; keys in the sample for each shard, and most in all.
SHARDS, LEAST_SHARD, MOST_SHARD, SAMPLE, MOST_SAMPLE = 4096, 16 << 20, 1 << 30, 64, 1 << 18
#: Compressed bytes from which on a file is closed.
ROLL = 256 << 20
READ_AHEAD, ROWS_BYTES = 1 << 20, 4 << 20
MANIFEST = "shard int, part int, name string, size long, records long, sha256 string"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(33), 127]}


def _sortable(key: Column) -> Column:
    """Text that sorts like the key, null last."""
    return F.coalesce(F.lpad(F.hex(key.bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("Z" * 16))


def _hadoop(spark: SparkSession, uri: str) -> tuple:
    """Hadoop's file system and path of a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{key}:{digest}'.encode()).hexdigest()[:32], version=5)}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One record with its headers. Key-Id and Refers-To-Key-Id are extension fields that carry the keys."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", url.translate(_ESCAPED))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", DATE), ("Refers-To-Key-Id", str(refers_to))]
        fields += [("WARC-Refers-To-Target-URI", refers_url.translate(_ESCAPED))] if refers_url is not None else []
    fields += [("Key-Id", str(key))] if key is not None else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """The files of one shard, under temporary names."""

    def __init__(self, folder: str, attempt: str, shard: int, roll: int) -> None:
        self.files, self.root = _files(f"{folder}/_temporary/{attempt}")
        self.shard, self.roll, self.part, self.out, self.done = shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.files.create_dir(self.root, recursive=True)
            self.name = f"part-{self.shard:07d}-{self.part:05d}.warc.gz"
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.digest.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.part, self.name, self.size, self.records, self.digest.hexdigest()))
            self.part, self.out = self.part + 1, None


def revisits(keys: DataFrame, least: int) -> DataFrame:
    """place, refers_to and refers_url of each record that revisits another. keys: key, url, place, digest, size."""
    large = keys.where(F.col("size") >= least)
    first = large.groupBy("digest").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first"), F.count("*").alias("rows"))
    first = stored(first.where("rows > 1 and first is not null").select("digest", F.col("first.key").alias("refers_to"), F.col("first.url").alias("refers_url"), "rows"))
    bound = hot_bound(first.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    found = lookup(large.select("key", "place", "digest"), first, "digest", "rows", bound)
    return found.where("key is null or key > refers_to").groupBy("place").agg(F.first("refers_to").alias("refers_to"), F.first("refers_url").alias("refers_url"))


def bounds(keys: DataFrame, shard_bytes: int | None) -> list[str]:
    """The places where shards begin, but for the first."""
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    size = shard_bytes or min(MOST_SHARD, max(LEAST_SHARD, total // SHARDS))
    shards = -(-total // size)
    if shards < 2:
        return []
    step = max(1, rows // min(MOST_SAMPLE, SAMPLE * shards))
    sample = keys.where(F.pmod(F.xxhash64("place"), F.lit(step)) == 0).select("place", "size").sort("place", "size").toArrow()
    places, sizes = sample["place"].to_pylist(), sample["size"].to_pylist()
    out, seen, all_of = [], 0, sum(sizes)
    for place, own in zip(places, sizes, strict=True):
        if seen * shards >= all_of * (len(out) + 1) and place not in out[-1:]:
            out.append(place)
        seen += own
    return out


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, shard_bytes: int | None = None, roll: int = ROLL) -> None:
    """Write one record for each row of pages to archives in folder (a URI) and commit them."""
    spark = pages.sparkSession
    files, manifest = _hadoop(spark, f"{folder}/manifest")
    if files.exists(manifest):
        raise FileExistsError(f"{folder} already has a manifest")
    body = F.coalesce(F.col(payload), F.lit(""))
    digest = F.sha2(body, 256)
    named = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"), digest.alias("digest"))
    named = named.withColumn("place", F.concat(_sortable(F.col("key")), "digest"))
    keys = stored(named.select("key", "url", "place", "digest", F.octet_length("payload").cast("long").alias("size")))
    cuts = spark.sparkContext.broadcast(bounds(keys, shard_bytes))

    @F.pandas_udf("int")
    def shard_of(places: pd.Series) -> pd.Series:
        return places.map(lambda place: bisect_right(cuts.value, place)).astype("int32")

    seen = revisits(keys, least)
    rows = named.withColumn("kind", F.lit(1)).unionByName(seen.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("shard", shard_of("place"))
    dealt = rows.repartition(len(cuts.value) + 1, "shard").sortWithinPartitions("shard", "place", "kind", "url")
    columns = ["shard", "place", "kind", "key", "url", "payload", "digest", "refers_to", "refers_url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roller, seen = uuid.uuid4().hex, None, ("", None, None)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                shard, place, kind = (x.as_py() for x in row[:3])
                if kind == 0:  # stands before the pages that it is about
                    seen = place, row[7].as_py(), row[8].as_py()
                    continue
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield told(roller, attempt)
                    roller = Roller(folder, attempt, shard, roll)
                revisit = seen[0] == place
                refers_to, refers_url = seen[1:] if revisit else (None, None)
                roller.add(record(row[3].as_py(), row[4].as_py(), row[5].as_py().encode(), row[6].as_py(), refers_to, refers_url, revisit))
        if roller is not None:
            roller.close()
            yield told(roller, attempt)

    def told(roller: Roller, attempt: str) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        listed = [pa.array(x, kind) for x, kind in zip(zip(*roller.done, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*listed, pa.array([attempt] * len(roller.done))], ["shard", "part", "name", "size", "records", "sha256", "attempt"])

    commit(stored(dealt.select(*columns).mapInArrow(run, f"{MANIFEST}, attempt string")), folder)


def commit(rows: DataFrame, folder: str) -> None:
    """Give the files of rows (of the manifest, with attempt) their names, then put the manifest in place."""
    spark = rows.sparkSession

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for name, attempt in zip(batch.column("name").to_pylist(), batch.column("attempt").to_pylist(), strict=True):
                source = f"{root}/_temporary/{attempt}/{name}"
                if files.get_file_info(source).type != pa.fs.FileType.NotFound:  # else it was moved before this task was lost
                    files.move(source, f"{root}/{name}")
            yield batch.select([f.name for f in batch.schema if f.name != "attempt"])

    temporary = f"{folder}/_manifest-{uuid.uuid4().hex}"
    rows.mapInArrow(move, MANIFEST).write.parquet(temporary)
    files, source = _hadoop(spark, temporary)
    if not files.rename(source, _hadoop(spark, f"{folder}/manifest")[1]):
        raise OSError(f"the manifest of {folder} can't be put in place")
    files.delete(_hadoop(spark, f"{folder}/_temporary")[1], True)


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of a stream of uncompressed bytes."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
            raise ValueError(f"block digest of {fields['warc-record-id']} doesn't fit")
        yield fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {fields['warc-record-id']} doesn't fit")
    size = len(payload) if kind == "response" else int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
    key, refers_to = fields.get("key-id"), fields.get("refers-to-key-id")
    return key and int(key), fields.get("warc-target-uri"), size, digest, kind, refers_to and int(refers_to), payload.decode() if kind == "response" else None


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with payloads, html (null in revisits) of all records that the manifest names."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"][: 7 if payloads else 6]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=False)))
    manifest = spark.read.parquet(f"{folder}/manifest")
    listed = manifest.select("name", "records")
    listed = listed.repartition(max(1, min(listed.count(), 10_000)))  # files of about one size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size, seen = [], 0, 0
                with files.open_input_stream(f"{root}/{name}", compression=None, buffer_size=READ_AHEAD) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in parsed(stream):
                        held.append(_row(fields, block)[: len(names)])
                        size += len(block)
                        seen += 1
                        if size >= ROWS_BYTES:
                            yield _batch(held)
                            held, size = [], 0
                if seen != count:
                    raise ValueError(f"{name} has {seen} records, {count} by the manifest")
                if held:
                    yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    sql_types = {pa.int64(): "long", pa.string(): "string"}
    return listed.mapInArrow(run, ", ".join(f"{f.name} {sql_types[f.type]}" for f in schema))


def round_trip(pages: DataFrame) -> DataFrame:
    """What the reader finds in the archives of pages, in a new folder beside the checkpoints."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder, payloads=False).drop("url")
