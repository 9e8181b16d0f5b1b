"""Removal of word sequences that repeat anywhere in a corpus.

Every ``window`` consecutive words of a document are a window. Each task counts its windows in a count-min sketch of two
rows; the sketches are merged cell by cell. A merged cell can only overestimate, so a window with a cell that counts 1
occurs once, and every repeated window is among those estimated repeated. A second pass groups exactly those, by
96-bit digests of their words, and the words that repeated windows cover are removed.

The windows of the second pass travel in runs that share a minimiser (the least hash of the short word sequences inside
a window), so that equal windows meet and the row overhead is paid once a run. Windows that the sketch holds for very
frequent are dealt out over SALTS groups; a group that sees such a window once passes it on to a small second round.
Where many different windows share one minimiser, which the sketching tasks count as well (by cells), each travels by its
own hash instead.

Defined results: a null text has no words. Rows with equal text are different documents, so all their windows repeat,
also when the key is equal or null. Texts shorter than a window keep all words. Other columns are not read.

Memory: the sketch grows with the input up to DEPTH rows of 2**MOST_BITS cells; its merged bits, one a cell, are
broadcast in compressed form. Beyond that many windows it filters less and less and the exact pass does more; results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import stored
from folioforge.llm.hashing import Windows, mixed, portions

DEPTH, SHARD_BITS = 2, 6
#: A row of the sketch has at least CELLS_PER_WINDOW times as many cells as there are windows, between these powers of two.
LEAST_BITS, MOST_BITS, CELLS_PER_WINDOW, BYTES_PER_WORD = 20, 30, 1.5, 6
SALTS, DIGEST = 64, 12
#: Cells that minimisers are counted in, and the windows of one from which on its windows travel alone: this share of all, or many.
PIECE_BITS, PIECE_SHARE, PIECE_LEAST = 12, 512, 65_536
#: Windows counted before a task hands on its sketch.
HELD = 4_000_000


def cell_bits(docs: DataFrame) -> int:
    """The size of a sketch row as a power of two, from the bytes of the column text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(size / BYTES_PER_WORD * CELLS_PER_WINDOW).bit_length()))


def cells_of(windows: Windows, row: int, bits: int) -> np.ndarray:
    return (mixed(windows.hash, row + 1) >> np.uint64(64 - bits)).astype(np.uint32)


def piece_cells(minimiser: np.ndarray) -> np.ndarray:
    return (mixed(minimiser, 21) >> np.uint64(64 - PIECE_BITS)).astype(np.int64)


def packed(cells: np.ndarray) -> bytes:
    """Sorted cells as steps of a byte each; 255 is a step that reaches no cell."""
    steps = np.diff(cells, prepend=np.uint32(0)).astype(np.int64)
    skips = steps // 255
    out = np.full(len(steps) + skips.sum(), 255, np.uint8)
    out[np.cumsum(skips + 1) - 1] = steps % 255
    return zlib.compress(out.tobytes(), 1) if len(out) > 4 * len(cells) else b"\0" + out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data[1:] if data[:1] == b"\0" else zlib.decompress(data), np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _shards(held: list[np.ndarray], row: int, bits: int) -> Iterator[tuple[int, bytes]]:
    cells, size = np.sort(np.concatenate(held)), 1 << bits - SHARD_BITS
    bounds = np.searchsorted(cells, np.arange(1, 1 << SHARD_BITS, dtype=np.uint32) * np.uint32(size))
    for shard, part in enumerate(np.split(cells, bounds)):
        if len(part):
            yield row << SHARD_BITS | shard, packed(part - np.uint32(shard * size))


def sketched(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """Merged sketch: shard, bits (which cells count 2 or more, packed) and hot (the few cells of a large share); shard -1 has the hot cells of minimisers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        task = TaskContext.get().partitionId()
        pieces = np.zeros(1 << PIECE_BITS, np.int64)

        def flush() -> pa.RecordBatch:
            rows = [x for row in range(DEPTH) for x in _shards(held[row], row, bits)]
            for part in held:
                part.clear()
            return pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in rows], pa.int32()), "task": pa.array([task] * len(rows), pa.int32()), "cells": pa.array([c for _, c in rows], pa.binary())})

        for batch in batches:
            for _, texts in portions(batch.column(0)):
                windows = Windows(texts, window)
                if len(windows.hash):
                    pieces += np.bincount(piece_cells(windows.minimiser), minlength=len(pieces))
                    for row in range(DEPTH):
                        held[row].append(cells_of(windows, row, bits))
                if sum(map(len, held[0])) >= HELD:
                    yield flush()
        if held[0]:
            yield flush()
        if pieces.any():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([-1], pa.int32()), "task": pa.array([task], pa.int32()), "cells": pa.array([zlib.compress(pieces.tobytes(), 1)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total, pieces = -2, np.zeros(1 << bits - SHARD_BITS, np.uint32), np.zeros(1 << PIECE_BITS, np.int64)

        def result() -> pa.RecordBatch:
            if shard == -1:
                many = np.flatnonzero(pieces > max(PIECE_LEAST, int(pieces.sum()) // PIECE_SHARE))
                return pa.RecordBatch.from_pydict({"shard": pa.array([-1], pa.int32()), "bits": pa.array([b""], pa.binary()), "hot": pa.array([many.astype("<u4").tobytes()], pa.binary())})
            hot = np.flatnonzero(total > max(256, int(total.sum()) // 1024))
            twice = zlib.compress(np.packbits(total > 1).tobytes(), 1)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "bits": pa.array([twice], pa.binary()), "hot": pa.array([hot.astype("<u4").tobytes()], pa.binary())})

        for batch in batches:
            for now, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != shard:
                    if shard >= -1:
                        yield result()
                    shard = now
                    total[:] = 0
                if shard == -1:
                    pieces += np.frombuffer(zlib.decompress(cells), np.int64)
                else:
                    np.add.at(total, unpacked(cells), 1)
        if shard >= -1:
            yield result()

    parts = docs.mapInArrow(count, "shard int, task int, cells binary").select("shard", "cells")
    return parts.repartition(DEPTH << SHARD_BITS, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary, hot binary")


def joined_bits(rows: list, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By sketch row: one bit a cell, and the sorted hot cells; and the hot cells of minimisers."""
    pieces = np.zeros(0, np.uint32)
    twice = [np.zeros(1 << bits - 3, np.uint8) for _ in range(DEPTH)]
    hot: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    size = 1 << bits - SHARD_BITS
    for r in rows:
        if r.shard == -1:
            pieces = np.frombuffer(r.hot, "<u4")
            continue
        row, shard = r.shard >> SHARD_BITS, r.shard & (1 << SHARD_BITS) - 1
        twice[row][shard * size // 8 : (shard + 1) * size // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
        hot[row].append(np.frombuffer(r.hot, "<u4") + np.uint32(shard * size))
    return twice, [np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint32) for x in hot], pieces


def _digests(text: bytes, words: np.ndarray, window: int) -> bytes:
    parts = text.split()
    line = memoryview(b" ".join(parts))
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)))
    return b"".join([blake2b(line[a:b], digest_size=DIGEST).digest() for a, b in zip(at[words].tolist(), (at[words + window] - 1).tolist(), strict=True)])


RUN = "bucket long, salt int, id long, print int, first int, offsets binary, digests binary"


def candidates(docs: DataFrame, window: int, bits: int, sketch: list) -> DataFrame:
    """Runs of windows estimated repeated, with their digests. docs: id, print (a hash of the text), text."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hot, pieces = joined_bits(shared.value, bits)
        for batch in batches:
            for start, texts in portions(batch.column("text")):
                w = Windows(texts, window)
                cells = [cells_of(w, row, bits) for row in range(DEPTH)]
                maybe = np.ones(len(w.hash), bool)
                for row in range(DEPTH):
                    maybe &= (twice[row][cells[row] >> 3] >> (7 - (cells[row] & 7)).astype(np.uint8) & 1).astype(bool)
                chosen = np.flatnonzero(maybe)
                if not len(chosen):
                    continue
                often = np.logical_and.reduce([np.isin(cells[row][chosen], hot[row]) for row in range(DEPTH)])
                text, word, least_piece = w.text[chosen], w.word[chosen], w.minimiser[chosen]
                if len(pieces):
                    least_piece = np.where(np.isin(piece_cells(least_piece), pieces), mixed(w.hash[chosen], 31), least_piece)
                by_text = np.searchsorted(text, np.arange(len(texts) + 1))
                digests = b"".join(_digests(texts[t], word[a:b], window) for t, (a, b) in enumerate(zip(by_text[:-1], by_text[1:], strict=True)) if b > a)
                order = np.lexsort((word, often, least_piece, text))
                text, word, least_piece, often = text[order], word[order], least_piece[order], often[order]
                data = np.frombuffer(digests, np.dtype((np.void, DIGEST)))[order]
                new = np.ones(len(text), bool)
                # a minimiser can come back later in a text; offsets have to fit a byte
                new[1:] = (np.diff(text) > 0) | (np.diff(least_piece) != 0) | (np.diff(often.astype(np.int8)) != 0) | (np.diff(word) > 1)
                at = np.flatnonzero(new)
                length = np.diff(np.append(at, len(text)))
                while (length > 200).any():
                    new[(at + 200)[length > 200]] = True
                    at = np.flatnonzero(new)
                    length = np.diff(np.append(at, len(text)))
                offsets = (word - np.repeat(word[at], length)).astype(np.uint8)
                ends = np.append(at, len(text))
                rows = pa.array(text[at] + start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least_piece[at].view(np.int64)),
                        pa.array(np.where(often[at], 1 + text[at] % SALTS, 0).astype(np.int32)),
                        batch.column("id").take(rows),
                        batch.column("print").take(rows),
                        pa.array(word[at].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(offsets)]),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * DIGEST).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]),
                    ],
                    ["bucket", "salt", "id", "print", "first", "offsets", "digests"],
                )

    return docs.mapInArrow(run, RUN)


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _repeated(digests: np.ndarray) -> np.ndarray:
    """Whether each digest occurs again among digests."""
    parts = digests.view("<u4").reshape(-1, 3)
    order = np.lexsort((parts[:, 0], parts[:, 1], parts[:, 2]))
    same = (parts[order][1:] == parts[order][:-1]).all(1)
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


SPAN = "id long, print int, first int, last int, digest binary"


def exactly_repeated(runs: DataFrame) -> DataFrame:
    """id, print, first, last: neighbouring windows that occur elsewhere too, by the first words of the first and last."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(table: pa.Table) -> pa.RecordBatch:
            columns = {name: table[name].combine_chunks() for name in table.schema.names}
            offsets = _bytes_of(columns["offsets"])
            digests = _bytes_of(columns["digests"]).view(np.dtype((np.void, DIGEST)))
            length = np.array([len(x) for x in columns["offsets"].to_pylist()])
            row = np.repeat(np.arange(len(length)), length)
            word = offsets.astype(np.int64) + columns["first"].to_numpy()[row]
            salted = columns["salt"].to_numpy()[row] > 0
            again = _repeated(digests)
            hit = np.flatnonzero(again)
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(row[hit]) > 0) | (np.diff(word[hit]) > 1)
            at = np.flatnonzero(new)
            to = np.append(at, len(hit))[1:] - 1
            # frequent windows: one seen once here goes on, one seen often leaves a mark
            alone = np.flatnonzero(salted & ~again)
            _, mark = np.unique(digests[salted & again].view("S12") if (salted & again).any() else np.zeros(0, "S12"), return_index=True)
            mark = np.flatnonzero(salted & again)[mark]
            rows = pa.array(np.concatenate((row[hit[at]], row[alone], row[mark])))
            first = np.concatenate((word[hit[at]], word[alone], np.full(len(mark), -1)))
            last = np.concatenate((word[hit[to]], word[alone], np.full(len(mark), -1)))
            passed = [None] * len(at) + [digests[i].tobytes() for i in (*alone, *mark)]
            return pa.RecordBatch.from_arrays(
                [columns["id"].take(rows), columns["print"].take(rows), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(passed, pa.binary())],
                ["id", "print", "first", "last", "digest"],
            )

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bucket, salt = table["bucket"].to_numpy(), table["salt"].to_numpy()
            changes = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0))
            whole = int(changes[-1]) + 1 if len(changes) else 0
            if whole:
                yield judged(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None and len(held):
            yield judged(held)

    return runs.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(group, SPAN)


def resolved(spans: DataFrame) -> DataFrame:
    """Spans without digest stand; those passed on stand if their digest was passed on by another group as well."""
    passed = spans.where("digest is not null")
    often = passed.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    late = passed.where("first >= 0").join(often, "digest", "left_semi")
    return spans.where("digest is null").unionByName(late).select("id", "print", "first", "last")


def removed(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and kept_text (the kept words, joined by one space) of every row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("id"), F.hash(F.col(text)).alias("print"), F.col(text).alias("text"))
    bits = cell_bits(named)
    sketch = sketched(named.select("text"), window, bits).collect()  # compressed; at most DEPTH << MOST_BITS - 3 bytes
    runs = candidates(named.select("id", "print", "text"), window, bits, sketch)
    spans = resolved(stored(exactly_repeated(runs))).distinct()
    by_text = stored(spans.groupBy("id", "print").agg(F.collect_list(F.struct("first", "last")).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for value, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (value or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for x in found or ():
                    edge[x["first"]] += 1
                    edge[x["last"] + window] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c] if found else words
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], [key, "n_words", "n_removed", "kept_text"]
            )

    both = named.join(by_text, ["id", "print"], "left").select("key", "text", "spans")
    return both.mapInArrow(cut, f"`{key}` {kind}, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return removed(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
