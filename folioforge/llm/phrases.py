"""Phrase collocations, counted in counting quotient filters.

Texts become streams of word ids. An n-gram of ids, packed side by side, is permuted invertibly (a Feistel network over
exactly its bits); the top bits of the permuted number are the quotient, the others the full remainder. A ``Filter``
holds the n-grams of a shard sorted by both: a bit a slot and a bit an entry say which remainders belong to which
quotient, beside a counter of a byte (larger counts follow in full). Nothing is approximate: every n-gram can be read
back. Each task writes the filters of its part, cut by the leading bits of the quotient; the filters of one such range
are merged in sorted order, whatever task they come from.

An n-gram of at least ``least`` occurrences consists of shorter ones with at least as many. So rare words end a stream,
and a longer n-gram is counted only where both of its inner parts are frequent, which is looked up in a bitmap of at
most 2**MOST_CELLS bits (a false positive costs a count, nothing else).

Candidates are phrases of 2 to 4 words. Each cut of a candidate has a score, the share of the phrase among the
occurrences of its two parts; the lowest counts. A candidate inside a longer one with nearly as many occurrences is dropped.

Defined results: a null or empty text has no words; a null language is ``und``. Repeated rows count again. Keys and
other columns are not read. Texts without frequent phrases, and empty tables, give no rows.

Scale: words and n-grams are added up in every task before anything is shuffled. The permuted numbers are uniform, so
ranges are even however frequent a phrase is; there are as many as the number of words asks for. The MOST_WORDS most
frequent words with their ids are broadcast; the ids of others are joined, by stretches of text.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored
from folioforge.llm.hashing import mixed

LONGEST = 4
#: Words held in a task before they are handed on, n-grams before they are sorted, and entries wanted in a range.
WORDS_HELD, GRAMS_HELD, RANGE_ENTRIES = 200_000, 2_000_000, 1 << 20
#: Most words that are broadcast, and the longest of them in bytes; the largest bitmap as a power of two.
MOST_WORDS, MOST_LETTERS, MOST_CELLS = 1 << 19, 64, 28
#: Bytes of text in a stretch.
STRETCH = 1 << 18
SALTS, BUCKETS = 64, 1024
IDS = [f"w{i}" for i in range(LONGEST)]

_LOWERED = bytes(ord("\n") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text; pieces end at sentence marks and line ends."""
    return [words for words in map(bytes.split, (text or "").encode().translate(_LOWERED).split(b"\n")) if words]


# --- the permutation and the filter -------------------------------------------------------------------------------


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Layout:
    """How n-grams of ids of ``width`` bits are packed: the first ids in the left number, the others in the right one."""

    def __init__(self, n: int, width: int, range_bits: int = 0) -> None:
        self.n, self.width = n, width
        self.left_ids = (n + 1) // 2
        self.left_bits, self.right_bits = self.left_ids * width, (n - self.left_ids) * width
        self.range_bits = min(range_bits, self.left_bits)
        self.low_bits = self.left_bits - self.range_bits

    def permuted(self, ids: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right = self._packed(ids[: self.left_ids]), self._packed(ids[self.left_ids :])
        with np.errstate(over="ignore"):
            for step in range(2):
                right = right ^ mixed(left, 40 + step) & _mask(self.right_bits)
                left = left ^ mixed(right, 50 + step) & _mask(self.left_bits)
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            for step in (1, 0):
                left = left ^ mixed(right, 50 + step) & _mask(self.left_bits)
                right = right ^ mixed(left, 40 + step) & _mask(self.right_bits)
        return self._ids(left, self.left_ids) + self._ids(right, self.n - self.left_ids)

    def _packed(self, ids: Sequence[np.ndarray]) -> np.ndarray:
        out = ids[0].astype(np.uint64)
        for x in ids[1:]:
            out = out << np.uint64(self.width) | x.astype(np.uint64)
        return out

    def _ids(self, packed: np.ndarray, count: int) -> list[np.ndarray]:
        return [packed >> np.uint64(self.width * i) & _mask(self.width) for i in reversed(range(count))]

    def sorted(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.left_bits + self.right_bits <= 64:
            return np.argsort(left << np.uint64(self.right_bits) | right, kind="stable")
        return np.lexsort((right, left))


def summed(layout: Layout, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted and distinct n-grams with their counts added up."""
    order = layout.sorted(left, right)
    left, right, counts = left[order], right[order], counts[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.add.reduceat(counts, at) if len(at) else counts


def _bytes(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _values(data: memoryview, count: int, bits: int) -> tuple[np.ndarray, memoryview]:
    size = -(-bits // 8)
    out = np.zeros((count, 8), np.uint8)
    out[:, :size] = np.frombuffer(data[: count * size], np.uint8).reshape(count, size)
    return out.view("<u8").reshape(count).astype(np.uint64), data[count * size :]


class Filter:
    """A counting quotient filter over one range of permuted n-grams: left (without the bits of the range), right and count, sorted."""

    def __init__(self, layout: Layout, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> None:
        self.layout, self.left, self.right, self.counts = layout, left, right, counts

    def packed(self) -> bytes:
        """Number of entries, then runs of remainders a quotient in unary, remainders, counters and the counters past a byte."""
        n = len(self.left)
        quotient_bits = min(self.layout.low_bits, n.bit_length())
        rest_bits = self.layout.low_bits - quotient_bits
        slot = (self.left >> np.uint64(rest_bits)).astype(np.int64)
        unary = np.zeros(n + (1 << quotient_bits), np.uint8)
        unary[slot + np.arange(n)] = 1  # an entry stands after one zero for each slot before its own
        large = self.counts >= 255
        parts = [np.array([n], "<u4").tobytes(), np.packbits(unary).tobytes(), _bytes(self.left & _mask(rest_bits), rest_bits), _bytes(self.right, self.layout.right_bits)]
        return b"".join([*parts, np.where(large, 255, self.counts).astype(np.uint8).tobytes(), self.counts[large].astype("<u8").tobytes()])

    @classmethod
    def unpacked(cls, layout: Layout, data: bytes) -> Filter:
        n = int(np.frombuffer(data[:4], "<u4")[0])
        quotient_bits = min(layout.low_bits, n.bit_length())
        rest_bits = layout.low_bits - quotient_bits
        size = n + (1 << quotient_bits)
        rest = memoryview(data)[4:]
        unary = np.unpackbits(np.frombuffer(rest[: -(-size // 8)], np.uint8), count=size)
        rest = rest[-(-size // 8) :]
        ones = np.flatnonzero(unary)
        slot = (ones - np.arange(n)).astype(np.uint64)
        low, rest = _values(rest, n, rest_bits)
        right, rest = _values(rest, n, layout.right_bits)
        counts = np.frombuffer(rest[:n], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(rest[n:], "<u8").astype(np.int64)
        return cls(layout, slot << np.uint64(rest_bits) | low, right, counts)

    @classmethod
    def merged(cls, filters: Sequence[Filter]) -> Filter:
        layout = filters[0].layout
        parts = [np.concatenate([getattr(f, name) for f in filters]) for name in ("left", "right", "counts")]
        return cls(layout, *summed(layout, *parts))


# --- words and streams of ids ------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and f of every word. docs: lang (never null), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array([w.decode() for w in words], pa.string()), "f": pa.array(list(words.values()), pa.int64())})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                words = held[lang.as_py()]
                for piece in pieces(text.as_py()):
                    words.update(piece)
                if len(words) >= WORDS_HELD or len(held) > 256 and sum(map(len, held.values())) >= WORDS_HELD:
                    yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """words (lang, word, f) with id, from 1 on without gaps: numbered inside buckets, which follow each other."""
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).drop("size")  # at most BUCKETS rows
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "bucket").select((F.col("before") + F.col("inside")).alias("id"), "lang", "word", "f")


def _tidy(ids: np.ndarray) -> np.ndarray:
    """ids without zeros that follow a zero and without ids between two zeros, which are in no n-gram."""
    set_ = ids != 0
    alone = set_ & ~np.append(set_[1:], False) & ~np.insert(set_[:-1], 0, False)
    ids = np.where(alone, 0, ids)
    set_ = ids != 0
    return ids[set_ | np.insert(set_[:-1], 0, False)]


def streams(docs: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """ids (int32, 0 between pieces and for rare words) of stretches of text. docs: lang, text; words: id, lang, word, f."""
    short = F.octet_length("word") <= MOST_LETTERS
    shown = words.where(short).orderBy(F.desc("f"), "id").limit(MOST_WORDS).toArrow()
    table: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, id_ in zip(shown["lang"].to_pylist(), shown["word"].to_pylist(), shown["id"].to_pylist(), strict=True):
        table[lang][word.encode()] = id_
    whole = len(shown) == count
    shared = docs.sparkSession.sparkContext.broadcast(dict(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, part, number = shared.value, TaskContext.get().partitionId(), 0
        out: list[int] = []
        missing: dict[tuple[str, bytes], int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            ids, number, size = np.array(out, np.int32), number + 1, 0
            names = list(missing)
            row = {"stretch": [part << 33 | number], "ids": [(_tidy(ids) if whole else ids).tobytes()], "missing": [[{"k": -missing[x], "lang": x[0], "word": x[1].decode()} for x in names]]}
            out.clear()
            missing.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("stretch", pa.int64()), ("ids", pa.binary()), ("missing", pa.list_(pa.struct([("k", pa.int32()), ("lang", pa.string()), ("word", pa.string())])))])
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                get = tables.get(lang, {}).get
                for piece in pieces(text):
                    if whole:
                        out.extend([get(w, 0) for w in piece])
                    else:
                        out.extend([get(w) or missing.setdefault((lang, w), -1 - len(missing)) for w in piece])
                    out.append(0)
                size += len(text or "")
                if size >= STRETCH:
                    yield flush()
        if out:
            yield flush()

    found = docs.select("lang", "text").mapInArrow(run, "stretch long, ids binary, missing array<struct<k: int, lang: string, word: string>>")
    if whole:
        return stored(found.select("ids"))
    found = stored(found)
    asked = found.select("stretch", F.inline("missing"))
    got = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("stretch").agg(F.collect_list(F.struct("k", "id")).alias("got"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, got in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(data, np.int32)
                known = np.zeros(1 - int(ids.min(initial=0)), np.int32)
                for x in got or []:
                    known[x["k"]] = x["id"]
                rows.append(_tidy(np.where(ids < 0, known[np.maximum(-ids, 0)], ids)).tobytes())
            yield pa.RecordBatch.from_pydict({"ids": pa.array(rows, pa.binary())})

    return stored(found.select("stretch", "ids").join(got, "stretch", "left").select("ids", "got").mapInArrow(fill, "ids binary"))


# --- counting ----------------------------------------------------------------------------------------------------


def _cells(layout: Layout, ids: Sequence[np.ndarray], bits: int) -> np.ndarray:
    left, right = layout.permuted(ids)
    with np.errstate(over="ignore"):
        return (mixed(left ^ mixed(right, 60), 61) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(grams: DataFrame, n: int, width: int, bits: int) -> bytes:
    """One bit a cell of the n-grams, compressed; what reaches the driver is bounded by 2**bits."""
    layout = Layout(n, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(layout, [batch.column(i).to_numpy() for i in range(n)], bits)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells)})

    cells = grams.select(*IDS[:n]).mapInArrow(run, "cell long")
    rows = cells.groupBy(F.shiftright("cell", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return zlib.compress(out.tobytes(), 1)


def counted(ids: DataFrame, n: int, width: int, range_bits: int, least: int, inner: tuple[int, bytes] | None) -> DataFrame:
    """w0 to w3 (0 past n) and f of n-grams with at least ``least`` occurrences. inner: bits and bitmap of the frequent (n-1)-grams."""
    layout = Layout(n, width, range_bits)
    shared = ids.sparkSession.sparkContext.broadcast(inner)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        if shared.value is not None:
            bits, data = shared.value
            known = np.frombuffer(zlib.decompress(data), np.uint64)

        def flush() -> pa.RecordBatch:
            left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            left, right, counts = summed(layout, left, right, np.ones(len(left), np.int64))
            ranges = (left >> np.uint64(layout.low_bits)).astype(np.int64) if layout.range_bits else np.zeros(len(left), np.int64)
            at = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(ranges)).tolist()
            filters = [Filter(layout, left[a:b] & _mask(layout.low_bits), right[a:b], counts[a:b]).packed() for a, b in zip(at[:-1], at[1:], strict=True)]
            held.clear()
            return pa.RecordBatch.from_pydict({"range": pa.array(ranges[at[:-1]], pa.int64()), "filter": pa.array(filters, pa.binary())})

        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, np.int32)
                if len(x) < n:
                    continue
                columns = [x[i : len(x) - n + 1 + i] for i in range(n)]
                chosen = np.logical_and.reduce([c != 0 for c in columns])
                if shared.value is not None:
                    cells = _cells(Layout(n - 1, width), [x[i : len(x) - n + 2 + i] for i in range(n - 1)], bits)
                    often = (known[cells >> 6] >> (cells & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    chosen &= often[:-1] & often[1:]
                at = np.flatnonzero(chosen)
                if len(at):
                    held.append(layout.permuted([c[at] for c in columns]))
                    size += len(at)
                if size >= GRAMS_HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, entries = -1, [], 0

        def result() -> pa.RecordBatch:
            whole = Filter.merged(held)
            often = whole.counts >= least
            left = whole.left[often] | np.uint64(now << layout.low_bits)
            found = layout.restored(left, whole.right[often]) + [np.zeros(int(often.sum()), np.uint64)] * (LONGEST - n)
            return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in found], pa.array(whole.counts[often])], [*IDS, "f"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield result()
                    held = []
                    entries = 0
                now = part
                held.append(Filter.unpacked(layout, data))
                entries += len(held[-1].left)
                if entries > 4 * RANGE_ENTRIES:
                    held = [Filter.merged(held)]
                    entries = 0
        if held:
            yield result()

    parts = ids.select("ids").mapInArrow(shards, "range long, filter binary")
    dealt = parts.repartition(min(1 << layout.range_bits, 4096), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(merge, ", ".join(f"{w} long" for w in [*IDS, "f"]))


# --- scores ------------------------------------------------------------------------------------------------------


def _ids(columns: Sequence[Column]) -> list[Column]:
    return [*columns, *[F.lit(0).cast("long")] * (LONGEST - len(columns))]


def _parts(which: str) -> Column:
    """The structs of a phrase's cuts (k, first part, rest) or of its shorter contiguous parts of two words or more."""
    w = [F.col(x) for x in IDS]

    def cut(k: int, n: int) -> Column:
        first = [c.alias(f"l{i}") for i, c in enumerate(_ids(w[:k]))]
        rest = [c.alias(f"r{i}") for i, c in enumerate(_ids(w[k:n]))]
        return F.struct(F.lit(k).alias("k"), *first, *rest)

    def inside(i: int, j: int) -> Column:
        return F.struct(*[c.alias(x) for x, c in zip(IDS, _ids(w[i:j]), strict=True)])

    def all_of(n: int) -> Column:
        if which == "cuts":
            return F.array(*[cut(k, n) for k in range(1, n)])
        return F.array(*[inside(i, i + m) for m in range(2, n) for i in range(n - m + 1)])

    out = F.when(F.col("size") == LONGEST, all_of(LONGEST)).when(F.col("size") == 3, all_of(3))
    return out.when(F.col("size") == 2, all_of(2)) if which == "cuts" else out


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """grams (size, w0..w3, a) with the l, r and score of the lowest cut, without those inside a longer one nearly as frequent."""
    single = words.select(F.col("id").alias("w0"), *[F.lit(0).cast("long").alias(x) for x in IDS[1:]], "f")
    counts = single.unionByName(grams.select(*IDS, F.col("a").alias("f")))
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    cuts = grams.select(*IDS, "size", "a", F.explode(_parts("cuts")).alias("cut")).select(*IDS, "size", "a", "cut.*")
    for side in "lr":
        cuts = cuts.join(counts.select(*[F.col(x).alias(f"{side}{i}") for i, x in enumerate(IDS)], F.col("f").alias(side)), [f"{side}{i}" for i in range(LONGEST)])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(28,0)) * 2000000) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))"))
    best = cuts.groupBy(*IDS, "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select(*IDS, "size", "a", "best.l", "best.r", "best.score")
    inside = grams.where("size > 2").select(F.explode(_parts("inside")).alias("part"), "a").groupBy("part").agg(F.max("a").alias("longer")).select("part.*", "longer")
    return best.join(inside, IDS, "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * 80)).drop("longer")


def ranked(found: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """lang, rank, phrase, a, l, r and score of the first phrases of each language."""
    first = words.select(F.col("id").alias("w0"), "lang", F.col("word").alias("p0"))
    rows = found.join(first, "w0").withColumn("salt", F.pmod(F.xxhash64(*IDS), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a")]
    for by in (["lang", "salt"], ["lang"]):  # all that tie stay until their texts are known
        rows = rows.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
    for i, w in enumerate(IDS[1:], 1):
        rows = rows.join(words.select(F.col("id").alias(w), F.col("word").alias(f"p{i}")), w, "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"p{i}" for i in range(LONGEST)]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "score")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``most`` phrases. docs: lang, text."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    every = stored(word_counts(docs))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(numbered(every.where(F.col("f") >= least)))
    count, tokens = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    width = max(1, count.bit_length())
    range_bits = max(0, (tokens // RANGE_ENTRIES).bit_length())
    ids = streams(docs, words, count)
    found, inner = [], None
    for n in range(2, LONGEST + 1):
        level = stored(counted(ids, n, width, range_bits, least, inner))
        found.append(level.withColumn("size", F.lit(n)).withColumnRenamed("f", "a"))
        if n < LONGEST:
            bits = min(MOST_CELLS, max(12, 4 + level.count().bit_length()))
            inner = bits, bitmap(level, n, width, bits)
    grams = found[0].unionByName(found[1]).unionByName(found[2])
    chosen = ranked(scored(grams, words), words, most)
    return chosen.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
