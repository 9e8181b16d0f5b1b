"""Language-model scores by prediction by partial matching over bytes, beside a word-frequency base.

A text is its words in lower case (A-Z only), joined by one blank, and one end symbol. The model is a trie of byte
contexts of up to ORDER bytes with the counts of what follows them. In a context with n occurrences of d different
symbols, a symbol seen c times has (2c - 1) / 2n and escaping d / 2n (method D); what is escaped to are the shorter
context's probabilities without the symbols that the longer one has seen, made to sum to 1 again (exclusion). Below the
empty context all 256 symbols are alike. A document's score is the log10 probability of its symbols: the code length.

Defined results: a null text is the empty text, which still has its end. Rows with a null key are held out. Without
training text, every symbol has 1/256. Repeated rows are scored each. Other columns are not read.

Scale: counts of words and of contexts are gathered over all training rows, added up in every task and then by Spark. The
order is ORDER at every size. A symbol's probability follows from the ORDER + 1 bytes that end with it, so at most
MOST_ENTRIES of these sequences, the most frequent ones, are broadcast with their probabilities; the others are counted
by document, scored once each where all counts of their contexts meet (``resolved``) and joined. Contexts of up to NEAR - 1
bytes, whose number the bytes bound, are broadcast whole for that. Words that make up at least one FREQUENT-th of all
tokens, FREQUENT at most, are broadcast; the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import hot_bound, lookup, stored
from folioforge.llm.language import held_out

ORDER, MOST_ENTRIES, FREQUENT = 5, 3_000_000, 2_000_000
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
WORDS_HELD, BYTES_HELD = 200_000, 2_000_000
#: The longest sequences that are broadcast whole, and rows whose longer contexts are built at a time.
NEAR, ROWS_HELD = 3, 1 << 18


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z only, and at the six blank characters


def _keys(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of several texts, each after ORDER start symbols, and where each text's first symbol is."""
    lead, end = bytes([START] * ORDER), bytes([END])
    parts = [lead + b" ".join(words) + end for words in texts]
    first = np.cumsum([0, *map(len, parts)])[:-1] + ORDER
    return np.frombuffer(b"".join(parts), np.uint8), first


def grams(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By symbol, start symbols left out: it and the ORDER before it as one number, the symbol lowest."""
    wide = symbols.astype(np.uint64)
    out = wide[ORDER:].copy()
    for back in range(1, ORDER + 1):
        out |= wide[ORDER - back : len(wide) - back] << np.uint64(8 * back)
    inside = np.ones(len(out), bool)
    for back in range(1, ORDER + 1):
        at = first - ORDER - back
        inside[at[at >= 0]] = False
    return out[inside]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def counted(texts: DataFrame) -> DataFrame:
    """kind (word or gram), key and n over all rows of texts (text); the word key 0 of kind end counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        merged, held, size, ends = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0, 0

        def rows(kind: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(keys), pa.string()), "key": pa.array(keys), "n": pa.array(counts)})

        def add() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _summed(np.concatenate((merged[0], keys)), np.concatenate((merged[1], counts)))

        for batch in batches:
            for start in range(0, len(batch), 64):
                part = [_words(text) for text in batch.column(0).slice(start, 64).to_pylist()]
                ends += len(part)
                for text in part:
                    words.update(text)
                held.append(grams(*stream(part)))
                size += len(held[-1])
                if size >= BYTES_HELD:
                    merged, held, size = add(), [], 0
                if len(merged[0]) >= 2 * BYTES_HELD:
                    yield rows("gram", merged[0].view(np.int64), merged[1])
                    merged = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(words) >= WORDS_HELD:
                    yield rows("word", _keys(list(words)), np.fromiter(words.values(), np.int64, len(words)))
                    words.clear()
        if held:
            merged = add()
        yield rows("gram", merged[0].view(np.int64), merged[1])
        yield rows("word", _keys(list(words)), np.fromiter(words.values(), np.int64, len(words)))
        yield rows("end", np.zeros(1, np.int64), np.array([ends], np.int64))

    return texts.mapInArrow(run, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Table:
    """Values by 64-bit key (not 0), by open addressing; all look-ups of an array at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(1.5 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            at, left = (at[~placed] + 1) & (1 << self.bits) - 1, left[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        at = self._slot(keys)
        seen = self.keys[at]
        found = seen == keys
        out = np.where(found, self.values[at], np.float32(0))
        left = np.flatnonzero(~found & (seen != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (1 << self.bits) - 1
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            going = ~hit & (seen != 0)
            left, at = left[going], at[going]
        return out, found


def _marked(grams_: np.ndarray, length: int) -> np.ndarray:
    """Keys of sequences of ``length`` symbols: a mark above the symbols."""
    low = grams_ & np.uint64((1 << 8 * length) - 1)
    return low | np.uint64(length + 1 << 56)


def _followed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, each sequence's place among them, their kinds of symbols and twice their counts, and each sequence's share."""
    context, place, kinds = np.unique(gram >> np.uint64(8), return_inverse=True, return_counts=True)
    whole = 2 * np.bincount(place, n, len(context))
    return context, place, kinds, whole, (2 * n - 1) / whole[place]


def trie(top: np.ndarray, counts: np.ndarray, order: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and log10 probabilities of all (context, symbol), keys and log10 escape factors of all contexts.

    top: sequences of order + 1 symbols with their counts. near: sequences of NEAR symbols with their shares; sequences of
    up to that length are left out then.
    """
    keys, logs, contexts, factors = [], [], [], []
    lower_keys, lower = near or (np.zeros(0, np.uint64), np.zeros(0))
    for length in range(NEAR + 1 if near else 1, order + 2):
        gram, n = _summed(top & np.uint64((1 << 8 * length) - 1), counts)
        context, place, kinds, whole, p = _followed(gram, n)
        if length == 1:
            below = np.full(len(gram), 1 / 256)
        else:
            below = lower[np.searchsorted(lower_keys, gram & np.uint64((1 << 8 * (length - 1)) - 1))]
        rest = np.maximum(1 - np.bincount(place, below, len(context)), 1e-12)
        keys.append(_marked(gram, length))
        logs.append(np.log10(p))
        contexts.append(_marked(context, length - 1))
        factors.append(np.log10(kinds / whole / rest))
        lower_keys, lower = gram, p
    return np.concatenate(keys), np.concatenate(logs).astype(np.float32), np.concatenate(contexts), np.concatenate(factors).astype(np.float32)


class Model:
    def __init__(self, order: int, keys: np.ndarray, logs: np.ndarray, contexts: np.ndarray, factors: np.ndarray) -> None:
        self.order, self.entries, self.contexts = order, Table(keys, logs), Table(contexts, factors)

    def descend(self, gram: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 factors of each symbol down to sequences of ``least`` symbols, and the places of those not found by then."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for length in range(self.order + 1, least - 1, -1):
            now = gram[left]
            value, found = self.entries.get(_marked(now, length))
            out[left] += value
            left, now = left[~found], now[~found]
            if not len(left):
                break
            out[left] += self.contexts.get(_marked(now >> np.uint64(8), length - 1))[0]
        return out, left

    def symbol_scores(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after those before it."""
        out, left = self.descend(gram, 1)
        out[left] -= log10(256)
        return out


def model_of(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Order, and the most frequent sequences of order + 1 symbols with their log10 probabilities; from the counted grams."""
    grams_ = counts.where("kind = 'gram'").select("key", "n", F.shiftright("key", 8).alias("context"), F.floor(4 * F.log2("n")).alias("level"))
    least, entries = 0, 0
    for level, n in sorted(grams_.groupBy("level").count().collect(), reverse=True):
        entries += n
        least = level + 1
        if entries > MOST_ENTRIES:
            break
        least = level
    whole = grams_.groupBy("context").agg((2 * F.sum("n")).alias("whole"))
    table = grams_.where(F.col("level") >= least).join(whole, "context").select("key", ((2 * F.col("n") - 1) / F.col("whole")).alias("p")).toArrow()
    return ORDER, _marked(table["key"].to_numpy().view(np.uint64), ORDER + 1), np.log10(table["p"].to_numpy()).astype(np.float32)


def resolved(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, uses and value (log10 probability of its symbol) of each row of wanted (gram, uses); from the counted grams.

    All sequences whose contexts end alike in NEAR bytes meet in one task, which builds their contexts and scores them.
    """
    mask = F.lit((1 << 8 * NEAR) - 1)
    grams_ = counts.where("kind = 'gram'").select(F.col("key").alias("gram"), "n")
    short = grams_.groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    gram, n = short["gram"].to_numpy().view(np.uint64), short["n"].to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast((trie(gram, n, NEAR - 1), (gram, _followed(gram, n)[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, near = shared.value
        base = Model(NEAR - 1, *low)

        def scores(table: pa.Table) -> pa.RecordBatch:
            gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
            asked = np.flatnonzero(n == 0)
            gram, top, n = gram[asked], gram[n > 0], n[n > 0]
            value, left = Model(ORDER, *trie(top, n, ORDER, near)).descend(gram, NEAR + 1)
            value[left] += base.symbol_scores(gram[left])
            return pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "uses": table["uses"].combine_chunks().take(pa.array(asked)), "value": pa.array(value)})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS_HELD:
                table = pa.Table.from_batches(held)
                changes = np.flatnonzero(np.diff(table["key"].to_numpy()))
                if len(changes):
                    yield scores(table.slice(0, int(changes[-1]) + 1))
                    held = table.slice(int(changes[-1]) + 1).combine_chunks().to_batches()
        if held:
            yield scores(pa.Table.from_batches(held))

    both = grams_.select("gram", "n", F.lit(0).cast("long").alias("uses")).unionByName(wanted.select("gram", F.lit(0).cast("long").alias("n"), "uses"))
    met = both.withColumn("key", F.shiftright("gram", 8).bitwiseAND(mask)).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "gram long, uses long, value double")


def scored(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learned from the rows of train."""
    kind = docs.schema[key].dataType.simpleString()
    counts = stored(counted(train.select(text)))
    tokens, kinds, ends = counts.where("kind <> 'gram'").agg(F.sum("n"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.sum(F.when(F.col("kind") == "end", F.col("n")).otherwise(0))).first()
    tokens, kinds, ends = tokens or 0, kinds or 0, ends or 0
    words = counts.where("kind = 'word'").select("key", "n")
    often = tokens // FREQUENT + 1
    common = words.where(F.col("n") >= often).toArrow().sort_by("key")  # FREQUENT words at most
    shared = docs.sparkSession.sparkContext.broadcast((model_of(counts), common["key"].to_numpy(), common["n"].to_numpy(), ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, often_keys, often_logs), known_keys, known_counts, ends = shared.value
        frequent, logs = Table(often_keys, often_logs), np.log10(known_counts + 0.1)
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                texts = [_words(x) for x in part.column("text").to_pylist()]
                symbols, first = stream(texts)
                gram, starts = grams(symbols, first), first - ORDER * np.arange(1, len(first) + 1)
                values, found = frequent.get(_marked(gram, ORDER + 1))
                scores = np.add.reduceat(values.astype(np.float64), starts)
                # sequences that aren't broadcast, once a document with how often they occur there
                text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gram))))[~found]
                gram = gram[~found]
                place = np.lexsort((gram, text))
                gram, text = gram[place], text[place]
                new = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])))[: len(gram)])
                times = np.diff(np.append(new, len(gram)))
                seldom = pa.StructArray.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "times"])
                seldom = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(len(starts) + 1)).astype(np.int32)), seldom)
                base, known, rare = [], [], []
                for text in texts:
                    own = Counter(text)
                    hashes, n = _keys(list(own)), np.fromiter(own.values(), np.int64, len(own))
                    at = np.minimum(np.searchsorted(known_keys, hashes), max(len(known_keys) - 1, 0))
                    hit = known_keys[at] == hashes if len(known_keys) else np.zeros(len(hashes), bool)
                    base.append(float((logs[at[hit]] * n[hit]).sum()) + log10(ends + 0.1))
                    known.append(int(n[hit].sum()) + (ends > 0))
                    rare.append([{"word": w, "times": t} for w, t in zip(hashes[~hit].tolist(), n[~hit].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("key", "id", "print")),
                        pa.array([len(x) + 1 for x in texts], pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base),
                        pa.array(scores),
                        pa.array(rare, pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))),
                        seldom,
                    ],
                    ["key", "id", "print", "n_tokens", "known", "base", "score", "rare", "seldom"],
                )

    named = docs.select(F.col(key).alias("key"), F.xxhash64(key).alias("id"), F.hash(text).alias("print"), F.col(text).alias("text"))
    rows = stored(named.mapInArrow(run, f"key {kind}, id long, print int, n_tokens long, known long, base double, score double, rare array<struct<word:long,times:long>>, seldom array<struct<gram:long,times:long>>"))
    # rarer words: joined with their counts and added up by document; rows that are alike in key and text share a sum
    rare = rows.select("id", "print", F.explode("rare").alias("r")).select("id", "print", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    counted_words = words.where(F.col("n") < often).select(F.col("key").alias("word"), F.col("n").alias("c"))
    joined = rare.join(counted_words, "word", "left").select(
        "id", "print", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("base_rare"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known_rare"), F.lit(0.0).alias("score_rare"), F.lit(0).alias("rows")
    )
    # rarer sequences: scored once each, joined back and added up likewise
    seldom = rows.select("id", "print", F.explode("seldom").alias("s")).select("id", "print", F.col("s.gram").alias("gram"), F.col("s.times").alias("times"))
    uses = seldom.groupBy("gram").agg(F.count("*").alias("uses"))
    values = stored(resolved(uses, counts))
    summed = lookup(seldom, values, "gram", "uses", hot_bound(values.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])).select(
        "id", "print", F.lit(0.0).alias("base_rare"), F.lit(0).cast("long").alias("known_rare"), (F.col("times") * F.col("value")).alias("score_rare"), F.lit(0).alias("rows")
    )
    own = rows.select("id", "print", F.lit(0.0).alias("base_rare"), F.lit(0).cast("long").alias("known_rare"), F.lit(0.0).alias("score_rare"), F.lit(1).alias("rows"))
    sums = joined.unionByName(summed).unionByName(own).groupBy("id", "print").agg(*[F.sum(c).alias(c) for c in ("base_rare", "known_rare", "score_rare", "rows")])
    total = log10(tokens + 0.1 * (kinds + 1))
    return rows.drop("rare", "seldom").join(sums, ["id", "print"]).select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.expr("known_rare div rows")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_rare") / F.col("rows") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + F.col("score_rare") / F.col("rows")).alias("score"),
    )


def scored_by_folds(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out and the columns of ``scored``: learned from the rows that are not held out."""
    out = held_out("doc_id", folds)
    found = scored(docs, docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
