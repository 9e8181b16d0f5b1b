"""Language identification of mixed-language text.

A language model is a table of letter-trigram and short-word counts, learned from all labelled rows. Script ranges
narrow the languages of each word, every word gets a score for each of them, and a Viterbi pass with a switching
penalty labels the words; runs of one label are spans. A document's language is the one with most letters in its
spans, its score their share of all letters.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no spans, and so is every text when
nothing was learned. Ties go to the language that sorts first. A script that no language was learned with leaves all
languages as candidates. Repeated rows stay, clashing extra columns are not read. The model has a fixed number of slots
a language, of which it holds those seen, so it is as small as the languages are few at every input size. Up to DENSE
languages are laid out whole; with more, texts go in smaller portions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_BITS, SMOOTHING, SHORT_WORD, DENSE = 17, 0.3, 5, 64
SLOTS = 1 << SLOT_BITS
#: Nats: what a switch costs, how much one word can count, and what a word of a foreign script costs.
PENALTY, WORD_BOUND, FOREIGN = 14.0, 8.0, 30.0
#: A language uses a script if it has at least this share of its letters.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
#: First and last code point of the blocks of scripts; letters elsewhere count as one more script.
SCRIPT_RANGES = [
    [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],  # Latin
    [(0x370, 0x3FF), (0x1F00, 0x1FFF)],  # Greek
    [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],  # Cyrillic
    [(0x530, 0x58F)],  # Armenian
    [(0x590, 0x5FF)],  # Hebrew
    [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFEFC)],  # Arabic
    [(0x900, 0x97F)],  # Devanagari
    [(0x980, 0x9FF)],  # Bengali
    [(0xB80, 0xBFF)],  # Tamil
    [(0xC00, 0xC7F)],  # Telugu
    [(0xE00, 0xE7F)],  # Thai
    [(0x10A0, 0x10FF)],  # Georgian
    [(0x1200, 0x139F)],  # Ethiopic
    [(0x3040, 0x30FF), (0x31F0, 0x31FF)],  # Kana
    [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],  # Hangul
    [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],  # Han
]
SCRIPTS = len(SCRIPT_RANGES) + 2  # 0: no letter; the last: any other letter


@lru_cache(1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script of a letter (0 for anything else) and its lower case."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    script[letters] = SCRIPTS - 1
    for c in letters:
        if len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    for number, ranges in enumerate(SCRIPT_RANGES, 1):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = number
    return script, lower


class Words:
    """The words (runs of letters) of several texts with their feature slots."""

    def __init__(self, texts: list[str]) -> None:
        script_of, lower = letter_tables()
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(text) + 1 for text in texts])
        script = script_of[points]
        is_letter = script > 0
        small = np.where(is_letter, lower[points], 0).astype(np.uint32)
        before, after = np.concatenate(([0], small[:-1])).astype(np.uint32), np.concatenate((small[1:], [0])).astype(np.uint32)
        at = np.flatnonzero(is_letter)
        mixed = before[at] * np.uint32(0x9E3779B1) ^ small[at] * np.uint32(0x85EBCA77) ^ after[at] * np.uint32(0xC2B2AE3D)
        self.trigram = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - SLOT_BITS)
        first = before[at] == 0
        self.first = np.flatnonzero(first)  # where a word's letters begin among all letters
        self.start = at[self.first]
        self.length = np.diff(np.append(self.first, len(at)))
        self.script = script[self.start]
        self.text = np.searchsorted(ends, self.start, "right")
        self.short = np.flatnonzero(self.length <= SHORT_WORD)
        code = np.full(len(self.short), 7, np.uint32)
        for j in range(SHORT_WORD):
            inside = self.length[self.short] > j
            code[inside] = code[inside] * np.uint32(0x01000193) + small[self.start[self.short[inside]] + j]
        self.short_slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
        self.offset = ends - np.array([len(text) + 1 for text in texts])  # where each text begins

    def of_texts(self, chosen: np.ndarray) -> np.ndarray:
        """Counts by slot, then letters by script, of the chosen texts (a boolean a text)."""
        word = chosen[self.text]
        letter = np.repeat(word, self.length)
        slots = np.bincount(self.trigram[letter], minlength=SLOTS) + np.bincount(self.short_slot[word[self.short]], minlength=SLOTS)
        return np.concatenate([slots, np.bincount(np.repeat(self.script, self.length)[letter], minlength=SCRIPTS)])


def portions(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts of about ``most`` characters together, each with its first position; null is empty."""
    start, held, size = 0, [], 0
    for i in range(0, len(column), 64):
        for text in column.slice(i, 64).to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= most:
                yield start, held
                start, held, size = start + len(held), [], 0
    if held:
        yield start, held


class Rows:
    """Log probabilities by language and slot: of slots not seen with a language one value, of the others their own."""

    def __init__(self, unseen: np.ndarray, slots: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.unseen, self.slots, self.values = unseen, slots, values
        self.laid_out: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.unseen)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "laid_out": {}}

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.laid_out:
            return self.laid_out[i]
        if i >= len(self):
            raise IndexError(i)
        row = np.full(SLOTS, self.unseen[i], np.float32)
        row[self.slots[i]] = self.values[i]
        if len(self) <= DENSE:
            self.laid_out[i] = row
        return row

    def portion(self) -> int:
        """Characters of texts that are scored together."""
        return max(1 << 12, (1 << 18) * DENSE // max(DENSE, len(self)))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], Rows, np.ndarray]:
    """Languages in order, log probabilities by language and slot, and which language uses which script.

    Every labelled row counts; rows with a null text or language are passed over. Each task adds up its own table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for start, texts in portions(batch.column("text")):
                words = Words(texts)
                for name in set(langs[start : start + len(texts)]):
                    counts = words.of_texts(langs[start : start + len(texts)] == name)
                    total[name] = total[name] + counts if name in total else counts
        for name, counts in total.items():
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(slot), pa.string()), "slot": pa.array(slot.astype(np.int32)), "n": pa.array(counts[slot].astype(np.int64))})

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    place = {name: i for i, name in enumerate(langs)}
    row, slot, n = np.array([place[name] for name in counts["lang"].to_pylist()], np.int64), counts["slot"].to_numpy(), counts["n"].to_numpy()
    feature = slot < SLOTS
    letters = np.zeros((len(langs), SCRIPTS))
    letters[row[~feature], slot[~feature] - SLOTS] = n[~feature]
    row, slot, n = row[feature], slot[feature], n[feature]
    whole = np.bincount(row, n, len(langs)) + SMOOTHING * max(len(np.unique(slot)), 1)
    order = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[order], np.arange(1, len(langs)))
    values = np.log((n + SMOOTHING) / whole[row]).astype(np.float32)
    scripts = letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)
    return langs, Rows(np.log(SMOOTHING / whole).astype(np.float32), np.split(slot[order], bounds), np.split(values[order], bounds)), scripts


def word_scores(words: Words, logs: Rows, scripts: np.ndarray) -> np.ndarray:
    """By word and language, 0 for the best and not under -WORD_BOUND, or -FOREIGN where the script rules a language out."""
    scores = np.empty((len(words.first), len(logs)), np.float32)
    for i in range(len(logs)):
        row = logs[i]
        scores[:, i] = np.add.reduceat(row[words.trigram], words.first)
        scores[words.short, i] += row[words.short_slot]
    open_to = scripts.T[words.script]
    open_to[~open_to.any(1)] = True
    scores[~open_to] = -np.inf
    scores -= scores.max(1, keepdims=True)
    return np.where(open_to, np.maximum(scores, -WORD_BOUND), -FOREIGN)


def constant_path(scores: np.ndarray) -> int:
    """The language of all words if leaving it can't pay for the switches, else -1.

    Leaving it for another language over some words gains at most the largest sum of differences over neighbouring
    words; k such excursions need k - 1 switches at least, and one needs 1 unless it takes the whole text.
    """
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, 0), 0)
    low = np.concatenate((np.zeros((1, low.shape[1])), low[:-1]))
    return best if (gain - low).max() <= PENALTY / 2 else -1


def best_path(scores: np.ndarray) -> np.ndarray:
    """Viterbi: the language of each word that maximises the scores less PENALTY a switch; ties stay, then sort first.

    Scores are at most 0. Once a language leads all others by PENALTY it goes on to do so for as long as words score 0
    for it, so such words are passed over together.
    """
    rows, own = scores.tolist(), range(scores.shape[1])
    dents = [np.flatnonzero(column < 0).tolist() for column in scores.T]  # where a language isn't the best
    value, came, i = [0.0] * len(own), [], 0
    while i < len(rows):
        top = max(value)
        floor, lead = top - PENALTY, value.index(top)
        if rows[i][lead] == 0 and sum(v <= floor for v in value) == len(own) - 1:
            at = bisect_left(dents[lead], i)
            to = dents[lead][at] if at < len(dents[lead]) else len(rows)
            came.append((i, to, None, floor, lead))
            value = [top if o == lead else floor + rows[to - 1][o] for o in own]
        else:
            to = i + 1
            came.append((i, to, value, floor, lead))
            value = [(floor if v < floor else v) + r for v, r in zip(value, rows[i], strict=True)]
        i = to
    path = np.empty(len(rows), np.int64)
    now = value.index(max(value))
    for i, to, before, floor, lead in reversed(came):
        path[to - 1] = now
        path[i : to - 1] = lead
        if before is None or before[now] < floor:
            now = lead
    return path


def label(texts: list[str], logs: Rows, scripts: np.ndarray) -> Iterator[tuple[int, float, list[tuple[int, int, int]], float]]:
    """For each text: language (-1: none), score, spans (start, end, language) in code points, share of letters in learned scripts."""
    words = Words(texts)
    if not len(logs) or not len(words.first):
        yield from ((-1, 0.0, [], 0.0) for _ in texts)
        return
    scores = word_scores(words, logs, scripts)
    bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield -1, 0.0, [], 0.0
            continue
        constant = constant_path(scores[a:b])
        path = np.full(b - a, constant) if constant >= 0 else best_path(scores[a:b])
        letters = np.bincount(path, words.length[a:b], len(logs))
        best = int(letters.argmax())
        cut = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [b - a]))
        start, length = words.start[a:b] - words.offset[i], words.length[a:b]
        explained = words.length[a:b][scripts.any(0)[words.script[a:b]]].sum() / letters.sum()
        yield best, float(letters[best] / letters.sum()), [(int(start[x]), int(start[y - 1] + length[y - 1]), int(path[x])) for x, y in zip(cut[:-1], cut[1:], strict=True)], float(explained)


def predict(docs: DataFrame, model: tuple[list[str], Rows, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and spans (start, end, lang; code points, end exclusive) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, scripts = shared.value
        name = [*langs, UNDETERMINED]
        for batch in batches:
            for start, texts in portions(batch.column("text"), logs.portion()):
                found = list(label(texts, logs, scripts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(start, len(texts)),
                        pa.array([name[i] for i, *_ in found], pa.string()),
                        pa.array([score for _, score, *_ in found], pa.float64()),
                        pa.array([[{"start": a, "end": b, "lang": name[i]} for a, b, i in spans] for _, _, spans, _ in found], span),
                    ],
                    [key, "lang_pred", "score", "spans"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def held_out(key: str = "doc_id", folds: int = 5):
    """Whether nothing is learned from a row: crc32 of its key as text leaves 0, or the key is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: learned from the rows that are not held out, predicted for all."""
    model = learn(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def identified(docs: DataFrame, least_explained: float = 0.5) -> DataFrame:
    """The rows of docs, columns unchanged, with at least this share of letters in scripts of learned languages, in however many languages."""
    langs, logs, scripts = learn(docs.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast((logs, scripts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in portions(batch.column("text"), shared.value[0].portion()):
                keep = [i >= 0 and explained >= least_explained for i, _, _, explained in label(texts, *shared.value)]
                yield batch.slice(start, len(texts)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
