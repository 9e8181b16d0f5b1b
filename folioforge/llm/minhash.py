"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct word shingles. Equal sets form a class, which one document stands for. Each class
has a signature of TREES * DEPTH minima; tree t sorts the classes by its DEPTH minima. Classes that share the first
minima of a tree form a region; how many they must share depends on the region: the base depth follows from the
threshold (``base_depth``: a pair at the threshold meets in no tree with a chance of 2e-5 at most), and regions with
more than CROWD members are split at the next minimum where that leaves smaller groups. Small groups propose all their
pairs; in larger ones every class proposes its neighbours in the sorted order, those with the longest common prefix.
Regions with more than 1/4096 of all rows (and 256) go to a deeper prefix before they are sorted, and at full depth are dealt out
in an order that differs from tree to tree. Proposed pairs are confirmed exactly, on full sets, and the links are
joined into components. Crowded regions of the base depth, split or not, that hold several components are then searched
for links between them (``crowd_links``): the classes outside a region's largest component meet all of its classes, in
blocks, so that what the neighbours have missed is found as well.

Defined results: a text that is null or has no words has an empty set, is linked with nothing and is its own component.
Fewer words than a shingle make one shingle of all words. Rows with one key are one node, whatever their texts. A row
with a null key is linked with nothing, has a null component and is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import dropped, hot_bound, key_groups, lookup, stored, unused
from folioforge.llm.components import components
from folioforge.llm.hashing import Windows, mixed, portions

TREES, DEPTH, CROWD, MISSED = 16, 8, 8, 2e-5
#: Neighbours in the sorted order that a class of a crowded region proposes.
NEIGHBOURS = 2
#: Members of a crowded region that are compared with as many others at a time.
BLOCK = 256
#: Cells of the tables that large regions and wanted documents are looked up in.
CELLS, WANTED_BITS = 1 << 16, 27
#: Groups that a region which is large even at full depth is dealt out over.
SALTS = 64
_dice = np.random.default_rng(20240229)
_FLIP = _dice.integers(0, 1 << 32, TREES * DEPTH, np.uint32)[:, None]
_FACTOR = _dice.integers(0, 1 << 31, TREES * DEPTH, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def base_depth(least: float) -> int:
    """The most minima that pairs have to share in a tree while a pair at the threshold is missed rarely enough."""
    return max(d for d in range(1, DEPTH) if d == 1 or (1 - least**d) ** TREES <= MISSED)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    texts = [text.lower() for text in texts]  # of bytes: A-Z only
    windows = Windows(texts, size)
    bounds = np.searchsorted(windows.text, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        if bounds[i] < bounds[i + 1]:
            yield np.unique(windows.hash[bounds[i] : bounds[i + 1]])
        elif windows.n_words[i]:
            yield np.frombuffer(blake2b(b" ".join(text.split()), digest_size=8, person=b"short").digest(), np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    for start in range(0, len(low), 4096):
        values = (low[start : start + 4096] ^ _FLIP) * _FACTOR
        values ^= values >> np.uint32(15)
        out = np.minimum(out, (values * np.uint32(0x2C1B3C6D)).min(1))
    return out


def _class(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, n, class and sig of each row of docs (id, text); class and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in portions(batch.column("text")):
                sets = list(shingle_sets(texts, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, len(texts)),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([_class(x) if len(x) else None for x in sets], pa.binary()),
                        pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    ["id", "n", "class", "sig"],
                )

    return docs.mapInArrow(run, "id long, n long, class binary, sig binary")


def _regions(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """A hash of the first ``depth`` minima of a tree, by signature."""
    out = np.full(len(sig), tree * DEPTH + depth, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(depth):
            out = mixed(out ^ sig[:, tree * DEPTH + i].astype(np.uint64), 3)
    return out


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)


def region_rows(classes: DataFrame, depths: list[int]) -> DataFrame:
    """For each class and tree: region (of the adaptive depth), whole (its region of the base depth), label, tie, class, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(depths), CELLS), np.int64)
        for batch in batches:
            sig = _signatures(batch.column("sig"))
            for i, depth in enumerate(depths):
                for tree in range(TREES):
                    total[i] += np.bincount(_regions(sig, tree, depth) >> np.uint64(48), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at), "n": pa.array(total.ravel()[at])})

    counts = classes.select("sig").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # a cell is large if it holds 1/4096 of the rows over the mean of a cell; there are 4096 of a depth at most
    rows = classes.count() * TREES
    bound = hot_bound(rows, 4096, 256)
    large = np.array([r.cell for r in counts.where(F.col("n") > bound + rows // CELLS).select("cell").collect()], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column("sig"))
            own = np.frombuffer(b"".join(x[:8] for x in batch.column("class").to_pylist()), np.uint64)
            for tree in range(TREES):
                region = whole = _regions(sig, tree, depths[0])
                tie = mixed(own, 40 + tree)
                for i, depth in enumerate(depths):
                    crowded = np.isin(CELLS * i + (_regions(sig, tree, depth) >> np.uint64(48)).astype(np.int64), large)
                    deeper = _regions(sig, tree, depths[i + 1]) if i + 1 < len(depths) else mixed(_regions(sig, tree, depth) ^ tie % np.uint64(SALTS), 5)
                    region = np.where(crowded & (region == _regions(sig, tree, depth)), deeper, region)
                label = np.ascontiguousarray(sig[:, tree * DEPTH : (tree + 1) * DEPTH].astype(">u4")).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(region.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array([label[i : i + 4 * DEPTH] for i in range(0, len(label), 4 * DEPTH)], pa.binary()),
                        pa.array(tie.view(np.int64)),
                        batch.column("class"),
                        batch.column("n"),
                    ],
                    ["region", "whole", "label", "tie", "class", "n"],
                )

    return classes.select("class", "n", "sig").mapInArrow(deal, "region long, whole long, label binary, tie long, class binary, n long")


def neighbours(region: np.ndarray, labels: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of proposed pairs among rows that are sorted by region, label and tie."""
    left, right = [], []
    same = region[1:] == region[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    settled = np.zeros(len(region), bool)
    for depth in range(base, DEPTH + 1):
        if depth > base:
            same = same & (labels[1:, depth - 1] == labels[:-1, depth - 1])
            group = np.concatenate(([0], np.cumsum(~same)))
        small = (np.bincount(group)[group] <= CROWD) & ~settled
        for step in range(1, CROWD):
            hit = np.flatnonzero((group[step:] == group[:-step]) & small[:-step])
            left.append(hit)
            right.append(hit + step)
        if depth == base:
            crowded = ~small
            for step in range(1, NEIGHBOURS + 1):
                hit = np.flatnonzero((group[step:] == group[:-step]) & crowded[:-step])
                left.append(hit)
                right.append(hit + step)
        settled |= small
    return np.concatenate(left), np.concatenate(right)


def proposed(rows: DataFrame, base: int, percent: int) -> DataFrame:
    """Distinct pairs a < b of classes that are neighbours in a tree and whose sizes allow a link.

    Members of crowded or split regions, where not all pairs are proposed, come as a with the base region and a null b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            labels = np.frombuffer(b"".join(table["label"].to_pylist()), ">u4").reshape(-1, DEPTH)
            i, j = neighbours(table["region"].to_numpy(), labels, base)
            n = table["n"].to_numpy()
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            one, two = (table["class"].combine_chunks().take(pa.array(x[fits])).to_pylist() for x in (i, j))
            both = {(a, b) if a < b else (b, a) for a, b in zip(one, two, strict=True)}
            region, whole = table["region"].to_numpy(), table["whole"].to_numpy()
            _, place, size = np.unique(region, return_inverse=True, return_counts=True)
            crowd = np.flatnonzero((size[place] > CROWD) | (region != whole))
            members = table["class"].combine_chunks().take(pa.array(crowd)).to_pylist()
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([a for a, _ in both] + members, pa.binary()),
                    "b": pa.array([b for _, b in both] + [None] * len(members), pa.binary()),
                    "region": pa.array([None] * len(both) + whole[crowd].tolist(), pa.int64()),
                }
            )

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            changes = np.flatnonzero(np.diff(table["region"].to_numpy()))
            whole = int(changes[-1]) + 1 if len(changes) else 0
            if whole:
                yield pairs(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None and len(held):
            yield pairs(held)

    sorted_rows = rows.repartition("region").sortWithinPartitions("region", "label", "tie")
    return sorted_rows.mapInArrow(run, "a binary, b binary, region long").distinct()


def wanted_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class and set (sorted hashes) of the rows of docs (id, text) whose id is in wanted, and of a few others.

    The wanted ids go into a bitmap of 2**WANTED_BITS bits, so that the other texts are passed over where they are read.
    """
    cell = F.pmod(F.xxhash64("id"), F.lit(1 << WANTED_BITS))
    cells = wanted.select(cell.alias("cell")).groupBy(F.expr("cell div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(cell % 32768)").alias("bits"))
    bitmap = np.zeros(1 << WANTED_BITS - 3, np.uint8)
    for part, bits in cells.collect():
        bitmap[part * 4096 : part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cell").to_numpy()
            batch = batch.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            for _, texts in portions(batch.column("text")):
                sets = [x for x in shingle_sets(texts, size) if len(x)]
                yield pa.RecordBatch.from_pydict({"class": pa.array([_class(x) for x in sets], pa.binary()), "set": pa.array([x.tobytes() for x in sets], pa.binary())})

    return docs.where("id is not null").select(cell.alias("cell"), "text").mapInArrow(run, "class binary, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    first = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("one")), "a")
    return first.join(sets.select(F.col("class").alias("b"), F.col("set").alias("two")), "b").select("a", "b", "one", "two").mapInArrow(run, "a binary, b binary")


def with_shape(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (region, ...) with the other columns of sizes and outer and inner, the blocks of BLOCK rows that a region's outsiders and members fill.

    sizes: region, members, outsiders, ... Regions with very many rows are few and looked up by broadcast (see common.lookup).
    """
    outer, inner = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("outsiders", "members"))
    shape = sizes.withColumns({"outer": outer, "inner": inner}).drop("outsiders")
    total = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    return lookup(rows, shape, "region", "members", hot_bound(total))


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (region, class, outside, outer, inner, ...) dealt out so that each row outside meets all rows of its region, in one task each.

    A key for each pair of a block of BLOCK rows outside (side 0) and a block of BLOCK rows of the region (side 1).
    """
    dealt = rows.withColumn("own", F.xxhash64("class"))
    one, two = F.pmod("own", F.col("outer")), F.pmod("own", F.col("inner"))
    left = dealt.where("outside").withColumn("side", F.lit(0)).withColumn("one", one).withColumn("two", F.explode(F.expr("sequence(0L, inner - 1L)")))
    right = dealt.withColumn("side", F.lit(1)).withColumn("one", F.explode(F.expr("sequence(0L, outer - 1L)"))).withColumn("two", two)
    both = left.unionByName(right).withColumn("key", F.xxhash64("region", "one", "two"))
    return both.drop("outer", "inner", "one", "two").repartition("key").sortWithinPartitions("key")


def _alike(part: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components, one outside and any other, whose sizes and signatures leave room for a link."""
    sig, n = _signatures(part["sig"]), part["n"].to_numpy()
    component, side, own, outside = (part[c].to_numpy() for c in ("component", "side", "own", "outside"))
    right = np.flatnonzero(side == 1)
    share = percent / 100
    enough = TREES * DEPTH * share - 6 * np.sqrt(TREES * DEPTH * share * (1 - share))
    found = []
    for i in np.flatnonzero(side == 0):
        once = ~outside[right] | (own[right] >= own[i])  # two rows outside meet twice
        fits = right[once & (component[right] != component[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        fits = fits[(sig[fits] == sig[i]).sum(1) >= enough]
        found.append(np.stack([np.full(len(fits), i), fits]))
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def crowd_links(crowd: DataFrame, known: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """one and two: components that a link joins which the proposals have missed, found exactly inside crowded regions.

    crowd: region, class; known: class, rep, n, sig, component. Where a region's members aren't all of one component, those
    outside its largest component are compared with all of them by signature, block by block; only those that may link
    across components have their sets compared. Links inside a component change nothing and are passed over.
    """
    members = crowd.join(known.select("class", "component"), "class")
    parts = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    regions = parts.groupBy("region").agg(F.sum("n").alias("members"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most")).where("members > most")
    mixed = stored(regions.select("region", "members", "largest", (F.col("members") - F.col("most")).alias("outsiders")))
    if mixed.isEmpty():
        return mixed.sparkSession.createDataFrame([], "one long, two long")
    # shapes are looked up before signatures come in, so that these are joined once and not in each branch of the look-up
    placed = stored(with_shape(members, mixed).select("region", "class", (F.col("component") != F.col("largest")).alias("outside"), "outer", "inner"))
    rows = in_blocks(placed.join(known.select("class", "component", "n", "sig"), "class"))

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_groups(batches):
            at = np.unique(np.concatenate(_alike(part, percent)))
            yield from part.select(["region", "class", "outside"]).take(pa.array(at)).combine_chunks().to_batches()

    needed = stored(rows.mapInArrow(open_pairs, "region long, class binary, outside boolean").distinct())
    wanted = needed.select("class").distinct()
    ids = known.select("class", F.col("rep").alias("id")).join(wanted, "class", "left_semi")
    sets = stored(wanted_sets(docs, ids, size).join(wanted, "class", "left_semi").dropDuplicates(["class"]))
    sizes = stored(needed.groupBy("region").agg(F.count("*").alias("members"), F.count_if("outside").alias("outsiders")))
    shaped = stored(with_shape(needed, sizes))
    left = shaped.join(known.select("class", "component", "n", "sig"), "class").join(sets, "class")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_groups(batches):
            component = part["component"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part["set"].to_pylist()]
            joined: set[tuple[int, int]] = set()
            for i, j in zip(*_alike(part, percent), strict=True):
                pair = int(min(component[i], component[j])), int(max(component[i], component[j]))
                if pair not in joined:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        joined.add(pair)
            yield pa.RecordBatch.from_pydict({"one": pa.array([a for a, _ in joined], pa.int64()), "two": pa.array([b for _, b in joined], pa.int64())})

    return in_blocks(left).mapInArrow(link, "one long, two long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and kept (key = component_id) of every row of docs; the key is a long."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    base = base_depth(percent / 100)
    rows = stored(sketches(docs, size))
    known = rows.where("id is not null and class is not null")
    classes = stored(known.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    found = stored(proposed(region_rows(classes, [base, (base + DEPTH) // 2, DEPTH]), base, percent))
    pairs, crowd = found.where("b is not null").select("a", "b"), found.where("b is null").select("region", F.col("a").alias("class"))
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    reps = classes.select("class", "rep")
    wanted = ends.join(reps, "class").select("class", F.col("rep").alias("id"))
    sets = stored(wanted_sets(docs, wanted, size).join(ends, "class", "left_semi").dropDuplicates(["class"]))
    links = confirmed(pairs, sets, percent)
    named = links.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("one")), "a").join(reps.select(F.col("class").alias("b"), F.col("rep").alias("two")), "b").select("one", "two")
    # a key with several texts links their classes
    several = known.groupBy("id").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> last").select("id")
    own = known.join(several, "id", "left_semi").join(reps, "class").select(F.col("id").alias("one"), F.col("rep").alias("two"))
    links = stored(named.unionByName(own))
    joined = stored(components(links, "one", "two"))
    placed = stored(classes.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node"))
    dropped(classes)
    late = stored(crowd_links(crowd, placed, docs, percent, size))
    dropped(sets)
    if not late.isEmpty():
        joined = components(joined.select(F.col("node").alias("one"), F.col("component").alias("two")).unionByName(late), "one", "two")
        placed = placed.drop("component").join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    by_class = placed.select("class", "component", "copies")
    linked = lookup(known.select("id", "n", "class"), by_class, "class", "copies", hot_bound(rows.count())).select("id", "n", "component")
    alone = rows.where("id is null or class is null").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, without near-duplicates: one row of each component, and rows with a null key.

    Of several rows with the kept key, the one whose text sorts first stays.
    """
    kept = near_duplicates(docs, percent, size, key, text).where("kept").select(key).where(F.col(key).isNotNull()).distinct()
    named = docs.where(F.col(key).isNotNull()).join(kept, key, "left_semi")
    row = unused(docs, "row_of_key")
    first = named.withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(text))).where(F.col(row) == 1).drop(row).select(*docs.columns)
    return first.unionByName(docs.where(F.col(key).isNull()))
