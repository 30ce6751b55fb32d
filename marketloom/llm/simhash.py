"""SimHash near-duplicates: BK-trees over shards of fingerprints that agree in some bit blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import connected_components
from marketloom.llm.shared import id_and_text, join_counted, materialise, slices, words_of

BITS = 64
#: Fingerprints that one BK-tree holds at most; larger shards are cut in chunks, each pair of which is a unit of work.
TREE_SIZE = 1024
#: Text bytes whose shingles a task holds at once.
PART_BYTES = 1 << 19
#: Times that large shards are dealt by further bits.
REFINED = 3
#: A shard's wished mean size; with more fingerprints the shards agree in more bits.
SHARD_SIZE = 128


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) for every row: the SimHash of the lower-cased (A-Z) text's word shingles.

    Shingles count as often as they occur. A text with fewer words than a shingle is one shingle
    of all its words; one without words has fingerprint 0, as has a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                fps = text_fingerprints(part.column(1), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def text_fingerprints(texts: pa.Array, shingle: int, seed: int) -> np.ndarray:
    words, counts = words_of(texts, lower=True)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    lengths = np.asarray(pc.binary_length(words), dtype=np.int64)
    blob = b" ".join(words.cast(pa.binary()).to_pylist())
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first = np.cumsum(counts) - counts
    shingles = np.maximum(counts - shingle + 1, 1)
    offsets = np.cumsum(shingles) - shingles
    # the shingles' first words: those of each text in turn
    head = np.repeat(first - offsets, shingles) + np.arange(shingles.sum())
    last = head + np.repeat(np.minimum(counts, shingle) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(blob[s:e], seed) for s, e in zip(starts[head].tolist(), ends[last].tolist(), strict=True)], dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, offsets, axis=0, dtype=np.int32)
    set_bits = (2 * votes > shingles[:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    __slots__ = ("children", "items")

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        at, new = 0, len(self.items)
        self.items.append(item)
        self.children.append({})
        while at != new:
            at = self.children[at].setdefault((self.items[at] ^ item).bit_count(), new)

    def search(self, item: int, radius: int) -> list[int]:
        """Places of the items within the radius."""
        found, todo = [], [0] if self.items else []
        while todo:
            at = todo.pop()
            distance = (self.items[at] ^ item).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)
        return found


def spanning_links(tree_items: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links within the radius, as few as connect all that they connect. queries None: the tree's own items."""
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []

    def link(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            links.append((a, b))

    tree = BKTree()
    for item in tree_items:
        if queries is None:
            for at in tree.search(item, radius):
                link(item, tree.items[at])
        tree.add(item)
    for item in queries or ():
        for at in tree.search(item, radius):
            link(item, tree.items[at])
    return links


def block_masks(count: int, radius: int) -> list[int]:
    """Masks such that fingerprints within the radius agree under one at least.

    64 bits are cut in radius + 1 blocks or more; at most radius of them can differ, so that some
    choice of the others agrees. More blocks give more masks of more bits each.
    """
    for blocks in range(radius + 1, BITS + 1):
        agree = blocks - radius
        if blocks == radius + 4 or count / 2 ** (BITS * agree // blocks) <= SHARD_SIZE:
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, agree)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with a part of its other bits each: fingerprints within the radius that agree under it agree under one of these."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    edges = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << bit for bit in free[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def refined(rows: DataFrame, masks: list[int], radius: int) -> tuple[list[int], DataFrame, bool]:
    """The finer masks too, rows (fp, mask, value) with large shards dealt by these, and whether there was none to deal.

    A shard is dealt anew if the squares of the new shards' sizes add up to less than its own.
    """
    key = ["mask", "value"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    dense = materialise(sizes.where(F.col("n") > TREE_SIZE))
    if dense.isEmpty():
        return masks, rows, True
    finer = {m: finer_masks(m, radius) for m in masks}
    table = rows.sparkSession.createDataFrame([(signed(m), signed(f)) for m, own in finer.items() for f in own], "mask long, finer long")
    inside = rows.join(dense, key).join(F.broadcast(table), "mask").withColumn("fine", F.col("fp").bitwiseAND(F.col("finer")))
    inside = materialise(inside)
    squares = inside.groupBy(*key, "n", "finer", "fine").agg(F.count("*").alias("k")).groupBy(*key, "n").agg(F.sum(F.col("k") * F.col("k")).alias("work"))
    better = materialise(squares.where(F.col("work") < F.col("n") * F.col("n")).select(*key))
    dealt = inside.join(better, key, "left_semi").select("fp", F.col("finer").alias("mask"), F.col("fine").alias("value"))
    kept = rows.join(better, key, "left_anti").select("fp", *key)
    every = list(dict.fromkeys([*masks, *(f for own in finer.values() for f in own)]))
    return every, materialise(kept.unionByName(dealt)), False


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _trees(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by unit; each unit is one tree, or one tree and the queries put to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, tree, queries, out = None, [], [], []

        def close() -> None:
            if len(tree) + len(queries) > 1:
                out.extend(spanning_links(tree, queries or None, radius))

        def emit() -> pa.RecordBatch:
            ends = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            fps = np.asarray(batch.column(3)).astype(np.int64).view(np.uint64).tolist()
            keys = zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)
            for key, is_query, fp in zip(keys, batch.column(2).to_pylist(), fps, strict=True):
                if key != unit:
                    close()
                    unit, tree, queries = key, [], []
                (queries if is_query else tree).append(fp)
            if len(out) > 10_000:
                yield emit()
        close()
        yield emit()

    return run


def fingerprint_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all within the radius.

    nodes: distinct fp. Fingerprints go to a shard for each block mask; a shard's BK-tree finds
    its links and keeps a spanning forest of them. A shard with over TREE_SIZE fingerprints is dealt
    again by further bits where that makes less work. One that stays as large is cut in m chunks;
    each pair of chunks is a unit of its own: nothing is capped and no task holds more than two
    chunks.
    """
    count = nodes.count()
    masks = block_masks(count, radius)
    shards = F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in masks))
    rows = nodes.select("fp", F.explode(shards).alias("s")).select("fp", "s.mask", "s.value")
    for _ in range(REFINED):
        masks, rows, done = refined(rows, masks, radius)
        if done:
            break
    sizes = rows.groupBy("mask", "value").agg(F.ceil(F.count("*") / TREE_SIZE).cast("int").alias("chunks")).where("chunks > 1")
    rows = rows.join(sizes, ["mask", "value"], "left").withColumn("m", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    # chunk c is the tree of the units (c, j) for j >= c and the query side of (i, c) for i < c
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")
    rows = rows.select("fp", "mask", "value", "own", other)
    units = rows.select(
        F.xxhash64("mask", "value").alias("shard"),
        F.concat_ws(":", "mask", "value", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        (F.col("other") < F.col("own")).alias("is_query"),
        "fp",
    )
    dealt = units.repartition("unit").sortWithinPartitions("unit", "is_query", "fp").select("shard", "unit", "is_query", "fp")
    return dealt.mapInArrow(_trees(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component) for every row: component is the smallest id reachable over links.

    Fingerprints link at radius or fewer differing bits; a row reaches itself. Copies share one
    fingerprint and are never expanded into pairs. Rows with a null id take part and get the
    component of their fingerprint, null where no id is known there; repeated rows are all kept.
    Texts of any length are taken whole.
    An empty table gives an empty table; columns besides the id and the text play no part.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = materialise(rooted.join(least, "root").select("fp", "component", "n"))
    # rows of one fingerprint, as all empty texts, meet its component where they are
    return join_counted(prints, named, ["fp"], prints.count()).select("id", "fp", "component")
