"""Near-duplicates by five-word shingles: MinHash bands propose, SimHash sketches sift, the shingle sets decide.

At a word-shingle Jaccard similarity of 0.8 two 64-bit SimHashes of five-word shingles differ in
about 10 bits, beyond what shards of agreeing bits can find, and single words change as much as
shingles where an edit is contiguous. The least hashes of the shingles agree with the probability
of the similarity whatever the edit: texts at 0.8 share no band with probability 5e-5. 512 SimHash
bits of the shingles leave out clearly different texts of a band, and each link is verified on
the sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.components import connected_components
from marketloom.llm.shared import compact, id_and_text, join_counted, materialise, slices, words_of

#: Nodes of a unit of work; larger shards are cut in units of about that size.
TREE_SIZE = 1024
#: Text bytes whose shingles a task holds at once.
PART_BYTES = 1 << 19
#: Shingles of a chunk where sets are compared.
CHUNK_SHINGLES = 1 << 20
#: Bands of so many least hashes; a pair is a candidate where it agrees in one of them.
BANDS, DEPTH = 25, 5
#: Most keys whose sets are picked by broadcast.
BROADCAST_KEYS = 1_000_000
#: 64-bit parts of the shingles' sketch.
WIDE = 8
_GOLDEN = 0x9E3779B97F4A7C15
#: The bits of a byte as eight one-byte counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each run's SimHash: the bits that are set in over half of its hashes.

    Eight one-byte counters are added as one 64-bit number, over at most 255 hashes at a time.
    """
    sizes = np.diff(np.append(offsets, len(hashes)))
    cuts = -(-sizes // 255)
    first = np.cumsum(cuts) - cuts
    starts = np.repeat(offsets - 255 * first, cuts) + 255 * np.arange(cuts.sum())
    counters = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    votes = np.add.reduceat(counters.view(np.uint8), first, axis=0, dtype=np.int32)
    return np.packbits((2 * votes > sizes[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def _stream(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of what the hashes stand for."""
    return _mix(hashes + np.uint64((k + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))


def text_shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A key of each text's words in order, the texts with words, their distinct shingle hashes and where each one's begin."""
    words, counts = words_of(texts, lower=True)
    key = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return key, full, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    counts = counts[full]
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    hashes = known[np.asarray(coded.indices)]
    first = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(first, counts)
    key[full] = np.add.reduceat(_mix(hashes + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN)), first)
    number = np.maximum(counts - shingle + 1, 1)
    offsets = np.cumsum(number) - number
    head = np.repeat(first - offsets, number) + np.arange(number.sum())
    length = np.repeat(np.minimum(counts, shingle), number)
    rolled = np.zeros(len(head), dtype=np.uint64)
    for j in range(shingle):
        word = hashes[np.minimum(head + j, len(hashes) - 1)]
        rolled = np.where(j < length, _mix(rolled + word + np.uint64(_GOLDEN)), rolled)
    owner = np.repeat(np.arange(len(full)), number)
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    new = np.append(True, (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1]))
    rolled, owner = rolled[new], owner[new]
    return key, full, rolled, np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))


def text_sketches(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of each text's words in order, and BANDS hashes of least shingles and WIDE sketch parts as columns."""
    key, full, rolled, starts = text_shingles(texts, shingle)
    out = np.zeros((BANDS + WIDE, len(key)), dtype=np.uint64)
    if not len(full):
        return key, out
    for k in range(BANDS):
        band = np.full(len(full), k + 1, dtype=np.uint64)
        for j in range(k * DEPTH, (k + 1) * DEPTH):
            # shingle hashes are random already: an own odd factor orders them anew
            factor = _mix(np.array([(j + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)) | np.uint64(1)
            band = _mix(band + np.minimum.reduceat(rolled * factor, starts))
        out[k, full] = band
    for k in range(WIDE):
        out[BANDS + k, full] = _majority(_stream(rolled, k), starts)
    return key, out


def sketch_limit(similarity: float) -> int:
    """Most bits in which the sketches of sets of that Jaccard similarity differ: the mean and five standard deviations.

    The mean is that of large sets and a quarter more, as ties part small sets more often (most at
    4 and 5 shingles: 0.1875 of the bits at 0.8).
    """
    bits = 64 * WIDE
    share = min(1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi, 0.5)
    return round(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def unit_links(wide: np.ndarray, limit: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(place, earlier place, bits apart) of links whose sketches agree, and the classes that they form.

    As few links as connect all places that agreeing sketches connect; a place is linked to the
    closest one of each class that it meets.
    """
    kind = np.arange(len(wide))
    links = []
    for at in range(1, len(wide)):
        apart = np.bitwise_count(wide[:at] ^ wide[at]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= limit)
        if not len(near):
            continue
        near = near[np.argsort(apart[near], kind="stable")]
        met, first = np.unique(kind[near], return_index=True)
        links += [(at, int(other), int(apart[other])) for other in near[first]]
        kind[: at + 1][np.isin(kind[: at + 1], met)] = at
        kind[at] = at
    return links, kind


def unit_crossings(roots: np.ndarray, wide: np.ndarray, asks: np.ndarray, limit: int) -> np.ndarray:
    """Places of the queries and members that agree with one of another root by their sketches."""
    members = np.flatnonzero(~asks)
    met = np.zeros(len(roots), dtype=bool)
    for at in np.flatnonzero(asks):
        others = members[roots[members] != roots[at]]
        near = others[np.bitwise_count(wide[others] ^ wide[at]).sum(axis=1, dtype=np.int64) <= limit]
        met[near] = True
        met[at] |= len(near) > 0
    return np.flatnonzero(met)


def unit_verified(roots: np.ndarray, wide: np.ndarray, asks: np.ndarray, shingles: np.ndarray, ends: np.ndarray, limit: int, similarity: float) -> list[tuple[int, int]]:
    """(query, member) links of similar sets, enough to connect all that similar queries and members of other roots connect.

    shingles: the sorted sets of all places in turn; ends: where each one's begin, and the end of the last.
    """
    kind, members, sizes = np.unique(roots, return_inverse=True)[1], np.flatnonzero(~asks), np.diff(ends)
    links = []
    for at in np.flatnonzero(asks):
        others = members[kind[members] != kind[at]]
        near = others[np.bitwise_count(wide[others] ^ wide[at]).sum(axis=1, dtype=np.int64) <= limit]
        if not len(near):
            continue
        own = shingles[ends[at] : ends[at + 1]]
        length = sizes[near]
        starts = np.cumsum(length) - length
        theirs = shingles[np.repeat(ends[near] - starts, length) + np.arange(length.sum())]
        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        common = np.add.reduceat(own[place] == theirs, starts, dtype=np.int64)
        similar = near[common >= similarity * (len(own) + length - common) - 1e-9]
        met, first = np.unique(kind[similar], return_index=True)
        links += [(int(at), int(other)) for other in similar[first]]
        kind[np.isin(kind, met)] = kind[at]
    return links


#: What a unit gives: links, or (with b null) a member for each of its classes in a shard of several units.
FOUND = "a long, b long, apart int, shard long"


def _units(solve: Callable[[pa.RecordBatch], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by unit, their first column; solve is called with all rows of a unit, of which there are a few thousand at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(part: pa.RecordBatch) -> pa.RecordBatch:
            unit = np.asarray(part.column(0))
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            found = [row for lo, hi in zip(cuts, cuts[1:], strict=False) for row in solve(part.slice(lo, hi - lo))]
            columns = list(zip(*found, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "b", "apart", "shard"])

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.asarray(batch.column(0))
            last = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
            if held and held[0].column(0)[0].as_py() != unit[0]:
                yield solved(_joined(held))
                held = []
            if last:
                yield solved(_joined([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield solved(_joined(held))

    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, shard) of each node and band that it shares with another node. nodes: distinct key, bands b0.."""
    rows = nodes.select("key", F.explode(F.array(*(F.xxhash64(F.lit(k), f"b{k}") for k in range(BANDS)))).alias("shard"))
    shared = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard")
    return materialise(rows.join(shared, "shard").select("key", "shard"))


WIDE_NAMES = [f"w{k}" for k in range(WIDE)]


def _wide(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(part.column(c)) for c in WIDE_NAMES], axis=1).view(np.uint64)


def spanning_links(rows: DataFrame, nodes: DataFrame, limit: int, level: int = 0) -> DataFrame:
    """(a, b, apart) links within shards, and a member (a, shard) for each class of a unit where its shard has several.

    Shards over TREE_SIZE nodes are cut in units of about that size. rows: key, shard.
    """

    def solve(part: pa.RecordBatch) -> list[tuple]:
        if part.num_rows == 1 and part.column("shard").null_count:
            return []
        keys = part.column("key").to_pylist()
        links, kind = unit_links(_wide(part), limit)
        found = [(keys[a], keys[b], apart, None) for a, b, apart in links]
        shard = part.column("shard")[0].as_py()
        if shard is not None:
            found += [(keys[n], None, None, shard) for n in np.unique(kind, return_index=True)[1]]
        return found

    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / TREE_SIZE).cast("int").alias("m"))
    cut = rows.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("key", F.lit(level)), F.col("m")).cast("int"))
    units = cut.select(F.xxhash64("shard", "own").alias("unit"), "key", F.when(F.col("m") > 1, F.col("shard")).alias("shard")).join(nodes.select("key", *WIDE_NAMES), "key")
    return units.select("unit", "key", "shard", *WIDE_NAMES).repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(_units(solve), FOUND)


def crossing_units(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unit, key, root, is_query, sketch parts), sorted by unit: each pair of a shard's nodes with other roots meets in a unit.

    Nodes of a shard's largest root need not meet each other: all others, in chunks, are queries
    that meet all nodes, in chunks likewise. So a shard's rows grow with its size times the chunks of
    the others, not with its square. A chunk has about TREE_SIZE nodes and CHUNK_SHINGLES shingles.
    rows: key, shard, root, size (a number of shingles; 0 where sets are not needed).
    """
    counts = rows.groupBy("shard", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    sizes = counts.groupBy("shard").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.max("c").alias("c"), F.sum("s").alias("s"))
    chunks = lambda c: F.ceil(F.greatest(c / TREE_SIZE, F.col("s") / CHUNK_SHINGLES)).cast("int")
    sizes = sizes.where("n > c").select("shard", "most", chunks(F.col("n")).alias("m"), chunks(F.col("n") - F.col("c")).alias("q"))
    cut = rows.join(sizes, "shard")
    place = lambda salt, parts: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(parts)).cast("int")
    steps = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    members = cut.select("shard", "key", "root", F.lit(False).alias("is_query"), place("m", "m").alias("j"), steps("q").alias("i"))
    queries = cut.where("root <> most").select("shard", "key", "root", F.lit(True).alias("is_query"), place("q", "q").alias("i"), steps("m").alias("j"))
    both = members.unionByName(queries).select(F.xxhash64("shard", "i", "j").alias("unit"), "key", "root", "is_query")
    return both.join(nodes, "key").select("unit", "key", "root", "is_query", *(c for c in nodes.columns if c != "key")).repartition("unit").sortWithinPartitions("unit", "key", "is_query")


def _asks(part: pa.RecordBatch) -> np.ndarray:
    return part.column("is_query").to_numpy(zero_copy_only=False).astype(bool)


def crossing_links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, sets: DataFrame, shingle: int, limit: int, similarity: float) -> DataFrame:
    """(a, b) of similar nodes of a shard with other roots, enough to connect all there are. rows: key, shard, root.

    First sketches tell which nodes agree with one of another root at all; the sets of these alone
    come to the units, and pairs are verified there: no pair is written that is not similar.
    """

    def agreeing(part: pa.RecordBatch) -> list[tuple]:
        keys = part.column("key").to_pylist()
        return [(keys[n], None, None, None) for n in unit_crossings(np.asarray(part.column("root")), _wide(part), _asks(part), limit)]

    def similar(part: pa.RecordBatch) -> list[tuple]:
        keys, own = part.column("key").to_pylist(), part.column("shingles")
        ends = np.append(0, np.cumsum(np.asarray(own.value_lengths(), dtype=np.int64)))
        shingles = np.asarray(own.flatten()).view(np.uint64)
        found = unit_verified(np.asarray(part.column("root")), _wide(part), _asks(part), shingles, ends, limit, similarity)
        return [(keys[a], keys[b], None, None) for a, b in found]

    sketches = nodes.select("key", *WIDE_NAMES)
    open_keys = materialise(crossing_units(rows.withColumn("size", F.lit(0)), sketches).mapInArrow(_units(agreeing), FOUND).select(F.col("a").alias("key")).distinct())
    _released(docs.sparkSession)
    sets = shingle_sets(docs, open_keys, shingle, sets).join(open_keys, "key", "left_semi")
    sized = rows.join(sets.select("key", F.size("shingles").alias("size")), "key")
    sized = materialise(sized)
    _released(docs.sparkSession)
    units = crossing_units(sized, sketches.join(sets, "key"))
    return units.mapInArrow(_units(similar), FOUND).select("a", "b").distinct()


def _released(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of steps that are over: they stay until the driver collects what stands for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _ordered(links: DataFrame) -> DataFrame:
    """(a, b, apart), distinct and a > b."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "apart").distinct()


def shingle_sets(docs: DataFrame, keys: DataFrame, shingle: int, known: DataFrame | None = None) -> DataFrame:
    """(key, shingles) of the texts with one of the keys, and those known already. docs: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                key, full, rolled, starts = text_shingles(part.column(1), shingle)
                ends = pa.array(np.append(starts, len(rolled)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(key[full].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(rolled.view(np.int64)))], ["key", "shingles"])

    keys = materialise(keys if known is None else keys.join(known, "key", "left_anti"))
    count = keys.count()
    if not count and known is not None:
        return known
    few = count <= BROADCAST_KEYS
    sets = docs.mapInArrow(run, "key long, shingles array<long>").join(F.broadcast(keys) if few else keys, "key", "left_semi")
    sets = materialise(sets.dropDuplicates(["key"]))
    return sets if known is None else known.unionByName(sets)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, few: bool = False) -> DataFrame:
    """The pairs whose sets have the Jaccard similarity. few: at most BROADCAST_KEYS pairs, so that no other sets need to travel."""
    ends = {c: sets.join(F.broadcast(pairs.select(F.col(c).alias("key"))), "key", "left_semi") if few else sets for c in "ab"}
    left, right = (own.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c, own in ends.items())
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("a", "b")


def _rooted(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links with the roots of their ends, of which those between two roots are left."""
    if roots is None:
        return links.withColumns({"ra": F.col("a"), "rb": F.col("b")})
    for end in "ab":
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return links.where("ra <> rb")


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, linked: DataFrame | None = None) -> DataFrame:
    """(a, b) keys of similar nodes, enough to connect all that share a band and have the similarity.

    docs: id, text; nodes: distinct key, bands b0.., sketch parts w0..; linked: (a, b) keys that are
    linked already, each to the smallest of its class, which are given too. Units of each shard propose
    links that would connect them, and members of large shards' classes do so once more. Each node's
    closest link is verified, then each component's (once where links are given), then all that are left between components, so
    that a group of copies costs about as many comparisons as it has texts. Last, all agreeing pairs
    between unconnected nodes of a shard are compared: no link between components is left out.
    """
    limit = sketch_limit(similarity)
    rows = band_rows(nodes)
    first = materialise(spanning_links(rows, nodes, limit))
    again = spanning_links(first.where("b is null").select(F.col("a").alias("key"), "shard"), nodes, limit, 1)
    tried = materialise(_ordered(first.unionByName(again).where("b is not null")))
    del first, again
    _released(docs.sparkSession)
    most = tried.count()
    tried = compact(tried, most)
    sets = shingle_sets(docs, tried.select(F.explode(F.array("a", "b")).alias("key")).distinct(), shingle)
    found, open_links, roots, known, turns = linked, tried, None, 0, 3
    if linked is not None:
        # classes stand for the first turn
        known, turns = linked.count(), 2
        roots = linked.select(F.col("a").alias("node"), F.col("b").alias("root"))
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    for turn in range(turns):
        left = _rooted(open_links, roots)
        if turn < turns - 1:
            best = F.min(F.struct("apart", "a", "b")).alias("l")
            ends = left.select(F.explode(F.array("ra", "rb")).alias("r"), "apart", "a", "b")
            chosen = ends.groupBy("r").agg(best).select("l.a", "l.b").distinct()
        else:
            chosen = left.select("a", "b")
        chosen = materialise(compact(chosen, most))
        similar = verified(chosen, sets, similarity, chosen.count() <= BROADCAST_KEYS)
        found = materialise(compact(similar if found is None else found.unionByName(similar), known + most))
        roots = materialise(connected_components(found))
        open_links = compact(open_links.join(chosen, ["a", "b"], "left_anti"), most)
    _released(docs.sparkSession)
    named = roots.withColumnRenamed("node", "key")
    rows = rows.join(named, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = materialise(rows.select("key", "shard", "root"))
    return found.unionByName(crossing_links(docs, rows, nodes, sets, shingle, limit, similarity))


def class_links(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the keys of each class as links to its smallest one. prints: id, key; classes: id, component."""
    pairs = materialise(prints.select("id", "key").join(classes.select("id", "component"), "id").select("component", "key").distinct())
    least = pairs.groupBy("component").agg(F.min("key").alias("b"), F.count("*").alias("k")).where("k > 1")
    total = pairs.count()
    return materialise(compact(join_counted(pairs, least, ["component"], total, "k").where("key <> b").select(F.col("key").alias("a"), "b"), total))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, classes: DataFrame | None = None
) -> DataFrame:
    """(id, component) for every row: component is the smallest id reachable over similar texts.

    Texts are similar when their sets of word shingles (A-Z lower-cased, 64-bit hashes) have the
    Jaccard similarity; a pair at 0.8 is missed with probability 5e-5, a closer one less. Rows of one
    of the classes (id, component; ids occur once) are linked too, as those of SimHash fingerprints. Texts of
    the same words are always linked, those without words (null included) with each other. Rows
    with a null id take part and get the component of their text, null where no id is known there;
    repeated rows are all kept. Texts of any length are taken whole. An empty table gives an empty table; columns
    besides the id and the text play no part.
    """
    names = [f"b{k}" for k in range(BANDS)] + [f"w{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                key, sketch = text_sketches(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.view(np.int64)) for c in (key, *sketch))], ["id", "key", *names])

    fields = ", ".join(f"{name} long" for name in ["id", "key", *names])
    rows = id_and_text(docs, id_col, text_col)
    prints = materialise(rows.mapInArrow(run, fields))
    nodes = materialise(prints.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"), *(F.min(name).alias(name) for name in names)))
    linked = None if classes is None else class_links(prints, classes)
    parts = connected_components(similar_links(rows, nodes.drop("first", "n").where("key <> 0"), shingle, similarity, linked))
    rooted = nodes.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "first", "n", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("k"))
    named = materialise(join_counted(rooted, least, ["root"], rooted.count(), "k").select("key", "component", "n"))
    # rows of one text, as all empty ones, meet its component where they are
    return join_counted(prints.select("id", "key"), named, ["key"], prints.count()).select("id", "component")
