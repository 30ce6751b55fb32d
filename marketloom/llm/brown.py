"""Brown class-based bigrams: exchange clustering of words, smoothed class transitions and word emissions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import tallies
from marketloom.llm.shared import bytes_of, id_and_text, materialise, shared_folder, slices, words_of, written

#: Words whose codes, counts and classes are broadcast; all others meet theirs in joins.
FREQUENT = 1 << 18
#: The most frequent of them, which are clustered by exchange first; the others follow, each by its neighbours among these.
CORE = 1 << 13
CLASSES, ROUNDS = 64, 5
#: Parts of the core words; those of one part move at once.
SLOTS = 4
#: Hash parts by which a step of equal counts is cut where it is too large to be taken whole.
HASH_PARTS = 4096
#: Distinct words and their bytes that a task counts before it hands them on.
COUNTED, COUNTED_BYTES = 400_000, 32 << 20
#: Weight of the class model against the unigram model.
WEIGHT = 0.98
#: The end of a text; no word is empty. It is always a core word, with code 0.
END = b""
#: Marks a word outside the broadcast ones, in codes, and one that was never learned from, in classes.
RARE, UNSEEN = -1, 255
#: After more unseen words in a row the chances of their classes are taken for those after so many.
RUN = 8
#: Logarithms count as whole multiples of 1 / FINE, so that sums do not depend on their order.
FINE = 1 << 16


@dataclass
class Coded:
    """Several texts' tokens: distinct tokens, each token's place there, each text's number of tokens."""

    distinct: list[bytes]
    codes: np.ndarray
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def tokens_of(texts: pa.Array) -> Coded:
    """Lower-cased (A-Z) words and one end for each text."""
    words, counts = words_of(texts, lower=True)
    coded = words.dictionary_encode()
    distinct = [*bytes_of(coded.dictionary), END]
    codes = np.insert(np.asarray(coded.indices, dtype=np.int64), np.cumsum(counts), len(distinct) - 1)
    return Coded(distinct, codes, counts + 1)


def is_held_out(id_col: str, folds: int = 7, held: int = 2) -> F.Column:
    """crc32 of the id as text modulo folds; rows with a null id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(True))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): each token's number in the rows to learn from. rows: id, text, learn."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        counts, size = np.zeros(1 << 16, dtype=np.int64), 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.binary()), pa.array(counts[: len(codes)])], ["word", "c"])

        for batch in batches:
            for part in slices(batch):
                coded = tokens_of(part.column(1))
                at = np.array([codes.setdefault(w, len(codes)) for w in coded.distinct], dtype=np.int64)
                if len(codes) > len(counts):
                    counts = np.append(counts, np.zeros(len(codes), dtype=np.int64))
                counts[at] += np.bincount(coded.codes, minlength=len(at))
                size += sum(map(len, coded.distinct))
                if len(codes) > COUNTED or size > COUNTED_BYTES:
                    yield emit()
                    codes.clear()
                    counts, size = np.zeros(1 << 16, dtype=np.int64), 0
        if codes:
            yield emit()

    return rows.where("learn").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Words and their c, at most so many, from the greatest count down; the end comes first.

    Words are counted by steps of their count (eight a doubling) and whole steps are taken while
    they fit; of the first step that does not fit, whole hash parts are. Nothing is sorted and no
    task or driver sees more than that, and which words are taken depends on counts and words alone.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    part = F.pmod(F.xxhash64("word"), F.lit(HASH_PARTS)).cast("int")

    def fitting(sizes: dict[int, int], order: list[int], room: int) -> tuple[list[int], int]:
        taken = []
        for key in order:
            if sizes[key] > room:
                break
            room -= sizes[key]
            taken.append(key)
        return taken, room

    steps = {r["k"]: r["n"] for r in vocabulary.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()}
    order = sorted(steps, reverse=True)
    whole, room = fitting(steps, order, most - 1)
    chosen = step >= (whole[-1] if whole else 1 << 30)
    if len(whole) < len(order):
        cut = order[len(whole)]
        parts = {r["k"]: r["n"] for r in vocabulary.where(step == cut).groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect()}
        some, _ = fitting(parts, sorted(parts), room)
        chosen = chosen | ((step == cut) & (part <= (some[-1] if some else -1)))
    found = vocabulary.where(chosen | (F.col("word") == F.lit(END))).select("word", "c").toArrow()
    counts = dict(zip(bytes_of(found["word"].combine_chunks()), found["c"].to_pylist(), strict=True))
    ends = counts.pop(END, 0)
    words = sorted(counts, key=lambda w: (-counts[w], w))
    return [END, *words], np.array([ends, *(counts[w] for w in words)], dtype=np.int64)


def code_texts(rows: DataFrame, frequent: list[bytes], counts: np.ndarray) -> DataFrame:
    """Each row's tokens as codes, written once for all that follows.

    (row, id, learn, n_tokens, n_known, logs, codes, rare): codes are 32-bit places among the frequent
    words or RARE; rare has the words that are not frequent, in their order; n_known and logs (log10
    of c + 1) are of the frequent ones.
    """
    model = rows.sparkSession.sparkContext.broadcast(({w: n for n, w in enumerate(frequent)}, counts))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts = model.value
        known, logs = counts > 0, np.log10(counts + 1.0)
        for batch in batches:
            for part in slices(batch):
                coded = tokens_of(part.column(1))
                own = np.array([place.get(w, RARE) for w in coded.distinct], dtype=np.int32)
                codes, starts = own[coded.codes], coded.starts
                usual = codes != RARE
                sums = [np.add.reduceat(np.where(usual, x[codes], 0), starts, dtype=t) for x, t in ((known, np.int64), (logs, np.float64))]
                words = pa.array(coded.distinct, pa.binary()).take(pa.array(coded.codes[~usual]))
                ends = np.append(0, np.cumsum(coded.counts))
                rare_ends = np.append(0, np.cumsum(~usual))[ends]
                columns = [
                    *(part.column(c) for c in ("row", "id", "learn")),
                    pa.array(coded.counts),
                    *(pa.array(x) for x in sums),
                    pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(codes.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), words),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "learn", "n_tokens", "n_known", "logs", "codes", "rare"])

    schema = "row long, id long, learn boolean, n_tokens long, n_known long, logs double, codes binary, rare array<binary>"
    return written(rows.mapInArrow(code, schema))


def flat(column: pa.Array, dtype: str) -> np.ndarray:
    """The numbers of all values of a binary column in turn."""
    if not len(column):
        return np.zeros(0, dtype=dtype)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(dtype)


def before(tokens: np.ndarray, end: int = 0) -> np.ndarray:
    """What precedes each token: texts end with the end token, so that it also stands before the next text."""
    return np.append(np.array([end], dtype=tokens.dtype), tokens[:-1])


def core_pairs(coded: DataFrame, core: int) -> str:
    """Folder of how often core words follow each other, written in parts by slot: bucket, then keys and counts of both directions.

    A row is a bucket of words (code modulo BUCKETS) with all their pairs, at most core ** 2 / BUCKETS
    in a direction, however large the input. Keys are word * core + other.
    """

    def pairs(batch: pa.RecordBatch) -> np.ndarray:
        codes = flat(batch.column(0), "<i4").astype(np.int64)
        first = before(codes)
        both = (codes >= 0) & (codes < core) & (first >= 0) & (first < core)
        return first[both] * core + codes[both]

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return keys // core % tallies.BUCKETS

    def turned(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        again = keys % core * core + keys // core
        order = np.argsort(again)
        for out, k, n in ((True, keys, counts), (False, again[order], counts[order])):
            part = tallies.blocks(k, n, bucket_of(k))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([out] * part.num_rows)], [*part.schema.names, "out"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, {}

        def emit() -> pa.RecordBatch:
            packed = [tallies.pack(x) for out in (True, False) for x in sides[out].fold()]
            row = [[now % SLOTS], [now], *([x] for x in packed)]
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["slot", "bucket", "out_keys", "out_counts", "in_keys", "in_counts"])

        for batch in batches:
            for bucket, keys, counts, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        yield emit()
                    now, sides = bucket, {True: tallies.Tally(), False: tallies.Tally()}
                sides[out].add(*tallies.opened(keys, counts))
        if now is not None:
            yield emit()

    own = tallies.summed(tallies.tallied(coded.where("learn").select("codes"), pairs, bucket_of), turned, tallies.SCHEMA + ", out boolean")
    table = own.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(whole, PAIRS)
    folder = f"{shared_folder(coded.sparkSession)}/pairs-{uuid.uuid4().hex}"
    table.write.partitionBy("slot").parquet(folder)
    return folder


PAIRS = "slot int, bucket int, out_keys binary, out_counts binary, in_keys binary, in_counts binary"


def _information(n: np.ndarray) -> np.ndarray:
    """n log n, 0 for 0."""
    return n * np.log(np.maximum(n, 1.0))


def exchange_gains(own: np.ndarray, right: np.ndarray, left: np.ndarray, loop: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Changes of the classes' mutual information for moves of single words, each from its class own to each class.

    right, left: how often each class follows and precedes each word; loop: how often it follows
    itself; matrix: the classes' transitions with all words in their classes.
    """
    word = np.arange(len(own))
    base = np.repeat(matrix[None], len(own), axis=0)
    base[word, own] -= right
    base[word, :, own] -= left
    base[word, own, own] += loop
    outer, inner = right.copy(), left.copy()
    outer[word, own] -= loop
    inner[word, own] -= loop
    # with a word in class c, row c grows by outer, column c by inner, and entry (c, c) by loop as well
    rows = (_information(base + outer[:, None, :]) - _information(base)).sum(axis=2)
    columns = (_information(base + inner[:, :, None]) - _information(base)).sum(axis=1)
    both = np.diagonal(base, axis1=1, axis2=2)
    corner = _information(both + outer + inner + loop[:, None]) + _information(both) - _information(both + outer) - _information(both + inner)
    # the word is somewhere in any case: what follows and precedes it counts for the other classes
    total = base.sum(axis=2) + inner
    totals_in = base.sum(axis=1) + outer
    count_out, count_in = (outer.sum(axis=1) + loop)[:, None], (inner.sum(axis=1) + loop)[:, None]
    marginal = _information(total + count_out) - _information(total) + _information(totals_in + count_in) - _information(totals_in)
    gain = rows + columns + corner - marginal
    return gain - gain[word, own][:, None]


def mutual_information(matrix: np.ndarray) -> float:
    """Of the classes before and after, times the number of transitions, but for a constant."""
    return float(_information(matrix).sum() - _information(matrix.sum(axis=0)).sum() - _information(matrix.sum(axis=1)).sum())


def _pairs_of(row: dict, core: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """(word, other, count) of the pairs in which the bucket's words come first, and of those in which they come second."""
    sides = []
    for side in ("out", "in"):
        keys, counts = tallies.unpack(row[f"{side}_keys"]), tallies.unpack(row[f"{side}_counts"])
        sides.append((keys // core, keys % core, counts))
    return tuple(sides)


def best_moves(row: dict, classes: np.ndarray, matrix: np.ndarray) -> list[tuple[int, int]]:
    """(word, class) for the words of a bucket that gain by another class."""
    core = len(classes)
    words = np.arange(row["bucket"], core, tallies.BUCKETS)
    sides = []
    (word, other, counts), inward = _pairs_of(row, core)
    loops = word == other
    loop = np.bincount(word[loops] // tallies.BUCKETS, weights=counts[loops], minlength=len(words))
    for word, other, counts in ((word, other, counts), inward):
        at = word // tallies.BUCKETS * CLASSES + classes[other]
        sides.append(np.bincount(at, weights=counts, minlength=len(words) * CLASSES).reshape(-1, CLASSES))
    gains = exchange_gains(classes[words], *sides, loop, matrix)
    to = gains.argmax(axis=1)
    return [(int(w), int(t)) for w, t, g in zip(words, to, gains[np.arange(len(words)), to], strict=True) if g > 1e-9]


def changed(row: dict, slot: int, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What a bucket's pairs add to the transitions when its slot's words move; each pair counts once."""
    delta = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    outward, (word, other, counts) = _pairs_of(row, len(old))
    apart = other % tallies.BUCKETS % SLOTS != slot
    for first, second, n in (outward, (other[apart], word[apart], counts[apart])):
        moved = (old[first] != new[first]) | (old[second] != new[second])
        first, second, n = first[moved], second[moved], n[moved]
        np.add.at(delta, new[first] * CLASSES + new[second], n)
        np.subtract.at(delta, old[first] * CLASSES + old[second], n)
    return delta


def cluster(spark: SparkSession, folder: str, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Each core word's class and the classes' transitions between core words: the best state of ROUNDS rounds of exchange.

    Words are dealt over SLOTS slots by their code. A turn finds the best class of each word of a
    slot, given all classes as they are, and moves these words at once; a round is a turn of each
    slot. Which words move where depends on the counts alone, not on partitions. The driver holds a
    class for each core word and CLASSES ** 2 counts.
    """
    classes = np.arange(core) % CLASSES
    table = spark.read.schema(PAIRS).parquet(folder)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield batch.slice(at, 1).to_pylist()[0]

    def transitions(slot: int, old: np.ndarray | None, new: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((old, new))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old, new = sent.value
            total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
            for row in rows_of(batches):
                if old is None:
                    first, second, n = _pairs_of(row, len(new))[0]
                    np.add.at(total, new[first] * CLASSES + new[second], n)
                else:
                    total += changed(row, slot, old, new)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

        part = table if old is None else table.where(F.col("slot") == slot)
        found = part.mapInArrow(add, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        matrix = np.zeros(CLASSES * CLASSES)
        matrix[np.asarray(found["at"])] = np.asarray(found["n"])
        return matrix.reshape(CLASSES, CLASSES)

    matrix = transitions(0, None, classes)
    best = classes, matrix, mutual_information(matrix)
    for turn in range(ROUNDS * SLOTS):
        slot = turn % SLOTS
        sent = spark.sparkContext.broadcast((classes, matrix))

        def exchange(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            moves = [move for row in rows_of(batches) for move in best_moves(row, *sent.value)]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moves], pa.int32()) for i in (0, 1)], ["word", "to"])

        found = table.where(F.col("slot") == slot).mapInArrow(exchange, "word int, to int").toArrow()
        if not found.num_rows:
            continue
        old, classes = classes, classes.copy()
        classes[np.asarray(found["word"])] = np.asarray(found["to"])
        matrix = matrix + transitions(slot, old, classes)
        if (information := mutual_information(matrix)) > best[2]:
            best = classes, matrix, information
    return best[:2]


def neighbour_weights(matrix: np.ndarray) -> np.ndarray:
    """Row 2 * j + s, column k: what a neighbour of class j before (s = 0) or behind (s = 1) a word adds for class k, in units of 1 / FINE.

    The exchange gain to the first order in the word's counts, which for all but the core words are
    small beside those of the classes: log of a transition over its row or column.
    """
    smooth = matrix + 0.5
    behind = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
    ahead = np.log(smooth / smooth.sum(axis=0, keepdims=True))
    return np.rint(FINE * np.stack([ahead, behind], axis=1)).reshape(2 * CLASSES, CLASSES)


def classes_by_neighbours(coded: DataFrame, classes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Classes of all frequent words: those of the core, and for each other the best by its core neighbours."""
    core, wide = len(classes), 2 * CLASSES
    sent = coded.sparkSession.sparkContext.broadcast((classes, weights))

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        codes = flat(batch.column(0), "<i4").astype(np.int64)
        first = before(codes)
        found = []
        for word, other, side in ((codes, first, 0), (first, codes, 1)):
            own = (word >= core) & (other >= 0) & (other < core)
            found.append(word[own] * wide + 2 * sent.value[0][other[own]] + side)
        return np.concatenate(found)

    def choose(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, at = np.unique(keys // wide, return_inverse=True)
        contexts = np.zeros((len(words), wide))
        contexts[at, keys % wide] = counts
        best = (contexts @ sent.value[1]).argmax(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(best, pa.int32())], ["word", "class"])

    parts = tallies.tallied(coded.where("learn").select("codes"), keys, lambda keys: keys // wide % tallies.BUCKETS)
    found = tallies.summed(parts, choose, "word int, class int").toArrow()
    every = np.append(classes, np.zeros(size - core, dtype=np.int64))
    every[np.asarray(found["word"])] = np.asarray(found["class"])
    return every


def rare_words(coded: DataFrame, classes: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(word, c, class) of the words to learn from that are not frequent: the best class by their frequent neighbours.

    A word's neighbours are counted by class first, so that no word gathers more than (CLASSES + 1) ** 2 counts.
    """
    none, wide = CLASSES, CLASSES + 1
    sent = coded.sparkSession.sparkContext.broadcast((np.append(classes, none).astype(np.int32), weights))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # code -1 is the last entry: no class
            kind = sent.value[0][flat(batch.column(0), "<i4")]
            own = np.flatnonzero(kind == none)
            behind = np.append(kind[1:], none)
            context = before(kind, int(sent.value[0][0]))[own] * wide + behind[own]
            yield pa.RecordBatch.from_arrays([batch.column(1).flatten(), pa.array(context, pa.int32())], ["word", "context"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.vstack([sent.value[1], np.zeros((2, CLASSES))])
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            entries = batch.column(2).flatten()
            context, n = (np.asarray(entries.field(i)) for i in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), sizes) * (2 * wide)
            at = np.concatenate([row + context // wide * 2, row + context % wide * 2 + 1])
            seen = np.bincount(at, weights=np.append(n, n), minlength=batch.num_rows * 2 * wide).reshape(-1, 2 * wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((seen @ table).argmax(axis=1), pa.int32())], ["word", "c", "class"])

    met = coded.where("learn").where(F.size("rare") > 0).select("codes", "rare").mapInArrow(contexts, "word binary, context int")
    # one exchange by word serves both sums
    counted = met.repartition("word").groupBy("word", "context").agg(F.count("*").alias("n"))
    gathered = counted.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("context", "n")).alias("seen"))
    return written(gathered.mapInArrow(choose, "word binary, c long, class int"))


def resolved(coded: DataFrame, classes: np.ndarray, rare: DataFrame) -> DataFrame:
    """(id, learn, n_tokens, n_known, logs, classes): every token's class as a byte, or UNSEEN, the counts and logs of all words."""
    sent = coded.sparkSession.sparkContext.broadcast(np.append(classes, UNSEEN).astype(np.uint8))

    def by_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = sent.value[flat(batch.column(5), "<i4")]
            ends = np.frombuffer(batch.column(5).buffers()[1], dtype=np.int32)[batch.column(5).offset :][: batch.num_rows + 1]
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends - ends[0]) // 4), pa.py_buffer(kinds.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], column, batch.column(6)], [*batch.schema.names[:5], "kinds", "learn"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = flat(batch.column(5), "u1").copy()
            met = batch.column(7)
            sizes = np.asarray(met.value_lengths().fill_null(0))
            entries, row = met.flatten(), np.repeat(np.arange(batch.num_rows), sizes)
            place, kind, c = (np.asarray(entries.field(i)) for i in range(3))
            holes = np.flatnonzero(kinds == UNSEEN)
            ends = np.frombuffer(batch.column(5).buffers()[1], dtype=np.int32)[batch.column(5).offset :][: batch.num_rows]
            first = np.searchsorted(holes, ends - ends[0]) if len(ends) else ends
            kinds[holes[first[row] + place]] = kind
            known = np.asarray(batch.column(3)) + sizes
            logs = np.asarray(batch.column(4)) + np.bincount(row, weights=np.log10(c + 1.0), minlength=batch.num_rows)
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.append(ends - ends[:1], len(kinds)).astype(np.int32)), pa.py_buffer(kinds.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(6), batch.column(2), pa.array(known), pa.array(logs), column], ["id", "learn", "n_tokens", "n_known", "logs", "classes"])

    some = coded.select("row", "id", "n_tokens", "n_known", "logs", "codes", "learn")
    kinds = some.mapInArrow(by_code, "row long, id long, n_tokens long, n_known long, logs double, kinds binary, learn boolean")
    each = coded.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("place", "word"))
    met = each.join(rare, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "class", "c"))).alias("met"))
    whole = kinds.join(met, "row", "left").select("row", "id", "n_tokens", "n_known", "logs", "kinds", "learn", "met")
    return written(whole.mapInArrow(fill, "id long, learn boolean, n_tokens long, n_known long, logs double, classes binary"))


def transitions_of(rows: DataFrame, end: int) -> np.ndarray:
    """How often classes follow each other in the rows to learn from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            kinds = flat(batch.column(0), "u1").astype(np.int64)
            total += np.bincount(before(kinds, end) * CLASSES + kinds, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "n"])

    found = rows.where("learn").select("classes").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(CLASSES * CLASSES)
    matrix[np.asarray(found["at"])] = np.asarray(found["n"])
    return matrix.reshape(CLASSES, CLASSES)


def chances(follow: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Behind class a and r words that were never learned from (0 to RUN): [r, a, k] of one word of class k, and [r, a] of another unseen one.

    follow: chances of the class behind each class; place: of one word in each class. The classes of
    an unseen word are as likely as those behind a times their places.
    """
    words, unseen, at = [], [], np.eye(len(place))
    for _ in range(RUN + 1):
        ahead = at @ follow
        words.append(ahead * place)
        unseen.append((ahead * place).sum(axis=1))
        at = ahead * place / unseen[-1][:, None]
    return np.stack(words), np.stack(unseen)


@dataclass
class ClassModel:
    """What is learned: frequent words with counts and classes, all others as a table, and the coded texts."""

    frequent: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    rare: DataFrame
    coded: DataFrame
    tokens: int
    kinds: int


def learn_classes(rows: DataFrame, most_frequent: int = FREQUENT, core: int = CORE) -> ClassModel:
    """Classes of all words of the rows to learn from. rows: id, text, learn."""
    vocabulary = materialise(word_counts(rows))
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    frequent, counts = frequent_words(vocabulary, most_frequent)
    coded = code_texts(rows.select("id", "text", "learn", F.monotonically_increasing_id().alias("row")), frequent, counts)
    core = min(core, len(frequent))
    own, matrix = cluster(rows.sparkSession, core_pairs(coded, core), core)
    weights = neighbour_weights(matrix)
    classes = classes_by_neighbours(coded, own, weights, len(frequent))
    return ClassModel(frequent, counts, classes, rare_words(coded, classes, weights), coded, sums["n"] or 0, sums["v"])


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = FREQUENT, core: int = CORE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens are lower-cased (A-Z) words and one end for each text; rows that is_held_out does not
    hold out are learned from. With c a token's count, N of all and V of distinct tokens there:
    base_score sums log10((c + 1) / (N + V + 1)). score sums the log10 of

        (c + 1) * (WEIGHT * T / (N_k + V_k + 1) + (1 - WEIGHT) / (N + V + 1))

    where k is the token's class, T the smoothed probability of k after the class before, and N_k,
    V_k count the tokens and distinct tokens of class k. Each class keeps one place for words never
    learned from: such a word (c = 0) may be of any class, so that the sum over k of T / (N_k + V_k + 1)
    counts for it, and T behind it is the mean over its classes' chances. So score is the log10 probability of the text under a class bigram model mixed with the
    unigram model, and never below base_score + n_tokens * log10(1 - WEIGHT).

    Every word has its own class: the core of the most frequent words by exchange, each other one
    where the exchange gain by its own neighbours is greatest. Counts, neighbours and classes of words grow with the input;
    the most frequent words are broadcast, all others are joined, and for these no word is hot. A null or
    empty text is one end. Repeated rows and equal ids are each learned from and scored; rows
    with a null id are held out; without rows to learn from all counts are 0. Texts of any length are scored whole; behind eight unseen words in a row (RUN)
    the chances of their classes are taken for those after eight. An empty table gives
    none. Other columns play no part. Results do not depend on partitions.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("learn", ~is_held_out("id"))
    model = learn_classes(rows, most_frequent, core)
    distinct = np.bincount(model.classes[model.counts > 0], minlength=CLASSES)
    for r in model.rare.groupBy("class").count().collect():
        distinct[r["class"]] += r["count"]
    done = resolved(model.coded, model.classes, model.rare)
    matrix = transitions_of(done, int(model.classes[0]))
    class_tokens = matrix.sum(axis=0)
    spread = (class_tokens + 1) / (class_tokens + 1).sum()
    follow = (matrix + 2 * CLASSES * spread) / (matrix.sum(axis=1, keepdims=True) + 2 * CLASSES)
    uniform = 1 / (model.tokens + model.kinds + 1)
    known, unseen = (np.log10(WEIGHT * p + (1 - WEIGHT) * uniform) for p in chances(follow, 1 / (class_tokens + distinct + 1)))
    end = int(model.classes[0])

    @F.arrow_udf("double")
    def path(classes: pa.Array) -> pa.Array:
        sums = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([classes], ["classes"]), text_at=0, most=1 << 20):
            kinds = flat(part.column(0), "u1")
            sizes = np.asarray(pc.binary_length(part.column(0)), dtype=np.int64)
            seen = kinds != UNSEEN
            last = np.maximum.accumulate(np.where(seen, np.arange(len(kinds)), -1))
            last = np.append(-1, last[:-1])
            ahead = np.where(last >= 0, kinds[last], end)
            run = np.minimum(np.arange(len(kinds)) - 1 - last, RUN)
            logs = np.where(seen, known[run, ahead, np.where(seen, kinds, 0)], unseen[run, ahead])
            sums.append(np.add.reduceat(logs, np.cumsum(sizes) - sizes))
        return pa.array(np.concatenate(sums))

    return done.select(
        "id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("n_tokens") * F.lit(float(np.log10(uniform)))).alias("base_score"),
        (F.col("logs") + path("classes")).alias("score"),
    )
