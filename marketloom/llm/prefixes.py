"""The prefix trie of conversations, built by van Emde Boas recursion over tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.shared import join_counted, materialise, written

#: Turns of one conversation that are put in order together, as a power of two of turn numbers.
CELL = 10
#: Members that are gathered in one list, as a power of two of their ids.
BLOCK = 16


@dataclass
class Trie:
    """nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved); ends: (conv, conv_id, depth), each conversation's last node."""

    nodes: DataFrame
    ends: DataFrame


def ordered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, role, text): turns by their number, null first, equal ones by role and text, counted from 0.

    Null roles and texts become empty; rows without a conversation are left out. A conversation is
    ordered by cells of 1024 turn numbers, so that one with very many turns is many groups.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    rows = rows.withColumn("cell", F.shiftright("turn", CELL))
    within = F.row_number().over(Window.partitionBy("conv", "cell").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    cells = rows.groupBy("conv", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy(F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("conv", F.coalesce("cell", F.lit(0)).alias("cell"), F.col("cell").isNull().alias("none"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.select("conv", F.coalesce("cell", F.lit(0)).alias("cell"), F.col("cell").isNull().alias("none"), "role", "text", within.alias("at"))
    return numbered.join(before, ["conv", "cell", "none"]).select("conv", (F.col("before") + F.col("at") - 1).alias("pos"), "role", "text")


def _two_to(power: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), power)


def _blocks(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """(level, conv, lo, h1, h2, bytes, n) of the blocks of 2^level turns from turn lo on, and the number of levels.

    An end follows each conversation's last turn. A block's 128 bits are those of its turns with
    their places, put together in any order, so that blocks are added up where their rows are.
    """
    hashes = lambda end, role, text: [F.xxhash64("pos", end, role, text), F.xxhash64(F.lit("second"), text, role, "pos", end)]
    own = turns.select("conv", "pos", *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.lit(0), F.col("role"), F.col("text")), 1)), F.octet_length("text").cast("long").alias("bytes"))
    ends = lengths.select("conv", F.col("turns").alias("pos"))
    ends = ends.select("conv", "pos", *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.lit(1), F.lit(""), F.lit("")), 1)), F.lit(0).cast("long").alias("bytes"))
    longest = lengths.agg(F.max("turns")).first()[0]
    if longest is None:
        return own.select(F.lit(0).alias("level"), "conv", F.col("pos").alias("lo"), "h1", "h2", "bytes", F.lit(0).cast("long").alias("n")), 0
    levels = (int(longest) + 1).bit_length()
    each = own.unionByName(ends).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = _two_to(F.col("level"))
    lo = F.col("pos") - F.col("pos") % size
    summed = each.groupBy("level", "conv", lo.alias("lo")).agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.min("bytes").alias("bytes"), F.count("*").alias("n"))
    return written(summed.where(F.col("n") == size).repartition("level", "conv"), "level"), levels


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of all prefixes of the conversations in convs (column conv), whose turns are (conv, pos, role, text).

    Each distinct sequence of first d turns is a node, named by its smallest member; the root (d = 0)
    has them all. n_convs counts members, copies included; n_leaves the childless nodes of the
    subtree, its top included; saved adds up each node's (n_convs - 1) times the bytes of its last text.

    The recursion: all sequences of a forest are cut at half its depth; equal first halves under one
    root are one cut prefix, named by its smallest conversation. The upper tries then hold one
    sequence a cut prefix, the lower forests all rests under the cut prefix's name as their root. All tries
    and forests of one depth are cut at once, in two shuffles; after log2(depth) rounds each holds
    single turns, and a node's root is its parent. Totals go back up in as many rounds: what the
    lower forest of a cut prefix adds up to is grafted on the prefix in the upper trie.

    Copies of a conversation are one sequence with a count. A first turn that most conversations share is
    summed where the rows are and met by a broadcast of at most 10,000 rows. A conversation without turns
    ends at the root; repeated turns are turns of their own; other columns play no part; very long texts are
    hashed where they are (128 bits stand for a block of turns). Without conversations there is no node.
    """
    counted = turns.groupBy("conv").agg(F.count("*").alias("n"))
    lengths = materialise(convs.select("conv").distinct().join(counted, "conv", "left").select("conv", F.coalesce("n", F.lit(0)).alias("turns")))
    blocks, levels = _blocks(turns, lengths)
    at = lambda level: blocks.where(F.col("level") == level).drop("level", "n")
    one = materialise(_distinct(blocks, levels, lengths))
    first = lengths.agg(F.min("conv")).first()[0]
    path = F.array().cast("array<long>").alias("path")
    parts = one.where("conv = copy_of").select("conv", F.lit(0).cast("long").alias("lo"), F.lit(first).cast("long").alias("root"), "n", (F.col("turns") + 1).alias("length"), path)
    items = blocks.where("level = 0").count()
    for level in range(levels, 0, -1):
        parts = _cut(parts, at(level - 1), _two_to(levels - 1 - F.size("path")), items)
    named = parts.join(at(0), ["conv", "lo"])
    end = one.where("conv = copy_of").select("conv", F.col("turns").alias("lo"), F.lit(True).alias("is_end"))
    named = materialise(named.join(end, ["conv", "lo"], "left"))
    groups = named.where("is_end is null").groupBy("lo", "root", "h1", "h2").agg(F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("bytes").alias("bytes"), F.min(F.struct("conv", "path"))["path"].alias("path"))
    nodes = groups.select("conv_id", (F.col("lo") + 1).alias("depth"), F.col("root").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "path")
    nodes = materialise(nodes)
    ends = named.where("is_end").select(F.col("conv").alias("copy_of"), F.col("root").alias("conv_id"), F.col("lo").alias("depth"), "n")
    total = lengths.count()
    ends = join_counted(one.select("conv", "copy_of"), ends, ["copy_of"], total).select("conv", "conv_id", "depth")
    return Trie(_grafted(nodes, levels, first, total), ends)


def _distinct(blocks: DataFrame, levels: int, lengths: DataFrame) -> DataFrame:
    """(conv, turns, copy_of, n): the smallest conversation with the same turns, and how many there are.

    A conversation is known by its length and the blocks, one for each bit of the length, that it is made of.
    """
    size = F.col("turns") + 1
    used = lengths.select("conv", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(max(0, levels - 1)))).alias("level"))
    bit = _two_to(F.col("level"))
    used = used.where(F.col("size").bitwiseAND(bit) != 0).select("level", "conv", (F.col("size") - F.col("size") % (2 * bit)).alias("lo"))
    whole = used.join(blocks, ["level", "conv", "lo"]).groupBy("conv").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    known = materialise(lengths.join(whole, "conv"))
    same = materialise(known.groupBy("turns", "h1", "h2").agg(F.min("conv").alias("copy_of"), F.count("*").alias("k"), F.count("*").alias("n")))
    return join_counted(known, same, ["turns", "h1", "h2"], known.count(), "k").select("conv", "turns", "copy_of", "n")


def _cut(parts: DataFrame, halves: DataFrame, half: Column, items: int) -> DataFrame:
    """One level of the recursion: parts of less than twice half turns to parts of at most half.

    parts: conv, the first turn lo, the name of the prefix before it (root), n conversations, length and
    the names of the cut prefixes that it lies below, one a level (null where it lies above).
    """
    sized, add = parts.withColumn("half", half), lambda name: F.concat("path", F.array(name.cast("long"))).alias("path")
    active = materialise(sized.where("length >= half").join(halves, ["conv", "lo"]))
    key = ["lo", "root", "h1", "h2"]
    cuts = materialise(active.groupBy(*key).agg(F.min("conv").alias("cut"), F.sum("n").alias("members"), F.count("*").alias("k")))
    known = join_counted(active, cuts, key, items, "k")
    upper = F.struct("conv", "lo", "root", F.col("members").alias("n"), F.col("half").alias("length"), add(F.lit(None)))
    lower = F.struct("conv", (F.col("lo") + F.col("half")).alias("lo"), F.col("cut").alias("root"), "n", (F.col("length") - F.col("half")).alias("length"), add(F.col("cut")))
    both = F.array(F.when(F.col("conv") == F.col("cut"), upper), F.when(F.col("length") > F.col("half"), lower))
    new = known.select(F.explode(both).alias("p")).where("p is not null").select("p.*")
    rest = sized.where("length < half").select("conv", "lo", "root", "n", "length", add(F.lit(None)))
    return materialise(new.unionByName(rest))


def _grafted(nodes: DataFrame, levels: int, first: int | None, total: int) -> DataFrame:
    """All nodes, the root included, with their subtrees' totals."""
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    grown = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    grown = materialise(grown.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))
    every = grown.agg(F.sum("n_leaves"), F.sum("saved"), F.sum((F.col("depth") == 1).cast("long"))).first()
    place, half = F.col("depth") - 1, _two_to(F.size("path") - 1)
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    for _ in range(levels):
        top = F.element_at("path", 1)
        sums = grown.where(top.isNotNull()).groupBy(top.alias("conv_id"), (place - place % half).alias("depth"))
        sums = sums.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = F.slice("path", 2, F.size("path")).alias("path")
        grown = grown.join(sums, ["conv_id", "depth"], "left")
        grown = materialise(grown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", plus("n_leaves", "more_leaves"), plus("saved", "more_saved"), rest))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    if first is None:
        return grown.select(*names)
    values = [first, 0, None, total, every[2] or 0, every[0] if every[0] is not None else 1, every[1] or 0]
    root = nodes.sparkSession.range(1).select(*(F.lit(v).cast("long").alias(c) for v, c in zip(values, names, strict=True)))
    return root.unionByName(grown.select(*names))


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, sha256): the digest of each node's own conversations' ids, ascending and comma-joined.

    Ids are gathered in lists of 2^16 numbers at most; a digest reads its lists one after another.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    lists = ends.groupBy("conv_id", "depth", F.shiftright("conv", BLOCK).alias("block")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(done)
        if now is not None:
            yield _rows([(*now, state.hexdigest())])

    dealt = lists.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return dealt.mapInArrow(digest, "conv_id long, depth long, sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "sha256"])


def rebuilt(turns: DataFrame, most: int = 9, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (turns, convs) as prefix_trie() takes them, from ordered_turns().

    Conversation c begins with the first h turns of conversation c - c % group (all if it has fewer, none
    if there is none) and goes on with its own turns after its first h; h is crc32 of c in decimal modulo most.
    The remainder has c's sign.
    """
    head = lambda conv: (F.crc32(conv.cast("string").cast("binary")) % most).cast("long")
    convs = materialise(turns.groupBy("conv").agg(F.count("*").alias("n")))
    based = convs.select("conv", "n", head(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    based = based.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("of_base")), "base", "left")
    taken = F.least("h", F.coalesce("of_base", F.lit(0)))
    starts = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv", "base")
    heads = based.select("conv", "base", "h").join(starts, "base").where("pos < h").select("conv", "pos", "role", "text")
    tails = join_counted(turns, based.select("conv", "h", taken.alias("taken"), "n"), ["conv"], convs.agg(F.sum("n")).first()[0] or 0)
    tails = tails.where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    return heads.unionByName(tails), convs.select("conv")
