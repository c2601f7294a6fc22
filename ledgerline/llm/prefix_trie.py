"""The trie of conversation prefixes: which openings conversations share, and what sharing saves.

Each distinct sequence of a conversation's first ``d`` turns is a node of depth ``d``; the
root has no turn. Texts stay where they are: a turn is a 128-bit digest of role and text and
a word count. Digests are chained along each conversation, in a stream of its turns in
order, so that every prefix has a 128-bit name; a task holds one batch of turns, whatever
the length of a conversation.

**Screening.** All tasks count the names in a count-min sketch of fixed size, whose counters
stop at two. Where the estimate of a name is one, no other conversation has the prefix (an
estimate is never too low), so its node is complete as it stands and is emitted where it is.
Only the other prefixes, those shared and the few whose counters collide, are shuffled and
grouped exactly; a collision costs a row of shuffle and changes no result.

**Subtrees without walking them.** Let the smallest member of a node stand for it. A
conversation that stands for a node stands for all its deeper nodes too, so one depth per
conversation says where that begins. Then the leaves below a node are its members that
stand for a childless last node, and the tokens saved below it are the members' words from
its depth up to where they begin to stand for their nodes. Both are plain sums over members,
whatever the depth of the trie.

**Hot nodes.** Groups are hash aggregates that combine before the shuffle. The ids of
conversations that end in one node are joined per block of ``ID_BLOCK`` ids first; their
SHA-256 then runs over the blocks in order, as a stream. Parents are looked up by a broadcast
of counted size, or with hot parents apart.

Defined results: null roles and texts are empty; a null turn comes first; turns with equal
numbers (ties) and repeated rows are all kept, in the order of their digests; rows with a
null conv_id are one conversation, which names a node only where it is the sole member and
is left out of ``ends_sha256``; without conversations there is no node, not even the root;
other columns are ignored; prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.operators.skew import lookup_join
from ledgerline.session import stage

#: Counters of one row of the sketch, by number of prefixes; two bits each. The largest
#: sketch is 24 MB of second bits on the driver and on each executor. Beyond it more singletons
#: are grouped exactly, which changes no result.
LEAST_COUNTERS, MOST_COUNTERS = 2**16, 2**26
COUNTERS_PER_PREFIX = 8
SKETCH_ROWS = 3
SEGMENT_BYTES = 4096

ID_BLOCK = 1024

_NODE = ["n1", "n2"]


# --- turns ------------------------------------------------------------------------

def signed_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, sign, words)``: turns numbered from 1, with a digest of role and
    text and the number of words, without the texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    signed = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("sign"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "sign"))
    return signed.select("conv_id", place.cast("bigint").alias("place"), "sign", "words")


def share_openings(turns: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(turns, members)`` in which a conversation ``c`` begins with the first ``h`` turns
    of conversation ``c - c % family`` and goes on after its own first ``h`` turns; ``h`` is
    the CRC-32 of its decimal id modulo ``most + 1``, and 0 for a null id."""
    taken = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), F.lit(0))
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id")
    asks = members.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("head"), taken.alias("taken")).where("taken > 0")
    heads = turns.where((F.col("place") <= most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "of")
    copied = asks.join(heads, (F.col("head") == F.col("of")) & (F.col("place") <= F.col("taken")))
    own = turns.where(F.col("place") > taken)
    return own.unionByName(copied.select("conv_id", "place", "sign", "words")), members


# --- prefixes ---------------------------------------------------------------------

_PREFIX = "conv_id long, depth long, n1 long, n2 long, p1 long, p2 long, words long, before long, is_end boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A prefix per row of turns that come conversation by conversation, in order; a
    conversation begins with a row that has no sign, for the root. The last row of a batch
    waits for the next one, which tells whether the conversation goes on."""
    names = [field.split()[0] for field in _PREFIX.split(", ")]
    root = bytes(16)
    held, name, depth, total = None, root, 0, 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows = []
        for conv, sign, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "sign", "words"))):
            if held is not None:
                rows.append((*held, sign is None))
            if sign is None:
                name, depth, total, above = root, 0, 0, (None, None)
            else:
                above = struct.unpack("<qq", name)
                name, depth = hashlib.blake2b(name + sign, digest_size=16).digest(), depth + 1
            held = (conv, depth, *struct.unpack("<qq", name), *above, words, total)
            total += words
        if rows:
            yield out(rows)
    if held is not None:
        yield out([(*held, True)])


def prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per conversation and depth, the root included: names of the prefix and of the
    one above it, words of its last turn and of the turns before that."""
    starts = members.select(
        "conv_id", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("sign"),
        F.lit(0).cast("bigint").alias("words"))
    ordered = turns.unionByName(starts).repartition("conv_id").sortWithinPartitions("conv_id", "place", "sign")
    return ordered.select("conv_id", "sign", "words").mapInArrow(_chain, _PREFIX)


# --- the sketch -------------------------------------------------------------------

def _counters(n1: np.ndarray, n2: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for row in range(SKETCH_ROWS):
        yield (n1.view(np.uint64) + np.uint64(row) * n2.view(np.uint64)).astype(np.int64) & (width - 1)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _sketch_of(width: int):
    """Partial sketches in segments: for each counter whether it is over zero and over one."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((SKETCH_ROWS, width // 8), np.uint8) for _ in range(2))
        for batch in batches:
            for row, at in enumerate(_counters(*_numbers(batch, "n1", "n2"), width)):
                at, n = np.unique(at, return_counts=True)
                byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
                again = (n > 1) | (once[row, byte] & bit > 0)
                np.bitwise_or.at(twice[row], byte[again], bit[again])
                np.bitwise_or.at(once[row], byte, bit)
        once, twice = once.reshape(-1, SEGMENT_BYTES), twice.reshape(-1, SEGMENT_BYTES)
        used = np.flatnonzero(once.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 1024)):
            yield _segments(some.tolist(), [once[i].tobytes() for i in some], [twice[i].tobytes() for i in some])

    return sketch


def _segments(numbers: list[int], once: list[bytes], twice: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        names=["segment", "once", "twice"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of partial sketches; holds one pair of segments per number dealt to the task."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for number, *pair in zip(*(c.to_pylist() for c in batch.columns)):
            once, twice = (np.frombuffer(p, np.uint8) for p in pair)
            if number in sums:
                has, more = sums[number]
                once, twice = has | once, more | twice | (has & once)
            sums[number] = (once, twice)
    if sums:
        yield _segments(list(sums), [o.tobytes() for o, _ in sums.values()], [t.tobytes() for _, t in sums.values()])


def shared_counters(named: DataFrame) -> np.ndarray:
    """The sketch of all names ``n1, n2``: a bit per counter, set where it is over one."""
    width = LEAST_COUNTERS
    rows = named.count()
    while width < min(MOST_COUNTERS, COUNTERS_PER_PREFIX * rows):
        width *= 2
    kind = "segment long, once binary, twice binary"
    parts = named.select(*_NODE).mapInArrow(_sketch_of(width), kind)
    sums = parts.repartition(16, "segment").mapInArrow(_add, kind).select("segment", "twice").collect()
    bits = np.zeros((SKETCH_ROWS * width // 8 // SEGMENT_BYTES, SEGMENT_BYTES), np.uint8)
    for number, twice in sums:
        bits[number] = np.frombuffer(twice, np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def screened(named: DataFrame, bits: np.ndarray) -> DataFrame:
    """Prefixes with ``single``: the estimate of its count is one; and ``parent_single``."""
    sketch, width = named.sparkSession.sparkContext.broadcast(bits), bits.shape[1] * 8

    def single(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(n1), bool)
        for row, at in enumerate(_counters(n1, n2, width)):
            found |= (sketch.value[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
        return found

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = single(*_numbers(batch, "p1", "p2")) & batch.column("p1").is_valid().to_numpy(zero_copy_only=False)
            flags = [pa.array(single(*_numbers(batch, "n1", "n2"))), pa.array(above)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=[*batch.schema.names, "single", "parent_single"])

    return named.mapInArrow(probe, f"{_PREFIX}, single boolean, parent_single boolean")


# --- nodes ------------------------------------------------------------------------

def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each node, from blocks of ids in order."""
    node, digest, begun = None, None, False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])],
            names=["n1", "n2", "ends_sha256"])

    for batch in batches:
        for n1, n2, ids in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "ids"))):
            if (n1, n2) != node:
                if node is not None:
                    yield done()
                node, digest, begun = (n1, n2), hashlib.sha256(), False
            if ids:
                digest.update((b"," if begun else b"") + ids.encode())
                begun = True
    if node is not None:
        yield done()


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _ends(shared: DataFrame) -> DataFrame:
    blocks = shared.where("is_end").groupBy(*_NODE, F.floor(F.col("conv_id") / F.lit(ID_BLOCK)).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, F.col("block").asc_nulls_first()) \
        .select(*_NODE, "ids").mapInArrow(_end_digests, "n1 long, n2 long, ends_sha256 string")


def _own_places(all_rows: DataFrame, groups: DataFrame, children: DataFrame) -> DataFrame:
    """Per conversation: ``own_from``, its words before the first node that it stands for (all
    its words if there is none), and ``leaf``, 1 if it stands for a childless last node."""
    nothing = F.lit(None).cast("bigint")
    kept = groups.join(children, _NODE, "left").select(
        "conv_id", F.col("before").alias("own_from"), nothing.alias("total"), F.col("n_children").isNull().cast("int").alias("leaf"))
    alone = all_rows.where("single OR is_end").select(
        "conv_id", F.when(F.col("single"), F.col("before")).alias("own_from"),
        F.when(F.col("is_end"), F.col("before") + F.col("words")).alias("total"),
        (F.col("single") & F.col("is_end")).cast("int").alias("leaf"))
    # Words before a node never fall with its depth, so the least is that of the first one.
    return kept.unionByName(alone).groupBy("conv_id").agg(
        F.coalesce(F.min("own_from"), F.max("total")).alias("own_from"), F.max("leaf").alias("leaf"))


def prefix_nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns (conv_id, place, sign, words)``; ``members (conv_id)``
    lists the conversations, those without turns too.

    Per node: ``conv_id``, its smallest member, ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``, the digest of the ids
    of conversations that end in it."""
    named = stage(prefixes(turns, members), "prefixes")
    rows = stage(screened(named, shared_counters(named)), "screened")
    shared, alone = rows.where("NOT single"), rows.where("single")

    groups = stage(
        shared.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"),
            F.min("p2").alias("p2"), F.min("before").alias("before"), F.count(F.lit(1)).alias("n_convs"),
            F.max("parent_single").alias("parent_single")), "nodes")
    children = stage(
        groups.select("p1", "p2").unionByName(alone.where("NOT parent_single").select("p1", "p2"))
        .where("p1 IS NOT NULL").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2"))
        .agg(F.count(F.lit(1)).alias("n_children")), "children")
    places = stage(_own_places(rows, groups, children), "places").withColumnRenamed("conv_id", "of")
    sums = shared.join(places, F.col("conv_id").eqNullSafe(F.col("of"))).groupBy(*_NODE).agg(
        F.sum("leaf").cast("bigint").alias("n_leaves"),
        F.sum(F.greatest(F.col("own_from") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    none = F.lit(0).cast("bigint")
    grouped = groups.join(children, _NODE, "left").join(sums, _NODE).join(_ends(shared), _NODE, "left").select(
        "conv_id", "depth", "p1", "p2", "parent_single", "n_convs",
        F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", _sha(F.lit(""))).alias("ends_sha256"))
    one = F.lit(1).cast("bigint")
    single = alone.select(
        "conv_id", "depth", "p1", "p2", "parent_single", one.alias("n_convs"),
        F.when(F.col("is_end"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        none.alias("saved_tokens"),
        _sha(F.when(F.col("is_end"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).otherwise("")).alias("ends_sha256"))
    nodes = stage(grouped.unionByName(single), "trie")
    known = nodes.where("parent_single OR p1 IS NULL").withColumn(
        "parent_conv_id", F.when(F.col("parent_single"), F.col("conv_id")))
    lookup = groups.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    asked = lookup_join(nodes.where("NOT parent_single AND p1 IS NOT NULL"), lookup, ["p1", "p2"])
    return known.unionByName(asked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_nodes` of conversations as they are: ``conv_id, turn, role, text``."""
    turns = stage(signed_turns(conversations), "turns")
    return prefix_nodes(turns, turns.select("conv_id").distinct())
