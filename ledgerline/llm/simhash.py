"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check, components.

Fingerprints are counted first, so a group of equal ones is a single node whatever its
size. 64 bits in ``BLOCKS`` blocks: two fingerprints that differ in at most
``DISTANCE`` bits agree on at least ``BLOCKS - DISTANCE`` blocks, so they meet under at
least one choice of that many blocks. With seven blocks a key has three of them, 27 or
28 bits, and there are 35 keys; more blocks make longer keys and more of them. No pair
is lost for any choice of ``BLOCKS > DISTANCE``.

A key's members are compared in chunks of ``CHUNK``: a key with more members is dealt
out over pairs of chunks, so no task holds a whole key, and each comparison gives a
spanning forest of its links, never all pairs.

Defined results: null and empty texts have fingerprint zero and are one group; rows
that share a doc_id are rows of their own; a null doc_id is never the smallest unless
its whole component has no id; of equal fingerprints (ties) any may stand for the others in a
link; an empty table gives an empty result; very long texts are hashed whole, one at a time;
other columns are ignored, or kept as they are by :func:`keep_first`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.components import smallest_reachable
from ledgerline.session import stage

WORDS = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
CHUNK = 256

#: For each byte value, its eight bits, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, repeats included; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        hashes = np.array([digest(line, SEED)], dtype=np.uint64)
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = np.array(
            [digest(line[s:e - 1], SEED) for s, e in zip(starts, starts[WORDS:])], dtype=np.uint64)
    ones = np.concatenate([
        np.bincount(column, minlength=256) @ BITS for column in hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))],
            names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)``, the 64 bits of the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")) \
        .mapInArrow(_fingerprints, f"doc_id {kind}, text_hash long, fp long")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, their bits as a signed long."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    found = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``prints``."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    left, edges = np.ones(len(prints), dtype=bool), []
    while left.any():
        front = [int(np.argmax(left))]
        left[front[0]] = False
        while front:
            here = front.pop()
            new = np.flatnonzero(near[here] & left)
            left[new] = False
            front.extend(new.tolist())
            edges.extend((here, int(x)) for x in new)
    return edges


def _linker(distance: int):
    """Rows sorted by (key, value, low, high); each run of them is one comparison of at
    most two chunks. A run that ends with the batch waits for the next batch."""
    names = ["key", "value", "low", "high"]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in _and_end(batches):
            if batch is not None:
                now = [batch.column(n).to_numpy(zero_copy_only=False) for n in [*names, "fp"]]
                kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            if kept is None or not len(kept[0]):
                continue
            change = np.zeros(len(kept[0]), dtype=bool)
            change[0] = True
            for column in kept[:4]:
                change[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(change)
            done = len(kept[0]) if batch is None else starts[-1]
            prints = kept[4].view(np.uint64)
            a, b = [], []
            sizes = np.diff(np.append(starts, len(kept[0])))
            closed = starts < done
            # Most runs are pairs: compare those at once.
            pair = starts[closed & (sizes == 2)]
            pair = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= distance]
            a.append(prints[pair])
            b.append(prints[pair + 1])
            for start, size in zip(starts[closed & (sizes > 2)], sizes[closed & (sizes > 2)]):
                run = prints[start:start + size]
                edges = _forest(run, distance)
                a.append(run[[x for x, _ in edges]])
                b.append(run[[y for _, y in edges]])
            kept = [column[done:] for column in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    return links


def _and_end(batches):
    yield from batches
    yield None


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` of ``nodes`` that connect all
    that are linked by ``distance`` or fewer differing bits."""
    keyed = nodes.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, distance)])).alias("key", "value"))
    sizes = stage(keyed.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-sizes")
    crowded = keyed.join(sizes, ["key", "value"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = (
        crowded.withColumn("chunks", chunks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    names = ["key", "value", "low", "high"]
    return (
        dealt.repartition(*names).sortWithinPartitions(*names, "fp")
        .mapInArrow(_linker(distance), "a long, b long").distinct()
    )


def _grouped(docs: DataFrame, distance: int, blocks: int) -> DataFrame:
    """:func:`fingerprints` with ``root``, the smallest fingerprint of the component, and
    ``component_id``."""
    prints = stage(fingerprints(docs), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = smallest_reachable(links(nodes, distance, blocks))
    rooted = stage(
        nodes.join(roots, nodes["fp"] == roots["node"], "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = stage(rooted.join(firsts, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: the smallest doc_id reachable
    over links of ``distance`` or fewer differing bits."""
    return _grouped(docs, distance, blocks).select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id.

    Rows without an id come last. Of rows that share this doc_id, that with the smallest
    hash of its text stays, and of rows equal in both any one. Texts are shuffled only for
    such repeated rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    grouped = _grouped(docs, distance, blocks)
    copies = grouped.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    winners = stage(
        copies.groupBy("root").agg(first, F.min_by("copies", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("copies"))
        .select(F.col("first.doc_id").alias("win_id"), F.col("first.text_hash").alias("win_hash"), "copies"), "first-copies")

    def rows(chosen: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(chosen["win_id"]) & (F.xxhash64(docs["text"]) == chosen["win_hash"])
        return docs.join(chosen, same, "left_semi")

    single, repeated = winners.where("copies = 1"), winners.where("copies > 1")
    if repeated.limit(1).count() == 0:
        return rows(single)
    struct = F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row")
    one = rows(repeated).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), struct) \
        .dropDuplicates(["id", "hash"]).select("row.*")
    return rows(single).unionByName(one)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
