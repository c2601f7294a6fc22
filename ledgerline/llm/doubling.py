"""Repeated passages by level-wise doubling of window lengths.

The ladder of lengths ends at the window asked for and begins at the last of its halves
that has eight words or fewer (7, 13 for a window of 13). Only windows that are repeated
at one length are extended to the next, twice as long; the climb ends at the top, or
where no document has candidates left.

The first length is sampled without loss: of the short windows inside a window of the
second length, the one with the smallest hash is its anchor, and equal windows have
equal anchors. So only anchors, about a quarter of all places, are counted, and a window
is a candidate only if its anchor is repeated. From the third length on, a window is a
candidate if both of its halves are repeated.

Counting a length: each task sorts the hashes of a chunk of documents, settles those
that meet inside the chunk, and sends one entry per hash, packed by range of hash, so a
passage that very many documents share is one entry per chunk. Anchors are named by 64
bits, which only choose candidates; windows by 128 bits, which decide. Answers go back
to a document as the places of its repeated windows. All steps are one plan, in which
the shuffle that brings texts and answers together is made once and read again by each
length and by the removal.

A chunk never sends a row to each of many buckets: beyond ``FAN`` of them the ranges become
finer in hops (:func:`routes`). A hop deals the entries of a range out by salts, so that a
group is about as large as a bucket; a group merges its entries, settles what meets in it,
and cuts the rest into at most about ``FAN`` finer ranges. So rows grow with the entries, and a
passage that all chunks share is down to one entry per group before it meets in one bucket.

Defined results: null and empty texts have no words; texts of any length are taken whole, one
alone in its chunk if need be; rows without an id come after all others, and none of them is
smaller than another; rows that share an id are one document as far as "smaller" goes, and
each loses its own words; of equal windows in a document the first answers for all; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

WINDOW = 13
FIRST = 8
CHUNK_CHARACTERS = 2_500_000
BUCKET_BYTES = 40_000_000
LEAST_BUCKETS = 16
FAN = 256  # most ranges that a chunk or a group of a hop sends rows to, but for rounding
MOST_PARTITIONS = 20_000
NO_ID = 2**63 - 1

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ladder(window: int = WINDOW) -> list[int]:
    """The lengths, shortest first; at least two."""
    lengths = [window]
    while lengths[0] > FIRST or len(lengths) == 1:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


# --- hashes of windows ------------------------------------------------------------


class Words:
    """The words of a chunk of texts in a row, with the document each belongs to."""

    def __init__(self, texts: list[str]):
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        self.hashes = np.fromiter(
            (xxhash.xxh64_intdigest(w) for own in words for w in own), dtype=np.uint64, count=total)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.left = np.repeat(self.firsts + self.sizes, self.sizes) - np.arange(total)  # words to the document's end

    def starts(self, length: int) -> np.ndarray:
        """Where windows of a length start."""
        return np.flatnonzero(self.left >= length)

    def names(self, length: int, mixer: np.uint64) -> np.ndarray:
        """A hash of the window at each place; without meaning where none starts."""
        total = len(self.hashes)
        name = np.zeros(total, dtype=np.uint64)
        reach = max(total - length + 1, 0)
        for k in range(length):
            name[:reach] = name[:reach] * mixer + (self.hashes[k:k + reach] ^ mixer)
        name ^= name >> np.uint64(32)
        name *= mixer
        name ^= name >> np.uint64(29)
        return name

    def anchors(self, short: int, long: int, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the long windows, and the place of each one's anchor: the short window
        inside it with the smallest name, the leftmost of equals."""
        starts = self.starts(long)
        best, least = starts.copy(), name[starts]
        for k in range(1, long - short + 1):
            now = name[starts + k]
            less = now < least
            best[less] = starts[less] + k
            least[less] = now[less]
        return starts, best


def _members(words: Words, name: np.ndarray, places: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of ``places`` have a name that one of the ``chosen`` places of the same
    document has."""
    def keyed(at):
        return (name[at] ^ (words.owner[at].astype(np.uint64) * MIX_B)) if len(at) else np.zeros(0, dtype=np.uint64)
    return np.isin(keyed(places), keyed(chosen))


# --- packed rows ------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each byte of a number in a run of its own, compressed."""
    packer, parts = zstandard.ZstdCompressor(level=1), []
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes() if len(array) else b""
        planes = packer.compress(planes)
        parts += [array.dtype.str.encode().ljust(4), len(planes).to_bytes(8, "little"), planes]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    arrays, at, unpacker = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind = np.dtype(data[at:at + 4].decode().strip())
        size = int.from_bytes(data[at + 4:at + 12], "little")
        planes = np.frombuffer(unpacker.decompress(data[at + 12:at + 12 + size]), dtype=np.uint8)
        arrays.append(np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += 12 + size
    return arrays


_ROW = ["bucket", "salt", "id", "text_hash", "blob"]
_ROW_SQL = "bucket int, salt int, id long, text_hash long, blob binary"
_ANSWER_SQL = "id long, text_hash long, places binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=_ROW)


def routes(buckets: int) -> list[tuple[int, int]]:
    """Ranges and salts of each hop to ``buckets``, the last without salts. Ranges times
    salts are about as many as buckets, so all groups are of about one size."""
    hops = 1
    while FAN ** hops < buckets:
        hops += 1
    ranges = [round(buckets ** (n / hops)) for n in range(1, hops)] + [buckets]
    return [(r, -(-buckets // r)) for r in ranges]


def _mixed(number: int, size: int) -> int:
    """A number below ``size`` that depends on all bits of ``number``."""
    return ((number * int(MIX_A) & 2**64 - 1) >> 32) * size >> 32


def _answer_row(id_: int, text_hash: int, places: bytes, step: tuple[int, int]) -> tuple:
    """An answer rides along in any group, chosen by its document alone."""
    ranges, salts = step
    return _mixed(id_ ^ text_hash, ranges), _mixed(id_ ^ text_hash ^ int(MIX_B), salts), id_, text_hash, places


def _entry_rows(names: np.ndarray, second: np.ndarray, docs: np.ndarray, places: np.ndarray, known: np.ndarray,
                ids: np.ndarray, hashes: np.ndarray, ranges: int, salt: int) -> Iterator[tuple]:
    """Entries in the order of their names, packed by range of name: a row for each range
    that has any."""
    number = (names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
    for a, b in zip(cuts, [*cuts[1:], len(number)]):
        used, own = np.unique(docs[a:b], return_inverse=True)
        yield int(number[a]), salt, None, None, pack(
            np.diff(names[a:b], prepend=np.uint64(0)), second[a:b], own.astype("<u4"), places[a:b].astype("<u4"),
            known[a:b].astype("u1"), np.diff(ids[used], prepend=0), hashes[used])


def _entries(held: list[bytes], last: bool) -> tuple[np.ndarray, ...]:
    """Packed entries put together: names, second names, documents, places, whether known,
    and the ids and text hashes of the documents."""
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    at = 0
    for blob in held:
        gaps, second, numbers, places, known, ids, hashes = unpack(blob)
        names = np.cumsum(gaps, dtype=np.uint64)
        for column, part in zip(columns, (
                names, second if last else np.zeros(len(names), dtype=np.uint64),
                numbers.astype(np.int64) + at, places, known.astype(bool), np.cumsum(ids), hashes)):
            column.append(part)
        at += len(ids)
    return tuple(map(np.concatenate, columns))


def _by_document(ids: np.ndarray, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
    """Answers: for each document its id, text hash and packed sorted places."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order].astype("<u4")
    cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else []
    for a, b in zip(cuts, [*cuts[1:], len(docs)]):
        yield int(ids[docs[a]]), int(hashes[docs[a]]), places[a:b].tobytes()


def settle(names: np.ndarray, second: np.ndarray, docs: np.ndarray, places: np.ndarray, ids: np.ndarray, last: bool
           ) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk can say by itself about its windows, documents numbered by rising id.

    Returns the numbers of entries that are repeated here, and of those to be sent: the
    first of each document with the smallest id of its name. At the ``last`` length
    "repeated" means in a document with a smaller id, before it in another document."""
    order = np.lexsort((places, docs, second, names))
    names, second, docs = names[order], second[order], docs[order]
    new_name = np.concatenate([[True], (names[1:] != names[:-1]) | (second[1:] != second[:-1])])[:len(order)]
    new_doc = new_name.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    group = np.cumsum(new_name) - 1
    smallest = ids[docs[np.flatnonzero(new_name)]][group] if len(order) else ids[:0]
    first = ids[docs] == smallest
    if last:
        here = new_doc & ~first
    else:
        here = new_doc & (np.bincount(group, new_doc, minlength=group[-1] + 1)[group] > 1 if len(order) else new_doc)
    return order[here], order[new_doc & first]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``CHUNK_CHARACTERS`` of text each."""
    start = size = 0
    for n, value in enumerate(batch.column("text")):
        size += len(value.as_buffer() or b"") if value.is_valid else 0
        if size >= CHUNK_CHARACTERS:
            yield batch.slice(start, n + 1 - start)
            start, size = n + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _sender(lengths: list[int], level: int, step: tuple[int, int]):
    """Rows of (id, text_hash, text[, lists]) to packed entries of the level's windows, and
    answers already known."""
    last = level == len(lengths) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                ids = part.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                part, ids = part.take(pa.array(order)), ids[order]
                hashes = part.column("text_hash").to_numpy()
                words = Words(part.column("text").to_pylist())
                if level == 0:
                    name = words.names(lengths[0], MIX_A)
                    places = np.unique(words.anchors(lengths[0], lengths[1], name)[1])
                    second = np.zeros(len(places), dtype=np.uint64)
                else:
                    places = candidates(words, lengths, level, part.column("lists").to_pylist())
                    name = words.names(lengths[level], MIX_A)
                    second = words.names(lengths[level], MIX_B)[places]
                docs, inner = words.owner[places], places - words.firsts[words.owner[places]]
                here, sent = settle(name[places], second, docs, places, ids, last)
                rows = [_answer_row(*found, step) for found in _by_document(ids, hashes, docs[here], inner[here])]
                # The salt depends on the documents alone, so a task that runs again deals alike.
                salt = _mixed(int(np.bitwise_xor.reduce(ids ^ hashes)), step[1]) if len(ids) else 0
                rows += _entry_rows(name[places[sent]], second[sent] if last else second[:0], docs[sent], inner[sent],
                                    np.isin(sent, here), ids, hashes, step[0], salt)
                yield _batch(rows)

    return send


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], tuple | None, list[bytes]]]:
    """Sorted rows as ``(answers, group, blobs)``: answers as they come, entries of a whole
    group (bucket and salt) at once."""
    now, held = None, []
    for rows in batches:
        ready = []
        for bucket, salt, id_, text_hash, blob in zip(*[rows.column(n).to_pylist() for n in _ROW]):
            if text_hash is not None:
                ready.append((id_, text_hash, blob))
                continue
            if (bucket, salt) != now and held:
                yield [], now, held
                held = []
            now = bucket, salt
            held.append(blob)
        if ready:
            yield ready, None, []
    if held:
        yield [], now, held


def _splitter(last: bool, before: tuple[int, int], step: tuple[int, int]):
    """A hop: entries by group to entries by finer range, and answers for what meets here."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready, group, held in _grouped(batches):
            rows = [_answer_row(*found, step) for found in ready]
            if held:
                names, second, docs, places, known, ids, hashes = _entries(held, last)
                order = np.argsort(ids, kind="stable")
                rising = np.empty(len(ids), dtype=np.int64)
                rising[order] = np.arange(len(ids))
                docs, ids, hashes = rising[docs], ids[order], hashes[order]
                here, sent = settle(names, second, docs, places, ids, last)
                told = here[~known[here]]
                known[here] = True
                rows += [_answer_row(*found, step) for found in _by_document(ids, hashes, docs[told], places[told])]
                rows += _entry_rows(names[sent], second[sent] if last else second[:0], docs[sent], places[sent], known[sent],
                                    ids, hashes, step[0], group[1] * step[1] // before[1])
            yield _batch(rows)

    return split


def candidates(words: Words, lengths: list[int], level: int, lists: list[list[bytes]]) -> np.ndarray:
    """Starts of windows of a level that the answers of the level before leave."""
    before, length = lengths[level - 1], lengths[level]
    chosen = np.concatenate([
        np.zeros(0, dtype=np.int64),
        *[np.frombuffer(b"".join(own), dtype="<u4").astype(np.int64) + first
          for own, first in zip(lists, words.firsts.tolist()) if own]])
    name = words.names(before, MIX_A)
    if level == 1:
        starts, anchor = words.anchors(before, length, name)
        return starts[_members(words, name, anchor, chosen)]
    repeated = np.zeros(len(words.hashes) + length, dtype=bool)
    places = words.starts(before)
    repeated[places[_members(words, name, places, chosen)]] = True
    starts = words.starts(length)
    return starts[repeated[starts] & repeated[starts + length - before]]


def _counter(last: bool):
    """Entries by bucket to answers: the documents whose windows are repeated."""
    def answers(held: list[bytes]) -> Iterator[tuple]:
        names, second, docs, inner, known, ids, hashes = _entries(held, last)
        order = np.lexsort((second, names)) if last else np.argsort(names)
        names, second, docs, inner, known = (x[order] for x in (names, second, docs, inner, known))
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (second[1:] != second[:-1])])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(ids[docs], first)[group]
        if last:
            found = ids[docs] > smallest
        else:
            found = (np.bincount(group)[group] > 1) & ~known
        yield from _by_document(ids, hashes, docs[found], inner[found])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready, _, held in _grouped(batches):
            rows = [*ready, *(answers(held) if held else ())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                names=["id", "text_hash", "places"])

    return count


def _dealt(sent: DataFrame, step: tuple[int, int]) -> DataFrame:
    """Rows with their groups together, groups dealt out evenly over tasks."""
    ranges, salts = step
    parts = min(ranges * salts, MOST_PARTITIONS)
    group = F.col("bucket").cast("long") * salts + F.col("salt")
    return sent.repartitionById(parts, F.pmod(group, F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "salt")


def sent_rows(rows: DataFrame, lengths: list[int], level: int, buckets: int) -> DataFrame:
    """The entries of a level by bucket, and answers that chunks and hops gave."""
    last, steps = level == len(lengths) - 1, routes(buckets)
    sent = rows.mapInArrow(_sender(lengths, level, steps[0]), _ROW_SQL)
    for before, step in zip(steps, steps[1:]):
        sent = _dealt(sent, before).mapInArrow(_splitter(last, before, step), _ROW_SQL)
    return sent


def repeated_places(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The texts ``(id, text_hash, text)``, and answers ``(id, text_hash, lists)``: packed places
    of the first of equal windows in a document that also start in one with a smaller id."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    lengths, rows = ladder(window), texts
    for level in range(len(lengths)):
        counted = _dealt(sent_rows(rows, lengths, level, buckets), (buckets, 1)) \
            .mapInArrow(_counter(level == len(lengths) - 1), _ANSWER_SQL)
        # At most one entry per chunk, group and bucket that told of the document; those of rows
        # that repeat an id and a text are mostly equal, and kept once.
        answers = counted.groupBy("id", "text_hash").agg(F.collect_set("places").alias("lists"))
        rows = texts.join(answers, ["id", "text_hash"])
    return texts, answers


def covered_words(words: Words, lists: list[list[bytes] | None], window: int = WINDOW) -> np.ndarray:
    """Which words of a chunk lie in a window that the answers name, or in an equal one of
    the same document."""
    chosen = np.concatenate([
        np.zeros(0, dtype=np.int64),
        *[np.frombuffer(b"".join(own), dtype="<u4").astype(np.int64) + first
          for own, first in zip(lists, words.firsts.tolist()) if own]])
    starts = words.starts(window)
    hit = starts[_members(words, words.names(window, MIX_A), starts, chosen)]
    edges = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + window, -1)
    return np.cumsum(edges)[:-1] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, or ``kept_sha256`` for ``kept``: the words of
    each document that no repeated window covers, joined by one space."""
    texts, answers = repeated_places(docs, window)
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                whole = part.column("text").to_pylist()
                lists = part.column("lists").to_pylist()
                rows = [n for n, own in enumerate(lists) if own]
                words = Words([whole[n] for n in rows])
                gone = covered_words(words, [lists[n] for n in rows], window)
                cut = {n: gone[a:a + size] for n, a, size in zip(rows, words.firsts.tolist(), words.sizes.tolist())}
                counts, removed, kept = [], [], []
                for n, text in enumerate(whole):
                    own = text.encode("utf-8", "surrogatepass").split()
                    counts.append(len(own))
                    if n in cut:
                        own = [w for w, out in zip(own, cut[n].tolist()) if not out]
                    removed.append(counts[-1] - len(own))
                    line = b" ".join(own)
                    kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", last])

    done = texts.join(answers, ["id", "text_hash"], "left").select("id", "text", "lists") \
        .mapInArrow(run, f"id long, n_words long, n_removed long, {last} string")
    kind = docs.schema["doc_id"].dataType
    return done.select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias("doc_id"), "n_words", "n_removed", last)
