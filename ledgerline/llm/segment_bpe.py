"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A text is cut into pieces as the vocabulary's pattern says, each piece is encoded by
itself. The leaf of a live byte position holds the rank of the pair that starts there,
an inner node the smaller of its children, so the root gives the lowest rank and a walk
down, left child first, its leftmost place. A merge changes three leaves: the place of
the pair, its live left neighbour, and the place that dies; each change climbs to the
root. A piece of n bytes takes O(n log n), whatever its length.

Trees of pieces of like length are rows of one numpy array and take their steps
together; a piece is encoded once per task chunk and then remembered up to ``REMEMBERED``
pieces per worker (a bound on memory only).

The ranks are a file of the tokenizer package, named by its path; it has to exist where
the tasks run and is read once per worker.

Defined results: null is the empty text, which has no tokens; every text is taken whole;
repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REMEMBERED = 400_000
CHUNK_CHARACTERS = 1_000_000
TREE_CELLS = 1 << 21
NONE = np.int32(2**31 - 1)

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space as the pattern's language has it (the Unicode property), fixed values.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    classes = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            classes[code] = LETTER if kind == "L" else NUMBER
    classes[SPACES] = SPACE
    return classes


def pieces_of(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts in order, and for each text the number of its first piece
    (one more number at the end).

    The pattern: a contraction ('s 'd 'm 't 'll 've 're); else a run of letters, numbers
    or other marks with the one space before it; else a run of white space, which
    leaves its last character to what follows unless the text ends."""
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = len(code)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    if not total:
        return [], np.zeros(len(texts) + 1, dtype=np.int64)
    kind = character_classes()[code]
    begins = np.zeros(total + 1, dtype=bool)  # of texts; the end counts as one
    begins[firsts] = True
    start = begins.copy()
    start[1:total] |= kind[1:] != kind[:-1]
    # The last white space before something else in the same text.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:total])
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    # Contractions: the quote begins a piece and letters of the same text follow.
    quotes = np.flatnonzero((code == 0x27) & start[:total])
    padded = np.concatenate([code, np.zeros(2, dtype=code.dtype)])
    ends = np.concatenate([begins, [True, True]])
    one, two = padded[quotes + 1], padded[quotes + 2]
    inside = ~ends[quotes + 1]
    short = inside & np.isin(one, [ord(c) for c in "sdmt"])
    long = inside & ~ends[quotes + 2] & (
        ((one == ord("l")) & (two == ord("l"))) | (np.isin(one, [ord("v"), ord("r")]) & (two == ord("e"))))
    for place, size in ((quotes[short], 2), (quotes[long], 3)):
        start[place + 1] = False
        start[place + size] = True
    places = np.flatnonzero(start)  # ends with total
    raw = joined.encode("utf-8", "surrogatepass")
    if len(raw) == total:
        at = places
    else:
        widths = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(widths)])[places]
    at = at.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])], np.searchsorted(places, firsts)


class Strings:
    """Byte strings by number, that can be joined for a whole array of numbers at once."""

    def __init__(self, by_number: dict[int, bytes]):
        top = max(by_number) + 1
        strings = [by_number.get(n, b"") for n in range(top)]
        self.size = np.fromiter(map(len, strings), dtype=np.int64, count=top)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined strings, and where each of them ends."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.at[numbers] - (ends - sizes), sizes)
        source += np.arange(total)
        return self.flat[source].tobytes(), ends


class Ranks:
    """A rank file: token bytes by id, and the rank of each pair of ids that merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.id_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        self.spelled = Strings({i: b"%d " % i for i in self.bytes_of})
        self.spoken = Strings(self.bytes_of)
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ranks = [], []
        for token, rank in self.id_of.items():
            for cut in range(1, len(token)):
                left, right = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int32)[order]
        self.byte_pairs = self.pair(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.remembered: dict[bytes, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``NONE`` where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NONE)


def _merge_rows(ranks: Ranks, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Encode pieces of at most ``size`` (a power of two) bytes; ids in order, and how many each.

    Arrays are flat: row r has its tree at ``2 * size * r`` and its positions at
    ``(size + 1) * r``, the last of which stands for "no neighbour"."""
    rows, lengths = len(pieces), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    raw = np.zeros((rows, size), dtype=np.uint8)
    used = np.arange(size) < lengths[:, None]
    raw[used] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    width = size + 1
    token = np.zeros((rows, width), dtype=np.int64)
    token[:, :size] = ranks.byte_ids[raw]
    alive = np.zeros((rows, width), dtype=bool)
    alive[:, :size] = used
    after = np.tile(np.arange(1, width + 1), (rows, 1))
    after[after >= lengths[:, None]] = size
    before = np.tile(np.arange(-1, size), (rows, 1))
    before[:, 0] = size
    tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
    if size > 1:
        tree[:, size:2 * size - 1] = np.where(used[:, 1:], ranks.byte_pairs[raw[:, :-1], raw[:, 1:]], NONE)
    level = size // 2
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level //= 2
    token, alive, after, before, tree = (x.reshape(-1) for x in (token, alive, after, before, tree))

    def put(row, place, rank):
        """Set the leaf of a place in each row, and what stands above it."""
        root = row * (2 * size)
        node = place + size
        tree[root + node] = rank
        for _ in range(size.bit_length() - 1):
            lower = root + (node & ~1)
            node = node >> 1
            tree[root + node] = np.minimum(tree[lower], tree[lower + 1])

    row = np.arange(rows)
    row = row[tree[row * (2 * size) + 1] != NONE] if size > 1 else row[:0]
    while len(row):
        root, first = row * (2 * size), row * width
        lowest = tree[root + 1]
        node = np.ones(len(row), dtype=np.int64)
        for _ in range(size.bit_length() - 1):
            node *= 2
            node += tree[root + node] != lowest
        here = node - size
        dead = after[first + here]
        nearest = after[first + dead]
        token[first + here] = lowest
        alive[first + dead] = False
        after[first + here] = nearest
        before[first + nearest] = here  # at the place of "no neighbour" it is never read
        put(row, dead, NONE)
        put(row, here, np.where(nearest < size, ranks.pair(lowest, token[first + nearest]), NONE))
        left = before[first + here]
        has = np.flatnonzero(left < size)
        left = left[has]
        put(row[has], left, ranks.pair(token[first[has] + left], lowest[has]))
        row = row[tree[root + 1] != NONE]
    return token[alive], alive.reshape(rows, width).sum(axis=1)


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Blocks of pieces, and the ids of each as the bytes of an int32 array.

    A piece that is a token is that token."""
    whole = [p for p in pieces if p in ranks.id_of]
    yield whole, [ranks.id_of[p].to_bytes(4, "little") for p in whole]
    sized: dict[int, list[bytes]] = {}
    for piece in pieces:
        if piece not in ranks.id_of:
            sized.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
    for size, same in sized.items():
        step = max(1, TREE_CELLS // (2 * size))
        for at in range(0, len(same), step):
            block = same[at:at + step]
            ids, counts = _merge_rows(ranks, block, size)
            packed, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            yield block, [packed[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def ranks_at(path: str) -> Ranks:
    return Ranks(path)


def encode_texts(ranks: Ranks, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and where those of each text end."""
    pieces, firsts = pieces_of(texts)
    known = ranks.remembered
    missing = set(pieces).difference(known)
    if len(known) + len(missing) > REMEMBERED:
        known.clear()
        missing = set(pieces)
    for block, packed in encode_pieces(ranks, list(missing)):
        known.update(zip(block, packed))
    found = list(map(known.__getitem__, pieces))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    ends = np.concatenate([[0], np.cumsum(sizes)])[firsts]
    return np.frombuffer(b"".join(found), dtype="<i4"), ends[1:]


def _cut(whole: bytes, ends: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """``whole`` cut where the strings of each text's ids end."""
    places = np.concatenate([[0], ends])[np.concatenate([[0], upto])].tolist()
    return [whole[a:b] for a, b in zip(places, places[1:])]


def spelled(ranks: Ranks, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """For each text its ids as decimals joined by one space."""
    return [s[:-1] for s in _cut(*ranks.spelled.join(ids), upto)]


def decoded(ranks: Ranks, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """For each text the bytes that its ids stand for."""
    return _cut(*ranks.spoken.join(ids), upto)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    start, texts, size = 0, [], 0
    for n, value in enumerate(batch.column("text")):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARACTERS:
            yield start, texts
            start, texts, size = n + 1, [], 0
    if texts:
        yield start, texts


def encode_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids array<int>, decoded binary)`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_at(ranks_path)
        for batch in batches:
            for start, texts in _chunks(batch):
                ids, upto = encode_texts(ranks, texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(ids)),
                    pa.array(decoded(ranks, ids, upto), pa.binary()),
                ], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of what
    :func:`encode_documents` gives, made in the same task so that no id leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_at(ranks_path)
        for batch in batches:
            for start, texts in _chunks(batch):
                ids, upto = encode_texts(ranks, texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)),
                    pa.array(np.diff(upto, prepend=0), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in spelled(ranks, ids, upto)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded(ranks, ids, upto)]),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
