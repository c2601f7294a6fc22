"""Periodic runs of words, found from multi-scale minimizers.

A run is a stretch of consecutive words with smallest period ``q`` and a length of at least
``max(SHORTEST, 2 * q)`` that no neighbouring word extends. A stretch in which words ``q``
apart are equal and which cannot be extended is called a lag stretch; the runs are the lag
stretches of ``q`` words or more, each under its smallest ``q``.

Periods below ``DIRECT`` come from a scan of each lag. Longer ones are found per scale: for
periods in ``[P, 2P)`` with ``P`` a power of two, grams of ``P / 2`` words are hashed and
the least of each window of ``P / 2`` grams is marked. A run of such a period holds two
equal windows one period apart, so it holds two equal marks (minimizers) at that distance,
and each pair of equal marks at a distance in the range is extended to a lag stretch by
comparing words.

Grams that lie in a run of a period of a third of their length or less would give very many
pairs, so they are no marks; equal marks are then more than a sixth of ``P`` apart and a
mark has at most twelve partners. Where a window has only such grams it lies in one run of
that small period, known from a smaller scale, and the long run shows in one of two other
ways: two small runs of one period end one long period apart, which is a pair of marks as
well, or two small runs of one period touch, and then the long periods there follow from
the places of their ends. So no run is missed, and hashes only choose what is compared:
words are told apart exactly.

Many texts are scanned at once as one array, with a different number between any two of
them; a text of any length is one array in one task. Defined results: null, empty and blank
texts have no words and no runs; a null doc_id stays null; rows that share a doc_id are rows
of their own; of longest runs (ties) that with the smallest start, then period, is named; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHORTEST = 12
DIRECT = 32
#: Bytes of text that are scanned as one array; a longer text is an array of its own.
SCAN_BYTES = 4 * 2**20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes split at ASCII white space only."""
    return text.split() if text else []


# --- lag stretches ----------------------------------------------------------------

def _scanned(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all lag stretches that are long enough for a run."""
    differ = np.flatnonzero(ids[lag:] != ids[:-lag])
    edges = np.concatenate(([-1], differ, [len(ids) - lag]))
    wide = np.flatnonzero(np.diff(edges) - 1 >= max(SHORTEST, 2 * lag) - lag)
    return edges[wide] + 1, edges[wide + 1] + lag


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words of two arrays are equal, compared in growing pieces."""
    at, size, end = 0, 64, min(len(a), len(b))
    while at < end:
        differ = np.flatnonzero(a[at:at + size] != b[at:at + size][:len(a) - at])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 2
    return end


def _extended(ids: np.ndarray, at: np.ndarray, lag: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, lag)`` of the runs' lag stretches around places where words ``lag``
    apart are equal; places of a stretch that is known already are passed over."""
    found, known = [], (0, -1)
    for n in np.lexsort((at, lag)):
        m, q = int(at[n]), int(lag[n])
        if known[0] == q and m < known[1]:
            continue
        size = min(len(ids) - q - m, len(ids))
        right = m + _reach(ids[m:m + size], ids[m + q:m + q + size])
        left = m - _reach(ids[:m][::-1], ids[q:m + q][::-1])
        known = (q, max(right, m + 1))
        if right - left >= max(SHORTEST - q, q):
            found.append((left, right + q, q))
    return found


# --- marks ------------------------------------------------------------------------

def _paired(value: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with an equal value at a distance in ``[low, high)``, and that distance."""
    order = np.lexsort((at, value))
    value, at = value[order], at[order]
    places, lags, step = [], [], 1
    here = np.arange(len(at))
    while len(here := here[here + step < len(at)]):
        distance = at[here + step] - at[here]
        near = (value[here + step] == value[here]) & (distance < high)
        here, distance = here[near], distance[near]
        far = distance >= low
        places.append(at[here[far]])
        lags.append(distance[far])
        step += 1
    return np.concatenate([np.empty(0, np.int64), *places]), np.concatenate([np.empty(0, np.int64), *lags])


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least value of each window; ``window`` is a power of two."""
    at, least, size = np.arange(len(values)), values, 1
    while size < window:
        later = least[size:] < least[:-size]
        at = np.where(later, at[size:], at[:-size])
        least = np.where(later, least[size:], least[:-size])
        size *= 2
    return np.unique(at[least < _TOP])


def _inside(runs: np.ndarray, gram: int, size: int) -> np.ndarray:
    """Whether the gram at each place lies in a run of at most a third of its length."""
    small = runs[(3 * runs[:, 2] <= gram) & (runs[:, 1] - runs[:, 0] >= gram)]
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.minimum(small[:, 0], size), 1)
    np.add.at(change, np.minimum(small[:, 1] - gram + 1, size), -1)
    return np.cumsum(change[:-1]) > 0


def _phase(one: np.ndarray, other: np.ndarray) -> int:
    """How far ``one`` must be turned to the left to be ``other``; -1 if it never is."""
    twice, mark = np.concatenate((one, one)), other[0]
    for turn in np.flatnonzero(one == mark):
        if np.array_equal(twice[turn:turn + len(one)], other):
            return int(turn)
    return -1


def _touching(ids: np.ndarray, runs: np.ndarray, scale: int, places: list, lags: list) -> list[tuple[int, int, int]]:
    """Runs with a period of ``[scale, 2 * scale)`` where two runs of one small period touch.

    With ends ``s1, t1`` and ``s2, t2`` the long periods are those that bring the first small
    run into step with the second. Below the shorter of ``s2 - s1`` and ``t2 - t1`` the run
    is just ``[s2 - q, t1 + q)``; the few longer ones are left to be extended."""
    small = runs[(6 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    small = small[np.lexsort((small[:, 0], small[:, 2]))]
    found = []
    for (s1, t1, p), (s2, t2, p2) in zip(small[:-1].tolist(), small[1:].tolist()):
        if p != p2 or s2 > t1:
            continue
        turn = _phase(ids[s1:s1 + p], ids[s2:s2 + p])
        if turn < 0:
            continue
        first = scale + (s2 - s1 - turn - scale) % p
        periods = np.arange(first, min(2 * scale, t1 - s1 + 1, t2 - s2 + 1), p)
        plain = periods < min(s2 - s1, t2 - t1)
        found += [(s2 - q, t1 + q, q) for q in periods[plain].tolist()]
        rest = periods[~plain]
        places.append(np.maximum(s1, s2 - rest))
        lags.append(rest)
    return found


def _merged(runs: np.ndarray, found: list) -> np.ndarray:
    """All runs, each under its smallest period: one with a larger one has the same ends."""
    both = np.concatenate([runs, np.array(found, np.int64).reshape(-1, 3)])
    both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] != both[:-1, 1])
    return both[new]


def runs_of(ids: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs of an array, by start and end. ``longest``
    bounds the length of a run, where the array holds several texts."""
    ids = np.asarray(ids, np.int64)
    longest = len(ids) if longest is None else min(longest, len(ids))
    runs = np.empty((0, 3), np.int64)
    for lag in range(1, min(DIRECT, longest // 2 + 1)):
        starts, ends = _scanned(ids, lag)
        if len(starts):
            runs = np.concatenate([runs, np.stack([starts, ends, np.full(len(starts), lag)], axis=1)])
    runs = _merged(runs, [])
    hashes, gram, scale = ids.astype(np.uint64) * _MIX, 1, DIRECT
    while 2 * scale <= longest:
        while 2 * gram <= scale:
            left = hashes[:-gram] ^ (hashes[:-gram] >> np.uint64(29))
            hashes = left * _MIX + (hashes[gram:] ^ (hashes[gram:] >> np.uint64(32)))
            gram *= 2
            if 2 * gram == scale:
                break
        values = np.where(_inside(runs, gram, len(hashes)), _TOP, np.minimum(hashes, _TOP - np.uint64(1)))
        marks = _least(values, gram) if len(values) >= gram else np.empty(0, np.int64)
        ends = runs[(3 * runs[:, 2] <= gram) & (runs[:, 1] - runs[:, 0] >= scale - 1)]
        pairs = [_paired(values[marks], marks, scale, 2 * scale), _paired(ends[:, 2], ends[:, 1] - 1, scale, 2 * scale)]
        places, lags = [p for p, _ in pairs], [q for _, q in pairs]
        found = _touching(ids, runs, scale, places, lags)
        places, lags = np.concatenate(places), np.concatenate(lags)
        equal = ids[places] == ids[places + lags]
        found += _extended(ids, places[equal], lags[equal])
        runs = _merged(runs, found)
        scale *= 2
    return runs


# --- documents --------------------------------------------------------------------

def _report(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """``runs`` are ``(start, length, period)``."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped) > 0 if runs else dropped
    kept = b" ".join([w for w, out in zip(words, gone) if not out] if runs else words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = top or (None, None, None)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if top else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), runs, kept)


def _scan(group: list[tuple]) -> Iterator[tuple]:
    """Reports of ``(doc_id, words)``, found in one array."""
    numbers = defaultdict(count(1).__next__)
    arrays, at, starts = [], 0, []
    for n, (_, words) in enumerate(group):
        arrays += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - n])]
        starts.append(at)
        at += len(words) + 1
    found = runs_of(np.concatenate(arrays), max(len(words) for _, words in group))
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    own = defaultdict(list)
    for n, (start, end, period) in zip(owner.tolist(), found.tolist()):
        own[n].append((start - starts[n], end - start, period))
    for n, (doc_id, words) in enumerate(group):
        yield _report(doc_id, words, own[n])


def _groups(batches: Iterator[pa.RecordBatch], prepare: Prepare | None) -> Iterator[list[tuple]]:
    group, held = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            doc_id, words = doc_id.as_py(), words_of(text.as_py())
            group.append((doc_id, prepare(doc_id, words) if prepare else words))
            held += len(text.as_py() or b"")
            if held >= SCAN_BYTES:
                yield group
                group, held = [], 0
    if group:
        yield group


_FIELDS = ["n_runs", "start", "length", "period", "exponent_milli"]


def collapsed(docs: DataFrame, prepare: Prepare | None = None, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_runs``, the longest run's ``start, length, period,
    exponent_milli``, ``runs_sha256`` and ``collapsed_sha256``; ``with_text`` adds ``runs``
    and the ``text`` without the words of runs after their first period.

    ``prepare`` may change the words (UTF-8) of a document before they are searched."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [("runs", "array<struct<start: long, length: long, period: long>>"), ("text", "string")] if with_text else []
    schema = ", ".join([
        f"doc_id {kind}", *[f"{f} long" for f in _FIELDS], "runs_sha256 string", "collapsed_sha256 string",
        *[f"{n} {t}" for n, t in more]])
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_kind = first.schema.field(0).type

        def every():
            yield first
            yield from batches

        for group in _groups(every(), prepare):
            columns = list(zip(*_scan(group)))
            arrays = [pa.array(columns[0], id_kind), *[pa.array(c, pa.int64()) for c in columns[1:6]],
                      *[pa.array(c, pa.string()) for c in columns[6:8]]]
            names = ["doc_id", *_FIELDS, "runs_sha256", "collapsed_sha256"]
            if with_text:
                runs = [[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in columns[8]]
                arrays += [pa.array(runs, run), pa.array(columns[9], pa.binary()).cast(pa.string())]
                names += ["runs", "text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(reports, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by hash of the id, made periodic from some word on."""
    if doc_id is None or not words:
        return words
    mark = zlib.crc32(str(doc_id).encode())
    if mark % 10:
        return words
    mark, size = mark // 10, len(words)
    start = mark % size
    period = 1 + (size - start) // (3 + mark % 8)
    unit = words[start:start + period]
    tail = size - start
    return words[:start] + (unit * (tail // period + 1))[:tail]
