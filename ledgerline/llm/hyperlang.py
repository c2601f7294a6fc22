"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. The vector of
a three-letter sequence binds its letters by multiplication, each rotated by its place;
the profile of a text bundles (adds up) the vectors of all its sequences. A language's
prototype bundles the unit profiles of its documents, and a text gets the language whose
prototype has the largest cosine with its profile.

Letters are lower-cased; any other character is a word boundary, which is a symbol of
its own at either end of a sequence. Profiles of many texts are one product of counts
and sequence vectors, or, where texts have very many distinct sequences, a product each.

Prototypes are learnt from a bounded sample: about ``PER_LANGUAGE`` documents of each
language, chosen by a hash of id and text. Tasks send sums per language, so what
reaches the driver is one vector per language.

Defined results: a text that is null or without a letter is ``und`` with score 0; with
no language learnt all texts are ``und``; among equal cosines the first language by
name; rows without an id are never learnt from and count as held out; repeated rows
are each predicted; a text of any length is taken whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.segment_bpe import LETTER, character_classes

DIMENSIONS = 512
SEED = 20_011
PER_LANGUAGE = 2000
CHUNK_CHARACTERS = 1_000_000
DENSE_CODES = 1 << 22
DENSE_CELLS = 1 << 23  # most cells, and most sequences, that are counted in one table
DENSE_KINDS = 1 << 15
BLOCK = 4096

_letters: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The random vector of a code point; 0 stands for the word boundary."""
    vector = _letters.get(code)
    if vector is None:
        bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS)
        vector = _letters[code] = (2 * bits - 1).astype(np.int8)
    return vector


def sequences_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct letters, the distinct sequences as rows of three places among the letters,
    and for each occurrence its text and its sequence."""
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters, symbol = np.unique(np.where(character_classes()[code] == LETTER, code, 0), return_inverse=True)
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    size = len(letters)  # the first is 0, as there is a line end
    middle = np.flatnonzero(symbol[1:-1] != 0) + 1
    number = (symbol[middle - 1] * size + symbol[middle]) * size + symbol[middle + 1]
    if size ** 3 <= DENSE_CODES:
        present = np.bincount(number, minlength=size ** 3) > 0
        kinds = np.flatnonzero(present)
        place = (np.cumsum(present) - 1)[number]
    else:
        kinds, place = np.unique(number, return_inverse=True)
    parts = np.stack([kinds // (size * size), kinds // size % size, kinds % size], axis=1)
    return letters, parts.reshape(-1, 3), owner[middle - 1], place


def profiles(texts: list[str]) -> np.ndarray:
    """One bundled vector per text; all zero for a text without a letter.

    Sums are whole numbers, exact in 32-bit floats for texts of under 2^24 letters, so the two
    ways below give equal vectors: one product of a table of counts where that table is small,
    else the sequences of each text by themselves, ``BLOCK`` at a time."""
    letters, parts, owner, place = sequences_of(texts)
    found = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if not len(parts):
        return found
    table = np.stack([letter_vector(int(c)) for c in letters])

    def bound(rows: np.ndarray) -> np.ndarray:
        vectors = np.roll(table[rows[:, 0]], 2, axis=1)
        vectors *= np.roll(table[rows[:, 1]], 1, axis=1)
        vectors *= table[rows[:, 2]]
        return vectors.astype(np.float32)

    cell = owner * len(parts) + place
    if len(texts) * len(parts) <= DENSE_CELLS and len(parts) <= DENSE_KINDS:
        counts = np.bincount(cell, minlength=len(texts) * len(parts)).reshape(len(texts), len(parts))
        return counts.astype(np.float32) @ bound(parts)
    cell, counts = np.unique(cell, return_counts=True)
    owner, place, counts = cell // len(parts), cell % len(parts), counts.astype(np.float32)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for n, (start, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        for a in range(start, end, BLOCK):
            b = min(a + BLOCK, end)
            found[n] += counts[a:b] @ bound(parts[place[a:b]])
    return found


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    start, texts, size = 0, [], 0
    for n, value in enumerate(batch.column("text")):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARACTERS or len(texts) == 1000:
            yield start, texts
            start, texts, size = n + 1, [], 0
    if texts:
        yield start, texts


def held_out(modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text has the remainder; true for rows without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))


def sampled(share: Column, *columns: str) -> Column:
    """Whether the hash of a row falls into a share, however small the share is."""
    fraction = F.xxhash64(F.lit(1), *columns).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) + fraction < share * 1_000_000


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages by name, and their prototypes, from ``docs (doc_id, text, lang)``."""
    known = docs.where("lang is not null and text is not null")
    shares = {
        row["lang"]: min(1.0, per_language / row["count"]) for row in known.groupBy("lang").count().collect()}
    if not shares:
        return [], np.zeros((0, DIMENSIONS))
    part = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    chosen = known.where(sampled(F.element_at(part, F.col("lang")), "doc_id", "text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in _chunks(batch):
                for lang, row in zip(langs[start:], unit(profiles(texts)).astype(np.float64)):
                    bundles[lang] = bundles.get(lang, 0.0) + row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(bundles), pa.string()),
             pa.array([b.tolist() for b in bundles.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    partial = chosen.select("lang", "text").mapInArrow(sums, "lang string, bundle array<double>")
    whole = partial.select("lang", F.posexplode("bundle").alias("place", "value")) \
        .groupBy("lang", "place").agg(F.round(F.sum("value"), 6).alias("value")).collect()
    langs = sorted(shares)
    prototypes = np.zeros((len(langs), DIMENSIONS))
    for row in whole:
        prototypes[langs.index(row["lang"]), row["place"]] = row["value"]
    return langs, unit(prototypes)


def predicted(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of ``docs (doc_id, text, held_out)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch):
                own = profiles(texts)
                lettered = own.any(axis=1) if langs else np.zeros(len(texts), dtype=bool)
                cosines = unit(own).astype(np.float64) @ prototypes.T if langs else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)),
                    batch.column("held_out").slice(start, len(texts)),
                    pa.array([langs[b] if ok else "und" for b, ok in zip(best, lettered)], pa.string()),
                    pa.array(np.where(lettered, score, 0.0)),
                ], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Learn from rows of ``docs`` that are not held out (remainder 2 of 4), predict all."""
    marked = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    langs, prototypes = learn(marked.where("not held_out"))
    return predicted(marked.select("doc_id", "text", "held_out"), langs, prototypes)
