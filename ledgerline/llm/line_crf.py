"""Document quality from a linear-chain conditional random field over lines.

A chain is a document, a position a line. Every line has a few numbers (how long it and
its words are, shares of signs, capitals, digits, words said again, whether the line
itself is said again), and sees those of its neighbours. The field labels lines good or
bad; forward-backward gives each line's chance of being good, and the score of a
document is the mean of these, weighted by the lengths of the lines.

It is fitted on the driver to a bounded sample of labelled documents: about
``PER_CLASS`` of each label, chosen by a hash of the id, and of each at most
``TRAINING_LINES`` lines. All lines of a labelled document carry its label.

Defined results: null is the empty text, which is one empty line and is scored like any
other; without labels of both kinds every score is 0.5; where an id is labelled twice
the larger label counts; rows without an id are never learnt from and count as held
out; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import crf
from ledgerline.llm.hyperlang import _chunks, held_out, sampled
from ledgerline.llm.segment_bpe import LETTER, NUMBER, SPACE, character_classes

PER_CLASS = 2000
TRAINING_LINES = 60
ROUNDS = 120
MIXER = np.uint64(0x9E3779B97F4A7C15)
FEATURES = 12


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, firsts, dtype=np.float64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of every line of all texts, the lines of each text, and line lengths."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = character_classes()[code]
    ends = np.flatnonzero(code == 10)
    firsts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    lines = np.diff(np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)])))
    space = kind == SPACE
    letter = kind == LETTER
    length = (ends - firsts).astype(np.float64)
    chars = np.maximum(_sums(~space, firsts), 1.0)
    # Words: where each begins and ends, its line, and a hash to tell it from its neighbours.
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ended = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    number = np.searchsorted(ends, begins)
    count = np.bincount(number, minlength=len(ends)).astype(np.float64)
    words = np.maximum(count, 1.0)
    mixed = (code.astype(np.uint64) + np.uint64(1)) * MIXER
    mixed ^= mixed >> np.uint64(29)
    nothing = np.zeros(1, dtype=np.uint64)
    total = np.concatenate([nothing, np.cumsum(mixed * MIXER, dtype=np.uint64)])
    name = total[ended] - total[begins] if len(begins) else np.zeros(0, dtype=np.uint64)
    same = np.zeros(len(begins))
    if len(begins) > 1:
        same[1:] = (name[1:] == name[:-1]) & (number[1:] == number[:-1])
    again = np.bincount(number, same, minlength=len(ends))
    # Lines: equal to an earlier line of the text, by the sum of their place-weighted characters.
    place = np.arange(len(code)) - np.repeat(firsts, ends - firsts + 1)
    weighted = np.concatenate(
        [nothing, np.cumsum(mixed * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)])
    line_name = weighted[ends] - weighted[firsts]
    owner = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((np.arange(len(ends)), line_name, owner))
    repeated = np.zeros(len(ends))
    repeated[order[1:]] = (
        (line_name[order[1:]] == line_name[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        & (length[order[1:]] > 0))
    last = code[np.maximum(ends - 1, 0)]
    signs = np.isin(code, [ord(c) for c in "#*$%&|<>{}[]=_~^\\@"])
    upper = letter & ((code >= 65) & (code <= 90) | (code >= 0xC0) & (code <= 0xDE))
    table = np.stack([
        np.log1p(length) / 5,
        np.log1p(count) / 4,
        np.log(chars / words) / 2,
        np.log1p(20 * _sums(signs, firsts) / chars),
        np.log1p(20 * _sums(code == ord("!"), firsts) / chars),
        np.log1p(20 * _sums(upper, firsts) / chars),
        np.log1p(20 * _sums(kind == NUMBER, firsts) / chars),
        np.log1p(20 * again / words),
        repeated,
        np.isin(last, [ord(c) for c in ".!?:;\"'"]).astype(np.float64),
        np.log1p(20 * _sums((code == ord(",")) | (code == ord(".")), firsts) / chars),
        (length == 0).astype(np.float64),
    ], axis=1)
    return table, lines.astype(np.int64), length


def with_neighbours(table: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's numbers beside those of the line before and after (zero at the ends)."""
    before, after = np.zeros_like(table), np.zeros_like(table)
    before[1:], after[:-1] = table[:-1], table[1:]
    lasts = np.cumsum(lines) - 1
    before[lasts - lines + 1] = 0.0
    after[lasts] = 0.0
    return np.concatenate([table, before, after, np.ones((len(table), 1))], axis=1)


class LineField:
    """Weights of the label good against bad, and scores of label pairs and first labels."""

    def __init__(self):
        self.weights = np.zeros(3 * FEATURES + 1)
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)

    def fit(self, table: np.ndarray, lines: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> LineField:
        """``table``: rows of :func:`with_neighbours`; ``good``: 0 or 1 per document."""
        labels = np.repeat(good.astype(np.int64), lines)
        firsts = (np.cumsum(lines) - lines)[lines > 0]
        pairs, started = crf.pair_counts(labels, lines, 2)
        values = {"weights": self.weights, "trans": self.trans, "start": self.start}
        adam, penalty = crf.Adam(0.1), 0.1
        for _ in range(rounds):
            scores = np.stack([np.zeros(len(table)), table @ values["weights"]], axis=1)
            marginals, expected, _ = crf.forward_backward(scores, lines, values["trans"], values["start"])
            adam.step(values, {
                "weights": table.T @ (labels - marginals[:, 1]) - penalty * values["weights"],
                "trans": pairs - expected - penalty * values["trans"],
                "start": started - marginals[firsts].sum(axis=0) - penalty * values["start"],
            })
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text."""
        table, lines, length = line_features(texts)
        wide = with_neighbours(table, lines)
        emissions = np.stack([np.zeros(len(wide)), wide @ self.weights], axis=1)
        marginals, _, _ = crf.forward_backward(emissions, lines, self.trans, self.start)
        weight, firsts = length + 1.0, np.cumsum(lines) - lines
        return np.clip(_sums(marginals[:, 1] * weight, firsts) / _sums(weight, firsts), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(text, quality)`` of about ``per_class`` documents of each label, none held out.

    The chosen ids are few by that parameter, so they are broadcast."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(3, 1)) \
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {row["quality"]: row["count"] for row in usable.groupBy("quality").count().collect()}
    if set(counts) < {0, 1}:
        return docs.select("text", F.lit(0).alias("quality")).where("false")
    share = F.when(F.col("quality") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    chosen = usable.where(sampled(share, "doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")


def train(docs: DataFrame, labels: DataFrame) -> LineField:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column("quality").to_pylist()
            for start, texts in _chunks(batch):
                table, lines, _ = line_features(texts)
                wide = with_neighbours(table, lines)
                firsts = np.cumsum(lines) - lines
                yield pa.RecordBatch.from_arrays([
                    pa.array(quality[start:start + len(texts)], pa.int32()),
                    pa.array([wide[a:a + min(n, TRAINING_LINES)].astype("<f4").tobytes()
                              for a, n in zip(firsts.tolist(), lines.tolist())], pa.binary()),
                ], names=["quality", "lines"])

    sample = labelled_sample(docs, labels).withColumn("quality", F.col("quality").cast("int"))
    rows = sample.mapInArrow(run, "quality int, lines binary").orderBy(F.xxhash64("lines"), "quality").collect()
    if not rows:
        return LineField()
    tables = [np.frombuffer(row["lines"], dtype="<f4").reshape(-1, 3 * FEATURES + 1) for row in rows]
    return LineField().fit(
        np.concatenate(tables).astype(np.float64), np.array([len(t) for t in tables]),
        np.array([row["quality"] for row in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per document."""
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch):
                scores = field.scores(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)),
                    batch.column("held_out").slice(start, len(texts)),
                    pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                ], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(3, 1).alias("held_out")) \
        .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
