"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field
adds spans that the patterns miss, such as phone numbers without a country code. It is
trained from a small labelled table: chains of words from a bounded sample of
documents, labelled by the patterns, and once more with country codes left out. Its
features are word shapes (letters, digits and marks, runs drawn together) of a word
and its neighbours and the number of its digits; chains are decoded by Viterbi in
numpy batches. A chain is a stretch of words around words with digits or signs, up to
``CONTEXT`` words away: all other words have plain shapes and belong to no span.

An added span has to touch no span of a pattern, and its digits have to fit its kind.

All patterns are matched in linear time, so that a text of one very long word is no
trap. Offsets count code points, ends are exclusive.

Defined results: null is the empty text and has no span; a corpus without digits or
signs trains no field, and only the patterns count; repeated rows are each searched;
other columns are ignored, or carried along by :func:`masked`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import crf
from ledgerline.llm.hyperlang import sampled

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *[f"{mark}-{kind}" for kind in KINDS for mark in "BI"]]

#: Sizes of the labelled sample: documents, chains, and words of a chain.
SAMPLE_DOCUMENTS = 4000
SAMPLE_CHAINS = 6000
CHAIN_WORDS = 48
ROUNDS = 120

CONTEXT = 3
SLOTS = 5
BUCKETS = 2048

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARKED = re.compile(r"[0-9@+]+")
WORD = re.compile(r"\S+")
GAP = re.compile(r"\s")
EDGES = "()[]{}<>,.;:!?\"'|"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                yield at, end
            at = end + 1


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start."""
    spans = [("email", a, b) for a, b in _emails(text)]
    spans += [("ip", a, b) for a, b in _addresses(text)]
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", match.start(), match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(match.group())) <= 15:
                spans.append(("phone", match.start(), match.end()))
    return spans


# --- chains -----------------------------------------------------------------------


def _word_left(text: str, at: int) -> int:
    """The start of the word before ``at``, or of the text."""
    while at and text[at - 1].isspace():
        at -= 1
    while at and not text[at - 1].isspace():
        at -= 1
    return at


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where the chains of a text start and end."""
    begin = end = None
    word_end = 0
    for hit in MARKED.finditer(text):
        if hit.start() < word_end:
            continue
        gap = GAP.search(text, hit.end())
        word_end = gap.start() if gap else len(text)
        if end is None or hit.start() >= end:
            left = hit.start()
            if left and not text[left - 1].isspace():
                left = _word_left(text, left)
            for _ in range(CONTEXT):
                left = _word_left(text, left)
            if end is None:
                begin = left
            elif left > end:
                yield begin, end
                begin = left
        end = word_end
        for word in islice(WORD.finditer(text, word_end), CONTEXT):
            end = word.end()
    if begin is not None:
        yield begin, end


def words_of(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Words without the marks at their edges; the whole word where nothing else is left."""
    found = []
    for word in WORD.finditer(text, begin, end):
        a, b = word.span()
        while a < b and text[a] in EDGES and not (text[a] == "(" and text[a + 1:a + 2].isdigit()):
            a += 1
        while b > a and text[b - 1] in EDGES:
            b -= 1
        found.append((a, b) if a < b else word.span())
    return found


_RUNS = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"(.)\1+"), r"\1")]


def shape(word: str) -> str:
    """Letters as a, digits as 9, marks as they are, runs drawn together."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:24]


def _bucket(slot: int, value: str) -> int:
    return slot * BUCKETS + zlib.crc32(value.encode("utf-8", "surrogatepass")) % BUCKETS


def chain_features(words: list[str]) -> list[list[int]]:
    """For each word, the bucket of each of its features."""
    shapes = ["^", *map(shape, words), "$"]
    digits = [str(min(sum(c in "0123456789" for c in w), 20)) for w in words]
    return [
        [_bucket(0, shapes[t + 1]), _bucket(1, shapes[t]), _bucket(2, shapes[t + 2]), _bucket(3, digits[t]),
         _bucket(4, shapes[t + 1] + " " + digits[t])]
        for t in range(len(words))]


def _labels(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    labels = [0] * len(words)
    for kind, a, b in spans:
        inside = [t for t, (x, y) in enumerate(words) if x < b and y > a]
        for n, t in enumerate(inside):
            labels[t] = LABELS.index(("I-" if n else "B-") + kind)
    return labels


def labelled_chains(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Words and labels of the chains of a text, and of its phone numbers without their
    country codes."""
    spans = pattern_spans(text)
    for begin, end in stretches(text):
        places = words_of(text, begin, end)[:CHAIN_WORDS]
        near = [s for s in spans if s[1] < end and s[2] > begin]
        words, labels = [text[a:b] for a, b in places], _labels(places, near)
        yield words, labels
        first, inner = LABELS.index("B-phone"), LABELS.index("I-phone")
        codes = [t for t, label in enumerate(labels[:-1]) if label == first and labels[t + 1] == inner]
        if codes:
            yield ([w for t, w in enumerate(words) if t not in codes],
                   [first if t - 1 in codes else x for t, x in enumerate(labels) if t not in codes])


def labelled_table(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, chains: int = SAMPLE_CHAINS) -> DataFrame:
    """``(words, labels)``: the labelled table, of about ``documents`` documents chosen by
    the hash of their id and text, and at most ``chains`` rows."""
    total = docs.count()
    share = min(1.0, documents / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for t in batch.column("text") for c in labelled_chains(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([
                pa.array([w for w, _ in found], pa.list_(pa.string())),
                pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["words", "labels"])

    rows = docs.select("doc_id", "text").where(sampled(F.lit(share), "doc_id", "text")).select("text") \
        .mapInArrow(run, "words array<string>, labels array<int>")
    return rows.orderBy(F.xxhash64("words"), "words", "labels").limit(chains)


# --- the field --------------------------------------------------------------------


class Field:
    """Weights of features, label pairs and first labels."""

    def __init__(self):
        size = len(LABELS)
        self.weights = {
            "feature": np.zeros((SLOTS * BUCKETS, size)),
            "trans": np.zeros((size, size)),
            "start": np.zeros(size),
        }
        # An inside label only follows its own kind.
        for kind in KINDS:
            inside = LABELS.index("I-" + kind)
            for before, name in enumerate(LABELS):
                if name not in ("B-" + kind, "I-" + kind):
                    self.weights["trans"][before, inside] = -30.0
            self.weights["start"][inside] = -30.0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights["feature"][features].sum(axis=1)

    def fit(self, chains: list[tuple[list[str], list[int]]], rounds: int = ROUNDS) -> Field:
        lengths = np.array([len(w) for w, _ in chains], dtype=np.int64)
        features = np.array([f for w, _ in chains for f in chain_features(w)], dtype=np.int64).reshape(-1, SLOTS)
        labels = np.array([x for _, xs in chains for x in xs], dtype=np.int64)
        size = len(LABELS)
        seen, compact = np.unique(features, return_inverse=True)
        compact = compact.reshape(features.shape)
        weights = {k: v.copy() for k, v in self.weights.items()}
        weights["feature"] = weights["feature"][seen]
        fixed_trans, fixed_start = weights["trans"] < -20, weights["start"] < -20
        pairs, firsts = crf.pair_counts(labels, lengths, size)
        observed = np.eye(size)[labels]
        first_rows = np.cumsum(lengths) - lengths
        adam, penalty = crf.Adam(0.1), 0.02
        for _ in range(rounds):
            marginals, expected, _ = crf.forward_backward(
                weights["feature"][compact].sum(axis=1), lengths, weights["trans"], weights["start"])
            gap = observed - marginals
            slope = np.zeros_like(weights["feature"])
            for slot in range(SLOTS):
                for label in range(size):
                    slope[:, label] += np.bincount(compact[:, slot], gap[:, label], len(seen))
            gradients = {
                "feature": slope - penalty * weights["feature"],
                "trans": np.where(fixed_trans, 0.0, pairs - expected - penalty * weights["trans"]),
                "start": np.where(fixed_start, 0.0, firsts - marginals[first_rows].sum(axis=0) - penalty * weights["start"]),
            }
            adam.step(weights, gradients)
        self.weights["feature"][seen] = weights["feature"]
        self.weights["trans"], self.weights["start"] = weights["trans"], weights["start"]
        return self

    def spans(self, texts: list[str], places: list[tuple[int, list[tuple[int, int]]]]) -> list[list[Span]]:
        """Decoded spans of each text; ``places``: number of the text and words of each chain."""
        found: list[list[Span]] = [[] for _ in texts]
        if not places:
            return found
        lengths = np.array([len(words) for _, words in places], dtype=np.int64)
        features = np.array([f for n, words in places for f in chain_features([texts[n][a:b] for a, b in words])],
                            dtype=np.int64).reshape(-1, SLOTS)
        best = crf.viterbi(self.emissions(features), lengths, self.weights["trans"], self.weights["start"]).tolist()
        at = 0
        for n, words in places:
            open_kind = None
            for (a, b), label in zip(words, best[at:at + len(words)]):
                name = LABELS[label]
                if name[0] == "I" and open_kind == name[2:]:
                    kind, begin, _ = found[n][-1]
                    found[n][-1] = (kind, begin, b)
                elif name[0] == "B":
                    found[n].append((name[2:], a, b))
                open_kind = name[2:] or None
            at += len(words)
        return found


def train(docs: DataFrame) -> Field:
    """The field, fitted on the driver to the bounded labelled table."""
    chains = [(row["words"], row["labels"]) for row in labelled_table(docs).collect() if row["words"]]
    return Field().fit(chains) if chains else Field()


def fits(kind: str, word: str) -> bool:
    """Whether the characters of a decoded span can be of its kind."""
    digits = "".join(DIGIT.findall(word))
    if kind == "email":
        name, _, domain = word.partition("@")
        return bool(name) and DOMAIN.fullmatch(domain) is not None
    if kind == "ip":
        return len(word.split(".")) == 4 and all(p.isdigit() and p.isascii() and _byte(p) for p in word.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search(r"[^\x20().0-9+-]", word)


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and those with the field's added."""
    base = [pattern_spans(text) for text in texts]
    places = [(n, words_of(text, a, b)) for n, text in enumerate(texts) for a, b in stretches(text)]
    result = []
    for text, own, decoded in zip(texts, base, field.spans(texts, places)):
        taken = sorted((a, b) for _, a, b in own)
        new = []
        for kind, a, b in decoded:
            if fits(kind, text[a:b]) and not any(x < b and y > a for x, y in taken):
                new.append((kind, a, b))
        every = sorted([*own, *new], key=lambda s: (KINDS.index(s[0]), s[1]))
        result.append((own, every))
    return result


def _texts(batch: pa.RecordBatch, size: int = 500) -> Iterator[tuple[int, list[str]]]:
    column = batch.column("text")
    for start in range(0, batch.num_rows, size):
        yield start, [t.as_py() or "" for t in column.slice(start, size)]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def found_spans(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _texts(batch):
                both = all_spans(field, texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)),
                    *[pa.array([sum(s[0] == kind for s in own) for own, _ in both], pa.int64()) for kind in KINDS],
                    pa.array([hashlib.sha256(_written(own).encode()).hexdigest() for own, _ in both], pa.string()),
                    pa.array([_written(every) for _, every in both], pa.string()),
                ], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by the name of its kind; spans that overlap are
    replaced together, by the name of the first."""
    out, at, last = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if last is not None and a < last:
            at = last = max(last, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = last = b
    return "".join([*out, text[at:]])


def scrubbed(text: str, spans: list[Span]) -> str:
    """``text`` masked until the patterns find nothing more: a number that a pattern dropped
    because of its neighbour can be a match once the neighbour is masked."""
    while spans:
        text = mask(text, spans)
        spans = pattern_spans(text)
    return text


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars``, where there is such a
    column, counted anew for texts that changed. Null texts stay null."""
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text_at = names.index("text")
            for start, texts in _texts(batch):
                part = batch.slice(start, len(texts))
                clean = [scrubbed(t, every) for t, (_, every) in zip(texts, all_spans(field, texts))]
                nulls = part.column(text_at).is_null().to_pylist()
                columns = list(part.columns)
                columns[text_at] = pa.array(
                    [None if null else c for null, c in zip(nulls, clean)], batch.schema.field(text_at).type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    old = part.column(at).to_pylist()
                    columns[at] = pa.array(
                        [n if null or c == t else len(c) for n, null, c, t in zip(old, nulls, clean, texts)],
                        batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
