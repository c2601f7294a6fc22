"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import periodic
from ledgerline.llm.shipping import ship
from llm_frames import CLASHING, documents, odd_rows, sentence


def slow_runs(words):
    """Every run by trying each period at each place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def fast_runs(words):
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    return sorted(map(tuple, periodic.runs_of(ids).tolist()))


def power(unit, size):
    return (unit * (size // len(unit) + 1))[:size]


def test_random_words_of_small_alphabets():
    rng = random.Random(1)
    for letters in (1, 2, 3, 5):
        for size in (0, 1, 5, 11, 12, 13, 40, 130, 400, 900):
            words = [rng.randrange(letters) for _ in range(size)]
            assert fast_runs(words) == slow_runs(words)


def test_planted_periods_of_all_scales():
    rng = random.Random(2)
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            unit = [rng.randrange(rng.choice([2, 50])) for _ in range(rng.choice([1, 3, 7, 31, 32, 33, 40, 63, 64, 65, 100, 128, 200]))]
            words += [rng.randrange(50) for _ in range(rng.randrange(30))]
            words += power(unit, int(len(unit) * rng.choice([1.5, 2, 2.02, 2.5, 3, 5])))
        assert fast_runs(words) == slow_runs(words)


def test_runs_of_runs():
    """Long periods made of short ones, where few grams can be marks."""
    rng = random.Random(3)
    cases = [[0] * 700, [*([0] * 99), 1] * 5, [*([0, 1] * 60), 0] * 4, [1, *([0, 1] * 150), 0, *([0, 1] * 150), 1]]
    for _ in range(60):
        small = [power([rng.randrange(2) for _ in range(rng.choice([1, 2, 3, 5]))], rng.randrange(20, 160)) for _ in range(2)]
        unit = small[0] + small[1] * rng.randrange(2) + [rng.randrange(3)] * rng.randrange(2)
        cases.append([rng.randrange(3) for _ in range(rng.randrange(4))] + power(unit, int(len(unit) * rng.choice([2, 2.3, 3.1]))))
        cases.append(power([0, 1, 1], rng.randrange(60, 200)) + power([1, 0, 1], rng.randrange(60, 200)) + [0] * rng.randrange(90))
    for words in cases:
        assert fast_runs(words) == slow_runs(words)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert fast_runs(b) == slow_runs(b)


def slow_report(doc_id, text, change):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ")
             .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n = len(words)
    if change and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for s, e, q in slow_runs(words)), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, top[1] * 1000 // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), kept


@pytest.mark.parametrize("change", [False, True])
def test_documents(spark, change):
    ship(spark)
    rng = random.Random(5)
    rows = [(i, t if t is None else " ".join(t.split(" ")[:600]), lang, s) for i, t, lang, s in odd_rows()]
    rows += [(200 + n, sentence(rng, rng.randrange(1, 300), 40), "en", "s0") for n in range(60)]
    rows += [(400, " ".join(power(["x", "y", "z"], 40)), "en", "s0"), (401, "same " * 500, None, None)]
    docs = documents(spark, rows, clashing=True)
    assert set(CLASHING) <= set(docs.columns)
    got = periodic.collapsed(docs, periodic.planted if change else None, with_text=True).collect()
    want = [slow_report(i, t, change) for i, t, *_ in rows]
    key = lambda row: str(tuple(row))
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted((w for w, _ in want), key=key)
    assert sorted(r["text"] for r in got) == sorted(k for _, k in want)
    if change:
        assert sum(r["n_runs"] > 0 for r in got) > 5


def test_very_long_text_of_one_word_and_of_shifted_pairs(spark):
    """Work stays near the length of the text where every gram repeats."""
    assert fast_runs([0] * 200_000) == [(0, 200_000, 1)]
    words = [0, 1] * 20_000 + [0] + [0, 1] * 20_000
    found = fast_runs(words)
    assert found[0][0] == 0 and len(found) > 9_000


def test_empty_table(spark):
    ship(spark)
    docs = documents(spark, odd_rows()).where("false")
    assert periodic.collapsed(docs).count() == 0
