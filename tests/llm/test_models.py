"""Fields, languages and their held-out accuracy."""

import hashlib
import itertools
import random
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from ledgerline.llm import crf, hyperlang, line_crf, pii_crf
from ledgerline.llm.shipping import ship
from llm_frames import documents, odd_rows

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- fields -----------------------------------------------------------------------


def test_field_against_all_labellings():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 4])
    emissions, trans, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    best = crf.viterbi(emissions, lengths, trans, start)
    marginals, pairs, total = crf.forward_backward(emissions, lengths, trans, start)
    at, want_total, want_pairs = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        if n:
            own = emissions[at:at + n]
            ways = list(itertools.product(range(3), repeat=int(n)))
            score = np.array([start[w[0]] + sum(own[t, x] for t, x in enumerate(w))
                              + sum(trans[a, b] for a, b in zip(w, w[1:])) for w in ways])
            assert tuple(best[at:at + n]) == ways[int(score.argmax())]
            chance = np.exp(score) / np.exp(score).sum()
            want = np.array([[sum(c for c, w in zip(chance, ways) if w[t] == x) for x in range(3)] for t in range(n)])
            assert np.allclose(marginals[at:at + n], want)
            for c, w in zip(chance, ways):
                for a, b in zip(w, w[1:]):
                    want_pairs[a, b] += c
            want_total += np.log(np.exp(score).sum())
        at += n
    assert np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


# --- personal data ----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (2 if n % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_spans(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and slow_luhn(digits):
            spans.append(("card", *m.span()))
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]


PRIVATE = ["a.b+c@x-1.example.com", "10.20.30.255", "4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4.5.6.7.8", "a@b"]


def test_patterns_are_those_of_the_contract():
    rng = random.Random(3)
    letters = "a.@-+ 01925.() z%é\n"
    for _ in range(20_000):
        text = "".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(PRIVATE) for _ in range(rng.randrange(30)))
        assert pii_crf.pattern_spans(text) == slow_spans(text), text


def test_hard_texts_take_linear_time():
    for text in ("1" * 300_000, "a@" * 100_000, "9." * 100_000, "a" * 300_000 + "@", "+1 " * 100_000, "1 " * 50_000):
        pii_crf.pattern_spans(text)
        list(pii_crf.stretches(text))


def private_rows():
    rng = random.Random(7)
    rows = []
    for n in range(400):
        words = ["lorem", "ipsum", "dolor", "sit"] * 20
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(
                [f"u{rng.randrange(99)}@mail.example.com", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
                 f"{rng.randrange(256)}.{rng.randrange(256)}.7.{rng.randrange(256)}", "4111111111111111", "1999", "v2.0"]))
        rows.append((n, " ".join(words), "en", "s"))
    return rows


def test_spans_of_documents(spark):
    rows = odd_rows() + private_rows()
    rows.append((9000, "call (988) 555-2485 now or lorem", "en", "s"))
    docs = documents(spark, rows, clashing=True)
    field = pii_crf.train(docs)
    got = {}
    for r in pii_crf.found_spans(docs, field).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        base = slow_spans(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        match = [r for r in got[i] if r["base_sha256"] == digest]
        assert match and [match[0][f"n_{k}"] for k in pii_crf.KINDS] == [sum(s[0] == k for s in base) for k in pii_crf.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(match[0]["spans"].split(","))
    assert got[9000][0]["spans"] == "phone:5:19"  # the field's own find
    clean = pii_crf.masked(docs, field)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not slow_spans(r["text"] or "")
        assert r["n_chars"] == len(r["text"] or "")


def test_no_digits_no_field(spark):
    docs = documents(spark, [(1, "plain words", "en", "s"), (2, None, None, None)])
    assert [r["spans"] for r in pii_crf.found_spans(docs, pii_crf.train(docs)).collect()] == ["", ""]
    assert pii_crf.masked(docs.where("false")).count() == 0


def test_overlapping_spans_are_masked_once():
    assert pii_crf.mask("ab 1234 cd", [("card", 3, 7), ("phone", 5, 9)]) == "ab <CARD>d"


# --- quality and language ---------------------------------------------------------


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op2_line_crf"](spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r["held_out"] == (crc(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
               for i, r in got.items())
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) > 0.95 * len(held)


def test_language_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op3_hyperlang"](spark, FOLDER).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in got if got[i]["held_out"] and docs[i]["lang"]]
    assert sum(got[i]["lang_pred"] == docs[i]["lang"] for i in held) > 0.97 * len(held)


def test_odd_documents(spark):
    rows = odd_rows()
    docs = documents(spark, rows, clashing=True)
    got = hyperlang.languages(docs).collect()
    assert len(got) == len(rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {100, 101, 102} <= und and not und - {100, 101, 102, None}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (4, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    scored = line_crf.quality_scores(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    nothing = labels.where("false")
    assert {r["score"] for r in line_crf.quality_scores(docs, nothing).collect()} == {0.5}
    assert line_crf.quality_scores(docs.where("false"), nothing).count() == 0
    assert hyperlang.languages(docs.where("false")).count() == 0


def test_profiles_do_not_depend_on_their_company():
    texts = ["abc déf", "日本語の文章です", "", "1 2 3", "Zebra zebra"]
    together = hyperlang.profiles(texts)
    alone = np.concatenate([hyperlang.profiles([t]) for t in texts])
    assert np.allclose(together, alone) and not together[2].any() and not together[3].any()


def slow_profile(text):
    """Binding and bundling letter by letter."""
    found = np.zeros(hyperlang.DIMENSIONS, dtype=int)
    padded = [0] + [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()] + [0]
    for before, letter, after in zip(padded, padded[1:], padded[2:]):
        if letter:
            vectors = [hyperlang.letter_vector(c).astype(int) for c in (before, letter, after)]
            found += np.roll(vectors[0], 2) * np.roll(vectors[1], 1) * vectors[2]
    return found


ODD_TEXTS = ["Häuser, häuser UND 3 Bäume", "日本語 の文章です", "", "12 !", "x", "ab\nab\tab a-b", "Ελληνικά ß ﬁ"]


@pytest.mark.parametrize("cells, block", [(1 << 23, 4096), (0, 4096), (0, 3)])
def test_profiles_are_those_bound_letter_by_letter(monkeypatch, cells, block):
    monkeypatch.setattr(hyperlang, "DENSE_CELLS", cells)
    monkeypatch.setattr(hyperlang, "BLOCK", block)
    assert hyperlang.profiles(ODD_TEXTS).tolist() == [slow_profile(t).tolist() for t in ODD_TEXTS]


def test_languages_are_those_of_slow_prototypes(spark):
    rng = random.Random(4)
    words = {"de": "der und nicht häuser", "fr": "le été garçon est", "ja": "日本語 文章 です"}
    rows = [(n, " ".join(rng.choices(words[lang].split(), k=rng.randrange(3, 30))), lang, "s")
            for n, lang in enumerate(rng.choices(list(words), k=60))]
    rows += [(60 + n, t, None, "s") for n, t in enumerate(ODD_TEXTS)]

    def unit(v):
        return v / (np.linalg.norm(v) or 1.0)

    bundles = {lang: unit(sum(unit(slow_profile(t)) for i, t, own, _ in rows if own == lang and crc(i, 4) != 2))
               for lang in sorted(words)}
    got = {r["doc_id"]: r for r in hyperlang.languages(documents(spark, rows)).collect()}
    for i, text, _, _ in rows:
        own = slow_profile(text)
        cosines = {lang: float(unit(own) @ bundle) for lang, bundle in bundles.items()}
        best = max(cosines, key=cosines.get) if own.any() else "und"
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - min(max(cosines.get(best, 0.0), 0.0), 1.0)) < 1e-4


def test_very_many_sequences_take_little_memory():
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 1000))) for _ in range(400)]
    tracemalloc.start()
    hyperlang.profiles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * 2**20


def test_line_features_do_not_depend_on_their_company():
    texts = ["a b\n\nc!", "", "x x x\nx x x", "\n"]
    table, lines, length = line_crf.line_features(texts)
    assert lines.tolist() == [3, 1, 2, 2]
    alone = [line_crf.line_features([t]) for t in texts]
    assert np.allclose(table, np.concatenate([a[0] for a in alone]))
    assert table[5][8] == 1.0 and table[4][8] == 0.0


def test_a_sample_keeps_its_expected_size_at_any_share(spark):
    from pyspark.sql import functions as F

    rows = spark.range(8_000_000)
    for share in (1e-5, 2.5e-6, 5e-7):
        expected = share * 8_000_000
        chosen = rows.where(hyperlang.sampled(F.lit(share), "id")).count()
        assert abs(chosen - expected) <= 4 * expected ** 0.5
    assert rows.where(hyperlang.sampled(F.lit(1.0), "id")).count() == 8_000_000
    assert rows.where(hyperlang.sampled(F.lit(5e-7), "id")).count() \
        < rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 0.5).count()
