"""Quality rules and byte-level BPE."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from ledgerline.llm import robust_rules, segment_bpe
from ledgerline.llm.shipping import ship
from llm_frames import documents, odd_rows, sentence

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = {p for i, w in enumerate(windows) if seen[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, again = len(words), len(repeated)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again,
            n < 50 or 100 * again > 50 * n)


def test_counts_are_those_of_the_contract(spark):
    rng = random.Random(5)
    rows = odd_rows() + [
        (300 + n, "\n".join(sentence(rng, rng.randrange(6), 4) + rng.choice(["", " #", "\t", "\x0b|", " "])
                            for _ in range(rng.randrange(30))), "en", "s") for n in range(60)]
    got = robust_rules.rule_verdicts(documents(spark, rows, clashing=True)).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted((str(i), *slow_counts(t)) for i, t, *_ in rows)
    assert all(r["kept"] is False for r in got if r["base_failed"])
    assert all(isinstance(r["kept"], bool) for r in got)


JUNK = [lambda t: t.replace(" ", " | "), str.upper, lambda t: re.sub(r"(\w+)", r"\1###", t)]


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    rows = [(n, ". ".join(sentence(rng, 12).capitalize() for _ in range(rng.randrange(8, 30))), ("en", "de")[n % 2],
             None if n % 5 == 0 else "big") for n in range(900)]
    rows += [(5000 + n, JUNK[n % 3](sentence(rng, 150)), "en", "big") for n in range(24)]
    docs = documents(spark, rows)
    kept = {r["doc_id"] for r in robust_rules.rule_verdicts(docs).where("kept").collect()}
    assert kept == set(range(900))
    assert {r["doc_id"] for r in robust_rules.keep_good(docs).collect()} == kept


def test_small_and_empty_tables_reject_no_outliers(spark):
    docs = documents(spark, odd_rows(), clashing=True)
    verdicts = robust_rules.rule_verdicts(docs).collect()
    assert all(r["kept"] is not r["base_failed"] for r in verdicts)
    good = robust_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in verdicts)
    assert robust_rules.rule_verdicts(docs.where("false")).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.45])
@pytest.mark.parametrize("copies", [True, False])
def test_junk_up_to_nearly_half_of_a_group_goes(spark, share, copies):
    rng = random.Random(11)
    good = [(n, ". ".join(sentence(rng, 12).capitalize() for _ in range(rng.randrange(8, 30))), "en", "s")
            for n in range(400)]
    page = JUNK[2](sentence(rng, 150))
    bad = [(5000 + n, page if copies else JUNK[n % 3](sentence(rng, 150)), "en", "s")
           for n in range(int(400 * share / (1 - share)))]
    kept = {r["doc_id"] for r in robust_rules.rule_verdicts(documents(spark, good + bad)).where("kept").collect()}
    assert kept == set(range(400))


def test_junk_in_small_groups_goes(spark):
    rng = random.Random(12)
    page = lambda: ". ".join(sentence(rng, 12).capitalize() for _ in range(rng.randrange(8, 30)))
    rows = [(n, page(), "en", "big") for n in range(400)]
    rows += [(1000 + n, page(), ("en", "fi", None)[n % 3], "rare") for n in range(12)]
    rows += [(5000 + n, JUNK[n // 4](sentence(rng, 150)), ("en", "fi", None, "xx")[n % 4], "rare") for n in range(12)]
    kept = {r["doc_id"] for r in robust_rules.rule_verdicts(documents(spark, rows)).where("kept").collect()}
    assert kept == {*range(400), *range(1000, 1012)}
    few = rows[:20] + rows[-12:-9]
    kept = {r["doc_id"] for r in robust_rules.rule_verdicts(documents(spark, few)).where("kept").collect()}
    assert kept == set(range(20))


def test_rules_run_without_python(spark):
    plan = robust_rules.rule_verdicts(documents(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- BPE --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return segment_bpe.Ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.id_of, special_tokens={})


def encoded(ranks, texts):
    ids, upto = segment_bpe.encode_texts(ranks, texts)
    starts = [0, *upto.tolist()]
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])], segment_bpe.decoded(ranks, ids, upto)


def test_ids_are_those_of_the_library(ranks, library):
    rng = random.Random(3)
    letters = "abst 'lrvedm\n\t !1é9 -日　\x1ć"
    texts = ["", " ", "a  ", "x" * 3000, "ab" * 2000 + "é" * 300, "''s !'s it's'", "\n's", "a'll've'LL"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(4000)]
    ids, back = encoded(ranks, texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(ranks, library, texts):
    ids, back = encoded(ranks, texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_digests(spark, library, monkeypatch):
    monkeypatch.setattr(segment_bpe, "REMEMBERED", 50)
    rows = odd_rows()
    got = segment_bpe.token_digests(documents(spark, rows, clashing=True), PATH).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    real = segment_bpe.encode_documents(documents(spark, rows), PATH).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]), bytes(r["decoded"]).decode()) for r in real) \
        == sorted((str(i), len(library.encode_ordinary(t or "")), t or "") for i, t, *_ in rows)
    assert segment_bpe.token_digests(documents(spark, rows).where("false"), PATH).count() == 0
