"""WARC archives and chat templates."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st

from ledgerline.llm import chat_template as chat, queries, warc
from ledgerline.llm.shipping import ship
from llm_frames import collected


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- WARC -------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/\r\n5", "two\r\n\r\nWARC/1.1\r\n\r\n"), (6, "x", "é" * 300_000), (7, "x", "é" * 300_000),
    (None, "n", "<p>one</p>"), (None, "m", "only here"), (None, "m", "only here"), (2, "again", "<p>one</p>"), (1, "tie", "<p>one</p>"),
]


def slow_records(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = first.get(html or "")
        revisit = own is not None and own != i
        out.append((i, len(payload), digest, "revisit" if revisit else "response", own if revisit else None))
    return sorted(out, key=lambda t: [(v is not None, str(v)) for v in t])


@pytest.mark.parametrize("rows", [0, 50_000])
def test_archives_come_back(spark, folder, monkeypatch, rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", warc.F.lit(1))
    warc.write_archives(warc.with_types(warc.with_digests(pages.repartition(3))), f"{folder}/w")
    back = warc.read_archives(spark, f"{folder}/w")
    assert collected(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == slow_records(PAGES)
    whole = warc.resolved(back)
    assert sorted((str(r["page_id"]), bytes(r["payload"]).decode()) for r in whole.collect()) \
        == sorted((str(i), html or "") for i, _, html in PAGES)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder, "w").glob("part-*"))
    assert text.count("é".encode() * 300_000) == 1 and text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    typed = warc.with_types(warc.with_digests(pages), min_bytes=11).collect()
    assert {r["page_id"] for r in typed if r["record_type"] == "revisit"} == {7}


def test_no_pages(spark, folder):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.with_types(warc.with_digests(pages)), f"{folder}/w")
    assert warc.read_archives(spark, f"{folder}/w").count() == 0


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(warc.records_of(memoryview(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))))
    with pytest.raises(ValueError):
        list(warc.records_of(memoryview(gzip.compress(b"no header"))))


# --- chat -------------------------------------------------------------------------

PARTS = ["\\", "#", "##", "###", "</turn>", " </turn>\n", "<", ": ", "\n", "### assistant: ", " ", "é", "\U0001F600"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "", "### x: "]),
                          st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), max_size=5))
def test_turns_come_back(turns):
    template = chat.Template(chat.TEMPLATE)
    messages = [{"role": r, "text": t} for r, t in turns]
    back = list(chat.read_turns(template.pieces(messages=iter(messages))))
    assert [(r, t) for r, t, _, _ in back] == turns
    whole, spans = template.render(messages=messages)
    said = "".join(t for r, t in turns if r == "assistant")
    assert "".join(chat.unescape(whole[a:b]) for a, b in spans) == said == "".join(x for b in back for x in b[2])


def test_language():
    source = ("{% set a = 1 + 2 * 3 %}{{ a }}{% if a > 9 %}x{% elif a == 7 and not false %}y{% else %}z{% endif %}"
              "{# note #}{{ 'q' | upper ~ \"w\" }}{% for x in xs %}{{ x.n }}{{ '' if loop.last else ', ' }}{% endfor %}"
              "{{ m['k'] }}{{ none }}{% generation %}{{ 7 // 2 }}{% endgeneration %}")
    assert chat.Template(source).render(xs=iter([{"n": 1}, {"n": 2}]), m={"k": "v"}) == ("7yQw1, 2v3", [(9, 10)])


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}no{% else %}d{% endif %}{{ x }}"))
    assert tree == (chat.Emit(chat.Const("abcd")), chat.Emit(chat.Name("x")))


@pytest.mark.parametrize("source", [
    "{{ x() }}", "{{ x | nothing }}", "{% if x %}", "{{ 1 + }}", "{% import os %}", "{{ x.y", "{% for x y %}{% endfor %}",
    "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "{{ " + "not " * 100 + "1 }}", "{{ x.__class__ }}", "{{ 'a' * 99 }}"])
def test_the_sandbox_holds(source):
    if source == "{{ x.y":
        assert chat.Template(source).render(x={}) == (source, [])
        return
    with pytest.raises(chat.TemplateError):
        chat.Template(source).render(x="text")


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello ### </turn>"), (2, 1, "assistant", "b"), (2, 0, "system", None),
    (3, None, "user", "no turn"), (3, 0, None, "no role"), (None, 0, "user", "x"), (4, 0, "user", ""), (4, 0, "user", ""),
    (5, 0, "assistant", "long " * 50_000), (-7, 0, "user", queries.TRICKY), (-7, 1, "assistant", queries.TRICKY),
]


def test_digests_of_conversations(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", warc.F.lit(1))
    want = {}
    key = lambda r: (str(r[0]), *[(v is not None, v if v is not None else 0 if n == 1 else "") for n, v in enumerate(r) if n])
    for conv, _, role, text in sorted(CHATS, key=key):
        want.setdefault(conv, []).append((role or "", text or ""))
    template = chat.Template(chat.TEMPLATE)
    got = {r["conv_id"]: r for r in chat.digests(df.repartition(3)).collect()}
    texts = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert set(got) == set(want) == set(texts)
    for conv, turns in want.items():
        row, whole = got[conv], template.render(messages=[{"role": r, "text": t} for r, t in turns])[0]
        said = "".join(t for r, t in turns if r == "assistant")
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(said)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["formatted_chars"] == len(whole) and texts[conv]["formatted"] == whole
    assert chat.digests(df.where("false")).count() == 0


def test_order_of_turns_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(c, t, "user", f"{c}-{t}") for c in range(20) for t in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(chat.digests(df.repartition(7))) == collected(chat.digests(df.coalesce(1)))
