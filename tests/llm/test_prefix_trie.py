"""The trie of conversation prefixes against a trie built in memory."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import prefix_trie
from ledgerline.llm.shipping import ship

SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def rebuilt(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        head = conversations.get(c - c % 20, []) if c is not None else []
        out[c] = head[:h] + own[h:]
    return out


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def slow_trie(conversations):
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        yield path
        for child in children.get(path, []):
            yield from below(child)

    def smallest(path):
        return min((c for c in nodes[path] if c is not None), default=None)

    found = []
    for path, members in nodes.items():
        ends = sorted(c for c in members if c is not None and len(conversations[c]) == len(path))
        found.append((
            smallest(path), len(path), smallest(path[:-1]) if path else None, len(members), len(children.get(path, [])),
            sum(p not in children for p in below(path)),
            sum((len(nodes[p]) - 1) * words(p[-1][1]) for p in below(path) if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return found


def by_conversation(rows):
    """Conversations as lists of turns, ties in the order of the operator's digests."""
    def sign(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, sign(role or "", text or ""), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def conversations(seed, size=120, null_id=True):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), size):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, ("user", "assistant")[turn % 2], rng.choice(["hi there", "go  on\n now", "x", f"own {rng.random()}"])))
    copied = [(turn, "user", f"common {turn} words here") for turn in range(6)]
    rows += [(c, *t) for c in range(1000, 1060) for t in copied]
    rows += [(2000, None, None, None), (2000, 1, "user", None), (2001, 1, None, ""), (2001, 1, None, "tie"), (2001, 1, None, "tie"),
             (2003, 5, "user", "long " * 30_000), (2004, 0, "us", "er:x"), (2005, 0, "user", ":x"), (2006, 0, "user", "été 日本")]
    rows += [(2040, turn, "user", f"t{turn}") for turn in range(400)] + [(2041, turn, "user", f"t{turn}") for turn in range(390)]
    if null_id:
        rows += [(None, 0, "user", "hi there"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    clash = {n: F.lit(7) for n in ("place", "sign", "words", "n1", "depth", "node", "single", "of", "leaf", "before")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(3)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_all_prefixes(spark, seed):
    rows = conversations(seed)
    got = prefix_trie.prefix_trie(frame(spark, rows))
    assert ordered(got.collect()) == ordered(slow_trie(by_conversation(rows)))


def test_shared_openings(spark):
    rows = conversations(3)
    turns, members = prefix_trie.share_openings(prefix_trie.signed_turns(frame(spark, rows)))
    got = prefix_trie.prefix_nodes(turns, members)
    want = slow_trie(rebuilt(by_conversation(rows)))
    assert ordered(got.collect()) == ordered(want)
    assert any(n_convs > 1 and depth > 2 for _, depth, _, n_convs, *_ in want)


def test_a_sketch_full_of_collisions_changes_nothing(spark, monkeypatch):
    rows = conversations(4)
    want = ordered(slow_trie(by_conversation(rows)))
    for name, value in (("LEAST_COUNTERS", 2**15), ("MOST_COUNTERS", 2**15), ("SKETCH_ROWS", 1)):
        monkeypatch.setattr(prefix_trie, name, value)
    monkeypatch.setattr(prefix_trie, "_counters", lambda n1, n2, width: iter([n1 & 255]))
    bits = np.full((1, 2**12), 255, np.uint8)
    for counters in (prefix_trie.shared_counters, lambda named: bits):
        monkeypatch.setattr(prefix_trie, "shared_counters", counters)
        assert ordered(prefix_trie.prefix_trie(frame(spark, rows)).collect()) == want


def test_singletons_are_not_shuffled(spark):
    """Of conversations that share nothing, only the root and a few collisions are grouped."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(500) for t in range(8)]
    turns = prefix_trie.signed_turns(frame(spark, rows))
    named = prefix_trie.prefixes(turns, turns.select("conv_id").distinct())
    seen = prefix_trie.screened(named, prefix_trie.shared_counters(named))
    assert seen.where("depth > 0 AND NOT single").count() < 80
    assert seen.where("depth = 0 AND single").count() == 0


def test_ids_that_end_in_one_node_are_joined_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 10)
    ids = list(range(-35, 400, 3))
    random.Random(1).shuffle(ids)
    rows = [(c, 0, "user", "same") for c in ids]
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()}
    joined = ",".join(map(str, sorted(ids)))
    assert got[1]["ends_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert got[1]["saved_tokens"] == len(ids) - 1 and got[0]["n_leaves"] == 1


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(frame(spark, conversations(1)).where("false")).count() == 0
