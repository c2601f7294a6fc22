"""SimHash near-duplicates, doubling and containment against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerline.llm import components, containment, doubling, simhash
from ledgerline.llm.shipping import ship
from llm_frames import documents, odd_rows, sentence


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- SimHash ----------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
             .split(" ") if w]
    if not words:
        return 0
    runs = [words] if len(words) < 4 else [words[i:i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                parent[top(a)] = top(b)
    groups = defaultdict(list)
    for n in range(len(rows)):
        groups[top(n)].append(rows[n][0])
    first = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [(rows[n][0], prints[n], first[top(n)]) for n in range(len(rows))]


def near_rows(seed):
    rng = random.Random(seed)
    base = [sentence(rng, 300).split() for _ in range(4)]
    rows = []
    for n in range(60):
        words = list(base[n % 4])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(300)] = "changed"
        rows.append((200 + n, " ".join(words), "en", "s"))
    return rows


@pytest.mark.parametrize("chunk", [2, 256])
def test_components_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = odd_rows() + near_rows(2)
    got = [(r[0], r[1] % 2**64, r[2]) for r in simhash.near_duplicates(documents(spark, rows, clashing=True)).collect()]
    assert sorted(got, key=str) == sorted(slow_components(rows), key=str)
    assert len({g[2] for g in got}) < len(rows)


def test_any_number_of_blocks_finds_all_links():
    rng = random.Random(4)
    for blocks in (5, 6, 7, 8, 16):
        masks = simhash.masks(blocks)
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(change & m % 2**64 == 0 for m in masks)


def test_forest_connects_what_links_connect():
    rng = random.Random(6)
    prints = np.array([sum(1 << b for b in rng.sample(range(9), 4)) for _ in range(60)], dtype=np.uint64)
    edges = simhash._forest(prints, 2)
    assert len(edges) < len(prints)
    assert all(bin(int(prints[a] ^ prints[b])).count("1") <= 2 for a, b in edges)


def test_one_document_of_each_component_stays(spark):
    rows = odd_rows() + near_rows(3)
    docs = documents(spark, rows, clashing=True)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {(i, p): c for i, p, c in slow_components(rows)}
    got = [(r["doc_id"], slow_fingerprint(r["text"])) for r in kept.collect()]
    assert all(groups[key] == key[0] for key in got)
    assert len(got) == len({c for c in groups.values()})


@pytest.mark.parametrize("order", ["random", "descending", "zero first"])
def test_long_chains_of_links_need_few_rounds(spark, monkeypatch, order):
    size = 10_000
    path = list(range(size))
    if order == "random":
        random.Random(3).shuffle(path)
    else:
        path = [0, *range(size - 1, 0, -1)] if order == "zero first" else path[::-1]
    staged, stage = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: staged.append(name) or stage(df, name))
    edges = spark.createDataFrame([*zip(path, path[1:]), (size, size + 1), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.smallest_reachable(edges).collect()}
    assert roots == {**{n: 0 for n in range(size)}, size: size, size + 1: size}
    assert staged.count("hooked") <= 27  # 2 log2(size)


def test_columns_of_any_name_stay(spark):
    docs = documents(spark, [(1, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (2, "x y", "en", "s")])
    named = docs.selectExpr("*", "'own' AS sim_text_hash", "7 AS `n.chars`", "8 AS copies", "9 AS win_id")
    kept = simhash.keep_first(named)
    assert kept.columns == named.columns
    assert sorted((r["doc_id"], r["sim_text_hash"], r["n.chars"], r["copies"], r["win_id"]) for r in kept.collect()) == [
        (1, "own", 7, 8, 9), (2, "own", 7, 8, 9)]


def test_empty_tables(spark):
    docs = documents(spark, odd_rows()).where("false")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0
    assert doubling.without_repeats(docs).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert containment.contained_items(docs, items).count() == 0
    full = documents(spark, odd_rows())
    assert containment.contained_items(full, items).count() == 0
    assert containment.decontaminate(full, items).count() == len(odd_rows())


# --- doubling ---------------------------------------------------------------------


def slow_removal(rows, window):
    place = lambda i: doubling.NO_ID if i is None else i
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, words in texts:
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            first[key] = min(first.get(key, place(i)), place(i))
    out = []
    for i, words in texts:
        gone = {b for a in range(len(words) - window + 1) if first[tuple(words[a:a + window])] < place(i)
                for b in range(a, a + window)}
        out.append((i, len(words), len(gone), b" ".join(w for n, w in enumerate(words) if n not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, vocabulary, fan", [(13, 10, 256), (30, 10, 256), (5, 3, 256), (9, 2, 256), (13, 10, 3), (30, 4, 4)])
def test_removal_is_that_of_all_windows(spark, monkeypatch, window, vocabulary, fan):
    monkeypatch.setattr(doubling, "CHUNK_CHARACTERS", 700)
    monkeypatch.setattr(doubling, "FAN", fan)  # a small one takes hops to the 16 buckets
    rng = random.Random(window)
    shared = [sentence(rng, rng.randrange(3, 70), vocabulary) for _ in range(10)]
    rows = odd_rows() + [
        (500 + n, " ".join(rng.choice(shared) if rng.random() < 0.6 else sentence(rng, rng.randrange(1, 40), vocabulary)
                           for _ in range(rng.randrange(5))), "en", "s") for n in range(50)]
    got = doubling.without_repeats(documents(spark, rows, clashing=True), window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_removal(rows, window)


def test_ladder():
    assert doubling.ladder(13) == [7, 13]
    assert doubling.ladder(50) == [7, 13, 25, 50]
    assert doubling.ladder(5) == [3, 5]


def test_routes_reach_any_number_of_buckets():
    assert doubling.routes(16) == [(16, 1)] and doubling.routes(256) == [(256, 1)]
    for buckets in (257, 1_600, 30_000, 65_537, 2_500_000, 16_000_000):
        steps = doubling.routes(buckets)
        assert steps[-1] == (buckets, 1) and len(steps) <= 3
        assert all(buckets <= ranges * salts < 1.3 * buckets + ranges for ranges, salts in steps)
        fans = [b[0] / a[0] for a, b in zip([(1, 0), *steps], steps)]
        assert max(fans) <= doubling.FAN + 1


def test_a_chunk_sends_few_rows_however_many_buckets(spark):
    rng = random.Random(8)
    rows = [(n, sentence(rng, 4_000, 5_000), "en", "s") for n in range(12)]
    texts = documents(spark, rows).selectExpr("doc_id AS id", "xxhash64(text) AS text_hash", "text").repartition(4, "id")

    def entries(buckets):
        step = doubling.routes(buckets)[0]
        sent = texts.mapInArrow(doubling._sender([7, 13], 0, step), doubling._ROW_SQL).where("text_hash IS NULL")
        return sent.count(), step[0]

    for buckets in (16, 1_600, 160_000):
        count, ranges = entries(buckets)
        assert count <= 4 * ranges and ranges <= doubling.FAN + 1
    # Hops leave the rows whole: each name of a level ends in one bucket.
    whole = {b: doubling.sent_rows(texts, [7, 13], 0, b).where("text_hash IS NULL") for b in (16, 1_600)}
    names = {b: sorted(n for r in w.collect() for n in np.cumsum(doubling.unpack(r["blob"])[0], dtype=np.uint64).tolist())
             for b, w in whole.items()}
    assert names[16] and sorted(set(names[16])) == sorted(set(names[1_600]))
    assert len(names[1_600]) <= len(names[16])


def test_digest_is_that_of_the_kept_words(spark):
    docs = documents(spark, odd_rows())
    plain = {(r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in doubling.without_repeats(docs).collect()}
    assert {tuple(r) for r in doubling.without_repeats(docs, digest=True).collect()} == plain


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint64) * 10**18, np.zeros(0, dtype=np.uint64), np.array([7], dtype="<u4")]
    assert [a.tolist() for a in doubling.unpack(doubling.pack(*arrays))] == [a.tolist() for a in arrays]


# --- containment ------------------------------------------------------------------


def slow_shingles(text):
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return set()
    return {" ".join(words)} if len(words) < 5 else {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}


def test_containment_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    items = [(n, sentence(rng, rng.randrange(5, 60))) for n in range(20)]
    items += [(50, None), (51, ""), (52, "only three words"), (53, items[0][1]), (None, items[1][1])]
    rows = odd_rows()
    for n in range(60):
        words = rng.choice(items[:20])[1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "other"
        text = f"{sentence(rng, 200)} {' '.join(words).title()}! {sentence(rng, rng.randrange(400))}"
        rows.append((700 + n, text, "en", "s"))
    rows.append((800, "Only, three WORDS", "en", "s"))
    want = set()
    for i, text, *_ in rows:
        own = slow_shingles(text)
        for item, passage in items:
            need = slow_shingles(passage)
            if need and 10 * len(need & own) >= 8 * len(need):
                want.add((i, item, len(need), len(need & own)))
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, clashing=True)
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"])
           for r in containment.contained_items(docs, frame).collect()}
    assert got == want and len(want) > 20
    clean = containment.decontaminate(docs, frame)
    leaks = {i for i, *_ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, *_ in rows if i not in leaks)
    assert clean.columns == docs.columns


def test_containment_runs_without_python(spark):
    docs = documents(spark, odd_rows())
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = containment.contained_items(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
