"""Template deduction and main text against occurrence vectors in memory and known articles."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import page_template as pt
from ledgerline.llm.shipping import ship

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def frame(spark, rows):
    clash = {n: F.lit(7) for n in ("host", "page", "tokens", "known", "slots", "class", "members", "text", "n_chars", "drop_constant")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(3)


def texts(spark, rows):
    got = pt.extracted(frame(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return {r["page_id"]: r["text"] for r in rows}


def article_page(rng, broken=False):
    """A page with every kind of other part, and its article."""
    title, *parts = [words(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(2, 7))]
    body = "".join(f"<p>{p.replace(' ', ' <b>', 1) if broken and n == 0 else p}{'<br>' if broken else '</p>'}" for n, p in enumerate(parts))
    links = "".join(f'<li><a href="/{n}">{words(rng, 2)}</a></li>' for n in range(rng.randrange(2, 8)))
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>'
        f'<div id="cookie-notice">We use cookies</div><header><h1>{words(rng, 2)}</h1></header><nav><ul>{links}</ul></nav>'
        f'<div class="main-wrap"><!-- {words(rng, 3)} <article> --><article class="post"><header><h1>{title}</h1></header>{body}'
        f'<div class="ad">{words(rng, 6)}</div><ul class="share"><li>Share</li></ul></article>'
        f'<form><label>Mail</label><input><button>Send</button></form><section class="comments"><article class="comment"><p>{words(rng, 9)}</p></article></section>'
        f'<aside class="sidebar"><p>{words(rng, 30)}</p></aside></div><footer>&copy; x &middot; {words(rng, 4)}</footer>'
        + ("" if broken else "</body></html>")), " ".join([title, *parts])


def plain_page(rng):
    """A page whose content no name tells from the rest."""
    parts = [words(rng, rng.randrange(15, 60)) for _ in range(rng.randrange(1, 6))]
    body = "".join(f"<div>{p}</div>" for p in parts)
    links = "".join(f'<td><a href="/{n}">{words(rng, 2)}</a></td>' for n in range(rng.randrange(2, 5)))
    return (
        f'<html><body><table class="t1"><tr>{links}</tr></table><div class="c7"><h2>Our weekly letter to all of you</h2>{body}'
        f'<p>Thank you for reading this</p></div><div class="c8">{words(rng, 2)}</div></body></html>'), " ".join(parts)


def site_rows(seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for n in range(40):
        page, want[n] = article_page(rng, broken=n % 5 == 0)
        rows.append((n, f"https://News.example.com:80/{n}?x=1", page))
    for n in range(40, 70):
        page, want[n] = plain_page(rng)
        rows.append((n, f"http://user@plain.example.org/{n}", page))
    return rows, want


def test_articles_of_known_pages(spark):
    rows, want = site_rows(1)
    assert texts(spark, rows) == want


def test_classes_are_those_of_occurrence_vectors(spark):
    rows, _ = site_rows(2)
    rows += rows[:3]
    found = pt.skeletons(frame(spark, rows))
    got = {(r["host"], tuple(r["members"])) for r in pt.large_classes(found).collect()}
    pages = defaultdict(list)
    for _, url, page in rows:
        pages["news.example.com" if "News" in url else "plain.example.org"].append(Counter(pt.parse(page)[0]))
    want = set()
    for host, counts in pages.items():
        vectors = defaultdict(list)
        for token in set().union(*counts):
            vector = tuple(c[token] for c in counts)
            if 2 * sum(v > 0 for v in vector) >= len(vector):
                vectors[vector].append(token)
        want |= {(host, tuple(sorted(t))) for t in vectors.values() if len(t) >= pt.CLASS_TOKENS}
    assert got == want and len(got) >= 2


def test_classes_out_of_order_or_across_each_other_are_not_valid():
    sizes, owner = {1: 2, 2: 2, 3: 3}, {10: 1, 11: 1, 20: 2, 21: 2, 30: 3, 31: 3, 32: 3}

    def sound(*tokens):
        return {kind: ok for kind, (ok, _) in pt._instances(list(tokens), owner, sizes).items()}

    assert sound(10, 20, 5, 21, 11) == {1: True, 2: True}
    assert sound(10, 20, 21, 20, 21, 11) == {1: True, 2: True}
    assert sound(10, 11, 11, 10) == {1: False}
    assert sound(30, 31, 32, 30, 32, 31) == {3: False}
    assert sound(10, 20, 11, 21)[2] is False
    first, second = (pt._instances(t, owner, sizes)[1][1] for t in ([10, 11], [11, 10]))
    assert first != second


def test_template_text_in_articles_goes_but_copies_stay(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for n in range(12):
        part = words(rng, 80)
        rows.append((n, f"http://a.example.com/{n}", f"<body><nav><p>x</p></nav><article><p>{part}</p><h4>Filed under news</h4></article></body>"))
        want[n] = part
    long = words(rng, 200)
    for n in range(20, 32):  # near copies
        rows.append((n, f"http://b.example.com/{n}", f"<body><nav><p>x</p></nav><article><p>{long}</p><p>tail {n}</p></article></body>"))
        want[n] = f"{long} tail {n}"
    for n in range(40, 50):  # exact copies
        rows.append((n, f"http://c.example.com/{n}", f"<body><article><p>{long}</p></article></body>"))
        want[n] = long
    assert texts(spark, rows) == want


def test_odd_pages(spark):
    long = "long word " * 300_000
    rows = [
        (1, "http://a.example.com/", None), (2, None, "<article>no host</article>"), (None, "http://a.example.com/", "<article>no id</article>"),
        (4, "nonsense", ""), (5, "http://a.example.com/", "   \n\t "), (6, "http://a.example.com/", "just words &amp; more &am"),
        (7, "http://a.example.com/", "<article>a<b>b</b>c<br>d\n\n e&nbsp;f</div></p></article>"),
        (8, "http://a.example.com/", "<article><p>one<p>two<script>x</article>"), (9, "http://a.example.com/", "<p>x < y <3 and <unclosed"),
        (10, "http://a.example.com/", f"<article><p>{long}</p></article>"), (11, "http://a.example.com/", "<div>" * 20_000 + "deep"),
        (12, "http://a.example.com/", "<!-- never ends <p>x</p>"), (13, "http://a.example.com/", '<article title="a>b"><p class=\'x>y\'>quoted</p></article>'),
        (14, "http://a.example.com/", "<article>\U0001F600 日本 &#x1F600;&lt;p&gt;</article>"), (14, "http://a.example.com/", "<article>again</article>"),
    ]
    got = texts(spark, [r for r in rows if r[2] != "<article>again</article>"])
    assert got[1] == got[4] == got[5] == got[12] == ""
    assert got[2] == "no host" and got[None] == "no id" and got[6] == "just words & more &am"
    assert got[7] == "abbc d e f".replace("abbc", "abc") and got[8] == "one two" and got[10] == long.strip() and got[11] == "deep"
    assert got[9].startswith("x < y <3 and") and got[13] == "quoted" and got[14] == "\U0001F600 日本 \U0001F600<p>"
    assert pt.extracted(frame(spark, rows)).count() == len(rows)


def test_empty_table(spark):
    assert pt.extracted(frame(spark, site_rows(1)[0]).where("false")).count() == 0
