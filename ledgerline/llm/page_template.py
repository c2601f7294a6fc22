"""Main text of web pages, by deducing the template that pages of one host share.

A page is read as tokens: the start of each block element, told apart by its path of names
and classes, and each run of text, told apart by its path and its words. A token's
occurrence vector says how often it is on each page of the host. Tokens with equal vectors
are an equivalence class. A class is large and frequent when it has ``CLASS_TOKENS`` tokens
or more and is on at least half of the host's pages; it is valid when its tokens keep one
order on all pages (repeated as often as the class occurs) and when its instances lie within
or beside those of other classes, never across them. The valid classes, nested, are the
template. Text tokens in it are constant; all other runs of text are slots.

No task sees all pages of a host. A vector is held as an exclusive-or of hashes of (page,
count), with the numbers of pages and of occurrences, so vectors are compared from a grouped
aggregate that combines before the shuffle; order and nesting are checked page by page, and
again only aggregates meet. A page meets its host's template by a broadcast of counted size,
or with hot hosts apart.

The main text is what is left of the page: slots in the article, else in the main element,
else in blocks named as content; where no block says so, the slots of template tokens that
hold most of the host's words outside links. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are known by their elements and by words
in class, id and role. Constant text inside the article is taken out as part of the template
only where it is a small part of the article (``CONSTANT_SHARE``); where it is more, the
host's pages are copies of each other, and nothing is taken out.

Defined results: null and empty pages, and pages without text, give an empty text; pages
without a host are read by themselves; broken markup never fails: an element that is not
closed ends with the one around it, an end without a start is passed over, and an unclosed
script takes the rest of the page; pages of any length are read whole, one at a time;
repeated rows are pages of their own, and exact copies count once where pages are counted;
ties between slots are all kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.skew import split_join
from ledgerline.session import stage

CLASS_TOKENS = 3
#: Distinct pages that a host needs for a template.
LEAST_PAGES = 4
CONSTANT_SHARE = 0.2
#: Largest size of all templates, counted, that is sent to every executor.
BROADCAST_BYTES = 32 * 2**20
#: Without a named article: least share of the best slot's words, largest share of link words.
SLOT_SHARE, LINK_SHARE = 0.1, 0.5

# Element names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby s samp small span "
    "strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES_ITSELF = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SIDE_ELEMENTS = frozenset(
    "aside button canvas datalist dialog footer form head header menu nav object select svg template video audio".split())

# Words in class, id and role that name a part of a page.
SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts aside banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion recommended related respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())

ARTICLE, MAIN, NAMED, PLAIN, SIDE = 3, 2, 1, 0, -1

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)(?:>|\Z)", re.S)
_MARKS = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Run:
    """A run of text in one block: its place among the page's tokens, words in all and in
    links, the level of the part it is in, and the start tag that it follows inside."""

    place: int
    text: str
    words: int
    links: int
    level: int
    inside: int


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _level(name: str, more: str, level: int) -> int:
    """The level inside an element, from that of the element around it."""
    if level == SIDE:
        return SIDE
    if name in SIDE_ELEMENTS:
        return level if name == "header" and level >= NAMED else SIDE
    found = {kind.lower(): (a or b or c).lower() for kind, a, b, c in _MARKS.findall(more)} if more else {}
    if name in ("html", "body"):
        return level
    if name == "article" or name == "main" or found.get("role") in ("main", "article"):
        named = MAIN if name == "main" or found.get("role") == "main" else ARTICLE
    else:
        named = PLAIN
    for mark in (m for kind in ("class", "id", "role", "itemprop") for m in found.get(kind, "").split()):
        parts = [p for p in _SPLIT.split(mark) if p]
        if not parts or parts[0] in ("has", "with", "no", "without"):
            continue
        side = {parts[0], parts[-1]} & SIDE_WORDS
        if side and not (level >= NAMED and side == {"header"}) and (named == PLAIN or side & {"comment", "comments"}):
            return SIDE
        if parts[0] in CONTENT_WORDS or parts[-1] in CONTENT_WORDS:
            named = max(named, NAMED)
    return max(level, named)


def parse(page: str) -> tuple[list[int], list[Run]]:
    """Tokens of a page, as signed 64-bit numbers in order, and its runs of text."""
    tokens: list[int] = []
    runs: list[Run] = []
    stack: list[tuple[str, int, int]] = [("", 0, PLAIN)]  # name, path, level
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            words = "".join(pieces).split()
            if words:
                text, (_, path, level) = " ".join(words), stack[-1]
                runs.append(Run(len(tokens), text, len(words), min(links, len(words)), level, _signed(path)))
                tokens.append(_signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), path)))
            pieces.clear()
        links = 0

    def close(names: set[str], within: set[str]) -> None:
        """End the innermost open element of ``names``, not looking beyond ``within``."""
        for n in range(len(stack) - 1, 0, -1):
            if stack[n][0] in names:
                flush()
                del stack[n:]
                return
            if stack[n][0] in within:
                return

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if linked:
                links += len(text.split())

    at = 0
    while True:
        found = _MARKUP.search(page, at)
        add(page[at:found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        more = found["more"] if found["name"] else found["more2"]
        if found["end"] or found["end2"]:
            if name == "a":
                linked = max(linked - 1, 0)
            elif name == "p" or name not in INLINE and name not in VOID:
                close({name}, set() if name != "p" else {"article", "body", "main", "section", "div", "td", "li", "blockquote"})
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in INLINE:
            linked += name == "a"
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        linked = 0
        if name in CLOSES_PARAGRAPH:
            close({"p"}, {"article", "body", "main", "section", "div", "td", "th", "li", "dd", "blockquote", "button"})
        if name in CLOSES_ITSELF:
            close(*CLOSES_ITSELF[name])
        if more.rstrip().endswith("/") and name in ("svg", "path", "circle", "rect", "use", "g", "line", "polygon"):
            continue
        kinds = " ".join(sorted(m for _, a, b, c in _MARKS.findall(more) for m in (a or b or c).split())) if more else ""
        path = xxhash.xxh64_intdigest(f"{name} {kinds}".encode("utf-8", "surrogatepass"), stack[-1][1])
        stack.append((name, path, _level(name, more, stack[-1][2])))
        tokens.append(_signed(path))
    flush()
    return tokens, runs


def _with_host(df: DataFrame, per_host: DataFrame, tokens: Column, how: str = "inner") -> DataFrame:
    """``df`` with the row of its host from a stored table; ``tokens`` says how many numbers
    a row of that table holds."""
    held = per_host.agg(F.sum(tokens * 8 + F.octet_length("host") + 64).alias("bytes")).first()["bytes"] or 0
    if held <= BROADCAST_BYTES:
        return df.join(F.broadcast(per_host), "host", how)
    return split_join(df, per_host, ["host"], how)


# --- skeletons --------------------------------------------------------------------

_SKELETON = ("host string, page long, tokens array<long>, places array<int>, words array<int>, links array<int>, "
             "levels array<int>, inside array<long>")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.strip().split()[0] for f in _SKELETON.split(",")]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            tokens, runs = parse(page or "")
            row = (host, _signed(xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"))), tokens,
                   *([getattr(r, n) for r in runs] for n in ("place", "words", "links", "level", "inside")))
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def skeletons(pages: DataFrame) -> DataFrame:
    """Per page with a host: its tokens and the figures of its runs, without texts."""
    return pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''").mapInArrow(_skeletons, _SKELETON)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of occurrence vectors, combined for the pages of a batch."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0])
        for host, page, tokens in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "tokens"))):
            seed = page & (1 << 64) - 1
            marks: dict[int, int] = {}
            for token, n in Counter(tokens).items():
                if n not in marks:
                    marks[n] = _signed(xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed))
                entry = sums[host, token]
                entry[0] += 1
                entry[1] += n
                entry[2] ^= marks[n]
        hosts, tokens = zip(*sums) if sums else ((), ())
        values = zip(*sums.values()) if sums else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), *[pa.array(v, pa.int64()) for v in values]],
            names=["host", "token", "pages", "total", "vector"])


def large_classes(found: DataFrame) -> DataFrame:
    """Tokens of large and frequent equivalence classes: ``host, class, tokens``."""
    hosts = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("distinct_pages")) \
        .where(F.col("distinct_pages") >= LEAST_PAGES)
    rows = found.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    sizes = stage(hosts.join(rows, "host"), "host-sizes")
    vectors = found.mapInArrow(_vectors, "host string, token long, pages long, total long, vector long") \
        .groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"))
    frequent = _with_host(vectors, sizes, F.lit(2)).where(F.col("pages") * 2 >= F.col("host_pages"))
    return frequent.groupBy("host", F.xxhash64("pages", "total", "vector").alias("class")) \
        .agg(F.sort_array(F.collect_list("token")).alias("members")).where(F.size("members") >= CLASS_TOKENS)


# --- order and nesting ------------------------------------------------------------

def _instances(tokens: list[int], owner: dict[int, int], sizes: dict[int, int]) -> dict[int, tuple[bool, int]]:
    """Per class on the page: whether its tokens are whole repetitions of one order and its
    instances are nested, and a hash of that order."""
    order: dict[int, list[int]] = defaultdict(list)
    sound: dict[int, bool] = defaultdict(lambda: True)
    still: list[list[int]] = []  # open instances: class, tokens to come
    for token in tokens:
        kind = owner.get(token)
        if kind is None:
            continue
        place, size = len(order[kind]), sizes[kind]
        order[kind].append(token)
        if place >= size and order[kind][place % size] != token:
            sound[kind] = False
        if place % size == 0:
            if size > 1:
                still.append([kind, size - 1])
            continue
        while still and still[-1][0] != kind:  # opened later and not complete: it lies across
            sound[still.pop()[0]] = False
        if still:
            still[-1][1] -= 1
            if still[-1][1] == 0:
                still.pop()
    result = {}
    for kind, seen in order.items():
        size = sizes[kind]
        whole = len(seen) % size == 0 and len(set(seen[:size])) == size
        first = np.array(seen[:size], np.int64).tobytes()
        result[kind] = (sound[kind] and whole, _signed(xxhash.xxh64_intdigest(first)))
    return result


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "class", "sound", "low", "high"]
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        columns = (batch.column(c).to_pylist() for c in ("host", "tokens", "classes"))
        for host, tokens, classes in zip(*columns):
            owner = {t: c["class"] for c in classes for t in c["members"]}
            sizes = {c["class"]: len(c["members"]) for c in classes}
            for kind, (sound, order) in _instances(tokens, owner, sizes).items():
                entry = sums.setdefault((host, kind), [True, order, order])
                entry[0], entry[1], entry[2] = entry[0] and sound, min(entry[1], order), max(entry[2], order)
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        rows = [(*key, *value) for key, value in sums.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * 5, kinds)], names=names)


def _slot_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per slot of a host: ``inside`` is the start tag that its runs follow, or 0 for
    all named parts; ``constant`` words are those of template text."""
    names = ["host", "inside", "words", "links", "constant"]
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0])
        columns = (batch.column(c).to_pylist() for c in ("host", "tokens", "places", "words", "links", "levels", "inside", "known"))
        for host, tokens, places, words, links, levels, inside, known in zip(*columns):
            known = set(known)
            for place, n, in_links, level, tag in zip(places, words, links, levels, inside):
                if level == SIDE:
                    continue
                entry = sums[host, tag if level == PLAIN else 0]
                if tokens[place] in known:
                    entry[2] += n
                else:
                    entry[0] += n
                    entry[1] += in_links
        rows = [(*key, *value) for key, value in sums.items()]
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * 5, kinds)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """One row per host with a template: ``host``, ``known`` (its tokens), ``slots`` (start
    tags whose slots hold the main text of pages without a named one) and
    ``drop_constant`` (whether constant text in named parts is template)."""
    found = stage(skeletons(pages), "skeletons")
    classes = stage(large_classes(found), "classes")
    per_host = stage(classes.groupBy("host").agg(F.collect_list(F.struct("class", "members")).alias("classes")), "by-host")
    judged = _with_host(
        found.select("host", "tokens"), per_host, F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["members"]))).mapInArrow(
        _judged, "host string, class long, sound boolean, low long, high long") \
        .groupBy("host", "class").agg(F.min("sound").alias("sound"), F.min("low").alias("low"), F.max("high").alias("high"))
    valid = stage(
        classes.join(judged.where("sound AND low = high").select("host", "class"), ["host", "class"])
        .groupBy("host").agg(F.flatten(F.collect_list("members")).alias("known")), "valid")
    figures = stage(_with_host(found, valid, F.size("known")).mapInArrow(
        _slot_figures, "host string, inside long, words long, links long, constant long")
        .groupBy("host", "inside").agg(F.sum("words").alias("words"), F.sum("links").alias("links"), F.sum("constant").alias("constant")),
        "slot-figures")
    text = (F.col("inside") != 0) & (F.col("links") <= LINK_SHARE * F.col("words")) & (F.col("words") > 0)
    best = figures.groupBy("host").agg(
        F.max(F.when(text, F.col("words"))).alias("best"),
        F.max(F.when(F.col("inside") == 0, F.col("constant") <= CONSTANT_SHARE * (F.col("words") + F.col("constant")))).alias("drop_constant"))
    slots = figures.join(best, "host").groupBy("host").agg(
        F.max("drop_constant").alias("drop_constant"),
        F.collect_list(F.when(text & (F.col("words") >= SLOT_SHARE * F.col("best")), F.col("inside"))).alias("slots"))
    return stage(valid.join(slots, "host", "left"), "templates")


# --- extraction -------------------------------------------------------------------

def main_text(page: str | None, known: set[int], slots: set[int] | None, drop_constant: bool) -> str:
    """The main text of a page under its host's template; without one, ``slots`` is None."""
    tokens, runs = parse(page or "")
    runs = [r for r in runs if r.level != SIDE]
    level = max((r.level for r in runs), default=PLAIN)
    if level != PLAIN:
        kept = [r for r in runs if r.level == level and not (drop_constant and tokens[r.place] in known)]
    elif slots is None:
        kept = [r for r in runs if r.links <= LINK_SHARE * r.words]
    else:
        kept = [r for r in runs if r.inside in slots and tokens[r.place] not in known]
    return " ".join(r.text for r in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html)``."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = _with_host(own, templates(pages), F.size("known") + F.coalesce(F.size("slots"), F.lit(0)), "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for batch in batches:
            found = []
            columns = (batch.column(c) for c in ("host", "html", "known", "slots", "drop_constant"))
            for host, page, known, slots, drop in zip(*columns):
                host = host.as_py()
                if host not in seen:
                    if len(seen) > 256:
                        seen.clear()
                    seen[host] = (set(known.as_py() or ()), None if slots.as_py() is None else set(slots.as_py()), bool(drop.as_py()))
                found.append(main_text(page.as_py(), *seen[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "known", "slots", "drop_constant").mapInArrow(
        texts, f"page_id {kind}, url string, text string, n_chars long")
