"""Benchmark decontamination by size-partitioned MinHash containment search.

Native: DataFrame expressions only. Items and documents are sets of five-word
shingles, ordered by a 64-bit hash. A document contains an item when at least
``threshold`` of the item's shingles are among its own.

Containment against the smaller set cannot be read off a MinHash of fixed length: a
short item is a speck in a long document. So the items are partitioned by size, and
the sketch of an item of n shingles is its bottom ``n - need + 1`` hashes, where
``need`` is the least number that must be shared. A document that shares ``need`` of
them holds at least one hash of the sketch, so no pair is lost. The sketch of a
document is the part of its hashes below the largest sketch hash of all partitions
that it is long enough to contain. Pairs that share a sketch hash are candidates,
and the shingles themselves decide.

Words are the runs of letters and digits of the lower-case text, so changed
punctuation, case and line ends do not hide a passage.

Defined results: null and empty texts have no shingle and never match; a text of one
to four words has one shingle, the whole of it; items with equal texts are reported
each; rows that share a doc_id are judged one by one and reported once with the
largest share; null ids are ids like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.session import stage

WORDS = 5
THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingled(words: str, combine) -> Column:
    """``combine`` of each run of five words, or of the whole of a shorter text."""
    size = F.size(words)
    runs = F.transform(
        F.expr(f"slice({words}, 1, greatest(size({words}) - {WORDS - 1}, 1))"),
        lambda w, i: combine(w, *[F.get(words, i + k) for k in range(1, WORDS)]),
    )
    return F.when(size > 0, runs)


def _hash(*parts: Column) -> Column:
    # A missing fifth word leaves the hash as it is; such texts have one shingle.
    return F.xxhash64(*parts)


def _join(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Stored tables: items with their shingles, and one row per sketch hash."""
    worded = items.select("item_id", _words(F.col("text")).alias("w"))
    shingled = worded.select(
        "item_id",
        F.array_distinct(_shingled("w", _join)).alias("shingles"),
        F.array_sort(F.array_distinct(_shingled("w", _hash))).alias("hashes"),
    ).where("shingles is not null")
    sized = stage(shingled.withColumns({
        "n": F.size("shingles"),
        "need": F.ceil(F.size("shingles") * F.lit(threshold) - 1e-9).cast("int"),
        "part": F.floor(F.log2(F.size("shingles"))).cast("int"),
    }), "items")
    sketch = sized.select(
        "item_id", "need", "part",
        F.explode(F.expr("slice(hashes, 1, n - need + 1)")).alias("h"),
    )
    return sized, stage(sketch, "item-sketches")


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` that share a sketch hash."""
    # One row per size partition: at most 31, as sizes are partitioned by powers of two.
    parts = sketch.groupBy("part").agg(F.max("h").alias("top"), F.min("need").alias("least")).collect()
    bound = F.greatest(
        *[F.when(F.size("w") - WORDS + 1 >= F.lit(p["least"]), F.lit(p["top"])) for p in parts],
        *[F.when((F.size("w") > 0) & F.lit(p["least"] <= 1), F.lit(p["top"])) for p in parts],
        F.lit(None).cast("long"), F.lit(None).cast("long"),
    )
    hashed = (
        docs.select("doc_id", _words(F.col("text")).alias("w"))
        .select("doc_id", F.size("w").alias("size"), bound.alias("bound"), _shingled("w", _hash).alias("hashes"))
    )
    own = hashed.select(
        "doc_id", "size", F.explode(F.filter("hashes", lambda h: h <= F.col("bound"))).alias("h"))
    met = own.join(sketch.select("h", "item_id", "need"), "h") \
        .where(F.greatest(F.col("size") - WORDS + 1, F.lit(1)) >= F.col("need"))
    return met.select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``(doc_id, item_id, n_shingles, n_shared, containment)`` at or over the threshold."""
    sized, sketch = sketches(items, threshold)
    found = stage(candidates(docs, sketch), "leak-candidates") \
        .select(F.col("doc_id").alias("c_doc"), F.col("item_id").alias("c_item"))
    pairs = (
        docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("c_doc")))
        .join(sized.select(F.col("item_id"), "shingles", "n", "need"), F.col("c_item").eqNullSafe(F.col("item_id")))
        .withColumn("w", _words(F.col("text")))
        .withColumn("n_shared", F.size(F.array_intersect("shingles", _shingled("w", _join))).cast("long"))
    )
    # The threshold is asked of the aggregate: asked before, it would be pushed below the
    # projections, and texts would be split once more for it.
    best = pairs.groupBy("doc_id", "item_id", "n", "need").agg(F.max("n_shared").alias("n_shared")) \
        .where("n_shared >= need")
    return best.select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item; own columns only."""
    leaks = stage(contained_items(docs, items, threshold).select(F.col("doc_id").alias("leak_doc")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_doc"]), "left_anti")
