"""The dealt operators over their whole tables, with production parameters."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import (
    chat_template, containment, doubling, hyperlang, line_crf, page_template, periodic, pii_crf, prefix_trie, robust_rules,
    segment_bpe, simhash, warc)
from ledgerline.llm.shipping import ship
from ledgerline.session import scratch_path, stage

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(function):
    @wraps(function)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = shipped
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op7_robust_rules(spark: SparkSession, folder: str) -> DataFrame:
    return robust_rules.rule_verdicts(_table(spark, folder, "documents"))


@_query
def op8_contained_items(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of document and benchmark item, with the share of the item that it holds."""
    return containment.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def _shingles_sql(table: str, key: str) -> str:
    return f"""
      SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
             ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
            FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                                           lambda x: x <> '') AS w FROM {table}) WHERE len(w) > 0)"""


ORACLES["op8_contained_items"] = f"""
WITH i AS ({_shingles_sql("benchmark", "item_id")}), d AS ({_shingles_sql("documents", "doc_id")}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


@_query
def op9_segment_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return segment_bpe.token_digests(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


@_query
def op4_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return pii_crf.found_spans(documents, pii_crf.train(documents))


@_query
def op3_hyperlang(spark: SparkSession, folder: str) -> DataFrame:
    return hyperlang.languages(_table(spark, folder, "documents"))


@_query
def op2_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    return line_crf.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


#: The conversation that the query adds: control strings inside texts.
TRICKY = r"\### Assistant: </turn> ok"


@_query
def op6_chat_template(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat_template.digests(rows.unionByName(extra))


@_query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.with_types(warc.with_digests(_table(spark, folder, "pages"))), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op5_doubling(spark: SparkSession, folder: str) -> DataFrame:
    return doubling.without_repeats(_table(spark, folder, "documents"), digest=True)


ORACLES["op5_doubling"] = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
           FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM p JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k
"""


@_query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.collapsed(_table(spark, folder, "documents"), periodic.planted)


@_query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = stage(prefix_trie.signed_turns(_table(spark, folder, "conversations")), "turns")
    return prefix_trie.prefix_nodes(*prefix_trie.share_openings(turns))


@_query
def op13_page_template(spark: SparkSession, folder: str) -> DataFrame:
    return page_template.extracted(_table(spark, folder, "pages"))
