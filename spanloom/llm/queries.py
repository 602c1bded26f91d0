"""The registered queries: each operator over its whole table with production parameters, and its SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, exact_dedup, filter_audit, fingerprints, lm_scoring, near_dedup, packing, quality, secret_scan, suffix_dedup, token_counts, warc
from .common import ship

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary that the contracts of operators 7 and 9 name.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The model that the contract of operator 12 names.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with corpus-wide ownership (owner: source; repository: source and language)."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op2_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that occur elsewhere too."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail chances of every document, fitted on the ratings of ``labels``."""
    return quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document and its number of links."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query
def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op8_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document."""
    return exact_dedup.dedup_map(table(spark, sf_dir, "documents"))


ORACLES["op8_cuckoo_dedup"] = r"""
WITH n AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept,
       text_sha256
FROM n
"""


@query
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by the weighted context tree, and the unigram base."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at every step of all 120 orders, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), f AS (
    SELECT part, doc_id,
           (len(w) < 50)::INT * 16
           + (100 * len(list_distinct(w)) < 65 * len(w))::INT * 8
           + (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT * 4
           + regexp_matches(t, '[#$%&*|]')::INT * 2
           + coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS fails
    FROM d
), l AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
    SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(toxic), 0) AS x
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), e AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([16, 8, 4, 2, 1]) AS bit
), o AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM e a, e b, e c, e d, e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
    SELECT filter_order, k AS step, e.bit AS own,
           coalesce((SELECT sum(b.bit) FROM e b WHERE instr(filter_order, b.letter) < k), 0)::INT AS before
    FROM o, range(1, 6) r(k), e WHERE e.letter = substr(filter_order, k, 1)
), m AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (fails & (before | own) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (fails & before = 0 AND fails & own <> 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (fails & before <> 0 AND fails & own <> 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(g) FILTER (fails & before = 0 AND fails & own <> 0), 0)::BIGINT AS good_lost,
           coalesce(sum(x) FILTER (fails & before = 0 AND fails & own <> 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM m
"""


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_conversation_trie"] = r"""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(k, range(8)), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS tbl
    FROM range(256) r(k)
), t AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS seq
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
    SELECT conv_id, seq,
           xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
                           lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
    FROM t, crc
), c AS (
    SELECT h.conv_id, list_concat(coalesce(b.seq[1:h], []), h.seq[h + 1:]) AS seq
    FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100
), m AS (
    SELECT conv_id, d, seq[1:d] AS prefix, len(seq) AS n FROM c, unnest(range(0, len(seq) + 1)) u(d)
), nodes AS (
    SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
    FROM m GROUP BY prefix, d
), kids AS (
    SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children,
           CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[d].text) END AS saved
    FROM nodes LEFT JOIN kids USING (prefix)
), below AS (
    SELECT prefix[1:k] AS prefix, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM full_nodes, unnest(range(0, d + 1)) u(k) GROUP BY 1
)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_nodes x JOIN below USING (prefix)
LEFT JOIN nodes p ON p.prefix = x.prefix[1:x.d - 1] AND x.d > 0
"""
