"""The registered query of each operator, and the twins that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import (
    align,
    bpe,
    chat,
    decontam,
    jaccard,
    langid,
    licenses,
    packing,
    quality,
    secrets,
    sharding,
    tokens,
    trie,
)
from cartulary.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The conversation that every run formats besides the table: control strings inside texts.
_PROBE = r"\### Assistant: </turn> ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontam.find_contaminated(docs, table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("masked")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = langid.held_out(F.col("doc_id"))
    learned = docs.where(~apart & F.col("lang").isNotNull() & F.col("text").isNotNull())
    predicted = langid.predict(docs, langid.train(learned))
    return predicted.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.train(docs))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    probe = spark.createDataFrame(
        [(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], said.schema
    )
    messages = chat.chains(said.unionByName(probe), "conv_id", "turn")
    back = chat.read_back(chat.format_paths(messages))
    conv_id = F.expr("CAST(nullif(tree, '') AS BIGINT)").alias("conv_id")
    return back.select(conv_id, *[x for x in back.columns if x not in ("tree", "leaf")])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality.apply_rules(ids, rules).drop("text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), 4, 85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, ranks, public_tokenizers.PATTERN))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256))
    hashed = aligned.withColumn("groups_sha256", F.coalesce(digest, F.lit(""))).drop("groups")
    return align.with_pair_counts(hashed)


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_counts": op5_token_counts,
        "op6_language_id": op6_language_id,
        "op7_license_scan": op7_license_scan,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_quality_rules": op9_quality_rules,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_alignment": op13_alignment,
    }


def _escapes(column: str, characters: str) -> str:
    """Characters that escaping adds to a column."""
    return " + ".join(f"length({column}) - length(replace({column}, '{x}', ''))" for x in characters)


_CHAT_SQL = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_PROBE}'
    UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'
), turns AS (
    SELECT *, role || chr(10) || text || chr(10) AS whole,
        CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
        length(role) + length(text) + {len(chat.HEAD + chat.MIDDLE + chat.END)}
            + {_escapes("role", "#<:" + chr(92))} + {_escapes("text", "#<" + chr(92))} AS chars
    FROM said
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(whole, '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
    sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_JACCARD_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) >= 4 THEN list_distinct(list_transform(
            range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM split
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
    SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (
    SELECT u, v FROM shared WHERE 100 * k >= 85 * (nu + nv - k)
), reach AS (
    SELECT doc_id AS u, doc_id AS v FROM sets
    UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) ON doc_id = u
"""


# CRC-32 bit by bit, as there is no function for it.
_TRIE_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
    SELECT conv_id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
        sha256(length(role) || ' ' || role || text) AS digest
    FROM said
), own AS (
    SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests,
        list(n_words ORDER BY turn NULLS FIRST, digest) AS counts
    FROM turns GROUP BY conv_id
), held AS (
    SELECT conv_id, digests, counts, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(
            range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(CAST(conv_id AS VARCHAR)[i])::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
        ), 4294967295) % 4 AS h
    FROM own
), rebuilt AS (
    SELECT c.conv_id,
        list_concat(coalesce(r.digests, [])[1:c.h], c.digests[c.h + 1:]) AS digests,
        list_concat(coalesce(r.counts, [])[1:c.h], c.counts[c.h + 1:]) AS counts
    FROM held c LEFT JOIN own r ON r.conv_id = c.conv_id - c.conv_id % 20
), members AS (
    SELECT conv_id, digests, counts, unnest(range(0, len(digests) + 1)) AS d FROM rebuilt
), nodes AS (
    SELECT d, array_to_string(digests[1:d], ',') AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
        any_value(digests[1:d]) AS path, max(CASE WHEN d > 0 THEN counts[d] ELSE 0 END) AS n_words,
        array_to_string(any_value(digests[1:d - 1]), ',') AS parent,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
            FILTER (WHERE len(digests) = d), '')) AS ends_sha256
    FROM members GROUP BY d, node
), families AS (
    SELECT parent, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), known AS (
    SELECT n.*, coalesce(f.n_children, 0) AS n_children
    FROM nodes n LEFT JOIN families f ON f.parent = n.node AND f.d = n.d
), above AS (
    SELECT n_children, (n_convs - 1) * n_words AS saved, path, unnest(range(0, d + 1)) AS d FROM known
), sums AS (
    SELECT d, array_to_string(path[1:d], ',') AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
        CAST(sum(saved) AS BIGINT) AS saved_tokens
    FROM above GROUP BY ALL
)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves,
    s.saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.node = k.node AND s.d = k.d
LEFT JOIN known p ON k.d > 0 AND p.node = k.parent AND p.d = k.d - 1
"""


def oracle_sql() -> dict[str, str]:
    """Twins of what SQL expresses; learned models and tokenizers have none."""
    return {
        "op8_chat_formatting": _CHAT_SQL,
        "op10_jaccard_join": _JACCARD_SQL,
        "op11_prefix_trie": _TRIE_SQL,
    }
