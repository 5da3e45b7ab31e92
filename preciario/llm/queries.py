"""The dealt operators over the driver tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preciario.llm import bpe, jaccard_join, language, line_dedup, merkle, neighbours, packing, quality_classifier, style_tree, token_counts, topk, trie, warc
from preciario.llm.shared import discard, scratch_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS_50K = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS_MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The one string that byte_bpe_50k.json takes as a token of its own.
SPECIAL_50K = (("<|endoftext|>", 50256),)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit, in DuckDB's dialect."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len({text}) + 1),
        lambda i: [CAST(ascii(substring({text}, CAST(i AS INTEGER), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, (a % 2) * 3988292384) END), 4294967295)"""


def query(function: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    if oracle:
        ORACLES[function.__name__] = oracle
    return function


@query
def op1_neighbours(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), lambda i: i % 100 == 0)


@query
def op2_html(spark, sf):
    return style_tree.extract(table(spark, sf, "pages"))


@partial(
    query,
    oracle="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
)
def op3_topk(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), lambda i: i % 20 == 0)


@query
def op4_jaccard_join(spark, sf):
    return jaccard_join.join(table(spark, sf, "documents"))


@query
def op5_token_counts(spark, sf):
    return token_counts.section_counts(table(spark, sf, "documents"), RANKS_50K)


@query
def op6_bpe(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), RANKS_MULTI)


@partial(query, oracle=line_dedup.oracle())
def op7_line_dedup(spark, sf):
    return line_dedup.remove_boilerplate(table(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query
def op8_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), RANKS_50K, SPECIAL_50K)


@query
def op9_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    return language.identify(rows, language.train(docs), keep=("doc_id", "held_out"))


@partial(
    query,
    oracle=f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {warc.SHORTEST} GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)""",
)
def op10_warc(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"), scratch_path(spark, "warc"))


@query
def op11_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf, "labels"))
    rows = docs.withColumn("held_out", quality_classifier.held_out(F.col("doc_id")))
    return quality_classifier.scored(rows, model, keep=("doc_id", "held_out"))


@partial(
    query,
    oracle=f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t
), r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, t.pos - h + least(h, coalesce(b.n, 0)), t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= h LEFT JOIN (SELECT DISTINCT conv_id, n FROM t) b ON b.conv_id = c.base
), s AS (
  SELECT c.conv_id, coalesce(list(sha256(strlen(role) || ':' || role || text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns,
         list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS words
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (SELECT conv_id, turns, words, unnest(range(0, len(turns) + 1)) AS depth FROM s
), n AS (
  SELECT array_to_string(turns[:depth], '/') AS path, depth, any_value(turns[:depth]) AS turns, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS w,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL
), k AS (SELECT array_to_string(turns[:depth - 1], '/') AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth
), a AS (SELECT turns, n_convs, n_children, w, unnest(range(0, depth + 1)) AS d FROM f
), g AS (SELECT array_to_string(turns[:d], '/') AS path, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM a GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN g ON g.path = f.path AND g.d = f.depth LEFT JOIN f u ON u.path = array_to_string(f.turns[:f.depth - 1], '/') AND u.depth = f.depth - 1""",
)
def op12_trie(spark, sf):
    own = written(trie.conversations_of(table(spark, sf, "conversations")), "trie-conversations")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    rebuilt = written(trie.with_heads(own, F.col("conv_id") - F.col("conv_id") % 20, heads, 3), "trie-rebuilt")
    out = trie.prefix_trie(rebuilt)
    discard(own, rebuilt)
    return out


def _packed_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree_sql(name: str, leaves: str, group: str) -> str:
    """Levels (name: grp, lvl, pos, n, h) over ``leaves`` (grp, pos, n, h), and the runs of siblings (name_runs)."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, pos, n, h FROM {leaves}
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3, n
), {name}_runs AS (SELECT grp, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3
), {name}_climb AS (
  SELECT grp, member, 0 AS lvl, pos, h, proof FROM {group}
  UNION ALL
  SELECT c.grp, c.member, c.lvl + 1, c.pos // 3,
         sha256(array_to_string(list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN i = c.pos % 3 + 1 THEN c.h ELSE hs[i] END), '')),
         c.proof || array_to_string(list_filter(list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN i <> c.pos % 3 + 1 THEN hs[i] END), lambda x: x IS NOT NULL), '')
  FROM {name}_climb c JOIN {name}_runs r ON r.grp = c.grp AND r.lvl = c.lvl AND r.run = c.pos // 3
), {name}_top AS (SELECT grp, member, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM {name}_climb GROUP BY grp, member)"""


@partial(
    query,
    oracle=f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS member, doc_id, coalesce('=' || source, '-') AS grp, CAST(doc_id AS VARCHAR) AS id, text,
         {" || ".join(_packed_sql(x) for x in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents
), h AS (
  SELECT member, doc_id, grp, sha256(head || {_packed_sql("text")}) AS leaf,
         CASE WHEN id IS NOT NULL AND {crc32_sql("id")} % 2 = 0 THEN sha256(head || {_packed_sql("replace(text, chr(10), '')")}) END AS altered FROM d
), leaves AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM h
), starts AS (SELECT grp, member, pos, coalesce(altered, leaf) AS h, '' AS proof FROM leaves),
{_tree_sql("t", "leaves", "starts")},
subroots AS (SELECT '' AS grp, grp AS member, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1),
tops AS (SELECT '' AS grp, t_top.member, s.pos, t_top.h, t_top.proof FROM t_top JOIN subroots s ON s.member = t_top.grp),
{_tree_sql("u", "subroots", "tops")}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(u_top.proof) AS proof_sha256, u_top.h AS folded_root, u_top.h = r.h AS verified
FROM leaves JOIN subroots s ON s.member = leaves.grp JOIN u_top ON u_top.member = leaves.member JOIN u r ON r.n = 1""",
)
def op13_merkle(spark, sf):
    docs = table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.checked(docs, altered).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
