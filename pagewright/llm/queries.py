"""Named queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import (
    decontaminate, hard_negatives, lz_dedup, mixing, prefix_trie, quality, secrets, simhash, suffix_dedup, tokens, url_filters,
    vector_topk)
from pagewright.llm.common import table
from pagewright.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = tokens.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=0, special=True)
    return tokens.read_tokens(manifest, folder)


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_repeated_windows")
def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_OP6 = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op6_exact_topk", _OP6)
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.exact_topk(table(spark, sf_dir, "embeddings"))


_OP7 = """
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
urls AS (
  SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM parts),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max({'rule': rh || rp, 'verdict': verdict}, length(rh || rp)) FROM rules
     WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best
  FROM urls)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""


@query("op7_url_filters", _OP7)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


#: <|endoftext|> of the vocabulary: no text encodes to it.
END_OF_TEXT = 50_256


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_no, start, n_tokens, closed: counts found in unindexed files of all documents."""
    folder = scratch_path(spark, "flat")
    manifest = tokens.write_tokens(
        table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=END_OF_TEXT, ordered=False)
    counts = tokens.scan_tokens(spark, folder, END_OF_TEXT)
    # both sides come from small manifests by mapInArrow, so their size can't be estimated: never broadcast
    return tokens.document_numbers(manifest, folder).join(counts.hint("merge"), "doc_no")


@query("op9_later_copies")
def op9_later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_later_copies(table(spark, sf_dir, "documents")).drop("kept")


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_OP11 = """
WITH turns AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, turn, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
plain AS (
  SELECT c, list(t ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM turns GROUP BY c),
summed AS (
  SELECT c, turns, xor(4294967295, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda crc, code: list_reduce(list_prepend(xor(crc, code), range(8)),
                                    lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM plain),
rebuilt AS (
  SELECT s.c, list_concat(coalesce(o.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns
  FROM summed s LEFT JOIN plain o ON o.c = s.c - s.c % 20),
prefixes AS (
  SELECT c, turns[1:d] AS node, d, d = len(turns) AS ends
  FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d),
own AS (
  SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE
    len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes),
children AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
shape AS (SELECT o.*, coalesce(k.n, 0) AS n_children FROM own o LEFT JOIN children k ON k.node = o.node AND k.d = o.d),
above AS (
  SELECT node[1:k] AS node, k AS d, saved, n_children
  FROM (SELECT node, saved, n_children, unnest(range(d + 1)) AS k FROM shape)),
totals AS (SELECT node, d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY node, d)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM shape s JOIN totals t ON t.node = s.node AND t.d = s.d
LEFT JOIN nodes p ON s.d > 0 AND p.d = s.d - 1 AND p.node = s.node[1:s.d - 1]
"""


@query("op11_prefix_trie", _OP11)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


_OP12 = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows x ON a.vec_id % 50 = 0 AND x.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", _OP12)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_secret_scans")
def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))
