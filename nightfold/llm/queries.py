"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.llm import align, ann, decontaminate, licenses, lines, mixing, quality, rules, sharding, simhash, tokens, toxicity, trie
from nightfold.llm.common import stored
from nightfold.util import ensure_checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/nightfold-tokens-{uuid.uuid4().hex}"
    tokens.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    rows = stored(tokens.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "digests")  # decoded once
    return tokens.starts(rows).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_token_ids": op3_token_ids,
    "op4_quality": op4_quality,
    "op5_jump_hash_sharding": op5_jump_hash_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality_rules": op13_quality_rules,
}

#: Nodes by whole sequences of turns. CRC-32 goes bit by bit over the decimal digits (a digit is a number below 256, then
#: eight shifts, marked by -1); subtrees are found by members: a node is below another if its smallest member is one of
#: the other's and it is deeper.
TRIE_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
  k AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h FROM c),
  r AS (SELECT k.conv_id, list_concat(coalesce(f.own, [])[1:k.h], k.own[k.h + 1:]) AS turns FROM k LEFT JOIN c f ON f.conv_id = k.conv_id - k.conv_id % 100),
  m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
  p AS (SELECT conv_id, depth, turns[1:depth] AS node, turns[1:depth - 1] AS up, depth = len(turns) AS ends, CASE WHEN depth > 0 THEN length(turns[depth].t) ELSE 0 END AS chars FROM m),
  n AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM p GROUP BY depth, node),
  ch AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
  w AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, node)),
  s AS (SELECT p.depth, p.node, sum(w.saved) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves FROM p JOIN w ON w.conv_id = p.conv_id AND w.depth >= p.depth GROUP BY ALL)
  SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ended) AS ends_sha256
  FROM w JOIN s USING (depth, node) LEFT JOIN n q ON w.depth > 0 AND q.depth = w.depth - 1 AND q.node = w.up"""


def _rules_sql() -> str:
    """The rules over all documents, from the same constants: sketches, their merges, fences, verdicts."""
    space, leading = r"[\x20\x09-\x0D]", f"(1 << greatest(length(bin(v)) - {rules.BITS}, 0))"
    scale = {"word_length": ("word_chars", 100), "symbol_share": ("n_symbols", rules.SCALE), "dup_lines": ("n_dup_lines", rules.SCALE), "repeat_share": ("n_repeat_words", rules.SCALE)}
    values = " UNION ALL ".join(f"SELECT rid, lang, source, '{n}' AS rule, CASE WHEN n_words > 0 THEN {c} * {k} // n_words END AS v FROM cnt" for n, (c, k) in scale.items())
    quart = lambda name, keys: f"""{name} AS (SELECT {keys}rule, max(total) AS total, min(b) FILTER (upto > total // 4) AS q1, min(b) FILTER (upto > 3 * total // 4) AS q3 FROM
      (SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS total FROM (SELECT {keys}rule, b, count(*) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"""  # noqa: E731
    pick = lambda c: f"CASE WHEN o.total >= {rules.ENOUGH} THEN o.{c} WHEN l.total >= {rules.ENOUGH} THEN l.{c} ELSE w.{c} END"
    limits = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {r.least} AS least, {-1 if r.below is None else r.below} AS below, {-1 if r.above is None else r.above} AS above, {k} AS nr" for k, r in enumerate(rules.RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
      ws AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
      e AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM ws),
      tri AS (SELECT rid, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM e WINDOW p AS (PARTITION BY rid ORDER BY i)),
      dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
      rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(3)) AS k) GROUP BY rid),
      cnt AS (SELECT rid, doc_id, coalesce('1' || lang, '0') AS lang, coalesce('1' || source, '0') AS source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM ws LEFT JOIN rep USING (rid)),
      val AS ({values}), sk AS (SELECT *, v - v % {leading} AS b FROM val WHERE v IS NOT NULL),
      {quart("o", "lang, source, ")}, {quart("l", "lang, ")}, {quart("w", "")}, lim AS ({limits}),
      f AS (SELECT o.lang, o.source, rule, {pick("q1")} AS q1, {pick("q3")} AS q3 FROM o JOIN l USING (lang, rule) JOIN w USING (rule)),
      broken AS (SELECT rid, string_agg(rule, ',' ORDER BY nr) AS failed FROM val JOIN f USING (lang, source, rule) JOIN lim USING (rule)
        WHERE (below >= 0 AND v < q1 - below * greatest(q3 - q1, least)) OR (above >= 0 AND v > q3 + above * greatest(q3 - q1, least)) GROUP BY rid),
      out AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM cnt LEFT JOIN broken USING (rid))
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM out"""


#: The others fit models, hash (XXH64, SimHash), tokenize or iterate; they are tested against plain versions.
ORACLE_SQL: dict[str, str] = {"op12_conversation_trie": TRIE_SQL, "op13_quality_rules": _rules_sql()}
