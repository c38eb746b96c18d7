"""Queries over the driver's tables for the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, hmm, jaccard, licenses, manifest, media, mixing, near_duplicates, pii, prefix_trie, quality, substrings, tokenizing
from .common import documents

ORACLE_SQL: dict[str, str] = {}


def quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    measures = {
        "n_words": "m.n_words", "mean_word_chars": "word_chars / greatest(m.n_words, 1)", "symbol_ratio": "n_symbols / greatest(m.n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(m.n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    met = " AND ".join(f"{measures[r.measure]} {op} {v}" for r in quality.RULES for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, string_split(text, chr(10)) AS lines, text FROM d),
tri AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.rid, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines,
  len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM w),
r AS (SELECT d.doc_id, m.n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(full_lines)::BIGINT AS n_lines, n_stop_words::BIGINT AS n_stop_words
  FROM d JOIN m USING (rid) LEFT JOIN cov USING (rid))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {met} AS kept FROM r m
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken()


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.encode_media(documents(spark, sf_dir)))
    starts = F.array_join(F.transform("clips", lambda c: c["first_frame"].cast("string")), ",")
    return read.withColumn("feature", F.concat(F.lit("shots:"), starts)).withColumn("n_shots", F.size("clips")).drop("clips")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.groups(documents(spark, sf_dir), shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first_word"], x["end_word"], x["matched"])), ",")
    return found.withColumn("spans", spans).drop("found")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(documents(spark, sf_dir)).select(*columns, "n_lines", "n_stop_words")


ORACLE_SQL["op6_quality"] = quality_sql()


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_duplicates(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    counts = [pii.count_of(F.col("fixed"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("fixed")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.tokenize(documents(spark, sf_dir), tokenizer_file(), keep_ids=False)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = manifest.tampered(F.col("text"), F.col("doc_id"))
    return manifest.Manifest(documents(spark, sf_dir), claim).checked()


def crc32_sql(x: str) -> str:
    """CRC-32 of a number's decimal text: each byte, then eight shifts."""
    steps = f"flatten(list_transform(string_split({x}::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295)"


def manifest_sql(levels: int = 7) -> str:
    """Level by level, for sources (and tables of sources) of at most 16 ** ``levels`` rows."""

    def leaf(text: str) -> str:
        parts = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({parts})"

    def tree(name: str, key: str) -> str:
        """``name``_n0 (key, pos, n, h) up to its root, and the siblings on each level."""
        made = []
        for k in range(levels):
            run = f"OVER (PARTITION BY {key}, pos // 16 ORDER BY pos ROWS BETWEEN"
            sides = f"string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r"
            made.append(f"{name}_s{k} AS (SELECT {key}, pos, n, {sides} FROM {name}_n{k})")
            made.append(f"{name}_n{k + 1} AS (SELECT {key}, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {name}_n{k} GROUP BY {key}, pos // 16, n)")
        return ", ".join(made)

    def climb(name: str, key: str, first: str) -> str:
        made, before = [], first
        for k in range(levels):
            made.append(
                f"{name}_c{k} AS (SELECT c.* EXCLUDE (pos, cur, proof), c.pos // 16 AS pos, CASE WHEN s.n > 1 THEN sha256(coalesce(l, '') || cur || coalesce(r, '')) ELSE cur END AS cur, proof || coalesce(l, '') || coalesce(r, '') AS proof "
                f"FROM {before} c JOIN {name}_s{k} s ON c.{key} IS NOT DISTINCT FROM s.{key} AND c.pos = s.pos)"
            )
            before = f"{name}_c{k}"
        return ", ".join(made)

    bent = f"CASE WHEN {crc32_sql('doc_id')} % 5 = 0 THEN translate(text, '{manifest.UPPER}', '{manifest.LOWER}') ELSE text END"
    return f"""
WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(f'({bent})')} AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
a_n0 AS (SELECT source, pos, n, leaf AS h FROM p), {tree("a", "source")},
q AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a_n{levels}),
b_n0 AS (SELECT 0 AS one, pos, n, h FROM q), {tree("b", "one")},
a_c AS (SELECT doc_id, source, leaf, claim AS cur, pos, '' AS proof FROM p), {climb("a", "source", "a_c")},
b_c AS (SELECT x.doc_id, x.leaf, q.h AS subroot, x.cur, q.pos, x.proof, 0 AS one FROM a_c{levels - 1} x JOIN q ON x.source IS NOT DISTINCT FROM q.source), {climb("b", "one", "b_c")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM b_c{levels - 1}, b_n{levels}"""


ORACLE_SQL["op12_merkle_manifest"] = manifest_sql()


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = prefix_trie.turns(documents(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.as_paths(prefix_trie.spliced(told)))


ORACLE_SQL["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, substr(sha256(strlen(role) || ':' || role || text), 1, 32)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 5 AS base, ({crc32_sql('conv_id')} % 9)::BIGINT AS h FROM own),
made AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns FROM h LEFT JOIN own b ON h.base = b.conv_id),
pre AS (SELECT conv_id, len(turns) AS n, d, list_slice(turns, 1, d) AS key FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM made)),
node AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM pre GROUP BY key, d),
up AS (SELECT c.*, p.conv_id AS parent FROM node c LEFT JOIN node p ON c.d = p.d + 1 AND list_slice(c.key, 1, c.d - 1) = p.key),
kids AS (SELECT list_slice(key, 1, d - 1) AS key, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
own2 AS (SELECT node.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(key[d].t) ELSE 0 END AS saved FROM node LEFT JOIN kids USING (key)),
sums AS (SELECT list_slice(key, 1, a) AS key, sum(saved) AS saved, count(*) FILTER (WHERE k = 0) AS leaves, max(CASE WHEN a = d THEN k END) AS k FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own2) GROUP BY 1)
SELECT up.conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, k::BIGINT AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256 FROM up JOIN sums USING (key)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_hmm": op2_hmm,
    "op3_media": op3_media,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_substrings": op7_substrings,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}
