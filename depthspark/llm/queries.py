"""Registered queries of this subpackage, each over the whole of its tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthspark.llm.common import tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.knn_quality import fit, quality_scores
    from depthspark.llm.pitman_yor import remainder
    docs = _table(spark, sf_dir, "documents")
    voters = fit(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = quality_scores(docs.select("doc_id", "text"), voters).select(F.col("row.doc_id").alias("doc_id"), "quality_score")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.multi_index import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.decontaminate import leaks
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), answer_share=None)


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.mixing import mix
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.pitman_yor import remainder
    from depthspark.llm.toxicity import fit, toxicity_scores
    docs = _table(spark, sf_dir, "documents")
    network = fit(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return toxicity_scores(docs, network).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"),
                                                 (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.common import new_path
    from depthspark.llm.token_files import token_digest, write_tokens
    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)


def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.secrets import scan_secrets
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.pitman_yor import remainder, score_documents
    scored = score_documents(_table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return scored.selectExpr("doc_id", "not learned as held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.token_counts import token_counts
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.ngram_join import ngram_components
    return ngram_components(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.merkle import tampered_manifest
    checked = tampered_manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.conversations import damaged, repair
    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthspark.llm.byte_bpe import decode, digests, encode
    return digests(decode(encode(_table(spark, sf_dir, "documents"))))


_QUERIES = [op1_knn_quality, op2_multi_index, op3_decontaminate, op4_entropy_mix, op5_toxicity, op6_token_files, op7_secret_owners, op8_pitman_yor, op9_token_counts, op10_ngram_join,
            op11_merkle_manifest, op12_conversation_repair, op13_byte_bpe]


def _spans_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Rows of one kind: the text between the matches and the matches give the places."""
    quoted = pattern.replace("'", "''")
    before = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    start = f"{before.format('g[1:i]')} + {before.format('m[1:i-1]')}"
    return f"""SELECT rid, '{kind}' AS kind, {place} AS place, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e, x.v AS v FROM (
  SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': {start}, 'n': length(m[i]), 'v': v[i]}})) AS x FROM (
    SELECT rid, regexp_extract_all(text, '{quoted}', 0) AS m, regexp_extract_all(text, '{quoted}', {group}) AS v, string_split_regex(text, '{quoted}') AS g FROM d) r
  WHERE len(m) > 0) u WHERE length(x.v) >= {least}"""


_NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
base AS ({_spans_sql("assign", 0, "(" + _NAME + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)}
  UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{24,}", 0, 24)}),
owned AS (SELECT o.* FROM ({_spans_sql("owned", 3, "[A-Za-z0-9_-]{32,}", 0, 32)}) o WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s < o.e AND o.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM owned),
live AS (SELECT v, count(DISTINCT source) <= 2 AND count(DISTINCT text) <= 8 AS live FROM every JOIN d USING (rid) GROUP BY v),
judged AS (SELECT every.*, live.live FROM every JOIN live USING (v)),
told AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE kind <> 'owned') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE kind <> 'owned' OR live) AS spans,
    count(*) FILTER (WHERE kind = 'owned' AND live) AS n_owned, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_shared
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN told USING (rid)
"""

_JOIN = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0) p),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT x, y FROM shared JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT rid, rid AS r FROM w UNION SELECT reach.rid, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (rid)
JOIN (SELECT reach.rid, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.rid = reach.r GROUP BY reach.rid) c USING (rid)
"""

# Levels of all trees at once, first up, then for every leaf from its sibling on.
_TREES = r"""
WITH RECURSIVE part AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
    coalesce(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(CAST(strlen(source) AS VARCHAR) || ':' || source, '-')
      || coalesce(CAST(strlen(lang) AS VARCHAR) || ':' || lang, '-') AS head, coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))) AS crc FROM documents),
leaf AS (SELECT rid, doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
    sha256(head || coalesce(CAST(strlen(CAST(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS VARCHAR) || ':'
      || CAST(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR), '-') || tail) AS shown FROM part),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node(tree, lvl, pos, n, digest) AS (SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL SELECT tree, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, lvl, pos // 2),
crown AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top(lvl, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM crown
  UNION ALL SELECT lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
way(rid, tree, lvl, pos, n, proof, folded) AS (SELECT rid, tree, 0, pos, n, '', shown FROM placed
  UNION ALL SELECT w.rid, w.tree, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN s.digest IS NULL THEN w.folded WHEN w.pos % 2 = 1 THEN s.digest || w.folded ELSE w.folded || s.digest END)
  FROM way w LEFT JOIN node s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
up(rid, lvl, pos, n, proof, folded) AS (SELECT w.rid, 0, c.pos, c.n, w.proof, w.folded FROM way w JOIN crown c USING (tree) WHERE w.n = 1
  UNION ALL SELECT u.rid, u.lvl + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN s.digest IS NULL THEN u.folded WHEN u.pos % 2 = 1 THEN s.digest || u.folded ELSE u.folded || s.digest END)
  FROM up u LEFT JOIN top s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT l.doc_id, l.leaf, c.subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.digest AS verified
FROM leaf l JOIN crown c USING (tree) JOIN up u ON u.rid = l.rid AND u.n = 1 JOIN (SELECT digest FROM top WHERE n = 1) r ON true
"""

SQL: dict[str, str] = {"op7_secret_owners": _SECRETS, "op10_ngram_join": _JOIN, "op11_merkle_manifest": _TREES}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def llm_sql() -> dict[str, str]:
    return dict(SQL)
