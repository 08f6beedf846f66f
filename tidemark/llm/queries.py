"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidemark.llm.common import spread
from tidemark.llm import decontamination, embedding_dedup, language, line_dedup, merkle, pieces, quality, sharding, simhash, substring_dedup, token_counts, token_files, whitening

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, _ = token_files.write_token_files(docs, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_files.read_token_files(spark, out)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), with_ids=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")
    return merkle.verified_rows(table(spark, sf_dir, "documents"), tampered)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sharding, op3_token_files, op4_pieces, op5_line_dedup, op6_embedding_dedup, op7_quality, op8_decontamination, op9_language, op10_token_counts, op11_embedding_whitening, op12_merkle_manifest, op13_substring_dedup)}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: For what SQL can say: all windows of both sides joined as lists of words; all pairs of vectors.
ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
      k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
      p AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
      h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN k ON p.n = k.n AND p.win = k.win),
      c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
      t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
      SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
      l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
      r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
      SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, min(r.w) AS component_id, v.vec_id = min(r.w) AS kept FROM v JOIN r ON r.u = v.vec_id GROUP BY v.vec_id""",
    "op12_merkle_manifest": f"""WITH RECURSIVE
      r AS (SELECT row_number() OVER () AS r, *, doc_id::VARCHAR AS name FROM documents),
      c AS (SELECT r, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS crc FROM r WHERE name IS NOT NULL),
      l AS (SELECT r, doc_id, source, {_leaf('text')} AS leaf, CASE WHEN crc % 2 = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS given FROM r LEFT JOIN c USING (r)),
      p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
      t AS (SELECT source, 0 AS lvl, pos, leaf AS h, n FROM p UNION ALL
        SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3),
      s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
      u AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM s UNION ALL
        SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3),
      top AS (SELECT max(lvl) AS depth, any_value(h) FILTER (WHERE n = 1) AS root FROM u),
      -- At each level the node that is folded so far, and the siblings met: first to the subroot, then to the root.
      f AS (SELECT r, source, 0 AS lvl, pos, n, given AS cur, '' AS proof FROM p UNION ALL
        SELECT f.r, f.source, f.lvl + 1, f.pos // 3, (f.n + 2) // 3, sha256(coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < f.pos), '') || f.cur || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > f.pos), '')),
          f.proof || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), '')
        FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.r, f.source, f.lvl, f.pos, f.n, f.cur, f.proof),
      g AS (SELECT f.r, s.subroot, 0 AS lvl, s.pos, s.n, f.cur, f.proof FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1 UNION ALL
        SELECT g.r, g.subroot, g.lvl + 1, g.pos // 3, (g.n + 2) // 3, sha256(coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos < g.pos), '') || g.cur || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos > g.pos), '')),
          g.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> g.pos), '')
        FROM g JOIN u ON u.lvl = g.lvl AND u.pos // 3 = g.pos // 3 WHERE g.n > 1 GROUP BY g.r, g.subroot, g.lvl, g.pos, g.n, g.cur, g.proof)
      SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM p JOIN g USING (r), top WHERE g.n = 1""",
    "op13_substring_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      p AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
      h AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM p JOIN (SELECT win FROM p GROUP BY win HAVING count(*) > 1) USING (win)),
      e AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
      s AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM e ANTI JOIN h USING (r, k) GROUP BY r)
      SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)""",
}
