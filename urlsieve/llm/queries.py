"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import (
    ann, chat, decontamination, fill_in_middle, html_text, lm_scoring, merkle, packing, quality, simhash, substring_dedup,
    suffix_array_dedup, token_counts,
)
from urlsieve.llm.common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.repeated_byte_digest(read_table(spark, sf_dir, "documents"), length=200)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(read_table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of each document, made of its own text: a cut, a copy and a replacement."""
    n = F.coalesce(F.length("text"), F.lit(0))

    def edit(start, end, insert):
        return F.struct(F.floor(start).cast("long").alias("start"), F.floor(end).cast("long").alias("end"), insert.alias("insert"))

    edits = F.array(edit(n / 4, n / 4 + 7, F.lit("")), edit(n / 2, n / 2, F.substring("text", 1, 12)),
                    edit(n * 3 / 4, n * 3 / 4 + 5, F.lit(" edit ")))
    return token_counts.recount(read_table(spark, sf_dir, "documents").withColumn("edits", edits)).drop("text")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_word_digest(read_table(spark, sf_dir, "documents"), length=35)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), seq_len=4096, end_id=2)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digest(read_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(read_table(spark, sf_dir, "documents"), every=7)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(read_table(spark, sf_dir, "documents"), folds=7, fold=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_benchmark_decontamination, op3_suffix_array_dedup, op4_simhash_near_dedup,
        op5_nearest_neighbours, op6_token_counts, op7_chat_formatting, op8_html_extraction, op9_substring_dedup, op10_packing,
        op11_fill_in_middle, op12_merkle_manifest, op13_lm_scoring)
}

_OP11 = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
hashed AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS kept, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS side
  FROM units),
cut AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR kept >= 100 THEN 'plain'
              WHEN side < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(u[1 : least(a, b)], ''), '') AS p,
         coalesce(array_to_string(u[least(a, b) + 1 : greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(u[greatest(a, b) + 1 : n], ''), '') AS s
  FROM hashed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _sql_tree(name: str) -> str:
    """Levels of the trees of table ``name`` (grp, nodes)."""
    return f"""SELECT grp, 0 AS lvl, nodes FROM {name}
  UNION ALL
  SELECT grp, lvl + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM {name}_levels WHERE len(nodes) > 1"""


# crc32, bit by bit: each byte is followed by eight shifts (written as -1)
_SQL_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""

_OP12 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
         CASE WHEN {_SQL_CRC} % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} ELSE {_sql_leaf("n_chars")} END AS claim
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs),
lang_trees AS (SELECT lang AS grp, list(leaf ORDER BY idx) AS nodes FROM placed GROUP BY lang),
lang_trees_levels AS (
  {_sql_tree("lang_trees")}),
subroots AS (
  SELECT grp AS lang, nodes[1] AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS k FROM lang_trees_levels WHERE len(nodes) = 1),
top AS (SELECT 0 AS grp, list(subroot ORDER BY k) AS nodes FROM subroots),
top_levels AS (
  {_sql_tree("top")}),
steps AS (
  SELECT p.lang, p.idx, l.lvl, coalesce(l.nodes[xor(p.idx >> l.lvl, 1) + 1], '') AS sibling, (p.idx >> l.lvl) & 1 AS side
  FROM placed p JOIN lang_trees_levels l ON p.lang IS NOT DISTINCT FROM l.grp WHERE len(l.nodes) > 1
  UNION ALL
  SELECT p.lang, p.idx, 1000 + l.lvl, coalesce(l.nodes[xor(s.k >> l.lvl, 1) + 1], ''), (s.k >> l.lvl) & 1
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN top_levels l WHERE len(l.nodes) > 1),
proofs AS (
  SELECT lang, idx, list(struct_pack(sibling := sibling, side := side) ORDER BY lvl) AS path FROM steps GROUP BY lang, idx),
folds AS (
  SELECT p.doc_id, p.leaf, p.lang, p.claim AS node, coalesce(q.path, []) AS path, 0 AS done
  FROM placed p LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.idx = q.idx
  UNION ALL
  SELECT doc_id, leaf, lang,
         sha256(CASE WHEN path[done + 1].side = 1 THEN path[done + 1].sibling || node ELSE node || path[done + 1].sibling END), path, done + 1
  FROM folds WHERE done < len(path)),
root AS (SELECT nodes[1] AS root FROM top_levels WHERE len(nodes) = 1)
SELECT f.doc_id, f.leaf, s.subroot, r.root, sha256(array_to_string(list_transform(f.path, lambda x: x.sibling), '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.root AS verified
FROM folds f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root r WHERE f.done = len(f.path)
"""

SQL: dict[str, str] = {"op11_fill_in_middle": _OP11, "op12_merkle_manifest": _OP12}
