"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vantage.runtime import small_batches

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.decontamination import find_leaks

    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(WORDS))


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.toxicity import judge

    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.token_files import encode_and_read

    return encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(WORDS))


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.ngram_join import join_texts

    return join_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.secrets import secret_digest

    return secret_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.line_dedup import line_digest

    return line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.media import media_features, to_media

    return media_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.conversation_repair import damaged, repair_digest

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_digest(damaged(conversations), conversations)


def op12_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.pieces import piece_digest

    return piece_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(PIECES))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantage.llm.conversation_trie import rebuilt_trie

    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _in_small_batches(f) for k, f in globals().items() if k.startswith("op") and callable(f)}


def _in_small_batches(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


LINES_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY rid, doc_id
"""


CRC_SQL = """list_reduce([0::BIGINT] || flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
 lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END, 4294967295::BIGINT)"""
TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY r) AS ts FROM t GROUP BY c),
ids AS (SELECT DISTINCT c, xor({CRC_SQL.format(x="c::VARCHAR")}, 4294967295::BIGINT) % 4 AS h FROM own),
conv AS (SELECT ids.c, list_concat(coalesce(b.ts[1:h], []), own.ts[h + 1:]) AS ts FROM ids JOIN own USING (c) LEFT JOIN own b ON b.c = ids.c - ids.c % 20),
pre AS (SELECT c, ts[1:d] AS seq, d, len(ts) AS n FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM conv)),
node AS (SELECT seq, d, min(c) AS c, count(*) AS n, max(n > d) AS inner_node, list(c ORDER BY c) FILTER (n = d) AS ends,
 (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(seq[d].text, '[^\x20\x09-\x0D]+')) END AS saves FROM pre GROUP BY seq, d),
up AS (SELECT seq[1:k] AS seq, saves, NOT inner_node AS leaf, k = d - 1 AS child FROM (SELECT *, unnest(range(d + 1)) AS k FROM node)),
below AS (SELECT seq, sum(saves) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (child) AS children FROM up GROUP BY seq)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, p.c AS parent_conv_id, node.n AS n_convs, below.children AS n_children, below.leaves AS n_leaves,
 CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(node.ends, ','), '')) AS ends_sha256
FROM node JOIN below ON below.seq = node.seq LEFT JOIN node p ON node.d > 0 AND p.seq = node.seq[1:node.d - 1] AND p.d = node.d - 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": LINES_SQL, "op13_conversation_trie": TRIE_SQL}
