"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import bpe, chat, class_lm, decontaminate, quality_knn, quality_rules, sharding, simhash, substring_dedup, toxicity_fm
from prosemill.llm.shared import UPPER, table
from prosemill.session import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_ALL = (op1_quality_knn, op2_substring_dedup, op3_sharding, op4_decontamination, op5_bpe, op6_class_lm, op7_simhash, op8_chat_format, op9_toxicity_fm, op10_quality_rules)

_OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS t FROM s),
m AS (SELECT t FROM k GROUP BY t HAVING count(*) > 1),
g AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM k SEMI JOIN m USING (t)),
c AS (SELECT r, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

_OP4_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bi),
di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM di),
h AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN x USING (r)
"""

_OP8_SQL = """
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN row(turn, coalesce(role, ''), coalesce(text, '')) END AS solo, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, solo ORDER BY turn NULLS FIRST) AS k FROM t),
p AS (SELECT conv_id, solo, k, list({'r': role, 't': text}) OVER (PARTITION BY conv_id, solo ORDER BY k) AS l, count(*) OVER (PARTITION BY conv_id, solo) AS n FROM k),
w AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, l FROM p WHERE k = n GROUP BY n, l),
m AS (SELECT * FROM w ANTI JOIN (SELECT DISTINCT l FROM p WHERE k < n) q USING (l))
SELECT conv_id, n_turns, n_copies, array_to_string(list_transform(l, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10)), '') AS text FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """The SQL of what SQL can say; the tests hold the others against brute force, a round trip or held-out labels."""
    return {"op2_substring_dedup": _OP2_SQL, "op4_decontamination": _OP4_SQL, "op8_chat_format": _OP8_SQL}
