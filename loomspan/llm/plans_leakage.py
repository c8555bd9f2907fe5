"""Queries of the leakage problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.leakage import leaked_spans
from loomspan.sources.tables import table


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which they hold twelve words in a row."""
    return _spans(spark, folder).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item: how many documents hold it, and how much of it."""
    per = _spans(spark, folder).groupBy("item_id").agg(
        F.countDistinct("doc_id").cast("long").alias("documents"), F.max("n_words").cast("long").alias("longest_run")
    )
    items = table(spark, folder, "eval_items").select("item_id", "split").distinct()
    return items.join(per, "item_id").select("item_id", "split", "documents", "longest_run")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}

_WORDS = r"regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\p{Cf}\p{M}]+', '', 'g'))), '[\p{L}\p{N}]+')"
ORACLE = {
    "p8_items": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, n AS dn, array_to_string(w[n : n + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS n FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, n AS n, array_to_string(w[n : n + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS n FROM i WHERE len(w) >= 12)),
m AS (SELECT DISTINCT doc_id, item_id, dn, dn - n AS shift FROM dg JOIN ig USING (g)),
r AS (SELECT doc_id, item_id, shift, dn - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY dn) AS run FROM m),
l AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, shift, run)
SELECT item_id, split, count(DISTINCT doc_id) AS documents, max(words) AS longest_run FROM l JOIN (SELECT DISTINCT item_id, split FROM eval_items) USING (item_id) GROUP BY ALL""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[n : n + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS n FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, array_to_string(w[n : n + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS n FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
