"""Problem 7: a training set mixed from the documents' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm.mixing import Mix
from strainspark.queries.tables import table


def mix(spark: SparkSession, d: str) -> Mix:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose documents, all put out as often as allowed, don't reach their share."""
    return mix(spark, d).short().select("source")


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return mix(spark, d).documents()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(spark, d).shares()


def p7_documents_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """The same mixture with characters for tokens, which SQL can count: every document and copy put out."""
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars").documents()


QUERIES = {"p7_found": p7_found, "p7_documents": p7_documents, "p7_shares": p7_shares, "p7_documents_by_chars": p7_documents_by_chars}
# Any usual size gives the same cases; SQL has no tokenizer, so it counts characters.
SQL = {
    "p7_found": """WITH n AS (SELECT lower(trim(source)) AS k, sum(length(text)) AS n FROM documents GROUP BY 1)
SELECT t.source FROM mix_targets t LEFT JOIN n ON lower(trim(t.source)) = n.k
WHERE t.target_share * (SELECT sum(length(text)) FROM documents) > t.max_repeats * coalesce(n.n, 0)""",
    "p7_documents_by_chars": """WITH d AS (SELECT doc_id, nullif(lower(trim(source)), '') AS k, greatest(coalesce(n_chars, 0), 0) AS n FROM documents),
s AS (SELECT k, sum(n) AS n FROM d GROUP BY k),
t AS (SELECT lower(trim(source)) AS k, sum(coalesce(target_share, 0)) AS share, max(max_repeats)::DOUBLE AS cap
      FROM (SELECT DISTINCT * FROM mix_targets) GROUP BY 1),
r AS (SELECT t.k, CASE WHEN s.n > 0 THEN least(cap, share * (SELECT sum(n)::DOUBLE FROM d) / s.n) ELSE 0 END AS rate FROM t JOIN s ON t.k = s.k),
c AS (SELECT doc_id, d.k, d.n, (floor(rate) + CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate)
      THEN 1 ELSE 0 END)::INT AS times FROM d JOIN r ON d.k = r.k)
SELECT doc_id, k AS source, n AS n_tokens, unnest(range(1, times + 1))::INT AS copy FROM c WHERE times > 0""",
}
