"""Problem 2: the best HSPs and merged hits of each query sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm.topn import top_n
from strainspark.queries.tables import table


def p2_hsps(spark: SparkSession, d: str) -> DataFrame:
    hsps = table(spark, d, "hsps").where("qseqid <> ''")
    return top_n(hsps, "qseqid", "bitscore", [("pident", "desc")], "hsp_id", 5)


def p2_merged_hits(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "merged_hits"), "qseqid", "identity_pct", [("coverage_pct", "desc")], "merged_id", 3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    def part(df: DataFrame, name: str, row_id: str) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), "qseqid", F.col(row_id).alias("row_id"))

    return part(p2_hsps(spark, d), "hsps", "hsp_id").unionByName(part(p2_merged_hits(spark, d), "merged_hits", "merged_id"))


QUERIES = {"p2_found": p2_found, "p2_hsps": p2_hsps, "p2_merged_hits": p2_merged_hits}

_H = """h AS (SELECT DISTINCT qseqid, bitscore, pident, hsp_id FROM hsps WHERE qseqid <> '' AND bitscore IS NOT NULL AND NOT isnan(bitscore)),
hr AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, pident DESC NULLS LAST, hsp_id)::INT AS rank FROM h)"""
_M = """m AS (SELECT DISTINCT qseqid, identity_pct, coverage_pct, merged_id FROM merged_hits WHERE qseqid IS NOT NULL AND identity_pct IS NOT NULL AND NOT isnan(identity_pct)),
mr AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY identity_pct DESC, coverage_pct DESC NULLS LAST, merged_id)::INT AS rank FROM m)"""
SQL = {
    "p2_hsps": f"WITH {_H} SELECT qseqid, bitscore, hsp_id, rank FROM hr WHERE rank <= 5",
    "p2_merged_hits": f"WITH {_M} SELECT qseqid, identity_pct, merged_id, rank FROM mr WHERE rank <= 3",
    "p2_found": f"""WITH {_H}, {_M} SELECT 'hsps' AS table_name, qseqid, hsp_id AS row_id FROM hr WHERE rank <= 5
UNION ALL SELECT 'merged_hits', qseqid, merged_id FROM mr WHERE rank <= 3""",
}
