"""Best rows, duplicates, shortlists, summaries and matrices over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.functions.stats import match_score
from strainspark.operators.matrix import cell, long_matrix, matrix
from strainspark.operators.ranking import best_fields, best_per_key, first_wins, latest_records, preferred
from strainspark.operators.summaries import breadth_and_depth, concordance, family_collapse, length_stats, sample_summary, weighted_share
from strainspark.queries.tables import table


def hits(spark: SparkSession, d: str) -> DataFrame:
    """hits, each record once."""
    return latest_records(table(spark, d, "hits"), "hit_id", "loaded_at")


def records_latest(spark, d):
    return hits(spark, d).select("hit_id", "sample", "gene", "loaded_at")


def best_hsp(spark, d):
    h = table(spark, d, "hsps").where("qseqid <> '' AND bitscore IS NOT NULL AND NOT isnan(bitscore)")
    return best_per_key(h, ["qseqid"], [F.desc("bitscore"), F.desc_nulls_last("pident"), F.col("hsp_id")]).select("qseqid", "sseqid", "bitscore", "hsp_id")


def best_reference(spark, d):
    """The reference with the highest summed score of each query's sample."""
    h = table(spark, d, "hsps").where("NOT isnan(bitscore)").select("hsp_id", "qseqid", "sseqid", "bitscore").distinct()
    p = table(spark, d, "pieces").select("qid", "sample")
    total = h.join(p, F.col("qseqid") == F.col("qid")).groupBy("sample", "sseqid").agg(F.round(F.sum("bitscore"), 1).alias("score"))
    return best_per_key(total, ["sample"], [F.desc("score"), F.col("sseqid")])


def best_hit_fields(spark, d):
    h = table(spark, d, "hits").where("sample IS NOT NULL AND gene IS NOT NULL AND identity_pct IS NOT NULL")
    return best_fields(h, ["sample", "gene"], F.struct("coverage_pct", "identity_pct", -F.col("hit_id")), ["hit_id", "identity_pct", "coverage_pct"])


def genes_top3(spark, d):
    n = hits(spark, d).where("sample IS NOT NULL AND gene IS NOT NULL").groupBy("drug_class", "gene").agg(F.count(F.lit(1)).alias("n"))
    return best_per_key(n, ["drug_class"], [F.desc("n"), F.col("gene")], 3, rank="place")


def shortlist(spark, d):
    """Databases of each sample: of the first two those within 2 of the most hits, and any 'resbase'."""
    n = hits(spark, d).where("sample IS NOT NULL AND database IS NOT NULL").groupBy("sample", "database").agg(F.count(F.lit(1)).alias("n"))
    return preferred(n, ["sample"], [F.desc("n"), F.col("database")], "n", top=2, within=2, forced=F.col("database") == "resbase")


def dedup_first(spark, d):
    h = table(spark, d, "hits")
    return first_wins(h, ["database", "gene", "sequence", "start", "end", "method", "note"], [F.col("hit_id"), F.col("loaded_at")]).select("hit_id", "database", "gene", "sequence", "start", "end", "method", "note")


def summary(spark, d):
    return sample_summary(hits(spark, d))


def match_scores(spark, d):
    h = hits(spark, d).where("coverage_pct IS NOT NULL AND identity_pct IS NOT NULL")
    return h.select("hit_id", F.round(match_score(F.col("coverage_pct"), F.col("identity_pct")), 6).alias("score"))


def assembly_stats(spark, d):
    return length_stats(table(spark, d, "pieces").where("sample IS NOT NULL"), ["sample"], "length")


def depth_stats(spark, d):
    h = hits(spark, d).where("gene IS NOT NULL")
    return h.groupBy("gene").agg(*breadth_and_depth(F.col("depth"))).select("gene", F.round("breadth_pct", 6).alias("breadth_pct"), F.round("mean_depth", 6).alias("mean_depth"))


def weighted_identity(spark, d):
    h = table(spark, d, "hsps").where("sseqid IS NOT NULL").select("hsp_id", "sseqid", "nident", "length").distinct()
    return h.groupBy("sseqid").agg(F.round(weighted_share(F.col("nident"), F.col("length")), 6).alias("identity_pct"))


def families(spark, d):
    m = table(spark, d, "meta").where("gene IS NOT NULL").select("seqid", "gene", F.coalesce(F.nullif("fam_id", F.lit("")), "gene").alias("fam"))
    h = table(spark, d, "merged_hits").where("identity_pct IS NOT NULL AND NOT isnan(identity_pct)").dropDuplicates(["merged_id"]).select("merged_id", "sseqid", "coverage_pct", "identity_pct", "n_hsps")
    j = h.join(m, F.col("sseqid") == F.col("seqid"))
    return family_collapse(j, [], F.col("fam"), "gene", F.struct("coverage_pct", "identity_pct", "merged_id"), "n_hsps")


def database_concordance(spark, d):
    h = hits(spark, d).where("sample IS NOT NULL AND gene IS NOT NULL")
    c = concordance(h.where("database = 'resbase'"), h.where("database = 'plasdb'"), ["sample"], "gene")
    return c.withColumn("jaccard", F.round("jaccard", 6))


def _primary(spark, d):
    return hits(spark, d).where("primary AND sample IS NOT NULL AND gene IS NOT NULL").withColumn("drug_class", F.coalesce(F.nullif("drug_class", F.lit("")), F.lit("unclassified")))


def matrix_count(spark, d):
    """samples by element types, counts; all samples keep a row."""
    return matrix(_primary(spark, d), "sample", "element_type", cell("count"), rows=table(spark, d, "samples"))


def matrix_genes(spark, d):
    """Distinct genes of each class, databases by element types."""
    return matrix(_primary(spark, d), "database", "element_type", cell("genes"))


def matrix_binary(spark, d):
    return matrix(_primary(spark, d), "gene", "database", cell("binary"))


def matrix_identity(spark, d):
    return matrix(_primary(spark, d), "gene", "database", cell("identity"), absent=None)


def matrix_long_symbol(spark, d):
    return long_matrix(_primary(spark, d).where("identity_pct IS NOT NULL AND coverage_pct IS NOT NULL"), "gene", "database", cell("symbol"))


def class_summary(spark, d):
    return long_matrix(_primary(spark, d).where("element_type = 'AMR'"), "sample", "drug_class", cell("genes"))


def set_operations(spark, d):
    """Genes of both, and of only the first, of two databases."""
    h = table(spark, d, "hits").where("gene IS NOT NULL").select("database", "gene")
    a, b = (h.where(F.col("database") == x).select("gene") for x in ("resbase", "plasdb"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("first")))


QUERIES = {f.__name__: f for f in (records_latest, best_hsp, best_reference, best_hit_fields, genes_top3, shortlist, dedup_first, summary, match_scores, assembly_stats, depth_stats, weighted_identity, families, database_concordance, matrix_count, matrix_genes, matrix_binary, matrix_identity, matrix_long_symbol, class_summary, set_operations)}

_H = "h AS (SELECT * FROM hits WHERE hit_id IS NULL OR true QUALIFY hit_id IS NULL OR row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_PR = _H + ", p AS (SELECT * REPLACE (coalesce(nullif(drug_class, ''), 'unclassified') AS drug_class) FROM h WHERE \"primary\" AND sample IS NOT NULL AND gene IS NOT NULL)"
# The values that become columns, named: a view can't pivot on names that the data give.
_TYPES = ("AMR", "PLASMID", "STRESS", "VIRULENCE")
_DATABASES = ("corecat", "oldargs", "plasdb", "resbase", "stressdb", "vircat")


def _columns(value: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"{value.format(n)} AS {n}" for n in names)


SQL = {
    "records_latest": f"WITH {_H} SELECT hit_id, sample, gene, loaded_at FROM h",
    "best_hsp": "SELECT qseqid, sseqid, bitscore, hsp_id FROM hsps WHERE qseqid <> '' AND NOT isnan(bitscore) QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, pident DESC NULLS LAST, hsp_id) = 1",
    "best_reference": """WITH h AS (SELECT DISTINCT hsp_id, qseqid, sseqid, bitscore FROM hsps WHERE NOT isnan(bitscore)),
t AS (SELECT sample, sseqid, round(sum(bitscore), 1) AS score FROM h JOIN pieces ON qseqid = qid GROUP BY ALL)
SELECT sample, sseqid, score FROM t QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, sseqid) = 1""",
    "best_hit_fields": """SELECT sample, gene, hit_id, identity_pct, coverage_pct FROM (SELECT DISTINCT sample, gene, hit_id, identity_pct, coverage_pct FROM hits WHERE sample IS NOT NULL AND gene IS NOT NULL AND identity_pct IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY sample, gene ORDER BY coverage_pct DESC NULLS LAST, identity_pct DESC, hit_id) = 1""",
    "genes_top3": f"""WITH {_H}, n AS (SELECT drug_class, gene, count(*) AS n FROM h WHERE sample IS NOT NULL AND gene IS NOT NULL GROUP BY ALL)
SELECT drug_class, gene, n, row_number() OVER (PARTITION BY drug_class ORDER BY n DESC, gene)::INT AS place FROM n QUALIFY place <= 3""",
    "shortlist": f"""WITH {_H}, n AS (SELECT sample, database, count(*) AS n FROM h WHERE sample IS NOT NULL AND database IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, database)::INT AS place, max(n) OVER (PARTITION BY sample) AS best FROM n)
SELECT sample, database, n, place FROM r WHERE (place <= 2 AND n >= best - 2) OR database = 'resbase'""",
    "dedup_first": """SELECT hit_id, database, gene, sequence, "start", "end", method, note FROM hits
QUALIFY row_number() OVER (PARTITION BY database, gene, sequence, "start", "end", method, note ORDER BY hit_id, loaded_at) = 1""",
    "summary": f"""WITH {_H} SELECT sample,
{', '.join(f"count(DISTINCT CASE WHEN \"primary\" AND element_type = '{t}' THEN gene END) AS n_{t.lower()}_genes" for t in ('AMR', 'VIRULENCE', 'STRESS', 'PLASMID'))},
count(DISTINCT CASE WHEN "primary" AND element_type = 'AMR' AND drug_class <> '' THEN drug_class END) AS n_classes,
count(*) FILTER ("primary" AND element_type = 'AMR' AND element_subtype = 'POINT' AND method <> 'VARIANTR') AS n_point,
count(*) FILTER (method IN ('VARIANTR', 'ALLELER')) AS n_variants,
count(*) FILTER (element_type = 'AMR' AND method = 'POINTR' AND contains(note, 'HETERORESISTANT')) AS n_hetero
FROM h WHERE sample IS NOT NULL GROUP BY sample""",
    "match_scores": f"WITH {_H} SELECT hit_id, round(coverage_pct * identity_pct / 100.0, 6) AS score FROM h WHERE coverage_pct IS NOT NULL AND identity_pct IS NOT NULL",
    "assembly_stats": """WITH r AS (SELECT sample, length, sum(length) OVER (PARTITION BY sample ORDER BY length DESC, qid, piece_offset ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY sample) AS tot FROM pieces WHERE sample IS NOT NULL AND length > 0)
SELECT sample, count(*) AS n, max(tot)::BIGINT AS total, max(length) AS largest, max(CASE WHEN run * 100 >= tot * 50 THEN length END) AS n50, max(CASE WHEN run * 100 >= tot * 90 THEN length END) AS n90 FROM r GROUP BY sample""",
    "depth_stats": f"WITH {_H} SELECT gene, round(100.0 * count(*) FILTER (depth >= 1) / count(*), 6) AS breadth_pct, round(avg(depth) FILTER (depth >= 1), 6) AS mean_depth FROM h WHERE gene IS NOT NULL GROUP BY gene",
    "weighted_identity": """SELECT sseqid, CASE WHEN sum(length) > 0 THEN round(100.0 * sum(greatest(0, nident)) / sum(length), 6) END AS identity_pct
FROM (SELECT DISTINCT hsp_id, sseqid, nident, length FROM hsps WHERE sseqid IS NOT NULL) GROUP BY sseqid""",
    "families": """WITH m AS (SELECT seqid, gene, coalesce(nullif(fam_id, ''), gene) AS fam FROM meta WHERE gene IS NOT NULL),
h AS (SELECT DISTINCT merged_id, sseqid, coverage_pct, identity_pct, n_hsps FROM merged_hits WHERE NOT isnan(identity_pct)), j AS (SELECT * FROM h JOIN m ON sseqid = seqid),
b AS (SELECT fam, gene FROM j QUALIFY row_number() OVER (PARTITION BY fam ORDER BY coverage_pct DESC NULLS LAST, identity_pct DESC, merged_id DESC) = 1),
n AS (SELECT fam, sum(n_hsps)::BIGINT AS depth, count(DISTINCT gene) AS n_genes, array_to_string(list_sort(list(DISTINCT gene))[1:4], ', ') AS names FROM j GROUP BY fam)
SELECT fam AS family, gene, depth, n_genes, names FROM n JOIN b USING (fam)""",
    "database_concordance": f"""WITH {_H}, a AS (SELECT DISTINCT sample, gene FROM h WHERE database = 'resbase' AND sample IS NOT NULL AND gene IS NOT NULL),
b AS (SELECT DISTINCT sample, gene FROM h WHERE database = 'plasdb' AND sample IS NOT NULL AND gene IS NOT NULL),
f AS (SELECT coalesce(a.sample, b.sample) AS sample, a.gene AS x, b.gene AS y FROM a FULL JOIN b ON a.sample = b.sample AND a.gene = b.gene)
SELECT sample, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b,
round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*), 6) AS jaccard FROM f GROUP BY sample""",
    "matrix_count": f"""WITH {_PR}, s AS (SELECT DISTINCT sample FROM samples WHERE sample IS NOT NULL)
SELECT s.sample, {_columns("count(p.sample) FILTER (element_type = '{0}')", _TYPES)} FROM s LEFT JOIN p ON s.sample = p.sample GROUP BY s.sample""",
    "matrix_genes": f"""WITH {_PR} SELECT database, {_columns("count(DISTINCT gene) FILTER (element_type = '{0}')", _TYPES)}
FROM p WHERE database IS NOT NULL GROUP BY database""",
    "matrix_binary": f"""WITH {_PR} SELECT gene, {_columns("(count(*) FILTER (database = '{0}') > 0)::INT", _DATABASES)}
FROM p WHERE database IS NOT NULL GROUP BY gene""",
    "matrix_identity": f"""WITH {_PR} SELECT gene, {_columns("max(identity_pct) FILTER (database = '{0}')", _DATABASES)}
FROM p WHERE database IS NOT NULL GROUP BY gene""",
    "matrix_long_symbol": f"""WITH {_PR}, b AS (SELECT gene, database, identity_pct AS i, coverage_pct AS c FROM p WHERE identity_pct IS NOT NULL AND coverage_pct IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY gene, database ORDER BY identity_pct DESC, coverage_pct DESC) = 1) SELECT gene, database, printf('%.0f', i) || '/' || printf('%.0f', c) AS value FROM b""",
    "class_summary": f"WITH {_PR} SELECT sample, drug_class, count(DISTINCT gene) AS value FROM p WHERE element_type = 'AMR' GROUP BY ALL",
    "set_operations": """SELECT gene, 'both' AS side FROM (SELECT gene FROM hits WHERE database = 'resbase' AND gene IS NOT NULL INTERSECT SELECT gene FROM hits WHERE database = 'plasdb' AND gene IS NOT NULL)
UNION ALL SELECT gene, 'first' FROM (SELECT gene FROM hits WHERE database = 'resbase' AND gene IS NOT NULL EXCEPT SELECT gene FROM hits WHERE database = 'plasdb' AND gene IS NOT NULL)""",
}
