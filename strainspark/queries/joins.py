"""Joins, overlaps, merged hits, profiles and the whole screen over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.functions.names import gene_key
from strainspark.operators.annotation import fill_from_group, prefix_related, transfer
from strainspark.operators.hsps import merge_hsps
from strainspark.operators.matrix import cell, matrix
from strainspark.operators.overlap import best_cover, greedy_dedup, islands, locus_primary, overlap_pairs
from strainspark.operators.profiles import allele_notation, allele_rank, lookup, nearest, profile, scheme_scores
from strainspark.operators.ranking import best_per_key
from strainspark.plans.screen import annotated, located, screen, thresholds
from strainspark.queries.ranked import hits
from strainspark.queries.strings import key_sql
from strainspark.queries.tables import table
from strainspark.session import materialize


def merged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "merged_hits").dropDuplicates(["merged_id"])


def hits_on_contigs(spark, d):
    return located(merged(spark, d).select("merged_id", "qseqid", "query_start", "query_end"), table(spark, d, "pieces")).select("merged_id", "sample", "contig", "start", "end")


def hits_with_metadata(spark, d):
    return annotated(merged(spark, d).select("merged_id", "sseqid"), table(spark, d, "meta")).select("merged_id", "sseqid", "gene", "drug_class", "element_type")


def hits_over_thresholds(spark, d):
    m = merged(spark, d).withColumn("database", F.regexp_extract("sseqid", r"^(.*)_[^_]*$", 1))
    return thresholds(m.where("NOT isnan(identity_pct)"), {"plasdb": (95.0, 60.0), "vircat": (90.0, 80.0)}).select("merged_id", "database")


def samples_without_hits(spark, d):
    return table(spark, d, "samples").where("sample IS NOT NULL").join(table(spark, d, "hits"), "sample", "left_anti").select("sample").distinct()


def samples_with_virulence(spark, d):
    return table(spark, d, "samples").join(table(spark, d, "hits").where("element_type = 'VIRULENCE'"), "sample", "left_semi").select("sample", "species").distinct()


def annotation_transfer(spark, d):
    """Subclass of each gene from metadata of the same gene key."""
    h = table(spark, d, "hits").where("gene IS NOT NULL").select("gene").distinct()
    k = table(spark, d, "meta").where("gene IS NOT NULL AND subclass IS NOT NULL AND subclass <> ''").select(gene_key(F.col("gene")).alias("key"), "subclass", "element_type")
    return transfer(h.withColumn("keys", F.array(gene_key(F.col("gene")))), "gene", "keys", k, "key", ["subclass", "element_type"])


def species_filled(spark, d):
    """Samples' species, a missing one taken from the assembly's prefix where that has only one."""
    s = table(spark, d, "samples").where("sample IS NOT NULL").select("sample", "species", F.regexp_extract("sample", "^(.*)-", 1).alias("site")).distinct()
    return fill_from_group(s, "site", "species")


def taxon_prefixes(spark, d):
    """Samples whose species and a taxon group (genus, or genus and species) are one the other's prefix."""
    s = table(spark, d, "samples").where("species IS NOT NULL").select("sample", F.replace("species", F.lit(" "), F.lit("_")).alias("taxon")).distinct()
    groups = s.select(F.explode(F.array(F.substring_index("taxon", "_", 1), F.col("taxon"))).alias("taxgroup")).distinct()
    return prefix_related(s, "taxon", groups, "taxgroup")


def database_overlaps(spark, d):
    """Pairs of hits of two databases that overlap on a contig."""
    h = hits(spark, d).where("sample IS NOT NULL AND sequence <> '' AND start >= 1 AND end >= start").select("hit_id", "database", "sample", "sequence", "start", "end")
    p = overlap_pairs(h.where("database = 'resbase'"), h.where("database = 'plasdb'"), ["sample", "sequence"], "start", "end", width=2000)
    return p.select("a_hit_id", "b_hit_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1).alias("shared"))


def covered_points(spark, d):
    """For each merged hit's start the best HSP of that pair that holds it."""
    m = merged(spark, d).where("query_start IS NOT NULL").select("merged_id", "qseqid", "sseqid", "query_start")
    h = table(spark, d, "hsps").where("bitscore IS NOT NULL AND NOT isnan(bitscore)").select("hsp_id", "qseqid", "sseqid", "qstart", "qend", "bitscore").distinct()
    return best_cover(m, h, ["qseqid", "sseqid"], "query_start", "merged_id", "qstart", "qend", [F.desc("bitscore"), F.col("hsp_id")], fields=["hsp_id", "bitscore"]).select("merged_id", "hsp_id", "bitscore")


def hsp_clusters(spark, d):
    """Runs of a query's HSPs on one reference that lie within 500 bases."""
    h = table(spark, d, "hsps").where("qseqid <> '' AND sseqid IS NOT NULL").select("hsp_id", "qseqid", "sseqid", F.least("qstart", "qend").alias("lo"), F.greatest("qstart", "qend").alias("hi")).distinct()
    return islands(h, ["qseqid", "sseqid"], "lo", "hi", gap=500, out="cluster").groupBy("qseqid", "sseqid", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))


def _called(spark, d):
    return hits(spark, d).where("sample IS NOT NULL AND sequence <> '' AND start >= 1 AND end >= start AND bitscore IS NOT NULL")


def greedy_hits(spark, d):
    """Hits of each database of which no better one on the contig overlaps half."""
    return greedy_dedup(_called(spark, d), ["database", "sample", "sequence"], "start", "end", "hit_id", [(F.col("bitscore"), "desc")]).select("hit_id")


def primary_hits(spark, d):
    """One primary hit of each place on a contig over all databases."""
    h = _called(spark, d).where("resolution <> 'POINT' AND method NOT IN ('READS', 'POINTR')")
    rank = [F.when(F.col("database") == "resbase", 2).when(F.col("database") == "corecat", 1).otherwise(0), (F.col("resolution") == "COMPLETE").cast("int"), (F.coalesce("drug_class", F.lit("")) != "").cast("int"), F.col("coverage_pct"), F.col("identity_pct")]
    return locus_primary(h, ["sample", "sequence", "element_type"], "start", "end", "hit_id", rank).select("hit_id", "is_primary")


def hsps_merged(spark, d):
    m = merge_hsps(table(spark, d, "hsps"))
    return m.select("qseqid", "sseqid", "strand", "query_start", "query_end", "covered_bases", F.round("identity_pct", 6).alias("identity_pct"), F.round("bitscore", 3).alias("bitscore"), "n_hsps", F.size("subject_intervals").alias("n_intervals"))


def screen_hits(spark, d):
    s = screen(table(spark, d, "hsps"), table(spark, d, "pieces"), table(spark, d, "meta"))
    return s.withColumn("identity_pct", F.round("identity_pct", 6)).withColumn("coverage_pct", F.round("coverage_pct", 6)).withColumn("bitscore", F.round("bitscore", 3))


def screen_matrix(spark, d):
    """Samples by element types from the screen: the flagship. All samples keep a row."""
    s = screen(table(spark, d, "hsps"), table(spark, d, "pieces"), table(spark, d, "meta")).where("element_type <> ''")
    return matrix(s, "sample", "element_type", cell("genes"), columns=["AMR", "PLASMID", "STRESS", "VIRULENCE"], rows=table(spark, d, "samples"))


def allele_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's best gene of each database, as the allele of that locus."""
    h = hits(spark, d).where("sample IS NOT NULL AND database IS NOT NULL AND gene IS NOT NULL AND identity_pct IS NOT NULL AND coverage_pct IS NOT NULL")
    return best_per_key(h, ["sample", "database"], [F.desc("coverage_pct"), F.desc("identity_pct"), allele_rank(F.col("gene")), F.col("hit_id")]).select("sample", F.col("database").alias("locus"), F.trim("gene").alias("allele"), "identity_pct", "coverage_pct")


def species_profiles(calls: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """The most frequent allele of each locus among a species' samples."""
    s = table(spark, d, "samples").where("species IS NOT NULL").select("sample", "species").distinct()
    n = calls.join(s, "sample").groupBy("species", "locus", "allele").agg(F.count(F.lit(1)).alias("n"))
    return best_per_key(n, ["species", "locus"], [F.desc("n"), F.col("allele")]).select(F.col("species").alias("st"), "locus", "allele", F.substring_index("species", " ", 1).alias("genus"))


def profile_strings(spark, d):
    return profile(allele_calls(spark, d), ["sample"], "locus", "allele")


def allele_notations(spark, d):
    return allele_calls(spark, d).select("sample", "locus", allele_notation(F.col("allele"), F.col("identity_pct"), F.col("coverage_pct")).alias("call"))


def profile_lookup(spark, d):
    """The species whose profile a sample's calls are, up to four loci without a call."""
    calls = materialize(allele_calls(spark, d), "allele-calls")
    return lookup(calls, species_profiles(calls, spark, d), "sample", "st", "locus", "allele", missing=4)


def profile_exact(spark, d):
    """Samples with the same calls at all loci as one of the profiles: those of the first sample of each profile string."""
    calls = materialize(allele_calls(spark, d), "allele-calls")
    first = profile(calls, ["sample"], "locus", "allele").groupBy("profile").agg(F.min("sample").alias("st"))
    profiles = calls.join(first.select(F.col("st").alias("sample")), "sample").select(F.col("sample").alias("st"), "locus", "allele")
    return lookup(calls, profiles, "sample", "st", "locus", "allele")


def profile_nearest(spark, d):
    calls = materialize(allele_calls(spark, d), "allele-calls")
    return nearest(calls, species_profiles(calls, spark, d), "sample", "st", "locus", "allele", lineage="genus", differ=5)


def scheme_ranks(spark, d):
    """Databases as schemes, classes as loci: how completely each sample has them."""
    h = hits(spark, d).where("sample IS NOT NULL AND database IS NOT NULL AND drug_class IS NOT NULL AND identity_pct IS NOT NULL AND coverage_pct IS NOT NULL")
    best = best_per_key(h, ["sample", "database", "drug_class"], [F.desc("coverage_pct"), F.desc("identity_pct"), F.col("hit_id")])
    loci = h.select("database", "drug_class").distinct()
    s = scheme_scores(best, loci, ["sample"], "database", "drug_class", "identity_pct", "coverage_pct")
    return s.select("sample", "database", "n_found", "n_exact", "n_full", "n_loci", "accepted", F.round("mean_identity", 6).alias("mean_identity"))


QUERIES = {f.__name__: f for f in (hits_on_contigs, hits_with_metadata, hits_over_thresholds, samples_without_hits, samples_with_virulence, annotation_transfer, species_filled, taxon_prefixes, database_overlaps, covered_points, hsp_clusters, greedy_hits, primary_hits, hsps_merged, screen_hits, screen_matrix, profile_strings, allele_notations, profile_lookup, profile_exact, profile_nearest, scheme_ranks)}

_M = "m AS (SELECT * FROM merged_hits QUALIFY merged_id IS NOT NULL AND row_number() OVER (PARTITION BY merged_id) = 1)"
_H = "h AS (SELECT * FROM hits QUALIFY hit_id IS NULL OR row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_CALLS = _H + """, c0 AS (SELECT sample, database AS locus, gene, trim(gene) AS allele, identity_pct, coverage_pct, hit_id, try_cast(gene AS BIGINT) AS n FROM h WHERE sample IS NOT NULL AND database IS NOT NULL AND gene IS NOT NULL AND identity_pct IS NOT NULL AND coverage_pct IS NOT NULL),
c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY sample, locus ORDER BY coverage_pct DESC, identity_pct DESC, CASE WHEN n IS NOT NULL THEN 0 WHEN length(gene) > 0 THEN 1 ELSE 2 END, coalesce(n, 0), gene, hit_id) = 1)"""
_PROF = _CALLS + """, sp AS (SELECT DISTINCT sample, species FROM samples WHERE species IS NOT NULL), pn AS (SELECT species AS st, locus, allele, count(*) AS k FROM c JOIN sp USING (sample) GROUP BY ALL),
p AS (SELECT st, locus, allele FROM pn QUALIFY row_number() OVER (PARTITION BY st, locus ORDER BY k DESC, allele) = 1), np AS (SELECT st, count(*) AS loci FROM p GROUP BY st), nc AS (SELECT sample, count(*) AS calls FROM c GROUP BY sample),
sh AS (SELECT sample, st, count(*) AS n_shared FROM c JOIN p USING (locus, allele) GROUP BY ALL), x AS (SELECT * FROM sh JOIN np USING (st) JOIN nc USING (sample))"""
SQL = {
    "hits_on_contigs": f"WITH {_M}, p AS (SELECT DISTINCT qid, sample, contig, piece_offset FROM pieces) SELECT merged_id, sample, contig, query_start + coalesce(piece_offset, 0) AS start, query_end + coalesce(piece_offset, 0) AS \"end\" FROM m JOIN p ON qseqid = qid",
    "hits_with_metadata": f"WITH {_M}, t AS (SELECT DISTINCT seqid, gene, class, element_type FROM meta) SELECT merged_id, sseqid, coalesce(gene, '') AS gene, coalesce(class, '') AS drug_class, coalesce(element_type, '') AS element_type FROM m LEFT JOIN t ON sseqid = seqid",
    "hits_over_thresholds": """WITH t AS (SELECT DISTINCT merged_id, regexp_extract(sseqid, '^(.*)_[^_]*$', 1) AS database, identity_pct AS i, coverage_pct AS c FROM merged_hits WHERE identity_pct IS NOT NULL AND NOT isnan(identity_pct))
SELECT merged_id, database FROM t WHERE i >= CASE database WHEN 'plasdb' THEN 95 WHEN 'vircat' THEN 90 ELSE 80 END AND c >= CASE database WHEN 'vircat' THEN 80 ELSE 60 END""",
    "samples_without_hits": "SELECT DISTINCT sample FROM samples WHERE sample IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.sample = samples.sample)",
    "samples_with_virulence": "SELECT DISTINCT sample, species FROM samples WHERE sample IN (SELECT sample FROM hits WHERE element_type = 'VIRULENCE' AND sample IS NOT NULL)",
    "species_filled": """WITH s AS (SELECT DISTINCT sample, species, regexp_extract(sample, '^(.*)-', 1) AS site FROM samples WHERE sample IS NOT NULL), u AS (SELECT site, min(species) AS fill FROM s WHERE species IS NOT NULL GROUP BY site HAVING count(DISTINCT species) = 1)
SELECT sample, coalesce(species, fill) AS species, site FROM s LEFT JOIN u USING (site)""",
    "taxon_prefixes": """WITH s AS (SELECT DISTINCT sample, replace(species, ' ', '_') AS taxon FROM samples WHERE species IS NOT NULL), g AS (SELECT DISTINCT taxon AS taxgroup FROM s UNION SELECT DISTINCT string_split(taxon, '_')[1] FROM s)
SELECT sample, taxon, taxgroup FROM s JOIN g ON taxon = taxgroup OR starts_with(taxon, taxgroup || '_') OR starts_with(taxgroup, taxon || '_')""",
    "database_overlaps": f"""WITH {_H}, o AS (SELECT hit_id, database, sample, sequence, "start" AS lo, "end" AS hi FROM h WHERE sample IS NOT NULL AND sequence <> '' AND "start" >= 1 AND "end" >= "start")
SELECT a.hit_id AS a_hit_id, b.hit_id AS b_hit_id, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS shared FROM o a JOIN o b ON a.sample = b.sample AND a.sequence = b.sequence AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.database = 'resbase' AND b.database = 'plasdb'""",
    "covered_points": f"""WITH {_M}, p AS (SELECT DISTINCT hsp_id, qseqid, sseqid, qstart, qend, bitscore FROM hsps WHERE bitscore IS NOT NULL AND NOT isnan(bitscore))
SELECT merged_id, hsp_id, p.bitscore FROM m JOIN p USING (qseqid, sseqid) WHERE query_start BETWEEN qstart AND qend QUALIFY row_number() OVER (PARTITION BY merged_id ORDER BY p.bitscore DESC, hsp_id) = 1""",
    "hsp_clusters": """WITH t AS (SELECT DISTINCT hsp_id, qseqid, sseqid, least(qstart, qend) AS lo, greatest(qstart, qend) AS hi FROM hsps WHERE qseqid <> '' AND sseqid IS NOT NULL),
n AS (SELECT *, coalesce(lo - max(hi) OVER (PARTITION BY qseqid, sseqid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 500, true) AS fresh FROM t),
k AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY qseqid, sseqid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS cluster FROM n) SELECT qseqid, sseqid, cluster, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM k GROUP BY ALL""",
    "profile_strings": f"WITH {_CALLS} SELECT sample, string_agg(locus || '(' || allele || ')', ' ' ORDER BY locus) AS profile FROM c GROUP BY sample",
    "allele_notations": f"WITH {_CALLS} SELECT sample, locus, CASE WHEN identity_pct >= 100 AND coverage_pct >= 100 THEN allele WHEN coverage_pct >= 100 THEN '~' || allele ELSE allele || '?' END AS call FROM c",
    "profile_exact": f"""WITH {_CALLS}, w AS (SELECT sample, string_agg(locus || '(' || allele || ')', ' ' ORDER BY locus) AS p FROM c GROUP BY sample)
SELECT sample, min(sample) OVER (PARTITION BY p) AS st, '' AS rivals FROM w""",
    "profile_lookup": f"""WITH {_PROF}, f AS (SELECT sample, list_sort(list(st)) AS l FROM x WHERE n_shared = calls AND loci - n_shared <= 4 GROUP BY sample)
SELECT s.sample, l[1] AS st, coalesce(array_to_string(l[2:], ', '), '') AS rivals FROM (SELECT DISTINCT sample FROM c) s LEFT JOIN f USING (sample)""",
    "profile_nearest": f"""WITH {_PROF}, t AS (SELECT *, string_split(st, ' ')[1] AS genus FROM x QUALIFY rank() OVER (PARTITION BY sample ORDER BY n_shared DESC) = 1)
SELECT sample, min(st) AS st, max(n_shared) AS n_shared, count(*) AS n_equal, CASE WHEN count(DISTINCT genus) = 1 THEN min(genus) END AS lineage FROM t WHERE n_shared >= loci - 5 GROUP BY sample""",
    "scheme_ranks": f"""WITH {_H}, v AS (SELECT * FROM h WHERE sample IS NOT NULL AND database IS NOT NULL AND drug_class IS NOT NULL AND identity_pct IS NOT NULL AND coverage_pct IS NOT NULL), l AS (SELECT database, count(DISTINCT drug_class) AS n_loci FROM v GROUP BY database),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY sample, database, drug_class ORDER BY coverage_pct DESC, identity_pct DESC, hit_id) = 1)
SELECT sample, database, count(*) AS n_found, count(*) FILTER (coverage_pct >= 100 AND identity_pct >= 100) AS n_exact, count(*) FILTER (coverage_pct >= 100) AS n_full, max(n_loci) AS n_loci,
count(*) FILTER (coverage_pct >= 100 AND identity_pct >= 100) >= greatest(2, max(n_loci) // 2) AS accepted, round(avg(identity_pct), 6) AS mean_identity FROM b JOIN l USING (database) GROUP BY sample, database""",
}

# Rules that read rows in order: a recursion that takes the next row of every group at each step.
_CALLED = """v AS (SELECT hit_id, database, sample, sequence, "start" AS lo, "end" AS hi, bitscore, resolution, method, element_type, drug_class, coverage_pct, identity_pct FROM h
  WHERE sample IS NOT NULL AND sequence <> '' AND "start" >= 1 AND "end" >= "start" AND bitscore IS NOT NULL AND hit_id IS NOT NULL)"""
_GREEDY = """f AS (SELECT g, rn, id, [{{'lo': lo, 'hi': hi}}] AS kept, true AS keep FROM o WHERE rn = 1
  UNION ALL
  SELECT g, rn, id, CASE WHEN clash THEN kept ELSE list_append(kept, {{'lo': lo, 'hi': hi}}) END, NOT clash FROM (
    SELECT o.g, o.rn, o.id, o.lo, o.hi, f.kept,
      len(list_filter(f.kept, lambda k: greatest(0, least(k.hi, o.hi) - greatest(k.lo, o.lo) + 1) >= {share} * greatest(1, o.hi - o.lo + 1))) > 0 AS clash
    FROM f JOIN o ON o.g = f.g AND o.rn = f.rn + 1))"""
SQL["greedy_hits"] = f"""WITH RECURSIVE {_H}, {_CALLED},
o AS (SELECT hash(database, sample, sequence) AS g, hit_id AS id, lo, hi, row_number() OVER (PARTITION BY database, sample, sequence ORDER BY bitscore DESC, hit_id) AS rn FROM v),
{_GREEDY.format(share=0.5)}
SELECT id AS hit_id FROM f WHERE keep"""
SQL["primary_hits"] = f"""WITH RECURSIVE {_H}, {_CALLED}, w AS (SELECT * FROM v WHERE resolution <> 'POINT' AND method NOT IN ('READS', 'POINTR')),
o AS (SELECT hash(sample, sequence, element_type) AS g, hit_id AS id, lo, hi,
  [CASE database WHEN 'resbase' THEN 2.0 WHEN 'corecat' THEN 1.0 ELSE 0.0 END, (resolution = 'COMPLETE')::INT::DOUBLE, (coalesce(drug_class, '') <> '')::INT::DOUBLE,
   coalesce(coverage_pct, 0.0), coalesce(identity_pct, 0.0)] AS r,
  row_number() OVER (PARTITION BY sample, sequence, element_type ORDER BY lo, hi, hit_id) AS rn FROM w),
f AS (SELECT g, rn, [{{'lo': lo, 'hi': hi, 'id': id, 'r': r}}] AS claimed, NULL::BIGINT AS lost FROM o WHERE rn = 1
  UNION ALL
  SELECT g, rn, CASE WHEN place = 0 THEN list_append(c, rec) WHEN r > c[place].r THEN list_concat(list_append(c[1:place - 1], rec), c[place + 1:]) ELSE c END,
    CASE WHEN place = 0 THEN NULL WHEN r > c[place].r THEN c[place].id ELSE id END FROM (
    SELECT *, {{'lo': lo, 'hi': hi, 'id': id, 'r': r}} AS rec,
      coalesce(list_position(list_transform(c, lambda p: least(p.hi, hi) - greatest(p.lo, lo) + 1 >= 0.6 * least(greatest(1, hi - lo + 1), greatest(1, p.hi - p.lo + 1))), true), 0) AS place FROM (
      SELECT o.*, list_filter(f.claimed, lambda p: p.hi >= o.lo) AS c FROM f JOIN o ON o.g = f.g AND o.rn = f.rn + 1)))
SELECT hit_id, hit_id NOT IN (SELECT lost FROM f WHERE lost IS NOT NULL) AS is_primary FROM w"""
# HSPs of a copy by falling score: those that add reference and fit the extent are taken.
_HSPS = """t AS (SELECT qseqid, sseqid, coalesce(strand, '+') AS strand, slen, coalesce(qlen, 0) AS qlen, least(sstart, send) AS s_lo, greatest(sstart, send) AS s_hi, least(qstart, qend) AS q_lo,
  greatest(qstart, qend) AS q_hi, coalesce(length, 0) AS length, coalesce(nident, 0) AS nident, coalesce(gaps, 0) AS gaps, bitscore, coalesce(evalue, 0.0) AS evalue, hsp_id FROM hsps
  WHERE {least} qseqid <> '' AND sseqid IS NOT NULL AND slen IS NOT NULL AND hsp_id IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(bitscore)
  AND qstart IS NOT NULL AND qend IS NOT NULL AND sstart IS NOT NULL AND send IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hsp_id) = 1),
a AS (SELECT *, coalesce(q_lo - max(q_hi) OVER (PARTITION BY qseqid, sseqid, strand ORDER BY q_lo, q_hi, hsp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2 * slen + 5000, false) AS apart FROM t),
b AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY qseqid, sseqid, strand ORDER BY q_lo, q_hi, hsp_id ROWS UNBOUNDED PRECEDING) AS copy FROM a),
n AS (SELECT *, dense_rank() OVER (ORDER BY qseqid, sseqid, strand, copy) AS g, row_number() OVER (PARTITION BY qseqid, sseqid, strand, copy ORDER BY bitscore DESC, hsp_id) AS rn FROM b),
x AS (SELECT g, rn, [{{'lo': s_lo, 'hi': s_hi}}] AS spans, slen, q_lo, q_hi, evalue, nident::DOUBLE AS matched, length::DOUBLE AS aligned, gaps::BIGINT AS gaps, bitscore AS bits FROM n WHERE rn = 1
  UNION ALL
  SELECT g, rn, CASE WHEN ok THEN list_append(spans, {{'lo': s_lo, 'hi': s_hi}}) ELSE spans END, slen, CASE WHEN ok THEN least(x_lo, q_lo) ELSE x_lo END, CASE WHEN ok THEN greatest(x_hi, q_hi) ELSE x_hi END,
    CASE WHEN ok THEN least(x_e, evalue) ELSE x_e END, CASE WHEN ok THEN matched + nident * fresh ELSE matched END, CASE WHEN ok THEN aligned + length * fresh ELSE aligned END,
    CASE WHEN ok THEN x_gaps + gaps ELSE x_gaps END, CASE WHEN ok THEN bits + bitscore ELSE bits END FROM (
    SELECT *, coalesce(list_max(shared), 0) <= 0.5 * own AND greatest(q_hi, x_hi) - least(q_lo, x_lo) + 1 <= 2 * slen + 5000 AS ok, greatest(0, own - list_sum(shared)) / own AS fresh FROM (
      SELECT n.g, n.rn, n.s_lo, n.s_hi, n.q_lo, n.q_hi, n.length, n.nident, n.gaps, n.bitscore, n.evalue, x.slen, x.spans, x.q_lo AS x_lo, x.q_hi AS x_hi, x.evalue AS x_e, x.matched, x.aligned, x.gaps AS x_gaps,
        x.bits, n.s_hi - n.s_lo + 1 AS own, list_transform(x.spans, lambda p: greatest(0, least(n.s_hi, p.hi) - greatest(n.s_lo, p.lo) + 1)) AS shared
      FROM x JOIN n ON n.g = x.g AND n.rn = x.rn + 1))),
z AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY rn DESC) = 1),
one AS (SELECT g, qseqid, sseqid, strand FROM n WHERE rn = 1),
e AS (SELECT g, unnest(spans) AS p FROM z), e1 AS (SELECT g, p.lo AS lo, p.hi AS hi FROM e),
e2 AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS new FROM e1),
e3 AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM e2),
e4 AS (SELECT g, k, min(lo) AS lo, max(hi) AS hi FROM e3 GROUP BY g, k),
cov AS (SELECT g, sum(hi - lo + 1)::INT AS covered_bases, count(*)::INT AS n_intervals, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS spans_text FROM e4 GROUP BY g),
merged AS (SELECT qseqid, sseqid, strand, slen, q_lo AS query_start, q_hi AS query_end, covered_bases, CASE WHEN aligned > 0 THEN 100.0 * matched / aligned ELSE 0.0 END AS identity_pct, bits AS bitscore, gaps,
  len(spans)::INT AS n_hsps, n_intervals, spans_text, CASE WHEN slen <> 0 THEN 100.0 * covered_bases / slen ELSE 0.0 END AS coverage_pct FROM z JOIN one USING (g) JOIN cov USING (g)
  QUALIFY row_number() OVER (PARTITION BY qseqid, sseqid, q_lo // 10000 ORDER BY bits DESC, q_lo, strand) = 1)"""
SQL["hsps_merged"] = f"""WITH RECURSIVE {_HSPS.format(least='')}
SELECT qseqid, sseqid, strand, query_start, query_end, covered_bases, round(identity_pct, 6) AS identity_pct, round(bitscore, 3) AS bitscore, n_hsps, n_intervals FROM merged"""
_SCREEN = f"""{_HSPS.format(least='pident >= 75 AND')},
pc AS (SELECT qid, min({{'sample': sample, 'contig': contig, 'o': coalesce(piece_offset, 0)}}) AS p FROM pieces WHERE qid IS NOT NULL GROUP BY qid),
md AS (SELECT seqid, min({{'g': gene, 'a': accession, 'p': product, 'c': class, 's': subclass, 't': element_type, 'u': element_subtype}}) AS m FROM meta GROUP BY seqid),
sf AS (SELECT merged.*, regexp_extract(sseqid, '^(.*)_[^_]*$', 1) AS database, pc.p.sample AS sample, pc.p.contig AS contig, query_start + pc.p.o AS lo, query_end + pc.p.o AS hi, coalesce(m.g, '') AS gene,
  coalesce(m.a, '') AS accession, coalesce(m.p, '') AS product, coalesce(m.t, '') AS element_type, coalesce(m.u, '') AS element_subtype, coalesce(m.c, '') AS drug_class, coalesce(m.s, '') AS subclass,
  qseqid || '|' || sseqid || '|' || query_start || '|' || strand AS hit FROM merged JOIN pc ON qid = qseqid LEFT JOIN md ON seqid = sseqid WHERE identity_pct >= 80 AND coverage_pct >= 60),
sk AS (SELECT *, coalesce(list_aggregate(list_transform(regexp_extract_all(gene, '([0-9]+|[^0-9])', 1), lambda y: CASE WHEN regexp_matches(y, '^[0-9]') THEN '~' || lpad(y::BIGINT::VARCHAR, 38, '0') ELSE repeat('0', 38) || y END), 'string_agg', ''), '') AS nk FROM sf),
o AS (SELECT hash(database, sample, contig) AS g, hit AS id, lo, hi, row_number() OVER (PARTITION BY database, sample, contig ORDER BY bitscore DESC, nk, hit) AS rn FROM sk),
{_GREEDY.format(share=0.5)},
screened AS (SELECT sk.* FROM sk JOIN f ON f.id = sk.hit AND f.keep)"""
SQL["screen_hits"] = f"""WITH RECURSIVE {_SCREEN}
SELECT sample, database, gene, accession, product, element_type, element_subtype, drug_class, subclass, contig AS sequence, lo AS "start", hi AS "end", strand, spans_text || '/' || slen AS coverage,
round(coverage_pct, 6) AS coverage_pct, round(identity_pct, 6) AS identity_pct, gaps::INT AS gaps, round(bitscore, 3) AS bitscore, CASE WHEN coverage_pct >= 100 THEN 'BLASTN' ELSE 'PARTIALN' END AS method,
CASE WHEN coverage_pct >= 100 THEN 'COMPLETE' ELSE 'PARTIAL' END AS resolution FROM screened"""
SQL["screen_matrix"] = f"""WITH RECURSIVE {_SCREEN}, own AS (SELECT DISTINCT sample FROM samples WHERE sample IS NOT NULL)
SELECT own.sample, {", ".join(f"count(DISTINCT CASE WHEN element_type = '{t}' THEN gene END) AS {t}" for t in ("AMR", "PLASMID", "STRESS", "VIRULENCE"))}
FROM own LEFT JOIN screened s ON s.sample = own.sample GROUP BY own.sample"""
SQL["annotation_transfer"] = f"""WITH g AS (SELECT DISTINCT gene FROM hits WHERE gene IS NOT NULL), h AS (SELECT gene, {key_sql('gene')} AS key FROM g),
m AS (SELECT {key_sql('gene')} AS key, min({{'s': subclass, 't': element_type}}) AS x FROM meta WHERE gene IS NOT NULL AND subclass IS NOT NULL AND subclass <> '' GROUP BY 1)
SELECT gene, m.x.s AS subclass, m.x.t AS element_type FROM h JOIN m USING (key)"""
