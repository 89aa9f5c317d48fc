"""Searches, coverage calls, closest alleles, marker variants and calls from reads over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.functions.names import file_format, marker_stem
from strainspark.functions.sequences import revcomp
from strainspark.operators.calls import best_reference, called_genes, closest_alleles, disrupted, divergent, marker_variants, read_stats, reference_coverage
from strainspark.operators.overlap import match_one_to_one
from strainspark.operators.seeds import search
from strainspark.plans.mutations import call_mutations, mutation_summary
from strainspark.queries.joins import merged
from strainspark.queries.ranked import hits
from strainspark.queries.strings import SQL as OF_STRINGS
from strainspark.queries.strings import aligned, consensus_full, reference_lengths, residues
from strainspark.queries.tables import table


def seed_search(spark, d):
    """Each aligned query piece searched in all aligned pieces of references."""
    a = aligned(spark, d)
    x = a.select(F.col("hsp_id").alias("qseqid"), F.col("qseq").alias("seq"))
    y = a.select(F.col("hsp_id").alias("sseqid"), F.col("sseq").alias("seq"))
    m = search(x, y, k=11).groupBy("qseqid", "sseqid").agg(F.max("nident").alias("nident"))
    return m


def reference_calls(spark, d):
    """The reference that each query's merged hits cover most."""
    m = merged(spark, d).where("slen > 0").select("qseqid", "sseqid", "slen", F.inline("subject_intervals"))
    c = reference_coverage(m, ["qseqid"], "sseqid", "lo", "hi", "slen")
    return best_reference(c, ["qseqid"], "sseqid").withColumn("coverage_pct", F.round("coverage_pct", 6))


def allele_matches(spark, d):
    """Full-length consensus of each reference against the aligned reference strings, put at their place in their own
    reference's length (N around them), of the same database and length."""
    database = F.regexp_extract("sseqid", "^(.*)_[^_]*$", 1)
    c = consensus_full(spark, d).select("sseqid", database.alias("database"), F.col("consensus").alias("seq"))
    bare = F.replace("sseq", F.lit("-"))
    lead = F.repeat(F.lit("N"), F.least("sstart", "send") - 1)
    placed = F.concat(lead, F.when(F.col("send") < F.col("sstart"), revcomp(bare)).otherwise(bare))
    a = aligned(spark, d).join(reference_lengths(spark, d), "sseqid", "left")
    a = a.select(database.alias("database"), F.concat_ws("#", "sseqid", "hsp_id").alias("allele"), F.rpad(placed, F.greatest(F.length(placed), F.col("slen")), F.lit("N")).alias("seq"))
    return closest_alleles(c, a, ["sseqid"], "database")


def marker_best(spark, d):
    """Of a sample's genes that are numbered variants of one stem only the best."""
    h = hits(spark, d).where("sample IS NOT NULL AND gene IS NOT NULL AND identity_pct IS NOT NULL AND coverage_pct IS NOT NULL")
    return marker_variants(h, ["sample"], "gene", marker_stem(F.trim("gene")), [F.desc("identity_pct"), F.desc("coverage_pct"), F.col("hit_id")]).select("sample", "gene", "hit_id")


def read_gene_calls(spark, d):
    h = hits(spark, d).where("sample IS NOT NULL AND gene IS NOT NULL AND depth IS NOT NULL AND method = 'READS'")
    c = called_genes(h, ["sample"], "coverage_pct", "identity_pct", "depth", family=F.lower(F.substring("gene", 1, 3)))
    return c.select("sample", "family", "gene", F.round("depth", 4).alias("depth"), "n_genes")


def piece_read_stats(spark, d):
    """Lengths and qualities of the aligned strings as if they were reads, by strand."""
    a = aligned(spark, d).select(F.when(F.col("send") >= F.col("sstart"), "+").otherwise("-").alias("strand"), F.col("qseq").alias("seq"), F.translate("qseq", "ACGT", "I?5+").alias("quality"))
    s = read_stats(a, ["strand"])
    return s.select("strand", "n_reads", F.round("mean_length", 6).alias("mean_length"), F.round("mean_quality", 6).alias("mean_quality"))


def counts_by_type(spark, d):
    """Metadata rows of each class by element type."""
    m = table(spark, d, "meta").where("class <> '' AND element_type IS NOT NULL")
    return m.groupBy(F.upper("class").alias("class")).pivot("element_type", ["AMR", "PLASMID", "STRESS", "VIRULENCE"]).agg(F.count(F.lit(1))).fillna(0)


def catalog(spark, d):
    """Every difference that an alignment shows, as the catalogue."""
    r = residues(spark, d).where("observed <> reference")
    return r.select("sseqid", "position", F.concat("sseqid", F.lit("_"), "reference", F.col("position").cast("string"), "observed").alias("symbol"), F.col("reference").alias("ref"), F.col("observed").alias("alt")).distinct()


def mutation_calls(spark, d):
    return call_mutations(table(spark, d, "hsps"), table(spark, d, "pieces"), catalog(spark, d)).select("sample", "sseqid", "position", "symbol", "observed", "reference", "hsp_id", "mutant")


def mutations_by_sample(spark, d):
    return mutation_summary(call_mutations(table(spark, d, "hsps"), table(spark, d, "pieces"), catalog(spark, d)))


def database_matches(spark, d):
    """Hits of two databases matched one to one by place."""
    h = hits(spark, d).where("sample IS NOT NULL AND sequence <> '' AND start >= 1 AND end >= start").select("hit_id", "database", "sample", "sequence", "start", "end")
    return match_one_to_one(h.where("database = 'resbase'"), h.where("database = 'plasdb'"), ["sample", "sequence"], "start", "end", "hit_id", width=2000)


def disrupted_genes(spark, d):
    """Genes of which a sample's longest single alignment is cut off."""
    m = table(spark, d, "meta").where("gene IS NOT NULL").select(F.col("seqid").alias("sseqid"), "gene").distinct()
    p = table(spark, d, "pieces").where("sample IS NOT NULL").select(F.col("qid").alias("qseqid"), "sample").distinct()
    h = table(spark, d, "hsps").join(m, "sseqid").join(p, "qseqid")
    rules = m.select("gene").distinct().select("gene", F.lit(90.0).alias("min_identity"), F.lit(None).cast("array<string>").alias("organisms"))
    out = disrupted(h, rules, ["sample"])
    return out.select("sample", "gene", F.round("coverage_pct", 6).alias("coverage_pct"))


def divergent_hits(spark, d):
    """Hits below the mean identity of their gene's hits."""
    h = hits(spark, d).where("gene IS NOT NULL AND identity_pct IS NOT NULL")
    c = h.groupBy("gene").agg(F.floor(F.avg("identity_pct")).alias("cutoff"))
    return divergent(h, c, "gene").select("hit_id", "gene", "identity_pct")


def file_formats(spark, d):
    s = table(spark, d, "samples").select(F.explode(F.array_compact(F.array("assembly", "r1", "r2"))).alias("path")).distinct()
    return s.select("path", file_format(F.col("path")).alias("kind"))


QUERIES = {f.__name__: f for f in (seed_search, reference_calls, allele_matches, marker_best, read_gene_calls, piece_read_stats, counts_by_type, mutation_calls, mutations_by_sample, database_matches, disrupted_genes, divergent_hits, file_formats)}

_H = "h AS (SELECT * FROM hits QUALIFY hit_id IS NULL OR row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
SQL = {
    "reference_calls": """WITH e AS (SELECT DISTINCT qseqid, sseqid, slen, unnest(subject_intervals) AS x FROM merged_hits WHERE slen > 0 AND merged_id IS NOT NULL),
i AS (SELECT DISTINCT qseqid, sseqid, least(x.lo, x.hi) AS lo, greatest(x.lo, x.hi) AS hi FROM e WHERE x.lo IS NOT NULL AND x.hi IS NOT NULL),
m AS (SELECT *, lo > max(hi) OVER (PARTITION BY qseqid, sseqid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS fresh FROM i),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY qseqid, sseqid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m), s AS (SELECT qseqid, sseqid, max(hi) - min(lo) + 1 AS n FROM g GROUP BY qseqid, sseqid, g),
n AS (SELECT sseqid, max(slen) AS slen FROM merged_hits WHERE slen > 0 AND merged_id IS NOT NULL GROUP BY sseqid), c AS (SELECT qseqid, sseqid, 100.0 * sum(s.n) / any_value(slen) AS pct FROM s JOIN n USING (sseqid) GROUP BY qseqid, sseqid)
SELECT qseqid, CASE WHEN pct >= 60 THEN sseqid ELSE 'none' END AS call, round(pct, 6) AS coverage_pct FROM c QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY pct DESC, sseqid DESC) = 1""",
    "marker_best": f"""WITH {_H}, v AS (SELECT sample, gene, hit_id, identity_pct, coverage_pct, coalesce(nullif(regexp_extract(trim(gene), '^(.+?)_[0-9]+$', 1), ''), trim(gene)) AS stem FROM h WHERE sample IS NOT NULL AND gene IS NOT NULL AND identity_pct IS NOT NULL AND coverage_pct IS NOT NULL),
n AS (SELECT sample, stem, count(DISTINCT gene) AS k FROM v GROUP BY ALL) SELECT sample, gene, hit_id FROM v JOIN n USING (sample, stem) QUALIFY k = 1 OR row_number() OVER (PARTITION BY sample, stem ORDER BY identity_pct DESC, coverage_pct DESC, hit_id) = 1""",
    "read_gene_calls": f"""WITH {_H}, v AS (SELECT sample, gene, lower(substr(gene, 1, 3)) AS family, coverage_pct, identity_pct, depth FROM h WHERE sample IS NOT NULL AND gene IS NOT NULL AND depth IS NOT NULL AND method = 'READS' AND coverage_pct >= 60 AND identity_pct >= 80),
b AS (SELECT sample, family, gene FROM v QUALIFY row_number() OVER (PARTITION BY sample, family ORDER BY coverage_pct DESC, identity_pct DESC, depth DESC, gene DESC) = 1), n AS (SELECT sample, family, sum(depth) AS depth, count(DISTINCT gene) AS n_genes FROM v GROUP BY ALL)
SELECT sample, family, gene, round(depth, 4) AS depth, n_genes FROM n JOIN b USING (sample, family) WHERE depth >= 5""",
    "piece_read_stats": """WITH a AS (SELECT DISTINCT hsp_id, qseq, CASE WHEN send >= sstart THEN '+' ELSE '-' END AS strand FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL)
SELECT strand, count(*) AS n_reads, round(avg(length(qseq)), 6) AS mean_length, round(sum(list_sum(list_transform(string_split(translate(qseq, 'ACGT', 'I?5+'), ''), lambda x: ascii(x) - 33))) / sum(length(qseq)), 6) AS mean_quality FROM a GROUP BY strand""",
    "mutation_calls": """WITH a AS (SELECT hsp_id, qseqid, sseqid, qseq, sseq, sstart, send, bitscore FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hsp_id) = 1),
i AS (SELECT *, unnest(range(1, length(sseq) + 1)) AS i FROM a), r AS (SELECT hsp_id, qseqid, sseqid, bitscore, (CASE WHEN send < sstart THEN sstart - (i - 1) ELSE sstart + i - 1 END)::INT AS position,
CASE WHEN send < sstart THEN translate(upper(substr(qseq, i, 1)), 'ACGTN', 'TGCAN') ELSE upper(substr(qseq, i, 1)) END AS observed, CASE WHEN send < sstart THEN translate(upper(substr(sseq, i, 1)), 'ACGTN', 'TGCAN') ELSE upper(substr(sseq, i, 1)) END AS reference FROM i),
e AS (SELECT DISTINCT sseqid, position, reference AS ref, observed AS alt FROM r WHERE observed <> reference), v AS (SELECT * FROM r WHERE bitscore IS NOT NULL AND NOT isnan(bitscore)),
p AS (SELECT DISTINCT qid, sample FROM pieces), t AS (SELECT sample, sseqid, qseqid, sum(bitscore) AS total FROM (SELECT DISTINCT hsp_id, qseqid, sseqid, bitscore FROM v) JOIN p ON qid = qseqid GROUP BY ALL),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY sample, sseqid ORDER BY total DESC, qseqid) = 1),
m AS (SELECT b.sample, v.sseqid, v.position, ref, alt, observed, reference, hsp_id, bitscore FROM v JOIN b USING (qseqid, sseqid) JOIN e ON e.sseqid = v.sseqid AND e.position = v.position
QUALIFY row_number() OVER (PARTITION BY b.sample, v.sseqid, v.position, ref, alt ORDER BY bitscore DESC, hsp_id) = 1)
SELECT sample, sseqid, position, sseqid || '_' || ref || position || alt AS symbol, observed, reference, hsp_id, reference = ref AND observed = alt AS mutant FROM m""",
    "disrupted_genes": """WITH m AS (SELECT DISTINCT seqid, gene FROM meta WHERE gene IS NOT NULL), p AS (SELECT DISTINCT qid, sample FROM pieces WHERE sample IS NOT NULL),
b AS (SELECT sample, gene, max(100.0 * (abs(send - sstart) + 1) / slen) AS c FROM hsps JOIN m ON seqid = sseqid JOIN p ON qid = qseqid WHERE slen > 0 AND pident >= 90 GROUP BY ALL)
SELECT sample, gene, round(c, 6) AS coverage_pct FROM b WHERE c >= 20 AND c < 90""",
    "divergent_hits": f"""WITH {_H}, v AS (SELECT hit_id, gene, identity_pct FROM h WHERE gene IS NOT NULL AND identity_pct IS NOT NULL), c AS (SELECT gene, floor(avg(identity_pct)) AS cutoff FROM v GROUP BY gene)
SELECT hit_id, gene, identity_pct FROM v JOIN c USING (gene) WHERE identity_pct < cutoff""",
    "file_formats": "SELECT DISTINCT path, CASE WHEN contains(path, '.fastq') THEN 'fastq' ELSE 'fasta' END AS kind FROM (SELECT unnest([assembly, r1, r2]) AS path FROM samples) WHERE path IS NOT NULL",
    "counts_by_type": """SELECT upper(class) AS class, count(*) FILTER (element_type = 'AMR') AS AMR, count(*) FILTER (element_type = 'PLASMID') AS PLASMID, count(*) FILTER (element_type = 'STRESS') AS STRESS, count(*) FILTER (element_type = 'VIRULENCE') AS VIRULENCE
FROM meta WHERE class <> '' AND element_type IS NOT NULL GROUP BY 1""",
}
SQL["mutations_by_sample"] = f"""SELECT sample, count(*) AS n_sites, count(*) FILTER (mutant) AS n_mutant, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (mutant), '') AS mutants
FROM ({SQL["mutation_calls"]}) GROUP BY sample"""
# Pairs in order, each taken if neither side is: a recursion over the pairs of each contig.
SQL["database_matches"] = f"""WITH RECURSIVE {_H}, v AS (SELECT hit_id, database, sample, sequence, "start" AS lo, "end" AS hi FROM h WHERE sample IS NOT NULL AND sequence <> '' AND "start" >= 1 AND "end" >= "start"),
p AS (SELECT hash(a.sample, a.sequence) AS g, a.hit_id AS a_id, b.hit_id AS b_id, row_number() OVER (PARTITION BY a.sample, a.sequence ORDER BY a.lo, a.hit_id, b.lo, b.hit_id) AS rn
  FROM v a JOIN v b ON a.sample = b.sample AND a.sequence = b.sequence AND a.database = 'resbase' AND b.database = 'plasdb' AND a.lo <= b.hi AND b.lo <= a.hi
  WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 >= 0.5 * least(a.hi - a.lo + 1, b.hi - b.lo + 1)),
f AS (SELECT g, rn, a_id, b_id, [a_id] AS aa, [b_id] AS bb, true AS taken FROM p WHERE rn = 1
  UNION ALL
  SELECT g, rn, a_id, b_id, CASE WHEN ok THEN list_append(aa, a_id) ELSE aa END, CASE WHEN ok THEN list_append(bb, b_id) ELSE bb END, ok FROM (
    SELECT p.*, f.aa, f.bb, NOT list_contains(f.aa, p.a_id) AND NOT list_contains(f.bb, p.b_id) AS ok FROM f JOIN p ON p.g = f.g AND p.rn = f.rn + 1))
SELECT a_id, b_id FROM f WHERE taken"""
SQL["allele_matches"] = f"""WITH full_length AS ({OF_STRINGS["consensus_full"]}), c AS (SELECT sseqid, regexp_extract(sseqid, '^(.*)_[^_]*$', 1) AS database, upper(consensus) AS seq FROM full_length),
l AS (SELECT sseqid, max(slen) AS slen FROM hsps WHERE slen > 0 GROUP BY sseqid),
s AS (SELECT hsp_id, sseqid, replace(sseq, '-', '') AS bare, sstart, send FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hsp_id) = 1),
t AS (SELECT sseqid, hsp_id, slen, repeat('N', least(sstart, send) - 1) || CASE WHEN send < sstart THEN reverse(translate(upper(bare), 'ACGTN', 'TGCAN')) ELSE bare END AS placed FROM s LEFT JOIN l USING (sseqid)),
a AS (SELECT regexp_extract(sseqid, '^(.*)_[^_]*$', 1) AS database, sseqid || '#' || hsp_id AS allele, upper(rpad(placed, greatest(length(placed), coalesce(slen, 0))::INT, 'N')) AS seq FROM t),
m AS (SELECT c.sseqid, c.database, allele, length(c.seq)::INT AS length,
  len(list_filter(range(1, length(c.seq) + 1), lambda i: substr(c.seq, i, 1) = substr(a.seq, i, 1) AND substr(c.seq, i, 1) IN ('A', 'C', 'G', 'T')))::INT AS n_same
  FROM c JOIN a ON a.database = c.database AND length(a.seq) = length(c.seq))
SELECT sseqid, database, allele, n_same, length FROM m QUALIFY row_number() OVER (PARTITION BY sseqid, database ORDER BY n_same DESC, allele) = 1"""
