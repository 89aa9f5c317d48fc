"""Functions of sequences, names and numbers over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strainspark.functions import names, sequences, stats
from strainspark.operators.alleles import allele_fractions, base_counts, consensus
from strainspark.operators.sketch import distances, sketches
from strainspark.queries.tables import table

#: Words of a product, first match first, and the class that they stand for.
KEYWORDS = (("efflux", "EFFLUX"), ("permease", "TRANSPORT"), ("kinase", "SIGNAL"), ("transferase", "TRANSFER"), ("methylase", "TRANSFER"), ("repressor", "REGULATION"), ("toxin", "TOXIN"))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hsps").where("qseq IS NOT NULL AND sseq IS NOT NULL").dropDuplicates(["hsp_id"]).select("hsp_id", "sseqid", "qseq", "sseq", "sstart", "send")


def revcomp(spark, d):
    return aligned(spark, d).select("hsp_id", sequences.revcomp(F.col("qseq")).alias("other"), sequences.complement(F.col("qseq")).alias("facing"))


def translated(spark, d):
    a = aligned(spark, d)
    return a.select("hsp_id", sequences.translate_codons(F.col("sseq")).alias("peptide"), sequences.looks_like_cds(F.col("sseq")).alias("is_cds"))


def composition(spark, d):
    a = aligned(spark, d)
    return a.select("hsp_id", sequences.count_of(F.col("qseq"), "GC").cast("bigint").alias("n_gc"), F.round(sequences.gc_percent(F.col("qseq")), 6).alias("gc_pct"), sequences.phred_sum(F.col("qseq")).alias("codes"))


def residues(spark, d):
    a = aligned(spark, d)
    return a.select("hsp_id", "sseqid", F.inline(sequences.aligned_residues(F.col("qseq"), F.col("sseq"), F.col("sstart"), F.col("send"))))


def alignment_walk(spark, d):
    """Places at which the query differs from the reference."""
    return residues(spark, d).where("observed <> reference").select("hsp_id", "position", "observed", "reference")


def mutation_symbols(spark, d):
    """Differences as symbols, parsed again, with their kind and whether they are what is aligned."""
    r = residues(spark, d).where("observed <> reference").join(table(spark, d, "meta").select(F.col("seqid").alias("sseqid"), "gene"), "sseqid")
    r = r.withColumn("symbol", F.concat("gene", F.lit("_"), "reference", F.col("position").cast("string"), "observed"))
    p = r.select("*", names.parse_symbol(F.col("symbol")).alias("p"))
    return p.select("hsp_id", "position", "symbol", F.col("p.gene").alias("parsed_gene"), F.col("p.ref").alias("ref"), F.col("p.alt").alias("alt"), F.col("p.position").alias("parsed_position"), names.change_type(F.col("p.ref"), F.col("p.alt")).alias("change"), names.is_mutant(F.col("p.ref"), F.col("p.alt"), F.col("observed"), F.col("reference")).alias("mutant"))


def codon_changes(spark, d):
    r = residues(spark, d).where("observed <> reference").join(aligned(spark, d).select("hsp_id", "sseq", "sstart", "send"), "hsp_id")
    bare = F.replace("sseq", F.lit("-"))
    forward = F.when(F.col("send") < F.col("sstart"), sequences.revcomp(bare)).otherwise(bare)
    c = r.select("hsp_id", "position", sequences.codon_change(forward, F.col("position") - F.least("sstart", "send") + 1, F.col("observed")).alias("c"))
    return c.where("c IS NOT NULL").select("hsp_id", "position", "c.*")


def site_counts(spark, d):
    """Base counts at each covered place of each reference."""
    r = residues(spark, d).withColumn("token", F.when(F.col("observed") == "-", "*").otherwise(F.col("observed")))
    return base_counts(r, ["sseqid", "position"], "token")


def consensus_sequences(spark, d):
    """The covered places only, without those between them; consensus_full has all places."""
    return consensus(site_counts(spark, d), ["sseqid"], "position", "base", "depth")


def reference_lengths(spark, d):
    return table(spark, d, "hsps").where("slen > 0").groupBy("sseqid").agg(F.max("slen").alias("slen"))


def consensus_full(spark, d):
    """Consensus in each reference's own length, N where nothing is aligned."""
    s = site_counts(spark, d).join(reference_lengths(spark, d), "sseqid", "left")
    return consensus(s, ["sseqid"], "position", "base", "depth", length="slen")


def site_fractions(spark, d):
    """Share of the rows that differ at each covered place, its p-value and status."""
    f = allele_fractions(residues(spark, d), ["sseqid", "position"], F.col("observed") != F.col("reference"), min_depth=2)
    return f.withColumn("fraction", F.round("fraction", 6)).withColumn("p_value", F.round("p_value", 9))


def binomial_tail(spark, d):
    """How unlikely each sample's share of partial hits is if a third of hits were partial: log10."""
    h = table(spark, d, "hits").where("sample IS NOT NULL").dropDuplicates(["hit_id"]).groupBy("sample").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("resolution") == "PARTIAL").cast("int").alias("k"))
    return h.select("sample", "n", "k", F.round(F.log10(stats.binomial_upper_tail(F.col("k"), F.col("n"), 1 / 3)), 6).alias("log10_p"))


def sequence_distances(spark, d):
    """Distance between what was seen of each reference and other references, over shared k-mers."""
    a = aligned(spark, d)
    x = sketches(a.select("sseqid", "qseq"), "sseqid", "qseq", k=11, size=200)
    y = sketches(a.select(F.col("sseqid").alias("reference"), "sseq"), "reference", "sseq", k=11, size=200)
    out = distances(x, y, "sseqid", "reference", k=11, size=200)
    return out.withColumn("jaccard", F.round("jaccard", 6)).withColumn("distance", F.round("distance", 6))


def natural_sort(spark, d):
    """Genes in their natural order: numbers by value."""
    g = table(spark, d, "meta").where("gene IS NOT NULL").select("gene").distinct()
    bucket = F.lower(F.substring("gene", 1, 1))
    return g.select("gene", bucket.alias("initial"), F.row_number().over(Window.partitionBy(bucket).orderBy(names.natural_key(F.col("gene")))).alias("place"))


def gene_keys(spark, d):
    g = table(spark, d, "meta").where("gene IS NOT NULL").select("gene").distinct()
    return g.select("gene", names.gene_key(F.col("gene")).alias("key"), F.array_join(names.lookup_keys(F.col("gene")), ",").alias("keys"), names.marker_stem(F.col("gene")).alias("stem"))


def inferred_classes(spark, d):
    m = table(spark, d, "meta").where("product IS NOT NULL").select("product").distinct()
    return m.select("product", names.infer_class(F.col("product"), KEYWORDS).alias("kind"), names.is_multicopy_rrna(F.col("product")).alias("rrna"))


def headers(spark, d):
    m = table(spark, d, "meta").where("gene IS NOT NULL AND accession IS NOT NULL AND product IS NOT NULL").select("seqid", F.concat_ws("~~~", F.lit("db"), "gene", "accession", "product").alias("header"))
    return m.select("seqid", names.parse_header(F.col("header")).alias("h")).select("seqid", "h.*")


def sample_files(spark, d):
    s = table(spark, d, "samples").select("sample", "assembly", "r1", "r2", "species").distinct()
    return s.select("sample", names.sample_name(F.col("assembly")).alias("from_assembly"), names.sample_name(F.col("r1"), reads=True).alias("from_reads"), names.mate(F.col("r2"))["mate"].alias("mate"), names.safe_name(F.col("species")).alias("safe"))


def paired_reads(spark, d):
    """Read files brought together by their stem."""
    s = table(spark, d, "samples").select(F.explode(F.array_compact(F.array("r1", "r2"))).alias("path")).distinct()
    m = s.select("path", names.mate(F.col("path")).alias("m")).select("path", "m.*")
    return m.groupBy("stem").pivot("mate", [1, 2]).agg(F.min("path")).withColumnsRenamed({"1": "r1", "2": "r2"})


def coverage_glyphs(spark, d):
    h = table(spark, d, "hits").select("hit_id", "coverage").distinct()
    return h.select("hit_id", names.coverage_glyph(F.col("coverage")).alias("glyph"))


def coverage_strings(spark, d):
    m = table(spark, d, "merged_hits").where("size(subject_intervals) > 0 AND slen IS NOT NULL AND merged_id IS NOT NULL").dropDuplicates(["merged_id"])
    return m.select("merged_id", names.coverage_string(F.col("subject_intervals"), F.col("slen")).alias("coverage"))


def text_pieces(spark, d):
    """Whole texts cut into overlapping pieces."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.inline(sequences.pieces(F.col("text"), 400, 100)))
    return t.select("doc_id", "piece_offset", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


QUERIES = {f.__name__: f for f in (revcomp, translated, composition, alignment_walk, mutation_symbols, codon_changes, site_counts, consensus_sequences, consensus_full, site_fractions, binomial_tail, sequence_distances, natural_sort, gene_keys, inferred_classes, headers, sample_files, paired_reads, coverage_glyphs, coverage_strings, text_pieces)}

_A = "a AS (SELECT hsp_id, sseqid, qseq, sseq, sstart, send FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hsp_id) = 1)"
# Alignment strings of these tables have no gaps in the subject; minus strands are complemented.
_R = _A + """, i AS (SELECT *, unnest(range(1, length(sseq) + 1)) AS i FROM a),
r AS (SELECT hsp_id, sseqid, CASE WHEN send < sstart THEN reverse(translate(upper(sseq), 'ACGTN', 'TGCAN')) ELSE sseq END AS sseq, least(sstart, send) AS sstart, (CASE WHEN send < sstart THEN sstart - (i - 1) ELSE sstart + i - 1 END)::INT AS position,
CASE WHEN send < sstart THEN translate(upper(substr(qseq, i, 1)), 'ACGTN', 'TGCAN') ELSE upper(substr(qseq, i, 1)) END AS observed,
CASE WHEN send < sstart THEN translate(upper(substr(sseq, i, 1)), 'ACGTN', 'TGCAN') ELSE upper(substr(sseq, i, 1)) END AS reference FROM i)"""
_T = "list_aggregate(list_transform(range(0, length({0}) // 3), lambda i: coalesce(map_extract(codons, upper(substr({0}, (3 * i + 1)::INT, 3)))[1], 'X')), 'string_agg', '')"
_CODONS = """c AS (SELECT map_from_entries(list((b1 || b2 || b3, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (16 * p1 + 4 * p2 + p3 + 1)::INT, 1)))) AS codons
FROM (SELECT i AS p1, substr('TCAG', (i + 1)::INT, 1) AS b1 FROM range(4) t(i)), (SELECT i AS p2, substr('TCAG', (i + 1)::INT, 1) AS b2 FROM range(4) t(i)), (SELECT i AS p3, substr('TCAG', (i + 1)::INT, 1) AS b3 FROM range(4) t(i)))"""
SQL = {
    "revcomp": f"WITH {_A} SELECT hsp_id, reverse(translate(qseq, 'ACGTN', 'TGCAN')) AS other, translate(qseq, 'ACGTN', 'TGCAN') AS facing FROM a",
    "translated": f"WITH {_A}, {_CODONS}, t AS (SELECT hsp_id, sseq, coalesce({_T.format('sseq')}, '') AS peptide FROM a, c) SELECT hsp_id, peptide, length(sseq) >= 60 AND length(sseq) % 3 = 0 AND NOT contains(regexp_replace(peptide, '[*]$', ''), '*') AS is_cds FROM t",
    "composition": f"WITH {_A}, n AS (SELECT hsp_id, qseq, length(regexp_replace(upper(qseq), '[^GC]', '', 'g')) AS g, length(regexp_replace(upper(qseq), '[^ACGT]', '', 'g')) AS k FROM a) SELECT hsp_id, g::BIGINT AS n_gc, round(100.0 * g / k, 6) AS gc_pct, list_sum(list_transform(string_split(qseq, ''), lambda x: ascii(x) - 33))::BIGINT AS codes FROM n",
    "alignment_walk": f"WITH {_R} SELECT hsp_id, position, observed, reference FROM r WHERE observed <> reference",
    "mutation_symbols": f"""WITH {_R}, s AS (SELECT hsp_id, position, observed, reference, gene, gene || '_' || reference || position || observed AS symbol FROM r JOIN meta ON seqid = sseqid WHERE observed <> reference AND gene IS NOT NULL)
SELECT hsp_id, position, symbol, gene AS parsed_gene, reference AS ref, observed AS alt, position AS parsed_position, 'substitution' AS change, true AS mutant FROM s""",
    "codon_changes": f"""WITH {_R}, {_CODONS}, m AS (SELECT hsp_id, position, sseq, observed, (position - sstart) // 3 * 3 AS f, (position - sstart) % 3 AS o FROM r WHERE observed <> reference),
x AS (SELECT *, substr(sseq, (f + 1)::INT, 3) AS codon FROM m), y AS (SELECT *, substr(codon, 1, o::INT) || observed || substr(codon, (o + 2)::INT) AS changed FROM x WHERE length(codon) = 3)
SELECT hsp_id, position, (f // 3 + 1)::INT AS codon, coalesce(map_extract(codons, y.codon)[1], 'X') AS ref_aa, coalesce(map_extract(codons, changed)[1], 'X') AS alt_aa, coalesce(map_extract(codons, y.codon)[1], 'X') = coalesce(map_extract(codons, changed)[1], 'X') AS synonymous FROM y, c""",
    "site_counts": f"""WITH {_R}, n AS (SELECT sseqid, position, count(*) FILTER (observed = 'A') AS n_a, count(*) FILTER (observed = 'C') AS n_c, count(*) FILTER (observed = 'G') AS n_g, count(*) FILTER (observed = 'T') AS n_t, count(*) FILTER (observed = '-') AS n_indel, count(*) AS depth FROM r GROUP BY ALL)
SELECT *, CASE WHEN n_t > 0 AND n_t >= greatest(n_a, n_c, n_g) THEN 'T' WHEN n_g > 0 AND n_g >= greatest(n_a, n_c) THEN 'G' WHEN n_c > 0 AND n_c >= n_a THEN 'C' WHEN n_a > 0 THEN 'A' END AS base FROM n""",
    "consensus_sequences": f"""WITH {_R}, n AS (SELECT sseqid, position, observed, count(*) AS k FROM r WHERE observed IN ('A', 'C', 'G', 'T') GROUP BY ALL), b AS (SELECT sseqid, position, observed FROM n QUALIFY row_number() OVER (PARTITION BY sseqid, position ORDER BY k DESC, observed DESC) = 1),
p AS (SELECT DISTINCT sseqid, position FROM r) SELECT sseqid, string_agg(coalesce(observed, 'N'), '' ORDER BY position) AS consensus, count(observed) AS n_called FROM p LEFT JOIN b USING (sseqid, position) GROUP BY sseqid""",
    "consensus_full": f"""WITH {_R}, n AS (SELECT sseqid, position, observed, count(*) AS k FROM r WHERE observed IN ('A', 'C', 'G', 'T') AND position >= 1 GROUP BY ALL), b AS (SELECT sseqid, position, observed FROM n QUALIFY row_number() OVER (PARTITION BY sseqid, position ORDER BY k DESC, observed DESC) = 1),
l AS (SELECT sseqid, max(slen) AS slen FROM hsps WHERE slen > 0 GROUP BY sseqid), m AS (SELECT sseqid, greatest(max(position), max(slen)) AS n FROM r LEFT JOIN l USING (sseqid) GROUP BY sseqid),
p AS (SELECT sseqid, unnest(range(1, n + 1)) AS position FROM m) SELECT sseqid, string_agg(coalesce(observed, 'N'), '' ORDER BY position) AS consensus, count(observed) AS n_called FROM p LEFT JOIN b USING (sseqid, position) GROUP BY sseqid""",
    "site_fractions": f"""WITH {_R}, n AS (SELECT sseqid, position, count(*)::INT AS depth, count(*) FILTER (observed <> reference)::INT AS n_alt FROM r GROUP BY ALL)
SELECT sseqid, position, depth, n_alt, round(n_alt / depth, 6) AS fraction,
round(CASE WHEN n_alt = 0 THEN 1.0 ELSE list_sum(list_transform(range(n_alt, depth + 1), lambda i: exp(lgamma(depth + 1) - lgamma(i + 1) - lgamma(depth - i + 1) + i * ln(0.002) + (depth - i) * ln(0.998)))) END, 9) AS p_value,
CASE WHEN depth < 2 THEN 'low-depth' WHEN n_alt / depth >= 0.9 THEN 'fixed' WHEN n_alt / depth >= 0.05 THEN 'heteroresistant' ELSE 'absent' END AS status FROM n""",
    "binomial_tail": """WITH h AS (SELECT DISTINCT hit_id, sample, resolution FROM hits WHERE sample IS NOT NULL), n AS (SELECT sample, count(*)::INT AS n, count(*) FILTER (resolution = 'PARTIAL')::INT AS k FROM h GROUP BY sample)
SELECT sample, n, k, round(CASE WHEN k = 0 THEN 0.0 ELSE log10(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1.0 / 3) + (n - i) * ln(2.0 / 3))))) END, 6) AS log10_p FROM n""",
    "natural_sort": """WITH g AS (SELECT DISTINCT gene FROM meta WHERE gene IS NOT NULL), k AS (SELECT gene, lower(substr(gene, 1, 1)) AS initial,
list_transform(regexp_extract_all(gene, '([0-9]+|[^0-9])', 1), lambda x: {'t': CASE WHEN regexp_matches(x, '^[0-9]') THEN 1 ELSE 0 END, 'n': coalesce(try_cast(x AS BIGINT), 0), 'c': CASE WHEN regexp_matches(x, '^[0-9]') THEN '' ELSE x END}) AS key FROM g)
SELECT gene, initial, row_number() OVER (PARTITION BY initial ORDER BY key)::INT AS place FROM k""",
    "inferred_classes": "SELECT DISTINCT product, CASE " + " ".join(f"WHEN contains(lower(product), '{w}') THEN '{c}'" for w, c in KEYWORDS) + " ELSE '' END AS kind, regexp_matches(product, '(?i)(?:^|[^A-Za-z0-9])(?:23S|16S|5S)(?:[^A-Za-z0-9]|$)|ribosomal[_ ]?RNA|rRNA') AS rrna FROM meta WHERE product IS NOT NULL",
    "headers": "SELECT seqid, trim(gene) AS gene, trim(accession) AS accession, trim(product, ' ') AS product FROM meta WHERE gene IS NOT NULL AND accession IS NOT NULL AND product IS NOT NULL",
    "sample_files": """SELECT DISTINCT sample, regexp_replace(regexp_replace(assembly, '^.*/', ''), '[.]fna$', '') AS from_assembly, regexp_replace(regexp_replace(r1, '^.*/', ''), '_R1[.]fastq[.]gz$', '') AS from_reads,
CASE WHEN r2 IS NOT NULL THEN 2 END::INT AS mate, replace(species, ' ', '_') AS safe FROM samples""",
    "paired_reads": """WITH f AS (SELECT DISTINCT unnest([r1, r2]) AS path FROM samples), m AS (SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '[.](fastq|fq)[.]gz$', '') AS base FROM f WHERE path IS NOT NULL)
SELECT regexp_replace(base, '_R[12]$', '') AS stem, min(path) FILTER (ends_with(base, '_R1')) AS r1, min(path) FILTER (ends_with(base, '_R2')) AS r2 FROM m GROUP BY 1""",
    "coverage_glyphs": """WITH h AS (SELECT DISTINCT hit_id, coverage FROM hits), s AS (SELECT *, try_cast(string_split(coverage, '/')[-1] AS INT) AS n, string_split(regexp_replace(coverage, '/[^/]*$', ''), ',') AS p FROM h)
SELECT hit_id, CASE WHEN coverage IS NOT NULL THEN CASE WHEN contains(coverage, '/') AND n > 0 THEN list_aggregate(list_transform(range(0, 15), lambda i: CASE WHEN len(list_filter(p, lambda x: i * n // 15 + 1 BETWEEN try_cast(string_split(x, '-')[1] AS INT) AND try_cast(string_split(x, '-')[-1] AS INT))) > 0 THEN '=' ELSE '.' END), 'string_agg', '') ELSE '' END END AS glyph FROM s""",
    "coverage_strings": """WITH m AS (SELECT DISTINCT merged_id, slen, subject_intervals FROM merged_hits WHERE len(subject_intervals) > 0 AND slen IS NOT NULL AND merged_id IS NOT NULL)
SELECT merged_id, array_to_string(list_transform(subject_intervals, lambda x: x.lo || '-' || x.hi), ',') || '/' || slen AS coverage FROM m""",
    "text_pieces": """WITH t AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) > 400 THEN ceil((length(text) - 400) / 300)::INT ELSE 0 END + 1)) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (i * 300)::INT AS piece_offset, length(substr(text, (i * 300 + 1)::INT, 400))::INT AS n, md5(substr(text, (i * 300 + 1)::INT, 400)) AS digest FROM t""",
}


def key_sql(name: str) -> str:
    """SQL of a gene's key for an expression."""
    bare = f"regexp_replace({name}, '\\s+', '', 'g')"
    bare = f"regexp_replace({bare}, '^[(](?i:{'|'.join(names.CLASS_PREFIXES)})[)]', '')"
    bare = f"regexp_replace({bare}, '^([^_]+(?:_[^_]*)*?)_[^_]*_[A-Z]{{1,2}}[0-9]{{5,}}(?:[.][0-9]+)?$', '\\1')"
    bare = f"CASE WHEN regexp_matches({bare}, '(?:^|_)[0-9]+_[0-9]+$') THEN {bare} ELSE regexp_replace({bare}, '^(.+)_[0-9]+$', '\\1') END"
    return f"regexp_replace(lower({bare}), '^(bla|aac|aph|ant|aad)_', '\\1')"


_FAMILIES = ", ".join(f"'{f}'" for f in names.BLA_FAMILIES)
SQL["gene_keys"] = f"""WITH g AS (SELECT DISTINCT gene FROM meta WHERE gene IS NOT NULL), k AS (SELECT gene, {key_sql('gene')} AS key FROM g)
SELECT gene, key, key || CASE WHEN NOT starts_with(key, 'bla') AND len(list_filter([{_FAMILIES}], lambda f: key = f OR starts_with(key, f || '-'))) > 0 THEN ',bla' || key ELSE '' END AS keys,
coalesce(nullif(regexp_extract(gene, '^(.+?)_[0-9]+$', 1), ''), gene) AS stem FROM k"""
