"""Report tables, typing, headers, variants and reference distances over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainspark.functions import headers as hd
from strainspark.operators import reports, variants
from strainspark.operators.alleles import allele_fractions
from strainspark.operators.sketch import distances, nearest, sketches
from strainspark.queries.ranked import hits
from strainspark.queries.strings import aligned, codon_changes, reference_lengths, residues, site_counts
from strainspark.queries.tables import table

TYPES = ("AMR", "PLASMID", "STRESS", "VIRULENCE")
SCHEMES = ("corecat", "oldargs", "plasdb", "resbase", "stressdb", "vircat")


def hits_by_name(spark, d):
    """The long table's order within each sample."""
    return reports.placed(hits(spark, d).where("sample IS NOT NULL AND hit_id IS NOT NULL"), reports.BY_NAME).select("sample", "hit_id", "place")


def hits_by_place(spark, d):
    return reports.placed(hits(spark, d).where("sample IS NOT NULL AND hit_id IS NOT NULL"), reports.BY_PLACE).select("sample", "hit_id", "place")


def gene_layout(spark, d):
    return reports.gene_layout(hits(spark, d), table(spark, d, "samples").select("sample", F.col("assembly").alias("file")))


def mixed_sites(spark, d):
    """Resistance found in reads with its share of them, whatever the method."""
    return reports.mixed_sites(hits(spark, d), methods=("POINTR", "VARIANTR", "READS"))


def acquired_genes(spark, d):
    """Hits of acquired resistance, but for accessions whose metadata has no class."""
    suppress = table(spark, d, "meta").where("class IS NULL OR trim(class) = ''").select("accession")
    return reports.acquired(hits(spark, d), suppress).select("hit_id", "sample", "gene", "accession")


def typing_alleles(spark, d):
    """Names of loci and alleles taken apart, of merged hits that are like enough to be typed."""
    m = table(spark, d, "meta").where("gene IS NOT NULL").select(F.col("seqid").alias("sseqid"), "gene").distinct()
    h = table(spark, d, "merged_hits").where("merged_id IS NOT NULL AND identity_pct >= 90 AND NOT isnan(identity_pct) AND coverage_pct >= 60").select("merged_id", "sseqid").distinct()
    dotted = F.concat_ws(".", F.substring_index("sseqid", "_", 1), F.translate("gene", ".#", "--"), F.lit("1"), F.col("merged_id").cast("string"))
    module = F.concat(F.substring_index("sseqid", "_", 1), F.lit("#"), F.translate("gene", ".#", "--"), F.lit("."), F.col("merged_id").cast("string"))
    named = h.join(m, "sseqid").select("merged_id", hd.locus_id(dotted).alias("a"), hd.locus_id(module).alias("b"))
    return named.select("merged_id", "a.*", F.col("b.scheme").alias("module"), F.col("b.locus").alias("module_locus"), F.col("b.allele").alias("module_allele"))


def _calls(spark, d):
    h = hits(spark, d).where("primary AND sample IS NOT NULL AND gene IS NOT NULL AND coverage_pct >= 60 AND identity_pct >= 90")
    return h.select("sample", F.col("database").alias("scheme"), F.col("gene").alias("call"), F.coalesce("drug_class", F.lit("")).alias("lineage"))


def typing_table(spark, d):
    return reports.typing_table(_calls(spark, d), table(spark, d, "samples"), SCHEMES)


def full_summary(spark, d):
    """Leading columns, typing, counts by element type and warnings of each sample."""
    h = hits(spark, d).where("sample IS NOT NULL")
    counts = h.groupBy("sample").agg(*[F.count_if(F.col("primary") & (F.col("element_type") == t)).alias(f"n_{t.lower()}") for t in TYPES])
    told = [F.when(F.col("start").isNull() | F.col("end").isNull(), "hits without coordinates"), F.when(F.col("start") > F.col("end"), "reversed coordinates"), F.when(F.col("identity_pct").isNull(), "no identity")]
    warnings = h.select("sample", F.explode(F.array_compact(F.array(*told))).alias("warning"))
    return reports.full_summary(table(spark, d, "samples"), typing_table(spark, d), counts, warnings)


def cards(spark, d):
    return reports.cards(hits(spark, d), table(spark, d, "samples"))


def provider_headers(spark, d):
    """Headers as five providers write them, read back."""
    m = table(spark, d, "meta").where("gene <> '' AND accession <> '' AND product <> ''").select("seqid", F.trim("gene").alias("gene"), "accession", "product", F.coalesce("class", F.lit("")).alias("class"), F.coalesce("fam_id", F.lit("")).alias("fam"))
    m = m.where("gene <> '' AND NOT gene RLIKE '[|() \\\\[_]' AND NOT product RLIKE '[|\\\\[\\\\]]' AND NOT class RLIKE '[|]'")
    h = m.select(
        "seqid",
        hd.protein_header(F.concat_ws("|", F.lit("12"), "accession", F.lit("1"), F.lit("1"), "gene", "fam", F.lit("hydrolase"), F.lit("2"), F.lit("a_b"), "class", "product")).alias("p"),
        hd.piped_header(F.concat_ws("|", F.lit("P1"), F.lit(""), F.lit("1"), F.lit("1"), F.lit(""), "gene", F.concat(F.lit("id "), F.col("product")))).alias("n"),
        hd.ontology_header(F.concat(F.lit("gb|"), F.col("accession"), F.lit("|+|1-9|T:1|"), F.col("gene"), F.lit(" [Genus x]"))).alias("o"),
        hd.copied_header(F.concat(F.col("gene"), F.lit("_b_1_"), F.translate("accession", "_", "-"), F.lit(" more"))).alias("c"),
        hd.bracketed_header(F.concat(F.lit("V1(gb|"), F.col("accession"), F.lit(") ("), F.col("gene"), F.lit(") kinase [Class] [Genus x]"))).alias("b"),
    )
    return h.select(
        "seqid", F.col("p.gene").alias("protein_gene"), F.col("p.class").alias("protein_class"), F.col("p.subclass").alias("protein_subclass"), F.col("p.product").alias("protein_product"),
        F.col("n.gene").alias("piped_gene"), F.col("n.accession").alias("piped_accession"), F.col("n.product").alias("piped_product"), F.col("o.gene").alias("ontology_gene"), F.col("o.product").alias("organism"),
        F.col("c.gene").alias("copied_gene"), F.col("c.accession").alias("copied_accession"), F.col("b.gene").alias("bracketed_gene"), F.col("b.accession").alias("bracketed_accession"), F.col("b.product").alias("bracketed_product"),
    )


def taxon_names(spark, d):
    """Species of the samples as sketches name them in their folders, read back."""
    s = table(spark, d, "samples").where("species IS NOT NULL").select("species").distinct()
    path = F.concat(F.translate(F.trim("species"), " ", "_"), F.lit("/GCF_000000001.fna.gz"))
    return s.select("species", hd.taxon_of_path(path).alias("taxon"), hd.taxon_of_path(F.lit("GCF_000000001.fna.gz")).alias("none"))


def long_contigs(spark, d):
    """Contigs of at least 1,000 bases; empty ones never."""
    p = table(spark, d, "pieces").where("sample IS NOT NULL AND length > 0").groupBy("sample", "contig").agg(F.max(F.coalesce("piece_offset", F.lit(0)) + F.col("length")).alias("length"))
    return p.where("length >= 1000")


def _differences(spark, d):
    """Alternate bases at each covered place, with what they change; every depth counts, as few reads cover a place here."""
    r = residues(spark, d)
    s = site_counts(spark, d).join(r.groupBy("sseqid", "position").agg(F.min("reference").alias("reference_base")), ["sseqid", "position"]).where("reference_base IN ('A', 'C', 'G', 'T')")
    found = variants.gated(variants.alternate_bases(s, "reference_base"), min_depth=1, least=0.1, min_reads=1, max_p=0.01)
    c = r.where("observed <> reference").join(codon_changes(spark, d), ["hsp_id", "position"], "left")
    effect = F.min(F.struct(F.concat("ref_aa", F.col("codon").cast("string"), "alt_aa").alias("aa"), "synonymous"))
    c = c.groupBy("sseqid", "position", F.col("observed").alias("alt")).agg(effect.alias("e"))
    m = table(spark, d, "meta").where("gene IS NOT NULL").select(F.col("seqid").alias("sseqid"), "gene").distinct()
    v = found.join(c, ["sseqid", "position", "alt"], "left").join(m, "sseqid").join(reference_lengths(spark, d), "sseqid")
    change = F.coalesce("e.aa", F.concat("reference_base", F.col("position").cast("string"), "alt"))
    return v.select(F.col("sseqid").alias("reference"), "gene", F.col("slen").alias("length"), "position", "alt", change.alias("change"), F.col("e.synonymous").alias("synonymous"), "depth", "alt_count", "fraction", "p_value", "is_fixed")


def variant_calls(spark, d):
    v = _differences(spark, d)
    return v.select("reference", "gene", "position", "alt", "change", "depth", "alt_count", F.round("fraction", 6).alias("fraction"), F.round("p_value", 9).alias("p_value"), "is_fixed")


def variant_rows(spark, d):
    """Variants as reported; the catalogue are the changes at even places of their references."""
    v = _differences(spark, d)
    known = v.where("position % 2 = 0").select("gene", F.lower("change").alias("change"))
    return variants.variant_rows(v, known).withColumn("fraction", F.round("fraction", 6))


def site_lists(spark, d):
    s = site_counts(spark, d).join(reference_lengths(spark, d), "sseqid").where("position >= 1")
    out = variants.site_lists(s, ["sseqid"], "position", "slen", min_depth=1, mixed_depth=2, min_indels=1)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("sseqid", F.round("breadth_pct", 6).alias("breadth_pct"), F.round("mean_depth", 6).alias("mean_depth"), listed(F.col("indel_sites")).alias("indel_sites"), listed(F.col("mixed_sites")).alias("mixed_sites"))


def site_rows(spark, d):
    """Places of the alignments as catalogued sites, absent ones too."""
    f = allele_fractions(residues(spark, d), ["sseqid", "position"], F.col("observed") != F.col("reference"), min_depth=2)
    f = f.withColumn("symbol", F.concat("sseqid", F.lit("_"), F.col("position").cast("string")))
    return variants.site_rows(f, absent=True).select("symbol", "status", F.round("identity_pct", 6).alias("identity_pct"), "note")


def _hash(x):
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")


def _distances(spark, d):
    a = aligned(spark, d)
    x = sketches(a.select("sseqid", "qseq"), "sseqid", "qseq", k=11, size=64, hashed=_hash)
    y = sketches(a.select(F.col("sseqid").alias("reference"), "sseq"), "reference", "sseq", k=11, size=64, hashed=_hash)
    return distances(x, y, "sseqid", "reference", k=11, size=64)


def reference_distances(spark, d):
    """Distance between what was seen of each reference and the references, over the lowest hashes of both."""
    return _distances(spark, d).select("sseqid", "reference", "n_shared", F.round("jaccard", 6).alias("jaccard"), F.round("distance", 6).alias("distance"))


def nearest_reference(spark, d):
    return nearest(_distances(spark, d), "sseqid", "reference", limit=0.05).select("sseqid", "reference", F.round("distance", 6).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (
        hits_by_name, hits_by_place, gene_layout, mixed_sites, acquired_genes, typing_alleles, typing_table, full_summary, cards, provider_headers, taxon_names, long_contigs,
        variant_calls, variant_rows, site_lists, site_rows, reference_distances, nearest_reference,
    )
}

_H = """h AS (SELECT * FROM hits QUALIFY hit_id IS NULL OR row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_PLACE = """WITH {h} SELECT sample, hit_id, row_number() OVER (PARTITION BY sample ORDER BY {order})::INT AS place
FROM h WHERE sample IS NOT NULL AND hit_id IS NOT NULL"""
_GLYPH = """CASE WHEN coverage IS NOT NULL THEN CASE WHEN contains(coverage, '/') AND try_cast(string_split(coverage, '/')[-1] AS INT) > 0 THEN
list_aggregate(list_transform(range(0, 15), lambda i: CASE WHEN len(list_filter(string_split(regexp_replace(coverage, '/[^/]*$', ''), ','),
lambda x: i * try_cast(string_split(coverage, '/')[-1] AS INT) // 15 + 1 BETWEEN try_cast(string_split(x, '-')[1] AS INT) AND try_cast(string_split(x, '-')[-1] AS INT))) > 0
THEN '=' ELSE '.' END), 'string_agg', '') ELSE '' END END"""
_TYPING = """calls AS (SELECT sample, database AS scheme, max({'c': gene, 'l': coalesce(drug_class, '')}) AS x FROM h
  WHERE "primary" AND sample IS NOT NULL AND gene IS NOT NULL AND coverage_pct >= 60 AND identity_pct >= 90 GROUP BY ALL),
wide AS (SELECT sample, """ + ", ".join(f"max(x) FILTER (scheme = '{s}') AS {s}_x" for s in SCHEMES) + """ FROM calls GROUP BY sample),
own AS (SELECT sample, min(species) AS species, coalesce(bool_or(trim(assembly) <> ''), false) AS a, coalesce(bool_or(trim(r1) <> ''), false) AS r
  FROM samples WHERE sample IS NOT NULL GROUP BY sample)"""
_SCHEMES = ", ".join(f"{s}_x.c AS {s}, {s}_x.l AS {s}_lineage" for s in SCHEMES)


def _differences_sql() -> str:
    from strainspark.queries.strings import _R, SQL

    return f"""WITH base AS ({SQL["site_counts"]}), codon AS ({SQL["codon_changes"]}), res AS (WITH {_R} SELECT hsp_id, sseqid, position, observed, reference FROM r),
ref AS (SELECT sseqid, position, min(reference) AS reference_base FROM res GROUP BY ALL),
s AS (SELECT * FROM base JOIN ref USING (sseqid, position) WHERE reference_base IN ('A', 'C', 'G', 'T')),
alts AS (SELECT sseqid, position, reference_base, depth, unnest([{{'b': 'A', 'n': n_a}}, {{'b': 'C', 'n': n_c}}, {{'b': 'G', 'n': n_g}}, {{'b': 'T', 'n': n_t}}]) AS u FROM s),
v0 AS (SELECT sseqid, position, reference_base, depth::INT AS depth, u.b AS alt, u.n::INT AS alt_count, u.n / depth AS fraction FROM alts WHERE u.n > 0 AND u.b <> reference_base),
v1 AS (SELECT *, list_sum(list_transform(range(alt_count, depth + 1), lambda i: exp(lgamma(depth + 1) - lgamma(i + 1) - lgamma(depth - i + 1) + i * ln(0.002) + (depth - i) * ln(0.998)))) AS p_value,
  fraction >= 0.9 AS is_fixed FROM v0),
v2 AS (SELECT * FROM v1 WHERE fraction >= 0.1 AND (is_fixed OR p_value <= 0.01)),
e AS (SELECT sseqid, position, observed AS alt, min({{'aa': ref_aa || codon || alt_aa, 's': synonymous}}) AS e FROM res LEFT JOIN codon USING (hsp_id, position) WHERE observed <> reference GROUP BY ALL),
m AS (SELECT DISTINCT seqid AS sseqid, gene FROM meta WHERE gene IS NOT NULL), l AS (SELECT sseqid, max(slen) AS slen FROM hsps WHERE slen > 0 GROUP BY sseqid),
v AS (SELECT sseqid AS reference, gene, slen AS length, position, alt, coalesce(e.aa, reference_base || position || alt) AS change, e.s AS synonymous, depth, alt_count, fraction, p_value, is_fixed
  FROM v2 LEFT JOIN e USING (sseqid, position, alt) JOIN m USING (sseqid) JOIN l USING (sseqid))"""


_KMER = """a AS (SELECT hsp_id, sseqid, qseq, sseq FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hsp_id) = 1),
x0 AS (SELECT DISTINCT sseqid, ('0x' || substr(md5(substr(qseq, i::INT, 11)), 1, 15))::BIGINT AS h FROM (SELECT *, unnest(range(1, length(qseq) - 9)) AS i FROM a)),
y0 AS (SELECT DISTINCT sseqid AS reference, ('0x' || substr(md5(substr(sseq, i::INT, 11)), 1, 15))::BIGINT AS h FROM (SELECT *, unnest(range(1, length(sseq) - 9)) AS i FROM a)),
x AS (SELECT * FROM x0 QUALIFY row_number() OVER (PARTITION BY sseqid ORDER BY h) <= 64), y AS (SELECT * FROM y0 QUALIFY row_number() OVER (PARTITION BY reference ORDER BY h) <= 64),
p AS (SELECT DISTINCT sseqid, reference FROM x JOIN y USING (h)),
u AS (SELECT sseqid, reference, h, count(*) AS n FROM (SELECT p.sseqid, p.reference, x.h FROM p JOIN x ON x.sseqid = p.sseqid UNION ALL SELECT p.sseqid, p.reference, y.h FROM p JOIN y ON y.reference = p.reference)
  GROUP BY sseqid, reference, h),
u2 AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY sseqid, reference ORDER BY h) <= 64),
j AS (SELECT sseqid, reference, count(*) FILTER (n = 2) AS n_shared, count(*) FILTER (n = 2) / count(*) AS j FROM u2 GROUP BY ALL HAVING count(*) FILTER (n = 2) > 0),
dist AS (SELECT *, greatest(0.0, -ln(2 * j / (1 + j)) / 11) AS distance FROM j)"""
_TWO = "round({0}::DECIMAL(18, 6), {1})::DOUBLE"
SQL = {
    "hits_by_name": _PLACE.format(h=_H, order="element_type NULLS LAST, drug_class NULLS LAST, gene NULLS LAST, hit_id"),
    "hits_by_place": _PLACE.format(h=_H, order='sequence NULLS LAST, "start" NULLS LAST, "end" NULLS LAST, hit_id'),
    "gene_layout": f"""WITH {_H}, f AS (SELECT sample, min(assembly) AS file FROM samples WHERE sample IS NOT NULL GROUP BY sample)
SELECT coalesce(file, h.sample) AS "#FILE", sequence AS "SEQUENCE", "start" AS "START", "end" AS "END", strand AS "STRAND", gene AS "GENE", coverage AS "COVERAGE", {_GLYPH} AS "COVERAGE_MAP",
gaps AS "GAPS", {_TWO.format('coverage_pct', 2)} AS "%COVERAGE", {_TWO.format('identity_pct', 2)} AS "%IDENTITY", database AS "DATABASE", accession AS "ACCESSION", product AS "PRODUCT",
coalesce(nullif(subclass, ''), nullif(drug_class, ''), '') AS "RESISTANCE" FROM h LEFT JOIN f ON f.sample = h.sample""",
    "mixed_sites": f"""WITH {_H} SELECT hit_id, sample, gene, string_split(note, ';')[1] AS mutation, drug_class AS class, subclass, {_TWO.format('allele_fraction', 4)} AS allele_fraction, depth,
CASE WHEN contains(upper(coalesce(note, '')), 'HETERORESISTANT') THEN 'heteroresistant' WHEN contains(upper(coalesce(note, '')), 'FIXED') THEN 'fixed' ELSE 'detected' END AS status,
sequence AS reference, "start" AS position FROM h WHERE allele_fraction IS NOT NULL AND method IN ('POINTR', 'VARIANTR', 'READS') AND element_type = 'AMR'""",
    "acquired_genes": f"""WITH {_H} SELECT hit_id, sample, gene, accession FROM h WHERE coalesce(element_subtype, '') <> 'POINT' AND coverage_pct >= 50 AND identity_pct >= 90
AND coalesce(element_type, 'AMR') = 'AMR' AND (accession IS NULL OR accession NOT IN (SELECT accession FROM meta WHERE (class IS NULL OR trim(class) = '') AND accession IS NOT NULL))""",
    "typing_alleles": """WITH m AS (SELECT DISTINCT seqid AS sseqid, gene FROM meta WHERE gene IS NOT NULL),
h AS (SELECT DISTINCT merged_id, sseqid FROM merged_hits WHERE merged_id IS NOT NULL AND identity_pct >= 90 AND NOT isnan(identity_pct) AND coverage_pct >= 60)
SELECT merged_id, string_split(sseqid, '_')[1] AS scheme, translate(gene, '.#', '--') AS locus, '1.' || merged_id AS allele,
string_split(sseqid, '_')[1] AS module, translate(gene, '.#', '--') AS module_locus, merged_id::VARCHAR AS module_allele FROM h JOIN m USING (sseqid)""",
    "typing_table": f"WITH {_H}, {_TYPING} SELECT own.sample, species, {_SCHEMES} FROM own LEFT JOIN wide ON wide.sample = own.sample",
    "full_summary": f"""WITH {_H}, {_TYPING},
n AS (SELECT sample, {', '.join(f"count(*) FILTER (\"primary\" AND element_type = '{t}') AS n_{t.lower()}" for t in TYPES)} FROM h WHERE sample IS NOT NULL GROUP BY sample),
w0 AS (SELECT DISTINCT sample, unnest([CASE WHEN "start" IS NULL OR "end" IS NULL THEN 'hits without coordinates' END, CASE WHEN "start" > "end" THEN 'reversed coordinates' END,
  CASE WHEN identity_pct IS NULL THEN 'no identity' END]) AS w FROM h WHERE sample IS NOT NULL),
w AS (SELECT sample, string_agg(w, '; ' ORDER BY w) AS warnings FROM w0 WHERE w IS NOT NULL GROUP BY sample)
SELECT own.sample, CASE WHEN a AND r THEN 'both' WHEN a THEN 'assembly' WHEN r THEN 'reads' ELSE 'none' END AS input_type, species, {_SCHEMES},
{', '.join(f'coalesce(n_{t.lower()}, 0) AS n_{t.lower()}' for t in TYPES)}, coalesce(warnings, '') AS warnings
FROM own LEFT JOIN wide ON wide.sample = own.sample LEFT JOIN n ON n.sample = own.sample LEFT JOIN w ON w.sample = own.sample""",
    "cards": f"""WITH {_H} SELECT count(*) AS n_hits, count(*) FILTER ("primary") AS n_primary, count(DISTINCT nullif(trim(gene), '')) AS n_genes, count(DISTINCT nullif(drug_class, '')) AS n_classes,
(SELECT count(DISTINCT sample) FROM samples) AS n_samples, (SELECT count(DISTINCT nullif(trim(species), '')) FROM samples) AS n_species FROM h""",
    "provider_headers": """WITH m AS (SELECT seqid, trim(gene) AS gene, accession, product, coalesce(class, '') AS class FROM meta WHERE gene <> '' AND accession <> '' AND product <> '')
SELECT seqid, gene AS protein_gene, upper(trim(replace(class, '_', ' '))) AS protein_class, 'A B' AS protein_subclass, trim(replace(product, '_', ' ')) AS protein_product,
gene AS piped_gene, 'P1' AS piped_accession, replace(product, '_', ' ') AS piped_product, gene AS ontology_gene, 'Genus x' AS organism, gene || '_b' AS copied_gene,
replace(accession, '_', '-') AS copied_accession, gene AS bracketed_gene, trim(accession) AS bracketed_accession, 'kinase' AS bracketed_product
FROM m WHERE gene <> '' AND NOT regexp_matches(gene, '[|() \\[_]') AND NOT regexp_matches(product, '[|\\[\\]]') AND NOT contains(class, '|')""",
    "taxon_names": """WITH s AS (SELECT DISTINCT species FROM samples WHERE species IS NOT NULL), w AS (SELECT species, list_filter(string_split(replace(trim(species), '_', ' '), ' '), lambda x: x <> '') AS p FROM s)
SELECT species, CASE WHEN len(p) = 0 THEN '' ELSE trim(upper(substr(p[1], 1, 1)) || lower(substr(p[1], 2)) || ' ' ||
  CASE WHEN lower(coalesce(p[2], '')) IN ('unknown', 'sp', 'spp') THEN 'sp.' ELSE lower(coalesce(p[2], '')) END) END AS taxon, '' AS none FROM w""",
    "long_contigs": """SELECT sample, contig, max(coalesce(piece_offset, 0) + length) AS length FROM pieces WHERE sample IS NOT NULL AND length > 0
GROUP BY sample, contig HAVING max(coalesce(piece_offset, 0) + length) >= 1000""",
    "variant_calls": _differences_sql() + """ SELECT reference, gene, position, alt, change, depth::BIGINT AS depth, alt_count, round(fraction, 6) AS fraction, round(p_value, 9) AS p_value, is_fixed FROM v""",
    "variant_rows": _differences_sql() + """, k AS (SELECT DISTINCT lower(gene) AS g, upper(change) AS c FROM v WHERE position % 2 = 0),
f AS (SELECT v.*, k.g IS NOT NULL AS known FROM v LEFT JOIN k ON lower(gene) = g AND upper(change) = c WHERE NOT coalesce(synonymous, false)),
o AS (SELECT *, row_number() OVER (PARTITION BY reference, gene ORDER BY position, change, depth, alt_count) AS rn FROM f WHERE NOT known AND is_fixed)
SELECT reference, gene, position AS "start", position AS "end", CASE WHEN known THEN 'POINTR' ELSE 'VARIANTR' END AS method, 1::BIGINT AS n_changes, change AS changes, depth::BIGINT AS depth,
alt_count::BIGINT AS alt_count, round(fraction, 6) AS fraction, CASE WHEN is_fixed THEN 'FIXED' ELSE 'HETERORESISTANT' END AS status FROM f WHERE known OR NOT is_fixed
UNION ALL SELECT reference, gene, 1, max(length), 'ALLELER', count(*), string_agg(change, ', ' ORDER BY rn) FILTER (rn <= 6) || CASE WHEN count(*) > 6 THEN ', ...' ELSE '' END,
max(depth) FILTER (rn = 1), max(alt_count) FILTER (rn = 1), NULL, 'ALLELE' FROM o GROUP BY reference, gene""",
}


def _more_sql() -> None:
    from strainspark.queries.strings import SQL as of_strings

    SQL["site_lists"] = f"""WITH base AS ({of_strings["site_counts"]}), l AS (SELECT sseqid, max(slen) AS slen FROM hsps WHERE slen > 0 GROUP BY sseqid),
s AS (SELECT *, greatest(n_a, n_c, n_g, n_t) AS top FROM base JOIN l USING (sseqid) WHERE position >= 1)
SELECT sseqid, round(100.0 * count(*) / max(slen), 6) AS breadth_pct, round(avg(depth), 6) AS mean_depth,
coalesce(string_agg(position, ',' ORDER BY position) FILTER (top > 0 AND n_indel >= greatest(1.0, 0.2 * depth)), '') AS indel_sites,
coalesce(string_agg(position, ',' ORDER BY position) FILTER (depth >= 2 AND top / depth BETWEEN 0.2 AND 0.8), '') AS mixed_sites FROM s GROUP BY sseqid"""
    SQL["site_rows"] = f"""WITH f AS ({of_strings["site_fractions"]}) SELECT sseqid || '_' || position AS symbol, status,
round(CASE WHEN status = 'absent' THEN 100.0 * (1.0 - n_alt / depth) ELSE 100.0 END, 6) AS identity_pct,
printf('%s_%d; AF=%.3f; %d/%d reads', sseqid, position, n_alt / depth, n_alt, depth) || CASE status WHEN 'heteroresistant' THEN '; HETERORESISTANT' WHEN 'fixed' THEN '; FIXED' ELSE '' END AS note FROM f"""
    SQL["reference_distances"] = f"WITH {_KMER} SELECT sseqid, reference, n_shared, round(j, 6) AS jaccard, round(distance, 6) AS distance FROM dist"
    SQL["nearest_reference"] = f"""WITH {_KMER} SELECT sseqid, reference, round(distance, 6) AS distance FROM dist WHERE distance <= 0.05
QUALIFY row_number() OVER (PARTITION BY sseqid ORDER BY distance, reference) = 1"""


_more_sql()
