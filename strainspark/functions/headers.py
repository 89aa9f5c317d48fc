"""Column functions on the sequence headers of public databases and on identifiers that hold several names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("accession", "fusion_part", "fusion_total", "gene", "fam_id", "part_of_gene", "reportable", "subclass", "class", "product")


def _named(gene: Column, accession: Column, product: Column) -> Column:
    return F.struct(gene.alias("gene"), accession.alias("accession"), product.alias("product"))


def protein_header(header: Column) -> Column:
    """STRUCT of ``FIELDS`` of a header with ten fields parted by '|'. A number alone in front is left out, fields
    that are missing are empty; class and subclass are upper case, and they and the product have blanks for '_'."""
    f = F.split(header, r"\|")
    f = F.when(F.trim(f[0]).rlike(r"^[0-9]+$"), F.slice(f, 2, 1 << 30)).otherwise(f)
    part = lambda i: F.trim(F.coalesce(F.get(f, F.lit(i)), F.lit("")))
    words = lambda c: F.trim(F.translate(c, "_", " "))
    shape = {"subclass": lambda c: F.upper(words(c)), "class": lambda c: F.upper(words(c)), "product": words}
    return F.when(header.isNotNull(), F.struct(*[shape.get(name, lambda c: c)(part(i)).alias(name) for i, name in enumerate(FIELDS)]))


def piped_header(header: Column) -> Column:
    """STRUCT<gene, accession, product> of protein|nucleotide|n|n|gene|family|id product: the nucleotide accession and the
    gene, or what stands beside them where they are empty. Null for fewer than six fields."""
    f = F.split(header, r"\|")
    first = lambda a, b: F.when(F.get(f, F.lit(a)) != "", F.get(f, F.lit(a))).otherwise(F.get(f, F.lit(b)))
    last = F.coalesce(F.get(f, F.lit(6)), F.lit(""))
    product = F.translate(F.when(F.contains(last, F.lit(" ")), F.regexp_replace(last, r"^[^ ]* ", "")).otherwise(last), "_", " ")
    return F.when(F.size(f) >= 6, _named(first(4, 5), first(1, 0), product))


def ontology_header(header: Column) -> Column:
    """STRUCT<gene, accession, product> of gb|accession|strand|range|term|name [organism]; the product is the organism."""
    f = F.split(header, r"\|")
    name = F.coalesce(F.get(f, F.lit(5)), F.lit(""))
    organism = F.when(F.contains(name, F.lit(" [")), F.regexp_replace(F.regexp_replace(name, r"^.*? \[", ""), r"[\] ]+$", "")).otherwise("")
    return F.when(F.size(f) >= 6, _named(F.trim(F.substring_index(name, " [", 1)), F.get(f, F.lit(1)), F.trim(organism)))


def copied_header(header: Column) -> Column:
    """STRUCT<gene, accession, product> of gene_copy_accession, read from the right as genes hold '_' themselves; without
    two '_' the whole token is the gene. The product is empty."""
    token = F.regexp_extract(header, r"^(\S*)", 1)
    parts = F.split(token, "_")
    n = F.size(parts)
    gene = F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), "_")
    bare = F.regexp_replace(F.when(n >= 3, gene).otherwise(token), r"^_+|_+$", "")
    return F.when(header.isNotNull(), _named(bare, F.when(n >= 3, F.element_at(parts, -1)).otherwise(""), F.lit("")))


def bracketed_header(header: Column) -> Column:
    """STRUCT<gene, accession, product> of id(gb|accession) (gene) product [class] [organism]; of another header the first
    token is the gene, the accession empty and the product all of it."""
    form = r"^[^(]*\((?:[^|()]*\|)?([^()]*)\) \((.+?)\) (.*?)(?: \[.*)?$"
    part = lambda i: F.trim(F.regexp_extract(header, form, i))
    return F.when(header.rlike(form), _named(part(2), part(1), part(3))).when(header.isNotNull(), _named(F.regexp_extract(header, r"^(\S*)", 1), F.lit(""), header))


def locus_id(name: Column) -> Column:
    """STRUCT<scheme, locus, allele> of scheme.locus.allele (the allele may hold dots) or module#locus.allele; null for
    other names."""
    module = F.contains(name, F.lit("#"))
    scheme = F.when(module, F.substring_index(name, "#", 1))
    rest = F.when(module, F.regexp_replace(name, r"^[^#]*#", "")).otherwise(name)
    parts = F.split(rest, r"\.")
    full = F.when(module, F.concat(F.array(scheme), parts)).otherwise(parts)
    return F.when(F.size(full) >= 3, F.struct(full[0].alias("scheme"), full[1].alias("locus"), F.array_join(F.slice(full, 3, 1 << 30), ".").alias("allele")))


def taxon_of_path(path: Column) -> Column:
    """'Genus species' of a reference named Genus_species/file: the folder, or a lone name without its ending. Empty for
    accessions and what doesn't begin with a letter; an unknown species is 'sp.'."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != "")
    own = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.get(parts, F.lit(0)))
    words = F.filter(F.split(F.translate(F.regexp_replace(own, r"\.(?:fna\.gz|fasta\.gz|fna|fasta|fa|gz)$", ""), "_", " "), " "), lambda x: x != "")
    genus, species = F.get(words, F.lit(0)), F.lower(F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    species = F.when(species.isin("unknown", "sp", "spp"), "sp.").otherwise(species)
    named = F.trim(F.concat(F.upper(F.substring(genus, 1, 1)), F.lower(F.substring(genus, 2, 1 << 30)), F.lit(" "), species))
    return F.when(path.isNotNull(), F.when(genus.rlike(r"^(?i:gcf|gca)") | ~genus.rlike(r"^\p{L}"), "").otherwise(F.coalesce(named, F.lit(""))))
