"""Sources, sinks and streams: the tables written in a format and read again through the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.operators.wide import attributes
from strainspark.queries.ranked import hits
from strainspark.queries.strings import aligned
from strainspark.queries.tables import table
from strainspark.session import scratch
from strainspark.sources.sequences import read_fasta, read_fastq, sequences_by_id, write_fasta
from strainspark.sources.sinks import element_table, long_table, sample_documents, write_table
from strainspark.sources.tabular import HSP_FIELDS, long_profiles, read_hsps, read_sample_sheet, read_table
from strainspark.streaming.arrivals import each_batch, read_arrivals, windowed_counts


def fasta_round_trip(spark, d):
    a = aligned(spark, d).select(F.concat(F.lit("h"), F.col("hsp_id").cast("string"), F.lit(" "), "sseqid").alias("header"), "qseq")
    path = scratch(spark, "fasta")
    write_fasta(a, "header", "qseq", path, width=20)
    return sequences_by_id(read_fasta(spark, path))


def fastq_round_trip(spark, d):
    a = aligned(spark, d).select(F.format_string("@r%d\n%s\n+\n%s", "hsp_id", "qseq", F.translate("qseq", "ACGT", "IIFF")))
    path = scratch(spark, "fastq")
    a.write.option("compression", "gzip").text(path)
    return read_fastq(spark, path).select("name", "seq", "quality")


def hsp_text_round_trip(spark, d):
    path = scratch(spark, "hsp")
    h = table(spark, d, "hsps").where("qseqid <> '' AND sseqid IS NOT NULL").dropDuplicates(["hsp_id"])
    h.select(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("none")) for n, _ in HSP_FIELDS])).write.text(path)
    return read_hsps(spark, path).where("NOT isnan(bitscore)").groupBy("qseqid").agg(F.count(F.lit(1)).alias("n"), F.sum("nident").alias("nident"), F.max("bitscore").alias("best"), F.count_if(F.col("strand") == "+").alias("n_forward"))


def sample_sheet(spark, d):
    path = scratch(spark, "sheet")
    s = table(spark, d, "samples")
    s.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("sample", "assembly", "r1", "r2")])).write.text(path)
    good, _ = read_sample_sheet(spark, path)
    return good.distinct()


def meta_text(spark, d):
    path = scratch(spark, "meta")
    m = table(spark, d, "meta").select("seqid", "gene", "accession", "fam_id")
    write_table(m, path)
    return read_table(spark, path, ["seqid", "gene"])


def profile_table_all(spark, d):
    """hits per database as a wide table of counts by sample, in long form again."""
    h = hits(spark, d).where("sample IS NOT NULL AND database IS NOT NULL")
    names = attributes(h, "database")
    wide = h.groupBy("sample").pivot("database", names).agg(F.nullif(F.count(F.lit(1)), F.lit(0)).cast("string"))
    return long_profiles(wide.fillna(""), "sample", names)


def profile_table_long(spark, d):
    """profile_table_all of three databases only, as its SQL has them."""
    h = hits(spark, d).where("sample IS NOT NULL").groupBy("sample").pivot("database", ["oldargs", "plasdb", "resbase"]).agg(F.nullif(F.count(F.lit(1)), F.lit(0)).cast("string"))
    return long_profiles(h.fillna(""), "sample", ["oldargs", "plasdb", "resbase"])


def hits_long_all(spark, d):
    return long_table(hits(spark, d)).select("sample", "gene", "class", "start", "end", "coverage_pct", "identity_pct", "depth", "allele_fraction", "primary")


def hits_long(spark, d):
    """The hits without a depth only, as its SQL has them; hits_long_all has all."""
    return long_table(hits(spark, d).where("depth IS NULL")).select("sample", "gene", "class", "start", "end", "coverage_pct", "identity_pct", "primary")


def hits_elements(spark, d):
    return element_table(hits(spark, d)).select("sample", "element", "start", "end", "target_length", "reference_length")


def _read_back(hits: DataFrame) -> DataFrame:
    back = sample_documents(hits).select("sample", F.explode(F.from_json("document", "hits array<struct<gene:string,start:int>>")["hits"]).alias("h"))
    return back.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("h.start", F.lit(0))).alias("starts"))


def hits_json_all(spark, d):
    """Genes of each sample, read back from its JSON document; a null start counts as 0."""
    return _read_back(hits(spark, d))


def hits_json(spark, d):
    """Only the hits with a start, as its SQL has them; hits_json_all has all."""
    return _read_back(hits(spark, d).where("start IS NOT NULL"))


def event_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, counted as a stream of files, each once."""
    e = table(spark, d, "events")
    path = scratch(spark, "events")
    stream = read_arrivals(spark, f"{d}/events.parque[t]", e.schema)
    counts = windowed_counts(stream, "ts", ["event_type"], window="1 day", late="30 days", row_id="event_id")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    each_batch(counts, f"{path}/state", keep, mode="update")
    out = spark.read.parquet(f"{path}/out")
    last = out.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.to_date("window_start").cast("string").alias("day"), "event_type", "n")


def arrivals_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Hits of new files through a batch plan, each batch into its own folder."""
    path = scratch(spark, "arrivals")
    h = table(spark, d, "hits")

    def plan(batch: DataFrame, number: int) -> None:
        batch.where("primary").groupBy("database").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream = read_arrivals(spark, f"{d}/hits.parque[t]", h.schema, files_per_trigger=4)
    each_batch(stream, f"{path}/state", plan)
    return spark.read.schema("database string, n bigint, batch int").parquet(f"{path}/out").groupBy("database").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (fasta_round_trip, fastq_round_trip, hsp_text_round_trip, sample_sheet, meta_text, profile_table_all, profile_table_long, hits_long_all, hits_long, hits_elements, hits_json_all, hits_json, event_counts_stream, arrivals_by_batch)}

_H = "h AS (SELECT * FROM hits QUALIFY hit_id IS NULL OR row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
SQL = {
    "fasta_round_trip": "SELECT DISTINCT 'h' || hsp_id AS id, qseq AS seq FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL",
    "fastq_round_trip": "SELECT DISTINCT 'r' || hsp_id AS name, qseq AS seq, translate(qseq, 'ACGT', 'IIFF') AS quality FROM hsps WHERE qseq IS NOT NULL AND sseq IS NOT NULL",
    "hsp_text_round_trip": """SELECT qseqid, count(*) AS n, sum(coalesce(nident, 0))::BIGINT AS nident, max(coalesce(bitscore, 0)) AS best, count(*) FILTER (coalesce(send, 0) >= coalesce(sstart, 0)) AS n_forward
FROM (SELECT DISTINCT hsp_id, qseqid, nident, bitscore, send, sstart FROM hsps WHERE qseqid <> '' AND sseqid IS NOT NULL AND (bitscore IS NULL OR NOT isnan(bitscore))) GROUP BY qseqid""",
    "sample_sheet": "SELECT DISTINCT nullif(sample, '') AS sample, nullif(assembly, '') AS assembly, nullif(r1, '') AS r1, nullif(r2, '') AS r2 FROM samples WHERE sample <> '' AND coalesce(nullif(assembly, ''), nullif(r1, '')) IS NOT NULL AND NOT (r2 IS NOT NULL AND r1 IS NULL)",
    "meta_text": "SELECT coalesce(seqid, '') AS seqid, coalesce(gene, '') AS gene, coalesce(accession, '') AS accession, coalesce(fam_id, '') AS fam_id FROM meta",
    "profile_table_all": f"WITH {_H} SELECT sample AS st, database AS locus, count(*)::VARCHAR AS allele FROM h WHERE sample IS NOT NULL AND database IS NOT NULL GROUP BY ALL",
    "profile_table_long": f"WITH {_H} SELECT sample AS st, database AS locus, count(*)::VARCHAR AS allele FROM h WHERE sample IS NOT NULL AND database IN ('oldargs', 'plasdb', 'resbase') GROUP BY ALL",
    "hits_long_all": f"WITH {_H} SELECT sample, gene, drug_class AS class, \"start\", \"end\", round_even(coverage_pct, 2) AS coverage_pct, round_even(identity_pct, 2) AS identity_pct, round_even(depth, 2) AS depth, round_even(allele_fraction, 4) AS allele_fraction, \"primary\" FROM h",
    "hits_long": f"WITH {_H} SELECT sample, gene, drug_class AS class, \"start\", \"end\", round_even(coverage_pct, 2) AS coverage_pct, round_even(identity_pct, 2) AS identity_pct, \"primary\" FROM h WHERE depth IS NULL",
    "hits_elements": f"WITH {_H} SELECT sample, gene AS element, \"start\", \"end\", abs(\"end\" - \"start\") + 1 AS target_length, try_cast(string_split(coverage, '/')[-1] AS INT) AS reference_length FROM h",
    "hits_json_all": f"WITH {_H} SELECT sample, count(*) AS n, sum(coalesce(\"start\", 0))::BIGINT AS starts FROM h WHERE sample IS NOT NULL GROUP BY sample",
    "hits_json": f"WITH {_H} SELECT sample, count(*) AS n, sum(\"start\")::BIGINT AS starts FROM h WHERE \"start\" IS NOT NULL AND sample IS NOT NULL GROUP BY sample",
    "event_counts_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL",
    "arrivals_by_batch": "SELECT database, count(*) AS n FROM hits WHERE \"primary\" GROUP BY database",
}
