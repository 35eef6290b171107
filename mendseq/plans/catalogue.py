"""Every query, by name: a function of a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendseq.functions import columns
from mendseq.functions.binomial import threshold_table
from mendseq.model import KEYS
from mendseq.operators import bloom, kmersets, report, solid, stats
from mendseq.operators.correct import correct
from mendseq.plans.pipeline import MODELLED, Settings, build_trusted, loaded_trust
from mendseq.plans.pipeline import correct_reads as run_correction
from mendseq.plans.reads_view import genome_table
from mendseq.plans.workspace import DEFAULT_K, Workspace, workspace
from mendseq.session import new_table_path, spread
from mendseq.sources.fastx import read_fastx, write_fastx
from mendseq.sources.naming import output_name
from mendseq.sources.trusted_store import load_trusted, save_trusted

Query = Callable[[SparkSession, str], DataFrame]
RESULT = [*KEYS, "seq", "qual", "correction", "bad_prefix", "bad_suffix", "info"]
# Bytes of a gzip range: less than a part file of all but the smallest tables.
RANGE_BYTES = 1 << 17
_queries: dict[str, Query] = {}


def query(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    _queries[build.__name__] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
    return build


def catalogue() -> dict[str, Query]:
    return dict(_queries)


def _lettered(kmers: DataFrame, k: int) -> DataFrame:
    return kmers.withColumn("kmer", columns.unpack(F.col("kmer"), k))


def _sum(array: str) -> F.Column:
    return F.aggregate(array, F.lit(0), lambda total, x: total + x).cast("bigint")


@query
def sequencing_reads(w):
    return w.reads.select(*KEYS, "id", "seq", "qual")


@query
def noisy_sequencing_reads(w):
    return w.noisy.select(*KEYS, "id", "seq", "qual")


@query
def read_stats(w):
    return stats.read_stats(w.reads, w.k)


@query
def infer_alpha(w):
    return stats.infer_alpha(w.reads, w.genome_size).select(
        "n_bases", F.round("coverage", 6).alias("coverage"), F.round("alpha", 9).alias("alpha"))


@query
def quality_histogram(w):
    return stats.quality_histogram(w.reads)


@query
def bad_quality_cutoff(w):
    return stats.bad_quality_cutoff(w.reads)


@query
def good_quality_cutoff(w):
    return stats.good_quality_cutoff(w.reads)


@query
def kmer_extract_counts(w):
    return kmersets.window_stats(w.reads, w.k).where("n_valid > 0").drop("n_windows")


@query
def kmer_validity(w):
    found = kmersets.window_stats(w.reads, w.k).groupBy("file_ind").agg(
        F.sum("n_valid").alias("valid"), F.sum(F.col("n_windows") - F.col("n_valid")).alias("other"))
    return found.select("file_ind", F.inline(F.array(
        F.struct(F.lit(True).alias("is_valid"), F.col("valid").alias("n_windows")),
        F.struct(F.lit(False).alias("is_valid"), F.col("other").alias("n_windows"))))).where("n_windows > 0")


@query
def kmer_canonical(w):
    return _lettered(kmersets.all_kmers(w.reads, w.k), w.k)


@query
def long_kmers(w):
    """k beyond what a packed code can hold."""
    return kmersets.all_kmers(w.reads, 41)


@query
def sample_kmers(w):
    return _lettered(kmersets.kmer_occurrences(w.reads, w.k, w.alpha), w.k)


@query
def set_a_distinct(w):
    return _lettered(w.sampled.df, w.k)


@query
def binomial_threshold(w):
    return threshold_table(stats.infer_alpha(w.reads, w.genome_size), w.k)


@query
def kmer_occurrence(w):
    hits = kmersets.window_hits(w.reads, w.sampled)
    return hits.select(*KEYS, "n_windows", F.size("solid").alias("n_hits"), _sum("solid").alias("pos_sum"))


def _profile(w: Workspace) -> DataFrame:
    return kmersets.position_profile(w.reads, w.sampled, w.thresholds, w.cutoff)


@query
def position_coverage(w):
    return kmersets.coverage_counts(w.reads, w.sampled, w.thresholds, w.cutoff)


@query
def trusted_positions(w):
    at = F.filter(F.transform("trusted", lambda t, i: F.when(t, i)), lambda i: i.isNotNull())
    return _profile(w).select(*KEYS, at.alias("at")).select(
        *KEYS, F.size("at").alias("n_trusted"), _sum("at").alias("pos_sum"))


@query
def trusted_kmers(w):
    return _lettered(w.trusted.df, w.k)


@query
def solid_flags(w):
    hits = kmersets.window_hits(w.reads, w.trusted)
    return hits.select(*KEYS, "n_windows", F.size("solid").alias("n_solid"), _sum("solid").alias("pos_sum"))


@query
def solid_semi_join(w):
    return _lettered(solid.solid_kmers(w.reads, w.trusted), w.k)


@query
def non_solid_anti_join(w):
    return _lettered(solid.untrusted_kmers(w.reads, w.trusted), w.k)


@query
def longest_solid_run(w):
    return solid.longest_run(kmersets.window_hits(w.reads, w.trusted))


@query
def trusted_spans(w):
    return solid.trusted_spans(kmersets.window_hits(w.reads, w.trusted), w.k)


@query
def anchor_class(w):
    return solid.anchor_class(kmersets.window_hits(w.noisy, w.trusted), w.k)


@query
def create_anchor_candidates(w):
    return solid.created_anchors(w.noisy, w.trusted)


@query
def set_ops_a_b(w):
    return _lettered(solid.compare_sets(w.sampled.df, w.trusted.df), w.k)


@query
def output_names(w):
    """Names as if every document were a read file of a format that varies with its number."""
    extensions = F.array(*[F.lit(e) for e in (
        ".fq", ".fastq", ".fa", ".fasta", ".fq.gz", ".fasta.gz", ".txt.gz", ".b.fq", "", "gz")])
    documents = w.spark.read.parquet(f"{w.sf_dir}/documents.parquet")
    path = F.concat(F.lit("in/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"),
                    F.element_at(extensions, (F.col("doc_id") % 10 + 1).cast("int")))
    return documents.select(
        "doc_id", output_name(path, F.col("doc_id") % 3 != 0).alias("output"),
        output_name(path, F.col("doc_id") % 3 != 0, level=0).alias("plain_output"))


def _bloom_sizes(w: Workspace) -> dict[str, bloom.BloomSize]:
    return {name: bloom.BloomSize.for_genome(w.genome_size, fp)
            for name, fp in (("a", bloom.SAMPLED_FP), ("b", bloom.TRUSTED_FP))}


@query
def bloom_sizing(w):
    return bloom.sizing(genome_table(w.spark, w.sf_dir))


@query
def high_error_adaptation(w):
    """The limits of a run when set A is as crowded as a filter sized for the genome."""
    loads = bloom.sizing(genome_table(w.spark, w.sf_dir)).where("name = 'a'").withColumn(
        "load", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    sampled = w.sampled.df.agg(F.count("*")).scalar()
    found = bloom.adaptation(loads, sampled * F.col("load"), 4, stats.bad_quality_cutoff(w.reads).scalar())
    return found.select("load", "max_corrections", "cutoff", F.round("fp", 9).alias("fp"))


@query
def bloom_membership(w):
    """Every k-mer of the reads against a filter of set B: none of B may be missed."""
    size = _bloom_sizes(w)["b"]
    blocks = bloom.bloom_blocks(w.trusted.df, size, w.k)
    marked = bloom.probe(kmersets.batch_kmers(w.reads, w.k), blocks, size, w.trusted.df)
    return marked.agg(
        F.count_if("member").alias("n_members"),
        F.count_if(F.col("member") & ~F.col("maybe")).alias("n_missed"),
        F.count_if(~F.col("member") & F.col("maybe")).alias("n_false"))


@query
def bloom_occupancy(w):
    size = _bloom_sizes(w)["a"]
    filled = bloom.occupancy(bloom.bloom_blocks(w.sampled.df, size, w.k), size)
    return filled.select(F.round("occupancy", 9).alias("occupancy"),
                         F.round("false_positive", 9).alias("false_positive"))


@query
def correct_reads(w):
    return w.corrected().select(*RESULT)


@query
def correct_noisy_reads(w):
    return w.corrected_noisy().select(*RESULT)


@query
def correct_reads_trim(w):
    return w.corrected_noisy(trim=True, new_quality="5").select(*RESULT)


@query
def correct_reads_strict(w):
    """Two corrections per 20 bases only: shows what is taken back as over-corrected."""
    return w.corrected_noisy(max_corrections=2).select(*RESULT)


@query
def correct_reads_fasta(w):
    """Without qualities."""
    return w.view("fasta").corrected().select(*RESULT)


@query
def correct_reads_noqual(w):
    """Qualities are there but do not count."""
    return w.changed("noqual", use_quality=False).corrected(new_quality="#").select(*RESULT)


@query
def correct_reads_two_files(w):
    return w.view("two_files").corrected().select(*RESULT)


@query
def correct_with_loaded_kmers(w):
    """Saved k-mers instead of passes 1 and 2."""
    path = new_table_path(w.spark, "saved")
    save_trusted(w.trusted.df, path, w.k, w.alpha, w.genome_size)
    kmers = load_trusted(w.spark, path, w.k, w.genome_size)
    return run_correction(w.reads.drop("true_seq"), loaded_trust(w.reads, kmers, w.settings), w.settings).select(*RESULT)


@query
def pipeline_modelled(w):
    """A set A as crowded as a filter for a third of the genome: one more correction, a higher cutoff."""
    settings = Settings(k=w.k, genome_size=w.genome_size // 3, alpha=w.alpha, false_positives=MODELLED)
    reads = w.reads.drop("true_seq")
    return run_correction(reads, build_trusted(reads, settings), settings).select(*RESULT)


def _joined(w: Workspace) -> Workspace:
    """The same with sets too large to broadcast."""
    return w.changed("joined", max_broadcast=0)


@query
def trusted_kmers_joined(w):
    return _lettered(_joined(w).trusted.df, w.k)


@query
def solid_flags_joined(w):
    hits = kmersets.window_hits(w.reads, w.trusted, max_broadcast=0)
    return hits.select(*KEYS, "n_windows", F.size("solid").alias("n_solid"), _sum("solid").alias("pos_sum"))


@query
def correct_reads_joined(w):
    return _joined(w).corrected().select(*RESULT)


@query
def correct_noisy_reads_joined(w):
    """Several errors a read, by neighbourhoods of the set."""
    joined = _joined(w)
    return correct(w.noisy, w.trusted, w.params(), joined.settings.max_broadcast).select(*RESULT)


@query
def correction_accuracy(w):
    """Errors in the reads by what became of them; gain: those mended less those made, of all."""
    return report.accuracy(w.reads, w.corrected()).select(
        "n_errors", "n_mended", "n_made", F.round("gain", 9).alias("gain"))


@query
def annotated_headers(w):
    return report.annotate(w.corrected_noisy(), discard=True).select(*KEYS, "id")


@query
def correction_summary(w):
    totals = report.summary(w.corrected_noisy(trim=True), trim=True, discard=True)
    return totals.withColumns({name: F.round(name, 9) for name in ("corrections_per_read", "bases_per_trim")})


@query
def fastx_roundtrip(w):
    """The reads written as a gzip FASTQ file and read back."""
    folder = new_table_path(w.spark, "fastq")
    write_fastx(w.reads, ["reads.fastq.gz"], folder, rows=w.reads.count())
    return read_fastx(w.spark, f"{folder}/output=reads.cor.fq.gz")


@query
def gzip_ranges_roundtrip(w):
    """The same, with gzip files read in ranges by their members."""
    folder = new_table_path(w.spark, "ranges")
    write_fastx(w.reads, ["reads.fastq.gz"], folder, rows=w.reads.count())
    return read_fastx(w.spark, f"{folder}/output=reads.cor.fq.gz", RANGE_BYTES)


@query
def fastx_roundtrip_fasta(w):
    """Without qualities, as plain text."""
    folder = new_table_path(w.spark, "fasta")
    reads = w.view("fasta").reads
    write_fastx(reads, ["reads.fasta"], folder, rows=reads.count())
    return read_fastx(w.spark, f"{folder}/output=reads.cor.fa")


@query
def paired_files_roundtrip(w):
    """Two inputs, one of them compressed, read back in their order."""
    folder = new_table_path(w.spark, "paired")
    reads = w.view("two_files").reads
    write_fastx(reads, ["left.fq", "right.fq.gz"], folder, rows=reads.count())
    return read_fastx(w.spark, [f"{folder}/output=left.cor.fq", f"{folder}/output=right.cor.fq.gz"])


@query
def trusted_store_roundtrip(w):
    path = new_table_path(w.spark, "saved")
    save_trusted(w.trusted.df, path, w.k, w.alpha, w.genome_size)
    return _lettered(load_trusted(w.spark, path, w.k, w.genome_size).df, w.k)


@query
def documents_kmers(w):
    """k-mers of the letters A, C, G, T and N of whole documents: very uneven lengths, other bases."""
    documents = w.spark.read.parquet(f"{w.sf_dir}/documents.parquet").select("doc_id", "text")
    letters = F.regexp_replace(F.upper("text"), "[^ACGTN]", "")
    reads = spread(documents, "doc_id").select(
        F.lit(0).alias("file_ind"), F.col("doc_id").alias("read_idx"), letters.alias("seq"))
    return _lettered(kmersets.kmer_counts(reads, DEFAULT_K), DEFAULT_K)
