"""Time the stages of a correction run; prints one JSON line.

Every stage is timed on its own, after a warm-up on the smallest tables that
starts the Python workers and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mendseq.operators import kmersets, report  # noqa: E402
from mendseq.operators import stats as stats_of  # noqa: E402
from mendseq.plans.catalogue import catalogue  # noqa: E402
from mendseq.plans.workspace import Workspace  # noqa: E402

WARM_UP = "/root/testdata/sf0.001"
# Queries on top of the stages of a run.
EXTRA = ["kmer_canonical", "position_coverage", "solid_semi_join", "anchor_class", "correct_noisy_reads",
         "bloom_membership", "fastx_roundtrip", "documents_kmers", "kmer_extract_counts", "kmer_validity",
         "correct_reads_fasta", "paired_files_roundtrip", "correction_accuracy", "trusted_kmers_joined",
         "solid_flags_joined", "correct_reads_joined"]


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    w, out = Workspace(spark, sf_dir), {}

    def timed(name: str, work) -> None:
        begin = time.time()
        work()
        out[name] = round(time.time() - begin, 3)

    timed("reads", lambda: w.reads)
    timed("infer_alpha", lambda: stats_of.infer_alpha(w.reads, w.genome_size).first())
    timed("bad_quality_cutoff", lambda: stats_of.bad_quality_cutoff(w.reads).first())
    # With the rate and the cutoff once more.
    timed("sampled_kmers", lambda: w.sampled)
    timed("trusted_kmers", lambda: w.trusted)
    timed("correct_reads", lambda: consume(w.corrected()))
    timed("annotated_headers", lambda: consume(report.annotate(w.corrected()).select("id", "seq", "qual")))
    timed("correction_summary", lambda: consume(report.summary(w.corrected())))
    timed("solid_flags", lambda: consume(kmersets.window_hits(w.reads, w.trusted)))
    return out


def extra(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    out, queries = {}, catalogue()
    # What the queries share is the stages' work, timed above.
    shared = queries["noisy_sequencing_reads"](spark, sf_dir)
    consume(shared)
    consume(queries["trusted_kmers"](spark, sf_dir))
    for name in EXTRA:
        begin = time.time()
        consume(queries[name](spark, sf_dir))
        out[name] = round(time.time() - begin, 3)
    return out


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("mendseq-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_UP):
        stages(spark, WARM_UP)
    times = stages(spark, sf_dir)
    run = sum(times[s] for s in ("reads", "sampled_kmers", "trusted_kmers", "correct_reads"))
    times.update(extra(spark, sf_dir))
    print(json.dumps({"metric": "end_to_end_correction", "value": round(run, 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
