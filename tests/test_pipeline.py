import gzip
import random

import pytest
from pyspark.sql import functions as F

from mendseq import cli
from mendseq.functions.columns import pack
from mendseq.model import CorrectionParams
from mendseq.operators import bloom, kmersets, report
from mendseq.operators.kmersets import all_kmers
from mendseq.operators.membership import KmerSet
from mendseq.plans.catalogue import catalogue
from mendseq.plans.pipeline import Settings
from mendseq.plans.workspace import workspace
from mendseq.session import materialize
from mendseq.streaming.correction import correct_stream
from tests import data
from tests.brute import Brute


def sample(seed=1, n=700, size=400):
    rng = random.Random(seed)
    text = data.genome(rng, size, repeats=0)
    truth, reads = [], []
    for i in range(n):
        start = rng.randrange(size - 60)
        clean = text[start:start + 60]
        wrong = clean
        if i % 3 == 0:
            at = rng.randrange(20, 40)
            wrong = clean[:at] + ("A" if clean[at] != "A" else "G") + clean[at + 1:]
        truth.append(clean)
        reads.append((f"@r{i}", wrong, "I" * 60))
    return text, truth, reads


def write(path, reads):
    text = "".join(f"{n}\n{s}\n+\n{q}\n" for n, s, q in reads)
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())


def read_out(folder, name):
    data_ = b"".join(p.read_bytes() for p in sorted((folder / f"output={name}").glob("part-*")))
    lines = (gzip.decompress(data_) if name.endswith("gz") else data_).decode().split("\n")
    return [(lines[i], lines[i + 1]) for i in range(0, len(lines) - 1, 4)]


def run(spark, *argv):
    return cli.run(spark, cli.parse([str(a) for a in argv]))


def test_whole_run(spark, tmp_path):
    _, truth, reads = sample()
    write(tmp_path / "left.fq", reads[:350])
    write(tmp_path / "right.fastq.gz", reads[350:])
    files = ["-r", tmp_path / "left.fq", "-r", tmp_path / "right.fastq.gz"]
    text = run(spark, *files, "-K", 11, 400, "-od", tmp_path / "out")
    assert text.split()[:2] == ["reads", "700"]
    out = read_out(tmp_path / "out", "left.cor.fq") + read_out(tmp_path / "out", "right.cor.fq.gz")
    assert [h.split()[0] for h, _ in out] == [r[0] for r in reads]
    fixed = sum(s == t for (_, s), t in zip(out, truth))
    broken = sum(s != t and r[1] == t for (_, s), t, r in zip(out, truth, reads))
    assert fixed > 660 and broken == 0
    assert any(h.endswith(" cor") for h, _ in out)

    # Saving the trusted k-mers and starting from them gives the same reads.
    assert run(spark, *files, "-K", 11, 400, "-saveTrustedKmers", tmp_path / "b") is None
    again = run(spark, *files, "-k", 11, 400, 0.1, "-loadTrustedKmers", tmp_path / "b", "-od", tmp_path / "out2")
    assert again == text
    assert read_out(tmp_path / "out2", "left.cor.fq") == out[:350]
    with pytest.raises(ValueError):
        run(spark, *files, "-k", 13, 400, 0.1, "-loadTrustedKmers", tmp_path / "b", "-od", tmp_path / "out3")


def test_no_reads_and_low_coverage(spark, tmp_path):
    (tmp_path / "none.fq").write_text("")
    assert run(spark, "-r", tmp_path / "none.fq", "-K", 11, 400, "-od", tmp_path / "out").split()[:2] == ["reads", "0"]
    write(tmp_path / "few.fq", sample(n=5)[2])
    assert run(spark, "-r", tmp_path / "few.fq", "-K", 11, 400, "-od", tmp_path / "out").split()[:2] == ["reads", "5"]


@pytest.mark.parametrize("argv", [
    [], ["-r", "a", "-k", "17", "500", "0.1", "-K", "17", "500"], ["-r", "a"], ["-K", "17", "500"],
    ["-r", "a", "-K", "17", "500", "-saveTrustedKmers", "x", "-loadTrustedKmers", "y"],
    ["-r", "a", "-k", "x", "500", "0.1"], ["-r", "a", "-K", "17", "0"], ["-r", "a", "-k", "17", "500", "1.5"],
    ["-r", "a", "-K", "17", "500", "-zlib", "10"], ["-r", "a", "-K", "17", "500", "-what"]])
def test_wrong_command_lines(argv, capsys):
    with pytest.raises(SystemExit) as e:
        cli.parse(argv)
    assert e.value.code


def test_settings():
    args = cli.parse("-r a -r b -k 21 1000 0.2 -maxcor 3 -trim -noQual -newQual xy -stable -t 4".split())
    s = cli.settings_of(args)
    assert (args.r, s.k, s.genome_size, s.alpha, s.max_corrections) == (["a", "b"], 21, 1000, 0.2, 3)
    assert (s.trim, s.use_quality, s.new_quality, s.false_positives) == (True, False, "x", "modelled")
    for wrong in (dict(k=1), dict(genome_size=0), dict(alpha=1.5), dict(false_positives="?")):
        with pytest.raises(ValueError):
            Settings(**{"k": 17, "genome_size": 10, **wrong})


def test_adaptation():
    assert bloom.adapt_to_errors(0.05, 4, 70) == (4, 70)
    assert bloom.adapt_to_errors(0.11, 4, 70) == (5, 71)
    assert bloom.adapt_to_errors(0.11, 4, 0) == (5, 0)


def test_bloom(spark):
    size = bloom.BloomSize.for_genome(5_000_000, 0.01)
    assert (size.capacity, size.hashes, size.bits) == (7_500_000, 7, 71_947_416)
    size = bloom.BloomSize.for_genome(5_000_000, 0.0005)
    assert (size.hashes, size.bits) == (11, 118_652_728)

    rng = random.Random(3)
    reads = spark.createDataFrame([(data.genome(rng, 3000),)], "seq string")
    others = spark.createDataFrame([(data.genome(rng, 3000),)], "seq string")
    inside, outside = all_kmers(reads, 21), all_kmers(others, 21)
    size = bloom.BloomSize.optimal(3000, 0.01)
    blocks = bloom.bloom_blocks(inside, size, 21)
    assert bloom.probe(inside, blocks, size).where("not maybe").isEmpty()
    false = bloom.probe(outside, blocks, size).where("maybe").count()
    assert false < 0.05 * 3000
    measured = bloom.occupancy(blocks, size).first()
    assert 0.2 < measured.occupancy < 0.6 and measured.false_positive < 0.05
    with pytest.raises(ValueError):
        bloom.bloom_blocks(inside, size, 40)


def test_bloom_in_parts(spark):
    """Requests that repeat, members not asked for, a filter of many parts; k-mers are sent many to a row."""
    size = bloom.BloomSize.optimal(300_000, 0.01)
    members = spark.range(0, 30_000).select((F.col("id") * 7919).alias("kmer"))
    asked = spark.range(10_000, 50_000).select((F.col("id") * 7919).alias("kmer"))
    blocks = bloom.bloom_blocks(members, size, 21)
    assert blocks.count() == blocks.select("block", "word").distinct().count()
    found = bloom.probe(asked.union(asked), blocks, size, members)
    assert found.count() == 40_000 and found.where("member").count() == 20_000
    assert found.where("member != (kmer < 30000 * 7919) or member and not maybe").isEmpty()
    assert found.where("not member and maybe").count() < 100
    sent = bloom._in_parts(asked.coalesce(1), bloom._part_of(size), bloom.ASKED)
    assert sent.count() <= size.bits // bloom.BLOCK_BITS // bloom.PART_BLOCKS + 1
    assert sent.agg(F.sum(F.size("key"))).first()[0] == 40_000


def test_accuracy_of_odd_reads(spark):
    """Shorter, longer, null and repeated reads, letters beyond ASCII; without a function called for each letter."""
    truth = [(0, 1, "ACGT", "AAGT"), (0, 2, "AC", "ACGT"), (0, 3, None, "ACGT"), (0, 4, "ACGTA", "ACGT"), (0, 5, "A\u00e9G", "ACG"),
             (0, 6, "CC", "AA"), (0, 6, "AC", "AA"), (0, 7, "A", "A"), (1, 1, "", ""), (0, 8, "AA", None), (None, 9, "A", "C")]
    mended = [(0, 1, "AAGT"), (0, 2, "ACGA"), (0, 3, "CCCC"), (0, 4, "TCGT"), (0, 5, "ACG"), (0, 6, "AC"), (0, 7, "C"), (1, 1, ""),
              (0, 8, "AA"), (None, 9, "C"), (0, 10, "A")]
    found = report.accuracy(spark.createDataFrame(truth, "file_ind int, read_idx bigint, seq string, true_seq string"),
                            spark.createDataFrame(mended, "file_ind int, read_idx bigint, seq string"))
    assert "lambda" not in found._jdf.queryExecution().toString()
    row = found.first()
    assert (row.n_errors, row.n_mended, row.n_made) == (1 + 2 + 1 + 2 + 1, 1 + 1 + 1 + 1, 1 + 1)


def test_stream(spark, tmp_path):
    text, _, reads = sample(2, n=60)
    k = 11
    rows = [(0, i, *r) for i, r in enumerate(reads)]
    schema = "file_ind int, read_idx bigint, id string, seq string, qual string"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
    trusted = data.kmers(text, k)
    kmers = spark.createDataFrame([(t,) for t in sorted(trusted)], "kmer string")
    kmers = KmerSet.store(kmers.select(pack(kmers.kmer, k).alias("kmer")), k)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    writer = correct_stream(stream, kmers, CorrectionParams(k),
                            lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    query = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.read_idx: r.seq for r in spark.read.parquet(str(out)).collect()}
    plain = Brute(trusted, k)
    assert got == {i: plain(r[1], r[2])[0] for i, r in enumerate(reads)}


def test_summary_while_writing(spark):
    """The totals are those of a scan, and no scan is made for them."""
    rows = [(i % 4 - 1, i % 3, i % 5, i) for i in range(50)]
    corrected = spark.createDataFrame(rows, "correction int, bad_prefix int, bad_suffix int, read_idx long").repartition(4)
    for trim, discard in ((False, False), (True, True)):
        counted, row = report.observed(corrected, trim, discard)
        written = materialize(counted, "counted")
        assert row().asDict() == report.summary(written, trim, discard).first().asDict()
        assert "CollectMetrics" in counted._jdf.queryExecution().executedPlan().toString()
    counted, row = report.observed(corrected.where("1 = 0"))
    materialize(counted, "none")
    assert row().asDict() == report.summary(corrected.where("1 = 0")).first().asDict()


def test_modelled_run_draws_set_a_once(spark, tmp_path, monkeypatch):
    """The rate it is drawn at needs no set of its own."""
    spark.createDataFrame([(i, i * 7 % 150) for i in range(800)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    drawn, whole = [], kmersets.sampled_kmers
    monkeypatch.setattr(kmersets, "sampled_kmers", lambda reads, k, alpha: drawn.append(alpha) or whole(reads, k, alpha))
    assert catalogue()["pipeline_modelled"](spark, str(tmp_path)).count() == 800
    assert len(drawn) == 1
    w = workspace(spark, str(tmp_path))
    assert w.sample.alpha == w.alpha == drawn[0] and len(drawn) == 2
