import gzip
import random

import pytest
from pyspark.sql import functions as F

from mendseq.operators.membership import KmerSet
from mendseq.sources.naming import base_name, output_name
from mendseq.sources.trusted_store import load_trusted, save_trusted
from mendseq.sources import fastx
from mendseq.sources.fastx import read_fastx, write_fastx


def fastq(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randint(1, 60)
        out.append((f"@r{i} x", "".join(rng.choice("ACGTN") for _ in range(size)),
                    "".join(rng.choice("#@+I>") for _ in range(size))))
    return out


def text_of(records, end="\n", last=True):
    text = end.join(end.join([r[0], r[1], "+" + r[0][1:], r[2]]) if len(r) > 2 else end.join(r) for r in records)
    return text + end if last else text


def rows(df):
    return [tuple(r) for r in df.select("file_ind", "read_idx", "id", "seq", "qual")
            .orderBy("file_ind", "read_idx").collect()]


def expected(*files):
    return [(f, i, r[0], r[1], r[2] if len(r) > 2 else None) for f, rs in enumerate(files) for i, r in enumerate(rs)]


@pytest.mark.parametrize("end,last", [("\n", True), ("\n", False), ("\r\n", True)])
def test_line_ends(spark, tmp_path, end, last):
    records = fastq(7)
    (tmp_path / "a.fq").write_bytes(text_of(records, end, last).encode())
    assert rows(read_fastx(spark, str(tmp_path / "a.fq"))) == expected(records)


def test_formats_and_order_of_files(spark, tmp_path):
    first, second = fastq(30, 1), [(f">s{i}", "acgNRY" * i) for i in range(1, 9)]
    third = fastq(5, 2)
    (tmp_path / "z.txt").write_text(text_of(first))
    (tmp_path / "a.fa").write_text(text_of(second))
    (tmp_path / "m.fastq.gz").write_bytes(gzip.compress(text_of(third).encode()))
    paths = [str(tmp_path / n) for n in ("z.txt", "a.fa", "m.fastq.gz")]
    assert rows(read_fastx(spark, paths)) == expected(first, second, third)


@pytest.mark.parametrize("size", [64, 200, 1000])
def test_records_cut_by_splits(spark, tmp_path, size):
    records = fastq(30 if size < 100 else 120, size)
    (tmp_path / "a.fq").write_text(text_of(records))
    fasta = [(">" + r[0], r[1]) for r in records]
    (tmp_path / "b.fa").write_text(text_of(fasta))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    try:
        for name in names:
            spark.conf.set(name, str(size))
        assert rows(read_fastx(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fa")])) == expected(records, fasta)
    finally:
        for name in names:
            spark.conf.unset(name)


def test_empty_and_wrong_files(spark, tmp_path):
    (tmp_path / "none.fq").write_text("")
    assert rows(read_fastx(spark, str(tmp_path / "none.fq"))) == []
    (tmp_path / "bad.fq").write_text("hello\nworld\n")
    with pytest.raises(ValueError, match="starts with neither"):
        read_fastx(spark, str(tmp_path / "bad.fq"))


@pytest.mark.parametrize("level", [0, 1, 9])
def test_round_trip(spark, tmp_path, level):
    first, second = fastq(200, 3), [(f">s{i}", "ACGT" * i) for i in range(1, 40)]
    (tmp_path / "x.fastq.gz").write_bytes(gzip.compress(text_of(first).encode()))
    (tmp_path / "y.fa").write_text(text_of(second))
    paths = [str(tmp_path / "x.fastq.gz"), str(tmp_path / "y.fa")]
    reads = read_fastx(spark, paths)
    out = tmp_path / "out"
    write_fastx(reads.repartition(5), paths, str(out), level)
    name = "x.cor.fq.gz" if level else "x.cor.fq"
    parts = sorted((out / f"output={name}").glob("part-*"))
    data = b"".join(p.read_bytes() for p in parts)
    text = (gzip.decompress(data) if level else data).decode()
    assert text == "".join(f"{r[0]}\n{r[1]}\n+\n{r[2]}\n" for r in first)
    plain = "".join(p.read_text() for p in sorted((out / "output=y.cor.fa").glob("part-*")))
    assert plain == text_of(second)
    again = read_fastx(spark, [str(out / f"output={name}"), str(out / "output=y.cor.fa")])
    assert rows(again) == expected(first, second)


def test_names(spark):
    paths = {"A.fq": "A", "d/A.fastq": "A", "A.fq.gz": "A", "A.txt.gz": "A.txt", "A.b.fq": "A.b", "A": "A",
             "x.y/A": "A", "A.fasta.gz": "A", "A.gz": "A", "Agz": "Agz", "A.fa.fq.gz": "A.fa"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    out = df.select("path", base_name(F.col("path")).alias("base"),
                    output_name(F.col("path"), F.lit(True)).alias("fq"),
                    output_name(F.col("path"), F.lit(False), 0).alias("fa")).collect()
    for row in out:
        base = paths[row.path]
        assert row.base == base
        assert row.fq == base + ".cor.fq" + (".gz" if row.path.endswith("gz") else "")
        assert row.fa == base + ".cor.fa"


def test_bad_level(spark):
    with pytest.raises(ValueError):
        write_fastx(spark.range(1), [], "x", 10)


def test_writing_again_replaces(spark, tmp_path):
    records, others = fastq(60, 5), fastq(20, 6)
    (tmp_path / "a.fq").write_text(text_of(records))
    (tmp_path / "b.fq").write_text(text_of(others))
    a, b, out = str(tmp_path / "a.fq"), str(tmp_path / "b.fq"), tmp_path / "out"
    for paths in ([a, b], [a], [a]):
        write_fastx(read_fastx(spark, paths), paths, str(out))
    assert rows(read_fastx(spark, str(out / "output=a.cor.fq"))) == expected(records)
    assert rows(read_fastx(spark, str(out / "output=b.cor.fq"))) == expected(others)


def test_paths_of_many_kinds(spark, tmp_path):
    first, second = fastq(9, 7), fastq(4, 8)
    folder = tmp_path / "with blank"
    folder.mkdir()
    (folder / "part-0.fq").write_text(text_of(first[:5]))
    (folder / "part-1.fq").write_text(text_of(first[5:]))
    (tmp_path / "x1.fq").write_text(text_of(second))
    one = str(tmp_path / "x1.fq")
    assert rows(read_fastx(spark, [one, str(folder), one])) == expected(second, first, second)
    assert rows(read_fastx(spark, [str(tmp_path / "x*.fq"), "file://" + str(folder)])) == expected(second, first)


def test_many_files(spark, tmp_path):
    paths = []
    for i in range(300):
        paths.append(str(tmp_path / f"f{i}.fa"))
        (tmp_path / f"f{i}.fa").write_text(f">s{i}\nACGT\n")
    found = read_fastx(spark, paths)
    assert rows(found) == [(i, 0, f">s{i}", "ACGT", None) for i in range(300)]


def test_trusted_store(spark, tmp_path):
    kmers = KmerSet.store(spark.createDataFrame([(5,), (9,)], "kmer bigint"), 11)
    path = str(tmp_path / "b")
    save_trusted(kmers.df, path, 11, 0.1, 5000)
    loaded = load_trusted(spark, path, k=11, genome_size=5000)
    assert loaded.k == 11 and loaded.rows == 2 and sorted(r[0] for r in loaded.df.collect()) == [5, 9]
    for wrong in ({"k": 12}, {"genome_size": 4999}):
        with pytest.raises(ValueError):
            load_trusted(spark, path, **wrong)
    spark.range(3).withColumnRenamed("id", "kmer").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        load_trusted(spark, str(tmp_path / "c"))


def test_many_reads_are_written_in_more_parts(spark, tmp_path, monkeypatch):
    """No part grows with the input: as many ranges as the number of reads asks for, in their order."""
    monkeypatch.setattr(fastx, "PART_READS", 50)
    rows = [(0, i, f"@r{i}", "ACGT" * 5, "I" * 20) for i in range(1000)]
    reads = spark.createDataFrame(rows, "file_ind int, read_idx bigint, id string, seq string, qual string").repartition(3)
    write_fastx(reads, ["a.fq"], str(tmp_path), rows=1000)
    parts = sorted(tmp_path.glob("output=*/part-*"))
    assert len(parts) > 10 and max(p.read_text().count("@r") for p in parts) < 200
    assert "".join(p.read_text() for p in parts) == "".join(f"@r{i}\n{'ACGT' * 5}\n+\n{'I' * 20}\n" for i in range(1000))


def test_a_task_may_read_a_later_file_first(spark, tmp_path):
    """Spark gives a task large files before small ones, several to one batch of lines."""
    want, n = [], 0
    for part, size in enumerate((3, 40, 7, 90, 1, 60)):
        rows = [(f"@r{n + i}", "ACGT" * (1 + i % 3), "I" * 4 * (1 + i % 3)) for i in range(size)]
        (tmp_path / f"part-{part}.fq").write_text("".join(f"{a}\n{s}\n+\n{q}\n" for a, s, q in rows))
        want += [(n + i, *row) for i, row in enumerate(rows)]
        n += size
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = sorted((r.read_idx, r.id, r.seq, r.qual) for r in read_fastx(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == want


def test_lines_are_counted_without_sorting_them(spark, tmp_path, monkeypatch):
    """All lines of a split pass through one hash table of a row for each split."""
    (tmp_path / "a.fa").write_text(">r0\nACGT\n")
    plans = []
    monkeypatch.setattr(fastx, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    assert read_fastx(spark, str(tmp_path / "a.fa")).count() == 1
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]
