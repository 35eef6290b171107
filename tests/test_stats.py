import pytest

from mendseq.operators import stats
from mendseq.operators.report import annotate, summary, summary_text

READS = "file_ind int, read_idx bigint, id string, seq string, qual string"


def frame(spark, rows):
    return spark.createDataFrame(rows, READS)


def plain_cutoffs(quals):
    def percentile(values, share):
        return next(q for q in range(300) if sum(v <= q for v in values) > share * len(values))

    first, last = [ord(q[0]) for q in quals], [ord(q[-1]) for q in quals]
    return min(percentile(last, 0.05), percentile(first, 0.05) - 1), percentile(first, 0.25)


def test_cutoffs(spark):
    quals = ["I5" if i % 7 else "#!" for i in range(50)] + ["5I"] * 3
    df = frame(spark, [(0, i, "@r", "AC", q) for i, q in enumerate(quals)])
    bad, good = plain_cutoffs(quals)
    assert stats.bad_quality_cutoff(df).first().cutoff == bad
    assert stats.good_quality_cutoff(df).first().cutoff == good


def test_the_first_file_decides_about_quality(spark):
    rows = [(0, 0, ">a", "AC", None), (1, 0, "@b", "AC", "II")]
    assert stats.bad_quality_cutoff(frame(spark, rows)).first().cutoff == 0
    assert stats.good_quality_cutoff(frame(spark, rows)).first().cutoff == 127
    swapped = [(1 - f, i, n, s, q) for f, i, n, s, q in rows]
    assert stats.bad_quality_cutoff(frame(spark, swapped)).first().cutoff == ord("I") - 1
    assert stats.bad_quality_cutoff(frame(spark, rows).limit(0)).first().cutoff == 0


def test_alpha(spark):
    row = stats.infer_alpha(frame(spark, [(0, 0, "@a", "ACGTN", None), (1, 0, "@b", "ACGTA", None)]), 5).first()
    assert (row.coverage, row.alpha) == (2.0, 3.5)


RESULTS = [
    # correction, bad_prefix, bad_suffix, info -> header
    ((0, 0, 0, 0), "@r"), ((0, 0, 0, 2), "@r"), ((-1, 0, 0, 0), "@r unfixable_error"),
    ((-1, 0, 0, 1), "@r unfixable_error oc"), ((-1, 0, 0, 3), "@r unfixable_error lc"),
    ((2, 0, 0, 0), "@r cor"), ((0, 3, 0, 2), "@r bad_prefix=3 ak"),
    ((1, 3, 4, 3), "@r cor bad_prefix=3 bad_suffix=4 lc"), ((1, 0, 12, 2), "@r cor bad_suffix=12 ak")]


def test_headers_and_summary(spark):
    rows = [(0, i, "@r", "ACGT", "IIII", *r) for i, (r, _) in enumerate(RESULTS)]
    df = spark.createDataFrame(rows, READS + ", correction int, bad_prefix int, bad_suffix int, info int")
    heads = [r.id for r in annotate(df).orderBy("read_idx").collect()]
    assert heads == [h for _, h in RESULTS]
    trimmed = [r.id for r in annotate(df, trim=True, discard=True).orderBy("read_idx").collect()]
    assert trimmed == [h.replace("bad_suffix", "trimmed") for (c, *_), h in RESULTS if c >= 0]
    total = summary(df).first()
    assert (total.corr_cnt, total.trim_reads_cnt, total.discard_reads_cnt, total.total_reads,
            total.error_free_reads_cnt) == (4, 0, 0, 9, 3)
    assert total.corrections_per_read == pytest.approx(4 / 6)
    total = summary(df, trim=True, discard=True).first()
    assert (total.trim_reads_cnt, total.trim_base_cnt, total.discard_reads_cnt) == (2, 16, 3)
    assert summary_text(total).split()[:2] == ["reads", "9"] and "8.000000" in summary_text(total)
    empty = summary(df.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0, 0.0, 0.0)
