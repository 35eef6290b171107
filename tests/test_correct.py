import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from mendseq.functions import ragged
from mendseq.functions.columns import pack
from mendseq.functions.index import Filter, build_index, hashed
from mendseq.model import CorrectionParams
from mendseq.operators import lanes
from mendseq.operators.correct import _kernel, chained_to, correct
from mendseq.operators.membership import ASKING, FINISHED, PENDING, KmerSet, Known, _Joining, run_known
from tests import data
from tests.brute import Brute

COLUMNS = ["seq", "qual", "correction", "bad_prefix", "bad_suffix", "info"]


def index_of(trusted, k):
    letters = ragged.from_arrow(pa.array(sorted(trusted), pa.string()))
    return build_index(ragged.read_windows(letters, k).kmer)


def batch_of(reads):
    n = len(reads)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)),
         pa.array([r[0] for r in reads], pa.string()), pa.array([r[1] for r in reads], pa.string())],
        names=["file_ind", "read_idx", "seq", "qual"])


def in_task(reads, trusted, params):
    run, answer = _kernel(params)(batch_of(reads), np.ones(len(reads), bool)), None
    index = index_of(trusted, params.k)
    while True:
        try:
            _, asked, *_ = run.send(answer)
        except StopIteration as end:
            return [tuple(end.value[c][i].as_py() for c in COLUMNS) for i in range(len(reads))]
        answer = index.contains(asked)


def in_rounds(reads, trusted, params, eager):
    """The rounds of the join mode for one group of reads, with the join done here."""
    index, waiting, done = index_of(trusted, params.k), batch_of(reads), {}
    yes = no = ragged.no_kmers(params.k)
    while waiting.num_rows:
        out, waits, (yes, no, asked) = run_known(waiting, _kernel(params), Known(yes, no), eager)
        for row in out.to_pylist():
            done[row["read_idx"]] = tuple(row[c] for c in COLUMNS)
        hit = index.contains(asked)
        yes, no = (np.unique(np.concatenate(v)) for v in ((yes, asked[hit]), (no, asked[~hit])))
        waiting = waiting.take(pa.array(np.flatnonzero(waits)))
    return [done[i] for i in range(len(reads))]


@pytest.mark.parametrize("seed", range(24))
def test_matches_plain_corrector(seed):
    rng = random.Random(seed)
    k = rng.choice([5, 7, 8, 11, 17])
    text = data.genome(rng, rng.choice([120, 400]))
    trusted = data.trusted(rng, text, k, lost=rng.choice([0, 0.03, 0.2]), extra=rng.choice([0, 0.05, 0.3]))
    options = dict(cutoff=rng.choice([0, 40, 60]), max_corrections=rng.choice([1, 2, 4]),
                   trim=rng.random() < 0.3, new_quality=rng.choice([None, "!"]))
    reads = data.reads(rng, text, 400, k=k)
    plain = Brute(trusted, k, **options)
    expected = [plain(*r) for r in reads]
    params = CorrectionParams(k, **options)
    assert in_task(reads, trusted, params) == expected
    for eager in (False, True):
        assert in_rounds(reads[:150], trusted, params, eager) == expected[:150]


@pytest.mark.parametrize("k", [32, 33, 40])
def test_long_kmers(k):
    rng = random.Random(k)
    text = data.genome(rng, 600)
    trusted = data.trusted(rng, text, k, lost=0.01, extra=0.05)
    reads = data.reads(rng, text, 120, sizes=(60, 160), k=k)
    plain = Brute(trusted, k)
    assert in_task(reads, trusted, CorrectionParams(k)) == [plain(*r) for r in reads]


def test_restores_isolated_errors_and_keeps_clean_reads():
    rng = random.Random(5)
    text, k = data.genome(rng, 3000, repeats=0), 17
    clean = [text[i:i + 100] for i in range(0, 2900, 7)]
    wrong = [c[:50] + ("A" if c[50] != "A" else "C") + c[51:] for c in clean]
    trusted, params = data.kmers(text, k), CorrectionParams(k)
    assert [r[0] for r in in_task([(c, None) for c in clean], trusted, params)] == clean
    fixed = in_task([(c, None) for c in wrong], trusted, params)
    assert [r[0] for r in fixed] == clean and {r[2] for r in fixed} == {1}


def test_created_anchor_that_explains_everything_changes_nothing():
    k, text = 5, "ACGTTGCAAC"
    read = text[:4] + "A" + text[5:9]
    trusted = data.kmers(text[:9], k)
    assert in_task([(read, None)], trusted, CorrectionParams(k)) == [(read, None, 0, 0, 0, 0)]


def test_windows_of_changed_bases_are_not_made_anew():
    """Reads without a trusted k-mer: what is held is little more than a code for each base they may have instead."""
    rng = random.Random(3)
    reads = [("".join(rng.choice("ACGTN"[:4 + (i % 9 == 0)]) for _ in range(100)), None) for i in range(400)]
    params = CorrectionParams(17)
    in_task(reads[:2], set(), params)
    tracemalloc.start()
    try:
        assert {r[2] for r in in_task(reads, set(), params)} == {-1}
        assert tracemalloc.get_traced_memory()[1] < 100 * 400 * 100 * 3
    finally:
        tracemalloc.stop()


def test_what_follows_a_base_is_made_only_where_its_first_kmer_is_found(monkeypatch):
    rng = random.Random(6)
    text, k = data.genome(rng, 3000, repeats=0), 17
    clean = [text[i:i + 100] for i in range(0, 2900, 7)]
    wrong = [(c[:50] + ("A" if c[50] != "A" else "C") + c[51:], None) for c in clean]
    made, whole = [], lanes.canonical_windows
    monkeypatch.setattr(lanes, "canonical_windows", lambda codes, k: made.append(codes.size) or whole(codes, k))
    assert [r[0] for r in in_task(wrong, data.kmers(text, k), CorrectionParams(k))] == clean
    # One of four bases goes on, in each of the two directions (and for the check of the anchor).
    assert sum(made) <= 2 * 2 * len(wrong) * (2 * k - 1)


def test_only_reads_that_guessed_wrong_run_again(spark):
    """Rounds of a group, with the join done here: what the filter lets pass by mistake is found out, for those reads alone."""
    rng = random.Random(9)
    text, k = data.genome(rng, 4000), 13
    trusted = data.trusted(rng, text, k, lost=0.01, extra=0.02)
    reads = data.reads(rng, text, 400, sizes=(60, 100), k=k) + [("", None), (None, None)]
    params, index, ran = CorrectionParams(k), index_of(trusted, k), []
    members = ragged.read_windows(ragged.from_arrow(pa.array(sorted(trusted))), k).kmer
    passing = Filter(Filter.piece(hashed(members), 1 << 10))
    assert 0.0005 < passing.contains(np.arange(100_000)).mean() < 0.1
    given = T.StructType.fromDDL("file_ind int, read_idx bigint, seq string, qual string")
    rounds = _Joining(given, T.StructType([*given, *T.StructType.fromDDL("correction int, bad_prefix int, bad_suffix int, info int")]), k, True)

    def kernel(batch, alive):
        out = yield from _kernel(params)(batch, alive)
        ran.append(batch.num_rows)
        return out

    nothing, done = ragged.no_kmers(k), {}
    batches = list(rounds.step(0, batch_of(reads), kernel, Known(nothing, nothing), passing))
    while True:
        table = pa.Table.from_batches(batches, rounds.types)
        kind = table["kind"].to_numpy()
        for row in table.filter(pa.array(kind == FINISHED)).to_pylist():
            done[row["out_read_idx"]] = tuple(row[f"out_{c}"] for c in COLUMNS)
        waiting, asking = (table.filter(pa.array(kind == v)) for v in (PENDING, ASKING))
        if not waiting.num_rows:
            break
        asked = asking["asked"].combine_chunks().flatten().to_numpy()
        lacking = pa.array([asked[~index.contains(asked)].tolist()], pa.list_(pa.int64()))
        # As a shuffle leaves them.
        waiting = waiting.take(pa.array(rng.sample(range(waiting.num_rows), waiting.num_rows)))
        batches = list(rounds.answered(0, waiting.select(rounds.waiting()), asking.append_column("lacking", lacking), kernel, passing))
    plain = Brute(trusted, k)
    assert [done[i] for i in range(len(reads))] == [plain(s or "", q) for s, q in reads]
    assert ran[0] == len(reads) and 0 < ran[1] < len(reads) / 2 and sum(ran[2:]) < len(reads) / 4


def test_guessed_output_that_turns_to_null(spark):
    """It can't be told from what did not change, so such a read runs again."""
    given = T.StructType.fromDDL("file_ind int, read_idx bigint, seq string, qual string")
    rounds, ran = _Joining(given, given, 9, True), []

    def kernel(batch, alive):
        yield np.arange(batch.num_rows), np.arange(batch.num_rows) + 5
        ran.append(batch["read_idx"].to_pylist())
        qual = [None if i == 1 else q for i, q in zip(batch["read_idx"].to_pylist(), batch["qual"].to_pylist())]
        return batch.set_column(3, "qual", pa.array(qual, pa.string()))

    nothing, passing = ragged.no_kmers(9), Filter(np.full(64, ~np.uint64(0)))
    table = pa.Table.from_batches(rounds.step(0, batch_of([("AC", "II"), ("AC", "II"), ("AC", None)]), kernel, Known(nothing, nothing), passing), rounds.types)
    waiting, asking = (table.filter(pa.array(table["kind"].to_numpy() == v)) for v in (PENDING, ASKING))
    asking = asking.append_column("lacking", pa.array([[]], pa.list_(pa.int64())))
    table = pa.Table.from_batches(rounds.answered(0, waiting.select(rounds.waiting()), asking, kernel, passing), rounds.types)
    assert set(table["kind"].to_pylist()) == {FINISHED} and ran == [[0, 1, 2], [1]]
    assert sorted((r["out_read_idx"], r["out_seq"], r["out_qual"]) for r in table.to_pylist()) == [(0, "AC", "II"), (1, "AC", None), (2, "AC", None)]


def test_short_reads_and_no_trusted_kmers():
    params = CorrectionParams(7)
    assert in_task([("ACGT", "IIII"), ("", None)], set(), params) == [
        ("ACGT", "IIII", 0, 0, 0, 0), ("", None, 0, 0, 0, 0)]
    assert in_task([("ACGTACGTA", None), ("NNNNNNNNN", None)], set(), params) == [
        ("ACGTACGTA", None, -1, 0, 0, 3), ("NNNNNNNNN", None, -1, 0, 0, 3)]


def test_quality_of_another_length_is_an_error():
    with pytest.raises(ValueError):
        in_task([("ACGTACGTA", "II")], set(), CorrectionParams(5))


def test_undone_corrections_take_their_neighbours_along():
    fixed = np.zeros(13, bool)
    fixed[[1, 4, 10, 12]] = True
    over = np.zeros(13, bool)
    over[4] = True
    assert chained_to(over, fixed, np.arange(13), 4).tolist() == [1, 4]
    assert chained_to(over, fixed, np.arange(13), 7).tolist() == [1, 4, 10, 12]


@pytest.mark.parametrize("k", [9, 33])
def test_broadcast_and_join_agree_on_spark(spark, k):
    rng = random.Random(k)
    text = data.genome(rng, 300)
    trusted = data.trusted(rng, text, k, lost=0.05, extra=0.1)
    reads = data.reads(rng, text, 30, sizes=(50, 80), k=k)
    rows = [(0, i, f"@r{i}", s, q) for i, (s, q) in enumerate(reads)]
    df = spark.createDataFrame(rows, "file_ind int, read_idx bigint, id string, seq string, qual string")
    kmers = spark.createDataFrame([(t,) for t in sorted(trusted)], "kmer string")
    kmers = KmerSet.store(kmers.select(pack(kmers.kmer, k).alias("kmer")), k)
    params, plain = CorrectionParams(k), Brute(trusted, k)
    expected = [plain(*r) for r in reads]
    for bound in (10_000, 0):
        out = correct(df.repartition(3), kmers, params, max_broadcast=bound).orderBy("read_idx").collect()
        assert [tuple(r[c] for c in COLUMNS) for r in out] == expected
        assert [r.id for r in out] == [r[2] for r in rows]


def test_k_of_the_kmers_must_match(spark):
    kmers = KmerSet.store(spark.createDataFrame([(1,)], "kmer bigint"), 9)
    reads = spark.createDataFrame([(0, 0, "@a", "ACGT", None)],
                                  "file_ind int, read_idx bigint, id string, seq string, qual string")
    with pytest.raises(ValueError):
        correct(reads, kmers, CorrectionParams(11))
