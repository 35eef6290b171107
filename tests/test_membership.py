import random

import numpy as np
import pyarrow as pa
import pytest

from mendseq.functions import index
from mendseq.functions.index import Filter, Layout, PackedIndex, hashed, packed_bits
from mendseq.operators import membership
from mendseq.operators.kmersets import all_kmers, batch_kmers, window_hits
from mendseq.operators.membership import KmerSet, Known, gathered, run_known
from mendseq.plans.workspace import Workspace
from tests import data

READS = "file_ind int, read_idx bigint, seq string"


def test_a_kmer_most_reads_share(spark, monkeypatch):
    """Nearly all windows are the same k-mer, in the set or not."""
    monkeypatch.setattr(membership, "GROUP_BASES", 300)
    reads = [(0, i, "A" * 20 if i % 3 else "ACGTTGCACC") for i in range(200)]
    reads += [(0, 200 + i, "C" * 12) for i in range(100)]
    df = spark.createDataFrame(reads, READS).repartition(4)
    kmers = KmerSet.store(spark.createDataFrame([(0,), (int("01233210", 4),)], "kmer bigint"), 8)
    near = window_hits(df, kmers)
    far = window_hits(df, kmers, max_broadcast=0)
    def key(row):
        return row.read_idx, row.n_windows, sorted(row.solid), [tuple(r) for r in row.runs]

    expected = sorted(map(key, near.collect()))
    assert sorted(map(key, far.collect())) == expected
    assert expected[1] == (1, 13, list(range(13)), [(0, 13)])


def test_the_broadcast_bound_counts_bytes(spark):
    packed = KmerSet(spark.range(1), 17, rows=1000)
    letters = KmerSet(spark.range(1), 50, rows=1000)
    assert packed.fits(8000) and not packed.fits(7999)
    assert letters.fits(50_000) and not letters.fits(49_999)


def test_found_kmers(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [7]), (3, [6])], "group_id bigint, asked array<bigint>")
    kmers = KmerSet.store(spark.createDataFrame([(6,)], "kmer bigint"), 8)
    with kmers.bucketed().opened(spark) as members:
        rows = membership.found_kmers(df, members).orderBy("group_id").collect()
    assert [tuple(r) for r in rows] == [(1, [6]), (3, [6])]


def test_lacking_kmers(spark):
    """Only those come back: of what passes a filter they are few."""
    df = spark.createDataFrame([(1, [5, 6]), (2, [7]), (3, [6]), (4, [])], "group_id bigint, asked array<bigint>")
    kmers = KmerSet.store(spark.createDataFrame([(6,)], "kmer bigint"), 8)
    with kmers.bucketed().opened(spark) as members:
        rows = membership.found_kmers(df, members, "left_anti").orderBy("group_id").collect()
    assert [tuple(r) for r in rows] == [(1, [5]), (2, [7])]


def test_the_set_is_not_moved(spark):
    df = spark.createDataFrame([(1, [5, 6])], "group_id bigint, asked array<bigint>")
    kmers = KmerSet.store(spark.range(100).withColumnRenamed("id", "kmer"), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with kmers.bucketed().opened(spark) as members:
            joined = membership.found_kmers(df, members)
            plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # What is asked, and the answers of each group: nothing of the set.
    assert plan.count("Exchange hashpartitioning") == 2


def test_buckets_are_written_once_and_leave_no_table(spark):
    kmers = KmerSet.store(spark.range(100).withColumnRenamed("id", "kmer"), 8)
    with kmers.bucketed().opened(spark) as members:
        assert members.count() == 100
    assert kmers.bucketed() is kmers.bucketed()
    with kmers.bucketed().opened(spark) as members:
        assert members.where("kmer = 7").count() == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mendseq_")]


@pytest.mark.parametrize("k", [4, 17, 31, 33])
def test_index_and_filter_made_in_parts(spark, monkeypatch, k):
    """As those made at once: the index exact, the filter without a miss and with few others."""
    rng = np.random.default_rng(k)
    packed = np.unique(rng.integers(0, 1 << min(2 * k, 62), 150 if k == 4 else 20_000))
    kmers, others = packed[::2], packed[1::2]
    if k > 31:
        kmers, others = ([f"{v:064b}".translate({48: "A", 49: "C"})[-k:] for v in s] for s in (kmers, others))
        kmers, others = sorted(set(kmers)), sorted(set(others) - set(kmers))
    df = spark.createDataFrame([(v if k > 31 else int(v),) for v in kmers], "kmer string" if k > 31 else "kmer bigint")
    made = KmerSet(df.repartition(3), k, len(kmers))
    inside, outside = (np.array(v, f"S{k}" if k > 31 else np.int64) for v in (kmers, others))
    for rows in (1 << 19, 1000):
        monkeypatch.setattr(membership, "PART_ROWS", rows)
        index, passing = made.index(), made.filter()
        assert index.contains(inside).all() and not index.contains(outside).any()
        assert passing.contains(inside).all() and passing.contains(outside).mean() < 0.05


@pytest.mark.parametrize("rows, most", [(1 << 16, 0.0002), ((1 << 16) + 1, 0.00003), (1 << 17, 0.0002)])
def test_few_others_pass_a_filter(rows, most):
    """At 16 to 32 bits a k-mer."""
    rng = np.random.default_rng(rows)
    kmers = np.unique(rng.integers(0, 1 << 34, rows + 400_000))
    rng.shuffle(kmers)
    passing = Filter(Filter.piece(hashed(kmers[:rows]), Filter.size(rows)))
    assert passing.contains(kmers[:rows]).all() and passing.contains(kmers[rows:]).mean() < 8 * most


def test_a_filter_of_few_bits(spark, monkeypatch):
    """Below 8 bits a k-mer one word does better than two; none is missed, in parts or not."""
    monkeypatch.setattr(index, "MAX_FILTER_BYTES", 1 << 13)
    kmers = np.unique(np.random.default_rng(2).integers(0, 1 << 34, 40_000))
    inside, outside = kmers[::2], kmers[1::2]
    df = spark.createDataFrame([(int(v),) for v in inside], "kmer bigint")
    for rows in (1 << 19, 1000):
        monkeypatch.setattr(membership, "PART_ROWS", rows)
        made = KmerSet(df.repartition(3), 17, len(inside))
        passing = made.filter()
        assert not made.filters() and not passing.both and passing.contains(inside).all()
        assert passing.contains(outside).mean() < 0.3


def test_an_index_takes_few_bytes_and_bounds_what_is_broadcast(spark):
    """18 million k-mers, as 9 million reads sample: 128 MiB of codes before, some four bytes each now."""
    kmers = KmerSet(spark.range(1), 17, rows=18_000_000)
    layout = Layout(kmers.rows, packed_bits(17))
    assert layout.bytes <= 4 * kmers.rows and kmers.fits()
    assert not KmerSet(spark.range(1), 17, rows=140_000_000).fits()
    assert not KmerSet(spark.range(1), 31, rows=60_000_000).fits()
    small = PackedIndex(Layout(3, 34), [Layout(3, 34).piece(Layout(3, 34).mixed(np.arange(3)))])
    assert len(small.fine) * 2 + small.rest.nbytes <= Layout(3, 34).bytes + 2


def test_what_fails_the_filter_is_not_asked():
    """Only k-mers the filter lets pass are asked; with answers all reads finish."""
    passing = Filter(Filter.piece(hashed(np.arange(100)), Filter.size(100)))
    asked = np.array([5, 1 << 30, 7, 1 << 31])
    assert passing.contains(asked).tolist() == [True, False, True, False]

    def kernel(batch, alive):
        first = yield np.arange(4), asked
        second = yield np.flatnonzero(first), asked[first] + 1
        return pa.RecordBatch.from_arrays([pa.array(first)[:0] if not alive.any() else pa.array(first[alive])], names=["hit"])

    batch = pa.RecordBatch.from_arrays([pa.array(range(4))], names=["read_idx"])
    nothing = Known(*[np.zeros(0, np.int64)] * 2)
    out, waits, (yes, no, wanted) = run_known(batch, kernel, nothing, True, passing)
    assert waits.tolist() == [True, False, True, False] and out.to_pydict() == {"hit": [False, False]}
    assert sorted(wanted.tolist()) == [5, 6, 7, 8] and not len(yes) + len(no)
    out, waits, _ = run_known(batch, kernel, Known(np.array([5, 6]), np.array([7, 8])), True, passing)
    assert not waits.any() and out.to_pydict() == {"hit": [True, False, False, False]}


def test_what_fails_the_filter_is_not_looked_up(monkeypatch):
    passing = Filter(Filter.piece(hashed(np.arange(100)), Filter.size(100)))
    others = np.arange(1 << 30, (1 << 30) + 1000)
    asked = np.concatenate([np.arange(20), others[~passing.contains(others)]])
    looked, whole = [], Known.look_up
    monkeypatch.setattr(Known, "look_up", lambda known, kmers: looked.append(len(kmers)) or whole(known, kmers))

    def kernel(batch, alive):
        hit = yield np.zeros(len(asked), np.int64), asked
        return pa.RecordBatch.from_arrays([pa.array([int(hit.sum())])[:alive.sum()]], names=["hits"])

    batch = pa.RecordBatch.from_arrays([pa.array([0])], names=["read_idx"])
    out, waits, _ = run_known(batch, kernel, Known(np.arange(15), np.arange(15, 20)), True, passing)
    assert looked == [20] and not waits.any() and out.to_pydict() == {"hits": [15]}


def test_a_kernel_without_reads_is_not_run_on():
    """Where every read waits for an answer, nothing is made of guesses."""
    ran = []

    def kernel(batch, alive):
        hit = yield np.arange(2), np.array([5, 6])
        ran.append(hit.tolist())
        return pa.RecordBatch.from_arrays([pa.array(hit[alive])], names=["hit"])

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1])], names=["read_idx"])
    nothing = np.zeros(0, np.int64)
    out, waits, (yes, no, asked) = run_known(batch, kernel, Known(nothing, nothing))
    assert not ran and not out.num_rows and waits.all() and asked.tolist() == [5, 6] and not len(yes) + len(no)
    out, waits, _ = run_known(batch, kernel, Known(np.array([5]), nothing))
    assert ran == [[True, False]] and out.to_pydict() == {"hit": [True]} and waits.tolist() == [False, True]


@pytest.mark.parametrize("k", [7, 31, 33])
def test_known_kmers(k):
    rng = np.random.default_rng(k)
    kmers = np.unique(rng.integers(0, 1 << min(2 * k, 62), 50_000))
    if k > 31:
        kmers = np.array(sorted({f"{v:064b}".translate({48: "A", 49: "C"})[-k:] for v in kmers}), f"S{k}")
    yes, no, others = kmers[::3], kmers[1::3], kmers[2::3]
    found, member = Known(yes, no).look_up(np.concatenate([others, no, yes, others]))
    n = len(others)
    assert found.tolist() == [False] * n + [True] * (len(no) + len(yes)) + [False] * n
    assert member.tolist() == [False] * (n + len(no)) + [True] * len(yes) + [False] * n


def test_gathered_reads_repeat_their_kmers_in_a_batch(spark):
    """The same reads; what a batch gives shrinks by coverage. Reads without a k-mer and repeated ones are kept."""
    rng = random.Random(8)
    text = data.genome(rng, 20_000)
    rows = [(0, i, text[s:s + 100]) for i in range(4000) for s in [rng.randrange(19_900)]] + [(0, 1, None), (0, 2, "AC"), (0, 2, "AC")]
    reads = spark.createDataFrame(rows, "file_ind int, read_idx bigint, seq string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        near = gathered(reads, 17)
        assert sorted(map(tuple, near.collect()), key=repr) == sorted(rows, key=repr)
        assert 2 * batch_kmers(near, 17).count() < batch_kmers(reads, 17).count()
        assert all_kmers(near, 17).count() == all_kmers(reads, 17).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_views_share_the_sample(spark):
    """Set A is drawn by file, read and position, so other qualities give the same one."""
    w = Workspace(spark, "none", reads=spark.createDataFrame([], "file_ind int, read_idx bigint, id string, seq string, qual string"))
    assert w.changed("noqual", use_quality=False).like is w and w.view("fasta").like is w
    assert w.view("two_files").like is None and w.changed("other", alpha=0.5).like is None
