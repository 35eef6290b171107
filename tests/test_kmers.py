import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendseq.functions import columns, ragged
from mendseq.functions.binomial import binomial_cdf, thresholds
from mendseq.functions.index import build_index
from mendseq.functions.sampling import PRIME, coin, coin_limit, coin_sql
from mendseq.model import kmer_type
from mendseq.operators import kmersets
from mendseq.operators.membership import KmerSet
from tests import data
from tests.brute import canonical

READS = "file_ind int, read_idx bigint, seq string, qual string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ACGTNacx", max_size=60), max_size=8), st.integers(2, 40))
def test_windows_of_a_batch(reads, k):
    w = ragged.read_windows(ragged.from_arrow(pa.array(reads, pa.string())), k)
    expected = [(r, p, s[p:p + k]) for r, s in enumerate(reads) for p in range(len(s) - k + 1)]
    assert list(zip(w.row.tolist(), w.pos.tolist())) == [(r, p) for r, p, _ in expected]
    assert w.valid.tolist() == [set(m) <= set("ACGT") for _, _, m in expected]
    for code, valid, (_, _, m) in zip(w.kmer.tolist(), w.valid, expected):
        if valid and k <= 31:
            assert code == int("".join(str("ACGT".index(c)) for c in canonical(m)), 4)
        elif valid:
            assert code.decode() == canonical(m)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ACGT", min_size=2, max_size=40))
def test_canonical_is_the_same_for_both_strands(kmer):
    both = pa.array([kmer, "".join(reversed(kmer.translate(str.maketrans("ACGT", "TGCA"))))])
    w = ragged.read_windows(ragged.from_arrow(both), len(kmer))
    assert w.kmer[0] == w.kmer[1]


@pytest.mark.parametrize("k", [2, 3, 17, 31, 32, 40])
def test_windows_with_another_base(k):
    """The same k-mers as of a text that has the base, whichever letters are around."""
    rng = random.Random(k)
    text = "".join(rng.choice("ACGTACGTACGTN") for _ in range(k + 120))
    codes = ragged.CODES[np.frombuffer(text.encode(), np.uint8)]

    def windows(text):
        w = ragged.read_windows(ragged.from_arrow(pa.array([text])), k)
        return w.kmer, w.valid

    start = np.array([rng.randrange(len(text) - k + 1) for _ in range(80)])
    at = np.array([rng.randrange(k) for _ in start])
    kmers, valid = ragged.Changing(codes, k).kmers(start[:, None], at[:, None], np.arange(4))
    following, clean = ragged.next_kmers(codes[start[:, None] + np.arange(k - 1)], k)
    many, good = ragged.canonical_windows(codes[start[:, None] + np.arange(k)], k)
    for i, (s, a) in enumerate(zip(start, at)):
        for base, letter in enumerate("ACGT"):
            kmer, ok = windows(text[s:s + a] + letter + text[s + a + 1:s + k])
            assert valid[i, base] == ok[0] and (not ok[0] or kmers[i, base] == kmer[0])
            kmer, ok = windows(text[s:s + k - 1] + letter)
            assert clean[i] == ok[0] and (not ok[0] or following[i, base] == kmer[0])
        kmer, ok = windows(text[s:s + k])
        assert good[i, 0] == ok[0] and (not ok[0] or many[i, 0] == kmer[0])


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**62 - 1)), st.lists(st.integers(0, 2**62 - 1)))
def test_packed_index(members, others):
    index = build_index(np.array(sorted(members), dtype=np.int64))
    asked = np.array([*members, *others], dtype=np.int64)
    assert index.contains(asked).tolist() == [int(a) in members for a in asked]


def test_sliced_and_null_strings():
    array = pa.array(["AC", None, "GGT", "", "T"]).slice(1, 3)
    r = ragged.from_arrow(array)
    assert r.length.tolist() == [0, 3, 0] and r.flat.tobytes() == b"GGT"
    assert ragged.to_arrow(r.flat, r.length, np.array([True, False, False])).to_pylist() == [None, "GGT", ""]


def test_batches_are_cut_by_bases():
    batch = pa.RecordBatch.from_arrays([pa.array(["A" * n for n in (3, 4, 5, 30, 1, 1)])], names=["seq"])
    out = list(ragged.slices([batch], max_bases=10))
    assert [s for b in out for s in b["seq"].to_pylist()] == batch["seq"].to_pylist()
    assert len(out) > 2


@pytest.mark.parametrize("k", [5, 31, 32, 45])
def test_column_functions(spark, k):
    rng = random.Random(k)
    rows = [("".join(rng.choice("ACGT") for _ in range(k)),) for _ in range(20)] + [("T" * k,), ("A" * k,)]
    df = spark.createDataFrame(rows, "kmer string")
    least = columns.canonical(F.col("kmer"))
    out = df.select("kmer", least.alias("c"), columns.pack(least, k).alias("code")).withColumn(
        "back", columns.unpack(F.col("code"), k))
    assert out.schema["code"].dataType == kmer_type(k)
    for row in out.collect():
        assert row.c == row.back == canonical(row.kmer)
    short = spark.createDataFrame([("ACG",), ("ACGNT",)], "seq string")
    assert [r[0] for r in short.select(columns.windows(F.col("seq"), 4)).collect()] == [[], ["ACGN", "CGNT"]]


def test_coin_is_the_same_in_sql_and_is_fair(spark):
    file_ind, read_idx = np.array([0, 3, 1]), np.array([5, 2**40 + 1, 7])
    pos = np.array([0, 10, 99])
    rows = [tuple(int(v) for v in row) for row in zip(file_ind, read_idx, pos)]
    df = spark.createDataFrame(rows, "f bigint, r bigint, p bigint")
    assert [x[0] for x in df.select(F.expr(coin_sql("f", "r", "p"))).collect()] == \
        coin(file_ind, read_idx, pos).tolist()
    drawn = coin(np.int64(0), np.repeat(np.arange(4000), 100), np.tile(np.arange(100), 4000)) < coin_limit(0.1)
    grid = drawn.reshape(4000, 100)
    assert abs(drawn.mean() - 0.1) < 0.003
    assert grid.mean(axis=0).std() < 0.01 and abs(np.corrcoef(grid[:, 10], grid[:, 11])[0, 1]) < 0.05
    assert coin(np.int64(0), np.arange(1000), np.int64(3)).max() < PRIME


def test_thresholds():
    assert thresholds(0.1, 17)[1:] == [1, 2, 3, 3, 4, 4, 4, 5, 5, 5, 6, 6, 7, 7, 7, 8, 8]
    assert thresholds(0.1, 17, 0.01)[1:] == [1, 2, 3, 3, 4, 4, 4, 5, 5, 6, 6, 6, 7, 7, 7, 8, 8]
    assert binomial_cdf(3, 0.5) == pytest.approx([0.125, 0.5, 0.875, 1])
    for alpha in (0, 1, -0.1, 2):
        with pytest.raises(ValueError):
            thresholds(alpha, 17)


def plain_trusted(reads, sampled, k, table, cutoff):
    """Positions and k-mers that set A vouches for, one read at a time."""
    profile, out = [], set()
    for seq, qual in reads:
        hit = [set(seq[s:s + k]) <= set("ACGT") and canonical(seq[s:s + k]) in sampled
               for s in range(len(seq) - k + 1)]
        trust, windows, hits = [], [], []
        for i in range(len(seq)):
            over = hit[max(0, i - k + 1):i + 1]
            windows.append(len(over))
            hits.append(sum(over))
            trust.append(sum(over) > table[len(over)] and not (qual and ord(qual[i]) <= cutoff))
        profile.append((windows, hits, trust))
        out |= {canonical(seq[s:s + k]) for s in range(len(seq) - k + 1) if all(trust[s:s + k])}
    return profile, out


@pytest.mark.parametrize("k", [7, 33])
def test_sampled_and_trusted_kmers(spark, k):
    rng = random.Random(k)
    text = data.genome(rng, 200)
    reads = data.reads(rng, text, 150, sizes=(k, 3 * k + 20), k=k)
    df = spark.createDataFrame([(0, i, s, q) for i, (s, q) in enumerate(reads)], READS).repartition(5)
    at = [(i, p, s[p:p + k]) for i, (s, _) in enumerate(reads) for p in range(len(s) - k + 1)]
    valid = [(i, p, canonical(m)) for i, p, m in at if set(m) <= set("ACGT")]

    def lettered(kmers):
        return {r[0] for r in kmers.select(columns.unpack(F.col("kmer"), k)).collect()}

    assert lettered(kmersets.all_kmers(df, k)) == {m for _, _, m in valid}
    alpha = 0.4
    coins = coin(np.int64(0), np.array([i for i, _, _ in valid]), np.array([p for _, p, _ in valid]))
    drawn = [v for v, c in zip(valid, coins) if c < coin_limit(alpha)]
    sampled = kmersets.sampled_kmers(df, k, alpha)
    assert lettered(sampled) == {m for _, _, m in drawn}
    found = kmersets.kmer_occurrences(df, k, alpha)
    assert {(r.read_idx, r.pos) for r in found.collect()} == {(i, p) for i, p, _ in drawn}

    table = [0] + [max(1, n // 3) for n in range(1, k + 1)]
    profile, expected = plain_trusted(reads, {m for _, _, m in drawn}, k, table, 40)
    stored = KmerSet.store(sampled, k)
    for bound in (1 << 20, 0):
        assert lettered(kmersets.trusted_kmers(df, stored, table, 40, bound)) == expected
    rows = kmersets.position_profile(df, stored, table, 40).orderBy("read_idx").collect()
    for row, (windows, hits, trust) in zip(rows, profile):
        if any(windows):
            assert (row.n_windows, row.n_hits, row.trusted) == (windows, hits, trust)
        else:
            assert not any(row.trusted)


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    text = data.genome(rng, 200)
    rows = [(0, i, s, q) for i, (s, q) in enumerate(data.reads(rng, text, 80))]
    df = spark.createDataFrame(rows, READS)
    one, many = (kmersets.sampled_kmers(df.repartition(n), 7, 0.3) for n in (1, 7))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_long_sequences_are_cut(spark, monkeypatch):
    rng = random.Random(9)
    reads = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 4, 5, 6, 24, 25, 26, 300)]
    df = spark.createDataFrame([(s,) for s in reads] + [(None,)], "seq string")
    whole = {r.kmer: r.n_occurrences for r in kmersets.kmer_counts(df, 5).collect()}
    distinct = {r.kmer for r in kmersets.all_kmers(df, 5).collect()}
    monkeypatch.setattr(kmersets, "PIECE", 7)
    assert {r.kmer: r.n_occurrences for r in kmersets.kmer_counts(df, 5).collect()} == whole
    assert {r.kmer for r in kmersets.all_kmers(df, 5).collect()} == distinct
    assert max(len(r.seq) for r in kmersets.in_pieces(df, 5).collect()) == 11


def test_many_long_kmers_are_one_array():
    kmers = np.tile(np.array([b"ACGT" * 10 + b"A", b"TGCA" * 10 + b"C"]), 300_000)
    column = ragged.kmers_to_arrow(kmers)
    assert isinstance(column, pa.Array) and column.type == pa.string() and len(column) == len(kmers)
    assert column[0].as_py() == "ACGT" * 10 + "A" and column[-1].as_py() == "TGCA" * 10 + "C"
    assert len(ragged.kmers_to_arrow(kmers[:0])) == 0


def test_a_base_is_counted_for_its_own_read_only():
    """Windows over each base, and those in set A, whatever reads lie beside it."""
    rng = random.Random(4)
    k, reads = 5, ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(14))) for _ in range(60)] + ["ACGTACG"]
    quals = ["".join(rng.choice("#I") for _ in r) or None for r in reads]
    for given in (quals, quals[:-1] + [None], [None] * len(reads)):
        seq, qual = (ragged.from_arrow(pa.array(v, pa.string())) for v in (reads, given))
        w = ragged.read_windows(seq, k)
        hit = w.valid & (w.kmer % 3 > 0)
        table = np.array([0, 0, 0, 1, 1, 2])
        c = kmersets.Coverage(seq, qual, w, hit, k, table, ord("#"))
        at, trusted, whole = 0, [], []
        for r, (s, q) in enumerate(zip(reads, given)):
            mine = [(int(p), bool(h)) for row, p, h in zip(w.row, w.pos, hit) if row == r]
            here = []
            for p in range(len(s)):
                over = [h for start, h in mine if start <= p < start + k]
                assert (c.n_windows[at + p], c.n_hits[at + p], c.row[at + p], c.pos[at + p]) == (len(over), sum(over), r, p)
                here.append(len(over) > 0 and sum(over) > table[len(over)] and not (q and q[p] == "#"))
            at += len(s)
            trusted += here
            whole += [all(here[p:p + k]) for p, _ in mine]
        assert c.trusted.tolist() == trusted
        assert c.kmer_trusted.tolist() == (np.array(whole, bool) & w.valid).tolist()
