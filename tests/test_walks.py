import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendseq.functions import index
from mendseq.functions.nodes import WALK, Nodes
from mendseq.model import CorrectionParams
from mendseq.operators import walks
from mendseq.operators.correct import correct
from mendseq.operators.kmersets import all_kmers
from mendseq.operators.membership import KmerSet
from mendseq.session import materialize

READS = "file_ind int, read_idx bigint, id string, seq string, qual string"
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def back(s):
    return s[::-1].translate(COMPLEMENT)


def plain_walks(kmers):
    """{node: (exts, walk, last)} by following letters."""
    exts = {}
    for s in kmers:
        for t in (s, back(s)):
            exts.setdefault(t[:-1], set()).add(t[-1])
    out = {}
    for node, letters in exts.items():
        here, walk = node, ""
        while len(walk) < WALK and len(exts.get(here, ())) == 1:
            walk += min(exts[here])
            here = (node + walk)[len(walk):]
        out[node] = sorted(letters), walk, sorted(exts.get(here, ())) if walk else []
    return out


def letters(bits):
    return [c for i, c in enumerate("ACGT") if bits >> i & 1]


@pytest.mark.parametrize("k", [5, 16, 31, 32, 40])
def test_walks_against_following_letters(spark, k):
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    genome += "ACGGT" * 12 + genome[40:40 + 2 * k] + "T" + genome[90:90 + k]
    kmers = sorted({min(s, back(s)) for s in (genome[i:i + k] for i in range(len(genome) - k + 1))})
    if k <= 31:
        df = spark.createDataFrame([(int("".join(str("ACGT".index(c)) for c in s), 4),) for s in kmers], "kmer bigint")
    else:
        df = spark.createDataFrame([(s,) for s in kmers], "kmer string")
    nodes = materialize(walks.nodes_of(df, k), "nodes")

    def spelled(node):
        return node if k > 31 else "".join("ACGT"[node >> 2 * i & 3] for i in range(k - 2, -1, -1))

    found = {spelled(r.node): (letters(r.exts), r.walk, letters(r.last)) for r in walks.walks_of(nodes, k).collect()}
    assert found == plain_walks(kmers)
    # A walk tells of every node on it.
    codec = Nodes(k)
    rows = [(n, *v) for n, v in found.items()]
    code = np.array([["ACGT".index(c) for c in n] for n, *_ in rows], np.int64)
    bits = [np.array([sum(1 << "ACGT".index(c) for c in r[i]) for r in rows], np.int64) for i in (1, 3)]
    known, exts = codec.walked(codec.of_bases(code), bits[0], [r[2] for r in rows], bits[1])
    facts = walks.Facts(codec, known, exts)
    want = {}
    for node, (e, walk, last) in found.items():
        for i in range(len(walk) + 1):
            here = (node + walk[:i])[i:]
            want[here] = found[here][0] if here in found else []
    assert {(n.decode() if k > 31 else spelled(int(n))): letters(int(e)) for n, e in zip(facts.nodes, facts.exts)} == want


def test_facts_answer_for_both_strands():
    codec = Nodes(3)
    facts = walks.Facts(codec, np.array([0b0001]), np.array([0b0100]))  # AC goes on with G
    asked = np.array([0b000110, 0b000111, 0b101111, 0b011011])  # ACG, ACT, GTT (AAC on the other strand), CGT (ACG on the other strand)
    known, member, _ = facts.look_up(asked)
    assert known.tolist() == [True, True, False, True] and member.tolist() == [True, False, False, True]


def test_only_what_comes_before_a_miss_counts():
    chain = np.array([0, 0, 0, 1, 1, 4, 4, 4])
    miss = np.array([0, 1, 0, 0, 0, 1, 0, 1], bool)
    assert walks.after_a_miss(chain, miss).tolist() == [False, False, True, False, False, False, True, True]
    assert walks.after_a_miss(chain[:0], miss[:0]).tolist() == []


def noisy(genome, length, n, rate, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = rng.randrange(len(genome) - length + 1)
        seq = [rng.choice("ACGTN") if rng.random() < rate else c for c in genome[at:at + length]]
        seq = "".join(seq)
        rows.append((0, i, f"@r{i}", back(seq.replace("N", "A")) if i % 2 else seq, "".join(rng.choice("#I") for _ in seq)))
    return rows + [(0, n, "@short", "ACG", "III"), (0, n + 1, "@other", "NNNN" * 30, "I" * 120), (0, n + 2, "@far", "ACCA" * 40, "I" * 160)]


@pytest.mark.parametrize("k, length, n, rate", [(17, 100, 150, 0.06), (41, 300, 60, 0.02), (17, 5000, 8, 0.03)])
def test_rounds_don_t_grow_with_reads(spark, monkeypatch, k, length, n, rate):
    """As by broadcast, in few rounds, with a repeat that branches and gaps in the set."""
    monkeypatch.setattr(walks, "GROUP_BASES", 40 * length)
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(6000))
    genome = genome[:3000] + genome[1000:1080] + genome[3000:]
    reads = spark.createDataFrame(noisy(genome, length, n, rate, 5), READS).repartition(3)
    holes = genome[:2000], genome[2003:4500], genome[4490:]
    kmers = KmerSet.store(all_kmers(spark.createDataFrame([(s,) for s in holes], "seq string"), k), k)
    params = CorrectionParams(k=k, cutoff=ord("#"))
    near = correct(reads, kmers, params)
    far = correct(reads, kmers, params, max_broadcast=0)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))
    assert far.where(F.col("correction") > 0).count() > n // 3
    rounds = {f.split("round=")[1].split("/")[0] for f in far.inputFiles()}
    assert len(rounds) <= 8
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mendseq_")]


def test_sets_that_overfill_the_filter_go_by_walks(spark, monkeypatch):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(2000))
    reads = spark.createDataFrame(noisy(genome, 100, 60, 0.05, 3), READS).repartition(3)
    kmers = KmerSet.store(all_kmers(spark.createDataFrame([(genome,)], "seq string"), 17), 17)
    params = CorrectionParams(k=17, cutoff=ord("#"))
    near = correct(reads, kmers, params)
    monkeypatch.setattr(index, "MAX_FILTER_BYTES", kmers.rows - 1)
    far = correct(reads, kmers, params, max_broadcast=0)
    assert kmers.walks is not None
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))
