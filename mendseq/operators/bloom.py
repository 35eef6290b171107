"""An optional approximate k-mer set in a block Bloom filter.

Every key sets a fixed number of bits inside one 256-bit block, so a probe touches
one cache line. The filter is a table with one row per 64-bit word, made and probed in
parts of PART_BLOCKS blocks: keys are sent to the part of their block, many in a row,
and meet its words there. It is never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mendseq.model import MAX_PACKED_K

# Fixed values of the sizing rule.
BLOCK_BITS = 256
WORDS = BLOCK_BITS // 64
MAX_HASHES = 999
CAPACITY_PER_BASE = 1.5
SAMPLED_FP, TRUSTED_FP = 0.01, 0.0005
HIGH_ERROR_FP = 0.1
# Blocks that one group makes or probes, and keys worked on at once.
PART_BLOCKS = 1 << 10
LOT = 1 << 18
# What a row sent to a part holds.
ASKED, MEMBER, WORD = range(3)


@dataclass(frozen=True)
class BloomSize:
    capacity: int
    hashes: int
    bits: int

    @classmethod
    def optimal(cls, capacity: int, false_positive: float) -> BloomSize:
        def bits(h: int) -> float:
            return -h * capacity / log(1 - false_positive ** (1 / h)) + BLOCK_BITS

        hashes = min(range(2, MAX_HASHES + 1), key=bits)
        return cls(capacity, hashes, -(-int(bits(hashes)) // 8) * 8)

    @classmethod
    def for_genome(cls, genome_size: int, false_positive: float) -> BloomSize:
        return cls.optimal(int(genome_size * CAPACITY_PER_BASE), false_positive)

    def modelled_fp(self, n_distinct: int) -> float:
        """The false positive rate once ``n_distinct`` keys are in."""
        return (1 - exp(-self.hashes * n_distinct / self.bits)) ** self.hashes


def sizing(genomes: DataFrame) -> DataFrame:
    """(name, capacity, hashes, bits) of both filters as a query on one row with ``genome_size``."""
    limits = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(fp).alias("fp")) for n, fp in (("a", SAMPLED_FP), ("b", TRUSTED_FP))])
    h, capacity = F.col("hashes"), F.col("capacity")
    tried = genomes.select(F.floor(F.col("genome_size") * CAPACITY_PER_BASE).alias("capacity"), F.inline(limits)).select(
        "name", "fp", "capacity", F.explode(F.sequence(F.lit(2), F.lit(MAX_HASHES))).alias("hashes"))
    bits = -h * capacity / F.log(1 - F.pow("fp", F.lit(1.0) / h)) + BLOCK_BITS
    best = F.min_by(F.struct("hashes", "size"), F.struct("size", "hashes")).alias("best")
    return tried.withColumn("size", bits).groupBy("name", "capacity").agg(best).select(
        "name", "capacity", "best.hashes", (F.ceil(F.floor("best.size") / 8) * 8).alias("bits"))


def adaptation(sizes: DataFrame, n_distinct: Column, max_corrections: int, cutoff: Column) -> DataFrame:
    """``sizes`` with the false positive rate after ``n_distinct`` keys, and the limits that follow."""
    rate = F.pow(1 - F.exp(-F.col("hashes") * n_distinct / F.col("bits")), F.col("hashes"))
    crowded = F.col("fp") > HIGH_ERROR_FP
    return sizes.withColumn("fp", rate).withColumns({
        "max_corrections": F.lit(max_corrections) + crowded.cast("int"),
        "cutoff": cutoff + (crowded & (cutoff > 0)).cast("int")})


def adapt_to_errors(false_positive: float, max_corrections: int, cutoff: int) -> tuple[int, int]:
    """A crowded set A means many errors: allow one more correction, raise the cutoff."""
    if false_positive <= HIGH_ERROR_FP:
        return max_corrections, cutoff
    return max_corrections + 1, cutoff + 1 if cutoff else 0


# Fixed values of the 64-bit mixing function.
SEED_STEP = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(seed * SEED_STEP % 2**64)
    for shift, factor in zip((30, 27), MIX):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _blocks_of(keys: np.ndarray, size: BloomSize) -> np.ndarray:
    return (_mixed(keys, 1) % np.uint64(max(size.bits // BLOCK_BITS, 1))).astype(np.int64)


def bit_positions(keys: np.ndarray, size: BloomSize) -> np.ndarray:
    """(n, hashes): the bits of each key, all inside its block."""
    block = _blocks_of(keys, size) * BLOCK_BITS
    cols = [(_mixed(keys, 2 + h) % np.uint64(BLOCK_BITS)).astype(np.int64) for h in range(size.hashes)]
    return block[:, None] + np.stack(cols, axis=1)


def may_contain(bits: np.ndarray, keys: np.ndarray, size: BloomSize) -> np.ndarray:
    return bits[bit_positions(keys, size)].all(axis=1)


def _in_parts(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: int) -> DataFrame:
    """(part, kind, key, bits): the rows of ``df`` (its first column the key, bits the second if any) as one row per part and lot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            lot = pa.Table.from_batches(held)
            held.clear()
            key = lot.column(0).to_numpy()
            if lot.num_columns == 1:
                key = np.unique(key)
            at = part(key)
            order = np.argsort(at, kind="stable")
            parts, first = np.unique(at[order], return_index=True)
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            bits = lot.column(1).to_numpy()[order] if lot.num_columns > 1 else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), kind, np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(key[order])),
                 pa.ListArray.from_arrays(ends if len(bits) else pa.array(np.zeros(len(parts) + 1, np.int32)), pa.array(bits))],
                names=["part", "kind", "key", "bits"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LOT:
                yield out()
        if held:
            yield out()

    return df.mapInArrow(task, "part int, kind int, key array<bigint>, bits array<bigint>")


def _part_of(size: BloomSize) -> Callable[[np.ndarray], np.ndarray]:
    return lambda keys: _blocks_of(keys, size) // PART_BLOCKS


def _values(table: pa.Table, kind: int, name: str) -> np.ndarray:
    rows = table.filter(pc.equal(table["kind"], kind))
    return rows[name].combine_chunks().flatten().to_numpy()


def bloom_blocks(kmers: DataFrame, size: BloomSize, k: int) -> DataFrame:
    """(block, word, bits): the words of the filter that are not zero."""
    if k > MAX_PACKED_K:
        raise ValueError(f"the Bloom option needs packed k-mers, k <= {MAX_PACKED_K}")
    schema = T.StructType.fromDDL("block bigint, word int, bits bigint")

    def made(key: tuple, table: pa.Table) -> pa.Table:
        words = np.zeros(PART_BLOCKS * WORDS, np.uint64)
        base = key[0].as_py() * PART_BLOCKS * BLOCK_BITS
        keys = _values(table, MEMBER, "key")
        for s in range(0, len(keys), LOT):
            bit = (bit_positions(keys[s:s + LOT], size) - base).ravel()
            np.bitwise_or.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        return pa.table([pa.array(base // BLOCK_BITS + at // WORDS), pa.array((at % WORDS).astype(np.int32)),
                         pa.array(words[at].view(np.int64))], schema=to_arrow_schema(schema))

    return _in_parts(kmers.select("kmer"), _part_of(size), MEMBER).groupBy("part").applyInArrow(made, schema)


def occupancy(blocks: DataFrame, size: BloomSize) -> DataFrame:
    """One row: the share of bits set, and the false positive rate measured from it.

    A probe of a block succeeds by chance when all its bits happen to be set, so the
    rate is the mean over all blocks, empty ones included.
    """
    n_blocks = max(size.bits // BLOCK_BITS, 1)
    filled = blocks.groupBy("block").agg(F.sum(F.bit_count("bits")).alias("n_set"))
    return filled.agg(
        (F.coalesce(F.sum("n_set"), F.lit(0)) / (n_blocks * BLOCK_BITS)).alias("occupancy"),
        (F.coalesce(F.sum(F.pow(F.col("n_set") / BLOCK_BITS, F.lit(size.hashes))), F.lit(0.0))
         / n_blocks).alias("false_positive"))


def probe(requests: DataFrame, blocks: DataFrame, size: BloomSize, members: DataFrame | None = None) -> DataFrame:
    """Distinct ``kmer`` of ``requests`` with ``maybe``: every bit of the key is set in the filter.

    With ``members``, distinct k-mers too, ``member`` tells which of the requests are among them.
    """
    told = members is not None
    schema = T.StructType.fromDDL("kmer bigint, maybe boolean" + (", member boolean" if told else ""))
    types = to_arrow_schema(schema)

    def answered(key: tuple, table: pa.Table) -> pa.Table:
        words = np.zeros(PART_BLOCKS * WORDS, np.uint64)
        base = key[0].as_py() * PART_BLOCKS * BLOCK_BITS
        words[_values(table, WORD, "key") - base // 64] = _values(table, WORD, "bits").view(np.uint64)
        asked = np.unique(_values(table, ASKED, "key"))
        maybe = np.ones(len(asked), bool)
        for s in range(0, len(asked), LOT):
            bit = bit_positions(asked[s:s + LOT], size) - base
            maybe[s:s + LOT] = (words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)
        found = [pa.array(asked), pa.array(maybe)]
        if told:
            found.append(pa.array(np.isin(asked, _values(table, MEMBER, "key"))))
        return pa.table(found, schema=types)

    given = _in_parts(requests.select("kmer"), _part_of(size), ASKED).unionAll(_in_parts(
        blocks.select(F.col("block") * WORDS + F.col("word"), "bits"), lambda words: words // (PART_BLOCKS * WORDS), WORD))
    if told:
        given = given.unionAll(_in_parts(members.select("kmer"), _part_of(size), MEMBER))
    return given.groupBy("part").applyInArrow(answered, schema)
