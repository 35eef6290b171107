"""Asking a k-mer set of any size through its neighbourhoods.

The set is kept as a table of *nodes*: all k-1 bases that a k-mer begins with, on
either strand, with the bases that go on there (``exts``, a bit each) and the walk that
starts there, up to WALK bases as long as one base only goes on. Walks are made by
doubling: five joins of the table with itself.

A group of reads that asks for a node and its walk learns of every node on the way
which k-mers begin there, so it can go on for as many bases without asking again. From the
second round on a read that stops asks at each gap of its trusted k-mers at once, so
the number of rounds doesn't grow with the length of reads or the number of their errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendseq.functions import ragged
from mendseq.functions.nodes import WALK, Nodes
from mendseq.model import KEYS, MAX_PACKED_K, kmer_type
from mendseq.operators.membership import ASKING, FINISHED, PENDING, Kernel, KmerSet, Rounds, by_nearness, nearness
from mendseq.session import Bucketed, materialize, new_table_path

# Bases in one group of reads: enough of them to lie over each other, little work for a task.
GROUP_BASES = 400_000
DOUBLINGS = WALK.bit_length() - 1


def _next(node: Column, letter: Column, k: int) -> Column:
    if k > MAX_PACKED_K:
        return F.concat(F.substring(node, 2, k), letter)
    code = F.instr(F.lit("ACGT"), letter).cast("long") - 1
    return F.shiftleft(node, 2).bitwiseOR(code).bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1))


def nodes_of(kmers: DataFrame, k: int) -> DataFrame:
    """(node, exts): the bases that go on at each node, on both strands of every k-mer."""
    schema = T.StructType([T.StructField("node", kmer_type(k)), T.StructField("ext", T.IntegerType())])
    nodes = Nodes(k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, base in nodes.ends(ragged.kmers_from_arrow(batch["kmer"], k)):
                yield pa.RecordBatch.from_arrays([ragged.kmers_to_arrow(node), pa.array(np.left_shift(1, base).astype(np.int32))], names=schema.names)

    return kmers.mapInArrow(task, schema).groupBy("node").agg(F.bit_or("ext").alias("exts"))


def walks_of(nodes: DataFrame, k: int) -> DataFrame:
    """(node, exts, walk, last): ``walk`` is empty where no base or several go on; ``last`` are the bases at its end."""
    letter = F.element_at(F.create_map(*[F.lit(v) for b, c in enumerate("ACGT") for v in (1 << b, c)]), F.col("exts"))
    steps = nodes.where(F.col("exts").isin(1, 2, 4, 8)).withColumn("letter", letter).select(
        "node", _next(F.col("node"), F.col("letter"), k).alias("to"), F.col("letter").alias("walk"))
    for _ in range(DOUBLINGS):
        steps = materialize(steps, "walks")
        more = steps.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("walk").alias("rest"))
        steps = steps.join(more, "to", "left").select(
            "node", F.coalesce("further", "to").alias("to"), F.concat("walk", F.coalesce("rest", F.lit(""))).alias("walk"))
    ended = steps.join(nodes.select(F.col("node").alias("to"), F.col("exts").alias("last")), "to", "left").drop("to")
    return nodes.join(ended, "node", "left").select(
        "node", "exts", F.coalesce("walk", F.lit("")).alias("walk"), F.coalesce("last", F.lit(0)).alias("last"))


def neighbourhoods(kmers: KmerSet) -> Bucketed:
    """The table of a set, made once."""
    if kmers.walks is None:
        nodes = materialize(nodes_of(kmers.df, kmers.k), "nodes")
        kmers.walks = Bucketed.write(walks_of(nodes, kmers.k), "node", 2 * kmers.rows)
    return kmers.walks


class Facts:
    """Which bases go on at the nodes a group knows of; none at those it asked for in vain."""

    def __init__(self, nodes: Nodes, known: np.ndarray, exts: np.ndarray, fresh: int = 0):
        """The first ``fresh`` are kept for the next round although no read has used them yet."""
        self.arithmetic = nodes
        self.nodes, first = np.unique(known, return_index=True)
        self.exts, self.fresh = exts[first], np.flatnonzero(first < fresh)

    def _at(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.nodes):
            return np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        at = np.searchsorted(self.nodes, node)
        at[at == len(self.nodes)] = 0
        return at, self.nodes[at] == node

    def look_up(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each k-mer is known, is a member, and the place of the fact that tells."""
        (node, base), (other, complement) = self.arithmetic.ends(kmers)
        at, known = self._at(node)
        there, also = self._at(other)
        at, base = np.where(known, at, there), np.where(known, base, complement)
        known |= also
        if not len(self.nodes):
            return known, known, at
        return known, known & (self.exts[at] >> base & 1 == 1), at

    def has(self, nodes: np.ndarray) -> np.ndarray:
        return self._at(nodes)[1]


def after_a_miss(chain: np.ndarray, miss: np.ndarray) -> np.ndarray:
    """Which k-mers follow one known to be missing in their chain, and so make no difference."""
    before = np.cumsum(miss) - miss
    first = np.concatenate([[True], chain[1:] != chain[:-1]]) if len(chain) else miss
    return before > np.maximum.accumulate(np.where(first, before, 0))


def run_walking(batch: pa.RecordBatch, kernel: Kernel, facts: Facts, ahead: bool):
    """Run ``kernel`` as far as the facts go.

    Returns its output for the reads that finish, which reads do not, the places of the
    facts those depend on, and the nodes they ask for.
    """
    alive = np.ones(batch.num_rows, dtype=bool)
    used, wanted = [], [(np.zeros(0, np.int64), facts.arithmetic.none())]
    run, answer = kernel(batch, alive), None
    while True:
        try:
            rows, asked, *more = run.send(answer)
        except StopIteration as end:
            out = end.value
            break
        known, answer, at = facts.look_up(asked)
        used.append((rows[known], at[known]))
        if more:
            beyond = after_a_miss(more[1], known & ~answer)
            known, answer = known | beyond, answer & ~beyond
        stopped = np.zeros(batch.num_rows, dtype=bool)
        stopped[rows[~known]] = True
        stopped &= alive
        alive[stopped] = False
        if not stopped.any():
            continue
        lacking = ~known & stopped[rows]
        if more:
            # What comes after depends on it, and walks will tell of most of that.
            lacking &= ~after_a_miss(more[1], lacking)
        wanted += [(rows[lacking], node) for node, _ in facts.arithmetic.ends(asked[lacking])]
        if ahead and more:
            rows, nodes = more[0]()
            mine = stopped[rows]
            wanted.append((rows[mine], nodes[mine]))
    waits = ~alive
    rows, places = (np.concatenate(v) for v in zip(*used)) if used else (np.zeros(0, np.int64),) * 2
    asked = np.unique(np.concatenate([n for _, n in wanted]))
    return out, waits, np.unique(places[waits[rows]]), asked


class _Walking(Rounds):
    def __init__(self, given: T.StructType, schema: T.StructType, k: int):
        node = T.ArrayType(kmer_type(k))
        super().__init__(given, schema, [T.StructField("nodes", node), T.StructField("exts", T.ArrayType(T.IntegerType())),
                                         T.StructField("asked", node)])

    def step(self, group: int, reads: pa.RecordBatch, kernel: Kernel, facts: Facts) -> Iterator[pa.RecordBatch]:
        out, waits, used, asked = run_walking(reads, kernel, facts, ahead=bool(len(facts.nodes)))
        yield self.rows(out.num_rows, FINISHED, group, {f"out_{n}": out[n] for n in self.out})
        if waits.any():
            kept = reads.take(pa.array(np.flatnonzero(waits)))
            yield self.rows(kept.num_rows, PENDING, group, {f"in_{n}": kept[n] for n in self.given})
            kept = np.union1d(used, facts.fresh)
            columns = {"nodes": ragged.kmers_to_arrow(facts.nodes[kept]), "exts": pa.array(facts.exts[kept].astype(np.int32)),
                       "asked": ragged.kmers_to_arrow(asked)}
            yield self.rows(1, ASKING, group, {
                name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for name, v in columns.items()})


def found_nodes(asking: DataFrame, table: DataFrame, walk: bool) -> DataFrame:
    """(group_id, found): the asked nodes that are in the table, with their walks from the second round on.

    A group asks for a node once, so even one that every read contains appears no more
    often than there are groups.
    """
    fields = ["node", "exts", "walk", "last"] if walk else ["node", "exts"]
    asked = asking.select("group_id", F.explode("asked").alias("node"))
    return asked.join(table.select(*fields), "node").groupBy("group_id").agg(F.collect_list(F.struct(*fields)).alias("found"))


def solve_by_walks(df: DataFrame, kernel: Kernel, kmers: KmerSet, schema: T.StructType) -> DataFrame:
    """Run ``kernel`` over ``df``, reads near each other in groups; each round is a written table."""
    spark, k = df.sparkSession, kmers.k
    rounds, nodes = _Walking(df.schema, schema, k), Nodes(k)
    folder = new_table_path(spark, "rounds")

    def of_kind(path: str, kind: int) -> DataFrame:
        return spark.read.schema(rounds.schema).parquet(path).where(F.col("kind") == kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        nothing = Facts(nodes, nodes.none(), np.zeros(0, np.int64))
        for batch in ragged.slices(batches, max_bases=GROUP_BASES):
            yield from rounds.step(group, batch.select(rounds.given), kernel, nothing)
            group += 1

    def again(key: tuple, waiting: pa.Table, asking: pa.Table) -> pa.Table:
        reads = waiting.select([f"in_{n}" for n in rounds.given]).rename_columns(rounds.given)
        lists = asking.combine_chunks().to_batches()[0]
        old, asked = (nodes.from_arrow(lists[name].flatten()) for name in ("nodes", "asked"))
        found = lists["found"].flatten()
        got, exts = nodes.from_arrow(found.field("node")), found.field("exts").to_numpy(zero_copy_only=False).astype(np.int64)
        walks = found.type.num_fields == 4
        if walks:
            got, exts = nodes.walked(got, exts, found.field("walk").to_pylist(), found.field("last").to_numpy(zero_copy_only=False).astype(np.int64))
        known = np.concatenate([got, old, asked])
        exts = np.concatenate([exts, lists["exts"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(len(asked), np.int64)])
        batch = reads.combine_chunks().to_batches()[0]
        facts = Facts(nodes, known, exts, fresh=len(got) if walks else 0)
        return pa.Table.from_batches(list(rounds.step(key[0].as_py(), batch, kernel, facts)))

    ordered = by_nearness(nearness(df, k))
    turn, output = 0, ordered.mapInArrow(first, rounds.schema)
    with neighbourhoods(kmers).opened(spark) as table:
        while True:
            path = f"{folder}/round={turn}"
            output.write.parquet(path)
            asking = of_kind(path, ASKING).select("group_id", "nodes", "exts", "asked")
            if asking.isEmpty():
                break
            found = found_nodes(asking, table, walk=turn > 0)
            answered = asking.join(found, "group_id", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
            waiting = of_kind(path, PENDING).select("group_id", *[f"in_{n}" for n in rounds.given])
            output = waiting.groupBy("group_id").cogroup(answered.groupBy("group_id")).applyInArrow(again, rounds.schema)
            turn += 1
    return of_kind(folder, FINISHED).select(*[F.col(f"out_{name}").alias(name) for name in schema.names])
