"""Asking which k-mers are in a k-mer set, by broadcast or by join.

A *kernel* is a Python generator over one Arrow batch. It yields questions,
``(rows, kmers)``, and is sent one boolean per k-mer; what it returns is the
output batch. A kernel of one question runs in two ways:

* ``solve_in_task``: the set is small (its rows were counted), so every task holds
  an index of it and answers in place. No shuffle.
* ``solve_by_join``: the set can have any size. Reads that share k-mers are put
  into the same group of bounded size; a filter of bounded size tells of most other
  k-mers that they are not in the set; a group asks for each of the rest once, however
  many of its reads need it, and the questions of all groups are joined with the
  set, which is bucketed once and not moved again.

A kernel of which each question depends on the answers before goes on *eagerly*: what
passes the filter is taken for a member until the join has told. What came out is kept
with a read, and only reads for which a guess was wrong go through it again. For sets that would overfill the filter there is
``walks.solve_by_walks``.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mendseq.functions import ragged
from mendseq.functions import index
from mendseq.functions.index import BLOCK, LINE, Filter, Layout, LetteredIndex, PackedIndex, Piece, hashed, packed_bits, spread_codes
from mendseq.model import KEYS, MAX_BROADCAST_BYTES, MAX_INDEX_BYTES, MAX_PACKED_K, kmer_type
from mendseq.session import Bucketed, materialize, new_table_path

Kmers = tuple[np.ndarray, np.ndarray]
# The third part foresees nodes of ``walks`` that may be asked for later. The fourth numbers
# chains of k-mers, of which only those before the first one missing make a difference.
Question = Kmers | tuple[np.ndarray, np.ndarray, Callable[[], Kmers], np.ndarray]
Kernel = Callable[[pa.RecordBatch, np.ndarray], Generator[Question, np.ndarray, pa.RecordBatch]]

# Bases in one group of reads that ask together.
GROUP_BASES = 1_000_000
# k-mers of one part of an index or filter, which is made by one task.
PART_ROWS = 1 << 19

FINISHED, PENDING, ASKING = range(3)


@dataclass
class KmerSet:
    """A written table of distinct canonical k-mers."""

    df: DataFrame
    k: int
    rows: int
    # Written when they are first needed: the set in buckets, and its neighbourhoods.
    buckets: Bucketed | None = None
    walks: Bucketed | None = None

    @classmethod
    def store(cls, df: DataFrame, k: int, name: str = "kmers") -> KmerSet:
        table = materialize(df, name)
        return cls(table, k, table.count())

    def fits(self, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
        """Whether its k-mers, and their index, are few enough to be broadcast."""
        packed = self.k <= MAX_PACKED_K
        taken = self.rows * (8 if packed else self.k)
        # Letters are copied once to be sorted.
        held = Layout(self.rows, packed_bits(self.k)).bytes if packed else 2 * taken
        return taken <= max_bytes and held <= MAX_INDEX_BYTES

    def filters(self) -> bool:
        """Whether a filter of bounded size still has 8 bits a k-mer."""
        return self.rows <= index.MAX_FILTER_BYTES

    def bucketed(self) -> Bucketed:
        """The set in sorted buckets: a join by k-mer moves only what is asked."""
        if self.buckets is None:
            self.buckets = Bucketed.write(self.df, "kmer", self.rows)
        return self.buckets

    def _parts(self) -> int:
        return 1 << max(0, (self.rows - 1) // PART_ROWS).bit_length()

    def _in_parts(self, number: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
                  make: Callable[[int, np.ndarray], list[bytes | int]], fields: str) -> dict[int, dict]:
        """What ``make`` gives for the k-mers of each part, by the codes ``number`` gives them."""
        k = self.k

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, code = number(ragged.kmers_from_arrow(batch["kmer"], k))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(code.view(np.int64))], names=["part", "code"])

        def made(key: tuple, table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            values = make(part, table["code"].to_numpy().view(np.uint64))
            return pa.table({name: [value] for name, value in zip(("part", *names), (part, *values))}, schema=types)

        schema = T.StructType.fromDDL(f"part int, {fields}")
        names, types = schema.names[1:], to_arrow_schema(schema)
        rows = self.df.mapInArrow(numbered, "part int, code bigint").groupBy("part").applyInArrow(made, schema).toArrow()
        return {row["part"]: row for row in rows.to_pylist()}

    def index(self) -> PackedIndex | LetteredIndex:
        """Only for a set within the broadcast bound; made in parts, so that none of them is its k-mers."""
        if self.k > MAX_PACKED_K:
            return LetteredIndex(ragged.kmers_from_arrow(self.df.toArrow()["kmer"], self.k))
        layout, parts = Layout(self.rows, packed_bits(self.k)), self._parts()
        if parts == 1:
            return PackedIndex(layout, [layout.piece(layout.mixed(ragged.kmers_from_arrow(self.df.toArrow()["kmer"], self.k)))])

        def number(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mixed = layout.mixed(kmers)
            return layout.part(mixed, parts), mixed

        def make(part: int, mixed: np.ndarray) -> list[bytes | int]:
            piece = layout.piece(mixed, part, parts)
            return [piece.rows, *(a.tobytes() for a in (piece.coarse, piece.fine, piece.rest))]

        made = self._in_parts(number, make, "rows bigint, coarse binary, fine binary, rest binary")
        return PackedIndex(layout, (
            Piece(row["rows"], np.frombuffer(row["coarse"], np.int64), np.frombuffer(row["fine"], np.uint16), np.frombuffer(row["rest"], layout.rest))
            if (row := made.pop(part, None)) else layout.piece(np.zeros(0, np.uint64), part, parts) for part in range(parts)))

    def filter(self) -> Filter:
        """Of bounded size for any set."""
        words, parts, both = Filter.size(self.rows), self._parts(), self.filters()
        if parts == 1:
            return Filter(Filter.piece(hashed(ragged.kmers_from_arrow(self.df.toArrow()["kmer"], self.k)), words, both=both), both)
        parts = min(parts, words // LINE)

        def number(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h = hashed(kmers)
            return Filter.place(h, parts), h

        made = self._in_parts(number, lambda part, h: [Filter.piece(h, words, part, parts, both).tobytes()], "words binary")
        out = np.zeros(words, np.uint64)
        for part, row in made.items():
            out[part * (words // parts):(part + 1) * (words // parts)] = np.frombuffer(row["words"], np.uint64)
        return Filter(out, both)


def solve(df: DataFrame, kernel: Kernel, kmers: KmerSet, schema: T.StructType,
          max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Run ``kernel`` over ``df`` by broadcast if the set fits, else by joins."""
    if kmers.fits(max_broadcast):
        return solve_in_task(df, kernel, kmers, schema)
    return solve_by_join(df, kernel, kmers, schema)


def solve_in_task(df: DataFrame, kernel: Kernel, kmers: KmerSet, schema: T.StructType) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(kmers.index())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in ragged.slices(batches):
            run = kernel(batch, np.ones(batch.num_rows, dtype=bool))
            answer = None
            while True:
                try:
                    _, asked, *_ = run.send(answer)
                except StopIteration as end:
                    yield end.value
                    break
                answer = index.contains(asked)

    return df.mapInArrow(task, schema)


class Slots:
    """Where k-mers are in an array of distinct ones."""

    def __init__(self, kmers: np.ndarray):
        # Four slots a k-mer, so that most questions meet at most one.
        self.bits = max(2 * len(kmers) - 1, 1).bit_length() + 1
        slot = self._slot(kmers)
        self.order = np.argsort(slot, kind="stable")
        self.kmers = kmers[self.order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << self.bits))]).astype(np.int32)

    def _slot(self, kmers: np.ndarray) -> np.ndarray:
        return (hashed(kmers) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, kmers: np.ndarray) -> np.ndarray:
        """Their places, -1 for others."""
        out = np.full(len(kmers), -1, np.int32)
        if len(self.kmers):
            for begin in range(0, len(kmers), BLOCK):
                self._find(kmers[begin:begin + BLOCK], out[begin:begin + BLOCK])
        return out

    def _find(self, kmers: np.ndarray, out: np.ndarray) -> None:
        slot = self._slot(kmers)
        at, end = self.start[slot], self.start[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.kmers[at] == kmers[left]
            out[left[same]] = self.order[at[same]]
            at += 1
            more = ~same & (at < end)
            left, at, end = left[more], at[more], end[more]


class Known:
    """Answers a group of reads already has."""

    def __init__(self, yes: np.ndarray, no: np.ndarray):
        self.slots, self.members = Slots(np.concatenate([yes, no])), len(yes)

    def look_up(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each k-mer is known, and is a member."""
        at = self.slots.find(kmers)
        known = at >= 0
        return known, known & (at < self.members)


@dataclass
class Run:
    """How far the known answers went: output, reads that wait, and what was asked of what passes."""

    # Of the reads that do not wait, or of all if it was guessed.
    out: pa.RecordBatch
    waiting: np.ndarray
    # Of each question reads, k-mers, whether those were known, and were members.
    history: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def depends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members and others that waiting reads know of, and k-mers they have to ask for."""
        rows, asked, is_known, member = (
            (np.concatenate(v) for v in zip(*self.history)) if self.history else (np.zeros(0, np.int64),) * 4)
        waits = self.waiting[rows]
        is_known, member = is_known.astype(bool), member.astype(bool)
        return asked[waits & member], asked[waits & is_known & ~member], asked[waits & ~is_known]

    def guesses(self) -> tuple[np.ndarray, np.ndarray]:
        """Reads and the k-mers they guessed, but for the first question, which no guess leads to."""
        later = [(rows[~is_known], asked[~is_known]) for rows, asked, is_known, _ in self.history[1:]]
        if not later:
            return np.zeros(0, np.int64), self.history[0][1][:0]
        rows, asked = (np.concatenate(v) for v in zip(*later))
        return rows, asked


def run_as_known(batch: pa.RecordBatch, kernel: Kernel, known: Known, eager: bool = False, passing: Filter | None = None) -> Run:
    """Run ``kernel`` as far as the known answers go.

    k-mers that do not pass the filter are known not to be members. ``eager`` goes on as if
    all others were until they are known; the kernel must then give one row for each read.
    """
    alive, guessed = np.ones(batch.num_rows, dtype=bool), np.zeros(batch.num_rows, dtype=bool)
    history: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    run, answer = kernel(batch, alive), None
    while True:
        try:
            rows, asked, *_ = run.send(answer)
        except StopIteration as end:
            out = end.value
            break
        answer = np.zeros(len(asked), dtype=bool)
        # Of the others nothing need be known.
        passes = np.arange(len(asked)) if passing is None else np.flatnonzero(passing.contains(asked))
        rows, asked = rows[passes], asked[passes]
        is_known, member = known.look_up(asked)
        history.append((rows, asked, is_known, member))
        open_ = ~is_known
        stopped = np.zeros(batch.num_rows, dtype=bool)
        stopped[rows[open_]] = True
        if eager:
            guessed |= stopped
            member = member | open_
        else:
            alive[stopped & alive] = False
            if not alive.any():
                # What else the kernel does is for no read.
                run.close()
                out = pa.RecordBatch.from_arrays([], names=[])
                break
        answer[passes] = member
    return Run(out, ~alive | guessed, history)


def run_known(batch: pa.RecordBatch, kernel: Kernel, known: Known, eager: bool = False, passing: Filter | None = None):
    """Output of ``run_as_known`` for the reads that finish, which reads do not, and what those depend on."""
    run = run_as_known(batch, kernel, known, eager, passing)
    return run.out.filter(pa.array(~run.waiting)) if eager else run.out, run.waiting, run.depends()


class Rounds:
    """The rows a round writes: finished output, reads that wait, and what a group asks."""

    def __init__(self, given: T.StructType, schema: T.StructType, state: list[T.StructField]):
        self.given, self.out = given.names, schema.names
        self.schema = T.StructType(
            [T.StructField("kind", T.IntegerType()), T.StructField("group_id", T.LongType())]
            + [T.StructField(f"out_{f.name}", f.dataType) for f in schema]
            + [T.StructField(f"in_{f.name}", f.dataType) for f in given] + state)
        self.types = to_arrow_schema(self.schema)

    def rows(self, n: int, kind: int, group: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = {"kind": pa.array(np.full(n, kind, np.int32)), "group_id": pa.array(np.full(n, group)), **columns}
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in self.types],
            schema=self.types)


def packed(values: np.ndarray) -> bytes:
    data = np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), dtype)


class _Joining(Rounds):
    """Reads that wait have their place in the group and, if it was guessed, what came out.

    ``trail``: places and the numbers of asked k-mers they guessed after the first question.
    """

    def __init__(self, given: T.StructType, schema: T.StructType, k: int, eager: bool):
        self.k, self.eager = k, eager
        types = {f.name: f.dataType for f in given}
        # Of these only what differs is kept with reads that wait.
        self.shared = {f.name for f in schema if types.get(f.name) == f.dataType}
        super().__init__(given, schema, [T.StructField("place", T.IntegerType())] + [
            T.StructField(name, T.ArrayType(kmer_type(k))) for name in ("yes", "no", "asked")] + [T.StructField("trail", T.BinaryType())])

    def waiting(self) -> list[str]:
        """Columns of reads that wait."""
        return ["group_id", "place", *[f"in_{n}" for n in self.given], *[f"out_{n}" for n in self.out if self.eager]]

    def step(self, group: int, reads: pa.RecordBatch, kernel: Kernel, known: Known, passing: Filter) -> Iterator[pa.RecordBatch]:
        run = run_as_known(reads, kernel, known, self.eager, passing)
        out = run.out.filter(pa.array(~run.waiting)) if self.eager else run.out
        if out.num_rows:
            yield self.rows(out.num_rows, FINISHED, group, {f"out_{n}": out[n] for n in self.out})
        if run.waiting.any():
            kept, lists = reads.filter(pa.array(run.waiting)), [np.unique(v) for v in run.depends()]
            place, columns, trail = np.arange(kept.num_rows, dtype=np.int32), {}, None
            if self.eager:
                place, columns = self._guessed(kept, run.out.filter(pa.array(run.waiting)), place)
                rows, asked = run.guesses()
                trail = packed(np.stack([(np.cumsum(run.waiting) - 1)[rows], Slots(lists[2]).find(asked)]).astype(np.int32))
            yield self.rows(kept.num_rows, PENDING, group, {
                "place": pa.array(place), **columns, **{f"in_{n}": kept[n] for n in self.given}})
            yield self.rows(1, ASKING, group, {"trail": pa.array([trail], pa.binary()), **{
                name: pa.ListArray.from_arrays(pa.array([0, len(kmers)], pa.int32()), ragged.kmers_to_arrow(kmers))
                for name, kmers in zip(("yes", "no", "asked"), lists)}})

    def _guessed(self, given: pa.RecordBatch, out: pa.RecordBatch, place: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Output to be kept; reads of which it can't be have no place."""
        columns = {f"out_{n}": out[n] for n in self.out}
        for n in self.shared:
            before, after = given[n], out[n].cast(given[n].type)
            same = pc.fill_null(pc.equal(before, after), False)
            columns[f"out_{n}"] = pc.if_else(same, pa.scalar(None, after.type), after)
            lost = pc.and_(before.is_valid(), after.is_null())
            place = np.where(lost.to_numpy(zero_copy_only=False), np.int32(-1), place)
        return place, columns

    def answered(self, group: int, waiting: pa.Table, asking: pa.Table, kernel: Kernel, passing: Filter) -> Iterator[pa.RecordBatch]:
        """The next round of a group: reads that guessed right are done, the others run again."""
        yes, no, asked, lacking = (
            ragged.kmers_from_arrow(asking[name].combine_chunks().flatten(), self.k)
            for name in ("yes", "no", "asked", "lacking"))
        lacks = Slots(lacking).find(asked) >= 0
        waiting = waiting.combine_chunks().to_batches()[0]
        reads = waiting.select([f"in_{n}" for n in self.given]).rename_columns(self.given)
        if self.eager:
            wrong = self._wrong(waiting["place"].to_numpy(), reads, asking["trail"][0].as_py(), lacking, lacks, kernel)
            if not wrong.all():
                done = waiting.filter(pa.array(~wrong))
                yield self.rows(done.num_rows, FINISHED, group, {
                    f"out_{n}": pc.coalesce(done[f"out_{n}"], done[f"in_{n}"]) if n in self.shared else done[f"out_{n}"] for n in self.out})
            if not wrong.any():
                return
            reads = reads.filter(pa.array(wrong))
        yield from self.step(group, reads, kernel, Known(np.concatenate([yes, asked[~lacks]]), np.concatenate([no, lacking])), passing)

    def _wrong(self, place: np.ndarray, reads: pa.RecordBatch, trail: bytes, lacking: np.ndarray, lacks: np.ndarray, kernel: Kernel) -> np.ndarray:
        """Reads that took a k-mer for a member that is none."""
        wrong = place < 0
        rows, first, *_ = next(kernel(reads, np.ones(reads.num_rows, dtype=bool)))
        wrong[rows[Slots(lacking).find(first) >= 0]] = True
        at, number = unpacked(trail, np.int32).reshape(2, -1)
        later = np.zeros(reads.num_rows, dtype=bool)
        later[at[lacks[number]]] = True
        return wrong | later[place]


def nearness(df: DataFrame, k: int, passing: Broadcast | None = None) -> DataFrame:
    """Adds ``near``: reads that overlap often have the same least k-mer, of those that pass the filter if any does."""
    size = min(k, MAX_PACKED_K)
    schema = T.StructType([*df.schema, T.StructField("near", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            w, none = ragged.read_windows(ragged.from_arrow(batch["seq"]), size), np.iinfo(np.int64).max
            has = w.count > 0

            def least(there: np.ndarray) -> np.ndarray:
                out = np.full(batch.num_rows, none)
                out[has] = np.minimum.reduceat(np.where(there, code, none), w.first[has]) if has.any() else none
                return out

            code = spread_codes(w.kmer)
            near = least(w.valid)
            if passing is not None and size == k:
                there = w.valid.copy()
                there[w.valid] = passing.value.contains(w.kmer[w.valid])
                best = least(there)
                near = np.where(best < none, best, near)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=schema.names)

    return df.mapInArrow(task, schema)


def by_nearness(df: DataFrame) -> DataFrame:
    """Ordered by ``near``, then spread: a k-mer shared by very many reads does not bring them all into one partition."""
    return df.repartitionByRange("near", F.xxhash64(*KEYS)).sortWithinPartitions("near")


def gathered(reads: DataFrame, k: int) -> DataFrame:
    """The same reads with overlapping ones side by side, so that a batch repeats most of its k-mers.

    What is reduced per batch then shrinks by coverage before it is shuffled, however long the genome.
    Written first, as the bounds of the ranges come from a scan of their own.
    """
    return by_nearness(materialize(nearness(reads, k), "near")).drop("near")


def solve_by_join(df: DataFrame, kernel: Kernel, kmers: KmerSet, schema: T.StructType, eager: bool = False) -> DataFrame:
    spark, k, rounds = df.sparkSession, kmers.k, _Joining(df.schema, schema, kmers.k, eager)
    folder = new_table_path(spark, "rounds")
    passing = spark.sparkContext.broadcast(kmers.filter())

    def of_kind(path: str, kind: int) -> DataFrame:
        return spark.read.schema(rounds.schema).parquet(path).where(F.col("kind") == kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        nothing = Known(*[ragged.no_kmers(k)] * 2)
        for batch in ragged.slices(batches, max_bases=GROUP_BASES):
            yield from rounds.step(group, batch.select(rounds.given), kernel, nothing, passing.value)
            group += 1

    def again(key: tuple, waiting: pa.Table, asking: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(rounds.answered(key[0].as_py(), waiting, asking, kernel, passing.value)), rounds.types)

    ordered = by_nearness(materialize(nearness(df, k, passing), "near"))
    turn, output = 0, ordered.mapInArrow(first, rounds.schema)
    with kmers.bucketed().opened(spark) as members:
        while True:
            path = f"{folder}/round={turn}"
            output.write.parquet(path)
            asking = of_kind(path, ASKING).select("group_id", "yes", "no", "asked", "trail")
            if asking.where(F.size("asked") > 0).isEmpty():
                break
            # Few of what passes the filter.
            lacking = found_kmers(asking, members, "left_anti").withColumnRenamed("found", "lacking")
            answered = asking.join(lacking, "group_id", "left").withColumn(
                "lacking", F.coalesce("lacking", F.array().cast(T.ArrayType(kmer_type(k)))))
            waiting = of_kind(path, PENDING).select(*rounds.waiting())
            output = (waiting.groupBy("group_id").cogroup(answered.groupBy("group_id"))
                      .applyInArrow(again, rounds.schema))
            turn += 1
    return (of_kind(folder, FINISHED)
            .select(*[F.col(f"out_{name}").alias(name) for name in schema.names]))


def found_kmers(asking: DataFrame, members: DataFrame, how: str = "left_semi") -> DataFrame:
    """Which of the k-mers each group asks for are in the set (or, by ``left_anti``, are not).

    A group asks for a k-mer once, so even one that every read contains appears no
    more often than there are groups.
    """
    asked = asking.select("group_id", F.explode("asked").alias("kmer"))
    return (asked.join(members, "kmer", how)
            .groupBy("group_id").agg(F.collect_list("kmer").alias("found")))
