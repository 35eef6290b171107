"""Spelling variants by composing the vocabulary acceptor with a one-edit transducer.

Two words are near if one inserted, deleted or replaced code point makes one the other:
the composition acceptor o edit o acceptor accepts the pair. It is enumerated per
partition of its initial states. A partition is a window of places where the edit may
be, with what the words read before it and after it: both halves of a word are a window,
and a window in which many words meet is halved again, down to one place, where the
alphabet bounds them. So no partition grows with the vocabulary, and a pair belongs to
one window only, that of its first place of difference.

In a partition the middles of its words make a minimised acceptor. States reached
together while no edit was made are one state; after the edit both words read the same,
so what two states both accept is enumerated, and known for every two states met before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, rows_of, small_batches
from mendseq.session import materialize

# Words of the query: runs of letters, of this many code points and occurrences.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "A-Za-zÀ-ÿ", 7, 2
# One run of so many loses a code point.
DAMAGED = 31
# A form occurs so many times as often as its word.
FORM_TIMES = 10
# Words that meet in one window before it is halved.
TOGETHER = 2000
# Different words counted in a task before they leave it.
HELD_WORDS = 500_000

_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(doc_id: int | None, text: str | None) -> Iterator[str]:
    """The runs long enough, lower-cased from A to Z, some of them without one code point."""
    prefix = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run in _RUN.findall(text or ""):
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(word.encode(), prefix)
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < LEAST_LENGTH:
                continue
        yield word


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) that occur ``least`` times.

    A null text has none; a null doc_id is empty text before the colon. Repeated rows
    count as often as they occur.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(*rows_of(batch, "doc_id", "text")):
                for word in words_of(doc_id, text):
                    found[word] = found.get(word, 0) + 1
                if len(found) >= HELD_WORDS:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """The minimised deterministic acceptor of some words; states are numbers, 0 accepts nothing more."""

    def __init__(self, words: list[str]):
        """``words`` are sorted and distinct."""
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        self.final: list[bool] = []
        known: dict[tuple[bool, tuple[tuple[str, int], ...]], int] = {}

        def state(final: bool, arcs: tuple[tuple[str, int], ...]) -> int:
            found = known.get((final, arcs))
            if found is None:
                found = known[final, arcs] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return found

        state(True, ())
        # The states along the last word that may still get arcs.
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], state(final, tuple(arcs))))

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same)
            path += [(False, []) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        final, arcs = path[0]
        self.start = state(final, tuple(arcs))
        self.shared: dict[tuple[int, int], tuple[str, ...]] = {}

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """What both states accept; followed without recursion, as words may be very long."""
        waiting = [(p, q)]
        while waiting:
            p, q = pair = waiting[-1]
            if pair in self.shared:
                waiting.pop()
                continue
            # Along single arcs nothing is kept but that a way ends in nothing.
            read, way = [], []
            while len(self.arcs[p]) == 1 == len(self.arcs[q]) and not (self.final[p] and self.final[q]) \
                    and self.arcs[p][0][0] == self.arcs[q][0][0]:
                way.append((p, q))
                c, p = self.arcs[p][0]
                read.append(c)
                q = self.arcs[q][0][1]
                if (p, q) in self.shared:
                    break
            found = self.shared.get((p, q))
            if found is None:
                other = dict(self.arcs[q])
                further = [(c, (to, other[c])) for c, to in self.arcs[p] if c in other]
                unknown = [f for _, f in further if f not in self.shared]
                if unknown:
                    waiting += unknown
                    continue
                found = ("",) * (self.final[p] and self.final[q]) + tuple(
                    c + rest for c, f in further for rest in self.shared[f])
                self.shared[p, q] = found
            if found:
                head = "".join(read)
                self.shared[pair] = tuple(head + rest for rest in found)
            else:
                self.shared.update(dict.fromkeys(way, ()))
            waiting.pop()
        return self.shared[pair]

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        """(u, v, place) of every two accepted words one edit apart, v not the shorter one.

        The edit transducer replaces or inserts one symbol; ``place`` is where the words
        differ first. Words that differ by an insertion are given once, though several
        places of a run may be edited to the same effect.
        """
        waiting = [(self.start, "")]
        while waiting:
            p, before = waiting.pop()
            arcs = self.arcs[p]
            for i, (c, to) in enumerate(arcs):
                waiting.append((to, before + c))
                for d, other in arcs[i + 1:]:
                    for rest in self.common(to, other):
                        yield before + c + rest, before + d + rest, len(before)
                # v has c where u ends or reads another symbol; had it c next, a later place would do as well.
                if self.final[p] and self.final[to]:
                    yield before, before + c, len(before)
                after = dict(self.arcs[to])
                for d, other in arcs:
                    if d != c and d in after:
                        for rest in self.common(other, after[d]):
                            yield before + d + rest, before + c + d + rest, len(before)


def near_in_window(words: dict[str, int], before: int, after: int, width: int, end: bool) -> dict[str, tuple[int, int, str]]:
    """(near words, n of the best, the best) of each word in one window of ``words`` and their n.

    All share ``before`` code points in front and ``after`` at the end, with ``width``
    places between or one more. Two of the longer words are no pair here: they meet in
    windows of their own size. ``end``: the window reaches the end of the shorter words;
    others leave a difference behind their last place to the next window.
    """
    by_middle = {w[before:len(w) - after]: w for w in words}
    found: dict[str, tuple[int, int, str]] = {}

    def note(word: str, near: str) -> None:
        n, (m, best, name) = words[near], found.get(word, (0, 0, ""))
        if n > best or n == best and near < name:
            best, name = n, near
        found[word] = m + 1, best, name

    for u, v, place in Acceptor(sorted(by_middle)).pairs():
        if len(u) == width and (place < width or end):
            note(by_middle[u], by_middle[v])
            note(by_middle[v], by_middle[u])
    return found


def _windows(words: DataFrame) -> DataFrame:
    """Each word with all places, as the shorter one of a pair and as the longer one."""
    length = F.length("word")
    return words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where(F.col("size") > 0) \
        .withColumn("lo", F.lit(0)).withColumn("hi", F.col("size"))


def _halves(windows: DataFrame) -> DataFrame:
    """Both halves of each window; one place isn't halved."""
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("w")
    out = windows.select("word", "n", "size", cut).select("word", "n", "size", "w.lo", "w.hi").where(F.col("lo") < F.col("hi"))
    shared = F.concat_ws(" ", F.concat_ws(",", "size", "lo", "hi"), F.expr("substr(word, 1, lo)"),
                         F.expr("substr(word, length(word) - (size - hi) + 1)"))
    return out.withColumn("key", shared)


def partitions(words: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(word, n, size, lo, hi, key): the windows in which words meet, none of more than ``together`` words.

    Only windows of a single place may hold more: their words differ in one letter.
    """
    open_, done = _windows(words), []
    while True:
        halved = materialize(_halves(open_), "windows")
        met = halved.groupBy("key").agg(F.count("*").alias("met")).where(F.col("met") > 1)
        large = materialize(met.where(F.col("met") > together).select("key"), "large")
        if large.isEmpty():
            done.append(halved)
            break
        single = F.col("hi") - F.col("lo") == 1
        done.append(halved.join(large, "key", "left_anti").unionByName(halved.where(single).join(large, "key", "left_semi")))
        open_ = halved.where(~single).join(large, "key", "left_semi").drop("key")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _near_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; words that share one are composed with each other."""
    key, words, window = None, {}, (0, 0, 0, False)
    rows: list[tuple[str, int, int, str]] = []

    def finish() -> None:
        if len(words) > 1:
            rows.extend((w, *best) for w, best in near_in_window(words, *window).items())

    def flush() -> pa.RecordBatch:
        columns = [[r[i] for r in rows] for i in range(4)]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        for word, n, size, lo, hi, k in zip(*rows_of(batch, "word", "n", "size", "lo", "hi", "key")):
            if k != key:
                finish()
                key, words, window = k, {}, (lo, size - hi, hi - lo, hi == size)
            words[word] = n
        if len(rows) > 50_000:
            yield flush()
    finish()
    yield flush()


def near_words(words: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(word, n_near, best): number of near words, and (n, word) of the most frequent one, of every word that has any."""
    small_batches(words.sparkSession)
    met = partitions(words, together).repartition("key").sortWithinPartitions("key")
    parts = met.mapInArrow(_near_runs, "word string, n_near long, best_n long, best string")
    # Of equal n the word first in code-point order, which is also that of UTF-8 bytes.
    order = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best"))


def variants(words: DataFrame, times: int = FORM_TIMES, together: int = TOGETHER) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n), words distinct.

    The form is the near word with the largest n if that is ``times`` that of the word.
    ``root`` is where forms lead; as n grows with each, few steps of doubling find it.
    An empty table gives no rows.
    """
    near = near_words(words, together)
    best_n = -F.col("best.m")
    given = words.join(near, "word", "left")
    has = best_n >= F.col("n") * times
    out = materialize(given.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(has, F.col("best.form")).alias("form"), F.when(has, best_n).alias("form_n")), "forms")
    roots = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                     F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
