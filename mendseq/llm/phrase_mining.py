"""Phrase collocations by Toivonen mining.

A sample of whole documents proposes words and word pairs. The full pass counts all
words, and of the longer phrases those that are proposed or in the negative border, that
is, all whose shorter parts are proposed. A border phrase that turns out frequent was
missed by the sample: whatever it makes possible is counted by a further pass, until no
pass finds one. Every count is exact.

Tasks test what is proposed on bits of hashed phrases, at most 32 MiB each. A phrase
that passes by chance, more often where over 100 million are proposed, is counted too
and changes no result.

A language is ``und`` where null; a null text is empty. Repeated rows count as often as
they occur, other columns are ignored, an empty table or one without a frequent phrase
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendseq.llm.common import arrow_map, rows_of, small_batches
from mendseq.session import materialize

LEAST, BEST, SCALE = 10, 2000, 1_000_000
# One of so many documents is in the sample, where a phrase is proposed from PROPOSED occurrences on.
SAMPLE_OF, PROPOSED = 4, 2
# Share of a phrase's occurrences, in percent, that lie in a longer one which replaces it.
REPLACED = 50
# Bits of a set of phrases: 16 each, between these bounds.
SET_BITS = 1 << 12, 1 << 28
# Words reduced together before anything leaves the task.
LOT = 2_000_000
# Parts in which the phrases of one language are ranked first, and the width of steps of scores.
SALTS, SCORE_STEP = 64, 1000

END = b"\n"
_TO_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_and_ends(text: str) -> list[bytes]:
    """The words of a text with END after every piece."""
    data = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).replace(END, b" \n ")
    return [*filter(None, data.split(b" ")), END]


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * _FIRST + (second ^ (second >> np.uint64(29))) * _SECOND
    return mixed ^ (mixed >> np.uint64(32))


class Proposed:
    """Hashed phrases as bits; some that are not in it pass by chance."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def proposed(phrases: DataFrame, words: int) -> Proposed:
    """The set of the phrases (lang, phrase) of ``words`` words, one or two."""
    chosen = phrases.where(F.col("words") == words).select("lang", "phrase")
    least, most = SET_BITS
    size = min(most, max(least, 1 << (16 * chosen.count()).bit_length()))

    def start():
        def work(batch):
            parts = [[word_hash(lang, w) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")] for lang, phrase in zip(*rows_of(batch, "lang", "phrase"))]
            hashes = np.array(parts, np.uint64).reshape(-1, words)
            at = (hashes[:, 0] if words == 1 else pair_hash(hashes[:, 0], hashes[:, 1])) & np.uint64(size - 1)
            return {"block": pa.array((at >> np.uint64(6)).astype(np.int64)),
                    "bits": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))}

        return work

    blocks = arrow_map(chosen, start, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy().view(np.uint64)
    return Proposed(bits)


class _Numbered(dict):
    """Numbers of the words of one language in the order they are met; 0 is END."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Wanted:
    """What a pass counts. Without proposals (the sample): all words and pairs."""

    def __init__(self, words: list[Proposed] | None = None, pairs: list[Proposed] | None = None,
                 missed: tuple[Proposed, Proposed] | None = None):
        self.words, self.pairs, self.missed = words, pairs, missed

    def places(self, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where a counted pair begins, where a counted triple begins).

        The full pass counts pairs of proposed words and triples of proposed pairs; an
        expansion those of them with a word or a pair that was missed.
        """
        a, b = ids[:-1], ids[1:]
        pairs = (a != 0) & (b != 0)
        if self.words is None:
            return pairs, np.zeros(max(0, len(pairs) - 1), bool)
        able = any_has(self.words, hashes)
        late = None
        if self.missed is not None:
            new = self.missed[0].has(hashes)
            able |= new
        pairs &= able[a] & able[b]
        pair = pair_hash(hashes[a], hashes[b])
        known = pairs & any_has(self.pairs, pair)
        if self.missed is not None:
            late = pairs & self.missed[1].has(pair)
            known |= late
            pairs &= new[a] | new[b]
        triples = known[:-1] & known[1:]
        return pairs, triples if late is None else triples & (late[:-1] | late[1:])


def any_has(sets: list[Proposed] | None, hashes: np.ndarray) -> np.ndarray:
    return reduce(np.logical_or, (p.has(hashes) for p in sets or []), np.zeros(len(hashes), bool))


def distinct_rows(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of two or three columns of numbers below ``size``, and how often each occurs."""
    bits = size.bit_length()
    low = (1 << bits) - 1
    if bits * len(columns) <= 62:
        found, n = np.unique(reduce(lambda a, b: a << bits | b, columns), return_counts=True)
        return [found >> bits * i & low for i in range(len(columns) - 1, -1, -1)], n
    heads, at = np.unique(columns[0] << bits | columns[1], return_inverse=True)
    found, n = np.unique(at.astype(np.int64) << bits | columns[2], return_counts=True)
    head = heads[found >> bits]
    return [head >> bits, head & low, found & low], n


def count_lot(lang: str, numbers: _Numbered, ids: np.ndarray, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """The phrases of one language in one lot; ``words`` is 0 in the row that counts all words."""
    words = list(numbers)
    hashes = np.array([word_hash(lang, w) for w in words], np.uint64)
    spelled = pa.array(words, pa.binary())

    def rows(columns: list[np.ndarray], n: np.ndarray, known: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(n), 1 << 17):
            e = s + (1 << 17)
            parts = [spelled.take(pa.array(c[s:e])) for c in columns]
            phrase = (parts[0] if size < 2 else pc.binary_join_element_wise(*parts, b" ")).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(np.full(len(phrase), size, np.int32)),
                 pa.array(known[s:e]), pa.array(n[s:e].astype(np.int64))], names=["lang", "phrase", "words", "known", "n"])

    if wanted.missed is None:
        n = np.bincount(ids, minlength=len(words))
        n[0] = 0
        met = np.flatnonzero(n)
        yield from rows([met], n[met], any_has(wanted.words, hashes[met]), 1)
        yield from rows([np.zeros(1, np.int64)], np.array([n.sum()]), np.ones(1, bool), 0)
    pairs, triples = map(np.flatnonzero, wanted.places(ids, hashes))
    if len(pairs):
        found, n = distinct_rows([ids[pairs], ids[pairs + 1]], len(words))
        known = wanted.pairs if wanted.missed is None else []
        yield from rows(found, n, any_has(known, pair_hash(hashes[found[0]], hashes[found[1]])), 2)
    if len(triples):
        found, n = distinct_rows([ids[triples], ids[triples + 1], ids[triples + 2]], len(words))
        yield from rows(found, n, np.ones(len(n), bool), 3)


def count(docs: DataFrame, wanted: Wanted, least: int) -> DataFrame:
    """(lang, phrase, words, known, n): phrases that occur ``least`` times; ``known`` if proposed before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[str, tuple[_Numbered, list[int]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, ids) in lots.items():
                yield from count_lot(lang, numbers, np.array(ids, np.int64), wanted)
            lots.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(*rows_of(batch, "lang", "text")):
                if lang not in lots:
                    lots[lang] = _Numbered(), []
                numbers, ids = lots[lang]
                before = len(ids)
                ids += map(numbers.__getitem__, words_and_ends(text))
                held += len(ids) - before
                if held >= LOT:
                    yield from flush()
                    held = 0
        yield from flush()

    small_batches(docs.sparkSession)
    # Lots are reduced already: dealt out as they are, phrases are aggregated once, where they meet.
    rows = docs.mapInArrow(run, "lang string, phrase string, words int, known boolean, n long").repartition("lang", "phrase", "words")
    return rows.groupBy("lang", "phrase", "words").agg(F.max("known").alias("known"), F.sum("n").alias("n")) \
        .where((F.col("words") == 0) | (F.col("n") >= least))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col("doc_id"), F.col("text")).alias("drawn"))


def mine(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to 3 words that occur ``least`` times in their language.

    The row of each language with 0 words counts all of its words.
    """
    given = _texts(docs)
    drawn = materialize(count(given.where(F.pmod("drawn", F.lit(SAMPLE_OF)) == 0), Wanted(), PROPOSED), "sample")
    words, pairs = [proposed(drawn, 1)], [proposed(drawn, 2)]
    passes = [materialize(count(given, Wanted(words, pairs), least), "phrases")]
    new = passes[0].where(~F.col("known"))
    while not new.isEmpty():
        missed = proposed(new, 1), proposed(new, 2)
        passes.append(materialize(count(given, Wanted(words, pairs, missed), least), "phrases"))
        words, pairs = [*words, missed[0]], [*pairs, missed[1]]
        # A phrase that an earlier pass counted too has the same count.
        new = passes[-1].where(~F.col("known")).join(reduce(DataFrame.union, passes[:-1]), ["lang", "phrase"], "left_anti")
    return materialize(reduce(DataFrame.union, passes).select("lang", "phrase", "words", "n").distinct(), "phrases")


def _part(first: int, n: int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of 2 or 3 words, by its worst cut."""
    phrases = found.where(F.col("words") > 0)
    cuts = phrases.where(F.col("words") > 1).withColumn("w", F.split("phrase", " ")).select(
        "lang", F.col("phrase").alias("whole"), F.col("words").alias("size"), F.col("n").alias("a"),
        F.explode(F.when(F.col("words") == 2, F.array(*[F.struct(F.lit(k).alias("k"), _part(*p).alias("part")) for k, p in (
            (0, (1, 1)), (1, (2, 1)))])).otherwise(F.array(*[F.struct(F.lit(k).alias("k"), _part(*p).alias("part")) for k, p in (
                (0, (1, 1)), (1, (2, 2)), (2, (1, 2)), (3, (3, 1)))]))).alias("cut")).select("*", "cut.k", "cut.part").drop("cut")
    # Parts that very many phrases share: at most 1000 words and 1000 pairs reach this share of all words.
    total = found.where(F.col("words") == 0).agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * 1000 >= total
    common = phrases.where(often & (F.col("words") < 3)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("often"))
    counts = phrases.where(~often).select("lang", F.col("phrase").alias("key"), "n")
    # What is found has a key of its own that no phrase has.
    looked = cuts.join(F.broadcast(common), ["lang", "part"], "left").withColumn(
        "key", F.when(F.col("often").isNull(), F.col("part")).otherwise(F.concat(F.lit(" "), "whole")))
    looked = looked.join(counts, ["lang", "key"], "left").withColumn("f", F.coalesce("often", "n"))
    wide = looked.groupBy("lang", F.col("whole").alias("phrase"), F.col("size").alias("words"), "a").agg(
        *[F.max(F.when(F.col("k") == k, F.col("f"))).alias(f"f{k}") for k in range(4)])
    score = "cast(({scale} * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast({l} as decimal(38,0)) * cast({r} as decimal(38,0))) as bigint)"
    first, second = (F.struct(F.expr(score.format(scale=SCALE, l=f"f{k}", r=f"f{k + 1}")).alias("score"), F.lit(k).alias("k"),
                              F.col(f"f{k}").alias("l"), F.col(f"f{k + 1}").alias("r")) for k in (0, 2))
    least = F.when(F.col("words") == 2, first).otherwise(F.least(first, second)).alias("cut")
    return wide.select("lang", "phrase", "words", "a", least).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def unreplaced(phrases: DataFrame) -> DataFrame:
    """Without the pairs of which a triple holds REPLACED percent of all occurrences."""
    w = F.split("phrase", " ")
    inner = phrases.where(F.col("words") == 3).withColumn("w", w).select(
        "lang", F.explode(F.array(_part(1, 2), _part(2, 2))).alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.join(longest, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * REPLACED)).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``best`` phrases of each language.

    By score, then occurrences, then bytes of the phrase. Whole steps of scores that can't
    be among them go first; what stays is ranked in SALTS parts, then together.
    """
    found = mine(docs, least)
    step = F.expr(f"score div {SCORE_STEP}").alias("step")
    phrases = materialize(unreplaced(scored(found)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), "scored")
    # At most 1,001 steps a language.
    above = Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = phrases.groupBy("lang", step).agg(F.count("*").alias("m"))
    lowest = steps.withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0))).where(F.col("above") < best) \
        .groupBy("lang").agg((F.min("step") * SCORE_STEP).alias("lowest"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    high = phrases.join(lowest, ["lang", "salt"]).where(F.col("score") >= F.col("lowest"))
    few = high.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    totals = found.where(F.col("words") == 0).select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
