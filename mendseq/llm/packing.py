"""Best-fit packing of tokenized documents, improved by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, row_numbers, rows_of
from mendseq.llm.tokens import byte_level_ids, unit_ids
from mendseq.session import materialize

CAPACITY = 2048
# Pieces packed together in one group, and the fill up to which a sequence is packed again.
GROUP, REPACK_BELOW = 4096, 0.985
END = np.zeros(1, "<u4").tobytes()

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each to the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


def _best_change(a: list[int], b: list[int], sizes: list[int], room: int) -> tuple[int, list[int], list[int]] | None:
    """(gain, items out of ``a``, items out of ``b``): what fills ``a`` best from ``b``."""
    groups = sorted([(sizes[i], [i]) for i in b] + [(sizes[i] + sizes[j], [i, j]) for i, j in combinations(b, 2)],
                    key=lambda g: g[0])
    keys, best = [g[0] for g in groups], None
    for give, out in [(0, [])] + [(sizes[i], [i]) for i in a]:
        at = bisect_right(keys, give + room) - 1
        # Nothing out: a move of one document.
        while at >= 0 and not out and len(groups[at][1]) > 1:
            at -= 1
        if at >= 0 and keys[at] > give and (best is None or keys[at] - give > best[0]):
            best = (keys[at] - give, out, groups[at][1])
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empties bins: fuller ones take from emptier ones by a move, a swap or two for one.

    Each step makes the sum of squared fills larger, so the search ends. It stops at
    once when no fewer bins could hold the items.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(sizes) // capacity)
    moved = True
    while moved and sum(map(bool, bins)) > least:
        moved = False
        live = sorted((i for i in range(len(bins)) if 0 < fill[i] < capacity), key=lambda i: fill[i])
        spare = sum(map(bool, bins)) - least
        for b in live[:spare + 1]:
            for a in reversed(live):
                while a != b and bins[b] and 0 < fill[a] < capacity:
                    change = _best_change(bins[a], bins[b], sizes, capacity - fill[a])
                    if change is None or fill[a] + change[0] <= fill[b]:
                        break
                    gain, out, taken = change
                    bins[a] = [i for i in bins[a] if i not in out] + taken
                    bins[b] = [i for i in bins[b] if i not in taken] + out
                    fill[a] += gain
                    fill[b] -= gain
                    moved = True
    return [b for b in bins if b]


VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; a null text is an empty one, which is its end id alone."""
    def start():
        units, number = unit_ids(vocabulary, "I", ranks), row_numbers()

        def work(batch):
            out = [[], [], [], [], []]
            for doc_id, text in zip(*rows_of(batch, "doc_id", "text")):
                ids = byte_level_ids(text or "", units) + END
                for k, (begin, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc_id, k, begin, n, zlib.crc32(ids[4 * begin:4 * (begin + n)]))):
                        column.append(value)
            return dict(zip("abcdef", [number(len(out[0]))] + out))

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                     start, _PIECES)


def _packed_groups(items: DataFrame, n: int, capacity: int, base: int) -> DataFrame:
    groups = max(1, -(-n // GROUP))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        sizes = group["length"].tolist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        order = [i for b in bins for i in b]
        length = group["length"].to_numpy()[order]
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])])[:-1].astype(int)
        ahead = np.cumsum(length) - length
        out = group.iloc[order].copy()
        out["sequence_id"] = base + (int(group["g"].iloc[0]) << 24) + of
        out["offset"] = ahead - ahead[first][of]
        out["filled"] = np.add.reduceat(length, first)[of]
        return out.drop(columns="g")

    return items.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("g").applyInPandas(
        pack, _PIECES + ", sequence_id long, offset long, filled long")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place there.

    ``found`` has the columns of ``pieces``; ``uid`` is unique. Pieces as long as a
    sequence stay alone. The others are dealt by a hash to groups of about ``GROUP``
    and packed there; sequences that stay less than ``REPACK_BELOW`` full are packed
    once more in new groups, so that a group leaves hardly any room unused. Ties go by
    ``uid``. No pieces: no rows.
    """
    whole = found.where(F.col("length") == capacity)
    rest = found.where(F.col("length") < capacity)
    once = materialize(_packed_groups(rest, rest.count(), capacity, 0), "packed")
    again = once.where(F.col("filled") < REPACK_BELOW * capacity)
    twice = _packed_groups(again.drop("sequence_id", "offset", "filled"), again.count(), capacity, 1 << 60)
    names = [c.split()[0] for c in _PACKED.split(", ")]
    return (whole.withColumns({"sequence_id": F.lit(1 << 61) + F.col("uid"), "offset": F.lit(0).cast("long")}).select(names)
            .union(once.where(F.col("filled") >= REPACK_BELOW * capacity).select(names))
            .union(twice.select(names)))


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS,
                   capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes and packs ``docs`` (doc_id, text; other columns are left out)."""
    return pack(materialize(pieces(docs, vocabulary, ranks, capacity), "pieces"), capacity)
