"""Reads without any trusted k-mer: find one change that creates some."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

from mendseq.functions.ragged import Changing, Ragged, within

# Bases of candidate windows held at once.
CHUNK_CELLS = 8_000_000


def probe_starts(pos: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """The windows over ``pos`` that must promise something before all are tried."""
    loops = (k - 1) // 32 + 1
    turns = 2 * loops - np.arange(loops) - 1
    starts = pos[:, None] - turns * k // (2 * loops) + 1
    return np.minimum(np.maximum(starts, 0), (length - k)[:, None])


def longest_run(hit: np.ndarray) -> np.ndarray:
    best = np.zeros(len(hit), dtype=np.int64)
    now = np.zeros(len(hit), dtype=np.int64)
    for column in hit.T:
        now = (now + 1) * column
        np.maximum(best, now, out=best)
    return best


def find_anchors(k: int, codes: Ragged, qual: Ragged, owner: np.ndarray, alive: np.ndarray,
                 rows: np.ndarray) -> Generator:
    """For each of ``rows`` its best change; returns arrays over the rows that have one.

    (row, position, base, hits) where hits[:, j] tells whether window
    position - k + 1 + j is trusted after the change.
    """
    weight = np.cumsum(codes.length[rows] * 3 * 2 * k)
    parts = []
    for part in np.split(rows, np.flatnonzero(np.diff(weight // CHUNK_CELLS)) + 1):
        if len(part):
            parts.append((yield from _find(k, codes, qual, owner, alive, part)))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros((0, k), dtype=bool)
    return tuple(np.concatenate(v) for v in zip(*parts))


def _find(k, codes, qual, owner, alive, rows) -> Generator:
    length = codes.length[rows]
    local, place = np.repeat(np.arange(len(rows)), length), within(length)
    text = codes.flat[codes.start[rows][local] + place]
    windows, first = Changing(text, k), np.cumsum(length) - length
    changes = np.arange(4) != text[:, None]

    promising = np.zeros(changes.shape, dtype=bool)
    asked, kmers = [], []
    for column in probe_starts(place, length[local], k).T:
        kmer, usable = windows.kmers((first[local] + column)[:, None], (place - column)[:, None], np.arange(4))
        asked.append(np.flatnonzero(usable & changes))
        kmers.append(kmer.ravel()[asked[-1]])
    asked, kmers = np.concatenate(asked), np.concatenate(kmers)
    hit = yield owner[rows[local[asked // 4]]], kmers
    promising.ravel()[asked[hit]] = True
    promising &= alive[owner[rows[local]]][:, None]

    cell, base = np.nonzero(promising)
    row, pos = rows[local[cell]], place[cell]
    start = pos[:, None] + np.arange(1 - k, 1)
    inside = (start >= 0) & (start + k <= codes.length[row][:, None])
    kmer, usable = windows.kmers(np.where(inside, first[local[cell]][:, None] + start, 0),
                                 np.where(inside, np.arange(k - 1, -1, -1), 0), base[:, None])
    usable = usable & inside
    hits = np.zeros(usable.shape, dtype=bool)
    candidate, window = np.nonzero(usable)
    if len(candidate):
        hits[candidate, window] = yield owner[row[candidate]], kmer[candidate, window]
        hits &= alive[owner[row]][:, None]

    score = longest_run(hits)
    scored = np.flatnonzero(score > 0)
    has_quality = qual.length[row] > 0
    quality = np.zeros(len(row), dtype=np.int64)
    quality[has_quality] = qual.flat[qual.start[row[has_quality]] + pos[has_quality]]
    order = scored[np.lexsort((scored, quality[scored], -score[scored], row[scored]))]
    best = order[np.unique(row[order], return_index=True)[1]]
    return row[best], pos[best], base[best].astype(np.int64), hits[best]
