"""Correct every read against the trusted k-mers."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mendseq.functions import ragged
from mendseq.functions.ragged import CODES, LETTERS, Ragged
from mendseq.model import (
    INFO_AMBIGUOUS, INFO_LOW_COVERAGE, INFO_OVER_CORRECTED, MAX_BROADCAST_BYTES,
    CorrectionParams, check_k,
)
from mendseq.operators.anchors import find_anchors
from mendseq.operators.kmersets import hit_runs
from mendseq.operators.lanes import LEFT, RIGHT, UNFIXED, Lanes
from mendseq.operators.membership import KmerSet, solve_by_join, solve_in_task
from mendseq.operators.walks import solve_by_walks

# Fixed values of the rule against too many corrections in one place.
CAP_WINDOW = 20
UNKNOWN_BASE = ord("N")

RESULT_FIELDS = ["correction", "bad_prefix", "bad_suffix", "info"]


class Outcome:
    """Per read: bases corrected (-1: given up), uncorrected ends, reason."""

    def __init__(self, rows: int):
        self.correction = np.zeros(rows, dtype=np.int64)
        self.bad_prefix = np.zeros(rows, dtype=np.int64)
        self.bad_suffix = np.zeros(rows, dtype=np.int64)
        self.info = np.zeros(rows, dtype=np.int64)


def correct(reads: DataFrame, trusted: KmerSet, params: CorrectionParams,
            max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Reads with corrected ``seq`` (and ``qual``) and the result columns."""
    check_k(params.k)
    if params.k != trusted.k:
        raise ValueError(f"k is {params.k} but the trusted k-mers have k = {trusted.k}")
    schema = T.StructType(
        list(reads.schema) + [T.StructField(name, T.IntegerType()) for name in RESULT_FIELDS])
    if trusted.fits(max_broadcast):
        return solve_in_task(reads, _kernel(params), trusted, schema)
    if trusted.filters():
        return solve_by_join(reads, _kernel(params), trusted, schema, eager=True)
    return solve_by_walks(reads, _kernel(params), trusted, schema)


def _kernel(params: CorrectionParams):
    def kernel(batch: pa.RecordBatch, alive: np.ndarray):
        seq, qual = ragged.from_arrow(batch["seq"]), ragged.from_arrow(batch["qual"])
        present = qual.length > 0
        if (qual.length[present] != seq.length[present]).any():
            raise ValueError("a read has a quality string of another length than its sequence")
        seq, qual = Ragged(seq.flat.copy(), seq.start, seq.length), Ragged(
            qual.flat.copy(), qual.start, qual.length)
        out = yield from _correct_batch(seq, qual, alive, params)
        return _output(batch, seq, qual, out, alive, params)

    return kernel


def _output(batch, seq, qual, out, alive, params):
    cut = np.where(out.correction >= 0, out.bad_suffix, 0) if params.trim else np.zeros(seq.rows, np.int64)
    rows = pa.array(np.flatnonzero(alive))
    arrays = []
    for name in batch.schema.names:
        if name == "seq":
            arrays.append(_rebuilt(seq, cut, alive))
        elif name == "qual":
            arrays.append(_rebuilt(qual, np.minimum(cut, qual.length), alive,
                                   batch[name].is_null().to_numpy(zero_copy_only=False)))
        else:
            arrays.append(batch[name].take(rows))
    arrays += [pa.array(getattr(out, name)[alive].astype(np.int32)) for name in RESULT_FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *RESULT_FIELDS])


def _rebuilt(text: Ragged, cut: np.ndarray, alive: np.ndarray, null: np.ndarray | None = None):
    if not cut.any() and alive.all():
        return ragged.to_arrow(text.flat, text.length, null)
    kept = alive[text.row_ids()] & (ragged.within(text.length) < np.repeat(text.length - cut, text.length))
    return ragged.to_arrow(text.flat[kept], (text.length - cut)[alive],
                           None if null is None else null[alive])


def _correct_batch(seq: Ragged, qual: Ragged, alive: np.ndarray, params: CorrectionParams) -> Generator:
    """Correct all reads once, then the long ends that stayed bad once more."""
    rows = np.arange(seq.rows)
    out = yield from _repair(seq, qual, rows, alive, params)
    long_end = np.minimum(seq.length // 2, 2 * params.k)
    going = alive & (out.correction >= 0)
    prefix = np.flatnonzero(going & (out.bad_prefix > long_end))
    suffix = np.flatnonzero(going & (out.bad_suffix > long_end))
    if not len(prefix) + len(suffix):
        return out
    again = np.concatenate([prefix, suffix])
    at_end = np.arange(len(again)) >= len(prefix)
    size = np.where(at_end, out.bad_suffix[again], out.bad_prefix[again])
    skip = np.where(at_end, seq.length[again] - size, 0)
    scored = qual.length[again] > 0
    part, cells = _cut(seq, again, skip, size)
    part_qual, qual_cells = _cut(qual, again, np.where(scored, skip, 0), np.where(scored, size, 0))
    more = yield from _repair(part, part_qual, again, alive, params)
    seq.flat[cells], qual.flat[qual_cells] = part.flat, part_qual.flat
    fixed = more.correction >= 0
    left_over = np.zeros(seq.rows, dtype=np.int64)
    np.maximum.at(out.info, again, more.info)
    np.add.at(out.correction, again[fixed], more.correction[fixed])
    np.add.at(left_over, again[fixed], np.where(at_end, more.bad_prefix, more.bad_suffix)[fixed])
    out.bad_prefix[again[fixed & ~at_end]] = more.bad_prefix[fixed & ~at_end]
    out.bad_suffix[again[fixed & at_end]] = more.bad_suffix[fixed & at_end]
    hopeless = (out.correction == 0) & (left_over > 0)
    out.correction[hopeless] = -1
    out.bad_prefix[hopeless] = out.bad_suffix[hopeless] = 0
    return out


def _cut(text: Ragged, rows: np.ndarray, skip: np.ndarray, size: np.ndarray):
    """A copy of ``size`` bytes of each of ``rows``, and the cells it came from."""
    cells = np.repeat(text.start[rows] + skip, size) + ragged.within(size)
    return Ragged(text.flat[cells], np.cumsum(size) - size, size), cells


def _repair(seq: Ragged, qual: Ragged, owner: np.ndarray, alive: np.ndarray,
            params: CorrectionParams) -> Generator:
    """One correction of every row of ``seq``, changing its bases in place."""
    k, out = params.k, Outcome(seq.rows)
    codes = Ragged(CODES[seq.flat], seq.start, seq.length)
    w = ragged.read_windows(seq, k)
    solid = w.valid.copy()
    solid[w.valid] = yield owner[w.row[w.valid]], w.kmer[w.valid]
    n_solid = np.bincount(w.row, weights=solid, minlength=seq.rows).astype(np.int64)
    trusted = _trusted_bases(seq, w, solid, k)

    lost = np.flatnonzero((w.count > 0) & (n_solid == 0) & alive[owner])
    changed, pos, base, hits = yield from find_anchors(k, codes, qual, owner, alive, lost)
    out.correction[lost] = -1
    out.info[lost] = INFO_LOW_COVERAGE
    out.correction[changed] = 0
    out.info[changed] = 0
    fix = np.full(len(codes.flat), UNFIXED, dtype=np.int8)
    alternatives = np.zeros(seq.rows, dtype=bool)
    alternatives[changed] = True
    fix[codes.start[changed] + pos] = base
    codes.flat[codes.start[changed] + pos] = base
    start = pos[:, None] - k + 1 + np.arange(k)
    inside = (start >= 0) & (start < w.count[changed][:, None])
    solid[(w.first[changed][:, None] + start)[inside]] = hits[inside]

    row, first, size = hit_runs(w, solid)
    longest = np.lexsort((first, -size, row))
    longest = longest[np.unique(row[longest], return_index=True)[1]]
    row, first, size = row[longest], first[longest], size[longest]
    open_ended = (size < w.count[row]) & alive[owner[row]]
    row, first, size = row[open_ended], first[open_ended], size[open_ended]
    if not len(row):
        return out
    right = first + size < w.count[row]
    left = first > 0
    lanes = Lanes(
        k, codes, owner, alive,
        row=np.concatenate([row[right], row[left]]),
        side=np.repeat([RIGHT, LEFT], [right.sum(), left.sum()]),
        gap=np.concatenate([(first + size)[right], (w.count[row] - first)[left]]),
        run=np.concatenate([size[right], size[left]]),
        solid=solid, window_first=w.first)
    yield from lanes.run()
    _collect(lanes, codes, fix)
    alternatives[lanes.row[lanes.alternatives]] = True
    _finish(seq, qual, row[alive[owner[row]]], lanes, fix, trusted, alternatives, out, params)
    return out


def _trusted_bases(seq: Ragged, w: ragged.Windows, solid: np.ndarray, k: int) -> np.ndarray:
    """Bases under a run of trusted k-mers that an untrusted one follows."""
    row, first, size = hit_runs(w, solid)
    closed = first + size < w.count[row]
    begin = seq.start[row[closed]] + first[closed]
    edges = np.zeros(len(seq.flat) + 1, dtype=np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + size[closed] + k - 1, -1)
    return np.cumsum(edges)[:-1] > 0


def _collect(lanes: Lanes, codes: Ragged, fix: np.ndarray) -> None:
    """Bring the decisions of both directions to the positions of the read."""
    cells = np.flatnonzero(lanes.fix != UNFIXED)
    lane = np.searchsorted(lanes.off, cells, side="right") - 1
    pos, found = cells - lanes.off[lane], lanes.fix[cells]
    mirrored = lanes.side[lane] == LEFT
    pos = np.where(mirrored, lanes.length[lane] - 1 - pos, pos)
    fix[codes.start[lanes.row[lane]] + pos] = np.where(mirrored & (found >= 0), 3 - found, found)


def _finish(seq, qual, rows, lanes, fix, trusted, alternatives, out, params) -> None:
    size = seq.length[rows]
    place = np.full(seq.rows, -1)
    place[rows] = np.arange(len(rows))
    counted = place[lanes.row] >= 0
    begin, end = np.zeros(len(rows), np.int64), size.copy()
    failed = lanes.failed & counted
    right, left = failed & (lanes.side == RIGHT), failed & (lanes.side == LEFT)
    end[place[lanes.row[right]]] = lanes.stop[right]
    begin[place[lanes.row[left]]] = (lanes.length - lanes.stop)[left]
    any_failed, no_candidate, ambiguous = (np.zeros(len(rows), dtype=bool) for _ in range(3))
    any_failed[place[lanes.row[failed]]] = True
    no_candidate[place[lanes.row[failed & lanes.no_candidate]]] = True
    ambiguous[place[lanes.row[counted & lanes.ambiguous]]] = True

    # Only bases with a decision: there are few of them.
    at = np.flatnonzero(fix != UNFIXED)
    read = np.searchsorted(seq.start, at, side="right") - 1
    at, read = at[place[read] >= 0], read[place[read] >= 0]
    touched = np.zeros(len(rows), dtype=bool)
    touched[place[read[trusted[at]]]] = True
    at, read = at[fix[at] >= 0], read[fix[at] >= 0]
    local, pos, change, letter = place[read], at - seq.start[read], fix[at], seq.flat[at]

    # A correction weighs 2, one of a base of bad quality 1, one of an N nothing.
    scored = qual.length[read] > 0
    score = np.zeros(len(at), dtype=np.int64)
    score[scored] = qual.flat[qual.start[read[scored]] + pos[scored]]
    weight = np.where(letter != UNKNOWN_BASE, np.where(scored & (score <= params.cutoff), 1, 2), 0)
    sums = np.concatenate([[0], np.cumsum(weight)])
    in_window = sums[1:] - sums[np.searchsorted(at, at - np.minimum(pos, CAP_WINDOW - 1))]
    bonus = ~alternatives[rows] & ~touched
    inner = (pos >= CAP_WINDOW) & (pos + CAP_WINDOW - 1 < size[local])
    limit = 2 * (params.max_corrections + (bonus[local] & inner))
    over = in_window > limit
    over_corrected = np.zeros(len(rows), dtype=bool)
    over_corrected[local[over]] = True
    if over.any():
        change[chained_to(over, change >= 0, at + read * params.k, params.k)] = UNFIXED

    applied = (change >= 0) & (pos >= begin[local]) & (pos < end[local])
    applied &= letter != LETTERS[np.maximum(change, 0)]
    seq.flat[at[applied]] = LETTERS[change[applied]]
    if params.new_quality:
        renewed = applied & scored
        qual.flat[qual.start[read[renewed]] + pos[renewed]] = ord(params.new_quality[0])

    n_fixed = np.bincount(local[applied], minlength=len(rows))
    nothing = (n_fixed == 0) & (begin == 0) & (end == size)
    info = np.where(any_failed, INFO_AMBIGUOUS, 0)
    info = np.where(nothing & over_corrected, INFO_OVER_CORRECTED, info)
    info = np.where(nothing & ambiguous, INFO_AMBIGUOUS, info)
    info = np.where(no_candidate, INFO_LOW_COVERAGE, info)
    out.correction[rows] = np.where(nothing & (ambiguous | over_corrected), -1, n_fixed)
    out.bad_prefix[rows], out.bad_suffix[rows] = begin, size - end
    out.info[rows] = info


def chained_to(over: np.ndarray, fixed: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Corrections over the limit, and all that follow each other to them within k."""
    at = np.flatnonzero(fixed)
    chain = np.cumsum(np.diff(place[at], prepend=place[at[:1]]) >= k)
    bad = np.zeros(chain[-1] + 1, dtype=bool)
    bad[chain[over[at]]] = True
    return at[bad[chain]]
