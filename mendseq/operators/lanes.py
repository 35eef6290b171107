"""Extend the trusted part of a read outwards, one base decision at a time.

A *lane* is one direction of one read, leaving the longest run of trusted k-mers.
Going left over a read is going right over its reverse complement, so both
directions are the same computation; only the order in which equal bases are
preferred is mirrored. All lanes of a batch advance together: every turn asks for
the k-mers of the four bases each lane could put at its current position.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

from mendseq.functions.nodes import WALK, Nodes
from mendseq.functions.ragged import COMPLEMENT, OTHER, Ragged, canonical_windows, next_kmers, starts, within

CHECK_ANCHOR, MOVE_ANCHOR, SCAN, DONE = range(4)
RIGHT, LEFT = 0, 1
UNFIXED, AMBIGUOUS = -1, -2


class Lanes:
    def __init__(self, k: int, codes: Ragged, owner: np.ndarray, alive: np.ndarray,
                 row: np.ndarray, side: np.ndarray, gap: np.ndarray, run: np.ndarray,
                 solid: np.ndarray, window_first: np.ndarray):
        """``gap`` is the first untrusted window beyond the run, ``run`` its size."""
        self.k, self.alive, self.owner = k, alive, owner[row]
        self.row, self.side = row, side
        self.length = codes.length[row]
        self.n_windows = self.length - k + 1
        self.gap = gap
        pad = k + 1
        self.off = starts(self.length + pad)
        total = int((self.length + pad).sum())
        cells, source = self._cells(self.length, codes.start[row])
        base = codes.flat[source]
        self.text = np.full(total, OTHER, dtype=np.uint8)
        self.text[cells] = np.where(np.repeat(side == RIGHT, self.length), base, COMPLEMENT[base])
        self.fix = np.full(total, UNFIXED, dtype=np.int8)
        # Untrusted windows, and the ends of the lanes.
        cells, source = self._cells(self.n_windows, window_first[row])
        self.opens = np.zeros(total, dtype=bool)
        self.opens[cells] = ~solid[source]
        self.opens[self.off + self.n_windows] = True
        self.gaps = np.flatnonzero(self.opens)
        self.at = gap + k - 1
        self.shift = np.full(len(row), k // 2 - 1)
        self.phase = np.where(run >= k, CHECK_ANCHOR, SCAN)
        self.stop = self.length.copy()
        self.failed = np.zeros(len(row), dtype=bool)
        self.no_candidate = np.zeros(len(row), dtype=bool)
        self.alternatives = np.zeros(len(row), dtype=bool)
        self.ambiguous = np.zeros(len(row), dtype=bool)

    def _cells(self, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``count`` items of each lane, where they lie in it and, from ``first`` on, in the read."""
        pos, forward = within(count), self.side == RIGHT
        source = np.repeat(np.where(forward, first, first + count - 1), count) + np.where(np.repeat(forward, count), pos, -pos)
        return np.repeat(self.off, count) + pos, source

    def _next_gap(self, lanes: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The next untrusted window at or after one."""
        at = self.off[lanes] + np.minimum(window, self.n_windows[lanes])
        return self.gaps[np.searchsorted(self.gaps, at)] - self.off[lanes]

    def run(self) -> Generator:
        while True:
            turn = np.flatnonzero((self.phase != DONE) & self.alive[self.owner])
            if not len(turn):
                return
            yield from self._turn(turn)

    def _turn(self, turn: np.ndarray) -> Generator:
        k, at, phase = self.k, self.at[turn], self.phase[turn]
        around = self.text[(self.off[turn] + at - k + 1)[:, None] + np.arange(2 * k)]
        own = around[:, k - 1]
        beyond = np.minimum(self.length[turn] - 1 - at, np.select(
            [phase == CHECK_ANCHOR, phase == MOVE_ANCHOR], [k, k // 2 + 1], k - 1))
        # Most bases fail at once: the rest is made and asked for only where the first is found.
        kmers, usable = next_kmers(around[:, :k - 1], k)
        wanted = (usable & (beyond >= 0))[:, None] & ((phase == SCAN)[:, None] | (np.arange(4) != own[:, None]))
        hit = np.zeros(wanted.shape, dtype=bool)
        lane, base = np.nonzero(wanted)
        if len(lane):
            hit[lane, base] = yield (
                self.owner[turn][lane], kmers[lane, base], lambda: self._foresee(turn), lane * 4 + base)
            hit &= self.alive[self.owner[turn]][:, None]
        supported = hit.astype(np.int64)
        lane, base = np.nonzero(hit)
        follow = around[lane, 1:]
        follow[:, k - 2] = base
        kmers, usable = canonical_windows(follow, k)
        usable &= np.arange(1, k + 1) <= beyond[lane][:, None]
        found = np.zeros(usable.shape, dtype=bool)
        which, window = np.nonzero(usable)
        if len(which):
            found[which, window] = yield (
                self.owner[turn][lane[which]], kmers[which, window], lambda: self._foresee(turn), (lane * 4 + base)[which])
        supported[lane, base] += np.logical_and.accumulate(found, axis=1).sum(axis=1)
        going = self.alive[self.owner[turn]]
        self._check_anchor(turn[going & (phase == CHECK_ANCHOR)],
                           supported[going & (phase == CHECK_ANCHOR)])
        self._move_anchor(turn[going & (phase == MOVE_ANCHOR)],
                          supported[going & (phase == MOVE_ANCHOR)])
        scan = going & (phase == SCAN)
        yield from self._scan(turn[scan], supported[scan], own[scan])

    def _foresee(self, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-1 bases ahead of where each lane is and of later gaps in its trusted windows, one in half a walk."""
        k = self.k
        opens = np.flatnonzero(self.opens & ~np.concatenate([[False], self.opens[:-1]]))
        lane = np.searchsorted(self.off, opens, side="right") - 1
        here = self.at - k + 1
        later = np.isin(lane, turn) & (opens - self.off[lane] > here[lane]) & (opens - self.off[lane] < self.n_windows[lane])
        lane, opens = lane[later], opens[later]
        stretch = (opens - self.off[lane] - here[lane]) // (WALK // 2)
        ahead = (stretch > 0) & np.concatenate([[True], (lane[1:] != lane[:-1]) | (stretch[1:] != stretch[:-1])])[:len(lane)]
        lane, start = np.concatenate([turn, lane[ahead]]), np.concatenate([self.off[turn] + here[turn], opens[ahead]])
        base = self.text[start[:, None] + np.arange(k - 1)]
        usable = (base < OTHER).all(axis=1)
        return self.owner[lane[usable]], Nodes(k).of_bases(base[usable])

    def _check_anchor(self, lanes: np.ndarray, supported: np.ndarray) -> None:
        """The run is a good start if changing only the next base explains what follows."""
        needed = 1 + np.minimum(self.k, self.length[lanes] - 1 - self.at[lanes])
        good = (supported == needed[:, None]).any(axis=1)
        self.phase[lanes[good]] = SCAN
        self._place_anchor(lanes[~good])

    def _move_anchor(self, lanes: np.ndarray, supported: np.ndarray) -> None:
        """Perhaps the run's last bases are wrong already: try to start further back."""
        self.alternatives[lanes] |= (supported > 0).any(axis=1)
        accepted = (supported == self.k // 2 + 2).any(axis=1)
        self.phase[lanes[accepted]] = SCAN
        rest = lanes[~accepted]
        self.shift[rest] -= 1
        self._place_anchor(rest)

    def _place_anchor(self, lanes: np.ndarray) -> None:
        given_up = self.shift[lanes] < 0
        self.phase[lanes] = np.where(given_up, SCAN, MOVE_ANCHOR)
        back = np.where(given_up, 0, self.shift[lanes] + 1)
        self.at[lanes] = self.gap[lanes] + self.k - 1 - back

    def _scan(self, lanes: np.ndarray, supported: np.ndarray, own: np.ndarray) -> Generator:
        k, at, length = self.k, self.at[lanes], self.length[lanes]
        last = np.minimum(at + k - 1, length - 1)
        found = supported > 0
        self.alternatives[lanes] |= found.sum(axis=1) > 1
        reach = np.where(found, at[:, None] + supported, -1)
        to_end = found & (reach == length[:, None])
        short = last - at + 1 < k
        tied = np.flatnonzero(short & (to_end.sum(axis=1) > 1))
        if len(tied):
            extra = yield from self._beyond_end(lanes[tied], to_end[tied])
            reach[tied] += extra
            going = self.alive[self.owner[lanes]]
            lanes, at, length, last, short, own = (
                v[going] for v in (lanes, at, length, last, short, own))
            reach, found = reach[going], found[going]
        best = reach.max(axis=1) if len(lanes) else np.zeros(0, dtype=np.int64)
        is_best = found & (reach == best[:, None])
        # Where no base explains more than itself, the read's own base is kept.
        mine = np.minimum(own, 3)
        keeps_own = (best == at + 1) & (own < OTHER) & is_best[np.arange(len(lanes)), mine]
        choice = np.where(keeps_own, mine, is_best.argmax(axis=1))
        several = ~keeps_own & (is_best.sum(axis=1) > 1)
        nothing = ~found.any(axis=1)
        fails = nothing | (several & ((best <= last) | short))
        stuck = lanes[fails]
        self.no_candidate[lanes[nothing]] = True
        self.failed[stuck] = True
        self.stop[stuck] = at[fails]
        self.phase[stuck] = DONE
        goes = ~fails
        lanes, at, length, last, best = (v[goes] for v in (lanes, at, length, last, best))
        choice, several = choice[goes], several[goes]
        here = self.off[lanes] + at
        self.fix[here] = np.where(several, AMBIGUOUS, choice)
        self.ambiguous[lanes] |= several
        self.text[here[~several]] = choice[~several]
        jump = best > last
        gap = self._next_gap(lanes, at + 1)
        finished = (best >= length) | (jump & (gap >= self.n_windows[lanes]))
        self.phase[lanes[finished]] = DONE
        self.at[lanes] = np.where(jump, gap + k - 1, best)

    def _beyond_end(self, lanes: np.ndarray, open_bases: np.ndarray) -> Generator:
        """How many bases each way of ending the read could still be continued by."""
        k, at, length = self.k, self.at[lanes], self.length[lanes]
        room = k - 1 - (length - 1 - at)
        begin = length - k + 1
        tail = self.text[(self.off[lanes] + begin)[:, None] + np.arange(k - 1)]
        tail = np.repeat(tail[:, None, :], 4, axis=1)
        tail[np.arange(len(lanes)), :, at - begin] = np.arange(4)
        preferred = np.where((self.side[lanes] == RIGHT)[:, None], np.arange(4), 3 - np.arange(4))
        extra = np.zeros(open_bases.shape, dtype=np.int64)
        going = open_bases.copy()
        while True:
            going &= (extra < room[:, None]) & self.alive[self.owner[lanes]][:, None]
            lane, base = np.nonzero(going)
            if not len(lane):
                return extra
            ends = tail[lane, base]
            kmers, usable = next_kmers(ends, k)
            kmers = np.take_along_axis(kmers, preferred[lane], axis=1)
            hit = np.zeros(kmers.shape, dtype=bool)
            asking, way = np.nonzero(np.broadcast_to(usable[:, None], hit.shape))
            hit[asking, way] = yield self.owner[lanes][lane[asking]], kmers[asking, way]
            grown = hit.any(axis=1)
            chosen = preferred[lane, hit.argmax(axis=1)]
            tail[lane[grown], base[grown]] = np.concatenate([ends[:, 1:], chosen[:, None].astype(np.uint8)], axis=1)[grown]
            extra[lane[grown], base[grown]] += 1
            going[lane[~grown], base[~grown]] = False
