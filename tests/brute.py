"""A plain, slow corrector for one read, to hold the distributed one against."""

from __future__ import annotations

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def canonical(kmer: str) -> str:
    return min(kmer, kmer.translate(COMPLEMENT)[::-1])


class Brute:
    def __init__(self, trusted: set[str], k: int, cutoff: int = 0, max_corrections: int = 4,
                 trim: bool = False, new_quality: str | None = None):
        self.trusted, self.k, self.cutoff = trusted, k, cutoff
        self.max_corrections, self.trim, self.new_quality = max_corrections, trim, new_quality

    def has(self, kmer: str) -> bool:
        return len(kmer) == self.k and set(kmer) <= set("ACGT") and canonical(kmer) in self.trusted

    def flags(self, read: str) -> list[bool]:
        return [self.has(read[s:s + self.k]) for s in range(len(read) - self.k + 1)]

    def __call__(self, read: str, qual: str | None):
        """(sequence, quality, correction, bad_prefix, bad_suffix, info)"""
        n, long_end = len(read), min(len(read) // 2, 2 * self.k)
        count, read, qual, prefix, suffix, info = self.once(read, qual)
        if count == -1:
            return read, qual, -1, 0, 0, info
        left_over = 0
        if (size := prefix) > long_end:
            again, part, part_qual, inner_prefix, inner_suffix, why = self.once(
                read[:size], None if qual is None else qual[:size])
            info = max(info, why)
            if again >= 0:
                read = part + read[size:]
                qual = None if qual is None else part_qual + qual[size:]
                prefix, left_over, count = inner_prefix, left_over + inner_suffix, count + again
        if (size := suffix) > long_end:
            again, part, part_qual, inner_prefix, inner_suffix, why = self.once(
                read[n - size:], None if qual is None else qual[n - size:])
            info = max(info, why)
            if again >= 0:
                read = read[:n - size] + part
                qual = None if qual is None else qual[:n - size] + part_qual
                suffix, left_over, count = inner_suffix, left_over + inner_prefix, count + again
        if count == 0 and left_over:
            return read, qual, -1, 0, 0, info
        if self.trim:
            read = read[:n - suffix]
            qual = None if qual is None else qual[:n - suffix]
        return read, qual, count, prefix, suffix, info

    def once(self, read: str, qual: str | None):
        n, k = len(read), self.k
        solid = self.flags(read)
        if all(solid):
            return 0, read, qual, 0, 0, 0
        fix: dict[int, str] = {}
        settled = set()
        for start, end in self.runs(solid):
            if end < len(solid):
                settled.update(range(start, end + k - 1))
        base_text, other_ways = read, False
        if not any(solid):
            best = self.anchor(read, qual)
            if best is None:
                return -1, read, qual, 0, 0, 3
            at, base = best
            other_ways, fix[at] = True, base
            base_text = read[:at] + base + read[at + 1:]
            for s in range(max(0, at - k + 1), min(at, n - k) + 1):
                solid[s] = self.has(base_text[s:s + k])
            if all(solid):
                return 0, read, qual, 0, 0, 0
        start, end = max(self.runs(solid), key=lambda r: (r[1] - r[0], -r[0]))
        right = self.scan(base_text, solid, start, end, +1) if end < len(solid) else None
        left = self.scan(base_text, solid, start, end, -1) if start > 0 else None
        prefix, stop, info, no_way, ambiguous = 0, n, 0, False, False
        for side, result in ((+1, right), (-1, left)):
            if result is None:
                continue
            fixes, failed_at, nothing, several, ways = result
            fix.update(fixes)
            other_ways |= ways
            ambiguous |= several
            no_way |= nothing
            if failed_at is not None:
                info = 2
                if side > 0:
                    stop = failed_at
                else:
                    prefix = failed_at + 1
        over = self.cap(read, qual, fix, settled, other_ways)
        letters, scores, count = list(read), None if qual is None else list(qual), 0
        for at, base in fix.items():
            if base and prefix <= at < stop and letters[at] != base:
                letters[at] = base
                count += 1
                if scores is not None and self.new_quality:
                    scores[at] = self.new_quality
        if count == 0 and prefix == 0 and stop == n:
            if ambiguous:
                count, info = -1, 2
            elif over:
                count, info = -1, 1
        return (count, "".join(letters), None if scores is None else "".join(scores),
                prefix, n - stop, 3 if no_way else info)

    @staticmethod
    def runs(solid: list[bool]) -> list[tuple[int, int]]:
        out, start = [], None
        for i, s in enumerate([*solid, False]):
            if s and start is None:
                start = i
            if not s and start is not None:
                out.append((start, i))
                start = None
        return out

    def anchor(self, read: str, qual: str | None):
        n, k, best = len(read), self.k, None
        loops = (k - 1) // 32 + 1
        for at in range(n):
            for base in "ACGT":
                if base == read[at]:
                    continue
                text = read[:at] + base + read[at + 1:]
                probes = [at - (2 * loops - t - 1) * k // (2 * loops) + 1 for t in range(loops)]
                if not any(self.has(text[s:s + k]) for s in (min(max(s, 0), n - k) for s in probes)):
                    continue
                here = [self.has(text[s:s + k]) for s in range(max(0, at - k + 1), min(at, n - k) + 1)]
                size = max((e - s for s, e in self.runs(here)), default=0)
                score = (size, 0 if qual is None else -ord(qual[at]))
                if size and (best is None or score > best[0]):
                    best = score, at, base
        return best and best[1:]

    def scan(self, read: str, solid: list[bool], start: int, end: int, step: int):
        """Walk away from the run; positions are those of the read in both directions."""
        n, k, n_windows = len(read), self.k, len(solid)
        text, fixes = list(read), {}
        ways = several = nothing = False

        def window(at: int, base: str, j: int) -> str:
            first = at - k + 1 + j if step > 0 else at - j
            return "".join(base if p == at else text[p] for p in range(first, first + k)) \
                if 0 <= first and first + k <= n else ""

        def support(at: int, base: str, most: int) -> int:
            count = 0
            while count < most and self.has(window(at, base, count)):
                count += 1
            return count

        def ahead(at: int) -> int:
            return n - 1 - at if step > 0 else at

        default = end + k - 1 if step > 0 else start - 1
        at = default
        if end - start >= k:
            needed = 1 + min(k, ahead(at))
            if not any(support(at, b, needed) == needed for b in "ACGT" if b != text[at]):
                for j in range(k // 2 - 1, -1, -1):
                    back = default - step * (j + 1)
                    supports = [support(back, b, k // 2 + 2) for b in "ACGT" if b != text[back]]
                    ways |= any(supports)
                    if k // 2 + 2 in supports:
                        at = back
                        break
        while True:
            most = min(k, ahead(at) + 1)
            reach = {b: s for b in "ACGT" if (s := support(at, b, most))}
            ways |= len(reach) > 1
            if not reach:
                return fixes, at, True, several, ways
            if most < k:
                for b, s in reach.items():
                    if s == most:
                        reach[b] += self.beyond(text, at, b, step, k - most)
            top = max(reach.values())
            winners = [b for b in reach if reach[b] == top]
            if top == 1 and text[at] in winners:
                winners = [text[at]]
            if len(winners) > 1 and (top < most or most < k):
                return fixes, at, nothing, several, ways
            if len(winners) > 1:
                fixes[at] = ""
                several = True
            else:
                fixes[at] = text[at] = winners[0]
            if top > ahead(at):
                return fixes, None, nothing, several, ways
            if top < most:
                at += step * top
                continue
            candidates = range(at + 1, n_windows) if step > 0 else range(at - k, -1, -1)
            gap = next((s for s in candidates if not solid[s]), None)
            if gap is None:
                return fixes, None, nothing, several, ways
            at = gap + k - 1 if step > 0 else gap

    def beyond(self, text: list[str], at: int, base: str, step: int, room: int) -> int:
        line = list(text)
        line[at] = base
        line = "".join(line)
        for count in range(room):
            if step > 0:
                grown = next((line + b for b in "ACGT" if self.has(line[len(line) - self.k + 1:] + b)), None)
            else:
                grown = next((b + line for b in "ACGT" if self.has(b + line[:self.k - 1])), None)
            if grown is None:
                return count
            line = grown
        return room

    def cap(self, read, qual, fix, settled, other_ways) -> bool:
        n, k = len(read), self.k
        bonus = not other_ways and not settled & set(fix)

        def weight(p):
            if not fix.get(p) or read[p] == "N":
                return 0
            return 0.5 if qual is not None and ord(qual[p]) <= self.cutoff else 1

        marked = []
        for i in range(n):
            total = sum(weight(p) for p in range(max(0, i - 19), i + 1))
            limit = self.max_corrections + (bonus and i >= 20 and i + 19 < n)
            if total > limit and fix.get(i):
                marked.append(i)
        for i in marked:
            if i not in fix:
                continue
            del fix[i]
            for step in (-1, +1):
                near, p = i, i + step
                while 0 <= p < n and abs(p - near) < k:
                    if fix.get(p):
                        del fix[p]
                        near = p
                    p += step
        return bool(marked)
