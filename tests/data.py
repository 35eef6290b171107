"""Small random genomes and reads with errors, for tests."""

from __future__ import annotations

import random

from tests.brute import COMPLEMENT, canonical


def genome(rng: random.Random, size: int, repeats: int = 2) -> str:
    text = "".join(rng.choice("ACGT") for _ in range(size))
    for _ in range(repeats):
        start, to = rng.randrange(size - 30), rng.randrange(size - 30)
        copy = list(text[start:start + 25])
        copy[rng.randrange(25)] = rng.choice("ACGT")
        text = text[:to] + "".join(copy) + text[to + 25:]
    return text


def kmers(text: str, k: int) -> set[str]:
    return {canonical(text[i:i + k]) for i in range(len(text) - k + 1)}


def trusted(rng: random.Random, text: str, k: int, lost: float = 0.03, extra: float = 0.03) -> set[str]:
    """Most k-mers of the genome, and some that differ by one base."""
    out = {m for m in kmers(text, k) if rng.random() > lost}
    for m in sorted(out):
        if rng.random() < extra:
            at = rng.randrange(k)
            out.add(canonical(m[:at] + rng.choice("ACGT") + m[at + 1:]))
    return out


def read(rng: random.Random, text: str, size: int, rate: float) -> tuple[str, str]:
    start = rng.randrange(max(1, len(text) - size))
    letters, scores = list(text[start:start + size]), []
    for i in range(len(letters)):
        wrong = rng.random() < rate
        if wrong:
            letters[i] = rng.choice("ACGTN" if rng.random() < 0.3 else "ACGT")
        scores.append(rng.choice("#5" if wrong else "5II"))
    seq = "".join(letters)
    return (seq.translate(COMPLEMENT)[::-1], "".join(scores)) if rng.random() < 0.5 else (seq, "".join(scores))


def reads(rng: random.Random, text: str, n: int, sizes=(20, 90), k: int = 7):
    out = []
    for i in range(n):
        size = rng.choice([rng.randint(*sizes), rng.randint(1, 3 * k)])
        seq, qual = read(rng, text, size, rng.choice([0, 0.02, 0.05, 0.1, 0.2]))
        out.append((seq, qual if rng.random() < 0.8 else None))
    return out
