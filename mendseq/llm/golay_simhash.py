"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. The binary Golay code (23, 12) covers
all words of 23 bits: each is within 3 bits of exactly one codeword. So two segments
that differ in at most 2 bits have a codeword in common among those within 4 bits of
either, and if they differ in 1 bit, the nearest codeword of one is within 4 bits of
the other.

Four errors over three segments leave two segments with at most 2 errors together, so
one of these holds for every pair of fingerprints that link:

* one segment is equal and another has at most 2 errors: the key is the equal segment
  and each codeword within 4 bits of the other;
* two segments have one error each: the key is the nearest codeword of one and each
  codeword within 4 bits of the other, made for both of them.

Fingerprints that share a key are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, edges_to_roots, rows_of
from mendseq.session import materialize

SHINGLE, SEED, MAX_BITS = 4, 42, 4
# Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR, CODE_BITS, CHECK_BITS = 0b110001110101, 23, 11

_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit by bit what more than half of the shingle hashes have; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    spans = list(zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(spans), _SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans[at:at + _SHINGLES_AT_ONCE]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint."""
    def start():
        def work(batch):
            ids, texts = rows_of(batch, "doc_id", "text")
            return {"doc_id": ids, "fp": [fingerprint(t) for t in texts]}

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                     start, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of the words as polynomials over two elements."""
    words = words.copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return words


@lru_cache(maxsize=1)
def _error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the nearest codeword's error, and all errors of up to 4 bits (padded with -1)."""
    patterns = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(CODE_BITS), w)])
    of = _syndrome(patterns)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=1 << CHECK_BITS)
    table = np.full((1 << CHECK_BITS, counts.max()), -1)
    column = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[of[order], column] = patterns[order]
    return table[:, 0], table


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 bits."""
    return (words ^ _error_patterns()[0][_syndrome(words)]) >> CHECK_BITS


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): every codeword within 4 bits of each word."""
    errors = _error_patterns()[1][_syndrome(words)]
    row, column = np.nonzero(errors >= 0)
    return row, (words[row] ^ errors[row, column]) >> CHECK_BITS


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every fuzzy key of the fingerprints (int64)."""
    whole = fps.view(np.uint64)
    parts = [((whole >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    nearest = [nearest_codeword(p) for p in parts]
    keys, rows = [], []

    def add(kind: int, high: np.ndarray, low: np.ndarray, row: np.ndarray) -> None:
        keys.append((high << 12 | low) << 4 | kind)
        rows.append(row)

    for kind, (equal, other) in enumerate(permutations(range(3), 2)):
        row, code = near[other]
        add(kind, parts[equal][row], code, row)
    for kind, (i, j) in enumerate(combinations(range(3), 2), 6):
        row, code = near[j]
        add(kind, nearest[i][row], code, row)
        row, code = near[i]
        add(kind, code, nearest[j][row], row)
    return np.concatenate(keys), np.concatenate(rows)


def _bits(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64))


def link_group(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that connect what is linked among distinct fingerprints, not all pairs.

    A search from one fingerprint to the next compares only with those not reached yet.
    """
    left, edges = fps, []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            close = _bits(left ^ np.int64(at)) <= max_bits
            if close.any():
                found = left[close].tolist()
                edges += [(at, x) for x in found]
                frontier += found
                left = left[~close]
    return edges


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a run of equal keys may go over several batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_key, held = None, []
    seen: set[tuple[int, int]] = set()

    def edges_of(key: np.ndarray, fp: np.ndarray) -> None:
        bounds = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(key)]])
        sizes = ends - starts
        two = starts[sizes == 2]
        hit = _bits(fp[two] ^ fp[two + 1]) <= MAX_BITS
        seen.update(zip(fp[two][hit].tolist(), fp[two + 1][hit].tolist()))
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            run = np.unique(fp[s:e])
            if e - s <= 8 and not any((_bits(run[1 + k:] ^ run[:len(run) - 1 - k]) <= MAX_BITS).any()
                                      for k in range(len(run) - 1)):
                continue
            seen.update(link_group(run))

    def flush() -> pa.RecordBatch:
        pairs = [p for p in seen if p[0] != p[1]]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        if held_key is not None and key[0] != held_key:
            edges_of(np.full(sum(map(len, held)), held_key), np.concatenate(held))
            held = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            whole = np.concatenate([*held, fp[:last]])
            edges_of(np.concatenate([np.full(len(whole) - last, key[0]), key[:last]]), whole)
            held = []
        held_key, held = key[-1], [*held, fp[last:]]
        if len(held) > 64:
            held = [np.unique(np.concatenate(held))]
        if len(seen) > 100_000:
            yield flush()
    if held:
        edges_of(np.full(sum(map(len, held)), held_key), np.concatenate(held))
    yield flush()


def linked(fps: DataFrame) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints ``fp`` differing in 4 bits or fewer."""
    def start():
        def work(batch):
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            key, row = fuzzy_keys(values)
            return {"key": pa.array(key), "fp": pa.array(values[row])}

        return work

    keys = arrow_map(fps.select("fp"), start, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_link_runs, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    A null or empty text has fingerprint zero and links like any other. Equal
    fingerprints are one node, so copies are never paired. Repeated rows each get a
    row; other columns are left out. ``component_id`` is the least doc_id reachable;
    null ids do not count for it. An empty table gives no rows.
    """
    found = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = edges_to_roots(linked(nodes)).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
                         "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id.

    Rows that repeat a doc_id are one document. Rows without a doc_id can't be told
    apart and all stay.
    """
    kept = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return (docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where(F.col("doc_id").isNull())))
