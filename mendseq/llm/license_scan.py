"""License scans by ordered signature rules.

Some hundred licenses in several phrasings, and sentences of their texts, make hundreds of
regexes (``license_rules``). A text is cut into words once; a rule is tried only if all its
keywords are among them. Detections are resolved in order of priority: one that lies
inside another of the same or a higher priority is suppressed, of two at the same
place the rule listed first stays. Detections of base rules always stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, rows_of
from mendseq.llm.license_rules import WEIGHT, Rule, rules

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
# Bytes that are no part of a word become blanks; A to Z lower-case; beyond ASCII nothing changes.
_TO_WORDS = bytes(c if c >= 0x80 or c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, lower-cased from A to Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


Found = tuple[Rule, int, int]


def detections(words: list[bytes], chosen: Iterable[Rule]) -> list[Found]:
    """(rule, first word, end word) of every match of ``chosen``, before anything is suppressed."""
    text, out = b" ".join(words), []
    for rule in chosen:
        at, before = 0, 0
        for m in rule.pattern.finditer(text):
            before += text.count(b" ", at, m.start())
            at = m.start()
            out.append((rule, before, before + 1 + m[0].count(b" ")))
    return out


def resolve(found: list[Found]) -> list[Found]:
    """Without what lies inside a detection of the same or a higher priority, but for base rules; by place."""
    kept = [f for f in found if f[0].base]
    spans: list[tuple[int, int]] = []
    rest = sorted((f for f in found if not f[0].base), key=lambda f: f[0].priority)
    for _, tier in groupby(rest, key=lambda f: f[0].priority):
        starts = [s for s, _ in spans]
        ends = list(accumulate((e for _, e in spans), max))
        reach, added = -1, []
        # The wider one of two that begin together comes first, and the rule listed first: the sort is stable.
        for f in sorted(tier, key=lambda f: (f[1], -f[2])):
            _, start, end = f
            above = bisect_right(starts, start) - 1
            if end > reach and (above < 0 or ends[above] < end):
                reach = end
                added.append(f)
        kept += added
        spans = sorted(spans + [(s, e) for _, s, e in added])
    return sorted(kept, key=lambda f: (f[1], f[2], f[0].priority, f[0].name))


_DETECTION = "struct<rule: string, label: string, base: boolean, first: long, end: long, weight: double>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, detections) for every row of ``docs`` (doc_id, text).

    ``detections`` holds rule, label, base, first word, word after the last and weight of
    what stays, by place. A null text is empty and has none. Repeated rows each get a
    row, other columns are left out, an empty table gives no rows.
    """
    def start():
        every = rules()
        keywords = frozenset().union(*(r.keywords for r in every))

        def work(batch):
            ids, given = rows_of(batch, "doc_id", "text")
            counts, out = [], []
            for text in given:
                words = words_of(text)
                counts.append(len(words))
                met = keywords.intersection(words)
                chosen = [r for r in every if r.keywords <= met] if met else []
                out.append([(r.name, r.label, r.base, s, e, WEIGHT[r.priority])
                            for r, s, e in resolve(detections(words, chosen))] if chosen else [])
            return {"doc_id": ids, "n_words": counts, "detections": [
                [dict(zip(("rule", "label", "base", "first", "end", "weight"), d)) for d in row] for row in out]}

        return work

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(given, start, f"doc_id long, n_words long, detections array<{_DETECTION}>")


def _labels(found: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def summarize(scanned: DataFrame) -> DataFrame:
    """One row per row of ``scan``: counts and places of base detections, labels, and the greatest weight as score."""
    found = F.col("detections")
    base = F.filter(found, lambda d: d["base"])
    firsts = F.transform(base, lambda d: d["first"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), _labels(base).alias("base_labels"), _labels(found).alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda d: d["weight"])), F.lit(0.0)).alias("score"))
