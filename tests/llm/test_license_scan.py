import random
import re

from mendseq.llm import license_scan, license_rules
from tests.llm.data import documents, empty

TEXTS = [
    "Released under the MIT License. Under, the... MIT-license!",
    "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "licensed under CC BY-NC 4.0; cc by nc",
    "Licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "under the mit", "a commit license", "ÉCC by nc", "Mit Licensé under the mitlicense", None, "", " ,.", "x" * 100_000 + " under the mit license",
    "under the mit license " * 3000,
]


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in license_rules.BASE:
        parts = phrase.split(" ")
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return len(words), found


def test_rules():
    every = license_rules.rules()
    assert len(every) > 500
    assert len({r.name for r in every}) == len(every)
    assert [r.priority for r in every] == sorted(r.priority for r in every)


def test_query_against_plain_search(spark):
    rows = [(i, t, -1, "none", 2.0) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], 0, "", 0.0), (None, TEXTS[0], 0, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, labels string, score double").repartition(3)
    out = license_scan.summarize(license_scan.scan(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        n_words, found = plain_base(TEXTS[r.doc_id or 0])
        places = [i for i, _ in found]
        labels = sorted({name for _, name in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            n_words, len(found), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and r.labels.split(",") == sorted(set(r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.labels == "")
    by_id = {r.doc_id: r for r in out}
    assert by_id[2].labels == "cc-by-nc,cc-by-nc-4"
    assert by_id[3].labels == "gpl-3" and by_id[4].labels == "gpl-2-or-later" and by_id[5].labels == "mit" and by_id[5].score == 1.0
    assert by_id[6].labels == by_id[7].labels == by_id[9].labels == ""


def test_keywords_only_save_work(spark):
    """A rule whose keywords are missing can't match."""
    every = license_rules.rules()
    words = sorted({w for r in every for w in r.keywords})
    rng = random.Random(3)
    for text in [t for t in TEXTS if t and len(t) < 1000] + [" ".join(w.decode() for w in rng.choices(words, k=60)) for _ in range(5)]:
        found = license_scan.detections(license_scan.words_of(text), every)
        assert all(r.keywords <= set(license_scan.words_of(text)) for r, _, _ in found)


def test_resolution_against_all_pairs():
    every = license_rules.rules()
    base, rest = [r for r in every if r.base], [r for r in every if not r.base]
    rng = random.Random(4)
    for _ in range(200):
        found = []
        for i in range(rng.randrange(12)):
            start = rng.randrange(12)
            found.append((rng.choice(base if rng.random() < 0.2 else rest), start, start + rng.randrange(1, 6)))
        ranked = sorted((f for f in found if not f[0].base), key=lambda f: (f[0].priority, f[1], -f[2]))
        kept = []
        for f in ranked:
            if not any(k[1] <= f[1] and f[2] <= k[2] for k in kept):
                kept.append(f)
        kept += [f for f in found if f[0].base]
        assert sorted((f[0].name, *f[1:]) for f in license_scan.resolve(found)) == sorted((f[0].name, *f[1:]) for f in kept)


def test_awkward_rows(spark):
    docs = documents(spark)
    assert license_scan.scan(docs).count() == docs.count()
    assert license_scan.summarize(license_scan.scan(empty(docs))).count() == 0
