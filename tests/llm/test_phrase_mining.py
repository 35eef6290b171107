import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mendseq.llm import phrase_mining as p
from tests.llm.data import documents, empty


def plain(rows, least, best):
    """{lang: [(phrase, a, l, r, n, score)]} by counting everything."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        rows = []
        for w, a in f.items():
            if len(w) == 1 or a < least:
                continue
            if len(w) == 2 and any(len(x) == 3 and c >= least and w in (x[:2], x[1:]) and 100 * c >= 50 * a for x, c in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode("utf-8", "surrogatepass"), f[w[:k]], f[w[k:]]))
        if rows:
            out[lang] = [(w.decode(), -a, l, r, n, -s) for s, a, w, l, r in sorted(rows)[:best]]
    return out


def mined(df, **how):
    out = defaultdict(list)
    for r in sorted(p.collocations(df, **how).collect(), key=lambda r: (r.lang, r["rank"])):
        assert r["rank"] == len(out[r.lang]) + 1
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(out)


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [w + e for w in "Sea land Été über x\x00y 日本 a".split() for e in ("", "s", "'")]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\n", "\t", "\xa0"]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "fr", None])) for i in range(n)]
    return rows + [(900, None, "en"), (901, "", None), (None, "a a a a a a", "en"), (902, "a a a a a a", "en"), (902, "a a a a a a", "en"), (903, "sea land " * 3000, "fr")]


@pytest.mark.parametrize("sample_of", [1, 4, 1 << 28])
def test_against_counting_everything(spark, monkeypatch, sample_of):
    """The same, whatever the sample holds: with none of it every frequent phrase is a border failure."""
    monkeypatch.setattr(p, "SAMPLE_OF", sample_of)
    rows = corpus()
    df = spark.createDataFrame([(*r, -1, 0.5) for r in rows], "doc_id long, text string, lang string, n long, score double").repartition(3)
    assert mined(df, least=4, best=25) == plain([(lang, text) for _, text, lang in rows], 4, 25)


def test_small_lots_and_salts(spark, monkeypatch):
    monkeypatch.setattr(p, "LOT", 50)
    monkeypatch.setattr(p, "SALTS", 2)
    rows = corpus(60, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert mined(df, least=3, best=5) == plain([(lang, text) for _, text, lang in rows], 3, 5)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert mined(docs) == plain(rows, 10, 2000)
    assert p.collocations(empty(docs)).count() == 0


def test_distinct_rows_of_many_words():
    rng = np.random.default_rng(1)
    for columns in (2, 3):
        given = [rng.integers(0, 4, 500) for _ in range(columns)]
        few = p.distinct_rows(given, 4)
        many = p.distinct_rows(given, (1 << 22) - 1)
        assert Counter(zip(*(c.tolist() for c in given))) == Counter(dict(zip(zip(*(c.tolist() for c in few[0])), few[1].tolist())))
        assert [c.tolist() for c in few[0]] == [c.tolist() for c in many[0]] and few[1].tolist() == many[1].tolist()


def test_counts_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", 0, "", 4 * 10**12), ("en", 1, "x", 3 * 10**12), ("en", 1, "y", 10**12 - 1), ("en", 2, "x y", 10**12 - 7)],
                                  "lang string, words int, phrase string, n long")
    r = p.scored(found).collect()[0]
    assert r.score == 1_000_000 * (10**12 - 7)**2 // (3 * 10**12 * (10**12 - 1))
