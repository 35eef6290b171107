import random
import re
import zlib
from collections import Counter

import pytest

from mendseq.llm import spelling_variants as s
from tests.llm.data import documents, empty


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    forms, out = {}, {}
    for w in words:
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
        out[w] = [words[w], len(found), forms[w], words[best] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(r) for w, r in out.items()}


def plain_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def vocabulary(seed):
    """Words close to each other, words with repeated letters, and some with hot prefixes."""
    rng, words = random.Random(seed), set()
    for _ in range(12):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(7, 13)))
        for _ in range(12):
            edited = list(word)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(edited))
                edited[at:at + 1] = rng.choice([[], ["a"], ["z", "a"], ["ß"]])
            words.add("".join(edited))
    words |= {"a" * n for n in (7, 8, 9, 11)} | {"prefix" + c + d for c in "abcdef" for d in "abcd"} | {"abcdefg", "bcdefgh", "xabcdefg", "abcdefgx"}
    return {w: 10 ** rng.randrange(5) + rng.randrange(3) for w in words if len(w) >= 7}


@pytest.mark.parametrize("together", [1, 4, 2000])
def test_against_all_pairs(spark, together):
    for seed in range(2):
        words = vocabulary(seed)
        df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
        assert found(s.variants(df, together=together)) == plain_variants(words)


def test_acceptor_is_minimal():
    words = sorted("tap taps top tops stop stops".split())
    a = s.Acceptor(words)
    reached, waiting = [], [(a.start, "")]
    while waiting:
        p, read = waiting.pop()
        reached += [read] * a.final[p]
        waiting += [(to, read + c) for c, to in a.arcs[p]]
    assert sorted(reached) == words
    assert len(a.arcs) == 7
    assert {(u, v) for u, v, _ in a.pairs()} == {(u, v) for i, u in enumerate(words) for v in words if near(u, v) and (len(u), u) < (len(v), v)}


def test_query_against_plain_words(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = plain_words(rows)
    assert {r.word: r.n for r in s.vocabulary(docs).collect()} == words
    assert found(s.variants(s.vocabulary(docs))) == plain_variants(words)
    assert s.variants(s.vocabulary(empty(docs))).count() == 0


def test_damaged_runs(spark):
    """Enough documents that some runs lose a letter, and others fall below the least length."""
    rows = [(i, "Garden garden GARDENS Übergärten gärten×gärten") for i in range(200)] + [(None, "gardens gardens")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in s.vocabulary(docs).collect()} == plain_words(rows)


def test_chain_and_long_words(spark):
    long = "a" * 3000
    words = {"abcdefg": 5, "abcdefgh": 50, "abcdefghi": 500, "abcdefghij": 5000, "bbcdefghij": 50_000, long: 3, long + "a": 40, long[:-1] + "b": 2,
             long[:1500] + "c" + long[1500:]: 400}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(s.variants(df, together=2)) == plain_variants(words)
    assert found(s.variants(df))["abcdefg"][-1] == "bbcdefghij"
