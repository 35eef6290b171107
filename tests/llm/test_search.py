import random
import time

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from mendseq.llm import adaptive_scan, common, copies, golay_simhash as g
from tests.llm.data import documents, empty, texts


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows: list[tuple[int, int]]) -> list[int]:
    """Least id of each row's component, by all pairs."""
    of = list(range(len(rows)))

    def find(x: int) -> int:
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                of[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least[find(i)] for i in range(len(rows))]


def test_golay_code():
    words = np.random.default_rng(1).integers(0, 1 << 23, 200)
    near, nearest = g.near_codewords(words), g.nearest_codeword(words)
    assert len(set(nearest[:50])) > 40
    for i in range(50):
        assert nearest[i] in near[1][near[0] == i]
    # All 2**12 codewords decode to themselves and lie 7 bits apart at least.
    codewords = np.array([(k << 11) ^ int(g._syndrome(np.array([k << 11]))[0]) for k in range(1 << 12)])
    assert (g._syndrome(codewords) == 0).all() and (g.nearest_codeword(codewords) == np.arange(1 << 12)).all()
    assert min(int(c).bit_count() for c in codewords[1:]) == 7


def test_every_pair_in_reach_shares_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(-2**63, 2**63 - 1, 1500, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.array([1 << int(bit)], np.uint64).view(np.int64)[0]
    found = []
    for fps in (a, b):
        keys, rows = g.fuzzy_keys(fps)
        sets = [set() for _ in fps]
        for k, r in zip(keys.tolist(), rows.tolist()):
            sets[r].add(k)
        found.append(sets)
    assert all(x & y for x, y in zip(*found))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    base = texts(20, 8)
    rows = list(enumerate(base))
    for i in range(60):
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(7, base[3]), (7, base[3]), (300, ""), (301, None), (302, " \n"), (303, "ÄÖ b"), (304, "ÄÖ B")]
    docs = spark.createDataFrame([(i, t, 9, "f") for i, t in rows], "doc_id long, text string, component_id int, fingerprint string")
    found = sorted((r.doc_id, r.fingerprint, r.component_id) for r in g.near_duplicates(docs).collect())
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints)))
    assert found == want
    kept = g.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_a_dense_group_and_a_chain(spark):
    # A chain whose ends are far apart, and a ball of prints that all link.
    chain, at = [0], 0
    for k in range(15):
        at |= 0xF << (4 * k)
        chain.append(at)
    ball = [0x0123456789ABCDEF ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chain + ball]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in common.edges_to_roots(g.linked(fps)).collect()}
    assert len({roots[x] for x in signed[:16]}) == 1 and len({roots[x] for x in signed[16:]}) == 1
    assert g.linked(fps).count() < 40 * len(signed)


def test_odd_documents(spark):
    docs = documents(spark)
    assert g.near_duplicates(docs).count() == docs.count()
    kept = g.first_of_each(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id in (40, 41, 42) for r in kept) == 1
    assert g.near_duplicates(empty(docs)).count() == 0 and g.first_of_each(empty(docs)).count() == 0


def vectors(n: int, seed: int = 4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, 16))
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def exact(rows, k=5, step=50):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        score = adaptive_scan.cosines(x, x[i])
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -score[others]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


SCHEMA = "vec_id long, embedding array<double>, score double, rank int"


def test_recall(spark):
    rows = vectors(3000)
    found = by_query(adaptive_scan.nearest(spark.createDataFrame([(*r, 1.0, 1) for r in rows], SCHEMA)))
    want = exact(rows)
    assert set(found) == set(want)
    hits = sum(len(set(dict(found[q])) & set(dict(want[q]))) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = dict(((q, v), s) for q in want for v, s in want[q])
    assert all(abs(scores.get((q, v), s) - s) < 1e-15 for q in found for v, s in found[q])


def test_odd_vectors_and_ties(spark):
    rows = vectors(30)
    odd = [(100, None), (150, [0.0] * 16), (200, [float("nan")] + [1.0] * 15), (201, [None] + [1.0] * 15), (202, [1.0, 2.0]),
           (203, []), (None, [1.0] * 16), (204, [float("inf")] + [1.0] * 15)]
    same = [(i, [1.0] * 16) for i in range(300, 312)]
    twice = [(301, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1.0, 1) for r in rows + odd + same + twice], SCHEMA)
    assert by_query(adaptive_scan.nearest(df)) == exact(rows + same)
    found = by_query(adaptive_scan.nearest(df))[300]
    assert [v for v, _ in found] == [301, 302, 303, 304, 305]
    few = by_query(adaptive_scan.nearest(df.where("vec_id in (0, 1, 2)")))
    assert [v for v, _ in few[0]] == [v for v, _ in exact(rows[:3])[0]]
    assert adaptive_scan.nearest(df.where("1 = 0")).count() == 0


def test_blocks_of_a_large_list(spark, monkeypatch):
    rows = vectors(400)
    monkeypatch.setattr(adaptive_scan, "BLOCK", 16)
    df = spark.createDataFrame([(*r, 1.0, 1) for r in rows], SCHEMA)
    assert by_query(adaptive_scan.nearest(df, probed_share=1.0)) == exact(rows)


@pytest.mark.parametrize("edges, want", [
    ([(1, 2), (3, 2), (5, 4), (4, 4), (2, 1)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([], {})])
def test_components(spark, edges, want):
    found = common.edges_to_roots(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_copies_by_jaccard_of_five_words(spark):
    rng = random.Random(11)
    rows, sets = [], {}
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 2, 3, 5, 8):  # similarities of about 0.92, 0.85, 0.78, 0.66 and 0.5
            words = list(base)
            for at in rng.sample(range(5, 115), edits):
                words[at] = f"new{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500, rows[0][1]), (501, ""), (502, " "), (503, "one two"), (504, "one  TWO")]
    for i, t in rows:
        words = t.lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.values()))


def test_copies_keep_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "quite another text than that one"), (2, long + " end"), (None, long), (None, "alone and without an id at all"),
            (None, "alone and without an id at all"), (1, long)]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted(
        [(1, long), (1, rows[1][1]), (0, rows[4][1])])
    assert corpus_pipeline.drop_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_copies_in_parted_groups(spark, monkeypatch):
    """The same groups, whether texts that bands connect are compared at once, by band or by blocks."""
    rng = random.Random(4)
    passage = [f"common{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = [f"t{i // 3}w{rng.randrange(99)}" for _ in range(80)]
        rows.append((i, " ".join(passage + own if i % 3 else passage + own[:40])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    for together in (1 << 21, 2000, 500):
        monkeypatch.setattr(copies, "TOGETHER", together)
        kept.append(sorted(r.doc_id for r in copies.first_of_each(docs).collect()))
    sets = [copies.shingles(t) for _, t in rows]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[b] if r == root[a] else r for r in root] if root[b] < root[a] else [root[a] if r == root[b] else r for r in root]
    assert kept[0] == kept[1] == kept[2] == sorted(set(root))


def test_many_texts_with_a_passage_and_no_link():
    """No sets are opened where signatures tell enough."""
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 62, 500).astype(np.uint64)])) for _ in range(600)]
    sets += [sets[0][3:], sets[5][:-4]]
    signs = np.stack([copies.signature(s).astype(np.uint8) for s in sets])
    begin = time.time()
    assert sorted(map(sorted, copies.link_sets(list(range(602)), signs, sets))) == [[0, 600], [5, 601]]
    assert time.time() - begin < 2


@pytest.mark.parametrize("hubs", [1, 3])
def test_components_with_hubs(spark, hubs):
    edges = [(h * 10_000 + i, h * 10_000) for h in range(hubs) for i in range(1, 400)] + [(900_000, 900_001), (900_001, 900_002)]
    found = {r.node: r.root for r in common.edges_to_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: n // 10_000 * 10_000 for e in edges for n in e}
