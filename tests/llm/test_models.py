import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from mendseq.llm import byte_cnn, context_mixing, toxicity
from tests.llm.data import documents, empty, texts

CLEAN, BAD = "the river stone light winter garden letter window".split(), ["blockhead", "numskull", "nitwit"]


def labelled(n: int, seed: int):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        lines = [" ".join(rng.choice(CLEAN) + rng.choice(["", "s", "ly"]) for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        toxic = i % 3 == 0
        if toxic:
            lines.insert(rng.randrange(len(lines) + 1), "you " + rng.choice(BAD) + " go away")
        found.append((i, ". ".join(lines) + ".", int(toxic)))
    return found


def test_toxicity_is_learned_and_located(spark):
    rows = labelled(300, 1)
    docs = spark.createDataFrame([(i, t, 0.1, 5) for i, t, _ in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 0, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in found if found[i].held_out]
    assert {i for i in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(found[i].predicted == rows[i][2] for i in held) >= 0.95 * len(held)
    for i in held:
        if found[i].predicted:
            assert any(b in rows[i][1][s.start:s.end] for s in found[i].offending for b in BAD)
    kept = {r.doc_id for r in toxicity.clean_documents(docs, labels).collect()}
    assert kept == {i for i in found if not found[i].predicted}
    assert toxicity.clean_documents(docs, labels).columns == docs.columns


def test_toxicity_without_labels_and_odd_texts(spark):
    docs = documents(spark)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(r.score < 0.5 and r.predicted == 0 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (40, 41, 42))
    assert toxicity.score(empty(docs), model).count() == 0


def test_noisy_or():
    p = np.array([0.1, 0.5, 0.0])
    assert abs(toxicity.noisy_or(p) - (1 - 0.9 * 0.5)) < 1e-12
    assert toxicity.noisy_or(np.array([])) == 0


LANGUAGES = {"xx": "sch ung ver ein der und lich keit".split(), "yy": "que eau oux tre les des ment oir".split()}


def written(n: int, seed: int):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(LANGUAGES[name]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 90))), name)
            for i, name in ((i, rng.choice(list(LANGUAGES))) for i in range(n))]


def test_language_is_learned(spark):
    rows = written(240, 2) + [(900, "123 !!", "xx"), (901, None, "yy"), (902, "schung", None), (902, "schung", None)]
    docs = spark.createDataFrame([(i, t, name, 1.5) for i, t, name in rows], "doc_id long, text string, lang string, score double")
    model = byte_cnn.fit(docs)
    found = byte_cnn.identify(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[900].lang_pred == by_id[901].lang_pred == "und"
    held = [(i, name) for i, _, name in rows[:240] if by_id[i].held_out]
    assert sum(by_id[i].lang_pred == name for i, name in held) >= 0.95 * len(held) > 20
    kept = byte_cnn.in_a_language(docs)
    assert kept.columns == docs.columns and not {900, 901} & {r.doc_id for r in kept.collect()}
    assert byte_cnn.identify(empty(docs), model).count() == 0


def test_language_without_labels(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    model = byte_cnn.fit(docs)
    assert {r.lang_pred for r in byte_cnn.identify(docs, model).collect()} == {"und"}
    assert byte_cnn.in_a_language(docs).count() == docs.count()


def test_convolution_slopes():
    model = byte_cnn.Model(["a", "b"])
    model.start(np.random.default_rng(1))
    rows, labels = np.random.default_rng(2).integers(97, 110, (5, byte_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    slopes = model.slopes(rows, labels)

    def loss() -> float:
        return -np.log(model.probabilities(rows)[np.arange(5), labels].astype(float)).mean()

    for name, at in (("dense", (3, 1)), ("filters", (0, 2, 5)), ("embedding", (100, 3)), ("bias", (4,))):
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-2
        up = loss()
        model.weights[name][at] = kept - 1e-2
        down = loss()
        model.weights[name][at] = kept
        assert abs((up - down) / 2e-2 - slopes[name][at]) < 2e-2


def test_base_scores_and_counts(spark):
    docs = documents(spark)
    rows = context_mixing.score(docs).collect()
    given = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    counts = Counter(w for i, t in given if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
                  for _, t in given)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    assert context_mixing.score(empty(docs)).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    docs = documents(spark)
    whole = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in context_mixing.score(docs).collect())
    monkeypatch.setattr(context_mixing, "COUNTED", 3)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in context_mixing.score(docs).collect()) == whole


def test_decisions_tell_ranks_apart():
    ranks = np.arange(3000)
    paths = [[] for _ in ranks]
    for at, node, bit in context_mixing.decisions(ranks):
        for i, n, b in zip(at.tolist(), node.tolist(), bit.tolist()):
            paths[i].append((n, b))
    assert len({tuple(p) for p in paths}) == len(ranks)
    # A prefix-free code: chances of all ranks sum to at most one.
    assert sum(2.0 ** -len(p) for p in paths) <= 1
    nodes = {}
    for p in paths:
        for k, (n, _) in enumerate(p):
            assert nodes.setdefault(n, p[:k]) == p[:k]


def test_learned_from_order(spark):
    rng = random.Random(7)
    follow = {"a": "b", "b": "c", "c": "d", "d": "a"}
    rows = []
    for i in range(200):
        word, line = rng.choice("abcd"), []
        for _ in range(30):
            line.append(word)
            word = follow[word]
        rows.append((i, " ".join(line)))
    scored = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(scored) > 10 and all(r.score > 0.6 * r.base_score for r in scored)


def test_texts_are_scored_alike_in_any_partitioning(spark):
    docs = spark.createDataFrame(list(enumerate(texts(20))), "doc_id long, text string")
    one = {r.doc_id: r.score for r in context_mixing.score(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in context_mixing.score(docs.repartition(7)).collect()}
    assert all(abs(one[i] - many[i]) < 1e-4 * abs(one[i]) for i in one)


def test_two_tokens_tell_the_next(spark):
    # One token before tells nothing of the next; the two before tell all.
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        line = [rng.randrange(31), rng.randrange(1, 31)]
        while len(line) < 60:
            line.append((line[-2] + line[-1]) % 31)
        rows.append((i, " ".join(f"w{x}" for x in line)))
    scored = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in scored) > 0.75 * sum(r.base_score for r in scored)


def test_every_decision_is_mixed(spark):
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string")
    model = context_mixing.fit(docs, context_mixing.word_counts(docs))
    depths = context_mixing.CLASS_BITS + int(np.log2(model.ranks.max() + 1))
    _, weights, refine = model.token_scores(model.ranks[:-1], np.array([len(model.ranks) - 1]))
    assert len(model.weights) >= depths and model.weights.shape[1] == 4
    assert (np.abs(weights - model.weights)[:depths].max(1) > 0).all() and (np.abs(refine - model.refine)[:depths].max(1) > 0).all()


def test_rare_words_keep_their_counts_in_score(spark, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(context_mixing, "RANKED", 3)
    found = []
    for counted in (context_mixing.COUNTED, 8):
        monkeypatch.setattr(context_mixing, "COUNTED", counted)
        found.append(sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), r.score, r.bits_per_byte or 0.0)
                            for r in context_mixing.score(docs).collect()))
    assert all(a[:3] == b[:3] for a, b in zip(*found))
    assert np.allclose([r[3:] for r in found[0]], [r[3:] for r in found[1]], rtol=1e-6)


def test_decisions_are_counted_in_lots():
    """Batches wait until there are enough tokens, and count as one batch does."""
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 3000, n) for n in (40, 1, 700)]
    lots = context_mixing.BitCounts(context_mixing.TOKEN_SLOTS)
    for ranks in parts:
        lots.add_tokens(ranks, np.array([0]))
    assert not lots.seen.any()
    whole = context_mixing.BitCounts(context_mixing.TOKEN_SLOTS)
    whole.add_tokens(np.concatenate(parts), np.array([0, 40, 41]))
    assert lots.blocks().equals(whole.blocks())
    assert lots.seen.any() and lots.seen.sum() == sum(len(at) for at, _, _ in context_mixing.decisions(np.concatenate(parts))) * 4


class Watched:
    """numpy, with the sizes of what goes into exp and comes out of bincount."""

    def __init__(self):
        self.mixed, self.longest = 0, 0

    def __getattr__(self, name):
        return getattr(np, name)

    def exp(self, z, *args, **kwargs):
        self.mixed += z.size
        return np.exp(z, *args, **kwargs)

    def bincount(self, *args, **kwargs):
        found = np.bincount(*args, **kwargs)
        self.longest = max(self.longest, len(found))
        return found


def made_up_model(vocabulary: int, seed: int) -> context_mixing.Model:
    rng = np.random.default_rng(seed)
    tables = [rng.integers(-60, 60, n).astype(np.int8) for n in context_mixing.TOKEN_SLOTS]
    spelling = [np.zeros(n, np.int8) for n in context_mixing.SPELLING_SLOTS]
    words = {b"w%d" % i: i for i in range(vocabulary)}
    depth, cells = context_mixing.DEPTH, context_mixing.REFINE_CELLS
    return context_mixing.Model(vocabulary, vocabulary, words, np.append(np.ones(vocabulary, np.int64), 0), np.append(np.arange(vocabulary) + 1, 0),
                                tables, spelling, rng.random((depth, 4)).astype(np.float32) * 0.3, rng.random((depth, cells)).astype(np.float32))


def test_only_decisions_are_mixed_and_counted(monkeypatch):
    """Depths that a token does not reach cost nothing, nor do slots that nothing is counted in."""
    model, ranks = made_up_model(3000, 3), np.random.default_rng(4).geometric(0.01, 900).clip(1, 3000)
    made = sum(len(at) for at, _, _ in context_mixing.decisions(ranks))
    watched = Watched()
    monkeypatch.setattr(context_mixing, "np", watched)
    model.token_scores(ranks, np.array([600, 1, 299]))
    assert watched.mixed == made < 0.8 * context_mixing.DEPTH * len(ranks)
    counts = context_mixing.BitCounts(context_mixing.TOKEN_SLOTS)
    counts.add_tokens(ranks, np.array([0]))
    counts.blocks()
    assert counts.seen.sum() == 4 * made and watched.longest <= made


def test_mixing_matches_a_plain_mixer():
    """Token after token and decision after decision, as the method says."""
    model, sizes = made_up_model(3000, 5), np.array([40, 1, 700, 3])
    ranks = np.random.default_rng(6).geometric(0.01, sizes.sum()).clip(0, 3000)
    ends = np.cumsum(sizes)
    around = context_mixing.contexts(ranks, ends - sizes)
    steps = [[] for _ in ranks]
    for d, (at, node, bit) in enumerate(context_mixing.decisions(ranks)):
        for i, n, b in zip(at.tolist(), node.tolist(), bit.tolist()):
            slots = [n if k == 0 else int(context_mixing._slots(around[k][i:i + 1], context_mixing._NODES[n], len(t))[0]) for k, t in enumerate(model.tables)]
            steps[i].append((d, b, np.array([t[s] for t, s in zip(model.tables, slots)]) * context_mixing.STEP))
    want, weights, refine, stretches = [], 0, 0, 0
    for size, end in zip(sizes.tolist(), ends.tolist()):
        score = 0.0
        for i in range(end - size, end):
            if (i - end + size) % context_mixing.STRETCH == 0:
                w, r = model.weights.astype(float), model.refine.astype(float)
            for d, bit, x in steps[i]:
                z = min(8.0, max(-8.0, w[d] @ x))
                p, cell = 1 / (1 + math.exp(-z)), context_mixing.REFINE_CELLS // 2 + round(2 * z)
                score += math.log10(max(1e-6, abs((p + r[d, cell]) / 2 + bit - 1)))
                r[d, cell] += context_mixing.REFINE_RATE * (bit - r[d, cell])
                w[d] += context_mixing.RATE * (bit - p) * x
            if i + 1 == end or (i + 1 - end + size) % context_mixing.STRETCH == 0:
                weights, refine, stretches = weights + w, refine + r, stretches + 1
        want.append(score)
    scores, last, refined = model.token_scores(ranks, sizes)
    assert np.allclose(scores, want, rtol=1e-3)
    assert np.allclose(last, weights / stretches, atol=0.01) and np.allclose(refined, refine / stretches, atol=0.01)


def test_blocks_keep_counts_of_any_size():
    """Blocks are as narrow as their counts; their sums are those of the counts."""
    counts = context_mixing.BitCounts(context_mixing.SPELLING_SLOTS)
    cells = {(0, 0): 3, (5, 1): 255, (context_mixing.BLOCK, 0): 256, (2 * context_mixing.BLOCK + 1, 1): 70_000}
    for (slot, bit), n in cells.items():
        counts.seen[slot, bit] = n
    blocks = counts.blocks()
    assert blocks.column("block").to_pylist() == [0, 1, 2]
    sizes = [len(zstandard.decompress(b)) for b in blocks.column("counts").to_pylist()]
    assert sizes == [2 * context_mixing.BLOCK * width for width in (1, 2, 4)]
    # Two tasks with the same counts.
    batch = pa.concat_batches([blocks, blocks]).sort_by("block")
    found = {r["block"]: np.frombuffer(r["stretch"], np.int8) for b in context_mixing._summed(iter([batch])) for r in b.to_pylist()}
    for (slot, bit), n in cells.items():
        zeros, ones = (0, 2 * n) if bit else (2 * n, 0)
        want = np.clip(round(math.log((ones + 0.4) / (zeros + 0.4)) / context_mixing.STEP), -127, 127)
        assert found[slot // context_mixing.BLOCK][slot % context_mixing.BLOCK] == want
    assert sum(np.count_nonzero(s) for s in found.values()) == len(cells)
