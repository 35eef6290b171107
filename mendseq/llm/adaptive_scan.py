"""Approximate nearest neighbours: inverted lists searched by an adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid. Within a probed list all vectors
are rotated by the same random rotation, so that any leading columns are a fair sample
of a distance; after each block of columns a hypothesis test abandons candidates whose
partial distance already says that they are too far (Gao and Long, 2023). What is left
is measured exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, hashed_sample
from mendseq.session import materialize

NEIGHBOURS, QUERY_STEP = 5, 50
# The sample that centroids are fitted on, and the most lists.
SAMPLE, MOST_LISTS, ROUNDS = 8192, 1024, 12
# Share of the lists each query probes, at least so many, and at least so many vectors in them.
PROBED_SHARE, LEAST_PROBED, LEAST_VECTORS = 0.7, 24, 1024
# Vectors and queries that meet in one group.
BLOCK = 4096
# Columns between two tests, and how sure a test is: larger abandons less.
COLUMNS, SURENESS = 16, 3.0
# Lists: the square root of the number of vectors, divided by this.
LIST_FACTOR = 3
# Candidates tested at once; the bound grows tighter from one lot to the next.
LOT = 1024
SEED = 5


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as float64 bytes ... ) of the rows that take part.

    Left out: null ids, vectors that are null, empty, zero or hold null or non-finite
    components, and those not of the commonest length. Rows that repeat a vec_id count
    once, with the least vector.
    """
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = found.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)) \
        .where(ok & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means; a centroid without members moves to the worst served vector."""
    unit = _unit(sample)
    rng = np.random.default_rng(SEED)
    at = unit[rng.permutation(len(unit))[:n]]
    for _ in range(ROUNDS):
        likeness = unit @ at.T
        own = likeness.argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums * sums).sum(1))
        worst = np.argsort(likeness.max(1))
        for k, lone in enumerate(np.flatnonzero(size < 1e-12)):
            sums[lone], size[lone] = unit[worst[k % len(worst)]], 1.0
        at = sums / size[:, None]
    return at


def cosines(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (rows * one).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((one * one).sum()))


def scan(rotated: np.ndarray, rows: np.ndarray, ids: np.ndarray, query_rotated: np.ndarray, query: np.ndarray,
         query_id: int, k: int, bound: float = np.inf) -> list[tuple[float, int]]:
    """(cosine, id) of the best ``k``, ties to the smaller id.

    ``bound``: a squared distance of unit vectors that the ``k`` nearest are known to keep.
    """
    best: list[tuple[float, int]] = []
    dim = rotated.shape[1]
    for s in range(0, len(ids), LOT):
        alive = np.arange(s, min(s + LOT, len(ids)))
        alive = alive[ids[alive] != query_id]
        partial = np.zeros(len(alive))
        for a in range(0, dim, COLUMNS):
            gap = rotated[alive, a:a + COLUMNS] - query_rotated[a:a + COLUMNS]
            partial += np.einsum("ij,ij->i", gap, gap)
            seen = min(a + COLUMNS, dim)
            if np.isfinite(bound):
                # Unit vectors: the squared distance is 2 - 2 cos. All columns seen: no chance is left but rounding.
                slack = (1 + SURENESS / np.sqrt(seen)) ** 2 if seen < dim else 1 + 1e-9
                stays = partial * (dim / seen) <= bound * slack + 1e-12
                alive, partial = alive[stays], partial[stays]
                if not len(alive):
                    break
        if len(alive):
            best += zip(cosines(rows[alive], query).tolist(), ids[alive].tolist())
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                bound = min(bound, max(0.0, 2 - 2 * best[-1][0]))
    return best


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, probed_share: float = PROBED_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is a multiple of ``step``, the ``k`` nearest found.

    ``vectors``: vec_id, embedding; other columns are left out and rows that take no
    part (see ``usable``) are neither queries nor found. Fewer candidates: all of them.
    No vectors: no rows. A list's vectors and queries meet in blocks, so that a list
    that holds a large share of all vectors is many groups.
    """
    spark = vectors.sparkSession
    known = materialize(usable(vectors), "vectors")
    result = "query_id long, rank int, vec_id long, score double"
    sizes = known.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    known = known.where(F.size("v") == dim)
    sample = hashed_sample(known, "vec_id", SAMPLE, total).toArrow().sort_by("vec_id")
    fitted = np.array(sample.column("v").to_pylist(), np.float64)
    fitted_ids, fitted_unit = sample.column("vec_id").to_numpy(), _unit(fitted)
    n_lists = int(min(MOST_LISTS, max(1, round(total ** 0.5 / LIST_FACTOR)), len(fitted)))
    centres, turn = centroids(fitted, n_lists), rotation(dim)

    def rows(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        column = batch.column("v")
        return batch.column("vec_id"), column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

    def dealer():
        def work(batch):
            if not batch.num_rows:
                return None
            ids, x = rows(batch)
            own = (_unit(x) @ centres.T).argmax(1).astype(np.int32)
            return {"vec_id": ids, "list": pa.array(own), "v": [r.tobytes() for r in x]}

        return work

    dealt = materialize(arrow_map(known, dealer, "vec_id long, list int, v binary"), "lists")
    # One row for each list, MOST_LISTS at most.
    counted = {r["list"]: r["n"] for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([counted.get(i, 0) for i in range(n_lists)])
    probed = min(n_lists, max(LEAST_PROBED, int(np.ceil(n_lists * probed_share))))

    def prober():
        def work(batch):
            if not batch.num_rows:
                return None
            ids, x = rows(batch)
            order = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")
            reached = np.cumsum(held[order], axis=1) - held[order]
            wanted = (np.arange(n_lists) < probed) | (reached < LEAST_VECTORS)
            row, at = np.nonzero(wanted & (held[order] > 0))
            # The k-th nearest of the sample is no nearer than the k-th nearest of all.
            likeness = _unit(x) @ fitted_unit.T
            likeness[ids.to_numpy()[:, None] == fitted_ids] = -np.inf
            bound = 2 - 2 * np.sort(likeness, axis=1)[:, -k] if len(fitted_ids) >= k else np.full(len(x), np.inf)
            return {"query_id": ids.take(pa.array(row)), "list": pa.array(order[row, at].astype(np.int32)),
                    "v": [x[r].tobytes() for r in row], "bound": pa.array(bound[row])}

        return work

    asked = materialize(arrow_map(known.where(F.col("vec_id") % step == 0), prober, "query_id long, list int, v binary, bound double"),
                        "probes")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_blocks")).join(
        dealt.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "list")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = dealt.join(F.broadcast(blocks), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), every("query_blocks").alias("query_block"),
        "vec_id", "v")
    questions = asked.join(F.broadcast(blocks), "list").select(
        "list", every("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"),
        "query_id", "v", "bound")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            x, ids, q = _matrix(left["v"].tolist()), left["vec_id"].to_numpy(), _matrix(right["v"].tolist())
            turned, asks = _unit(x) @ turn, _unit(q) @ turn
            for i, (query_id, bound) in enumerate(zip(right["query_id"].tolist(), right["bound"].tolist())):
                out += [(query_id, vec_id, score)
                        for score, vec_id in scan(turned, x, ids, asks[i], q[i], query_id, k, bound)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["list", "block", "query_block"]
    found = base.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
