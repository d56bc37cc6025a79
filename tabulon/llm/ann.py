"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Every vector belongs to the list of its nearest centroid; centroids come from a bounded sample. A
query is compared with the lists whose centroids are nearest: with the nearest first, whose k-th distance
is the bar that candidates of the others must beat. In a list, vectors and query are rotated by
one random orthogonal matrix and stored by blocks of columns; after each block a candidate is dropped
if its partial distance, scaled up to all dimensions, exceeds the bar by more than a hypothesis test allows.
Survivors are measured exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

SAMPLE = 20_000
MOST_LISTS = 1_024
PROBED = 0.55
BLOCK = 16
EPSILON = 2.1
CHUNK = 4_096
QUERY_CHUNK = 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of vectors that aren't null, empty or zero and have only finite components."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", v.alias("v"))


def _centroids(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty cell keeps its centre."""
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def scan(rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, query: np.ndarray, q_turned: np.ndarray, own: int, k: int, epsilon: float, block: int, bar: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of *rows* to *query*, no farther than *bar*: (ids, distances), by the adaptive scan over *turned* columns."""
    at, exact = _scan(rows, turned, ids, query, q_turned, own, k, epsilon, block, bar)
    return ids[at], exact


def _scan(rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, query: np.ndarray, q_turned: np.ndarray, own: int, k: int, epsilon: float, block: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
    dims = turned.shape[1]
    alive = np.flatnonzero(ids != own)
    if len(alive) == 0:
        return alive, np.zeros(0)
    part, most, done = np.zeros(len(alive)), bar * (1 + 1e-9), 0
    bar = bar * bar  # distances are compared squared
    while done < dims and (len(alive) > k or bar < np.inf and len(alive)):
        step = slice(done, min(dims, done + block))
        diff = turned[alive, step] - q_turned[step]
        part += np.einsum("ij,ij->i", diff, diff)
        done = step.stop
        if bar == np.inf and len(alive) > k:  # the k closest by the first columns give a distance to beat
            lead = alive[np.argpartition(part, k - 1)[:k]]
            diff = turned[lead] - q_turned
            bar = np.einsum("ij,ij->i", diff, diff).max()
        keep = part * (dims / done) <= bar * (1 + epsilon / np.sqrt(done)) ** 2 if done < dims else part <= bar * (1 + 1e-9)
        alive, part = alive[keep], part[keep]
    diff = rows[alive] - query
    exact = np.sqrt((diff * diff).sum(axis=1))
    order = np.lexsort((ids[alive], exact))[:k]
    order = order[exact[order] <= most]
    return alive[order], exact[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, probed: float = PROBED, epsilon: float = EPSILON, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among all *vectors* but itself.

    *vectors* and *queries*: vec_id, embedding. Unusable vectors take no part; repeated ids are repeated
    candidates, repeated queries are asked once, and a query id with several vectors gets the candidates
    nearest to any of them, each row once. Vectors are compared with those of their own length: the most
    frequent length has fitted lists, any other is one list that is scanned whole. Lists and rotation are fitted on at most about *sample* rows (by hash of the id) and
    bounded by MOST_LISTS x dimensions. Lists are cut into chunks of about CHUNK rows, and their queries
    into chunks too, so no task holds a whole list, however large. Fewer candidates than k give fewer rows.
    """
    every = cut(usable(vectors).withColumn("n", F.size("v")))
    total = every.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], out)
    dims = every.groupBy("n").count().orderBy(F.desc("count"), "n").first()["n"]
    others = every.where(F.col("n") != dims).select("vec_id", "v", (-F.col("n")).alias("list"))
    every = every.where(F.col("n") == dims).drop("n")
    share = int(min(1.0, sample / total) * 1_000_000)
    fit = np.array([r.v for r in every.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).orderBy("vec_id").select("v").limit(2 * sample).collect()]).reshape(-1, dims)
    if len(fit) == 0:
        fit = np.array([r.v for r in every.orderBy("vec_id").limit(1_000).collect()])
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(MOST_LISTS, len(fit) // 20, total**0.5)))
    shared = vectors.sparkSession.sparkContext.broadcast((_centroids(fit, lists, rng), np.linalg.qr(rng.normal(size=(dims, dims)))[0]))
    probes = max(1, min(lists, int(np.ceil(probed * lists)))) if lists > 4 else lists

    def to_lists(n: int):
        def nearest(batches):
            import pyarrow as pa

            c = shared.value[0]
            half = 0.5 * (c * c).sum(axis=1)
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                close = x @ c.T - half
                near = np.argsort(-close, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))], ["vec_id", "v", "near"])

        return nearest

    placed = "vec_id long, v array<double>, near array<int>"
    stored = cut(every.mapInArrow(to_lists(1), placed).select("vec_id", "v", F.element_at("near", 1).alias("list")).unionAll(others))
    sizes = {r.list: r["count"] for r in stored.groupBy("list").count().collect()}  # at most MOST_LISTS and a row for each other length
    asked = usable(queries).distinct()
    odd = asked.where(F.size("v") != dims).select("vec_id", "v", F.array(-F.size("v")).alias("near"))
    asked = cut(asked.where(F.size("v") == dims).mapInArrow(to_lists(probes), placed).unionAll(odd))
    cuts = F.create_map(*[x for k_, n in sizes.items() for x in (F.lit(k_), F.lit(-(-n // CHUNK)))])

    def scanned(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            rows, ids = np.stack(c["v"].to_numpy()), c["vec_id"].to_numpy()
            turn = shared.value[1] if rows.shape[1] == dims else np.eye(rows.shape[1])
            turned, asks = rows @ turn, np.stack(q["v"].to_numpy())
            nearest: dict[int, dict[int, float]] = {}
            for one, bar, x, y in zip(q["vec_id"].tolist(), q["bar"].tolist(), asks, asks @ turn):
                best = nearest.setdefault(one, {})
                for at, score in zip(*(z.tolist() for z in _scan(rows, turned, ids, x, y, one, k, epsilon, BLOCK, bar))):
                    best[at] = min(score, best.get(at, np.inf))
            for one, best in nearest.items():
                found += [(one, int(ids[at]), score) for at, score in sorted(best.items(), key=lambda z: (z[1], ids[z[0]]))[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def compared(probes: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the k nearest in each chunk of the lists of *probes* (vec_id, v, bar, list)."""
        wanted = {r.list: r["count"] for r in probes.groupBy("list").count().collect()}
        q_cuts = F.create_map(*[x for k_ in sizes for x in (F.lit(k_), F.lit(max(1, -(-wanted.get(k_, 0) // QUERY_CHUNK))))])
        right = stored.where(F.col("list").isin([x for x in sizes if x in wanted])).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), cuts[F.col("list")]).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), (q_cuts[F.col("list")] - 1).cast("int"))))
        left = probes.where(F.col("list").isin(list(sizes))).withColumn("part", F.pmod(F.xxhash64("vec_id"), q_cuts[F.col("list")]).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), (cuts[F.col("list")] - 1).cast("int"))))
        keys = ["list", "chunk", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scanned, "query_id long, vec_id long, score double")

    infinite = F.lit(float("inf"))
    first = cut(compared(asked.select("vec_id", "v", infinite.alias("bar"), F.element_at("near", 1).alias("list"))))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    bars = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar"))
    further = asked.join(bars, "vec_id", "left").select("vec_id", "v", F.coalesce("bar", infinite).alias("bar"), F.explode(F.slice("near", 2, probes)).alias("list"))
    best = first.unionAll(compared(cut(further)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
