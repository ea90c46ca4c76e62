"""Centroid clustering with Hamerly's bounds, in whole numbers.

Each vector is a row of a state table with its cluster, an upper bound of the distance to its own centroid and a lower
bound of that to any other. A round moves the centroids, loosens the bounds by how far they drifted, and settles a vector
without a scan where the bounds, or its exact distance and half the way to the nearest other centroid, show that
its own centroid is strictly nearest. The others are held against all centroids by exact squared distances, so results
and ties don't depend on the bounds. The state is written each round in the partitions that it was read in: no shuffle, and a
lost executor costs a part of one round. Sums are kept up by the vectors that moved; tasks add theirs up before Spark does.
The driver holds k centroids of one length and their sums, at every size of the input.

Defined results: a vector takes part if it has the wanted number of components, none of them null, NaN or infinite; whole
components beyond +-2**27 count as that, so that squared distances stay below 2**63. Starts are the rows with the smallest hashes of
their ids, ties by components; a null id is never a start, and gets a cluster. Repeated rows count each. With fewer rows than k there are
as many centroids as rows, without rows there is no result. An inertia beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, lean, table

#: Components are held to this, so that d * (2 * MOST)**2 fits a long for d up to 128.
MOST = 2**27
#: Bounds are widened by this share, which is far above the rounding of doubles.
SLACK = 1e-9
STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double, scans int"


def whole_vectors(vectors: DataFrame, d: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q): floor(scale * x) of the vectors that take part."""
    fine = (F.size(vector_col) == d) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x.cast("double") * scale))))).cast("int")
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, held).alias("q"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids: by a matrix product where doubles hold them, else in whole numbers."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * int(top) ** 2 * c.shape[1] < 2**52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([own_square(x, row[None, :]) for row in c], axis=1)


def own_square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x.astype(np.int64) - c
    return (gap * gap).sum(axis=1)


class Step:
    """One round's centroids with how far each came, and half its way to the nearest other one."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        moved = np.zeros(k) if before is None else np.sqrt(own_square(centroids, before).astype(np.float64)) * (1 + SLACK)
        order = np.argsort(-moved, kind="stable")
        self.own = moved
        # for a vector, the farthest that any centroid but its own has moved
        self.others = np.full(k, moved[order[0]])
        self.others[order[0]] = moved[order[1]] if k > 1 else 0.0
        apart = squares(centroids, centroids).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1)) / 2 * (1 - SLACK)

    def settle(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower, scanned) after the centroids' move; cluster -1 for rows that have none yet."""
        cluster, scanned = cluster.copy(), cluster < 0
        at = np.maximum(cluster, 0)
        upper, lower = upper + self.own[at], np.maximum(lower - self.others[at], 0.0)
        safe = np.maximum(lower, self.half[at])
        near = np.nonzero(scanned | (upper >= safe))[0]
        tight = near[cluster[near] >= 0]
        upper[tight] = np.sqrt(own_square(x[tight], self.centroids[cluster[tight]]).astype(np.float64)) * (1 + SLACK)
        scanned[tight] = upper[tight] >= safe[tight]
        full = np.nonzero(scanned)[0]
        if len(full):
            all_of = squares(x[full], self.centroids)
            best = all_of.argmin(axis=1)
            rows = np.arange(len(full))
            upper[full] = np.sqrt(all_of[rows, best].astype(np.float64)) * (1 + SLACK)
            all_of[rows, best] = np.iinfo(np.int64).max
            lower[full] = np.sqrt(all_of.min(axis=1).astype(np.float64)) * (1 - SLACK) if all_of.shape[1] > 1 else np.inf
            cluster[full] = best
        return cluster, upper, lower, scanned


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(len(column), d)


def start_state(whole: DataFrame) -> DataFrame:
    """The state before the first round: packed vectors without a cluster."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            packed = [np.asarray(q, dtype="<i4").tobytes() for q in batch["q"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": packed, "cluster": np.full(n, -1), "was": np.full(n, -1), "upper": np.zeros(n), "lower": np.zeros(n), "scans": np.zeros(n, dtype=int)})

    return whole.mapInPandas(lean(work), STATE)


def assigned(state: DataFrame, step: Step, d: int) -> DataFrame:
    """The state after a round's assignment; `was` is the cluster before, `scans` counts full scans."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, upper, lower, scanned = step.settle(_matrix(batch["v"], d), batch["cluster"].to_numpy(), batch["upper"].to_numpy(), batch["lower"].to_numpy())
            yield batch.assign(was=batch["cluster"], cluster=cluster, upper=upper, lower=lower, scans=batch["scans"].to_numpy() + scanned)

    return state.mapInPandas(lean(work), STATE)


def moved_sums(state: DataFrame, d: int) -> DataFrame:
    """(cluster, at, total): what a round's moves add to each cluster's sums; at -1 is the count. At most k * (d + 1) rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            wide = np.hstack([np.ones((len(batch), 1), dtype=np.int64), _matrix(batch["v"], d)])
            for column, sign in (("cluster", 1), ("was", -1)):
                label = batch[column].to_numpy()
                for k in np.unique(label[label >= 0]):
                    sums[int(k)] = sums.get(int(k), 0) + sign * wide[label == k].sum(axis=0)
        if sums:
            yield pd.DataFrame({"cluster": np.repeat(list(sums), d + 1), "at": np.tile(np.arange(-1, d), len(sums)), "part": np.concatenate(list(sums.values()))})

    moved = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was")
    return moved.mapInPandas(work, "cluster int, at int, part long").groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def starts(whole: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, d: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(state, centroids) after these rounds and a last assignment. The state is a table in the shared folder."""
    whole = whole_vectors(vectors, d, scale, id_col, vector_col)
    centroids = starts(whole, k, seed)
    if not len(centroids):
        return start_state(whole.where(F.lit(False))), centroids
    state = cut(start_state(whole), "vectors")
    step = Step(centroids)
    sums = np.zeros((len(centroids), d + 1), dtype=object)
    for left in range(rounds, -1, -1):
        last, state = state, cut(assigned(state, step, d), "state")
        delete(state.sparkSession, last.cut_path)
        if not left:
            break
        for r in moved_sums(state, d).collect():
            sums[r.cluster, r.at + 1] += int(r.total)
        new = np.array([[int(x) // int(row[0]) for x in row[1:]] if row[0] else list(old) for row, old in zip(sums, centroids, strict=True)], dtype=np.int64)
        step, centroids = Step(new, centroids), new
    return state, centroids


def with_distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): exact squared distances to the vectors' own centroids."""
    d = centroids.shape[1] if len(centroids) else 0

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            label = batch["cluster"].to_numpy()
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": label, "distance": own_square(_matrix(batch["v"], d), centroids[label])})

    return state.select("vec_id", "v", "cluster").mapInPandas(work, "vec_id long, cluster int, distance long")


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    state, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    rows = with_distances(state, centroids)
    per_cluster = cut(rows.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia")), "inertia")  # at most k rows
    whole = per_cluster.agg(F.expr("try_sum(cluster_inertia)").alias("n"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    known = per_cluster.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", whole.scalar().alias("inertia"), "centroid_sha256")


def _rounds_sql(k: int, rounds: int) -> str:
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, arg_min(n, (d, n)) AS cluster, min(d) AS distance
  FROM (SELECT p.rid, c.n, CAST(list_sum(list_transform(range(1, 65), lambda i: (p.q[i] - c.q[i]) * (p.q[i] - c.q[i]))) AS BIGINT) AS d FROM p, c{i} c) GROUP BY rid
)""")
        if i < rounds:
            parts.append(f"""s{i} AS MATERIALIZED (
  SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM p JOIN a{i} USING (rid)) GROUP BY cluster, pos
), c{i + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY pos) AS q FROM s{i} GROUP BY cluster) m ON m.cluster = c.n
)""")
    return ",\n".join(parts)


OP11_SQL = f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS INTEGER) AS n, q FROM p WHERE vec_id IS NOT NULL QUALIFY n < 40),
{_rounds_sql(40, 5)},
e AS (SELECT vec_id, a5.cluster, a5.distance FROM a5 JOIN p USING (rid))
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.q, ',')) AS centroid_sha256 FROM e JOIN c5 ON c5.n = e.cluster
"""
