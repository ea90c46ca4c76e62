"""Exact top-k search by tiled matrix products.

Queries are dealt to groups of a bounded size and candidates to shards, both packed into blocks of vectors. Each pair of a
group and a shard is one cell of a grid: Spark shuffles the blocks to their cells, and a task holds one group's
queries while the shard's blocks pass by. Each tile, a block of queries times one of candidates, is a matrix product of which
partial selection keeps the k best of each query. The cells' lists are merged as a tree, FAN lists at a time.
Scores are integers, so results are exact and do not depend on the order of work. Nothing passes through the driver but counts.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part;
ties go to the smaller id; a repeated id counts once, with its best score; vectors of another
length than the query's are not compared; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, table, width

#: Vectors in a block; a tile's scores are 32 MB.
BLOCK = 2048
#: Queries in a group, at most about; with 64 components 256 MB.
GROUP = 256 * BLOCK
#: Candidates in a shard, at most about; there are as many shards as tasks, if that is more.
SHARD = 1 << 20
#: Lists merged at once.
FAN = 16


def quantise(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as doubles (exact below 2**53)."""
    return np.floor(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) * scale)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: by BLAS where doubles are exact, else in int64, else in Python's integers (held at the ends of int64)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2.0**52:
        return (q @ c.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in c], dtype=object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a tile for each query as (query row, id, score). Ids are ascending, so the first maximum is the tie's winner."""
    scores = products(q, c)
    least = np.iinfo(np.int64).min
    own = np.searchsorted(ids, q_ids)
    hit = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids)
    scores[np.nonzero(hit)[0], own[hit]] = least
    rows = np.arange(len(q_ids))
    found = []
    for _ in range(min(k, len(ids))):
        at = scores.argmax(axis=1)
        value = scores[rows, at]
        ok = value != least
        found.append((rows[ok], ids[at[ok]], value[ok]))
        scores[rows, at] = least
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (rows[:0], ids[:0], scores[:0, 0])


def keep_best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query row, each id once."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    pair = np.lexsort((np.arange(len(row)), ids, row))
    again = np.zeros(len(row), dtype=bool)
    again[pair[1:]] = (row[pair[1:]] == row[pair[:-1]]) & (ids[pair[1:]] == ids[pair[:-1]])
    row, ids, score = row[~again], ids[~again], score[~again]
    starts = np.searchsorted(row, row)
    top = np.arange(len(row)) - starts < k
    return row[top], ids[top], score[top]


def packed(rows: DataFrame, scale: int) -> DataFrame:
    """(d, ids, data): blocks of up to BLOCK vectors of one length, their ids ascending."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, same in batch.groupby(batch["v"].map(len)):
                for at in range(0, len(same), BLOCK):
                    some = same.iloc[at : at + BLOCK].sort_values("id", kind="stable")
                    yield pd.DataFrame({"d": [d], "ids": [some["id"].to_numpy(dtype="<i8").tobytes()], "data": [quantise(some["v"], scale).tobytes()]})

    return rows.mapInPandas(lean(work), "d int, ids binary, data binary")


def _unpacked(d: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(data).reshape(-1, d)


def search_cells(cells: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, shard): the k best of each query in each cell. cells: (grp, shard, side, d, ids, data), side 0 the queries."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, queries, held = None, [], []

        def lists() -> Iterator[pd.DataFrame]:
            for (_, ids, _), best in zip(queries, held, strict=True):
                if best:
                    yield pd.DataFrame({"query_id": ids[best[0]], "vec_id": best[1], "score": best[2], "shard": cell[1]})

        for batch in batches:
            for row in batch.itertuples():
                if cell != (row.grp, row.shard):
                    yield from lists()
                    cell, queries, held = (row.grp, row.shard), [], []
                ids, vectors = _unpacked(row.d, row.ids, row.data)
                if row.side == 0:
                    queries.append((row.d, ids, vectors))
                    held.append(None)
                    continue
                # a repeated id: one matrix of its first rows, the others apart
                first = np.append(True, np.diff(ids) != 0)
                parts = [(ids[first], vectors[first])] + [(ids[i : i + 1], vectors[i : i + 1]) for i in np.nonzero(~first)[0]]
                for q, (d, ids_q, block) in enumerate(queries):
                    for i, v in parts if d == row.d else []:
                        new = best_of_tile(ids_q, block, i, v, k)
                        held[q] = keep_best(*(np.concatenate(x) for x in zip(held[q], new, strict=True)), k) if held[q] else keep_best(*new, k)
        yield from lists()

    return cells.mapInPandas(lean(work), "query_id long, vec_id long, score long, shard int")


def merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the shards' lists, FAN of them at a time."""
    while True:
        shards = -(-shards // FAN)
        once = lists.groupBy("query_id", F.floor(F.col("shard") / FAN).cast("int").alias("shard"), "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def grid(n: int, n_asked: int, tasks: int, group: int, shard: int) -> tuple[int, int]:
    """(groups, shards) for so many candidates and queries.

    Each query goes to all shards and each candidate to all groups. With as few cells as the bounds and the tasks allow, the
    two shares of the shuffle are alike where groups and shards are in proportion to queries and candidates.
    """
    low, least = max(1, -(-n_asked // group)), max(1, -(-n // shard))
    cells = max(tasks, low * least)
    groups = max(low, round((cells * n_asked / max(1, n)) ** 0.5))
    return groups, max(least, -(-cells // groups))


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, scale: int = 256, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row where `is_query` holds.

    `group` bounds the queries that a task holds, about; `shard` the candidates that it goes through.
    """
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull()).where(fine)
    rows = usable.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = usable.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    n, n_asked = usable.agg(F.count("*"), F.count_if(is_query)).first()
    tasks = width(vectors.sparkSession)
    n_groups, n_shards = grid(n, n_asked, tasks, group, shard)
    # queries by a hash of their ids, so that a block's rows are whole in one task; candidates block by block, in turn
    blocks = packed(asked.repartition(n_groups, F.xxhash64("id")), scale).select(F.pmod(F.spark_partition_id(), F.lit(n_groups)).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(0).alias("side"), "d", "ids", "data")
    tiles = packed(rows, scale).select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"), F.pmod(F.xxhash64("ids"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(1).alias("side"), "d", "ids", "data")
    cells = blocks.unionAll(tiles).repartition(tasks, "grp", "shard").sortWithinPartitions("grp", "shard", "side")
    return merged(search_cells(cells, k), n_shards, k)


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
