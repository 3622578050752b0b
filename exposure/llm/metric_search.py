"""Exact top-k by inner product with an M-tree of paged nodes.

Vectors become integers floor(scale * x).  An inner product is turned into a distance by one more
coordinate, sqrt(M^2 - |x|^2) for rows and 0 for queries, where M is the longest row: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so near means a high score and the triangle inequality holds.

* Index.  Rows go to the nearest of up to ``PIVOTS`` pivots (a bounded sample by hash of their
  id), then to pages of at most ``PAGE`` rows, so a vector with very many copies fills pages, not a
  task.  A page is a routing node: pivot, covering radius, and its rows with their distances to the
  pivot, sorted.  Pages are written to the shared folder; every row is indexed.
* Search.  Queries come in blocks.  Each block meets every bucket of pages.  Within a bucket a
  query opens pages best-first by the bound d(q, pivot) - radius, and in a page it computes only
  rows with |d(q, pivot) - d(row, pivot)| within its current k-th distance.  A page whose bound
  exceeds that is never opened.  The k best of each bucket are merged per query.

Bounds are floating with a margin; scores are exact integers: components beyond 2^20, where
doubles might round, are multiplied as 64-bit integers.  Ties go to the smaller id.

Vectors that are NULL, empty or hold NULL or non-finite components take no part, nor do rows
without an id or of another length than most.  Repeated rows are candidates each, but a query never
returns rows of its own id.  Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.shared import stored

PIVOTS, PAGE, BUCKET_PAGES, BLOCK = 64, 512, 32, 1024
_PAGES = "bucket long, ids binary, rows binary, away binary, pivot binary, radius double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that makes all of them equally long."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _away(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x`` to rows of ``p``."""
    square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(square, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 1 << 20:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with integer components, of rows that take part."""
    x = F.col(vector_col)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.filter(whole & F.col(id_col).isNotNull())
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    lengths = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out if lengths is None else out.filter(F.size("v") == lengths["n"])


def build_index(rows: DataFrame, top: float) -> tuple[DataFrame, int]:
    """Pages of the M-tree, written to the shared folder, and the number of their buckets."""
    sample = rows.orderBy(F.xxhash64("id"), "v").limit(PIVOTS).select("v").toPandas()
    lifted = np.unique(_lifted(np.array(sample["v"].tolist(), np.int64), top), axis=0)

    def route(batches):
        for batch in batches:
            nearest = _away(_lifted(_matrix(batch["v"]), top), lifted).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(nearest)], names=["id", "v", "pivot"])

    routed = stored(rows.mapInArrow(route, "id long, v array<long>, pivot long"))
    counts = routed.groupBy("pivot").count()  # one row per pivot
    pages = routed.join(F.broadcast(counts), "pivot").withColumn(
        "page", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") * 1.25 / PAGE).cast("int"))
    )
    n_pages = counts.select(F.sum(F.ceil(F.col("count") * 1.25 / PAGE))).first()[0]
    buckets = max(1, math.ceil(n_pages / BUCKET_PAGES))

    def node(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _matrix(table["v"])
        pivot = lifted[table["pivot"][0].as_py()]
        away = _away(_lifted(x, top), pivot[None, :])[:, 0]
        order = np.argsort(away, kind="stable")
        bucket = (hash((table["pivot"][0].as_py(), table["page"][0].as_py())) & 0x7FFFFFFF) % buckets
        return pa.table({
            "bucket": pa.array([bucket], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "rows": pa.array([x[order].tobytes()], pa.binary()), "away": pa.array([away[order].tobytes()], pa.binary()),
            "pivot": pa.array([pivot.tobytes()], pa.binary()), "radius": [float(away.max())],
        })

    return stored(pages.select("id", "v", "pivot", "page").groupBy("pivot", "page").applyInArrow(node, _PAGES)), buckets


def best_of(q: np.ndarray, own: int, k: int, top: float, pages: list[tuple]) -> list[tuple[int, int]]:
    """``(score, id)`` of the k best rows of these pages, opened best-first."""
    lifted = np.concatenate([q.astype(np.float64), [0.0]])
    length = float((lifted * lifted).sum())
    pivots = np.stack([p[3] for p in pages])
    to_pivot = _away(lifted[None, :], pivots)[0]
    bound = np.maximum(to_pivot - np.array([p[4] for p in pages]), 0)
    margin = 1e-6 * (math.sqrt(length) + math.sqrt(top) + 1)
    best_score, best_id = np.empty(0, np.int64), np.empty(0, np.int64)
    reach = math.inf
    for at in np.argsort(bound, kind="stable"):
        if bound[at] > reach + margin:
            break
        ids, x, away, _, _ = pages[at]
        low = np.searchsorted(away, to_pivot[at] - reach - margin, "left") if reach < math.inf else 0
        high = np.searchsorted(away, to_pivot[at] + reach + margin, "right") if reach < math.inf else len(away)
        some = np.flatnonzero(ids[low:high] != own) + low
        best_score = np.concatenate([best_score, _scores(q, x[some])])
        best_id = np.concatenate([best_id, ids[some]])
        order = np.lexsort((best_id, -best_score))[:k]
        best_score, best_id = best_score[order], best_id[order]
        if len(order) == k:
            reach = math.sqrt(max(length + top - 2 * float(best_score[-1]), 0.0))
    return list(zip(best_score.tolist(), best_id.tolist()))


def top_k(
    table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the k best other rows."""
    spark = table.sparkSession
    out = "query_id long, vec_id long, score long"
    rows = stored(vectors(table, id_col, vector_col, scale))
    top = rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)).alias("m")).first()["m"]
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pages, buckets = build_index(rows, top)
    asked = rows.join(table.filter(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = asked.dropDuplicates(["id", "v"])
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).select("id", "v", "block", every(buckets).alias("bucket"))
    nodes = pages.select("*", every(blocks).alias("block"))

    def search(own: pa.Table, tree: pa.Table) -> pa.Table:
        dims = len(own["v"][0]) if own.num_rows else 0
        opened = [
            (np.frombuffer(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, dims), np.frombuffer(a, np.float64), np.frombuffer(p, np.float64), r)
            for i, x, a, p, r in zip(*(tree[c].to_pylist() for c in ("ids", "rows", "away", "pivot", "radius")))
        ] if dims else []
        found = []
        if opened:
            for name, q in zip(own["id"].to_pylist(), _matrix(own["v"])):
                found += [(name, v, s) for s, v in best_of(q, name, k, top, opened)]
        got = np.array(found, np.int64).reshape(-1, 3)
        return pa.table({"query_id": got[:, 0], "vec_id": got[:, 1], "score": got[:, 2]})

    part = queries.groupBy("bucket", "block").cogroup(nodes.groupBy("bucket", "block")).applyInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
