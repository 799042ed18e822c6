"""Exact top-k inner products by ball-tree branch and bound, one tree for each shard.

Rows are dealt to shards of a bounded size and each shard becomes a ball tree (centre and radius of each node). Queries go in bounded blocks. In a shard,
nodes are visited best first: by falling upper bound (centre product plus norm times radius), the largest that any query of the block which still needs
the node has; a node whose bound is below a query's kth score is not opened for it. Shards are searched in waves of 1, 3, 12, 48, ... shards. What all
shards of the waves before have found, merged, gives each query the kth score that the next wave starts from. A shard's rows are sent once: blocks of
queries come to the task that holds its tree, one after the other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_first, lean, materialize

LEAF = 128
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
#: After the first wave each one makes the shards that are done so many times as many.
GROWTH = 4


def ball_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """(row order, nodes as (from, to, left child, right child), centres, radii); leaves have child -1."""
    order = np.arange(len(vectors))
    nodes, centres, radii = [], [], []

    def grow(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        c = own.mean(0)
        me = len(nodes)
        nodes.append((a, b, -1, -1))
        centres.append(c)
        radii.append(float(np.sqrt(((own - c) ** 2).sum(1).max())))
        if b - a > leaf and radii[me] > 0:
            far = own[np.argmax(((own - c) ** 2).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (far - other), mid)]
            nodes[me] = (a, b, grow(a, a + mid), grow(a + mid, b))
        return me

    if len(vectors):
        grow(0, len(vectors))
    return order, nodes, np.array(centres).reshape(len(nodes), -1), np.array(radii)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, tree=None, opened: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query row, id, score) of each query in one shard, without those below its floor; ties to the smaller id. Visited nodes go to opened."""
    order, nodes, centres, radii = tree or ball_tree(vectors)
    best_s = np.full((len(queries), k), -np.inf)
    best_i = np.full((len(queries), k), np.iinfo(np.int64).max)
    if nodes and len(queries):
        norms = np.sqrt((queries**2).sum(1))
        slack = 1e-9 * (1 + norms * float(np.abs(centres).max(initial=0) + radii.max()) * max(1, queries.shape[1]))
        bounds = queries @ centres.T + norms[:, None] * radii + slack[:, None]
        kth = floor.astype(float).copy()
        heap = [(-float(bounds[:, 0].max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            rows = np.flatnonzero(bounds[:, node] >= kth)
            if not len(rows):
                continue
            if opened is not None:
                opened.append(node)
            a, b, left, right = nodes[node]
            if left >= 0:
                for child in (left, right):
                    # a child is needed by no query that its parent was not needed by
                    bounds[:, child] = np.minimum(bounds[:, child], bounds[:, node])
                    heapq.heappush(heap, (-float(bounds[rows, child].max()), child))
                continue
            at = order[a:b]
            s = queries[rows] @ vectors[at].T
            i = np.broadcast_to(ids[at], s.shape)
            s[(i == query_ids[rows][:, None]) | (s < kth[rows][:, None])] = -np.inf
            rows, s, i = rows[(hit := np.isfinite(s).any(1))], s[hit], i[hit]
            s, i = np.concatenate([best_s[rows], s], 1), np.concatenate([best_i[rows], i], 1)
            cut = np.partition(s, -k, 1)[:, -k]
            keep = s >= cut[:, None]
            for n, r in enumerate(rows):
                p = np.flatnonzero(keep[n])
                p = p[np.lexsort((i[n, p], -s[n, p]))[:k]]
                best_s[r], best_i[r] = s[n, p], i[n, p]
            kth[rows] = np.maximum(kth[rows], best_s[rows, -1])
    q, j = np.nonzero(np.isfinite(best_s))
    return q, best_i[q, j], best_s[q, j]


def _pack(df: DataFrame, key: str) -> DataFrame:
    """One row for each group: ids (int64) and vectors (float64) as bytes. Groups have a bounded number of rows."""

    def run(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        ids = table.column("id").to_numpy().astype(np.int64)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), len(v[0]))
        o = np.argsort(ids, kind="stable")
        return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.int32()), "ids": [ids[o].tobytes()], "vectors": [flat[o].tobytes()]})

    return df.select(key, "id", "v").groupBy(key).applyInArrow(run, f"{key} int, ids binary, vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products.

    Both tables have id (long) and v (array<double> of whole numbers, all of one length, no nulls); more columns are left out. A query's own id is
    no candidate; ties go to the smaller id; with fewer than k candidates all are returned, from an empty table none. Repeated ids in vectors count as
    rows of their own; a repeated query id asks once, with its smallest vector. Scores are exact while sums stay below 2^53.
    """
    vectors = vectors.select("id", "v")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))
    data = materialize(_pack(vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "shard"), "topk-shards")
    block_of = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(blocks)).cast("int")
    asks = materialize(_pack(queries.withColumn("block", block_of("id")), "block"), "topk-blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ids = x = None
        for rows in by_first(batches):
            for row in (r for batch in rows for r in batch.to_pylist()):
                own = np.frombuffer(row["ids"], np.int64)
                v = np.frombuffer(row["vectors"])
                v = v.reshape(len(own), len(v) // len(own))
                if row["block"] < 0:  # the shard itself comes before the blocks
                    ids, x, tree, shard = own, v, ball_tree(v), row["shard"]
                    continue
                if tree is None or shard != row["shard"]:
                    continue  # no row was dealt to this shard
                floor = np.full(len(own), -np.inf)
                if row["floor_ids"]:
                    floor[np.searchsorted(own, row["floor_ids"])] = row["floor"]
                n, i, s = search(ids, x, own, v, floor, k, tree)
                yield pa.RecordBatch.from_arrays([pa.array(own[n]), pa.array(i), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    first_k = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    done = 0
    while done < shards:
        upto = min(shards, max(1, done * GROWTH))
        floors = None
        if best is not None:
            full = best.groupBy("query_id").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
            floors = full.groupBy(block_of("query_id").alias("block")).agg(F.collect_list("query_id").alias("floor_ids"), F.collect_list("s").alias("floor"))
        held = asks.join(floors, "block", "left") if floors is not None else asks.withColumns({"floor_ids": F.lit(None).cast("array<bigint>"), "floor": F.lit(None).cast("array<double>")})
        columns = ["shard", "block", "ids", "vectors", "floor_ids", "floor"]
        sent = held.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1)))).select(*columns)
        own = data.where((F.col("shard") >= done) & (F.col("shard") < upto)).withColumns({"block": F.lit(-1), "floor_ids": F.lit(None).cast("array<bigint>"), "floor": F.lit(None).cast("array<double>")})
        meeting = own.select(*columns).unionByName(sent).repartition(min(parts, upto - done), "shard").sortWithinPartitions("shard", "block")
        found = meeting.mapInArrow(run, "query_id long, vec_id long, score long")
        best = (found if best is None else best.drop("rank").unionByName(found)).withColumn("rank", F.row_number().over(first_k)).where(F.col("rank") <= k)
        done = upto
        if done < shards:
            best = materialize(best, "topk-best")
    return best.select("query_id", "rank", "vec_id", "score")


def quantised(table: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """id and v = floor(scale * x); rows with a null id or vector, or a null or non-finite component, take no part.

    Vectors of different lengths have no inner product: they raise ValueError. Repeated rows stay; an empty table gives no rows.
    """
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    rows = table.where(F.col(id_col).isNotNull() & whole)
    ends = rows.agg(F.min(F.size(x)).alias("least"), F.max(F.size(x)).alias("most")).first()
    if ends["least"] != ends["most"]:
        raise ValueError(f"vectors of {ends['least']} to {ends['most']} components: all must have the same number")
    # to double and back keeps whole numbers beyond the long range as they are
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))
