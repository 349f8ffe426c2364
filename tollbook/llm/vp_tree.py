"""Nearest neighbours from vantage-point trees, one to a shard of vectors.

A node splits its vectors at the median distance to a vantage point and keeps the range of distances
on either side, so the triangle inequality bounds what a side can hold. A side is passed over when
its bound, times ``relax``, exceeds the worst neighbour found; ``relax`` 1 is exact search. Blocks of
queries go through a tree together, and the shards' neighbours are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollbook.llm.common import map_arrow, rename_free, session_of, written

SHARD_VECTORS = 4_096
BLOCK_QUERIES = 1_024
LEAF_VECTORS = 64
RELAX = 1.0
# vantage, lower and upper distance inside, lower and upper outside, left and right child; a leaf
# has vantage -1 and the bounds of its rows instead of children.
NODE = np.dtype(
    [("vantage", "<i4"), ("in_low", "<f8"), ("in_high", "<f8"), ("out_low", "<f8"), ("out_high", "<f8"), ("left", "<i4"), ("right", "<i4")]
)
INDEX = "dim int, shard long, ids binary, begin binary, vectors binary, nodes binary"
FOUND = "query_id long, vec_id long, score double"


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to those of ``y``, from differences in double."""
    out = np.empty((len(x), len(y)))
    step = max(1, 1_000_000 // max(1, y.size))
    for start in range(0, len(x), step):
        apart = x[start : start + step, None, :] - y[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
    return out


class Tree:
    """Distinct vectors in leaf order, the ids of each (ascending), and the nodes."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, vectors: np.ndarray, nodes: np.ndarray):
        self.ids, self.begin, self.vectors, self.nodes = ids, begin, vectors, nodes

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        start = np.r_[np.flatnonzero(new), len(ids)]
        points, rng = vectors[new], np.random.default_rng(0)
        nodes: list[tuple] = [(-1, 0, 0, 0, 0, 0, len(points))]
        perm, todo = np.arange(len(points)), [(0, 0, len(points))]
        while todo:
            node, low, high = todo.pop()
            if high - low <= LEAF_VECTORS:
                continue
            own = perm[low:high]
            # The point farthest from a random one has the widest range of distances.
            vantage = own[distances(points[rng.choice(own)][None], points[own])[0].argmax()]
            far = distances(points[vantage][None], points[own])[0]
            middle = np.partition(far, (high - low) // 2)[(high - low) // 2]
            inside = far < middle if (far < middle).any() else far <= middle
            if inside.all():
                continue
            perm[low:high] = np.r_[own[inside], own[~inside]]
            cut, left = low + int(inside.sum()), len(nodes)
            nodes[node] = (vantage, far[inside].min(), far[inside].max(), far[~inside].min(), far[~inside].max(), left, left + 1)
            nodes += [(-1, 0, 0, 0, 0, low, cut), (-1, 0, 0, 0, 0, cut, high)]
            todo += [(left, low, cut), (left + 1, cut, high)]
        flat, place = np.array(nodes, NODE), np.empty(len(perm), np.int64)
        place[perm] = np.arange(len(perm))
        split = flat["vantage"] >= 0
        flat["vantage"][split] = place[flat["vantage"][split]]
        counts = np.diff(start)[perm]
        begin = np.r_[0, np.cumsum(counts)]
        members = np.concatenate([ids[start[p] : start[p + 1]] for p in perm]) if len(perm) else ids
        return cls(members, begin, points[perm], flat)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of up to ``k`` neighbours of each query (infinite where there are fewer),
        other than the query's own id, and how many distances were taken."""
        score = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)
        taken = 0

        def leaf(node, active: np.ndarray) -> None:
            nonlocal taken
            low, high = int(node["left"]), int(node["right"])
            if low == high or not len(active):
                return
            far = distances(queries[active], self.vectors[low:high])
            taken += far.size
            # Of equal vectors only the first few ids can be among the neighbours.
            counts = np.minimum(np.diff(self.begin[low : high + 1]), k + 1)
            column = np.repeat(np.arange(high - low), counts)
            rank = np.arange(len(column)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids = self.ids[self.begin[low + column] + rank]
            some = (far <= score[active, -1][:, None]).any(1)
            active, far = active[some], far[some][:, column]
            if not len(active):
                return
            far[query_ids[active][:, None] == ids[None, :]] = np.inf
            scores = np.concatenate([score[active], far], 1)
            names = np.concatenate([found[active], np.broadcast_to(ids, far.shape)], 1)
            best = np.lexsort((names, scores), axis=1)[:, :k]
            score[active], found[active] = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)

        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            number, active, bound = todo.pop()
            node = self.nodes[number]
            # A little room, because bounds and scores are rounded.
            active = active[bound * relax <= score[active, -1] * (1 + 1e-9) + 1e-12]
            if not len(active):
                continue
            if node["vantage"] < 0:
                leaf(node, active)
                continue
            far = distances(queries[active], self.vectors[int(node["vantage"])][None])[:, 0]
            taken += len(far)
            inner = np.maximum(np.maximum(node["in_low"] - far, far - node["in_high"]), 0)
            outer = np.maximum(np.maximum(node["out_low"] - far, far - node["out_high"]), 0)
            sides = (int(node["left"]), inner), (int(node["right"]), outer)
            nearer_left = inner <= outer
            # Each query goes down its nearer side first; the last put on the stack is taken first.
            for queue, (near, away) in ((~nearer_left, sides[::-1]), (nearer_left, sides)):
                if queue.any():
                    todo.append((away[0], active[queue], away[1][queue]))
                    todo.append((near[0], active[queue], near[1][queue]))
        return score, found, taken


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    sound = "vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)"
    return (
        rename_free(vectors, {"vec_id": vec_id, "vector": embedding})
        .where(F.expr(sound))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("vector").alias("dim"), F.col("vector").cast("array<double>").alias("vector"))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) + 0.0


def build(valid: DataFrame) -> DataFrame:
    """The index: one row a shard with its tree, written to the shared folder."""
    shards = max(1, -(-valid.count() // SHARD_VECTORS))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.build(rows["vec_id"].to_numpy(np.int64), _matrix(rows["vector"]))
        parts = (tree.ids.astype("<i8"), tree.begin.astype("<i8"), tree.vectors.astype("<f8"), tree.nodes)
        return pd.DataFrame([(key[0], key[1], *(x.tobytes() for x in parts))], columns=["dim", "shard", "ids", "begin", "vectors", "nodes"])

    dealt = valid.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return written(dealt.groupBy("dim", "shard").applyInPandas(one, INDEX), "vp-trees")


def _search(k: int, relax: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch[name][n] for name in batch.schema.names}
                dim = row["dim"].as_py()
                raw = {name: row[name].as_buffer() for name in ("ids", "begin", "vectors", "nodes")}
                tree = Tree(
                    np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["begin"], "<i8"),
                    np.frombuffer(raw["vectors"], "<f8").reshape(-1, dim), np.frombuffer(raw["nodes"], NODE),
                )
                asked = row["queries"].values
                query_ids = asked.field("vec_id").to_numpy()
                queries = asked.field("vector").flatten().to_numpy().reshape(-1, dim) + 0.0
                score, found, _ = tree.search(queries, query_ids, k, relax)
                hit = np.isfinite(score)
                yield pa.RecordBatch.from_pydict(
                    {"query_id": np.repeat(query_ids, hit.sum(1)), "vec_id": found[hit], "score": score[hit]}
                )

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = RELAX,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors nearest each query, nearest first.

    ``queries`` are rows like those of ``vectors``; a query's own id is no neighbour of it. Ties go
    to the smaller vec_id. Rows without id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; vectors of other lengths are not compared. With fewer
    candidates all are returned; a repeated row is as many neighbours. No vectors or no queries give
    no rows.
    """
    session_of(vectors)
    index = build(_valid(vectors, vec_id, embedding))
    asked = written(_valid(queries, vec_id, embedding), "queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    shards = index.select("dim", "shard")
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    # Every pair of a shard and a block of queries of its length is one unit of work.
    trees = index.select("*", block)
    grouped = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
        .join(shards, "dim")
    )
    work = trees.join(grouped, ["dim", "shard", "block"])
    near = map_arrow(work, _search(k, relax), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
