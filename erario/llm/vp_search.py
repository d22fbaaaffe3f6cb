"""Nearest neighbours by largest inner product: one vantage-point tree for each shard of the vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LEAF = 128
#: Rounding of a squared distance, as a share of the squared norms it comes from.
ROUNDING = 1e-12
#: Query blocks that one task meets with a tree.
TASK_BLOCKS = 64
INDEX = "shard long, dim int, tree binary"
FOUND = "query_id long, vec_id long, score double"


class Tree:
    """A vantage-point tree over the distinct vectors of a shard.

    Vectors get one more coordinate, ``sqrt(M^2 - |x|^2)`` with the shard's largest norm M, so
    that the Euclidean distance to a query (with 0 there) falls as the inner product grows:
    ``d^2 = |q|^2 + M^2 - 2 q.x``.  Nodes are arrays: the points ``lo:hi`` below, the vantage
    point's distances to them at least and at most, and the number of the second child.
    """

    FIELDS = ("points", "ids", "firsts", "lo", "hi", "pivot", "near", "far", "second", "norm")

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        tree = cls()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        if (ids[1:] == ids[:-1]).any():  # of an id's rows the smallest vector counts
            order = np.lexsort((*vectors.T[::-1], ids))
            order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
            ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        as_bytes = vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel()
        _, first, group = np.unique(as_bytes, return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")  # ids ascending within a group of equal vectors
        starts = np.r_[0, np.cumsum(np.bincount(group))]
        distinct = vectors[first].astype(np.float64)
        squares = (distinct**2).sum(1)
        tree.norm = np.array(squares.max())
        wide = np.c_[distinct, np.sqrt(np.maximum(tree.norm - squares, 0))]
        place, nodes, stack = np.arange(len(wide)), [], [(0, len(wide), -1, -1.0, -1.0)]
        while stack:  # depth first, so a node's first child is the next node
            lo, hi, parent, near, far = stack.pop()
            if parent >= 0:
                nodes[parent][5] = len(nodes)
            node = [lo, hi, -1, near, far, -1]
            nodes.append(node)
            if hi - lo <= LEAF:
                continue
            own = place[lo:hi]
            pivot = own[(7919 * (lo + 1)) % (hi - lo)]
            d = np.sqrt(((wide[own] - wide[pivot]) ** 2).sum(1))
            half = (hi - lo) // 2
            split = np.argpartition(d, half)
            place[lo:hi], d = own[split], d[split]
            node[2] = pivot
            me = len(nodes) - 1
            stack.append((lo + half, hi, me, d[half:].min(), d[half:].max()))
            stack.append((lo, lo + half, -1, d[:half].min(), d[:half].max()))
        tree.lo, tree.hi, tree.pivot, tree.near, tree.far, tree.second = (np.array(c) for c in zip(*nodes, strict=True))
        tree.pivot = np.where(tree.pivot >= 0, np.argsort(place)[tree.pivot], -1)
        tree.points = vectors[first][place]
        members = [by_group[starts[g] : starts[g + 1]] for g in group[first][place]]
        tree.ids, tree.firsts = ids[np.concatenate(members)], np.r_[0, np.cumsum([len(m) for m in members])]
        return tree

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Tree:
        tree, stored = cls(), np.load(io.BytesIO(data))
        for name in cls.FIELDS:
            setattr(tree, name, stored[name])
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query number, vec_id, score)`` of each query's k nearest here, its own row left out.

        A child is left out when ``factor`` times its smallest possible distance is above the
        distance of the query's k-th best so far; with factor 1 no nearer point can be lost.
        Distances are rounded, so queries that had to leave out a point about as near as the
        last one kept are looked up again, with exact scores and ids deciding.
        """
        points = self.points.astype(np.float64)
        keep = min(k + 1, len(points))  # distinct vectors; one more for the query's own
        best = np.full((len(queries), keep), np.inf)
        which = np.full((len(queries), keep), -1)
        base = (queries**2).sum(1) + self.norm
        margin = ROUNDING * base  # of squared distances
        left_out = np.full(len(queries), np.inf)

        def scan(node: int, active: np.ndarray) -> None:
            at = np.arange(self.lo[node], self.hi[node])
            d = base[active, None] - 2 * (queries[active] @ points[at].T)
            both = np.c_[best[active], d]
            names = np.c_[which[active], np.broadcast_to(at, d.shape)]
            order = np.argpartition(both, (keep - 1, keep), axis=1)  # there are more than ``keep``
            cut = order[:, :keep]
            left_out[active] = np.minimum(left_out[active], np.take_along_axis(both, order[:, keep : keep + 1], 1)[:, 0])
            best[active], which[active] = np.take_along_axis(both, cut, 1), np.take_along_axis(names, cut, 1)

        def bound(active: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(best[active].max(1), 0)) + np.sqrt(margin[active])

        def visit(node: int, active: np.ndarray, scan=scan) -> None:
            if self.pivot[node] < 0:
                scan(node, active)
                return
            p = self.pivot[node]
            d = np.sqrt(np.maximum(base[active] - 2 * (queries[active] @ points[p]), 0))
            children = (node + 1, self.second[node])
            lower = [np.maximum(np.maximum(self.near[c] - d, d - self.far[c]), 0) for c in children]
            first = lower[0] <= lower[1]
            for turn in (0, 1):  # each query takes its nearer child first
                for c in (0, 1):
                    mine = first if (c == 0) == (turn == 0) else ~first
                    mine = mine & (factor * lower[c] <= bound(active))
                    if mine.any():
                        visit(children[c], active[mine], scan)

        def scores(row: np.ndarray, point: np.ndarray) -> np.ndarray:
            score = np.zeros(len(row))
            for j in range(points.shape[1]):  # one order of summing everywhere, so equal vectors score the same
                score += queries[row, j] * points[point, j]
            return score

        visit(0, np.arange(len(queries)))
        for query in np.flatnonzero(left_out <= best.max(1) + 2 * margin):
            near: list[np.ndarray] = []

            def gather(node: int, active: np.ndarray, near=near) -> None:
                at = np.arange(self.lo[node], self.hi[node])
                d = base[active[0]] - 2 * (points[at] @ queries[active[0]])
                near.append(at[d <= best[active[0]].max() + 2 * margin[active[0]]])

            visit(0, np.array([query]), gather)
            tied = np.concatenate(near)
            exact = scores(np.full(len(tied), query), tied)
            which[query] = tied[np.lexsort((self.ids[self.firsts[tied]], -exact))[:keep]]
        row, col = np.nonzero(which >= 0)
        point = which[row, col]
        score = scores(row, point)
        held = np.minimum(self.firsts[point + 1] - self.firsts[point], k + 1)  # of equal vectors only the smallest ids can be among the k
        row, score, point = np.repeat(row, held), np.repeat(score, held), np.repeat(point, held)
        ids = self.ids[self.firsts[point] + np.arange(len(point)) - np.repeat(np.cumsum(held) - held, held)]
        other = ids != query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], ids[rank < k], score[rank < k]


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors without null or non-finite components, with at least one that is not zero, and with an id."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).filter(F.col("vec_id").isNotNull() & ~bad & some)


def _matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(values), -1)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard, dim, tree``: every usable vector is in the tree of the shard that its id hashes to.

    The number of shards follows the number of rows, so a shard fits one task at any size;
    vectors of unlike length have trees of their own.
    """
    good = usable(vectors).withColumn("dim", F.size("embedding"))
    shards = max(1, -(-good.count() // shard_rows))

    def plant(key, table):
        if not len(table):
            return pa.table({"shard": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "tree": pa.array([], pa.binary())})
        flat = table.column("embedding").combine_chunks()
        tree = Tree.build(table.column("vec_id").to_numpy(), _matrix(flat, flat.type.value_type.to_pandas_dtype()))
        return pa.table({"shard": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "tree": [tree.dumped()]})

    return good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("shard", "dim").applyInArrow(plant, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found in all trees.

    Queries are packed into blocks of bounded size; the blocks travel to the trees of their
    dimension, by key, and leave ``k`` rows a query; those are ranked together.
    ``factor`` 1 is exact; a larger factor leaves out more of each tree.

    Rows with null, zero, short or non-finite vectors take no part; without vectors or
    queries there are no rows; a query's own id is left out, other copies of its vector are
    not; equal scores go by id.  Rows that repeat an id count once, with the smallest of their
    vectors of one length.  Other columns are not read.
    """
    asked = usable(queries).withColumn("dim", F.size("embedding")).groupBy("vec_id", "dim").agg(F.min("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-asked.count() // block))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))  # as many numbers as there are trees
    parts = F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // TASK_BLOCKS).cast("long"))
    met = packed.withColumn("part", F.floor(F.col("block") / TASK_BLOCKS)).join(shards, "dim").withColumn("shard", F.explode("shards")).select("dim", "shard", "part", "queries")
    tasks = index.withColumn("part", F.explode(parts)).join(met, ["dim", "shard", "part"]).select("tree", "queries")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, own in zip(batch.column("tree"), batch.column("queries"), strict=True):
                values = own.values
                ids = values.field("vec_id").to_numpy()
                row, found, score = Tree.loaded(tree.as_py()).search(ids, _matrix(values.field("embedding")), k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = tasks.mapInArrow(look, FOUND)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SEARCH_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
      FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
