"""Approximate nearest neighbours by largest inner product: stable projections, a kd-tree, and a chi-square stop.

Vectors are scaled by the greatest norm and get one more component that makes all norms equal, so the largest inner
product is the least distance. Gaussian projections to M dimensions are 2-stable: for two vectors at distance r, the
squared distance of their projections over r squared is chi-square with M degrees of freedom. So once the k-th best
vector found lies at distance r, a vector whose projection lies beyond sqrt(q) * r is nearer with probability 1 - STOP
at most, where q is the STOP quantile of chi-square. Projected neighbours are verified, nearest first, in batches of
growing size, until that test holds for the next one.

A kd-tree over the projections deals all rows into cells. A query first searches a part of its own cell, which bounds
its distance, then descends the tree along the boxes of the nodes, and goes only to the cells that the test leaves open.

The tree is fitted on a bounded sample (at most SAMPLE rows, LEAF_SAMPLE for each cell); every row is indexed. Cells
that hold more than CELL_ROWS rows are split by a hash of the id, so copies never pile up.

Results for odd input: vectors that are null, all zero, or hold null or non-finite components, and rows with a null id,
take no part; vectors meet only vectors of their own length; fewer candidates than k are all returned; ties go to the
smaller id, copies included; rows that repeat an id are candidates each, but never for their own id, and as a query the
least of their vectors counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import written
from .common import hash_sample, map_batches

K, M, STOP = 20, 24, 0.9
SAMPLE, LEAF_SAMPLE = 20_000, 16
#: Rows of a part of a cell, queries that visit a part together, and queries whose distances are held at once, about.
CELL_ROWS, QUERY_ROWS, ROUND_QUERIES = 4_096, 4_096, 256


def chi_square_quantile(p: float, m: int) -> float:
    """By bisection on the distribution function's series."""

    def below(x: float) -> float:
        # regularized lower gamma of m/2 at x/2
        a, z = m / 2, x / 2
        term = total = 1 / a
        k = a
        while term > 1e-14 * total:
            k += 1
            term *= z / k
            total += term
        return exp(-z + a * log(z) - lgamma(a)) * total if z > 0 else 0.0

    low, high = 0.0, 10.0 * m + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Tree:
    """Projection and kd-tree. A node splits a dimension at a value; the leaves are cells. Boxes bound the projections."""

    norm: float
    matrix: np.ndarray
    dimension: np.ndarray
    value: np.ndarray
    levels: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    parts: np.ndarray | None = None

    def project(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        x = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) if query else self.norm)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return x @ self.matrix[:-1] + last[:, None] * self.matrix[-1]

    def reach(self, queries: np.ndarray, score: np.ndarray, quantile: float) -> np.ndarray:
        """The squared projected distance up to which a vector may still beat a score; without end for a score of -inf."""
        scale = self.norm * np.linalg.norm(queries, axis=1)
        return quantile * (2 - 2 * np.minimum(1.0, score / scale)) + 1e-12

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dimension[node]] > self.value[node])
        return node - (2**self.levels - 1)

    def bound(self, cells: list[int], low: np.ndarray, high: np.ndarray, parts: list[int]) -> None:
        """Takes the boxes of the cells that hold rows, and the parts they are split into; nodes bound their children."""
        n, first = 2 ** (self.levels + 1) - 1, 2**self.levels - 1
        self.low, self.high, self.parts = np.full((n, M), np.inf), np.full((n, M), -np.inf), np.zeros(2**self.levels, np.int64)
        at = np.array(cells, np.int64)
        self.low[first + at], self.high[first + at], self.parts[at] = low, high, parts
        for node in range(first - 1, -1, -1):
            self.low[node] = self.low[2 * node + 1 : 2 * node + 3].min(axis=0)
            self.high[node] = self.high[2 * node + 1 : 2 * node + 3].max(axis=0)

    def descend(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of every cell whose box lies within a query's reach."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(self.levels + 1):
            gap = np.maximum(0, np.maximum(self.low[node] - points[who], points[who] - self.high[node]))
            near = (gap * gap).sum(axis=1) <= reach[who]
            who, node = who[near], node[near]
            if level < self.levels:
                who, node = np.repeat(who, 2), np.repeat(2 * node + 1, 2)
                node[1::2] += 1
        return who, node - (2**self.levels - 1)


def fit(sample: np.ndarray, norm: float, cells: int, seed: int = 17) -> Tree:
    d = sample.shape[1]
    matrix = np.random.default_rng(seed).normal(size=(d + 1, M))
    levels = max(0, ceil(np.log2(max(1, cells))))
    while levels and 2**levels * LEAF_SAMPLE > len(sample):
        levels -= 1
    tree = Tree(norm, matrix, np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), levels)
    points = tree.project(sample, query=False)
    held = {0: np.arange(len(points))}
    for node in range(2**levels - 1):
        rows = held.pop(node)
        own = points[rows]
        right = np.zeros(len(own), bool)
        if len(own):
            axis = tree.dimension[node] = int(np.ptp(own, axis=0).argmax())
            tree.value[node] = float(np.median(own[:, axis]))
            right = own[:, axis] > tree.value[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return tree


class Cell:
    """A part of a cell: its vectors and their projections; equal vectors are kept once, with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tree: Tree) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.tree, self.points = tree, tree.project(self.vectors, query=False)
        self.squares = (self.points * self.points).sum(axis=1)
        group = np.argsort(inverse, kind="stable")
        self.ids, self.starts = ids[group], np.searchsorted(inverse[group], np.arange(len(self.vectors) + 1))
        self.verified = 0

    def search(self, query: np.ndarray, distance: np.ndarray, least: float, quantile: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the verified vectors that the k best and all their ties are among.

        distance: squared, from the query's projection to those here; least: a score that the k-th neighbour is known
        to reach, or -inf. A vector that only the query's own row holds still counts, so k + 1 bound the distance.
        """
        size = 4 * (k + 1)
        near = np.argpartition(distance, size)[:size] if size < len(distance) else np.arange(len(distance))
        order = near[np.argsort(distance[near], kind="stable")]
        found, scores, at, all_sorted = [], [], 0, False
        norm = query[None]
        while True:
            best = np.concatenate(scores) if scores else np.zeros(0)
            bound = max(least, float(np.partition(best, -(k + 1))[-(k + 1)]) if len(best) > k else -np.inf)
            reach = self.tree.reach(norm, np.array([bound]), quantile)[0]
            if not all_sorted and at >= len(order):
                rest = np.flatnonzero(distance <= reach)
                order = np.concatenate([order, np.setdiff1d(rest, order, assume_unique=True)])
                order[at:] = order[at:][np.argsort(distance[order[at:]], kind="stable")]
                all_sorted = True
            batch = order[at : at + size]
            batch = batch[distance[batch] <= reach]
            if not len(batch):
                break
            found.append(batch)
            scores.append((query[None] * self.vectors[batch]).sum(axis=1))
            at, size = at + size, 2 * size
        self.verified += sum(map(len, found))
        return (np.concatenate(found), np.concatenate(scores)) if found else (np.zeros(0, np.int64), np.zeros(0))

    def _least_ids(self, vector: int, but: int, k: int) -> np.ndarray:
        """The k least ids that hold a vector, one id left out."""
        ids = self.ids[self.starts[vector] : self.starts[vector + 1]]
        a, b = np.searchsorted(ids, but, "left"), np.searchsorted(ids, but, "right")
        return np.concatenate([ids[: min(a, k)], ids[b : b + k]])[:k]

    def neighbours(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, quantile: float, k: int):
        """(query id, neighbour id, exact score) of the k best found here for each query."""
        out = []
        for a in range(0, len(queries), ROUND_QUERIES):
            points = self.tree.project(queries[a : a + ROUND_QUERIES], query=True)
            distances = np.maximum(0, (points * points).sum(axis=1)[:, None] + self.squares - 2 * points @ self.points.T)
            for i, distance in enumerate(distances, a):
                found, exact = self.search(queries[i], distance, float(least[i]), quantile, k)
                if len(found) > k + 1:
                    keep = exact >= np.partition(exact, -(k + 1))[-(k + 1)]
                    found, exact = found[keep], exact[keep]
                if not len(found):
                    continue
                ids = [self._least_ids(f, query_ids[i], k) for f in found]
                scores = np.repeat(exact, [len(x) for x in ids])
                ids = np.concatenate(ids)
                order = np.lexsort((ids, -scores))[:k]
                out.append((np.full(len(order), query_ids[i]), ids[order], scores[order]))
        return out


def usable(vector: Column) -> Column:
    """Not null, all components finite, one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(
    table: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K, stop: float = STOP, verified=None
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row of table where is_query holds.

    verified: an accumulator to which the number of vectors verified is added, if given.
    """
    rows = table.select(
        table[id_column].cast("bigint").alias("id"), table[vector].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).filter(F.col("id").isNotNull())
    rows = rows.filter(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(
        F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")
    )
    found = [
        _search(rows.filter(F.size("v") == r["d"]), r["n"], r["q"], r["norm"], k, chi_square_quantile(stop, M), verified)
        for r in sizes.orderBy("d").collect()
        if r["q"]
    ]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.union, found)


def _search(rows: DataFrame, n: int, n_queries: int, norm: float, k: int, quantile: float, verified) -> DataFrame:
    """search() among rows (id, v, q) of n vectors of one length."""
    spark = rows.sparkSession
    sample = _matrix(hash_sample(rows.select("id", "v"), "id", SAMPLE).toArrow().column("v"))
    tree = fit(sample, norm * (1 + 1e-9), ceil(n / CELL_ROWS))
    fitted = spark.sparkContext.broadcast(tree)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = fitted.value.project(_matrix(batch.column("v")), query=False)
        home = fitted.value.cells(points).astype(np.int32)
        projected = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * M), pa.array(points.reshape(-1)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), projected], [*batch.schema.names, "cell", "p"])

    placed = written(map_batches(rows, place, "id bigint, v array<double>, q boolean, cell int, p array<double>"), "placed")
    # One row for each cell: SAMPLE / LEAF_SAMPLE of them at most.
    ends = [f(F.col("p")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(M)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()
    parts = [ceil(r["n"] / CELL_ROWS) for r in cells]
    low, high = (np.array([[r[f"{name}{j}"] for j in range(M)] for r in cells]).reshape(-1, M) for name in ("low", "high"))
    tree.bound([r["cell"] for r in cells], low, high, parts)
    shared = spark.sparkContext.broadcast(tree)
    split = F.broadcast(spark.createDataFrame([(r["cell"], p) for r, p in zip(cells, parts, strict=True)], "cell int, parts int"))
    indexed = placed.join(split, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    once = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    lot = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(max(1, ceil(n_queries / QUERY_ROWS)))).cast("int").alias("lot")
    asked = placed.filter("q").withColumn("once", once).filter("once = 1").select("id", "v", "cell", lot)

    def answer(cell_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        out = []
        if len(cell_rows) and len(query_rows):
            cell = Cell(cell_rows.column("id").to_numpy(), _matrix(cell_rows.column("v")), shared.value)
            out = cell.neighbours(query_rows.column("id").to_numpy(), _matrix(query_rows.column("v")), query_rows.column("least").to_numpy(), quantile, k)
            if verified is not None:
                verified.add(cell.verified)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def visits(queries: DataFrame) -> DataFrame:
        """queries: (id, v, lot, least, cell, part). Each part meets the queries of one lot at a time."""
        queries = queries.toDF(*queries.columns)  # own column ids, as both sides stem from one table
        lots = queries.select("cell", "part", "lot").distinct().toDF("cell", "part", "lot")
        ours = indexed.join(lots, ["cell", "part"])
        key = ["cell", "part", "lot"]
        return ours.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(answer, "query_id bigint, vec_id bigint, score double")

    one_of = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts")).cast("int")
    home = asked.join(split, "cell").select("id", "v", "lot", F.lit(float("-inf")).alias("least"), "cell", one_of.alias("part"))
    first = written(visits(home), "first")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = first.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = home.drop("least").join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def route(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROUND_QUERIES):
                batch = whole.slice(a, ROUND_QUERIES)
                vectors = _matrix(batch.column("v"))
                reach = shared.value.reach(vectors, batch.column("least").to_numpy(), quantile)
                who, cell = shared.value.descend(shared.value.project(vectors, query=True), reach)
                times = shared.value.parts[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                new = (cell != batch.column("cell").to_numpy()[who]) | (part != batch.column("part").to_numpy()[who])  # the others are done
                picked = batch.take(pa.array(who[new]))
                columns = [picked.column(c) for c in ("id", "v", "lot", "least")] + [pa.array(x[new].astype(np.int32)) for x in (cell, part)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "lot", "least", "cell", "part"])

    schema = "id bigint, v array<double>, lot int, least double, cell int, part int"
    second = visits(rest.select("id", "v", "lot", "least", "cell", "part").mapInArrow(route, schema))
    ranked = first.union(second).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
